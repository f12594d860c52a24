"""Statistics as aggregate expressions and small DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import same_keys, sum_before


def r6(x: Column) -> Column:
    return F.round(x, 6)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null with fewer than three pairs or without variance on a side."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 3) & (spread > 0), F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def rank_sums(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """Per group: n_pos, n_neg and U, the Mann-Whitney count of pos over neg with ties as half.

    Equal values are counted before ranking, and the counts are summed up by ranges of the value: neither a frequent
    value nor a large group is one task's work.
    """
    cells = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    u = F.col("_p") * (F.col("_below") + F.col("_n") / 2)
    counted = sum_before(cells, by, "_v", "_n", "_below").withColumn("_u", u)
    return counted.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum("_u").alias("u"))


def auroc(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    return rank_sums(df, by, value, positive).withColumn("auroc", F.try_divide(F.col("u"), F.col("n_pos") * F.col("n_neg")))


def value_ranks(df: DataFrame, by: list[str], value: str, name: str, times: str = "1") -> tuple[DataFrame, list[tuple[str, str]]]:
    """The values of each group with the mean rank of the rows that have it, nulls among them, and the keys to look it up by.

    A row stands for `times` rows. Distinct values are counted, and the counts summed up by ranges.
    """
    cells = sum_before(df.groupBy(*by, value).agg(F.sum(F.expr(times)).alias("_n")), by, value, "_n", "_below")
    keys = [(c, f"_{name}_key{i}") for i, c in enumerate([*by, value])]
    return cells.select(*[F.col(c).alias(k) for c, k in keys], (F.col("_below") + (F.col("_n") + 1) / 2).alias(name)), keys


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of value within its group; equal values, nulls among them, share the mean of their ranks."""
    ranks, keys = value_ranks(df, by, value, name)
    return df.join(ranks, same_keys(keys)).drop(*[k for _, k in keys])


def centred_ranks(cells: DataFrame, by: str, times: str, values: dict[str, str]) -> DataFrame:
    """Adds the rank of each value within its group, less the group's mean rank, to a table whose rows stand for `times` rows.

    values: the new column of each. All values are ranked from the same table, which is read several times: a stored one
    of counted rows serves best.
    """
    group = "_group"
    sizes = cells.groupBy(F.col(by).alias(group)).agg(((F.sum(times) + 1) / 2).alias("_middle"))
    out = cells.join(F.broadcast(sizes), same_keys([(by, group)])).drop(group)  # a row for each group
    for value, name in values.items():
        ranks, keys = value_ranks(cells, [by], value, name, times)
        out = out.join(ranks, same_keys(keys)).drop(*[k for _, k in keys]).withColumn(name, F.col(name) - F.col("_middle"))
    return out.drop("_middle")


def centred_corr(x: Column, y: Column, times: Column) -> Column:
    """Pearson correlation of centred values, a row standing for `times` rows; null as in safe_corr."""
    spread = F.sqrt(F.sum(times * x * x)) * F.sqrt(F.sum(times * y * y))
    return F.when((F.sum(times) >= 3) & (spread > 0), F.sum(times * x * y) / F.nullif(spread, F.lit(0.0)))


def settled(few: DataFrame, *stored: DataFrame) -> DataFrame:
    """The few rows of a result, computed now, so that what they were made from is stored no longer."""
    rows = few.collect()
    for table in stored:
        table.unpersist()
    return few.sparkSession.createDataFrame(rows, few.schema)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, exact to 1e-12 from 10 on and a product below."""
    small = F.log(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(9))).cast("int")), F.lit(1.0), lambda a, k: a * k))
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n < 10, small).otherwise(series)


def beta_fraction(a: Column, b: Column, x: float, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method; its state is three numbers at any size."""
    start = 1 / (1 - (a + b) * x / (a + 1))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half_step(s: Column, term: Column) -> Column:
        c, d = 1 + term / s["c"], 1 / (1 + term * s["d"])
        return state(c, d, s["h"] * c * d)

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half_step(half_step(s, even), odd)

    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda m: m.cast("double")), state(F.lit(1.0), start, start), step, lambda s: s["h"])


def binomial_p(k: Column, n: Column) -> Column:
    """Two-sided exact binomial test against one half: all outcomes no likelier than k. Null for n = 0.

    The distribution is symmetric and falls away from its middle, so those are the outcomes at least as far out: twice a
    tail, which is an incomplete beta function. Its fraction needs about the root of n steps; at n = 10**8, 50,000.
    """
    least, size = F.greatest(F.least(k, n - k), F.lit(0)).cast("double"), n.cast("double")
    a, b = size - least, least + 1
    steps = F.when(n > 0, F.lit(30) + F.ceil(5 * F.sqrt(size)).cast("int")).otherwise(1)
    front = F.exp(log_factorial(size) - log_factorial(a) - log_factorial(least) - (size + 1) * F.log(F.lit(2.0)))
    return F.when(n > 0, F.when(2 * k == n, 1.0).otherwise(F.least(F.lit(1.0), 2 * front * beta_fraction(a, b, 0.5, steps))))


def hash_draw(n: Column, *parts: Column) -> Column:
    """A number from 0 to n - 1 that is a hash of the parts: the same draw on any engine."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's 95 % interval of a share (an extension)."""
    p, q = F.try_divide(k, n), F.lit(z * z)
    middle, half = p + q / (2 * n), z * F.sqrt(p * (1 - p) / n + q / (4 * n * n))
    return (middle - half) / (1 + q / n), (middle + half) / (1 + q / n)
