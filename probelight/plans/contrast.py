"""Paired-contrast queries: conditions side by side, behaviour, paired accuracy and its tests, effects by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import win_score
from ..functions.stats import auroc, average_ranks, binomial_p, centred_corr, centred_ranks, hash_draw, r6, safe_corr, settled, wilson
from ..operators.order import sum_before
from ..sources.tables import PAIRS_SQL, load, pairs


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).where("delta_b is not null and delta_c is not null").withColumn("shift", F.col("delta_c") - F.col("delta_b"))


def pivot_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("item", "clause", "split", "span_key", r6(F.col("delta_b")).alias("delta_b"), r6(F.col("delta_c")).alias("delta_c"), r6(F.col("delta_none")).alias("delta_none"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.concat_ws("+", *[F.when(F.col(f"delta_{c}").isNotNull(), c) for c in ("b", "c", "none")])
    return pairs(spark, sf_dir).groupBy("split", state.alias("present")).agg(F.count(F.lit(1)).alias("n"))


def _behaviour(df: DataFrame, *by: str) -> DataFrame:
    """Means, positives and crossings in both directions; a missing condition is null and left out of its mean."""
    toward, back = (F.col("delta_b") <= 0) & (F.col("delta_c") > 0), (F.col("delta_b") > 0) & (F.col("delta_c") <= 0)
    resists = F.col("delta_none") <= 0
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("delta_b")).alias("mean_b"), r6(F.avg("delta_c")).alias("mean_c"), r6(F.avg("delta_none")).alias("mean_none"), r6(F.avg("shift")).alias("mean_shift"),
        F.count_if(F.col("shift") > 0).alias("n_toward"), F.count_if(toward).alias("crossed_toward"), F.count_if(back).alias("crossed_back"),
        F.count_if(resists).alias("prior_resists"), F.count_if(resists & (F.col("delta_c") > 0)).alias("flipped"),
    )


BEHAVIOUR_SQL = """count(*) AS n, round(avg(delta_b), 6) AS mean_b, round(avg(delta_c), 6) AS mean_c, round(avg(delta_none), 6) AS mean_none, round(avg(delta_c - delta_b), 6) AS mean_shift,
  count(*) FILTER (delta_c - delta_b > 0) AS n_toward, count(*) FILTER (delta_b <= 0 AND delta_c > 0) AS crossed_toward, count(*) FILTER (delta_b > 0 AND delta_c <= 0) AS crossed_back,
  count(*) FILTER (delta_none <= 0) AS prior_resists, count(*) FILTER (delta_none <= 0 AND delta_c > 0) AS flipped FROM complete"""


def behaviour_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behaviour(complete(spark, sf_dir), "split")


def clause_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behaviour(complete(spark, sf_dir).where("split = 'test'"), "clause")


def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behaviour(complete(spark, sf_dir), "family")


def clause_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of items that shifted, strictly: a tie counts nothing here."""
    return complete(spark, sf_dir).groupBy("clause").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("shift") > 0).cast("int"))).alias("strict_share"), r6(F.stddev_pop("shift")).alias("sd_pop"), r6(F.min("shift")).alias("least"), r6(F.max("shift")).alias("most"))


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossed by separated, among items whose prior resists."""
    d = complete(spark, sf_dir).where("delta_none <= 0")
    crossed, apart = F.col("delta_c") > 0, F.col("shift") > 0
    return d.groupBy("split").agg(F.count_if(crossed & apart).alias("both"), F.count_if(crossed & ~apart).alias("crossed_only"), F.count_if(~crossed & apart).alias("separated_only"), F.count_if(~crossed & ~apart).alias("neither"))


def split_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span keys of the test split that train or dev also has, and the test items they touch."""
    spans = complete(spark, sf_dir).groupBy("span_key").agg(F.collect_set("split").alias("splits"), F.count_if(F.col("split") == "test").alias("n_test"))
    shared = F.array_contains("splits", "test") & (F.array_contains("splits", "train") | F.array_contains("splits", "dev"))
    return spans.agg(F.count(F.lit(1)).alias("keys"), F.count_if(shared).alias("shared_keys"), F.sum(F.when(shared, F.col("n_test")).otherwise(0)).alias("test_items_seen"), F.sum("n_test").alias("test_items"))


def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pairs(spark, sf_dir).groupBy("clause").agg(F.count("delta_b").alias("n_b"), F.count("delta_c").alias("n_c"), F.count("delta_none").alias("n_none"))
    return counts.withColumn("balanced", ((F.col("n_b") == F.col("n_c")) & (F.col("n_c") == F.col("n_none"))).cast("int"))


def paired_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(spark, sf_dir).groupBy("split", "clause").agg(r6(F.avg(win_score(F.col("delta_b"), F.col("delta_c")))).alias("accuracy"), F.count_if(F.col("shift") > 0).alias("wins"), F.count_if(F.col("shift") == 0).alias("ties"), F.count(F.lit(1)).alias("n"))


def paired_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, sign test on the pairs that are not ties, mean margin, Cohen's d with the sample deviation, Wilson's interval (an extension)."""
    g = complete(spark, sf_dir).groupBy("clause").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("shift") > 0).alias("wins"), F.count_if(F.col("shift") == 0).alias("ties"), r6(F.avg("shift")).alias("mean_margin"), r6(F.try_divide(F.avg("shift"), F.stddev_samp("shift"))).alias("cohen_d")
    )
    low, high = wilson(F.col("wins"), F.col("n") - F.col("ties"))
    return g.select("*", r6(binomial_p(F.col("wins"), F.col("n") - F.col("ties"))).alias("sign_p"), r6(low).alias("wilson_low"), r6(high).alias("wilson_high"))


def auroc_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = complete(spark, sf_dir)
    long = d.select("split", F.explode(F.array(F.struct(F.lit(False).alias("pos"), F.col("delta_b").alias("v")), F.struct(F.lit(True).alias("pos"), F.col("delta_c").alias("v")))).alias("x")).select("split", "x.*")
    return auroc(long, ["split"], "v", F.col("pos")).select("split", "n_pos", "n_neg", r6(F.col("auroc")).alias("auroc"))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of shift and prior by clause; null for fewer than three items or no variance.

    The study is read once, as the number of items of each clause, shift and prior; both ranks are made from these.
    """
    cells = complete(spark, sf_dir).where("delta_none is not null").groupBy("clause", "shift", "delta_none").agg(F.count(F.lit(1)).alias("items")).persist()
    ranked = centred_ranks(cells, "clause", "items", {"shift": "rs", "delta_none": "rn"})
    return settled(ranked.groupBy("clause").agg(F.sum("items").alias("n"), r6(centred_corr(F.col("rs"), F.col("rn"), F.col("items"))).alias("rho")), cells)  # a row for each clause


def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_ranks(complete(spark, sf_dir), ["clause"], "delta_b", "rank").select("item", "clause", "rank")


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods on the same items: accuracy difference and the exact test on the pairs where just one is right."""
    d = complete(spark, sf_dir).where("delta_none is not null")
    one, two = F.col("shift") > 0, F.col("delta_c") > F.col("delta_none")
    g = d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(one & ~two).alias("only_one"), F.count_if(~one & two).alias("only_two"), r6(F.avg(one.cast("int")) - F.avg(two.cast("int"))).alias("difference"))
    return g.select("*", r6(binomial_p(F.col("only_one"), F.col("only_one") + F.col("only_two"))).alias("p"), F.when(F.col("n") < 10, "few common items").otherwise("").alias("note"))


def sign_flip_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all sign patterns over the clauses' mean shifts whose mean is at least the observed.

    The clauses are cut in two halves. A pattern's sum is the sum of one pattern of each, so the patterns of both are
    put in one order and, for each of the first, those of the second that reach the rest are counted in passing:
    2 ** (k / 2) sums stand for 2 ** k patterns, and none is left out.
    """
    return sign_flips(complete(spark, sf_dir).groupBy("clause").agg(F.round(F.avg("shift"), 9).alias("m")))


def sign_flips(means: DataFrame) -> DataFrame:
    """k, patterns, at_least and p for the means m of clauses: see sign_flip_exact."""
    spark = means.sparkSession
    placed = means.select("m", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("clause")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("k"))  # a row for each clause
    side = F.when(F.col("i") < F.expr("k div 2"), 0).otherwise(1)
    halves = placed.groupBy(side.alias("half")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("ms"))
    both = spark.range(2).select(F.col("id").cast("int").alias("half")).join(halves, "half", "left").withColumn("ms", F.coalesce("ms", F.array().cast("array<double>")))
    masks = both.select("half", "ms", F.expr("explode(sequence(0, shiftleft(1, size(ms)) - 1))").alias("mask"))
    total = F.aggregate(F.expr("transform(ms, (m, i) -> CASE WHEN (mask & shiftleft(1, i)) > 0 THEN -m ELSE m END)"), F.lit(0.0), lambda a, x: a + x)
    seen = means.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("seen"), F.count(F.lit(1)).cast("int").alias("k"))
    sums = masks.select("half", total.alias("t")).crossJoin(F.broadcast(seen))  # one row
    # A first-half sum asks for the second-half sums that are at least its rest: all of them but those below it.
    asked = sums.select("k", "half", F.when(F.col("half") == 0, F.col("seen") - F.col("t") - 1e-9).otherwise(F.col("t")).alias("v"))
    cells = asked.groupBy("k", "v").agg(F.count_if(F.col("half") == 0).alias("first"), F.count_if(F.col("half") == 1).alias("second"))
    below = sum_before(cells, ["k"], "v", "second", "below")
    reached = F.sum("first") * F.sum("second") - F.sum(F.col("first") * F.col("below"))
    patterns = F.pow(F.lit(2.0), F.col("k")).cast("long")
    return below.groupBy("k").agg(reached.alias("at_least")).select("k", patterns.alias("patterns"), "at_least", r6(F.col("at_least") / patterns).alias("p"))


def cluster_bootstrap(spark: SparkSession, sf_dir: str, draws: int = 2000) -> DataFrame:
    """Whole clauses are drawn by hash; per draw the accuracy over their items. Items are summed by clause first."""
    cells = complete(spark, sf_dir).groupBy("split", "clause").agg(F.sum(win_score(F.col("delta_b"), F.col("delta_c"))).alias("score"), F.count(F.lit(1)).alias("n"))
    ordered = cells.withColumn("i", F.row_number().over(Window.partitionBy("split").orderBy("clause")) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("split")))
    picks = ordered.select("split", "k", F.col("i").alias("slot")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("i", hash_draw(F.col("k"), F.col("b"), F.col("slot")))
    accuracy = picks.join(ordered.select("split", "i", "score", "n"), ["split", "i"]).groupBy("split", "b").agg((F.sum("score") / F.sum("n")).alias("acc"))
    return accuracy.groupBy("split").agg(r6(F.percentile("acc", F.lit(0.025))).alias("low"), r6(F.percentile("acc", F.lit(0.975))).alias("high"), r6(F.avg("acc")).alias("mean"), r6(F.stddev_pop("acc")).alias("sd"))


def stratified_bootstrap(spark: SparkSession, sf_dir: str, draws: int = 100) -> DataFrame:
    """Items drawn within clause and split, the mean shift macro-averaged over clauses; the point estimate has all data."""
    d = complete(spark, sf_dir).where("split = 'test'").select("item", "clause", "shift")
    numbered = d.withColumn("i", F.row_number().over(Window.partitionBy("clause").orderBy("item")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("clause")))
    picks = numbered.select("clause", "n", F.col("i").alias("slot")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("i", hash_draw(F.col("n"), F.col("clause"), F.col("b"), F.col("slot")))
    each = picks.join(numbered.select("clause", "i", "shift"), ["clause", "i"]).groupBy("b", "clause").agg(F.avg("shift").alias("m")).groupBy("b").agg(F.avg("m").alias("macro"))
    point = d.groupBy("clause").agg(F.avg("shift").alias("m")).agg(F.avg("m").alias("point"))
    interval = each.agg(F.percentile("macro", F.lit(0.025)).alias("low"), F.percentile("macro", F.lit(0.975)).alias("high"), F.min("macro").alias("least"), F.max("macro").alias("most"))
    both = interval.crossJoin(point)  # one row each
    return both.select(*[r6(F.col(c)).alias(c) for c in ("low", "high", "least", "most", "point")], F.when(F.col("low") > 0, "above zero").otherwise("not above zero").alias("verdict"))


def headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect against headroom by sign class, and pooled: guarded correlation and slope."""
    d = complete(spark, sf_dir).where("delta_none is not null").withColumn("cls", F.when(F.col("item") % 2 == 0, "AGREE").otherwise("CONFLICT"))
    sign = F.when(F.col("cls") == "AGREE", 1).otherwise(-1)
    d = d.withColumn("effect", sign * (F.col("delta_c") - F.col("delta_none"))).withColumn("room", sign * F.col("delta_none"))
    both = d.withColumn("cls", F.explode(F.array("cls", F.lit("both"))))
    return both.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), r6(safe_corr(F.col("room"), F.col("effect"))).alias("corr"), r6(F.regr_slope("effect", "room")).alias("slope"), r6(F.median("room")).alias("median_room"))


HEADROOM_SQL = """effects AS (SELECT *, CASE WHEN item % 2 = 0 THEN 'AGREE' ELSE 'CONFLICT' END AS cls, (CASE WHEN item % 2 = 0 THEN 1 ELSE -1 END) * (delta_c - delta_none) AS effect, (CASE WHEN item % 2 = 0 THEN 1 ELSE -1 END) * delta_none AS room FROM complete WHERE delta_none IS NOT NULL)"""


def median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items at most the clause's median prior are low; cell means by half and split."""
    d = complete(spark, sf_dir).where("delta_none is not null")
    middle = d.groupBy("clause").agg(F.median("delta_none").alias("mid"))
    half = F.when(F.col("delta_none") <= F.col("mid"), "low").otherwise("high")
    return d.join(middle, "clause").groupBy("split", half.alias("half")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("shift")).alias("mean_shift"))


def condition_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(spark, sf_dir).groupBy("clause").agg(r6(F.avg("delta_c") - F.avg("delta_b") + 1e-9).alias("gap"), F.signum(F.avg("delta_c") - F.avg("delta_b")).cast("int").alias("direction"))


def spillover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring items' shifts against each other: mean, population deviation, largest size."""
    d = complete(spark, sf_dir).select("item", "clause", "shift")
    other = d.select((F.col("item") - 1).alias("item"), F.col("clause").alias("next_clause"), F.col("shift").alias("next_shift"))
    both = d.join(other, "item")
    return both.groupBy((F.col("clause") == F.col("next_clause")).cast("int").alias("same_clause")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("next_shift") - F.col("shift"))).alias("mean"), r6(F.stddev_pop(F.col("next_shift") - F.col("shift"))).alias("sd"), r6(F.max(F.abs(F.col("next_shift") - F.col("shift")))).alias("largest"))


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts within one of zero, above and below, and whether they are on the grid of eighths."""
    band = F.when(F.abs("shift") <= 1, "flat").when(F.col("shift") > 0, "up").otherwise("down")
    grid = F.abs(8 * F.col("shift") - F.bround(8 * F.col("shift"))) < 1e-6
    return complete(spark, sf_dir).groupBy(band.alias("band"), grid.cast("int").alias("on_grid")).agg(F.count(F.lit(1)).alias("n"))


def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance by segment: mean within nation, then the plain mean of the nations."""
    c = load(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.count(F.lit(1)).alias("n"))
    return c.groupBy("c_mktsegment").agg(r6(F.avg("m")).alias("macro"), r6(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("micro"), F.count(F.lit(1)).alias("cells"))


def cell_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell means by status and priority, and each status's largest cell."""
    cells = load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return cells.groupBy("o_orderstatus").agg(r6(F.max("m")).alias("largest"), F.max_by("o_orderpriority", F.struct("m", "o_orderpriority")).alias("cell"))


def record_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded lengths of documents against those of their texts: largest difference and how many are off, by source."""
    d = load(spark, sf_dir, "documents").withColumn("off", F.abs(F.col("n_chars") - F.length("text")))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("off") > 1e-3, F.lit(True))).alias("n_off"), F.max("off").alias("largest"))


def probe_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign flips of each clause's prior between two phrasings (even and odd items), against the rule of more than two."""
    d = pairs(spark, sf_dir).where("delta_none is not null").groupBy("clause").agg(F.avg(F.when(F.col("item") % 2 == 0, F.col("delta_none"))).alias("even"), F.avg(F.when(F.col("item") % 2 == 1, F.col("delta_none"))).alias("odd"))
    flip = F.signum("even") != F.signum("odd")
    return d.agg(F.count(F.lit(1)).alias("clauses"), F.count_if(flip).alias("flips"), F.when(F.count_if(flip) > 2, "KILL").otherwise("PASS").alias("verdict"), r6(F.avg(F.abs(F.col("even") - F.col("odd")))).alias("mean_difference"), r6(F.avg((F.abs("even") + F.abs("odd")) / 4)).alias("half_effect"))


def says_by_crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = F.when(F.col("delta_none") > 0, "says").otherwise("denies")
    crossed = F.when((F.col("delta_b") <= 0) & (F.col("delta_c") > 0), "crossed").otherwise("stayed")
    return complete(spark, sf_dir).where("delta_none is not null").groupBy(F.concat_ws("/", says, crossed).alias("cell")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("shift")).alias("mean_shift"))


_W = f"WITH {PAIRS_SQL} "
QUERIES = {
    "pivot_conditions": pivot_conditions, "completeness": completeness, "behaviour_by_split": behaviour_by_split, "clause_summary": clause_summary, "family_summary": family_summary, "clause_pooled": clause_pooled,
    "contingency": contingency, "split_hygiene": split_hygiene, "balance_check": balance_check, "paired_accuracy": paired_accuracy, "paired_evaluation": paired_evaluation, "auroc": auroc_by_split, "spearman": spearman,
    "avg_rank": avg_rank, "mcnemar": mcnemar, "sign_flip_exact": sign_flip_exact, "cluster_boot_hash": cluster_bootstrap, "stratified_boot_hash": stratified_bootstrap, "headroom_corr": headroom, "median_split": median_split,
    "condition_gap": condition_gap, "spillover": spillover, "score_bands": score_bands, "macro_average": macro_average, "cell_max": cell_max, "record_integrity": record_integrity, "probe_signs": probe_signs, "says_by_crossed": says_by_crossed,
}

# Every outcome up to the smaller count is summed up, however many there are.
_BINOMIAL = "CASE WHEN {n} = 0 THEN NULL WHEN 2 * {k} = {n} THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({k}, {n} - {k}) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))))) END"
_DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
ORACLES = {
    "pivot_conditions": _W + "SELECT item, clause, split, span_key, round(delta_b, 6) AS delta_b, round(delta_c, 6) AS delta_c, round(delta_none, 6) AS delta_none FROM pairs",
    "completeness": _W + "SELECT split, concat_ws('+', CASE WHEN delta_b IS NOT NULL THEN 'b' END, CASE WHEN delta_c IS NOT NULL THEN 'c' END, CASE WHEN delta_none IS NOT NULL THEN 'none' END) AS present, count(*) AS n FROM pairs GROUP BY 1, 2",
    "behaviour_by_split": _W + "SELECT split, " + BEHAVIOUR_SQL + " GROUP BY split",
    "clause_summary": _W + "SELECT clause, " + BEHAVIOUR_SQL + " WHERE split = 'test' GROUP BY clause",
    "family_summary": _W + "SELECT family, " + BEHAVIOUR_SQL + " GROUP BY family",
    "clause_pooled": _W + "SELECT clause, count(*) AS n, round(avg((delta_c > delta_b)::INT), 6) AS strict_share, round(stddev_pop(delta_c - delta_b), 6) AS sd_pop, round(min(delta_c - delta_b), 6) AS least, round(max(delta_c - delta_b), 6) AS most FROM complete GROUP BY 1",
    "contingency": _W + "SELECT split, count(*) FILTER (c AND s) AS both, count(*) FILTER (c AND NOT s) AS crossed_only, count(*) FILTER (NOT c AND s) AS separated_only, count(*) FILTER (NOT c AND NOT s) AS neither FROM (SELECT split, delta_c > 0 AS c, delta_c > delta_b AS s FROM complete WHERE delta_none <= 0) GROUP BY 1",
    "split_hygiene": _W + ", spans AS (SELECT span_key, bool_or(split = 'test') AND bool_or(split <> 'test') AS shared, count(*) FILTER (split = 'test') AS n_test FROM complete GROUP BY 1) SELECT count(*) AS keys, count(*) FILTER (shared) AS shared_keys, sum(CASE WHEN shared THEN n_test ELSE 0 END)::BIGINT AS test_items_seen, sum(n_test)::BIGINT AS test_items FROM spans",
    "balance_check": _W + "SELECT clause, count(delta_b) AS n_b, count(delta_c) AS n_c, count(delta_none) AS n_none, (count(delta_b) = count(delta_c) AND count(delta_c) = count(delta_none))::INTEGER AS balanced FROM pairs GROUP BY 1",
    "paired_accuracy": _W + "SELECT split, clause, round(avg(CASE WHEN delta_c > delta_b THEN 1.0 WHEN delta_c = delta_b THEN 0.5 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (delta_c > delta_b) AS wins, count(*) FILTER (delta_c = delta_b) AS ties, count(*) AS n FROM complete GROUP BY 1, 2",
    "paired_evaluation": _W + f""", g AS (SELECT clause, count(*) AS n, count(*) FILTER (delta_c > delta_b) AS wins, count(*) FILTER (delta_c = delta_b) AS ties, round(avg(delta_c - delta_b), 6) AS mean_margin, round(avg(delta_c - delta_b) / stddev_samp(delta_c - delta_b), 6) AS cohen_d FROM complete GROUP BY 1),
      h AS (SELECT *, n - ties AS m, wins / (n - ties) AS p, 1.959963984540054::DOUBLE AS z FROM g)
      SELECT clause, n, wins, ties, mean_margin, cohen_d, round({_BINOMIAL.format(k='wins', n='m')}, 6) AS sign_p, round((p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m), 6) AS wilson_low,
        round((p + z * z / (2 * m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m), 6) AS wilson_high FROM h""",
    "auroc": _W + ", long AS (SELECT split, FALSE AS pos, delta_b AS v FROM complete UNION ALL SELECT split, TRUE, delta_c FROM complete), ranked AS (SELECT split, pos, rank() OVER (PARTITION BY split ORDER BY v) + (count(*) OVER (PARTITION BY split, v) - 1) / 2 AS r FROM long) SELECT split, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auroc FROM ranked GROUP BY 1",
    "spearman": _W + ", ranked AS (SELECT clause, rank() OVER (PARTITION BY clause ORDER BY delta_c - delta_b) + (count(*) OVER (PARTITION BY clause, delta_c - delta_b) - 1) / 2 AS rs, rank() OVER (PARTITION BY clause ORDER BY delta_none) + (count(*) OVER (PARTITION BY clause, delta_none) - 1) / 2 AS rn FROM complete WHERE delta_none IS NOT NULL) SELECT clause, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(rs) * stddev_pop(rn) > 0 THEN round(covar_pop(rs, rn) / (stddev_pop(rs) * stddev_pop(rn)), 6) END AS rho FROM ranked GROUP BY 1",
    "avg_rank": _W + "SELECT item, clause, rank() OVER (PARTITION BY clause ORDER BY delta_b) + (count(*) OVER (PARTITION BY clause, delta_b) - 1) / 2 AS rank FROM complete",
    "mcnemar": _W + f", g AS (SELECT split, count(*) AS n, count(*) FILTER (delta_c > delta_b AND NOT delta_c > delta_none) AS only_one, count(*) FILTER (NOT delta_c > delta_b AND delta_c > delta_none) AS only_two, round(avg((delta_c > delta_b)::INT) - avg((delta_c > delta_none)::INT), 6) AS difference FROM complete WHERE delta_none IS NOT NULL GROUP BY 1) SELECT *, round({_BINOMIAL.format(k='only_one', n='(only_one + only_two)')}, 6) AS p, CASE WHEN n < 10 THEN 'few common items' ELSE '' END AS note FROM g",
    "sign_flip_exact": _W + """, ms AS (SELECT round(avg(delta_c - delta_b), 9) AS m, row_number() OVER (ORDER BY clause) - 1 AS i, count(*) OVER () AS k FROM complete GROUP BY clause), k AS (SELECT count(*) AS k, sum(m) AS seen FROM ms),
      one AS (SELECT mask, coalesce(sum(CASE WHEN (mask >> i) & 1 = 1 THEN -m ELSE m END), 0) AS t FROM (SELECT unnest(range(0, (1 << (SELECT k // 2 FROM k))::BIGINT)) AS mask) LEFT JOIN (SELECT * FROM ms WHERE i < k // 2) ON TRUE GROUP BY mask),
      two AS (SELECT mask, sum(CASE WHEN (mask >> (i - k // 2)) & 1 = 1 THEN -m ELSE m END) AS t FROM (SELECT unnest(range(0, (1 << (SELECT k - k // 2 FROM k))::BIGINT)) AS mask), (SELECT * FROM ms WHERE i >= k // 2) GROUP BY mask),
      n AS (SELECT count(*) AS patterns, count(*) FILTER (one.t + two.t >= seen - 1e-9) AS at_least FROM one, two, k) SELECT k::INTEGER AS k, patterns, at_least, round(at_least / patterns, 6) AS p FROM n, k""",
    "cluster_boot_hash": _W + f", cells AS (SELECT split, clause, sum(CASE WHEN delta_c > delta_b THEN 1.0 WHEN delta_c = delta_b THEN 0.5 ELSE 0.0 END)::DOUBLE AS score, count(*) AS n FROM complete GROUP BY 1, 2), ordered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY clause) - 1 AS i, count(*) OVER (PARTITION BY split) AS k FROM cells), picks AS (SELECT split, b, {_DRAW.format(chr(98) + ' || chr(58) || i')} % k AS i FROM ordered, (SELECT unnest(range(0, 2000)) AS b)), acc AS (SELECT p.split, b, sum(score) / sum(n) AS acc FROM picks p JOIN ordered o ON o.split = p.split AND o.i = p.i GROUP BY 1, 2) SELECT split, round(quantile_cont(acc, 0.025), 6) AS low, round(quantile_cont(acc, 0.975), 6) AS high, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS sd FROM acc GROUP BY 1",
    "stratified_boot_hash": _W + f", d AS (SELECT clause, delta_c - delta_b AS shift, row_number() OVER (PARTITION BY clause ORDER BY item) - 1 AS i, count(*) OVER (PARTITION BY clause) AS n FROM complete WHERE split = 'test'), picks AS (SELECT clause, b, {_DRAW.format('clause || chr(58) || b || chr(58) || i')} % n AS i FROM d, (SELECT unnest(range(0, 100)) AS b)), each AS (SELECT b, avg(m) AS macro FROM (SELECT b, p.clause, avg(shift) AS m FROM picks p JOIN d ON d.clause = p.clause AND d.i = p.i GROUP BY 1, 2) GROUP BY b), point AS (SELECT avg(m) AS point FROM (SELECT avg(shift) AS m FROM d GROUP BY clause)), i AS (SELECT quantile_cont(macro, 0.025) AS low, quantile_cont(macro, 0.975) AS high, min(macro) AS least, max(macro) AS most FROM each) SELECT round(low, 6) AS low, round(high, 6) AS high, round(least, 6) AS least, round(most, 6) AS most, round(point, 6) AS point, CASE WHEN low > 0 THEN 'above zero' ELSE 'not above zero' END AS verdict FROM i, point",
    "headroom_corr": _W + ", " + HEADROOM_SQL + ", every AS (SELECT cls, effect, room FROM effects UNION ALL SELECT 'both', effect, room FROM effects) SELECT cls, count(*) AS n, round(corr(room, effect), 6) AS corr, round(regr_slope(effect, room), 6) AS slope, round(median(room), 6) AS median_room FROM every GROUP BY 1",
    "median_split": _W + ", d AS (SELECT *, median(delta_none) OVER (PARTITION BY clause) AS mid FROM complete WHERE delta_none IS NOT NULL) SELECT split, CASE WHEN delta_none <= mid THEN 'low' ELSE 'high' END AS half, count(*) AS n, round(avg(delta_c - delta_b), 6) AS mean_shift FROM d GROUP BY 1, 2",
    "condition_gap": _W + "SELECT clause, round(avg(delta_c) - avg(delta_b) + 1e-9, 6) AS gap, sign(avg(delta_c) - avg(delta_b))::INTEGER AS direction FROM complete GROUP BY 1",
    "spillover": _W + ", d AS (SELECT item, clause, delta_c - delta_b AS shift FROM complete) SELECT (a.clause = b.clause)::INTEGER AS same_clause, count(*) AS n, round(avg(b.shift - a.shift), 6) AS mean, round(stddev_pop(b.shift - a.shift), 6) AS sd, round(max(abs(b.shift - a.shift)), 6) AS largest FROM d a JOIN d b ON b.item = a.item + 1 GROUP BY 1",
    "score_bands": _W + "SELECT CASE WHEN abs(shift) <= 1 THEN 'flat' WHEN shift > 0 THEN 'up' ELSE 'down' END AS band, (abs(8 * shift - round_even(8 * shift, 0)) < 1e-6)::INTEGER AS on_grid, count(*) AS n FROM (SELECT delta_c - delta_b AS shift FROM complete) GROUP BY 1, 2",
    "macro_average": "SELECT c_mktsegment, round(avg(m), 6) AS macro, round(sum(m * n) / sum(n), 6) AS micro, count(*) AS cells FROM (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1",
    "cell_max": "SELECT o_orderstatus, round(max(m), 6) AS largest, arg_max(o_orderpriority, m) AS cell FROM (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1",
    "record_integrity": "SELECT source, count(*) AS n, count(*) FILTER (coalesce(abs(n_chars - length(text)) > 1e-3, TRUE)) AS n_off, max(abs(n_chars - length(text))) AS largest FROM documents GROUP BY 1",
    "probe_signs": _W + ", d AS (SELECT clause, avg(delta_none) FILTER (item % 2 = 0) AS even, avg(delta_none) FILTER (item % 2 = 1) AS odd FROM pairs WHERE delta_none IS NOT NULL GROUP BY 1) SELECT count(*) AS clauses, count(*) FILTER (sign(even) <> sign(odd)) AS flips, CASE WHEN count(*) FILTER (sign(even) <> sign(odd)) > 2 THEN 'KILL' ELSE 'PASS' END AS verdict, round(avg(abs(even - odd)), 6) AS mean_difference, round(avg((abs(even) + abs(odd)) / 4), 6) AS half_effect FROM d",
    "says_by_crossed": _W + "SELECT (CASE WHEN delta_none > 0 THEN 'says' ELSE 'denies' END) || '/' || (CASE WHEN delta_b <= 0 AND delta_c > 0 THEN 'crossed' ELSE 'stayed' END) AS cell, count(*) AS n, round(avg(delta_c - delta_b), 6) AS mean_shift FROM complete WHERE delta_none IS NOT NULL GROUP BY 1",
}
