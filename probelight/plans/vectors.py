"""Vector queries on the embeddings: similarity, contrastive directions, leave-one-group-out margins, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import r6, safe_corr
from ..operators.joins import top_similar
from ..operators.vectors import dot, group_sum, norm, subtract, unit
from ..sources.tables import load


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B vectors are even ids, C the ids after them: pair, clause (label of B), span, b, c, diff."""
    e = load(spark, sf_dir, "embeddings")
    c = e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("pair"), F.col("embedding").alias("c"))
    b = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("pair"), F.col("label").alias("clause"), (F.col("vec_id") % 48).alias("span"), F.col("embedding").alias("b"))
    return b.join(c, "pair").withColumn("diff", subtract(F.col("c"), F.col("b")))


VPAIRS_SQL = """vp AS (
  SELECT b.vec_id AS pair, b.label AS clause, b.vec_id % 48 AS span, list_transform(range(1, len(b.embedding) + 1), lambda i: c.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) AS diff, b.embedding AS b, c.embedding AS c
  FROM embeddings b JOIN embeddings c ON c.vec_id = b.vec_id + 1 WHERE b.vec_id % 2 = 0
), dims AS (SELECT pair, clause, span, unnest(diff) AS x, unnest(range(1, len(diff) + 1)) AS d FROM vp)"""


def similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five earlier vectors with cosine at least 0.25 for every vector."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("vec"))
    queries = e.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return top_similar(queries, e, 5, 0.25).select("query_id", "id", "rank", r6(F.col("score")).alias("score"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(norm(F.col("embedding")))).alias("mean_norm"))


def contrast_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit mean difference, one row a dimension."""
    total = group_sum(vector_pairs(spark, sf_dir), [], "diff", "total").select(unit(F.col("total")).alias("u"))
    return total.select(F.posexplode("u").alias("d", "x")).select((F.col("d") + 1).alias("dim"), r6(F.col("x")).alias("x"))


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of all pairs on the direction of the whole: the direction is one row."""
    p = vector_pairs(spark, sf_dir)
    u = group_sum(p, [], "diff", "total").select(unit(F.col("total")).alias("u"))
    return p.crossJoin(F.broadcast(u)).select("pair", r6(dot(F.col("diff"), F.col("u"))).alias("margin"))


def _left_out(p: DataFrame, by: str) -> DataFrame:
    """Each pair's margin on the direction of all other groups: the sum of all less the group's, in one pass."""
    total = group_sum(p, [], "diff", "total")
    own = group_sum(p, [by], "diff", "own").crossJoin(F.broadcast(total)).select(by, unit(subtract(F.col("total"), F.col("own"))).alias("u"))
    return p.join(own, by).select("pair", "clause", "span", dot(F.col("diff"), F.col("u")).alias("margin"))


def loco_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _left_out(vector_pairs(spark, sf_dir), "clause")
    return m.groupBy("clause").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0))).alias("accuracy"), r6(F.avg("margin")).alias("mean_margin"))


LEAST_REST = 10


def loso_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with spans left out; a span that leaves fewer than ten pairs to fit on is passed over."""
    p = vector_pairs(spark, sf_dir)
    m = _left_out(p, "span")
    g = m.groupBy("span").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("margin")).alias("mean_margin"), F.count_if(F.col("margin") > 0).alias("wins"))
    total = p.agg(F.count(F.lit(1)).alias("_all"))
    return g.crossJoin(F.broadcast(total)).where(F.col("_all") - F.col("n") >= LEAST_REST).drop("_all")  # one row


def layer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of eight dimensions as layers, as many as the vectors have: fitted on three quarters of the spans, accuracy on the rest."""
    p = vector_pairs(spark, sf_dir)
    layers = p.select("pair", (F.col("span") % 4 == 0).alias("dev"), F.explode(F.transform(F.expr("sequence(0, (size(diff) - 1) div 8)"), lambda k: F.struct(k.alias("layer"), F.slice("diff", k * 8 + 1, 8).alias("v")))).alias("x")).select("pair", "dev", "x.layer", "x.v")
    fitted = group_sum(layers.where("not dev"), ["layer"], "v", "total").select("layer", unit(F.col("total")).alias("u"))
    return layers.where("dev").join(fitted, "layer").withColumn("m", dot(F.col("v"), F.col("u"))).groupBy("layer").agg(F.avg((F.col("m") > 0).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def grid_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers by accuracy, then in their order."""
    return layer_accuracy(spark, sf_dir).select("layer", "n", r6(F.col("accuracy")).alias("accuracy")).orderBy(F.desc("accuracy"), "layer").limit(10)


def cosine_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of all pairs of group means: as many rows as groups squared, however many vectors."""
    means = group_sum(load(spark, sf_dir, "embeddings"), ["label"], "embedding", "total").select("label", unit(F.col("total")).alias("u"))
    other = means.select(F.col("label").alias("label_b"), F.col("u").alias("v"))
    return means.withColumnRenamed("label", "label_a").crossJoin(other).where("label_a < label_b").select("label_a", "label_b", r6(dot(F.col("u"), F.col("v"))).alias("cosine"))


def pair_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clause: mean length of differences, coherence with the mean direction, correlation of length and margin."""
    p = vector_pairs(spark, sf_dir)
    u = group_sum(p, [], "diff", "total").select(unit(F.col("total")).alias("u"))
    g = p.crossJoin(F.broadcast(u)).select("clause", norm(F.col("diff")).alias("n"), dot(F.col("diff"), F.col("u")).alias("m"))
    return g.groupBy("clause").agg(r6(F.avg("n")).alias("mean_norm"), r6(F.avg(F.col("m") / F.col("n"))).alias("coherence"), r6(safe_corr(F.col("n"), F.abs("m"))).alias("corr"))


def group_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest difference of any component from the label's first vector."""
    e = load(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    off = F.array_max(F.transform(subtract(F.col("embedding"), F.col("f")), lambda x: F.abs(x)))
    return e.join(first, "label").groupBy("label").agg(r6(F.max(off)).alias("largest"))


def donor_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave each label's vectors out of the mean direction; the least accuracy and whose absence gives it."""
    per = loco_margins(spark, sf_dir)
    return per.agg(F.min("accuracy").alias("least"), F.min_by("clause", F.struct("accuracy", "clause")).alias("clause"), F.count_if(F.col("accuracy") >= 0.5).alias("n_half"))



QUERIES = {
    "similarity_topk": similarity_topk, "vector_norms": vector_norms, "contrast_direction": contrast_direction, "projection": projection, "loco_margins": loco_margins, "loso_margins": loso_margins,
    "grid_select": grid_select, "cosine_matrix": cosine_matrix, "pair_geometry": pair_geometry, "group_deviation": group_deviation, "donor_ablation": donor_ablation,
}
_W = f"WITH {VPAIRS_SQL}, total AS (SELECT d, sum(x) AS s FROM dims GROUP BY d), u AS (SELECT d, s / (SELECT sqrt(sum(s * s)) FROM total) AS x FROM total)"


def _left_out_sql(by: str) -> str:
    return _W + f""", own AS (SELECT {by}, d, sum(x) AS s FROM dims GROUP BY 1, 2), rest AS (SELECT o.{by}, o.d, t.s - o.s AS s FROM own o JOIN total t USING (d)),
      scaled AS (SELECT {by}, d, s / sqrt(sum(s * s) OVER (PARTITION BY {by})) AS x FROM rest), margins AS (SELECT a.pair, a.{by}, sum(a.x * s.x) AS margin FROM dims a JOIN scaled s ON s.{by} = a.{by} AND s.d = a.d GROUP BY 1, 2)"""


def layer_sql() -> str:
    return _W + """, l AS (SELECT pair, span % 4 = 0 AS dev, (d - 1) // 8 AS layer, d, x FROM dims), f AS (SELECT layer, d, sum(x) AS s FROM l WHERE NOT dev GROUP BY 1, 2),
      m AS (SELECT l.layer, pair, sum(l.x * f.s) AS m FROM l JOIN f ON f.layer = l.layer AND f.d = l.d WHERE dev GROUP BY 1, 2), per AS (SELECT layer::INTEGER AS layer, avg((m > 0)::INT) AS accuracy FROM m GROUP BY 1)"""


_LOCO = _left_out_sql("clause") + ", per AS (SELECT clause, count(*) AS n, round(avg(CASE WHEN margin > 0 THEN 1.0 WHEN margin = 0 THEN 0.5 ELSE 0.0 END), 6) AS accuracy, round(avg(margin), 6) AS mean_margin FROM margins GROUP BY 1)"
ORACLES = {
    "similarity_topk": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings) SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT q.id AS query_id, s.id, list_cosine_similarity(q.vec, s.vec) AS score, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.vec, s.vec) DESC, s.id)::INTEGER AS rank FROM v q JOIN v s ON s.id < q.id WHERE list_cosine_similarity(q.vec, s.vec) >= 0.25) WHERE rank <= 5",
    "vector_norms": "SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY 1",
    "contrast_direction": _W + " SELECT d::INTEGER AS dim, round(x, 6) AS x FROM u",
    "projection": _W + " SELECT pair, round(sum(dims.x * u.x), 6) AS margin FROM dims JOIN u USING (d) GROUP BY 1",
    "loco_margins": _LOCO + " SELECT * FROM per",
    "loso_margins": _left_out_sql("span") + " SELECT span, count(*) AS n, round(avg(margin), 6) AS mean_margin, count(*) FILTER (margin > 0) AS wins FROM margins GROUP BY 1 HAVING (SELECT count(*) FROM vp) - count(*) >= 10",
    "grid_select": _W + ", l AS (SELECT pair, span % 4 = 0 AS dev, (d - 1) // 8 AS layer, d, x FROM dims), f AS (SELECT layer, d, sum(x) AS s FROM l WHERE NOT dev GROUP BY 1, 2), g AS (SELECT layer, d, s / sqrt(sum(s * s) OVER (PARTITION BY layer)) AS s FROM f), m AS (SELECT l.layer, pair, sum(l.x * g.s) AS m FROM l JOIN g ON g.layer = l.layer AND g.d = l.d WHERE dev GROUP BY 1, 2) SELECT layer::INTEGER AS layer, count(*) AS n, round(avg((m > 0)::INT), 6) AS accuracy FROM m GROUP BY 1 ORDER BY accuracy DESC, layer LIMIT 10",
    "cosine_matrix": "WITH d AS (SELECT label, unnest(range(1, 65)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, d, sum(x) AS x FROM d GROUP BY 1, 2), u AS (SELECT label, d, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM s) SELECT a.label AS label_a, b.label AS label_b, round(sum(a.x * b.x), 6) AS cosine FROM u a JOIN u b ON b.d = a.d AND a.label < b.label GROUP BY 1, 2",
    "pair_geometry": _W + ", m AS (SELECT pair, clause, sqrt(sum(dims.x * dims.x)) AS n, sum(dims.x * u.x) AS m FROM dims JOIN u USING (d) GROUP BY 1, 2) SELECT clause, round(avg(n), 6) AS mean_norm, round(avg(m / n), 6) AS coherence, round(corr(n, abs(m)), 6) AS corr FROM m GROUP BY 1",
    "group_deviation": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS f FROM embeddings GROUP BY 1) SELECT e.label, round(max(list_max(list_transform(range(1, len(b.embedding) + 1), lambda i: abs(embedding[i]::DOUBLE - f[i]::DOUBLE)))), 6) AS largest FROM embeddings e JOIN f ON f.label = e.label GROUP BY 1",
    "donor_ablation": _LOCO + " SELECT min(accuracy) AS least, (SELECT clause FROM per ORDER BY accuracy, clause LIMIT 1) AS clause, count(*) FILTER (accuracy >= 0.5) AS n_half FROM per",
}
