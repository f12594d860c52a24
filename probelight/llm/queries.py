"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
import public_tokenizers

from . import bpe, chat, gif, html_text, mixing, near_dup, pii, quality, repair, resample, token_ids, topk, toxicity
from .common import scratch_path, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), "doc_id")
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("long").alias(f"n_{k}")
    digest = F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    extra = [F.size(F.filter("spans", lambda p: p["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.EXTRA]  # noqa: B023
    return found.select("doc_id", *[count(k) for k in pii.BASE], digest, pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *extra)


def op2_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(pow(n::DOUBLE, 0.5)) AS w, sum(n)::DOUBLE AS total FROM counts),
rates AS (SELECT source, pow(n::DOUBLE, 0.5) / w * total / n AS mean FROM counts, sums),
steps AS (
  SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, (SELECT unnest(range(0, 200)) AS k)
),
drawn AS (
  SELECT d.doc_id, d.source, ('0x' || substr(md5('mix:' || d.doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d
),
counted AS (
  SELECT doc_id, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM drawn.source AND s.c <= drawn.u AND s.k < 150)::INTEGER AS n_copies FROM drawn
)
SELECT d.*, c.n_copies, r.copy_no::INTEGER AS copy_no, md5('mix:order:' || d.doc_id || ':' || r.copy_no) AS shuffle_key
FROM documents d JOIN counted c USING (doc_id), (SELECT unnest(range(1, 200)) AS copy_no) r WHERE r.copy_no <= c.n_copies
"""


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, share=0.85)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def op6_gbt_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = gif.frames(gif.store(table(spark, sf_dir, "documents")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                data = b"".join(f["indices"] for f in row["frames"])
                colours = [sum(c) for c in zip(*(f["colours"] for f in row["frames"]), strict=True)]
                rows.append(
                    {
                        "doc_id": row["doc_id"], "n_bytes": row["n_bytes"], "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-64:]),
                        "media_bytes": len(row["media"]), "media_sha256": hashlib.sha256(row["media"]).hexdigest(), "feature": f"{len(row['frames'])}:" + ",".join(map(str, colours)),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([(n, pa.string() if n.endswith("sha256") or n == "feature" else pa.int64()) for n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
    return read.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    token_ids.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_ids.read_documents(spark, path)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return resample.ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 in SQL: a byte's entry of the table is the exclusive or of the entries of its bits (fixed values).
_CRC_BITS = (0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320)


def crc32_sql(text: str) -> str:
    """A DuckDB expression for the unsigned CRC-32 of the UTF-8 bytes of a column."""
    entry = "0"
    for k, value in enumerate(_CRC_BITS):
        entry = f"xor({entry}, ((xor(c, b) >> {k}) & 1) * {value})"
    byte = f"('0x' || substr(hex(encode({text})), 2 * i::INTEGER + 1, 2))::BIGINT"
    many = f"list_transform(range(0, octet_length(encode({text}))), lambda i: {byte})"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {many}), lambda c, b: xor(c >> 8, {entry})))"


OP11_SQL = rf"""
WITH texts AS (
  SELECT doc_id AS id, 's' AS side, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
  UNION ALL SELECT item_id, 't', translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
),
words AS (SELECT id, side, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT id, side, unnest(w) AS f FROM words
  UNION ALL SELECT id, side, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1
),
per_text AS (SELECT id, side, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM per_text)),
features AS (SELECT id, side, bucket, sum(n) AS n FROM per_text JOIN hashed USING (f) GROUP BY ALL),
both_sides AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM features GROUP BY 1),
sums AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM both_sides),
gains AS (
  SELECT bucket, floor(1000 * ln((b.t + 1)::DOUBLE * (sums.s + 10000) / ((b.s + 1)::DOUBLE * (sums.t + 10000))))::BIGINT AS gain FROM both_sides b, sums
),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 's' GROUP BY 1),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(words.w) >= 20 AS able,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights ON weights.id = d.doc_id JOIN words ON words.id = d.doc_id AND words.side = 's'
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM placed) // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.audited(repair.fragments(rows, copies=F.col("copies")), "conv_id")


_SPACES = r"[\x20\x09-\x0D]"
OP12_SQL = rf"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS f FROM conversations
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, {crc32_sql("f")} % 20 AS k FROM hashed)
),
placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS prior,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_extract(text, '([^\x20\x09-\x0D]){_SPACES}*$', 1) AS final
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)
),
judged AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
),
costed AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS may, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM judged
),
ends AS (SELECT conv_id, max(i) AS n FROM placed GROUP BY 1),
back(conv_id, i, h0, h1, h2, h3) AS (
  SELECT conv_id, n + 1, 0, 6, 3, 0 FROM ends
  UNION ALL
  SELECT conv_id, i, least(r0, r2 + 3, r3 + 6), least(r1, r2 + 3, r3 + 6), least(r2, r3 + 3), least(r3, r2 + 3)
  FROM (
    SELECT c.conv_id, c.i,
      least(h0 + 4, CASE WHEN may AND initial = 's' THEN h1 + extra ELSE 1000000 END, CASE WHEN may THEN h2 + extra + CASE initial WHEN 'u' THEN 0 ELSE 3 END ELSE 1000000 END) AS r0,
      least(h1 + 4, CASE WHEN may THEN h2 + extra + CASE initial WHEN 'u' THEN 0 ELSE 3 END ELSE 1000000 END) AS r1,
      least(h2 + 4, CASE WHEN may THEN h3 + extra + CASE initial WHEN 'a' THEN 0 ELSE 3 END ELSE 1000000 END) AS r2,
      least(h3 + 4, CASE WHEN may THEN h2 + extra + CASE initial WHEN 'u' THEN 0 ELSE 3 END ELSE 1000000 END) AS r3
    FROM back b JOIN costed c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.i = b.i - 1
  )
),
costs AS (SELECT conv_id, i, [h0, h1, h2, h3] AS h FROM back),
steps AS (
  SELECT a.conv_id, a.i, a.h, b.h AS next, c.role, c.text, c.initial, coalesce(c.may, false) AS may, coalesce(c.extra, 0) AS extra
  FROM costs a LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i + 1 LEFT JOIN costed c ON c.conv_id IS NOT DISTINCT FROM a.conv_id AND c.i = a.i
),
walk(conv_id, i, q, audit, lines) AS (
  SELECT conv_id, 1::BIGINT, 1, '', []::VARCHAR[] FROM ends
  UNION ALL
  SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END,
    CASE WHEN letter = 'D' THEN q WHEN letter = 'K' AND initial = 's' THEN 2 ELSE speaks END, audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, said || ':' || text) ELSE list_append(lines, said || ':') END
  FROM (
    SELECT w.*, s.role, s.text, s.initial, CASE w.q WHEN 3 THEN 4 ELSE 3 END AS speaks, CASE w.q WHEN 3 THEN 'assistant' ELSE 'user' END AS said,
      CASE
        WHEN next IS NOT NULL AND next[w.q] + 4 = h[w.q] THEN 'D'
        WHEN h[CASE w.q WHEN 3 THEN 4 ELSE 3 END] + 3 = h[w.q] THEN 'I'
        WHEN may AND ((initial = 's' AND w.q = 1 AND next[2] + extra = h[w.q]) OR (initial = 'a' AND w.q = 3 AND next[4] + extra = h[w.q]) OR (initial = 'u' AND w.q <> 3 AND next[3] + extra = h[w.q])) THEN 'K'
        ELSE 'R' END AS letter
    FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i WHERE next IS NOT NULL OR h[w.q] > 0
  )
),
done AS (SELECT w.conv_id, audit, lines FROM walk w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = e.n + 1 AND w.q IN (1, 4)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(h0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
"""


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.digest(chat.formatted(rows))


OP13_SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
told AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)(/?(?:INST|SYS|as|next|s|turn)[\]>])', '\1\\\2\3', 'g') AS escaped,
    regexp_replace(role, '([\[<])(\\*)(/?(?:INST|SYS|as|next|s|turn)[\]>])', '\1\\\2\3', 'g') AS named,
    role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS again FROM every
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + CASE WHEN again THEN 6 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7 ELSE 17 + length(named) END)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_rule_quality": op2_rule_quality,
    "op3_source_mix": op3_source_mix,
    "op4_minhash_near_dup": op4_minhash_near_dup,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_gbt_toxicity": op6_gbt_toxicity,
    "op7_html_host_paths": op7_html_host_paths,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_gif_media": op9_gif_media,
    "op10_token_ids": op10_token_ids,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_chat_format": op13_chat_format,
}
ORACLES: dict[str, str] = {"op3_source_mix": OP3_SQL, "op5_exact_top_k": OP5_SQL, "op11_importance_resampling": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_chat_format": OP13_SQL}
