"""One thin query for each operator over whole tables, and SQL for those that it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import compact_windows, decontam, html_text, jaccard_join, langid, line_dedup, matroska, mixing, toxicity, warc
from strandline.llm.common import cut, shared_dir, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    records = records.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest"), F.col("kind").alias("record_type"), page("refers").alias("refers_to"), F.regexp_replace("declared", "^sha1:", "").alias("declared"))
    # A page may have been fetched more than once, so a revisit means the response with the payload that it declares.
    stored = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared")).agg(F.max("payload_bytes").alias("full_bytes"))
    stored = cut(stored.join(records.where("refers_to is not null").select("refers_to", "declared").distinct(), ["refers_to", "declared"], "left_semi"))
    revisits = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "declared").join(stored, ["refers_to", "declared"])
    full = revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", "refers_to")
    return records.where("record_type = 'response'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to").unionByName(full)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def _remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))
    model = langid.learn(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = matroska.store(table(spark, sf_dir, "documents"))
    return matroska.restore(stored).withColumnRenamed("id", "doc_id")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    model = toxicity.learn(docs.where("not held_out"), table(spark, sf_dir, "labels"), docs)
    return toxicity.score(docs.select("doc_id", "held_out", "text"), model).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_warc": op1_warc, "op2_main_text": op2_main_text, "op3_langid": op3_langid, "op4_line_dedup": op4_line_dedup, "op5_decontaminate": op5_decontaminate, "op6_matroska": op6_matroska, "op7_compact_windows": op7_compact_windows, "op8_mix": op8_mix, "op9_jaccard": op9_jaccard, "op10_toxicity": op10_toxicity}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM r""",
    "op4_line_dedup": r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM s),
b AS (SELECT *, length(trim(line, ' ')) > 0 AS solid FROM x),
n AS (SELECT doc_id, line, no, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos FROM b WHERE solid),
f AS (
SELECT doc_id, no, 1 AS depth, list(line) OVER w AS run, sum(length(line)) OVER w AS chars, max(no) OVER w AS last FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 0 FOLLOWING)
 UNION ALL SELECT doc_id, no, 2 AS depth, list(line) OVER w AS run, sum(length(line)) OVER w AS chars, max(no) OVER w AS last FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)
 UNION ALL SELECT doc_id, no, 4 AS depth, list(line) OVER w AS run, sum(length(line)) OVER w AS chars, max(no) OVER w AS last FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
 UNION ALL SELECT doc_id, no, 8 AS depth, list(line) OVER w AS run, sum(length(line)) OVER w AS chars, max(no) OVER w AS last FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
 UNION ALL SELECT doc_id, no, 16 AS depth, list(line) OVER w AS run, sum(length(line)) OVER w AS chars, max(no) OVER w AS last FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)
 UNION ALL SELECT doc_id, no, 32 AS depth, list(line) OVER w AS run, sum(length(line)) OVER w AS chars, max(no) OVER w AS last FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING)),
c AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, no) > 1 AS copy FROM f WHERE len(run) = depth),
gone AS (SELECT DISTINCT b.doc_id, b.no FROM b JOIN c ON b.doc_id = c.doc_id AND b.no BETWEEN c.no AND c.last WHERE c.copy AND c.chars >= 20),
k AS (SELECT b.*, gone.no IS NOT NULL AS removed FROM b LEFT JOIN gone ON b.doc_id = gone.doc_id AND b.no = gone.no),
t AS (SELECT doc_id, CASE WHEN bool_or(solid AND NOT removed) OR NOT bool_or(removed) THEN coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT removed), '') ELSE '' END AS text,
  CAST(count(*) FILTER (WHERE removed) AS INTEGER) AS lines_removed FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.text, d.text) AS text, coalesce(t.lines_removed, 0) AS lines_removed FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op8_mix": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM w),
f AS (SELECT *, row_number() OVER o AS pos,
  CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
g AS (SELECT *, min(CASE WHEN left_size * weight <= cap * left_weight THEN pos END) OVER () AS first_open FROM f),
l AS (SELECT left_size AS level_size, left_weight AS level_weight FROM g WHERE pos = first_open),
t AS (SELECT source, source_size, CASE WHEN pos < first_open THEN cap ELSE level_size * weight / level_weight END AS target FROM g, l),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
  CAST(CAST('0x' || substr(md5('mix|' || coalesce(d.source, chr(0))), 1, 5) AS BIGINT) AS DOUBLE) / 1048576.0::DOUBLE AS u,
  CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, coalesce(substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 2), ''), d.doc_id) AS DOUBLE) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT) * size AS taken FROM k""",
}
