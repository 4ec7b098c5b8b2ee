"""WARC archives: written and read by Spark's text files, records told from payload by their boundary chain.

Reading splits archives at every occurrence of the record magic, wherever Hadoop cuts the file. Each piece is a
candidate record; its offset is the sum of the lengths before it, and its header claims where the next one begins.
Pointer jumping from the start of each file keeps the candidates that the chain of claims reaches; magic inside a
payload, even with a whole forged record behind it, is not reached. Pieces that the chain passes over are put back
into the payload of the record they lie in.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Equal payloads of so many bytes are stored once.
REVISIT_BYTES = 1000
#: Groups of equal payloads are broadcast up to this number (about 100 bytes each), else joined by shuffle.
BROADCAST_GROUPS = 100_000
#: A group of equal payloads is joined in so many parts.
SALTS = 16
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END


def with_roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of ``least`` bytes or more, rows with the largest
    page_id are responses (refers_to null), the others refer to it. A null page_id counts as the smallest."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    groups = cut(groups)
    if groups.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(groups), "digest", "left")
    else:
        parts = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.hash("page_id"), F.lit(SALTS))).join(parts, ["digest", "_salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A record's bytes as a string column, without its last line feed."""
    revisit = refers_to.isNotNull()
    block = F.concat(F.lit(_HTTP).cast("binary"), F.when(revisit, F.lit("").cast("binary")).otherwise(payload))
    uri = F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Date: 2020-01-01T00:00:00Z"),
        F.when(uri.isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), uri)).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        digest,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return F.concat(head.cast("binary"), block, F.lit("\r\n\r").cast("binary")).cast("string")


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """One uncompressed archive for each partition of ``pages`` (page_id, url, html) under ``path``.

    Null html is an empty payload, a null url no target; other columns are not read; an empty table gives no records.
    """
    rows = with_roles(pages, least)
    columns = record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("refers_to"))
    rows.select(columns.alias("value")).write.option("compression", "none").option("lineSep", "\n").text(path)


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str, pieces: bool = False) -> DataFrame:
    """Every occurrence of the magic: file, off, next (the successor its header claims; null if it claims none), header
    fields, whether its piece is just as long as claimed, and if so digest and length of its payload; with ``pieces``, also the piece.

    The piece before the first magic of a file has off = -1, and is empty in an archive."""
    sep = len(MAGIC)
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value", F.col("value").cast("binary").alias("piece")
    )
    raw = raw.withColumn("head", F.substring_index("value", END, 1)).withColumn("head_n", F.octet_length("head").cast("long")).withColumn("n", F.octet_length("piece").cast("long"))
    raw = raw.withColumn("claimed", F.regexp_extract("head", r"(?i)(?:^|\r\n)Content-Length: *(\d{1,18})(?:\r\n|$)", 1).try_cast("long"))
    raw = raw.withColumn("whole", F.coalesce(F.col("n") == F.col("head_n") + 4 + F.col("claimed") + 4, F.lit(False)))
    payload = _payload(F.when(F.col("whole"), F.expr("substring(piece, int(head_n + 5), int(claimed))")))
    fields = (("WARC-Type", "kind"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers"), ("WARC-Payload-Digest", "declared"))
    narrow = raw.select(
        "file", "block", "mid", "n", "head_n", "claimed", "whole",
        *[F.when(F.col("claimed").isNotNull(), _header(F.col("head"), x)).alias(y) for x, y in fields],
        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"), *["piece"] * pieces,
    )
    narrow = cut(narrow)
    # Each piece but the last of a file is followed by a magic; all pieces of a file before one add up to its offset.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = narrow.groupBy("file", "block").agg(F.sum(F.col("n") + sep).alias("size"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.select("file", "block", "mid", "n").withColumn("inner", F.coalesce(F.sum(F.col("n") + sep).over(inside), F.lit(0))).join(blocks, ["file", "block"])
    starts = sums.select("file", "block", "mid", (F.col("base") + F.col("inner")).alias("start"))
    placed = narrow.join(starts, ["file", "block", "mid"]).withColumn("off", F.when(F.col("start") == 0, F.lit(-1)).otherwise(F.col("start") - sep))
    claimed = F.when(F.col("off") >= 0, F.col("off") + sep + F.col("head_n") + F.col("claimed") + 8)
    return placed.withColumn("next", claimed).drop("block", "mid", "start")


def _payload(content: Column) -> Column:
    """What follows the HTTP header of a block."""
    http = F.octet_length(F.substring_index(content.cast("string"), END, 1))
    return F.substring(content, http + F.lit(len(END) + 1), F.octet_length(content))


def reachable(edges: DataFrame) -> DataFrame:
    """(file, off) of the nodes of ``edges`` (file, off, next) that the chain from offset 0 of each file passes.

    Pointer jumping: in each round every node's pointer is replaced by its target's, and what reached nodes point to
    is reached; as many rounds as the binary logarithm of the most nodes of a file.
    """
    most = edges.groupBy("file").count().agg(F.max("count")).first()[0]
    nodes = cut(edges.select("file", "off", F.col("next").alias("jump"), (F.col("off") == 0).alias("reached")))
    for _ in range(ceil(log2(most)) + 1 if most else 0):
        target = nodes.select("file", F.col("off").alias("jump"), F.col("jump").alias("further"))
        jumped = nodes.join(target, ["file", "jump"], "left").select("file", "off", "jump", "further", "reached")
        marks = nodes.where("reached and jump is not null").select("file", F.col("jump").alias("off")).distinct().withColumn("mark", F.lit(True))
        nodes = jumped.join(marks, ["file", "off"], "left")
        nodes = cut(nodes.select("file", "off", F.col("further").alias("jump"), (F.col("reached") | F.col("mark").isNotNull()).alias("reached")))
    return nodes.where("reached").select("file", "off")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: file, off, kind, record_id, refers, declared (digest), payload_bytes, digest.

    digest and payload_bytes are of the payload as stored; a revisit stores none. A file that doesn't begin with a
    record has none; a record cut short by the end of its file is left out.
    """
    found = cut(candidates(spark, path))
    no_archive = found.where("off = -1 and n > 0").select("file")
    chain = cut(reachable(found.where("off >= 0 and next is not null").join(no_archive, "file", "left_anti").select("file", "off", "next")))
    keep = ["file", "off", "kind", "record_id", "refers", "declared", "payload_bytes", "digest"]
    true = found.join(chain, ["file", "off"])
    broken = cut(true.where("not whole"))
    whole = true.where("whole").select(keep)
    if broken.isEmpty():
        return whole
    # Their payload holds magic: the pieces from such a record to the next one of the chain make it up.
    marked = found.where("off >= 0").select("file", "off").join(chain.withColumn("own", F.col("off")), ["file", "off"], "left")
    so_far = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.select("file", F.col("off").alias("at"), F.last("own", True).over(so_far).alias("off")).join(broken.select("file", "off"), ["file", "off"], "left_semi")
    bytes_of = candidates(spark, path, pieces=True).select("file", F.col("off").alias("at"), "piece")
    gathered = owned.join(bytes_of, ["file", "at"]).groupBy("file", "off").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    magic = F.lit(MAGIC).cast("binary")
    joined = F.aggregate(F.expr("slice(parts, 2, size(parts))"), F.col("parts")[0]["piece"], lambda sofar, x: F.concat(sofar, magic, x["piece"]))
    mended = broken.drop("digest", "payload_bytes").join(gathered.select("file", "off", joined.alias("bytes")), ["file", "off"])
    mended = mended.withColumn("content", F.expr("substring(bytes, int(head_n + 5), int(claimed))")).where("octet_length(content) = claimed")
    payload = _payload(F.col("content"))
    return whole.unionByName(mended.withColumn("digest", F.sha1(payload)).withColumn("payload_bytes", F.octet_length(payload).cast("long")).select(keep))
