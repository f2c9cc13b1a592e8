"""WARC archives: writing with identical-payload revisits, and reading by boundary-chain verification.

Writing: every record is one line of Spark's text writer whose line separator is the blank lines that end a
record, so the files go to any file system through Spark's own commit protocol.  Reading: the text source
splits the files at every "WARC/1.", also at those inside payloads; the byte lengths of the pieces add up to
offsets, each piece that can be read as a header gives a candidate edge from its offset to the offset after
its declared length, and only pieces that the chain from the file's start reaches are records.

A record has to fit in a row: 2 GB at most, and in the memory of a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_folder

MAGIC, BLANK = "WARC/1.1\r\n", "\r\n\r\n"
#: What archives are split at: the beginning of MAGIC in all versions.
SPLIT = "WARC/1."
#: Up to so many revisits their ids are broadcast (about 20 MB); beyond, pages and revisits are joined by shuffle.
BROADCAST_REVISITS = 200_000


def payload_digest(data: Column) -> Column:
    """Base32 of the SHA-1 in upper case: eight times 20 bits, each as four digits of base 32."""
    hexed = F.sha1(data)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, refers_to) for the rows that revisit an equal payload of a smaller page_id.

    Every row that carries the smallest page_id of a payload is a response; null ids are larger than all others.
    """
    light = cut(pages.select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n"), payload_digest(F.coalesce("html", F.lit(""))).alias("payload_digest")))
    firsts = light.where(F.col("n") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("c"), F.count("page_id").alias("ids"))
    shared = firsts.where((F.col("c") > 1) & F.col("refers_to").isNotNull() & ((F.col("last") > F.col("refers_to")) | (F.col("ids") < F.col("c")))).select("payload_digest", "refers_to")
    return light.join(shared, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """A record per row of pages (page_id, url, html); a null html is an empty payload, a null url has no target line.

    Blanks and control characters of the url are percent-encoded.  A revisit keeps the HTTP header of the page,
    whose Content-Length tells its payload's length, and drops the payload.
    """
    revisits = cut(record_types(pages, least_bytes).toDF("_id", "_d", "refers_to"))
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    html = F.coalesce("html", F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    full = pages.select("page_id", "url", html.alias("html"), payload_digest(html).alias("d"))
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("d") == F.col("_d"))
    r = full.join(revisits, same, "left").withColumn("again", F.col("_d").isNotNull())
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(BLANK))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, "html"))
    url = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", " ", "%20"), "\r", "%0D"), "\n", "%0A"), "".join(map(chr, [*range(32), 127])), "")
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), named("page_id"), F.lit(f">\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("d"),
        F.when(F.col("again"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), named("refers_to"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("b").cast("string"), F.lit(BLANK))
    r.withColumn("b", block).select(F.concat(head, "b").alias("value")).write.option("lineSep", BLANK).text(folder)


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The text between SPLITs, with file, block and place in the block (from a task's row numbers).

    How files are packed into tasks depends on the cores at hand, and block and place with it.  So the rows stand on
    one RDD, whose partitions are those of this call: whoever reads them again, or after executors are lost,
    gets the same pieces under the same names.  Files that end in .gz are read unpacked, each by one task.
    """
    raw = spark.read.option("lineSep", SPLIT).text(folder)
    named = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(named._jdf.queryExecution().toRdd(), named._jdf.schema(), False), spark)


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def candidates(found: DataFrame) -> DataFrame:
    """A stored row per piece of found: file, block, place, start, succ and the fields of its header; offsets are in bytes.

    Running sums within a block, then over the blocks of a file, give the offsets.  start is that of the magic;
    the piece before a file's first magic starts below 0.  succ is null where no header can be read.
    """
    head = F.substring_index("value", BLANK, 1)
    p = found.withColumn("head", head).withColumn("bytes", F.octet_length("value").cast("long"))
    declared, headed = F.expr("try_cast(regexp_extract(head, '(?im)^Content-Length:[ \\t]*([0-9]+)[ \\t]*\\r?$', 1) AS BIGINT)"), F.octet_length("head") + len(BLANK)
    body = F.substring(F.col("value").cast("binary"), F.col("headed") + 1, F.col("declared").cast("int"))
    whole = F.col("bytes") == F.col("headed") + F.col("declared") + len(BLANK)
    fields = [F.when(whole, body).alias("body"), _header("WARC-Type").alias("type"), F.regexp_extract("head", "(?im)^WARC-Record-ID:[ \t]*<(?:urn:page:)?([^>]*)>", 1).alias("id"),
              F.regexp_extract("head", "(?im)^WARC-Refers-To:[ \t]*<(?:urn:page:)?([^>]*)>", 1).alias("refers"), _header("WARC-Target-URI").alias("url"), F.regexp_extract("head", "(?im)^WARC-Payload-Digest:[ \t]*sha1:(\\w+)", 1).alias("told")]
    read = p.withColumn("declared", F.when((F.col("bytes") > F.octet_length("head")) & F.col("head").rlike("^[0-9]+\r\n"), declared)).withColumn("headed", headed).select("file", "block", "place", "bytes", "headed", "declared", *fields)
    light = cut(read.select("file", "block", "place", "bytes", "headed", "declared", "type", "id", "refers", "url", "told", *payload(F.col("body"))))
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = light.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(SPLIT)).alias("_sum")).select("file", "block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    at = light.withColumn("_in", F.coalesce(F.sum(F.col("bytes") + len(SPLIT)).over(inside), F.lit(0))).join(blocks, ["file", "block"])
    start = F.col("_base") + F.col("_in") - len(SPLIT)
    return cut(at.withColumn("start", start).withColumn("succ", F.col("start") + len(SPLIT) + F.col("headed") + F.col("declared") + len(BLANK)).drop("_base", "_in"))


def payload(body: Column) -> list[Column]:
    """What a record's block tells, an HTTP header, a blank line and the payload, or a bare payload: lengths and the payload's digest."""
    split = F.when(F.startswith(body, F.lit("HTTP/").cast("binary")), F.position(F.lit(BLANK).cast("binary"), body)).otherwise(0)
    rest = F.when(split > 0, F.substring(body, split + len(BLANK), F.octet_length(body))).otherwise(body)
    told = F.expr("try_cast(regexp_extract(cast(substring(body, 1, 4096) AS STRING), '(?im)^Content-Length:[ \\t]*([0-9]+)', 1) AS BIGINT)")
    return [F.octet_length(rest).cast("long").alias("payload_bytes"), told.alias("http_length"), payload_digest(rest).alias("digest")]


def chained(found: DataFrame) -> DataFrame:
    """(file, start) of the pieces that the chain from the start of their file reaches.

    First runs of pieces that follow each other are drawn together: a run begins where the piece before doesn't
    end, and at the target of any edge that leads elsewhere than to the next piece.  Then pointers jump over the
    runs, twice as far in every round, until nothing new is reached; the rounds grow with the logarithm of the
    number of blocks of a file and of false beginnings.
    """
    order = Window.partitionBy("file", "block").orderBy("start")
    edges = found.where("start >= 0").select("file", "block", "start", "succ").withColumn("next", F.lead("start").over(order)).withColumn("prev", F.lag("succ").over(order))
    far = edges.where("succ IS NOT NULL AND NOT succ <=> next").select("file", F.col("succ").alias("start"), F.lit(True).alias("hit")).distinct()
    marked = edges.join(far, ["file", "start"], "left").withColumn("first", F.coalesce(F.col("prev") != F.col("start"), F.lit(True)) | F.col("hit").isNotNull())
    run = F.last(F.when(F.col("first"), F.col("start")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = cut(marked.select("file", "start", "succ", run.alias("run")))
    jump = cut(runs.groupBy("file", "run").agg(F.max_by("succ", "start").alias("to")).where("to IS NOT NULL"))
    reached, count = jump.where("run = 0").select("file", F.col("run").alias("at")).distinct().unionByName(runs.where("run = 0").select("file", F.col("run").alias("at")).distinct()).distinct(), -1
    known = runs.select("file", F.col("run").alias("at")).distinct()
    while True:
        reached = cut(reached)
        now = reached.count()
        if now == count:
            break
        count = now
        ahead = reached.withColumnRenamed("at", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("at"))
        reached = reached.unionByName(ahead.join(known, ["file", "at"], "left_semi")).distinct()
        nearer = jump.select("file", F.col("run").alias("_from"), F.col("to").alias("run"))
        jump = cut(nearer.join(jump, ["file", "run"]).select("file", F.col("_from").alias("run"), "to"))
    return runs.join(reached.select("file", F.col("at").alias("run")), ["file", "run"], "left_semi").select("file", "start")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: file, start, type, id, refers, url, told (its digest line), payload_bytes, http_length, digest, intact.

    payload_bytes and digest are computed from the bytes read; intact tells whether digest is what the record told,
    and is null for revisits and records that told none.  ids are what stands between < and >, without urn:page:.
    Archives may be of any version 1.x, and compressed with gzip; offsets are then those of the unpacked file.  A record
    whose payload holds the magic lies in several pieces; only those pieces are read again and put together in
    the order of their offsets.  Nothing is read after this has returned.
    """
    held = pieces(spark, folder)
    found = candidates(held)
    real = cut(found.join(chained(found), ["file", "start"], "left_semi").where("declared IS NOT NULL"))
    whole = F.col("bytes") == F.col("headed") + F.col("declared") + len(BLANK)
    intact = F.when((F.col("type") != "revisit") & (F.col("told") != ""), F.upper("told") == F.col("digest")).alias("intact")
    fields = ["file", "start", "type", "id", "refers", "url", "told", "payload_bytes", "http_length", "digest", intact]
    broken = real.where(~whole)
    count = broken.count()
    if not count:  # no payload holds the magic: there are no pieces to put together
        return real.select(*fields)
    spans = broken.select("file", F.col("start").alias("first"), "succ", F.col("headed").alias("skip"), "declared")
    parts = found.select("file", "block", "place", "start").join(spans, "file").where("start >= first AND start < succ").select("block", "place", *(["file", "first", "start", "skip", "declared"]))
    texts = held.join(parts, ["file", "block", "place"])
    ordered = F.sort_array(F.collect_list(F.struct("start", F.col("value").cast("binary").alias("value"))))
    joined = texts.groupBy("file", F.col("first").alias("start")).agg(ordered.alias("v"), F.first("skip").alias("skip"), F.first("declared").alias("declared"))
    glue = F.array_join(F.transform("v", lambda x: F.hex(x.value)), SPLIT.encode().hex())
    bytes_of = F.substring(F.unhex(glue), F.col("skip") + 1, F.col("declared").cast("int"))
    body = cut(joined.select("file", "start", "declared", bytes_of.alias("body")).select("file", "start", (F.octet_length("body") == F.col("declared")).alias("full"), *payload(F.col("body"))))
    if body.where("full").count() != count:
        raise RuntimeError(f"{count} records hold the magic, but not as many could be put together")
    again = broken.drop("payload_bytes", "http_length", "digest").join(body, ["file", "start"])
    return real.where(whole).select(*fields).unionByName(again.select(*fields))


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
