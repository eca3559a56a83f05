"""WARC archives: writing with revisits, and reading by boundary-chain verification.

*Writing.*  Spark's text writer writes the files: a row is a record's header and payload, and the line separator is the
pair of line ends that closes a record, so the output is plain WARC.  Of records with equal payloads of at least
``min_revisit`` bytes that with the smallest id is written whole and the others as revisits of it.

*Reading.*  The files are split at every ``WARC/1.0`` line, by any tasks at any block boundary, wherever it stands.  Each
piece is a candidate record: its offset and, from its Content-Length, the offset of its successor.  A payload may hold
such a line itself, so candidates are not trusted.  Pointer jumping from the start of each file (every round doubles
the length of the pointers and marks what the marked ones point at) retains the candidates that a chain of records
reaches; the rest is payload and is joined again to the record that it lies in.

Where tasks begin to read depends on the cores that are there at that moment, so nothing is carried from one scan of the
files to another but file offsets, which each scan computes from the sizes of the pieces that it has itself written down.

Defined results: null payloads are empty, null ids and urls stay null, line ends in urls are percent-encoded.  Rows with
the smallest id of their payload are all responses, however many there are; rows without id never are what others
refer to, and are responses unless an id exists.  Other columns are not read.  A record whose file ends before its
payload does is left out, as is what follows a broken header; a record whose pieces cannot be found again is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Fixed so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, scratch: Scratch, min_revisit: int = 100) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # only payloads that repeat are joined; the table is written so that its true size decides how
    first = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = scratch.keep(first.where("n > 1 and first is not null").select("payload_digest", "first"), "repeated")
    rows = rows.join(first, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))}).drop("first")


def _record(r: dict[str, Column]) -> Column:
    url = F.regexp_replace(F.regexp_replace(r["url"], "\r", "%0D"), "\n", "%0A")
    revisit = r["record_type"] == "revisit"
    # rows without id need a record id too; it is of a kind that is not read as a page's
    own = F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws(" ", r["url"], r["payload_digest"]), 256), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", r["record_type"]),
        line("WARC-Record-ID", F.coalesce(F.concat(F.lit("<urn:page:"), r["page_id"].cast("string"), F.lit(">")), own)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), r["payload_digest"])),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), r["refers_to"].cast("string"), F.lit(">"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(r["payload_bytes"].cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(r["payload"]),
    )


def write_archive(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write rows of ``plan_records`` as WARC files below ``path``."""
    value = _record({c: F.col(c) for c in records.columns})
    records.select(value.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, ordinal, size (with the separator) and value of every piece between WARC/1.0 lines, as split here and now."""
    at = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "ordinal": F.monotonically_increasing_id()}
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(*(c.alias(n) for n, c in at.items()), (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"), "value")


def _with_offset(rows: DataFrame) -> DataFrame:
    """Written pieces with ``off``, the offset of the WARC/1.0 line in front, in place of block, ordinal and size.

    Sizes are summed within a task's block, and over the blocks of a file.
    """
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("size").over(w), F.lit(0))
    blocks = rows.groupBy("file", "block").agg(F.sum("size").alias("size")).select("file", "block", total(before("file", "block")).alias("base"))
    within = rows.select("file", "block", "ordinal", "size", total(before("file", "block", "ordinal")).alias("within"))
    at = within.join(blocks, ["file", "block"]).select("file", "block", "ordinal", (F.col("base") + F.col("within") - len(MAGIC)).alias("off"))
    # the piece in front of the first line of a file is no candidate; every other follows its line
    return rows.join(at.where("off >= 0"), ["file", "block", "ordinal"]).drop("block", "ordinal")


def candidates(spark: SparkSession, path: str, scratch: Scratch, with_value: bool = False) -> DataFrame:
    """Every candidate's file, off, size, succ (offset of its successor), header, length and place of its payload, and, if the piece holds it whole, its payload's digest.

    ``off`` is the offset of the WARC/1.0 line.
    """
    header = F.substring_index("value", END, 1)
    length = F.regexp_extract(F.concat(F.lit("\r\n"), header, F.lit("\r\n")), "(?i)\r\nContent-Length: *([0-9]{1,18})\r\n", 1)
    raw = F.col("value").cast("binary")
    body = (F.octet_length("header") + len(END)).cast("long")
    rows = _pieces(spark, path).withColumns({"header": header, "length": F.when(length != "", length.cast("long"))})
    rows = rows.withColumn("length", F.when(F.contains("value", F.lit(END)), F.col("length")))
    whole = F.col("size") - len(MAGIC) >= body + F.col("length") + len(END)
    payload = F.substring(raw, (body + 1).cast("int"), F.col("length").cast("int"))
    rows = rows.select(
        "file", "block", "ordinal", "size", "length", body.alias("body"), F.when(F.col("length").isNotNull(), F.col("header")).alias("header"),
        F.coalesce(whole, F.lit(False)).alias("whole"), F.when(whole, F.sha2(payload, 256)).alias("digest"), *(["value"] if with_value else []),
    )
    rows = _with_offset(scratch.keep(rows, "pieces"))
    return rows.withColumn("succ", F.col("off") + len(MAGIC) + F.col("body") + F.col("length") + len(END))


def reachable(cands: DataFrame, scratch: Scratch) -> DataFrame:
    """file, off of the candidates that the chain from the start of their file reaches, by pointer jumping."""
    now = scratch.keep(cands.select("file", "off", F.col("succ").alias("next"), (F.col("off") == 0).alias("found")), "chain")
    marks, before = now.where("found").count(), 0
    # pointers and marked stretches double together: a round that marks nothing is at the ends of all chains
    while marks > before:
        # a row's successor, if it is a candidate, gives the new pointer; marked rows mark what they point at
        target = now.select("file", F.col("off").alias("next"), F.col("next").alias("jump"))
        step = now.join(target, ["file", "next"], "left")
        marked = now.where("found and next is not null").select("file", F.col("next").alias("off")).distinct().withColumn("hit", F.lit(True))
        after = step.join(marked, ["file", "off"], "left").select("file", "off", F.col("jump").alias("next"), (F.col("found") | F.coalesce("hit", F.lit(False))).alias("found"))
        after = scratch.keep(after, "chain")
        scratch.drop(now)
        now, before = after, marks
        marks = now.where("found").count()
    return now.where("found").select("file", "off")


def _field(name: str) -> Column:
    text = F.concat(F.lit("\r\n"), F.col("header"), F.lit("\r\n"))
    value = F.regexp_extract(text, f"(?i)\r\n{name}: *([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def _page(name: str) -> Column:
    value = F.regexp_extract(_field(name), r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(value != "", value.cast("long"))


def read_archive(spark: SparkSession, path: str, scratch: Scratch, with_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload) of every record below ``path``.

    Bytes and digest are those of the payload read; a revisit has those of the response that it refers to.
    """
    cands = scratch.keep(candidates(spark, path, scratch, with_payload), "candidates")
    found = scratch.keep(reachable(cands, scratch), "records")
    records = cands.join(found, ["file", "off"])
    broken = scratch.keep(records.where("not whole and length is not null").select("file", "off", "succ", "body", "length"), "broken")
    payload = lambda text: F.substring(text.cast("binary"), (F.col("body") + 1).cast("int"), F.col("length").cast("int"))
    records = records.where("length is not null").withColumn("payload", F.when(F.col("whole"), payload(F.col("value")).cast("string")) if with_payload else F.lit(None).cast("string")).drop("value")
    if not broken.isEmpty():
        # payloads cut by a line of their own are put together again: the pieces from a record up to its successor
        pieces = cands.select("file", "off", "size", "value") if with_payload else _with_offset(scratch.keep(_pieces(spark, path).join(broken.select("file").distinct(), "file", "left_semi"), "again"))
        start = broken.select("file", F.col("off").alias("record"), "off", "succ")
        marks = pieces.select("file", "off", "size").join(start, ["file", "off"], "full")
        # broken records do not overlap: the last one in front is the one that a piece may belong to
        last = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
        marks = marks.select("file", "off", "size", F.last("record", ignorenulls=True).over(last).alias("record"), F.last("succ", ignorenulls=True).over(last).alias("succ"))
        inner = scratch.keep(marks.where("off < succ").select("file", "off", "size", "record"), "inner")
        parts = inner.join(pieces.select("file", "off", "value"), ["file", "off"], "left").groupBy("file", "record")
        parts = parts.agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"), (F.sum("size") - len(MAGIC)).alias("bytes"), F.bool_or(F.col("size").isNull()).alias("lost"))
        text = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
        mended = broken.join(parts.select("file", F.col("record").alias("off"), text.alias("text"), "bytes", "lost"), ["file", "off"], "left")
        # both scans must have cut the same bytes
        end = lambda df, name: df.groupBy("file").agg(F.max(F.col("off") + F.col("size")).alias(name))
        mended = mended.join(end(cands, "end"), "file").join(end(pieces, "end_now"), "file", "left")
        same = (F.col("end") == F.col("end_now")) & ~F.col("lost") & (F.octet_length("text") == F.col("bytes"))
        mended = mended.withColumn("text", F.when(F.coalesce(same, F.lit(False)), F.col("text")).otherwise(F.raise_error(F.lit("A record's pieces were not found again.")).cast("string")))
        # a record whose file ends before its payload does is left out
        mended = mended.where(F.octet_length("text") >= F.col("body") + F.col("length")).withColumn("raw", payload(F.col("text")))
        mended = scratch.keep(mended.select("file", "off", F.sha2("raw", 256).alias("mended"), *([F.col("raw").cast("string").alias("again")] if with_payload else [])), "mended")
        records = records.join(mended, ["file", "off"], "left").where("whole or mended is not null")
        records = records.withColumns({"digest": F.coalesce("digest", "mended"), "payload": F.coalesce("payload", "again") if with_payload else F.col("payload")})
    out = records.select(
        _page("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"), F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("claimed"), "payload",
    )
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if with_payload else []), "claimed"]
    out = scratch.keep(out.select(*columns), "read")
    whole = out.where("record_type <> 'revisit'")
    again = out.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest", "payload").withColumnsRenamed({"claimed": "payload_digest"})
    source = whole.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", *(["payload"] if with_payload else []))
    source = source.join(again.select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"], "left_semi").dropDuplicates(["refers_to", "payload_digest"])
    source = scratch.keep(source, "sources")
    names = columns[:-1] if not with_payload else [c for c in columns if c != "claimed"]
    return whole.select(*names).unionByName(again.join(source, ["refers_to", "payload_digest"]).select(*names))
