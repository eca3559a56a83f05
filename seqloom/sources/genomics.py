"""BED, SAM, BAM, GFF3, Ensembl headers and sequence graphs."""

from __future__ import annotations

import gzip
import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.colspec import to_long
from ..staging import staged
from . import bgzf
from .tables import format_line, parse_line

SAM_FIELDS = ("name", "flag", "ref", "pos", "mapq", "cigar", "next_ref", "next_pos", "tlen", "seq", "qual", "extra")
SAM_SCHEMA = "is_header boolean, header string, name string, flag int, ref string, pos long, mapq int, cigar string, next_ref string, next_pos long, tlen long, seq string, qual string, extra string"


def bed(lines: DataFrame) -> DataFrame:
    """(chrom, start, end) of lines; comments and rows of fewer than three cells are skipped."""
    rows = lines.select(parse_line(F.col("value"), False).alias("c")).where((F.size("c") >= 3) & ~F.get("c", F.lit(0)).startswith("#"))
    return rows.select(F.get("c", F.lit(0)).alias("chrom"), to_long(F.get("c", F.lit(1))).alias("start"), to_long(F.get("c", F.lit(2))).alias("end"))


def sam(lines: DataFrame) -> DataFrame:
    """SAM lines as records; positions become 0-based, ``*`` null.  Short rows and unequal qualities are errors."""
    c = lambda i: F.get("c", F.lit(i))
    star = lambda i: F.nullif(c(i), F.lit("*"))
    rows = lines.where("value <> ''").select("value", parse_line(F.col("value"), False).alias("c"), F.col("value").startswith("@").alias("is_header"))
    body = ~F.col("is_header")
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    checked = F.when(body & (F.size("c") < 11), fail("SAM entry has too few columns.")).when(
        body & (c(9) != "*") & (c(10) != "*") & (F.length(c(9)) != F.length(c(10))), fail("SAM sequence and quality differ in length.")
    )
    rest = F.when(F.size("c") > 11, F.array_join(F.slice("c", F.lit(12), F.size("c")), "\t"))
    fields = {
        "name": star(0), "flag": to_long(c(1)).cast("int"), "ref": star(2), "pos": to_long(c(3)) - 1, "mapq": to_long(c(4)).cast("int"), "cigar": star(5), "next_ref": star(6),
        "next_pos": to_long(c(7)) - 1, "tlen": to_long(c(8)), "seq": star(9), "qual": star(10), "extra": rest,
    }
    return rows.select("is_header", F.coalesce(checked, F.when(F.col("is_header"), F.col("value"))).alias("header"), *(F.when(body, v).alias(k) for k, v in fields.items()))


def sam_lines(records: DataFrame) -> DataFrame:
    """The inverse of ``sam``."""
    star = lambda n: F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit("*"))
    num = lambda c: c.cast("string")
    cells = F.array(
        star("name"), num(F.col("flag")), star("ref"), num(F.col("pos") + 1), num(F.col("mapq")), star("cigar"), star("next_ref"), num(F.col("next_pos") + 1), num(F.col("tlen")), star("seq"), star("qual")
    )
    line = F.concat(format_line(cells, False), F.when(F.coalesce(F.col("extra"), F.lit("")) != "", F.concat(F.lit("\t"), F.col("extra"))).otherwise(""))
    return records.select(F.when(F.col("is_header"), F.col("header")).otherwise(line).alias("value"))


_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_NUMBERS = {"c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}


def _tags(raw: bytes) -> Iterator[tuple[str, str, str]]:
    at = 0
    while at < len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind == "A":
            yield tag, "A", chr(raw[at])
            at += 1
        elif kind in _NUMBERS:
            code, n = _NUMBERS[kind]
            yield tag, "f" if kind == "f" else "i", f"{struct.unpack_from('<' + code, raw, at)[0]:g}" if kind == "f" else str(struct.unpack_from("<" + code, raw, at)[0])
            at += n
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            yield tag, kind, raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            sub = chr(raw[at])
            code, n = _NUMBERS[sub]
            (count,) = struct.unpack_from("<I", raw, at + 1)
            values = struct.unpack_from(f"<{count}{code}", raw, at + 5)
            yield tag, "B", ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)])
            at += 5 + n * count
        else:
            raise ValueError(f"Unknown BAM tag type {kind}.")


def _bam_header(data: bytes) -> tuple[list[str], list[str], int] | None:
    """(text lines, names of references, size) of the header of a BAM stream, None if ``data`` ends before it does."""
    if data[:4] != b"BAM\1"[: len(data)]:
        raise ValueError("Not a BAM file.")
    try:
        (size,) = struct.unpack_from("<i", data, 4)
        (n_ref,) = struct.unpack_from("<i", data, 8 + size)
        at, refs = 12 + size, []
        for _ in range(n_ref):
            (n,) = struct.unpack_from("<i", data, at)
            struct.unpack_from("<i", data, at + 4 + n)
            refs.append(data[at + 4 : at + 3 + n].decode())
            at += 8 + n
    except struct.error:
        return None
    return data[8 : 8 + size].rstrip(b"\0").decode().splitlines(), refs, at


def _bam_record(data: bytes, at: int, refs: list[str]) -> tuple:
    """A row of SAM_SCHEMA."""
    name_of = lambda i: None if i < 0 else refs[i]
    (block,) = struct.unpack_from("<i", data, at)
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
    p = at + 36
    name = data[p : p + n_name - 1].decode()
    p += n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, p)
    p += 4 * n_ops
    packed = data[p : p + (n_seq + 1) // 2]
    p += len(packed)
    qual = data[p : p + n_seq]
    p += n_seq
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq]
    tags = list(_tags(data[p : at + 4 + block]))
    long_ops = next((v.split(",")[1:] for t, k, v in tags if t == "CG" and k == "B"), None)
    cigar = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in (map(int, long_ops) if long_ops else ops))
    extra = "\t".join(f"{t}:{k}:{v}" for t, k, v in tags if not (long_ops and t == "CG"))
    text = None if n_seq == 0 or qual[:1] == b"\xff" else bytes(q + 33 for q in qual).decode()
    none = lambda s: None if s in ("", "*") else s
    return (False, None, none(name), flag, name_of(ref), pos, mapq, none(cigar), name_of(next_ref), next_pos, tlen, none(seq), text, extra or None)


def _record_end(data: bytes, at: int) -> int | None:
    """Where the record ends that may start at ``at``; None if none can."""
    if at + 36 > len(data):
        return None
    block, ref, pos, n_name, _, _, n_ops, _, n_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fits = n_name > 0 and n_seq >= 0 and block >= 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq and min(ref, pos, next_ref, next_pos) >= -1
    name = data[at + 36 : at + 36 + n_name]
    return at + 4 + block if fits and (len(name) < n_name or name[-1] == 0) else None


def _likely_start(data: bytes) -> int:
    """The first place from which three records follow one another, or all that there are."""
    for at in range(len(data)):
        end, n = _record_end(data, at), 1
        while end is not None and n < 3 and end + 36 <= len(data):
            end, n = _record_end(data, end), n + 1
        if end is not None:
            return at
    return len(data)


_PART = ["file", "split", "part"]
_WALK = "file string, split long, part long, entry long, exit long, good boolean"


def _walk(blocks: DataFrame) -> DataFrame:
    """``entry`` and ``exit`` of parts: where the first record starts whose size ends in the part, and where the last one
    ends; not ``good`` where something else than records follows the entry.  Rows have ``before``, the three bytes in front
    of the part, and ``entry``, null where it has to be guessed."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("inner")
        first = {c: t.column(c)[0].as_py() for c in [*_PART, "base", "entry", "before"]}
        data = first["before"] + bgzf.unpacked(t.column("z").to_pylist())
        start = first["base"] - len(first["before"])
        at = _likely_start(data) if first["entry"] is None else first["entry"] - start
        entry, good = at, True
        while good and at + 4 <= len(data):
            step = struct.unpack_from("<i", data, at)[0]
            good = step >= 32
            at += 4 + step if good else 0
        types = [("file", pa.string()), *((c, pa.int64()) for c in ("split", "part", "entry", "exit")), ("good", pa.bool_())]
        return pa.table([[first[c]] for c in _PART] + [[start + entry], [start + at], [good]], schema=pa.schema(types))

    return blocks.groupBy(*_PART).applyInArrow(run, _WALK)


def _bam_heads(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """(file, lines, refs, end): the header of each file, one unit of work; files are read as far as their headers go."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("base", "ascending"), ("inner", "ascending")])
        head = _bam_header(bgzf.unpacked(t.column("z").to_pylist()))
        lines, refs, end = head or ([], [], None)
        types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()]
        return pa.table([pa.array([v], k) for v, k in zip((t.column("file")[0].as_py(), lines, refs, end), types, strict=True)], names=["file", "lines", "refs", "end"])

    done, upto = None, 1 << 16
    size = parts.groupBy("file").agg(F.max(F.col("base") + F.col("size")).alias("all"))
    while True:
        some = blocks.join(parts.where(F.col("base") < upto).select(*_PART, "base", "least"), _PART).where(F.col("base") + F.col("inner") - F.col("least") < upto)
        some = some if done is None else some.join(done.where("end is null").select("file"), "file")
        new = staged(some.groupBy("file").applyInArrow(run, "file string, lines array<string>, refs array<string>, end long"), "bam-heads")
        done = new if done is None else done.where("end is not null").unionByName(new)
        left = done.where("end is null")
        if left.isEmpty():
            return done
        if not left.join(size.where(F.col("all") <= upto), "file").isEmpty():
            raise ValueError("A BAM file ends within its header.")
        upto *= 16


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Headers, then the records of BAM files in their order (rows of SAM_SCHEMA).

    Parts of 256 blocks (16 MB at most) are read independently: each guesses where its first record starts, walks to its
    end, and the guess counts only if the part before ends there; others are walked again from where it does.  Memory is
    a part and the record that runs on, or a header.  A plain gzip file is one part.
    """
    blocks = bgzf.blocks(spark, path)
    order = Window.partitionBy("file").orderBy("split", "part")
    parts = blocks.groupBy(*_PART).agg(F.sum("size").alias("size"), F.min("inner").alias("least"))
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = staged(parts.withColumn("base", F.coalesce(before, F.lit(0))), "bam-parts")
    heads = _bam_heads(blocks, parts)

    tails = staged(_tails(blocks), "bam-tails")
    near = F.concat(*(F.coalesce(F.lag("tail", k).over(order), F.lit(b"")) for k in (3, 2, 1)))
    parts = parts.join(tails, _PART).withColumn("before", F.substring(near, -3, 3)).drop("tail")
    parts = staged(parts.join(heads.select("file", "end"), "file"), "bam-ends")
    over = F.col("base") + F.col("size") <= F.col("end")
    known = parts.where(over).select(*_PART, F.col("end").alias("entry"), F.col("end").alias("exit"), F.lit(True).alias("good"))
    entry = F.when(F.col("base") <= F.col("end"), F.col("end"))
    at = lambda p: blocks.join(p.select(*_PART, "base", "before", "entry"), _PART)
    walked = staged(known.unionByName(_walk(at(parts.where(~over).withColumn("entry", entry)))), "bam-walk")
    while True:
        rows = walked.join(parts, _PART).withColumn("due", F.coalesce(F.greatest(F.lag("exit").over(order), "end"), "end"))
        wrong = staged(rows.where("entry <> due").select(*_PART, "base", "size", "before", F.col("due").alias("entry")), "bam-wrong")
        if wrong.isEmpty():
            break
        walked = staged(walked.join(wrong, _PART, "left_anti").unionByName(_walk(at(wrong))), "bam-walk")
    last = rows.groupBy("file").agg(F.max(F.col("base") + F.col("size")).alias("all"), F.max("exit").alias("exit"), F.every("good").alias("good")).where("not good or all <> exit")
    if not last.isEmpty():
        raise ValueError("A BAM file is damaged, or ends within a record.")

    starts = F.col("exit") > F.col("entry")
    owner = F.last(F.when(starts, F.col("base")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("owner", owner)
    own = blocks.join(rows.where(starts).select(*_PART, "base", "least", F.col("base").alias("of")), _PART)
    more = blocks.join(rows.where("owner is not null").select(*_PART, "base", "least", "entry", F.col("owner").alias("of")), _PART)
    more = more.where(F.col("base") + F.col("inner") - F.col("least") < F.col("entry")).drop("entry")
    used = own.unionByName(more).withColumn("o", F.col("base") + F.col("inner") - F.col("least")).select("file", "of", "o", "z")
    plan = rows.where(starts).join(heads.select("file", "refs"), "file").select("file", F.col("base").alias("of"), "before", "entry", "exit", "refs")
    used = used.join(plan, ["file", "of"])
    first = F.col("o") == F.col("of")
    used = used.select("file", "of", "o", "z", *(F.when(first, F.col(c)).alias(c) for c in ("before", "entry", "exit", "refs")))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = used.repartitionByRange(n, "file", "of").sortWithinPartitions("file", "of", "o").drop("file").mapInArrow(_part_records, SAM_SCHEMA)
    top = heads.orderBy("file").select(F.explode("lines").alias("header"))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in body.schema.fields[2:]]
    return top.select(F.lit(True).alias("is_header"), "header", *nulls).unionAll(body)


def _tails(blocks: DataFrame) -> DataFrame:
    """The last three bytes of each part, or fewer if it is shorter."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("inner")
        data = bgzf.unpacked(t.column("z").to_pylist())
        return pa.table([t.column(c).slice(0, 1) for c in _PART] + [pa.array([data[-3:]], pa.binary())], names=[*_PART, "tail"])

    ends = blocks.withColumn("_n", F.row_number().over(Window.partitionBy(*_PART).orderBy(F.desc("inner")))).where("_n <= 3").drop("_n")
    return ends.groupBy(*_PART).applyInArrow(run, "file string, split long, part long, tail binary")


def _part_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of (of, o, z, before, entry, exit, refs): blocks in order, the last four columns at the first of a part."""
    names = ["is_header", "header", *SAM_FIELDS]
    types = [pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def records(plan: tuple, zs: list[bytes]) -> Iterator[tuple]:
        of, before, entry, end, refs = plan
        data = before + bgzf.unpacked(zs)
        start = of - len(before)
        at = entry - start
        while at < end - start:
            yield _bam_record(data, at, refs)
            at += 4 + struct.unpack_from("<i", data, at)[0]

    def parts() -> Iterator[tuple]:
        plan, zs = None, []
        for batch in batches:
            for of, _, z, before, entry, end, refs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if refs is not None:
                    if plan:
                        yield from records(plan, zs)
                    plan, zs = (of, before, entry, end, refs), []
                zs.append(z)
        if plan:
            yield from records(plan, zs)

    rows = parts()
    while part := [r for _, r in zip(range(4096), rows)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)


def _gunzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with gzip.open(path, "rt", encoding="utf-8", errors="replace", newline="\n") as f:
                while lines := list(itertools.islice(f, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([line.rstrip("\r\n") for line in lines])], ["value"])


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: ``.bam`` is BAM, all else SAM.

    Spark undoes ``.gz``; it knows no ``.gzip``, so such a file, in a folder that tasks mount, is one task's, line by line.
    """
    if path.endswith(".gzip"):
        local = re.sub("^file:/*", "/", path)
        return sam(spark.createDataFrame([(local,)], "path string").mapInArrow(_gunzipped, "value string"))
    return read_bam(spark, path) if path.endswith(".bam") else sam(spark.read.text(path))


def write_sam(records: DataFrame, path: str) -> None:
    """SAM text, always plain: headers, then alignments, each in the order of ``records``.

    Ranges of the order are written in parallel, by files whose names follow it.
    """
    n = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = records.withColumns({"_body": ~F.col("is_header"), "_row": F.monotonically_increasing_id()})
    sam_lines(rows.repartitionByRange(n, "_body", "_row").sortWithinPartitions("_body", "_row")).write.text(path)


def gff3_to_bed(lines: DataFrame) -> DataFrame:
    """(chrom, start, end, name, strand) of the coding lines that name a protein."""
    tabs, blanks = F.split("value", "\t"), F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.when(F.size(tabs) >= 9, tabs).otherwise(blanks).alias("c")).where((F.size("c") >= 9) & (F.get("c", F.lit(2)) == "CDS"))
    c = lambda i: F.get("c", F.lit(i))
    name = F.regexp_extract(F.concat(F.lit(";"), c(8)), ";protein_id=([^;]*)", 1)
    rows = rows.select(F.concat(F.lit("chr"), c(0)).alias("chrom"), (to_long(c(3)) - 1).alias("start"), to_long(c(4)).alias("end"), name.alias("name"), c(6).alias("strand"))
    return rows.where("name <> ''")


def ensembl_ids(lines: DataFrame) -> DataFrame:
    """(protein_id, transcript_id, gene_id) of header lines, empty where there is none."""
    ident = lambda kind: F.regexp_extract("value", rf"(ENS{kind}\d+\.\d+)", 1)
    return lines.where(F.col("value").startswith(">")).select(ident("P").alias("protein_id"), ident("T").alias("transcript_id"), ident("G").alias("gene_id"))


#: A node's name, a jump set, or what lies between these.
_GRAPH_TOKEN = re.compile(r"&([^;]*);|\[([^\]]*)\]|([^&\[\];]+)")


def parse_graph(body: str) -> tuple[str, list[tuple[str, int]], list[tuple[int, int]]]:
    """(characters, (node name, place) pairs, (from, to) jumps) of a FASTA body with ``&name;`` and ``[a b /]``.

    ``[a b]`` before a character names the nodes at which a walk that arrives there may go on; it may also pass
    through, which is a jump to the place itself, unless ``/`` is among the names.
    """
    chars, nodes, sets, at, size = [], [], [], 0, 0
    while at < len(body):
        found = _GRAPH_TOKEN.match(body, at)
        if found is None:
            raise ValueError("Unbalanced node name." if body[at] == "&" else "Unbalanced jump set.")
        name, names, run = found.groups()
        if name is not None:
            nodes.append((name.strip(), size))
        elif names is not None:
            if not names.split():
                raise ValueError("Empty jump set.")
            sets.append((size, names.split()))
        else:
            chars.append("".join(run.split()))
            size += len(chars[-1])
        at = found.end()
    place = dict(nodes)
    jumps = []
    for before, names in sets:
        for n in names:
            if n != "/" and n not in place:
                raise ValueError(f"Unknown node {n}.")
        jumps += [(before, place[n]) for n in names if n != "/"] + [(before, before)] * ("/" not in names)
    return "".join(chars), nodes, jumps


def graph_jumps(graphs: DataFrame) -> DataFrame:
    """(graph_id, chars, jumps array<struct<src, dst>>) of (graph_id, body); a graph is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_graph(b or "") for b in batch.column(1).to_pylist()]
            jumps = pa.array([[{"src": a, "dst": b} for a, b in j] for _, _, j in parsed], pa.list_(pa.struct([("src", pa.int64()), ("dst", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _, _ in parsed], pa.string()), jumps], ["graph_id", "chars", "jumps"])

    return graphs.select(F.col("graph_id").cast("long"), "body").mapInArrow(run, "graph_id long, chars string, jumps array<struct<src:bigint,dst:bigint>>")


def settings(text: str) -> dict[str, str]:
    """``name=value`` lines; ``;`` and ``#`` start comments."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in ";#":
            name, equals, value = line.partition("=")
            if not equals:
                raise ValueError(f"No = in setting: {line}")
            out[name.strip()] = value.strip()
    return out


