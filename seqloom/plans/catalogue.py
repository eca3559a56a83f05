"""The registered queries over the given tables and the SQL of those that SQL can express.

Documents serve as sequences (doc_id is seq_ind), benchmark items as patterns; part names as short
sequences; the relational tables as flat tables.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genome, text
from ..operators import align as al
from ..operators import alignments, digest, graphs, matches, proteins, search, suffix, tables
from ..sources import genomics
from ..sources import matches as match_files
from ..sources import sequences, tables as tsv
from ..staging import shared_dir, staged, with_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that has fewer splits than there are cores dealt to all of them, for what costs much more than the move."""
    table, cores = _t(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def _dealt(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table dealt to all cores by its keys, if one split has twice a core's share of the rows or more.

    A row group is read in one split whatever its size, so there may be as many splits as cores and rows in few of them.
    Only the files' footers are read to count.
    """
    table, cores = _t(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    most, rows = table.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return table.repartition(cores, *keys) if rows and most * cores >= 2 * rows else table


# --- search -------------------------------------------------------------------------------------------------------

SHORT_PATTERNS = ("e", "ee", "ed ", "re", "an", "aa", "l", "ll", "o o", "zz")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_ind"), F.col("source").alias("name"), F.col("text").alias("seq"))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("look_for"), F.col("text").alias("pattern"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_ind"), F.col("p_brand").alias("name"), F.col("p_name").alias("seq"))


def _short(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SHORT_PATTERNS)), "look_for long, pattern string")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_scan(_documents(spark, sf_dir), _patterns(spark, sf_dir))


_FINDFA = """
WITH pat AS (SELECT item_id AS look_for, text AS p FROM benchmark),
hit AS (SELECT look_for, p, doc_id AS found_in, text FROM documents JOIN pat ON contains(text, p) WHERE length(p) > 0),
pos AS (SELECT *, unnest(range(0, length(text) - length(p) + 1)) AS found_at FROM hit),
found AS (SELECT look_for, found_in, CAST(found_at AS BIGINT) AS found_at, CAST(found_at + length(p) AS BIGINT) AS found_to, text FROM pos WHERE substr(text, found_at + 1, length(p)) = p)
"""

_SHORT_SQL = f"""
WITH pat(look_for, p) AS (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(SHORT_PATTERNS))}),
pos AS (SELECT p_partkey AS found_in, p_name, unnest(range(0, length(p_name))) AS found_at FROM part),
found AS (SELECT CAST(look_for AS BIGINT) AS look_for, found_in, CAST(found_at AS BIGINT) AS found_at, CAST(found_at + length(p) AS BIGINT) AS found_to, p_name
          FROM pos JOIN pat ON substr(p_name, found_at + 1, length(p)) = p)
"""


@query(_FINDFA + "SELECT look_for, found_in, found_at, found_to FROM found")
def findfa(spark, sf_dir):
    return _found(spark, sf_dir)


@query(_SHORT_SQL + "SELECT look_for, found_in, found_at, found_to FROM found")
def findfa_overlap(spark, sf_dir):
    return search.find_scan(_parts(spark, sf_dir), _short(spark))


@query(_SHORT_SQL + "SELECT look_for, found_in, found_at, found_to FROM found")
def findsa(spark, sf_dir):
    seqs = _parts(spark, sf_dir)
    indexed = suffix.store(suffix.with_head(suffix.build(seqs), seqs, 2), f"{shared_dir(spark)}/index-{_unique()}")
    return search.find(seqs, _short(spark), indexed, 2)


_SAFA = """
WITH pos AS (SELECT p_partkey AS seq_ind, CAST(unnest(range(0, length(p_name))) AS BIGINT) AS char_ind, p_name FROM part)
SELECT row_number() OVER (ORDER BY substr(p_name, char_ind + 1), seq_ind, char_ind) - 1 AS rank, seq_ind, char_ind FROM pos
"""


@query(_SAFA)
def safa(spark, sf_dir):
    return suffix.build(_parts(spark, sf_dir))


@query(_SAFA)
def safa_doubling(spark, sf_dir):
    return suffix.build_doubling(_parts(spark, sf_dir))


@query(_SAFA)
def mrgsa(spark, sf_dir):
    seqs = with_rank(_parts(spark, sf_dir), ["seq_ind"], "place").withColumnRenamed("seq_ind", "key")
    cut = seqs.agg((F.count("*") / 2).cast("long")).first()[0]
    own = seqs.select(F.col("place").alias("seq_ind"), "key", "seq")
    left, right = own.where(F.col("seq_ind") < cut), own.where(F.col("seq_ind") >= cut).withColumn("seq_ind", F.col("seq_ind") - cut)
    merged, _ = suffix.merge(suffix.build(left), left, suffix.build(right), right)
    return merged.join(own.select("seq_ind", "key"), "seq_ind").select("rank", F.col("key").alias("seq_ind"), "char_ind")


@query(
    """
WITH pos AS (SELECT p_partkey AS seq_ind, CAST(unnest(range(0, length(p_name))) AS BIGINT) AS char_ind, p_name FROM part),
ranked AS (SELECT row_number() OVER (ORDER BY substr(p_name, char_ind + 1), seq_ind, char_ind) - 1 AS rank, seq_ind, char_ind, substr(p_name, char_ind + 1, 4) AS head FROM pos)
SELECT rank, seq_ind, char_ind, array_to_string(list_transform(range(1, 5), lambda i: CASE WHEN i <= length(head) THEN hex(head[i]) ELSE '*' END), ' ') AS bases FROM ranked
"""
)
def dumpsa(spark, sf_dir):
    seqs = _parts(spark, sf_dir)
    return suffix.dump(suffix.build(seqs), seqs, 4)


# --- matches ------------------------------------------------------------------------------------------------------


@query(_FINDFA + "SELECT row_number() OVER (ORDER BY look_for, found_in, found_at, found_to) - 1 AS match_ind, look_for, found_in, found_at, found_to FROM found")
def sortfound(spark, sf_dir):
    return matches.sort_found(_found(spark, sf_dir))


@query(_FINDFA + "SELECT look_for, found_in, found_at, found_to, source AS name FROM found JOIN documents ON doc_id = found_in")
def nameget(spark, sf_dir):
    return matches.names(_found(spark, sf_dir), _documents(spark, sf_dir))


@query(
    _FINDFA
    + """, n AS (SELECT row_number() OVER (ORDER BY look_for, found_in, found_at, found_to) - 1 AS match_ind, * FROM found)
SELECT match_ind, 0 AS part, 'match_' || match_ind || '_pre' AS name, substr(text, greatest(found_at - 5, 0) + 1, found_at - greatest(found_at - 5, 0)) AS seq FROM n
UNION ALL SELECT match_ind, 1, 'match_' || match_ind, substr(text, found_at + 1, found_to - found_at) FROM n
UNION ALL SELECT match_ind, 2, 'match_' || match_ind || '_post', substr(text, found_to + 1, 5) FROM n"""
)
def extfin(spark, sf_dir):
    return matches.surroundings(matches.sort_found(_found(spark, sf_dir)), _documents(spark, sf_dir))


#: A cut after e, r or s in front of the match, and the match ends in one of these or at the end of the sequence.
DIGEST = "[657273]|-[657273]|!\n^|-[657273]|!\n[657273]|-.|$\n^\\e|\\e-|\\d!"


@query(
    _SHORT_SQL
    + """SELECT look_for, found_in, found_at, found_to FROM found
WHERE (substr(p_name, found_at, 1) IN ('e', 'r', 's') AND found_at > 0 AND substr(p_name, found_to, 1) IN ('e', 'r', 's'))
   OR (found_at = 0 AND substr(p_name, found_to, 1) IN ('e', 'r', 's'))
   OR (found_at > 0 AND substr(p_name, found_at, 1) IN ('e', 'r', 's') AND found_to = length(p_name))
   OR (found_at = 1 AND substr(p_name, 1, 1) = 'e' AND substr(p_name, found_at + 1, 1) = 'e' AND substr(p_name, found_to + 1, 1) = 'd')"""
)
def matfildig(spark, sf_dir):
    rules, bad = digest.parse_rules(DIGEST)
    assert not bad, bad
    seqs = _parts(spark, sf_dir)
    return digest.filter_matches(search.find_scan(seqs, _short(spark)), seqs, rules)


@query(_FINDFA + "SELECT upper(lpad(hex(look_for), 16, '0') || lpad(hex(found_in), 16, '0') || lpad(hex(found_at), 16, '0') || lpad(hex(found_to), 16, '0')) AS record FROM found")
def match_records(spark, sf_dir):
    return match_files.match_bytes(_found(spark, sf_dir)).select(F.hex("record").alias("record"))


@query(_FINDFA + "SELECT look_for, found_in, found_at, found_to FROM found")
def match_text_round_trip(spark, sf_dir):
    return match_files.parse_match_text(match_files.match_text(_found(spark, sf_dir)))


# --- sequence and table stores ------------------------------------------------------------------------------------

_LINE = "regexp_replace(coalesce(text, ''), '\\s', '', 'g')"


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq_ind, 'doc ' || doc_id || ' ' || source AS name, 'doc' AS short_name, CAST(length({_LINE}) AS BIGINT) AS n, md5({_LINE}) AS digest FROM documents")
def zipfa(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    seq = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t-\r ]", "")
    rows = docs.select(F.col("doc_id").alias("seq_ind"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" "), F.col("source")).alias("name"), F.lit("doc").alias("short_name"), seq.alias("seq"), F.lit(None).cast("array<double>").alias("qual"))
    packed = sequences.pack([rows], f"{shared_dir(spark)}/pack-{_unique()}")
    return packed.select("seq_ind", "name", "short_name", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query(f"SELECT 'doc ' || doc_id || ' ' || source AS name, CAST(length({_LINE}) AS BIGINT) AS n, md5({_LINE}) AS digest FROM documents")
def unzipfa(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    seq = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t-\r ]", "")
    rows = docs.select(F.col("doc_id").alias("seq_ind"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" "), F.col("source")).alias("name"), seq.alias("seq"), F.lit(None).cast("array<double>").alias("qual"))
    path = f"{shared_dir(spark)}/fasta-{_unique()}"
    sequences.write_sequences(rows, path)
    return sequences.read_fasta(spark, path).select("name", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


def _unique() -> str:
    import uuid

    return uuid.uuid4().hex


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return tsv.from_columns(c, F.col("c_custkey"), F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"))


@query("SELECT c_custkey AS row_ind, CAST(c_custkey AS VARCHAR) || '|' || c_name || chr(9) || chr(10) || '\\' || '|' || c_mktsegment AS cells FROM customer")
def ziptab(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    table = tsv.from_columns(c, F.col("c_custkey"), F.col("c_custkey"), F.concat("c_name", F.lit("\t\n\\")), F.col("c_mktsegment"))
    lines = table.select("row_ind", tsv.format_line(F.col("cells")).alias("value"))
    return lines.select("row_ind", F.array_join(tsv.parse_line(F.col("value")), "|").alias("cells"))


@query("SELECT row_number() OVER (ORDER BY p_name, p_brand, p_partkey) - 1 AS rank, p_partkey AS row_ind FROM part")
def sorttab_str(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return tables.sort_table(tsv.from_columns(p, F.col("p_partkey"), F.col("p_name"), F.col("p_brand")), ["0", "1"]).select("rank", "row_ind")


@query("SELECT row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS rank, p_partkey AS row_ind FROM part")
def sorttab_int(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return tables.sort_table(tsv.from_columns(p, F.col("p_partkey"), F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("cm"))), ["i0"]).select("rank", "row_ind")


@query("SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rank, c_custkey AS row_ind FROM customer")
def sorttab_float(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return tables.sort_table(tsv.from_columns(c, F.col("c_custkey"), F.col("c_acctbal")), ["f0"]).select("rank", "row_ind")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return tsv.from_columns(o, F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey"))


_FINDTAB = "SELECT o_orderkey AS probe_ind, CAST(c_custkey AS VARCHAR) || '|' || c_name || '|' || c_mktsegment AS cells FROM orders JOIN customer ON c_custkey = o_custkey"


@query(_FINDTAB)
def findtab(spark, sf_dir):
    found = tables.look_up(_orders(spark, sf_dir), _customers(spark, sf_dir), ["i1"], ["i0"])
    return found.select("probe_ind", F.array_join("cells", "|").alias("cells"))


@query(
    """SELECT a.l_orderkey * 10 + a.l_linenumber AS probe_ind, CAST(p.p_brand AS VARCHAR) || '|' || CAST(p.p_size AS VARCHAR) || '|' || p.p_name AS cells
FROM lineitem a JOIN part p ON p.p_partkey = a.l_partkey AND p.p_size = a.l_linenumber"""
)
def findtabs(spark, sf_dir):
    li, p = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    probes = tsv.from_columns(li, F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_partkey"), F.col("l_linenumber"))
    database = tsv.from_columns(p, F.col("p_partkey"), F.col("p_brand"), F.col("p_size"), F.col("p_name"), F.col("p_partkey"))
    store = tables.write_sorted(database, ["i3", "i1"], f"{shared_dir(spark)}/sorted-{_unique()}")
    found = tables.look_up_sorted(probes, store, ["i0", "i1"])
    return found.select("probe_ind", F.array_join(F.slice("cells", 1, 3), "|").alias("cells"))


@query(f"SELECT row_number() OVER (ORDER BY probe_ind, cells) - 1 AS rank, probe_ind, cells FROM ({_FINDTAB})")
def sortfindtab(spark, sf_dir):
    found = tables.look_up(_orders(spark, sf_dir), _customers(spark, sf_dir), ["i1"], ["i0"])
    return tables.sort_found_rows(found).select("rank", "probe_ind", F.array_join("cells", "|").alias("cells"))


@query(
    """SELECT c.c_custkey AS probe_ind, coalesce(any_value(CAST(o.o_orderkey AS VARCHAR) || '|' || o.o_orderpriority), '') AS cells
FROM customer c LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey"""
)
def legacy_lookup(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    database = tsv.from_columns(o, F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey"))
    found = tables.look_up_first(_customers(spark, sf_dir), database, ["i0"], ["i2"])
    return found.select("probe_ind", F.array_join(F.slice("cells", 1, 2), "|").alias("cells"))


@query("SELECT max(length(p_name)) AS width0, max(length(CAST(p_size AS VARCHAR))) AS width1, count(*) AS n FROM part")
def table_widths(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    table = tsv.from_columns(p, F.col("p_partkey"), F.col("p_name"), F.col("p_size"))
    return tables.widest(table, ["0", "i1"])


# --- proteins, variants, reports ----------------------------------------------------------------------------------


def _bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as exons: a part is a protein, its lines are stretches of the chromosome named by its key."""
    li = _t(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 1000
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("chr"), (F.col("l_partkey") % 23).cast("string")).alias("chrom"), start.alias("start"),
        (start + 3 * F.col("l_linenumber")).alias("end"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


_BED = """SELECT l_orderkey * 10 + l_linenumber AS ord, 'chr' || (l_partkey % 23) AS chrom, l_orderkey * 1000 AS s, l_orderkey * 1000 + 3 * l_linenumber AS e,
 'P' || l_partkey AS name, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem"""


@query(f"SELECT name, string_agg(chrom || ':' || s || '-' || e || ':' || strand, ';' ORDER BY ord) AS locs FROM ({_BED}) GROUP BY name")
def prepare_pro(spark, sf_dir):
    rows = proteins.protein_rollup(_bed(spark, sf_dir))
    show = lambda x: F.concat(x["chrom"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.when(x["positive"], ":+").otherwise(":-"))
    return rows.select("name", F.array_join(F.transform("locs", show), ";").alias("locs"))


def _variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("name"), F.concat(F.lit("I"), (F.col("event_id") % 17).cast("string")).alias("ind"),
        F.col("event_type").alias("cigar"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("d"), (F.col("event_id") % 5).cast("string"))).alias("dif"),
    )


_VARIANTS = """rows AS (SELECT event_id AS ord, 'V' || user_id AS name, 'I' || (event_id % 17) AS ind, event_type AS cigar, CASE WHEN event_id % 3 = 0 THEN 'd' || (event_id % 5) END AS dif FROM events)"""


@query(
    f"""WITH {_VARIANTS}, votes AS (SELECT name, cigar, count(*) AS n, min(ord) AS first FROM rows GROUP BY 1, 2),
best AS (SELECT name, cigar FROM votes QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, first) = 1),
kinds AS (SELECT name, count(*) AS n_cigars FROM votes GROUP BY name),
lists AS (SELECT name, string_agg(ind, ',' ORDER BY ord) AS inds, coalesce(string_agg(DISTINCT dif, ',' ORDER BY dif), '') AS difs FROM rows GROUP BY name)
SELECT name, cigar, n_cigars, inds, difs FROM best JOIN kinds USING (name) JOIN lists USING (name)"""
)
def prepare_var(spark, sf_dir):
    rows = proteins.variant_rollup(_variant_rows(spark, sf_dir))
    return rows.select("name", "cigar", "n_cigars", F.array_join("inds", ",").alias("inds"), F.array_join("difs", ",").alias("difs"))


def _found_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = proteins.variant_rollup(_variant_rows(spark, sf_dir))
    return v.select((F.regexp_extract("name", "([0-9]+)", 1).cast("long") % 50).alias("look_for"), "inds", "difs")


_LOOK = f"WITH {_VARIANTS}, look AS (SELECT CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) % 50 AS look_for, * FROM rows)"


@query(_LOOK + "SELECT look_for, string_agg(DISTINCT ind, '|' ORDER BY ind) AS owners, count(DISTINCT ind) AS n_owners FROM look GROUP BY look_for")
def ownership(spark, sf_dir):
    return proteins.ownership(_found_variants(spark, sf_dir)).select("look_for", F.array_join("owners", "|").alias("owners"), "n_owners")


@query(_LOOK + "SELECT look_for, string_agg(DISTINCT dif, '|' ORDER BY dif) AS variants FROM look WHERE dif IS NOT NULL GROUP BY look_for")
def variants(spark, sf_dir):
    return proteins.peptide_variants(_found_variants(spark, sf_dir)).select("look_for", F.array_join("variants", "|").alias("variants"))


@query(
    _LOOK
    + """, a AS (SELECT look_for, count(DISTINCT ind) AS n, string_agg(DISTINCT dif, '|' ORDER BY dif) AS v FROM look GROUP BY look_for)
SELECT item_id AS look_for, text AS pattern, coalesce(n, 0) AS n_owners, coalesce(v, '') AS variants FROM benchmark LEFT JOIN a ON look_for = item_id"""
)
def freqs(spark, sf_dir):
    return proteins.frequencies(_patterns(spark, sf_dir), _found_variants(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, 'P' || l_partkey AS protein FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def limit_proteins(spark, sf_dir):
    found = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("_x")).alias("name"))
    wanted = _t(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("protein"))
    return proteins.limit_to_proteins(found, wanted).select("l_orderkey", "l_linenumber", proteins.protein_of(F.col("name")).alias("protein"))


def _difference_text() -> Column:
    good = F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), (F.col("l_linenumber") + 2).cast("string"), F.lit("S>F:"), F.col("l_orderkey").cast("string"), F.lit("C>T"))
    return F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("odd"), F.col("l_orderkey").cast("string"))).otherwise(good)


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN 'Questionable variant: odd' || l_orderkey END AS warning,
CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS prot_start, CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_linenumber + 2 AS BIGINT) END AS prot_end,
CASE WHEN l_partkey % 7 <> 0 THEN 'S>F' END AS prot_change, CASE WHEN l_partkey % 7 <> 0 THEN l_orderkey END AS gen_loc, CASE WHEN l_partkey % 7 <> 0 THEN 'C>T' END AS gen_change FROM lineitem"""
)
def parse_diff(spark, sf_dir):
    d = genome.difference(_difference_text())
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", "d.warning", "d.prot_start", "d.prot_end", "d.prot_change", "d.gen_loc", "d.gen_change")


def _cigar() -> Column:
    """aS bM cI dD bM: a, c, d from the line number, b from the quantity."""
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    return F.concat(n, F.lit("S"), q, F.lit("M"), n, F.lit("I"), n, F.lit("D"), q, F.lit("M"))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS n, CAST(floor(l_quantity) AS BIGINT) AS q, CAST(l_suppkey AS BIGINT) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, n AS soft_start, CAST(0 AS BIGINT) AS soft_end,
       array_to_string(list_concat(list_concat(range(s, s + q), list_transform(range(0, n), lambda i: CAST(-1 AS BIGINT))), range(s + q + n, s + q + n + q)), ',') AS positions FROM c"""
)
def cigar_positions(spark, sf_dir):
    p = genome.cigar_positions(_cigar(), F.col("l_suppkey").cast("long"))
    rows = _spread(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "p.soft_start", "p.soft_end", F.array_join(F.col("p.positions").cast("array<string>"), ",").alias("positions"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS BIGINT) AS first, CAST(l_suppkey + 2 * floor(l_quantity) + l_linenumber - 1 AS BIGINT) AS last FROM lineitem")
def cigar_bounds(spark, sf_dir):
    b = genome.cigar_bounds(genome.cigar_runs(_cigar(), F.col("l_suppkey").cast("long"))["runs"])
    return _spread(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", b.alias("b")).select("l_orderkey", "l_linenumber", "b.first", "b.last")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 <> 0 AND l_linenumber <= 5 + 2 AND l_linenumber + 2 >= 3 - 2
 THEN l_linenumber || '-' || (l_linenumber + 2) || 'S>F:' || l_orderkey || 'C>T' ELSE '' END AS near FROM lineitem"""
)
def near_match(spark, sf_dir):
    near = genome.near_differences(genome.differences(_difference_text()), F.lit("50M"), F.lit(3), F.lit(6), 2)
    return _dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.array_join(F.transform(near, lambda d: d["desc"]), ";").alias("near"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'c:' || (l_orderkey * 1000 + 3) || '-' || (l_orderkey * 1000 + 3 + 3 * l_linenumber - 1)
 ELSE 'c:' || (l_orderkey * 1000 + 3 * (l_linenumber + 2) - 4) || '-' || (l_orderkey * 1000 + 3 * (l_linenumber + 2) - 4 - 3 * l_linenumber + 1) END AS location FROM lineitem"""
)
def genome_location(spark, sf_dir):
    start = F.col("l_orderkey") * 1000
    loc = F.array(F.struct(F.lit("c").alias("chrom"), start.alias("start"), (start + 3 * (F.col("l_linenumber") + 2)).alias("end"), (F.col("l_partkey") % 2 == 0).alias("positive")))
    cigar = F.concat((F.col("l_linenumber") + 2).cast("string"), F.lit("M"))
    where = genome.genome_location(loc, cigar, F.lit(1), F.col("l_linenumber") + 1)
    return _dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", where["location"].alias("location"))


def _odd_cigar() -> Column:
    """By the part's number: a M, b I, c M, d D, e M, or too short, clipped, malformed, ``???`` or missing."""
    n, k = lambda m, low: (F.col("l_partkey") % m + low).cast("string"), F.col("l_partkey") % 11
    whole = F.concat(n(3, 1), F.lit("M"), n(4, 0), F.lit("I"), n(5, 1), F.lit("M"), n(3, 0), F.lit("D"), n(7, 6), F.lit("M"))
    return F.when(k == 0, None).when(k == 1, "???").when(k == 2, "3M1Q").when(k == 3, "2S18M").when(k == 4, "4M").otherwise(whole)


#: Residues' reference positions, list by list: what the CIGAR says, or the residue itself.
_ODD_CIGAR = """o AS (
  SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 11 AS k, l_linenumber % 4 AS a, l_linenumber % 4 + 1 + l_suppkey % 6 AS b,
         l_partkey % 3 + 1 AS m1, l_partkey % 4 AS i1, l_partkey % 5 + 1 AS m2, l_partkey % 3 AS d1, l_partkey % 7 + 6 AS m3 FROM lineitem),
c AS (
  SELECT *, CASE WHEN k >= 5 AND b <= m1 + i1 + m2 + m3 THEN list_concat(list_concat(list_concat(range(0, m1), list_transform(range(0, i1), lambda i: CAST(-1 AS BIGINT))), range(m1, m1 + m2)), range(m1 + m2 + d1, m1 + m2 + d1 + m3))
              WHEN k = 4 AND b <= 4 THEN range(0, 4) ELSE range(0, b) END AS pos,
         CASE k WHEN 0 THEN 'Missing CIGAR.' WHEN 1 THEN 'Missing CIGAR.' WHEN 2 THEN 'Bad CIGAR: Unknown operation in CIGAR.' WHEN 3 THEN 'Bad CIGAR: Soft clip in the CIGAR of a protein.'
              WHEN 4 THEN CASE WHEN b > 4 THEN 'Bad CIGAR: Match beyond the end of the CIGAR.' END
              ELSE CASE WHEN b > m1 + i1 + m2 + m3 THEN 'Bad CIGAR: Match beyond the end of the CIGAR.' END END AS cigar_warning
  FROM o)"""


@query(
    f"""WITH {_ODD_CIGAR},
e AS (
  SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 3 END AS n_exons, l_linenumber % 2 = 0 AS forward, l_suppkey * 100 AS s FROM c),
g AS (
  SELECT *, list_concat(list_concat(range(s, s + l_partkey % 9 + 4), CASE WHEN n_exons = 3 THEN range(s + 40, s + 40 + l_suppkey % 4) ELSE [] END),
            CASE WHEN n_exons = 3 THEN range(s + 40 + l_suppkey % 4, s + 60 + l_partkey % 5) ELSE [] END) AS up
  FROM e),
h AS (SELECT *, CASE WHEN forward THEN up ELSE list_reverse(up) END AS bases, len(up) // 3 AS codons, CASE WHEN forward THEN 1 ELSE -1 END AS step FROM g),
residues AS (SELECT rid, step, unnest(range(a, b)) AS i, bases, codons, pos FROM h),
p AS (SELECT rid, step, i, bases, CASE WHEN pos[i + 1] >= codons THEN -1 ELSE pos[i + 1] END AS r FROM residues),
flat AS (
  SELECT rid, step, i, j, CASE WHEN r < 0 THEN -1 ELSE bases[3 * r + j + 1] END AS x FROM p, range(3) t(j) WHERE r >= 0 OR j = 0),
marked AS (
  SELECT *, row_number() OVER w AS k, lag(x) OVER w AS before FROM flat WINDOW w AS (PARTITION BY rid ORDER BY i, j)),
runs AS (
  SELECT *, sum(CASE WHEN before IS NULL OR NOT ((x < 0 AND before < 0) OR (x >= 0 AND before >= 0 AND x = before + step)) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY k) AS run FROM marked),
parts AS (
  SELECT rid, run, CASE WHEN any_value(x) < 0 THEN '-1' WHEN count(*) = 1 THEN 'c:' || min(x) ELSE 'c:' || arg_min(x, k) || '-' || arg_max(x, k) END AS part FROM runs GROUP BY ALL),
texts AS (SELECT rid, string_agg(part, '|' ORDER BY run) AS location FROM parts GROUP BY ALL)
SELECT h.l_orderkey, h.l_linenumber, t.location,
       array_to_string(list_filter([CASE WHEN n_exons = 3 AND l_partkey % 7 = 0 THEN 'Multiple chromosomes.' END, CASE WHEN n_exons = 1 THEN 'Both strands.' END, CASE WHEN len(up) % 3 <> 0 THEN 'Not whole codons.' END,
         cigar_warning, CASE WHEN list_max(pos) >= codons THEN 'CIGAR beyond location.' END], lambda w: w IS NOT NULL), '|') AS warnings
FROM h JOIN texts t USING (rid)"""
)
def genome_location_exons(spark, sf_dir):
    """Three exons, two of which touch, on either strand; some turn after the first; CIGARs of all kinds."""
    s, forward, mixed = F.col("l_suppkey").cast("long") * 100, F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") % 5 == 0
    exon = lambda chrom, a, b, way: F.struct(chrom.alias("chrom"), a.alias("start"), b.alias("end"), way.alias("positive"))
    first = exon(F.lit("c"), s, s + F.col("l_partkey") % 9 + 4, forward)
    second = exon(F.lit("c"), s + 40, s + 40 + F.col("l_suppkey") % 4, forward != mixed)
    third = exon(F.when(F.col("l_partkey") % 7 == 0, "d").otherwise("c"), s + 40 + F.col("l_suppkey") % 4, s + 60 + F.col("l_partkey") % 5, forward)
    at = F.col("l_linenumber") % 4
    where = genome.genome_location(F.array(first, second, third), _odd_cigar(), at, at + 1 + F.col("l_suppkey") % 6)
    rows = _dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", where.alias("w"))
    return rows.select("l_orderkey", "l_linenumber", "w.location", F.array_join("w.warnings", "|").alias("warnings"))


@query(
    f"""WITH {_ODD_CIGAR},
x AS (
  SELECT *, list_filter(pos[a + 1:b], lambda p: p >= 0) AS inside, list_filter(pos[1:a], lambda p: p >= 0) AS before, list_filter(pos[b + 1:], lambda p: p >= 0) AS after
  FROM c WHERE cigar_warning IS NULL OR cigar_warning = 'Missing CIGAR.'),
r AS (
  SELECT *, coalesce(list_min(inside), list_max(before), list_max(inside), list_min(after)) - 1 AS low, coalesce(list_max(inside), list_min(after), list_min(inside), list_max(before)) + 1 AS high FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 <> 0 AND l_linenumber <= high AND l_linenumber + 2 >= low
 THEN l_linenumber || '-' || (l_linenumber + 2) || 'S>F:' || l_orderkey || 'C>T' ELSE '' END AS near FROM r"""
)
def near_match_cigars(spark, sf_dir):
    """Insertions, deletions and missing CIGARs; those that place no match are errors and left out before."""
    at, to, cigar, k = F.col("l_linenumber") % 4, F.col("l_linenumber") % 4 + 1 + F.col("l_suppkey") % 6, _odd_cigar(), F.col("l_partkey") % 11
    rows = _dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").withColumns({"cigar": cigar, "at": at, "to": to})
    long_enough = F.when(k == 4, F.col("to") <= 4).otherwise(F.col("to") <= F.col("l_partkey") % 3 + F.col("l_partkey") % 4 + F.col("l_partkey") % 5 + F.col("l_partkey") % 7 + 8)
    rows = rows.where((k < 2) | ((k > 3) & long_enough))
    near = genome.near_differences(genome.differences(_difference_text()), F.col("cigar"), F.col("at"), F.col("to"), 1)
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform(near, lambda d: d["desc"]), ";").alias("near"))


@query(
    _SHORT_SQL.rstrip()
    + """,
m AS (SELECT look_for, found_in AS p, found_at, found_to, row_number() OVER (ORDER BY look_for, found_in, found_at, found_to) - 1 AS match_ind FROM found),
locs AS (SELECT l_partkey AS p, flatten(list(range(l_orderkey * 1000, l_orderkey * 1000 + 3 * l_linenumber) ORDER BY l_orderkey * 10 + l_linenumber, l_orderkey, l_linenumber)) AS up FROM lineitem GROUP BY l_partkey),
v AS (
  SELECT user_id AS p, count(DISTINCT event_id % 17) AS n_owners, string_agg(DISTINCT 'I' || event_id % 17, '|' ORDER BY 'I' || event_id % 17) AS owners,
         CASE user_id % 4 WHEN 0 THEN '3M2I94M' WHEN 1 THEN '2M4D97M' WHEN 2 THEN '3S96M' ELSE '99M' END AS cigar FROM events GROUP BY user_id),
x AS (
  SELECT m.*, n_owners, owners, cigar, up, len(up) // 3 AS codons, CASE WHEN m.p % 2 = 0 THEN 1 ELSE -1 END AS step, CASE WHEN m.p % 2 = 0 THEN up ELSE list_reverse(up) END AS bases,
         CASE cigar WHEN '3M2I94M' THEN list_concat([0, 1, 2, -1, -1], range(3, 97)) WHEN '2M4D97M' THEN list_concat([0, 1], range(6, 103)) WHEN '99M' THEN range(0, 99) ELSE range(0, found_to) END AS pos
  FROM m LEFT JOIN v ON m.p = v.p LEFT JOIN locs ON locs.p = m.p),
residues AS (SELECT match_ind, step, bases, codons, pos, unnest(range(found_at, found_to)) AS i FROM x WHERE up IS NOT NULL),
r AS (SELECT match_ind, step, bases, i, CASE WHEN pos[i + 1] >= codons THEN -1 ELSE pos[i + 1] END AS r FROM residues),
flat AS (SELECT match_ind, step, i, j, CASE WHEN r < 0 THEN -1 ELSE bases[3 * r + j + 1] END AS b FROM r, range(3) t(j) WHERE r >= 0 OR j = 0),
marked AS (SELECT *, row_number() OVER w AS k, lag(b) OVER w AS before FROM flat WINDOW w AS (PARTITION BY match_ind ORDER BY i, j)),
runs AS (
  SELECT *, sum(CASE WHEN before IS NULL OR NOT ((b < 0 AND before < 0) OR (b >= 0 AND before >= 0 AND b = before + step)) THEN 1 ELSE 0 END) OVER (PARTITION BY match_ind ORDER BY k) AS run FROM marked),
parts AS (SELECT match_ind, run, min(b) AS least, count(*) AS n, arg_min(b, k) AS a, arg_max(b, k) AS z FROM runs GROUP BY match_ind, run),
texts AS (SELECT match_ind, string_agg(CASE WHEN least < 0 THEN '-1' ELSE 'chr' || p % 23 || ':' || a || CASE WHEN n > 1 THEN '-' || z ELSE '' END END, '|' ORDER BY run) AS location
          FROM parts JOIN m USING (match_ind) GROUP BY match_ind),
ends AS (
  SELECT match_ind, list_filter(pos[found_at + 1:found_to], lambda q: q >= 0) AS inside, list_filter(pos[1:found_at], lambda q: q >= 0) AS before, list_filter(pos[found_to + 1:], lambda q: q >= 0) AS after
  FROM x WHERE cigar IS NOT NULL AND cigar <> '3S96M'),
near AS (
  SELECT match_ind, coalesce(list_min(inside), list_max(before), list_max(inside), list_min(after)) - 1 AS low, coalesce(list_max(inside), list_min(after), list_min(inside), list_max(before)) + 1 AS high FROM ends)
SELECT CAST(pat.look_for AS BIGINT) AS look_for, pat.p AS pattern, match_ind IS NOT NULL AS found, match_ind, coalesce('P' || x.p || '_1', '') AS name, coalesce('P' || x.p, '') AS protein,
       coalesce(p_brand, '') AS transcript, coalesce(p_type, '') AS gene, found_at, found_to, coalesce(CASE WHEN cigar <> '3S96M' THEN cigar END, '') AS cigar, coalesce(location, '') AS location,
       CASE WHEN match_ind IS NULL THEN '' WHEN up IS NULL THEN 'No location.' ELSE array_to_string(list_filter([CASE WHEN cigar IS NULL OR cigar = '3S96M' THEN 'Missing CIGAR.' END,
         CASE WHEN list_max(pos) >= codons THEN 'CIGAR beyond location.' END], lambda w: w IS NOT NULL), '|') END AS warnings,
       coalesce(n_owners, 0) AS n_owners, coalesce(owners, '') AS owners,
       CASE WHEN x.p % 20 <= high AND x.p % 20 + 1 >= low THEN x.p % 20 || '-' || (x.p % 20 + 1) || 'A>B:5C>T' ELSE '' END AS near_variants
FROM pat LEFT JOIN x ON pat.look_for = x.look_for LEFT JOIN part ON p_partkey = x.p LEFT JOIN texts USING (match_ind) LEFT JOIN near USING (match_ind)"""
)
def peptide_report(spark, sf_dir):
    """The whole chain: search, order, names, proteins, variants, report; variants with insertions, deletions and no CIGAR."""
    seqs = _parts(spark, sf_dir).withColumn("name", F.concat(F.lit("P"), F.col("seq_ind").cast("string"), F.lit("_1")))
    found = matches.names(matches.sort_found(search.find_scan(seqs, _short(spark))), seqs)
    k = F.regexp_extract("name", "([0-9]+)$", 1).cast("long")
    near = F.when(k % 4 != 2, F.concat((k % 20).cast("string"), F.lit("-"), (k % 20 + 1).cast("string"), F.lit("A>B:5C>T")))
    cigar = F.when(k % 4 == 0, "3M2I94M").when(k % 4 == 1, "2M4D97M").when(k % 4 == 3, "99M")
    v = proteins.variant_rollup(_variant_rows(spark, sf_dir)).withColumns({"cigar": cigar, "difs": F.concat("difs", F.array(near)), "name": F.concat(F.lit("P"), k.cast("string"), F.lit("_1"))})
    found = proteins.with_proteins(found, proteins.protein_rollup(_bed(spark, sf_dir)), v)
    ids = _t(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("protein"), F.col("p_brand").alias("transcript"), F.col("p_type").alias("gene"))
    return proteins.peptide_report(_short(spark), found, ids, 1)


# --- genomics -----------------------------------------------------------------------------------------------------


@query(
    """SELECT 'chr' || l_suppkey AS chrom, CAST(l_partkey - 1 AS BIGINT) AS start, l_orderkey AS "end", 'p' || l_linenumber AS name, l_returnflag AS strand FROM lineitem WHERE l_linenumber <> 1"""
)
def gff3_to_bed(spark, sf_dir):
    c = F.col
    li = _t(spark, sf_dir, "lineitem")
    attrs = F.concat(F.lit("ID=x;protein_id=p"), c("l_linenumber").cast("string"), F.lit(";note=a b"))
    line = F.concat_ws("\t", c("l_suppkey").cast("string"), F.lit("src"), F.when(c("l_linenumber") == 1, "gene").otherwise("CDS"), c("l_partkey").cast("string"), c("l_orderkey").cast("string"), F.lit("."), c("l_returnflag"), F.lit("0"), attrs)
    return genomics.gff3_to_bed(li.select(line.alias("value")))


@query("SELECT 'ENSP' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.1' AS protein_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'ENST' || p_size || '.2' END AS transcript_id, 'ENSG' || p_size || '.3' AS gene_id FROM part")
def ensembl_ids(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    line = F.concat(F.lit(">ENSP"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".1 pep "), F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.concat(F.lit("transcript:ENST"), F.col("p_size").cast("string"), F.lit(".2"))), F.lit(" gene:ENSG"), F.col("p_size").cast("string"), F.lit(".3"))
    return genomics.ensembl_ids(p.select(F.explode(F.array(line, F.lit("MKR"))).alias("value")))


@query("""SELECT 'chr' || l_suppkey AS chrom, CAST(l_partkey AS BIGINT) AS start, l_orderkey AS "end" FROM lineitem WHERE l_linenumber <> 2""")
def bed_read(spark, sf_dir):
    line = F.concat(F.when(F.col("l_linenumber") == 2, "#").otherwise(""), F.concat_ws("\t", F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string"), F.lit("x")))
    return genomics.bed(_t(spark, sf_dir, "lineitem").select(line.alias("value")))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN 'chr' || l_suppkey END AS ref, CASE WHEN l_linenumber <> 3 THEN CAST(l_partkey AS BIGINT) END AS start,
CASE WHEN l_linenumber <> 3 THEN CASE WHEN l_linenumber = 1 THEN CAST(l_partkey + 1 AS BIGINT) ELSE l_orderkey END END AS "end" FROM lineitem"""
)
def ucsc(spark, sf_dir):
    head = F.concat(F.lit("chr"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") == 3, "=").otherwise(":"), F.col("l_partkey").cast("string"))
    t = F.when(F.col("l_linenumber") == 1, head).otherwise(F.concat(head, F.lit("-"), F.col("l_orderkey").cast("string")))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", genome.ucsc(t).alias("u")).select("l_orderkey", "l_linenumber", "u.ref", "u.start", "u.end")


@query(
    """SELECT l_orderkey, l_linenumber, (f & 2304) = 0 AS is_primary, (f & 1) <> 0 AS needs_pair, (f & 4) = 0 AND NOT ((f & 64) <> 0 AND (f & 128) <> 0) AND l_linenumber > 1 AND l_returnflag <> 'R' AS is_alignment
FROM (SELECT *, CAST(l_partkey % 4096 AS BIGINT) AS f FROM lineitem)"""
)
def sam_flags(spark, sf_dir):
    flag, pos = (F.col("l_partkey") % 4096).cast("int"), F.col("l_linenumber").cast("long") - 2
    cigar = F.when(F.col("l_returnflag") == "R", "5S").otherwise("3S2M")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", genome.is_primary(flag).alias("is_primary"), genome.needs_pair(flag).alias("needs_pair"), genome.is_alignment(flag, pos, cigar).alias("is_alignment"))


_SAM_LINE = """'r' || l_orderkey || chr(9) || (l_partkey % 4096) || chr(9) || CASE WHEN l_linenumber = 1 THEN '*' ELSE 'chr1' END || chr(9) || l_suppkey || chr(9) || '60' || chr(9)
 || '4M' || chr(9) || '=' || chr(9) || '0' || chr(9) || '-5' || chr(9) || 'ACGT' || chr(9) || CASE WHEN l_linenumber = 2 THEN '*' ELSE 'IIII' END || CASE WHEN l_linenumber = 3 THEN chr(9) || 'NM:i:1' || chr(9) || 'XX:Z:a' ELSE '' END"""


@query(f"SELECT {_SAM_LINE} AS line FROM lineitem")
def sam_round_trip(spark, sf_dir):
    c, s = F.col, (lambda x: F.col(x).cast("string"))
    line = F.concat_ws(
        "\t", F.concat(F.lit("r"), s("l_orderkey")), (c("l_partkey") % 4096).cast("string"), F.when(c("l_linenumber") == 1, "*").otherwise("chr1"), s("l_suppkey"), F.lit("60"), F.lit("4M"), F.lit("="), F.lit("0"), F.lit("-5"),
        F.lit("ACGT"), F.when(c("l_linenumber") == 2, "*").otherwise("IIII"), F.when(c("l_linenumber") == 3, F.concat(F.lit("NM:i:1\tXX:Z:a"))),
    )
    return genomics.sam_lines(genomics.sam(_t(spark, sf_dir, "lineitem").select(line.alias("value")))).select(F.col("value").alias("line"))


@query(
    """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
SELECT user_id AS name, CAST(k // 2 AS BIGINT) AS pair_ind, min(event_id) AS first, max(event_id) AS second FROM n GROUP BY user_id, k // 2 HAVING count(*) = 2"""
)
def mate_pairs(spark, sf_dir):
    pairs, _ = alignments.mate_pairs(_t(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")
    return pairs.select("name", "pair_ind", F.col("first.event_id").alias("first"), F.col("second.event_id").alias("second"))


@query(
    """WITH r AS (SELECT n_nationkey AS id, n_nationkey AS size, n_nationkey % 3 AS kind FROM nation),
j AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, r.id, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS priority
      FROM lineitem LEFT JOIN r ON l_linenumber >= r.size % 5 AND (r.kind = 1 OR l_linenumber < r.size % 5 + 3) AND (r.kind = 2 OR (l_quantity >= r.size AND l_quantity < r.size + 10)))
SELECT point_id, CAST(arg_max(id, priority * 1000000 + id) AS BIGINT) AS cost FROM j GROUP BY point_id"""
)
def region_cost(spark, sf_dir):
    points = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("b"))
    size = F.col("n_nationkey")
    kind, none = size % 3, F.lit(-1)
    regions = _t(spark, sf_dir, "nation").select(
        size.alias("region_id"), (size % 5).alias("start_a"), F.when(kind == 1, none).otherwise(size % 5 + 3).alias("end_a"), F.when(kind == 2, none).otherwise(size).alias("start_b"),
        F.when(kind == 2, none).otherwise(size + 10).alias("end_b"), size.cast("long").alias("cost"),
    )
    return alignments.region_costs(points, regions)


@query("SELECT l_orderkey * 10 + l_linenumber AS point_id, CASE WHEN l_quantity < 11 THEN 1 WHEN l_quantity < 31 THEN 2 END AS cost FROM lineitem")
def quality_cost(spark, sf_dir):
    points = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), F.floor("l_quantity").cast("int").alias("quality"))
    return alignments.quality_costs(points, spark.createDataFrame([(0, 10, 1), (11, 30, 2)], "low int, high int, cost int"))


# --- scalars ------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand AS quality, CAST(-(ascii(p_brand) - 33) / 10.0 AS DOUBLE) AS first FROM part")
def phred(spark, sf_dir):
    log = text.phred_to_log10(F.col("p_brand"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.log10_to_phred(log).alias("quality"), log[0].alias("first"))


@query("SELECT p_partkey, translate(reverse(p_name), 'ACGTacgt', 'TGCAtgca') AS seq, reverse(p_name) AS reversed FROM part")
def revcomp(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.reverse_complement(F.col("p_name")).alias("seq"), F.reverse("p_name").alias("reversed"))


@query(
    """SELECT p_partkey, CAST(length(regexp_extract(p_name, '^[^ e]*')) AS INTEGER) AS until, CAST(length(regexp_extract(p_name, '^[a-l]*')) AS INTEGER) AS while_set,
CAST(strpos(p_name, 're') - 1 AS INTEGER) AS found, p_name LIKE '%e' AS ends, len(string_split_regex(p_name, '[ e]')) AS parts FROM part"""
)
def spans(spark, sf_dir):
    n = F.col("p_name")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", text.span_until(n, " e").alias("until"), text.span_while(n, "abcdefghijkl").alias("while_set"), text.find_first(n, F.lit("re")).alias("found"), text.ends_with(n, "e").alias("ends"),
        F.size(text.split_on(n, " e")).cast("long").alias("parts"),
    )


@query(
    """WITH p AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part)
SELECT p_partkey, CAST(coalesce(list_min(list_filter(range(0, least(length(a), length(b))), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1))), least(length(a), length(b))) AS INTEGER) AS n FROM p"""
)
def memdiff(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.common_prefix(F.col("p_name"), F.col("p_type")).alias("n"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, 7), lambda i: CASE WHEN i <= length(p_name) THEN hex(p_name[i]) ELSE '*' END), ' ') AS bases, CAST(p_size AS INTEGER) AS byte FROM part")
def hex_dump(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.head_hex(F.col("p_name"), 6).alias("bases"), text.hex_byte(F.lpad(F.hex(F.col("p_size")), 2, "0")).alias("byte"))


@query("SELECT l_suppkey, round(max(p) + log10(sum(pow(10, p - m))), 6) AS log10_sum FROM (SELECT l_suppkey, -l_quantity AS p, max(-l_quantity) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) GROUP BY l_suppkey")
def logsum(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", (-F.col("l_quantity")).cast("double").alias("p"))
    return tables.log10_total(rows, ["l_suppkey"], "p").select("l_suppkey", F.round("log10_sum", 6).alias("log10_sum"))


@query("SELECT p_partkey, round(lgamma(p_size + 0.5), 6) AS value FROM part")
def loggamma(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(text.log_gamma(F.col("p_size") + F.lit(0.5)), 6).alias("value"))


@query(
    """SELECT user_id, score, place FROM (SELECT user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC) AS place
FROM (SELECT DISTINCT user_id, CAST(event_id % 13 AS BIGINT) AS score FROM events WHERE event_id % 13 >= 4)) WHERE place <= 3"""
)
def top_scores(spark, sf_dir):
    return tables.distinct_best(_t(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 13).alias("score")), "user_id", "score", 3, 4)


@query("SELECT regexp_extract(c_name, '^[^#]*') || c_custkey AS key, c_mktsegment AS rest FROM customer")
def keyed_lines(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    line = F.concat(F.regexp_extract("c_name", "^[^#]*", 0), F.col("c_custkey").cast("string"), F.lit("\t"), F.col("c_mktsegment"))
    rows = tsv.keyed_lines(c.select(F.explode(F.array(line, F.lit("  "))).alias("value")))
    return rows.select("key", F.split_part("line", F.lit("\t"), F.lit(2)).alias("rest"))


@query("SELECT 'P' || (o_custkey) AS protein, arg_max(o_orderpriority, o_orderkey) AS transcript, arg_max('G' || o_orderstatus, o_orderkey) AS gene FROM orders GROUP BY o_custkey")
def variant_ids(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    cells = F.array(F.concat(F.lit("P"), F.col("o_custkey").cast("string"), F.lit(".2")), F.concat("o_orderpriority", F.lit(".1")), F.concat(F.lit("G"), F.col("o_orderstatus"), F.lit(".12.3")))
    return tsv.variant_ids(o.select(F.col("o_orderkey").alias("ord"), cells.alias("cells")))


# --- alignment and graphs -----------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("a"), F.col("p_brand").alias("b"))


@query("SELECT p_partkey AS pair_id, CAST(-levenshtein(p_name, p_brand) AS DOUBLE) AS score FROM part")
def align_global_unit(spark, sf_dir):
    return al.align(_pairs(spark, sf_dir))


@query()
def align_local(spark, sf_dir):
    return al.align(_pairs(spark, sf_dir), al.Cost(2, -1, -3, -1, 0), al.LOCAL, 1)


@query()
def align_semi(spark, sf_dir):
    return al.align(_pairs(spark, sf_dir), al.Cost(2, -1, -3, -1, 0), al.SEMI, 3)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 10).alias("graph_id"), (F.col("l_partkey") % 1000).alias("src"), (F.col("l_partkey") % 1000 + F.col("l_linenumber")).alias("dst"))


_EDGES = "e AS (SELECT DISTINCT l_suppkey % 10 AS graph_id, l_partkey % 1000 AS src, l_partkey % 1000 + l_linenumber AS dst FROM lineitem)"


@query(f"WITH {_EDGES} SELECT * FROM e UNION ALL SELECT graph_id, dst, dst FROM (SELECT DISTINCT graph_id, dst FROM e) t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = t.graph_id AND e.src = t.dst)")
def graph_flatten(spark, sf_dir):
    return graphs.flatten(_edges(spark, sf_dir))


@query(
    f"""WITH {_EDGES}, b AS (SELECT graph_id, src AS node, dst AS t FROM e UNION SELECT graph_id, dst, src FROM e),
s AS (SELECT DISTINCT graph_id, CAST(500 AS BIGINT) AS node FROM e),
h1 AS (SELECT s.graph_id, t AS node FROM s JOIN b USING (graph_id, node)),
h2 AS (SELECT h1.graph_id, t AS node FROM h1 JOIN b USING (graph_id, node)),
a AS (SELECT *, 0 AS d FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)
SELECT graph_id, node, CAST(min(d) AS BIGINT) AS distance FROM a GROUP BY 1, 2"""
)
def graph_neighbourhood(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graphs.neighbourhood(edges, edges.select("graph_id", F.lit(500).cast("long").alias("node")), 2)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey % 100 AS graph_id, o_orderkey % 8 AS src, o_orderkey % 8 + 1 + o_orderkey % 3 AS dst FROM orders),
walk(graph_id, node, layer) AS (SELECT graph_id, src, CAST(0 AS BIGINT) FROM e UNION SELECT w.graph_id, e.dst, w.layer + 1 FROM walk w JOIN e ON e.graph_id = w.graph_id AND e.src = w.node)
SELECT graph_id, node, max(layer) AS layer FROM walk GROUP BY 1, 2"""
)
def graph_layers(spark, sf_dir):
    n = F.col("o_orderkey")
    edges = _t(spark, sf_dir, "orders").select((n % 100).alias("graph_id"), (n % 8).alias("src"), (n % 8 + 1 + n % 3).alias("dst")).distinct()
    return graphs.topological_layers(edges)
