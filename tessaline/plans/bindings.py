"""The engine's operators bound to the driver's tables, each with SQL for DuckDB where SQL can express it.

Every query runs over whole tables. Where a row number decides, its order ends in all columns, since (l_orderkey, l_linenumber) is
not unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import text as T
from ..operators import alignments as A
from ..operators import clusters as C
from ..operators import structures as X
from ..operators import taxonomy as N
from ..operators.graph import connected_components
from ..sources.sequences import chunk_sequences, multimerise
from ..sources.structures import dali_statistics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def bind(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ALN = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


@bind("SELECT l_orderkey, l_partkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.04 AND 0.08")
def aln_filter_range(spark, sf):
    """FLT-1."""
    return A.range_filter(read(spark, sf, "lineitem"), "l_discount", 0.04, 0.08).select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")


@bind("SELECT l_orderkey, l_tax FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'nan'::DOUBLE ELSE l_tax END AS l_tax FROM lineitem) WHERE NOT isnan(l_tax) AND l_tax BETWEEN 0.02 AND 0.05")
def aln_filter_drop_nan(spark, sf):
    """FLT-2."""
    rows = read(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"))
    return A.range_filter(rows, "l_tax", 0.02, 0.05, keep_nan=False)


@bind("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 100 <> l_suppkey % 100")
def without_self_hits(spark, sf):
    """FLT-3."""
    rows = read(spark, sf, "lineitem").withColumns({"q": F.col("l_partkey") % 100, "t": F.col("l_suppkey") % 100})
    return A.without_self_hits(rows, "q", "t").select("l_orderkey", "l_partkey", "l_suppkey")


@bind(f"SELECT {', '.join(ALN)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {', '.join(ALL)}) <= 3")
def aln_top_n(spark, sf):
    """WIN-1."""
    return A.top_n(read(spark, sf, "lineitem"), 3, "l_orderkey", "l_extendedprice", ALL).select(*ALN)


@bind(f"SELECT {', '.join(ALN)} FROM lineitem WHERE l_discount BETWEEN 0.04 AND 0.08 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {', '.join(ALL)}) <= 2")
def aln_filter_top_n(spark, sf):
    """FLT-1 and WIN-1."""
    return A.top_n(A.range_filter(read(spark, sf, "lineitem"), "l_discount", 0.04, 0.08), 2, "l_orderkey", "l_extendedprice", ALL).select(*ALN)


KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@bind(f"SELECT {', '.join(KEY)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(concat_ws('|', '42', {', '.join(KEY)})), {', '.join(KEY)}) <= 2")
def aln_sample_hash(spark, sf):
    """WIN-2."""
    return A.sample_n(read(spark, sf, "lineitem"), 2, "l_orderkey", KEY).select(*KEY)


@bind("""
SELECT l_orderkey, l_partkey, l_returnflag, '' AS l_linestatus, 'first' AS source FROM lineitem WHERE l_linenumber <= 2
UNION ALL SELECT l_orderkey, l_partkey, '', l_linestatus, 'second' FROM lineitem WHERE l_linenumber >= 2
""")
def aln_merge_source(spark, sf):
    """SET-1, SET-2, PRJ-1."""
    rows = read(spark, sf, "lineitem")
    one = rows.where("l_linenumber <= 2").select("l_orderkey", "l_partkey", "l_returnflag")
    two = rows.where("l_linenumber >= 2").select("l_orderkey", "l_partkey", "l_linestatus")
    return A.merge(one, two, "first", "second")


@bind("SELECT l_orderkey, l_linenumber, l_partkey, p_name AS part_name, p_brand AS part_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def aln_add_lookup(spark, sf):
    """JN-1."""
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return A.add_lookup(rows, read(spark, sf, "part"), F.col("l_partkey"), "p_partkey", {"p_name": "part_name", "p_brand": "part_brand"})


@bind("SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount < 0.02 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)")
def cache_anti_join(spark, sf):
    """JN-14, JN-15, SET-3."""
    rows = read(spark, sf, "lineitem")
    return rows.where("l_discount < 0.02").select("l_partkey").distinct().join(rows.where("l_discount > 0.08").select("l_partkey"), "l_partkey", "left_anti")


@bind("""
WITH a AS (SELECT 'n' || c_nationkey AS outer_rep, 'c' || c_custkey AS struc_rep FROM customer),
b AS (SELECT 'c' || o_custkey AS struc_rep, 'o' || o_orderkey AS member FROM orders)
SELECT coalesce(a.outer_rep, b.struc_rep) AS outer_rep, coalesce(a.struc_rep, b.struc_rep) AS struc_rep, coalesce(b.member, 'X') AS member
FROM a FULL JOIN b ON a.struc_rep = b.struc_rep
""")
def merge_clusters(spark, sf):
    """JN-2."""
    one = read(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("outer_rep"), F.concat(F.lit("c"), "c_custkey").alias("struc_rep"), F.col("c_custkey").alias("ordinal"))
    two = read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("struc_rep"), F.concat(F.lit("o"), "o_orderkey").alias("member"))
    return C.merge_cluster_tables(one, two)


NAMES = ["", ".pdb", ".pdb.gz", ".FASTA", ".fasta.pdb", ".pdb.fasta", ".cif", ".ent"]


@bind(f"""
WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || ({NAMES!r})[(p_partkey % 8 + 1)::INT] AS name FROM part)
SELECT p_partkey, {"regexp_replace(" * len(T.FILE_SUFFIXES)}name{"".join(f", '{s.replace('.', chr(92) + '.')}$', '', 'i')" for s in T.FILE_SUFFIXES)} AS stem,
  regexp_replace(name, '\\.(pdb|cif|mmcif|ent)$', '', 'i') AS structure FROM n
""")
def strip_suffix(spark, sf):
    """STR-3, STR-5."""
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return read(spark, sf, "part").select("p_partkey", T.remove_file_suffix(name).alias("stem"), T.strip_structure_suffix(name).alias("structure"))


@bind("SELECT c_custkey, CASE WHEN contains(n, '-') THEN split_part(n, '-', 2) ELSE n END AS accession FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'AF-' || c_custkey || '-F1-model_v2.pdb' ELSE 'Q' || c_custkey END AS n FROM customer)")
def accession_token(spark, sf):
    """STR-8."""
    n = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("AF-"), "c_custkey", F.lit("-F1-model_v2.pdb"))).otherwise(F.concat(F.lit("Q"), "c_custkey"))
    return read(spark, sf, "customer").select("c_custkey", T.accession_of(n).alias("accession"))


@bind("""
SELECT o_orderkey, split_part(split_part(o_orderpriority || '__' || o_custkey || '_v2', '__', 2), '_', 1) AS cluster_taxid,
  CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR ELSE split_part(o_orderpriority || '__' || o_custkey || '_v2', '__', 2) END AS alignment_taxid,
  translate(o_orderpriority, ':;_\\/?{}[]*!#+ ', '---------------') AS clean, lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS padded FROM orders
""")
def name_tokens(spark, sf):
    """STR-6, STR-7, STR-9, STR-10."""
    name = F.concat("o_orderpriority", F.lit("__"), "o_custkey", F.lit("_v2"))
    given = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise("")
    return read(spark, sf, "orders").select("o_orderkey", T.cluster_taxid(name).alias("cluster_taxid"), T.alignment_taxid(name, given).alias("alignment_taxid"), T.remove_bad_characters(F.col("o_orderpriority")).alias("clean"), T.pad_to_five_digits(F.col("o_orderkey") % 100000).alias("padded"))


@bind("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT || 'M' || l_linenumber || 'I' || l_suppkey % 9 || 'M' AS cigar, (l_partkey % 90) AS qlen, (l_suppkey % 70) AS tlen FROM lineitem),
m AS (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)M', 1), lambda x: x::BIGINT)), 0) AS n FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, cigar, CASE WHEN qlen > 0 THEN n / qlen ELSE 0.0 END::DOUBLE AS cigar_qcov, CASE WHEN tlen > 0 THEN n / tlen ELSE 0.0 END::DOUBLE AS cigar_tcov FROM m
""")
def cigar_cov(spark, sf):
    """STR-1, STR-2, PRJ-2."""
    cigar = F.concat(F.col("l_quantity").cast("int"), F.lit("M"), "l_linenumber", F.lit("I"), (F.col("l_suppkey") % 9).cast("string"), F.lit("M"))
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cigar.alias("cigar"), (F.col("l_partkey") % 90).alias("qlen"), (F.col("l_suppkey") % 70).alias("tlen"))
    return A.add_cigar_coverage(rows).drop("qlen", "tlen")


@bind("""
WITH f AS (SELECT DISTINCT l_partkey AS c, n_name AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT f, count(*) AS n FROM f GROUP BY f), p AS (SELECT x.f AS f1, y.f AS f2, count(*) AS n FROM f x JOIN f y ON x.c = y.c AND x.f < y.f GROUP BY ALL)
SELECT f1, f2, p.n AS count, a.n AS f1_total, b.n AS f2_total, p.n / (a.n + b.n - p.n)::DOUBLE AS jaccard FROM p JOIN t a ON a.f = f1 JOIN t b ON b.f = f2
""")
def connection_map(spark, sf):
    """JN-8, AGG-4."""
    nation = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = read(spark, sf, "lineitem").join(nation, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("cluster_rep"), F.col("n_name").alias("family"))
    return C.connection_map(rows)


NODES_SQL = """
nodes AS (SELECT 'root' AS taxid, NULL AS parent, 'no rank' AS rank, 'life' AS name
  UNION ALL SELECT 'r' || r_regionkey, 'root', 'superkingdom', r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'family', n_name FROM nation
  UNION ALL SELECT c_custkey::VARCHAR, 'n' || c_nationkey, 'species', c_mktsegment || ' ' || c_custkey FROM customer
  UNION ALL SELECT 's' || c_custkey, c_custkey::VARCHAR, 'strain', 'strain ' || c_custkey FROM customer WHERE c_custkey % 4 = 0)
"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A taxonomy of regions, nations, customers and strains."""
    row = lambda t, i, p, r, n: t.select(i.cast("string").alias("taxid"), p.cast("string").alias("parent"), F.lit(r).alias("rank"), n.alias("name"))
    c, lit = F.col, F.lit
    cust = read(spark, sf, "customer")
    out = row(spark.range(1), lit("root"), lit(None), "no rank", lit("life"))
    out = out.unionByName(row(read(spark, sf, "region"), F.concat(lit("r"), "r_regionkey"), lit("root"), "superkingdom", c("r_name")))
    out = out.unionByName(row(read(spark, sf, "nation"), F.concat(lit("n"), "n_nationkey"), F.concat(lit("r"), "n_regionkey"), "family", c("n_name")))
    out = out.unionByName(row(cust, c("c_custkey"), F.concat(lit("n"), "c_nationkey"), "species", F.concat_ws(" ", "c_mktsegment", "c_custkey")))
    return out.unionByName(row(cust.where("c_custkey % 4 = 0"), F.concat(lit("s"), "c_custkey"), c("c_custkey"), "strain", F.concat_ws(" ", lit("strain"), "c_custkey")))


@bind(f"""
WITH RECURSIVE {NODES_SQL}, up AS (SELECT taxid, name AS path, 1 AS depth FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.taxid, up.path || '>' || n.name, depth + 1 FROM nodes n JOIN up ON n.parent = up.taxid)
SELECT taxid, path, depth::INT AS depth FROM up
""")
def lineage_recursive(spark, sf):
    """TAX-3."""
    return N.lineages(nodes(spark, sf)).select("taxid", F.array_join(F.transform("lineage", lambda x: x["name"]), ">").alias("path"), F.size("lineage").alias("depth"))


@bind(f"""
WITH RECURSIVE {NODES_SQL}, up AS (SELECT taxid AS leaf, taxid, parent, rank, name, 0 AS d FROM nodes UNION ALL SELECT leaf, n.taxid, n.parent, n.rank, n.name, d + 1 FROM up JOIN nodes n ON up.parent = n.taxid)
SELECT leaf AS taxid, coalesce(max(name) FILTER (rank = 'superkingdom'), '') AS superkingdom, coalesce(max(name) FILTER (rank = 'family'), '') AS family,
  CASE WHEN count(*) FILTER (rank = 'species') > 0 THEN max(name) FILTER (d = 0) ELSE '' END AS species FROM up GROUP BY leaf
""")
def canonical_lineages(spark, sf):
    """TAX-4, TAX-5, TAX-2: a table of taxon ids with its ranks."""
    n = nodes(spark, sf)
    return N.add_taxonomy(n.select("taxid"), N.lineages(n), levels=("superkingdom", "family", "species"))


@bind(f"""
WITH {NODES_SQL}, k AS (SELECT name, min(taxid) AS t FROM nodes GROUP BY name),
q AS (SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' 12' ELSE '?' || n_name END AS name FROM nation)
SELECT id, q.name, coalesce(a.t, b.t, 'X') AS taxid_of_name FROM q LEFT JOIN k a ON q.name = a.name LEFT JOIN k b ON regexp_replace(q.name, '[\\d ]+$', '') = b.name
""")
def taxid_of_name(spark, sf):
    """TAX-1."""
    kind = F.col("n_nationkey") % 3
    q = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat("n_name", F.lit(" 12"))).otherwise(F.concat(F.lit("?"), "n_name")).alias("name"))
    return N.name_to_taxid(q, nodes(spark, sf))


@bind("""
WITH own AS (SELECT DISTINCT l_suppkey AS c, o_custkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT c, r_name AS superkingdom, unnest([{'level': 'superkingdom', 'taxon': r_name}, {'level': 'family', 'taxon': n_name}, {'level': 'species', 'taxon': c_mktsegment}], recursive := true)
      FROM own JOIN customer ON t = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c AS cluster_rep, max(superkingdom) AS superkingdom, level, taxon, count(*) AS count FROM x GROUP BY c, level, taxon
""")
def taxa_counts(spark, sf):
    """AGG-2, AGG-3, JN-5, JN-6: taxa by level for each cluster."""
    names = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = names.select(F.col("c_custkey").cast("string").alias("taxid"), F.col("r_name").alias("superkingdom"), F.col("n_name").alias("family"), F.col("c_mktsegment").alias("species"))
    own = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("cluster_rep"), F.col("o_custkey").alias("taxid"))
    return N.lineage_counts(own, names, ["cluster_rep"], ("superkingdom", "family", "species"))


@bind("""
SELECT l_suppkey AS cluster_rep, l_orderkey, n AS cluster_count, dense_rank() OVER (ORDER BY n DESC, m DESC)::BIGINT AS "cluster_ID"
FROM (SELECT l_suppkey, l_orderkey, count(*) OVER (PARTITION BY l_suppkey) AS n, min(l_suppkey) OVER (PARTITION BY l_suppkey) AS m FROM lineitem)
""")
def cluster_rank(spark, sf):
    """WIN-4."""
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster_rep"), "l_orderkey", F.col("l_suppkey").alias("ordinal"))
    return C.rank_clusters(rows).select("cluster_rep", "l_orderkey", "cluster_count", "cluster_ID")


@bind("""
WITH i AS (SELECT l_suppkey AS query, l_linenumber AS s, l_linenumber + l_quantity::BIGINT % 10 AS e FROM lineitem),
c AS (SELECT query, unnest(range(s, e + 1)) AS position FROM i), n AS (SELECT query, position, count(*) AS k FROM c GROUP BY ALL)
SELECT q.query, p.position, coalesce(k, 0)::BIGINT AS coverage FROM (SELECT DISTINCT query FROM i) q CROSS JOIN (SELECT unnest(range(1, 21)) AS position) p LEFT JOIN n ON n.query = q.query AND n.position = p.position
""")
def position_coverage(spark, sf):
    """AGG-9."""
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_linenumber").cast("long").alias("qstart"), (F.col("l_linenumber") + F.col("l_quantity").cast("long") % 10).alias("qend"), F.lit(20).alias("qlen"))
    return A.position_coverage(rows, ["query"])


@bind("""
WITH i AS (SELECT l_suppkey AS query, l_linenumber AS s, l_linenumber + l_quantity::BIGINT % 10 AS e, 1 / (0.5 + l_discount) AS w FROM lineitem),
n AS (SELECT query, position, sum(w) AS k FROM (SELECT query, w, unnest(range(s, e + 1)) AS position FROM i) GROUP BY ALL)
SELECT q.query, p.position, round(coalesce(k, 0), 4) AS coverage FROM (SELECT DISTINCT query FROM i) q CROSS JOIN (SELECT unnest(range(1, 21)) AS position) p LEFT JOIN n ON n.query = q.query AND n.position = p.position
""")
def scaled_coverage(spark, sf):
    """AGG-10."""
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_linenumber").cast("long").alias("qstart"), (F.col("l_linenumber") + F.col("l_quantity").cast("long") % 10).alias("qend"), F.lit(20).alias("qlen"), (F.col("l_discount") + 0.5).alias("fident"))
    return A.scaled_coverage(rows, ["query"]).withColumn("coverage", F.abs(F.round("coverage", 4)))


@bind("""
WITH i AS (SELECT l_partkey AS target, l_linenumber AS s, l_linenumber + l_quantity::BIGINT % 40 AS e, l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber AS o FROM lineitem),
b AS (SELECT target, s AS tstart, e AS tend, e - s + 1 AS n FROM i QUALIFY row_number() OVER (PARTITION BY target ORDER BY e - s DESC, o, s, e) = 1)
SELECT target AS id, substring(text, tstart::BIGINT, n) AS seq FROM b JOIN documents ON doc_id = target WHERE length(text) >= tend
""")
def arg_extreme_trim(spark, sf):
    """AGG-11, JN-3, SEQ-8."""
    order = F.struct((F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("o"), F.col("l_linenumber").alias("s"), F.col("l_quantity").alias("q"))
    rows = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("tstart"), (F.col("l_linenumber") + F.col("l_quantity").cast("long") % 40).alias("tend"), order.alias("ordinal"))
    best = A.extreme_alignments(rows, shortest=False)
    seqs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))
    fit = best.join(seqs.select(F.col("id").alias("target"), F.length("seq").alias("n")), "target").where("n >= tend").drop("n")
    return A.trim_targets(fit, seqs)[0]


def _chunk_sql(step: int, overlap: bool) -> str:
    return f"""
WITH c AS (SELECT doc_id, length(text) AS n, i // {step} AS part, substring(text, i + 1, 200) AS seq FROM (SELECT doc_id, text, unnest(range(0, length(text), {step})) AS i FROM documents WHERE length(text) > 200)),
d AS (SELECT *, lag(seq) OVER w AS before, part = max(part) OVER (PARTITION BY doc_id) AS last FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY part))
SELECT 'PART' || part || '_' || doc_id AS id, seq FROM d WHERE NOT (last AND before IS NOT NULL AND contains(before, seq)) AND length(seq) >= 50
UNION ALL SELECT doc_id::VARCHAR, text FROM documents WHERE length(text) <= 200 AND length(text) >= 50
"""


@bind(_chunk_sql(200, False))
def seq_chunk(spark, sf):
    """SEQ-1, SEQ-2, FLT-8."""
    seqs = read(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq"))
    return chunk_sequences(seqs, 200).select("id", "seq")


@bind(_chunk_sql(100, True))
def seq_chunk_overlap(spark, sf):
    """SEQ-1 with overlap."""
    seqs = read(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq"))
    return chunk_sequences(seqs, 200, overlapping=True).select("id", "seq")


@bind("""
SELECT conv_id, string_agg(text || ':' || text, ':' ORDER BY turn) AS seq, count(*) AS turns FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL GROUP BY conv_id
""")
def multimer(spark, sf):
    """SEQ-3, SEQ-4."""
    rows = read(spark, sf, "conversations").where("conv_id is not null and text is not null")
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"), F.count("*").alias("turns"))
    return packed.select("conv_id", S.multimer(F.col("s.text"), F.transform("s", lambda x: F.lit(2))).alias("seq"), "turns")


@bind("""
WITH d AS (SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u FROM documents),
p AS (SELECT doc_id, unnest(regexp_extract_all(u, 'T[HI][ANERS]')) AS match, unnest(regexp_split_to_array(u, 'T[HI][ANERS]')) AS before, unnest(range(1, len(regexp_split_to_array(u, 'T[HI][ANERS]')) + 1)) AS k FROM d),
s AS (SELECT doc_id, match, (sum(length(before)) OVER (PARTITION BY doc_id ORDER BY k) + 3 * (k - 1) + 1)::INT AS start FROM p)
SELECT doc_id, match, start, start + 2 AS "end" FROM s WHERE match IS NOT NULL
""")
def motif_find(spark, sf):
    """SEQ-6, SEQ-7."""
    docs = read(spark, sf, "documents").select("doc_id", F.explode(S.motif_matches(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "T[HI][ANERS]")).alias("m"))
    return docs.select("doc_id", "m.match", "m.start", "m.end")


@bind("""
WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
o AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM v WHERE value >= 30) GROUP BY user_id, g HAVING count(*) >= 3),
d AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM v WHERE value <= 20) GROUP BY user_id, g HAVING count(*) >= 3),
t AS (SELECT user_id, count(*) AS total FROM v GROUP BY user_id)
SELECT user_id, coalesce(a.n, 0)::BIGINT AS ordered, coalesce(b.n, 0)::BIGINT AS disordered, (total - coalesce(a.n, 0) - coalesce(b.n, 0))::BIGINT AS intermediate, total, coalesce(a.m, 0) >= 8 AS there_is_a_domain
FROM t LEFT JOIN (SELECT user_id, sum(n) AS n, max(n) AS m FROM o GROUP BY user_id) a USING (user_id) LEFT JOIN (SELECT user_id, sum(n) AS n FROM d GROUP BY user_id) b USING (user_id)
""")
def disorder_runs(spark, sf):
    """WIN-6, AGG-8."""
    return X.disorder(read(spark, sf, "events").select("user_id", "ts", "value"), "user_id", "ts", "value", 30, 20, 3, 8)


@bind("SELECT user_id, count(value) AS total, count_if(value >= 50)::BIGINT AS passing, round(count_if(value >= 50) / count(value), 2) AS fraction FROM events GROUP BY user_id")
def qc_fraction(spark, sf):
    """AGG-7."""
    return X.quality(read(spark, sf, "events"), 50, "user_id", "value")


@bind("""
SELECT 'u' || user_id AS file, round(avg(v), 2) AS plddt FROM (SELECT user_id, event_id % 7 AS r, floor(arg_max(value, event_id)) AS v FROM events GROUP BY ALL) GROUP BY user_id
""")
def mean_plddt(spark, sf):
    """AGG-5, AGG-6."""
    e = read(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("file"), F.lit(0).alias("model"), F.col("event_id").cast("string").alias("chain"), (F.col("event_id") % 7).cast("int").alias("resseq"), F.lit("").alias("icode"), F.lit("").alias("hetflag"), F.lit("ALA").alias("resname"), F.col("event_id").alias("atom_ordinal"), F.floor("value").cast("double").alias("bfactor"))
    return X.mean_plddt(e)


@bind("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS resseq FROM events")
def rebase(spark, sf):
    """WIN-5, WIN-7, WIN-9."""
    e = read(spark, sf, "events").select("user_id", F.col("user_id").cast("string").alias("file"), F.lit(0).alias("model"), F.lit("A").alias("chain"), F.col("event_id").cast("int").alias("resseq"), F.lit("").alias("icode"), F.lit("").alias("hetflag"), F.lit("ALA").alias("resname"), F.col("event_id").alias("atom_ordinal"), F.col("value").alias("bfactor"))
    return X.rebase(e).select("user_id", F.col("atom_ordinal").alias("event_id"), "resseq")


@bind("SELECT event_id, event_type FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2)")
def extract_chains(spark, sf):
    """FLT-6."""
    e = read(spark, sf, "events").select("event_id", "event_type")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return X.extract_chains(e, kinds, "event_type")


@bind("""
WITH d AS (SELECT l_partkey % 97 AS g, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::BIGINT AS e, l_orderkey FROM lineitem),
p AS (SELECT s_suppkey AS point, s_suppkey % 97 AS g FROM supplier)
SELECT d.l_orderkey, d.g, s, e, point FROM d JOIN p ON d.g = p.g AND point % 100 BETWEEN s AND e
""")
def domains_range_join(spark, sf):
    """JN-10, FLT-7."""
    d = read(spark, sf, "lineitem").select((F.col("l_partkey") % 97).alias("g"), (F.col("l_linenumber") * 10).cast("long").alias("s"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")).alias("e"), "l_orderkey")
    p = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_suppkey") % 97).alias("g"), (F.col("s_suppkey") % 100).alias("at"))
    return X.range_join(p, d, ["g"], "at", "s", "e", 16).select("l_orderkey", "g", "s", "e", "point")


@bind("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), '') AS iptm FROM events")
def json_iptm(spark, sf):
    """SRC-19, JSN-1."""
    from ..sources.remote import _path

    return read(spark, sf, "events").select("event_id", _path(F.col("props"), "$.missing", "$.k").alias("iptm"))


@bind("""
WITH v AS (SELECT vec_id, label % 2 AS chain, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(0.0 + (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM v a JOIN v b ON a.chain = 0 AND b.chain = 1)
SELECT a, b, round(d, 6) AS distance FROM p WHERE d < 0.08
""")
def contact_pairs(spark, sf):
    """JN-11."""
    v = read(spark, sf, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    pairs = X.near_pairs(v.where("label % 2 = 0").drop("label"), v.where("label % 2 = 1").drop("label"), 0.08)
    return pairs.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round("distance", 6).alias("distance"))


@bind("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(list_sum(e[1:9]) / list_sum(e), 6) AS p FROM e
""")
def contact_probability(spark, sf):
    """AGG-14."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: i.cast("double"))
    return read(spark, sf, "embeddings").select("vec_id", F.round(X.contact_probability(F.col("embedding").cast("array<double>"), edges, 8.0), 6).alias("p"))


@bind("SELECT vec_id // 8 AS file, (vec_id % 8)::INT AS i, (j - 1)::INT AS j, embedding[j] AS value FROM embeddings, unnest(range(1, 65)) t(j)")
def matrix_cells(spark, sf):
    """JN-12, SNK-9: a matrix in long form."""
    rows = read(spark, sf, "embeddings").groupBy(F.expr("vec_id div 8").alias("file")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    return X.matrix_cells(rows.select("file", F.col("s.embedding").alias("m")), "m")


@bind("""
WITH h AS (SELECT l_orderkey % 50 AS query_id, l_partkey % 50 AS target_id, l_quantity AS alnlen, l_linenumber * 8.0 AS tlen, l_tax * 100 AS rmsd, l_discount * 100 AS z, CASE WHEN l_suppkey % 3 = 0 THEN 40.0 END AS given FROM lineitem),
q AS (SELECT *, coalesce(given, CASE WHEN query_id = target_id THEN tlen ELSE 0 END) AS qlen FROM h)
SELECT query_id, target_id, alnlen, qlen::DOUBLE AS qlen, tlen::DOUBLE AS tlen, (alnlen / greatest(qlen, tlen))::DOUBLE AS cov FROM q WHERE alnlen / greatest(qlen, tlen) >= 0.5 AND z >= 3 AND alnlen >= 5 AND rmsd >= 1
""")
def dali_coverage(spark, sf):
    """DALI-1, FLT-4."""
    h = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("query_id"), (F.col("l_partkey") % 50).alias("target_id"), F.col("l_quantity").alias("alnlen"), (F.col("l_linenumber") * 8.0).alias("tlen"), (F.col("l_tax") * 100).alias("rmsd"), (F.col("l_discount") * 100).alias("z"), F.when(F.col("l_suppkey") % 3 == 0, 40.0).alias("given"))
    return dali_statistics(h, 0.5, 3, 5, 1).select("query_id", "target_id", "alnlen", "qlen", "tlen", "cov")


EDGES_SQL = "e AS (SELECT 'o' || l_orderkey AS q, 'p' || l_partkey AS t, l_extendedprice AS s FROM lineitem), b AS (SELECT q AS a, t AS b FROM e UNION SELECT t, q FROM e)"

# every node with the least node that it reaches: a node is visited anew only when its least falls
LEAST_SQL = """r(n, c) USING KEY (n) AS (SELECT a, min(least(a, b)) FROM b GROUP BY a
UNION SELECT b.a, min(r.c) FROM b JOIN r ON b.b = r.n JOIN recurring.r AS own ON own.n = b.a GROUP BY b.a, own.c HAVING min(r.c) < own.c)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("query"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_extendedprice").alias("alntmscore"))


@bind(f"""
WITH RECURSIVE {EDGES_SQL}, {LEAST_SQL}
SELECT n AS node, c AS component FROM r
""")
def components(spark, sf):
    """GRF-1."""
    return connected_components(edges(spark, sf), "query", "target")


@bind(f"""
WITH RECURSIVE {EDGES_SQL}, {LEAST_SQL}
SELECT c AS cluster_rep, n AS cluster_member FROM r
UNION ALL SELECT DISTINCT 'p' || p_partkey, 'p' || p_partkey FROM part WHERE 'p' || p_partkey NOT IN (SELECT a FROM b)
""")
def component_clusters(spark, sf):
    """GRF-1 with all inputs."""
    return C.component_clusters(edges(spark, sf), all_inputs=read(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")))


@bind()
def greedy_cover(spark, sf):
    """GRF-2, GRF-3. A sequential algorithm: tests hold it against brute force."""
    return C.greedy_clusters(edges(spark, sf))


@bind(f"WITH {EDGES_SQL} SELECT least(q, t) AS a, greatest(q, t) AS b, max(s) AS score FROM e GROUP BY ALL")
def best_scores(spark, sf):
    """AGG-16."""
    return C.best_scores(edges(spark, sf))


@bind(f"""
WITH {EDGES_SQL}, m AS (SELECT q AS m FROM e UNION SELECT t FROM e)
SELECT count(*) AS n_pairs, 0::BIGINT AS n_self, count(*) AS n_other, (SELECT count(*) FROM m) AS n_members, 0::BIGINT AS n_only_self FROM e
""")
def graph_diag(spark, sf):
    """AGG-15, AGG-1."""
    return C.graph_diagnostics(edges(spark, sf))


@bind(f"""
WITH {EDGES_SQL} SELECT a AS member, count(*) AS degree FROM b GROUP BY a ORDER BY degree DESC, a LIMIT 10
""")
def graph_top_degrees(spark, sf):
    """AGG-15, SRT-2, SRT-3: the ten hubs, a report."""
    return C.top_degrees(edges(spark, sf))


@bind(f"""
WITH RECURSIVE m AS (SELECT 'c' || o_custkey AS rep, 'o' || o_orderkey AS member FROM orders),
size AS (SELECT rep, count(*) AS n FROM m GROUP BY rep),
h AS (SELECT DISTINCT l_partkey, l_suppkey, 'o' || l_orderkey AS o FROM lineitem),
a AS (SELECT DISTINCT x.o AS q, y.o AS t FROM h x JOIN h y ON x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey AND x.o <> y.o),
link AS (SELECT x.rep AS r1, y.rep AS r2 FROM a JOIN m x ON x.member = q JOIN m y ON y.member = t JOIN size ON size.rep = x.rep WHERE x.rep <> y.rep GROUP BY x.rep, y.rep, size.n HAVING count(DISTINCT q) >= 0.25 * size.n),
b AS (SELECT r1 AS a, r2 AS b FROM link UNION SELECT r2, r1 FROM link UNION SELECT rep, rep FROM size), {LEAST_SQL},
s AS (SELECT c, arg_min(r.n, (-size.n, r.n)) AS super_rep, sum(size.n)::BIGINT AS cluster_count FROM r JOIN size ON size.rep = r.n GROUP BY c),
i AS (SELECT *, row_number() OVER (ORDER BY cluster_count DESC, super_rep)::BIGINT AS id FROM s)
SELECT id AS "cluster_ID", cluster_count, m.rep AS cluster_rep, super_rep, member AS cluster_member FROM m JOIN r ON m.rep = r.n JOIN i USING (c)
""")
def super_clusters(spark, sf):
    """GRF-5, JN-7: customers' orders, aligned where they hold the same part of the same supplier."""
    clusters = read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("cluster_rep"), F.concat(F.lit("o"), "o_orderkey").alias("cluster_member"))
    rows = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.concat(F.lit("o"), "l_orderkey").alias("o")).distinct()
    hits = rows.alias("x").join(rows.alias("y"), ["l_partkey", "l_suppkey"]).where("x.o <> y.o").select(F.col("x.o").alias("query"), F.col("y.o").alias("target"))
    return C.super_clusters(clusters, hits, 0.25)


@bind("""
WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), q AS (SELECT DISTINCT user_id, 2 AS s, 9 AS e FROM v)
SELECT q.user_id AS query, s AS qstart, e AS qend, coalesce(min(i), -1)::INT AS new_qstart, coalesce(max(i), -1)::INT AS new_qend FROM q LEFT JOIN v ON v.user_id = q.user_id AND i BETWEEN s AND e AND value >= 60 GROUP BY ALL
""")
def trim_by_plddt(spark, sf):
    """WIN-8."""
    v = read(spark, sf, "events").select(F.col("user_id").alias("query"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).alias("position"), F.col("value").alias("plddt"))
    out = A.trim_by_plddt(v.select("query", F.lit(2).alias("qstart"), F.lit(9).alias("qend")).distinct(), v, 60.0)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("new_qstart", "new_qend")})


@bind("""
WITH u AS (SELECT item_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS q FROM benchmark), p AS (SELECT item_id, q, substring(q, 3) || substring(q, 1, 2) AS t FROM u),
c AS (SELECT item_id, list_filter(range(1, length(q) + 1), lambda i: regexp_matches(substring(q, i, 1), '^[A-Z]$') AND regexp_matches(substring(t, i, 1), '^[A-Z]$')) AS cols, q, t FROM p)
SELECT item_id, floor(100e0 * len(list_filter(cols, lambda i: substring(q, i, 1) = substring(t, i, 1))) / len(cols) + 0.5e0)::INT AS pident FROM c WHERE len(cols) > 0
""")
def aligned_identity(spark, sf):
    """ALN-1, ALN-3: whole texts against themselves, turned by two characters."""
    q = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    p = read(spark, sf, "benchmark").select("item_id", q.alias("q"), F.concat(F.substr(q, F.lit(3)), F.left(q, F.lit(2))).alias("t"))
    return p.select("item_id", S.percent_identity(F.col("q"), F.col("t")).alias("pident")).where("pident is not null")


@bind("""
WITH d AS (SELECT l_orderkey, l_linenumber || '-' || (l_linenumber + l_quantity::INT % 7) || '_' || (l_linenumber + 20) AS boundary, l_linenumber AS a, l_linenumber + l_quantity::INT % 7 AS b FROM lineitem)
SELECT l_orderkey, boundary, unnest(list_concat(range(a, b + 1), [a + 20]))::INT AS residue FROM d
""")
def domain_residues(spark, sf):
    """JSN-4."""
    a, b = F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity").cast("int") % 7
    d = read(spark, sf, "lineitem").select("l_orderkey", F.concat(a.cast("string"), F.lit("-"), b.cast("string"), F.lit("_"), (a + 20).cast("string")).alias("boundary"))
    return d.select("l_orderkey", "boundary", F.explode(S.range_residues(F.col("boundary"))).alias("residue"))


@bind("SELECT n_name AS name, upper(substring(n_name, 1, 1)) AS letter FROM nation ORDER BY n_name")
def sorted_names(spark, sf):
    """SRT-1, SRT-4."""
    return read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.upper(F.substring("n_name", 1, 1)).alias("letter")).orderBy("name")
