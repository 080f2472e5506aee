"""Alignment, cluster, taxonomy and structure operators on small tables."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessaline.operators import alignments as A
from tessaline.operators import clusters as C
from tessaline.operators import structures as X
from tessaline.operators import taxonomy as N

from .test_graph import brute as components


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_range_filter(spark):
    df = spark.createDataFrame([("a", "0.5"), ("b", "1.01"), ("c", "nan"), ("d", "0.4")], "query string, alntmscore string")
    assert [r[0] for r in rows(A.range_filter(df))] == ["a", "c", "d"] and [r[0] for r in rows(A.range_filter(df, keep_nan=False))] == ["a", "d"]
    with pytest.raises(ValueError):
        A.range_filter(df, low=2, high=1)
    with pytest.raises(PySparkException):
        A.range_filter(df.unionByName(spark.createDataFrame([("e", "x")], df.schema)), strict=True).collect()


def test_top_and_sample(spark):
    df = spark.createDataFrame([(q, i, float(i % 3), i) for q in "ab" for i in range(7)], "query string, target int, s double, ordinal int")
    assert rows(A.top_n(df, 3, "query", "s").select("query", "target")) == [(q, t) for q in "ab" for t in (1, 2, 5)]
    one, two = rows(A.sample_n(df, 3, "query", ["target"])), rows(A.sample_n(df.repartition(5), 3, "query", ["target"]))
    assert one == two and len(one) == 6 and rows(A.sample_n(df, 3, "query", ["target"], seed=1)) != one
    assert A.top_n(df, 0).count() == 14


def test_merge_and_insert(spark):
    a, b = spark.createDataFrame([("q", "1", "x")], "query string, s string, a string"), spark.createDataFrame([("r", "y", "2")], "query string, b string, s string")
    out = A.merge(a, b, "f", "g")
    assert out.columns == ["query", "s", "source", "a", "b"] and rows(out) == [("q", "1", "f", "x", ""), ("r", "2", "g", "", "y")]
    assert A.insert_after(a, "query", {"n": F.lit(1)}).columns == ["query", "n", "s", "a"]
    assert A.same_rows(a, a.select("a", "s", "query")) and not A.same_rows(a, a.union(a))


def test_lookup(spark):
    df = spark.createDataFrame([("AF-P1-F1",), ("P2",)], "target string")
    names = spark.createDataFrame([("P1", "g", "full"), ("P2", "", "other")], "accession string, geneName string, fullName string")
    assert rows(A.add_uniprot(df, names)) == [("AF-P1-F1", "P1", "g", "full"), ("P2", "P2", "", "other")]
    with pytest.raises(PySparkException):
        A.add_uniprot(df, names.where("accession = 'P1'")).collect()


def test_coverage_sweep(spark):
    rng = random.Random(1)
    data = []
    for q in "abc":
        n = rng.randrange(5, 30)
        data += [(q, s, rng.randrange(s, n + 1), n, rng.choice([0.25, 0.5, 1.0])) for s in (rng.randrange(1, n + 1) for _ in range(8))]
    df = spark.createDataFrame(data, "query string, qstart int, qend int, qlen int, fident double")
    want = {(q, p): (0, 0.0) for q, _, _, n, _ in data for p in range(1, n + 1)}
    for q, s, e, _, f in data:
        for p in range(s, e + 1):
            c, w = want[q, p]
            want[q, p] = c + 1, w + 1 / f
    assert {(r.query, r.position): r.coverage for r in A.position_coverage(df, ["query"]).collect()} == {k: v[0] for k, v in want.items()}
    got = {(r.query, r.position): r.coverage for r in A.scaled_coverage(df, ["query"]).collect()}
    assert got == pytest.approx({k: v[1] for k, v in want.items()})
    with pytest.raises(PySparkException):
        A.position_coverage(df.withColumn("qlen", F.lit(1)), ["query"]).collect()


def test_extremes_and_trim(spark):
    df = spark.createDataFrame([("t", 1, 5, 0), ("t", 3, 7, 1), ("t", 2, 3, 2), ("u", 1, 2, 3)], "target string, tstart int, tend int, ordinal int")
    assert rows(A.extreme_alignments(df, shortest=False)) == [("t", 1, 5, 5), ("u", 1, 2, 2)]
    best = A.extreme_alignments(df)
    assert rows(best) == [("t", 2, 3, 2), ("u", 1, 2, 2)]
    cut, lost = A.trim_targets(best, spark.createDataFrame([("t", "ABCDEFG")], "id string, seq string"))
    assert rows(cut) == [("t", "BC")] and rows(lost) == [("u",)]


def test_trim_by_plddt(spark):
    iv = spark.createDataFrame([("q", 2, 6), ("r", 1, 3), ("q", 2, 6)], "query string, qstart int, qend int")
    p = spark.createDataFrame([("q", i, v) for i, v in enumerate([90, 10, 80, 20, 70, 30], 1)] + [("r", i, 5) for i in (1, 2, 3)], "query string, position int, plddt int")
    assert rows(A.trim_by_plddt(iv, p, 60)) == [("q", 2, 6, 3, 5), ("q", 2, 6, 3, 5), ("r", 1, 3, None, None)]


def brute_cover(pairs):
    near, left, rep = {}, set(), {}
    for a, b in pairs:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    left = set(near)
    while left:
        best = min(left, key=lambda m: (-len(near[m] & left), m))
        for c in near[best] & left:
            rep[c] = best
        left -= near[best]
    return rep


@pytest.mark.parametrize("seed", range(3))
def test_greedy_cover(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}", rng.random()) for _ in range(30)]
    df = spark.createDataFrame(pairs, "query string, target string, alntmscore double")
    for task_pairs in (2_000_000, 0):  # covered in tasks, and by joins alone
        got = [(r.cluster_member, r.cluster_rep) for r in C.greedy_clusters(df, reassign=False, task_pairs=task_pairs).collect()]
        assert sorted(got) == sorted(brute_cover([(a, b) for a, b, _ in pairs]).items())


def test_greedy_cover_by_parts(spark):
    """Small components share tasks, middling ones have their own and larger ones shrink by joins first; names are of any type."""
    rng = random.Random(5)
    pairs = [(100 * k + rng.randrange(size), 100 * k + rng.randrange(size)) for k, size in enumerate([2, 3, 4, 5, 9, 14]) for _ in range(2 * size)]
    df = spark.createDataFrame([*((a, b, 1.0) for a, b in pairs), (7, None, 1.0)], "query int, target int, alntmscore double")
    got = C.greedy_clusters(df, reassign=False, task_pairs=16)
    assert got.columns == ["cluster_rep", "cluster_member"] and [t for _, t in got.dtypes] == ["int", "int"]
    assert sorted((r.cluster_member, r.cluster_rep) for r in got.collect()) == sorted(({7: 7} | brute_cover(pairs)).items())


def test_greedy_cover_needs_no_components_where_a_task_holds_all(spark, monkeypatch):
    """Rounds of components over millions of pairs took most of the time."""
    monkeypatch.setattr(C, "connected_components", lambda *_: pytest.fail("components"))
    pairs = [("a", "b"), ("b", "c"), ("d", "e"), ("f", "f")]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "query string, target string, alntmscore double")
    assert {r.cluster_member: r.cluster_rep for r in C.greedy_clusters(df).collect()} == brute_cover(pairs)


@pytest.mark.parametrize("task_names", [100, 0])
def test_greedy_cover_deals_whole_components(spark, monkeypatch, task_names):
    """Rounds of components by joins took half of the time over 36,000,000 pairs; only names too many for a task need them."""
    monkeypatch.setattr(C, "ALONE", 4)
    monkeypatch.setattr(C, "SHARE", 5)
    monkeypatch.setattr(C, "TASK_NAMES", task_names)
    monkeypatch.setattr(C, "connected_components", C.connected_components if not task_names else lambda *_: pytest.fail("components"))
    rng = random.Random(6)
    pairs = [(f"{k}n{rng.randrange(size):02}", f"{k}n{rng.randrange(size):02}") for k, size in enumerate([2, 3, 2, 4, 9, 14, 3]) for _ in range(2 * size)]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "query string, target string, alntmscore double")
    assert {r.cluster_member: r.cluster_rep for r in C.greedy_clusters(df, task_pairs=60).collect()} == brute_cover(pairs)


def batches(pairs, size=7):
    return pa.Table.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, pa.schema([("a", pa.int64()), ("b", pa.int64())])).to_batches(size)


@pytest.mark.parametrize("chunk", [1 << 20, 16])
def test_streamed_pairs(monkeypatch, chunk):
    """Components and cover of pairs that come in many chunks."""
    monkeypatch.setattr(C, "_CHUNK", chunk)
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(299)]
    graphs = [chain, chain[::-1], rng.sample(chain, 299), [], [(0, i) for i in range(1, 300)], [(i, 299) for i in range(299)]]
    graphs += [sorted({(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(n)) if a < b}) for n in (20, 150, 300, 900)]
    for pairs in graphs:
        got = pa.Table.from_batches(C.cover_pairs(batches(pairs)), pa.schema([("cluster_rep", pa.int64()), ("cluster_member", pa.int64())])).to_pylist()
        assert {r["cluster_member"]: r["cluster_rep"] for r in got} == brute_cover(pairs)
        comp = components(pairs)
        for share, most in ((5, 100), (50, 50), (0, 0), (1000, 1000)):
            bins = {a: k for part in C.bin_pairs(batches(pairs), 300, share, most) for a, k in zip(*part.to_pydict().values(), strict=True)}
            assert bins.keys() == {a for a, _ in pairs}
            size, held, where = Counter(comp[a] for a, _ in pairs), {}, {}
            for a, k in bins.items():
                where.setdefault(comp[a], set()).add(k)
            for c, ks in where.items():
                assert len(ks) == 1 and (ks == {-1}) == (size[c] > most)
                held.setdefault(*ks, []).append(size[c])
            held.pop(-1, None)
            assert sorted(held) == list(range(len(held))) and all(len(v) == 1 or sum(v) < 2 * share for v in held.values())


def test_cover_function_on_large_random_graphs():
    rng = random.Random(9)
    for _ in range(300):
        pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(1, 60))]
        near = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        near = {k: [x for x in v if x != k] for k, v in near.items()}
        assert C.cover(list(near), near) == brute_cover(pairs)


def test_reassign(spark):
    clusters = spark.createDataFrame([("a", "a"), ("a", "m"), ("a", "k"), ("b", "b"), ("a", "z"), ("c", "c")], "cluster_rep string, cluster_member string")
    scores = spark.createDataFrame([("a", "m", 0.5), ("b", "m", 0.9), ("a", "k", 0.7), ("b", "k", 0.7), ("a", "z", -1.0)], "a string, b string, score double")
    got = {r.cluster_member: r.cluster_rep for r in C.reassign_members(clusters, scores).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "m": "b", "k": "a", "z": "b"}


def test_reassign_negative_prefers_unconnected(spark):
    clusters = spark.createDataFrame([("b", "b"), ("b", "z"), ("a", "a")], "cluster_rep string, cluster_member string")
    scores = spark.createDataFrame([("b", "z", -1.0)], "a string, b string, score double")
    assert {r.cluster_member: r.cluster_rep for r in C.reassign_members(clusters, scores).collect()} == {"a": "a", "b": "b", "z": "a"}


def test_components_and_diagnostics(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d"), ("a", "a")], "query string, target string")
    assert rows(C.component_clusters(df, all_inputs=spark.createDataFrame([("a",), ("e",)], "id string"))) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("e", "e")]
    assert rows(C.graph_diagnostics(df)) == [(4, 2, 2, 4, 1)] and rows(C.top_degrees(df))[1] == ("b", 2)


def test_merge_clusters(spark):
    one = spark.createDataFrame([("L1", "S1", 0), ("L1", "S2", 1), ("L2", "S9", 2)], "lol_rep string, struc_rep string, ordinal int")
    two = spark.createDataFrame([("S1", "m1"), ("S1", "m2"), ("S2", "m3"), ("S5", "m4")], "struc_rep string, member string")
    assert rows(C.merge_cluster_tables(one, two)) == [("L1", "S1", "m1"), ("L1", "S1", "m2"), ("L1", "S2", "m3"), ("L2", "S9", "X"), ("S5", "S5", "m4")]
    bad = one.unionByName(spark.createDataFrame([("L3", "S1", 3)], one.schema))
    with pytest.raises(PySparkException):
        C.merge_cluster_tables(bad, two).collect()


def test_rank_and_connections(spark):
    df = spark.createDataFrame([("a", "m1", "f", 0), ("a", "m2", "g", 1), ("b", "m3", "f", 2), ("b", "m4", "", 3), ("c", "m5", "g", 4), ("c", "m6", "f", 5), ("c", "m7", "f", 6)], "cluster_rep string, cluster_member string, family string, ordinal int")
    ids = {r.cluster_rep: (r.cluster_ID, r.cluster_count) for r in C.rank_clusters(df).collect()}
    assert ids == {"c": (1, 3), "b": (2, 2), "a": (3, 2)}
    assert rows(C.connection_map(df)) == [("f", "g", 2, 3, 2, 2 / 3)]


def test_super_clusters(spark):
    clusters = spark.createDataFrame([("a", "a"), ("a", "a2"), ("b", "b"), ("b", "b2"), ("b", "b3"), ("c", "c")], "cluster_rep string, cluster_member string")
    aln = spark.createDataFrame([("a", "b"), ("b3", "c"), ("a", "a2")], "query string, target string")
    out = {r.cluster_member: (r.cluster_ID, r.super_rep, r.cluster_count) for r in C.super_clusters(clusters, aln, 0.5).collect()}
    assert set(out.values()) == {(1, "b", 6)}
    assert {r.super_rep for r in C.super_clusters(clusters, aln, 1.1).collect()} == {"a", "b", "c"}
    every, rep = C.add_clusters(aln, C.super_clusters(clusters, aln, 0.5))
    assert every.count() == 3 and rep.count() == 0


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame([("1", None, "no rank", "root"), ("2", "1", "superkingdom", "Bacteria"), ("3", "2", "clade", "x"), ("4", "3", "family", "Fam one"), ("5", "4", "species", "Sp"), ("6", "5", "strain", "Sp K12"), ("7", "7", "superkingdom", "Viruses"), ("8", "2", "clade", "y")], "taxid string, parent string, rank string, name string")


def test_lineages(spark, nodes):
    lin = N.lineages(nodes)
    assert {r.taxid: [n.taxid for n in r.lineage] for r in lin.collect()}["6"] == list("123456")
    out = {r.taxid: (r.superkingdom, r.family, r.species) for r in N.taxon_table(lin, ("superkingdom", "family", "species")).collect()}
    assert out["6"] == ("Bacteria", "Fam one", "Sp K12") and out["5"][2] == "Sp" and out["4"] == ("Bacteria", "Fam one", "") and out["7"][0] == "Viruses"
    df = spark.createDataFrame([("5",), ("99",)], "taxid string")
    assert rows(N.add_taxonomy(df, lin, levels=("family",))) == [("5", "Fam one"), ("99", "")]
    assert rows(N.rank_and_name(df, nodes)) == [("5", "species", "Sp"), ("99", "UNKNOWN", "UNKNOWN")]
    q = spark.createDataFrame([("Sp",), ("Sp 12",), ("?",)], "name string")
    assert rows(N.name_to_taxid(q, nodes)) == [("?", "X"), ("Sp 12", "5"), ("Sp", "5")] or rows(N.name_to_taxid(q, nodes)) == [("?", "X"), ("Sp", "5"), ("Sp 12", "5")]


def test_taxa_counts(spark, nodes):
    levels = ("superkingdom", "family")
    names = N.taxon_table(N.lineages(nodes), levels)
    clusters = spark.createDataFrame([("r__5", "r__5", 0), ("r__5", "s__6", 1), ("r__5", "t__7", 2), ("z__8", "z__8", 3)], "cluster_rep string, cluster_member string, ordinal int")
    got = rows(N.cluster_taxa_counts(clusters, names, levels=levels).select("cluster_rep", "cluster_count", "superkingdom", "level", "taxon", "count"))
    assert ("r__5", 3, "Bacteria", "family", "Fam one", 2) in got and ("r__5", 3, "Viruses", "superkingdom", "Viruses", 1) in got and ("r__5", 3, "Viruses", "family", "", 1) in got
    aln = spark.createDataFrame([("z__8", "q__5", "")], "query string, target string, taxid string")
    more = rows(N.cluster_taxa_counts(clusters, names, aln, levels).where("cluster_rep = 'z__8' and level = 'superkingdom'").select("taxon", "count"))
    assert more == [("Bacteria", 2)]
    with pytest.raises(PySparkException):
        N.cluster_taxa_counts(clusters, names, aln.withColumn("query", F.lit("nobody")), levels).collect()


def atoms(spark, data):
    return spark.createDataFrame([("f.pdb", 0, c, r, "", "", n, i, "CA", "", *map(float, xyz), 1.0, b, e, "") for i, (c, r, n, xyz, b, e) in enumerate(data)], "file string, model int, chain string, resseq int, icode string, hetflag string, resname string, atom_ordinal long, atom_name string, altloc string, x double, y double, z double, occupancy double, bfactor double, element string, line string")


def test_structures(spark):
    df = atoms(spark, [("A", 5, "ALA", (0.0, 0, 0), 90.0, "C"), ("A", 5, "ALA", (1.0, 0, 0), 10.0, "C"), ("A", 9, "GLY", (2.0, 0, 0), 50.0, "C")])
    assert rows(X.mean_plddt(df)) == [("f.pdb", 70.0)] and rows(X.chain_sequences(df)) == [("f.pdb", "AG")]
    assert [r.resseq for r in X.rebase(df).orderBy("atom_ordinal").collect()] == [1, 1, 2]
    assert rows(X.quality(X.residues(df), 60)) == [("f.pdb", 2, 1, 0.5)]
    with pytest.raises(ValueError):
        X.extract_chains(df, ["A", "Q"])
    d = spark.createDataFrame([("f", 0, "5-9"), ("f", 1, "5-6_9")], "id string, domain_no int, boundary string")
    assert {r.label for r in X.domain_residues(df, d.where("domain_no = 1")).collect()} == {"__D5-6_9"}
    full = spark.createDataFrame([("f", 0, "5_9")], "id string, domain_no int, boundary string")
    assert {r.label for r in X.domain_residues(df, full).collect()} == {"__DFULL"}
    table = spark.createDataFrame([("f.pdb", "NULL", 0)], "k string, b string, ordinal int")
    assert {r.label for r in X.domain_residues(df, X.domain_table(table, "k", "b")).collect()} == {"__DUNK"}
    with pytest.raises(PySparkException):
        X.domain_residues(df, d.where("id = 'g'")).collect()


@pytest.mark.parametrize("values,want", [([70] * 7 + [40] * 3 + [30] * 3 + [55], (7, 6, 1, 14, True)), ([40, 70] * 5, (0, 0, 10, 10, False)), ([], None)])
def test_disorder(spark, values, want):
    df = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(values)], "file string, resseq int, plddt double")
    got = rows(X.disorder(df, domain_length=7))
    assert got == ([("f", *want)] if want else [])


def test_near_pairs_and_contacts(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 3)) * 4, rng.normal(size=(40, 3)) * 4
    one = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id int, x double, y double, z double")
    two = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "id int, x double, y double, z double")
    want = sorted((i, j) for i, j in itertools.product(range(40), range(40)) if np.linalg.norm(a[i] - b[j]) < 2.5)
    assert sorted((r.a.id, r.b.id) for r in X.near_pairs(one, two, 2.5).collect()) == want
    df = atoms(spark, [("A", 1, "ALA", (0.0, 0, 0), 90.0, "C"), ("A", 2, "ALA", (50.0, 0, 0), 90.0, "C"), ("B", 1, "ALA", (3.8, 0, 0), 90.0, "C"), ("B", 2, "ALA", (53.7, 0, 0), 90.0, "H")])
    assert rows(X.contacts(df)) == [("f.pdb", "A", 1, "B", 1)]
    scores = spark.createDataFrame([("f.pdb", [[9.0, 9.0, 2.0, 9.0], [9.0, 9.0, 9.0, 9.0], [2.0, 9.0, 9.0, 9.0], [9.0, 9.0, 9.0, 9.0]])], "file string, pae array<array<double>>")
    r = X.interaction_summary(df, scores).first()
    assert (r.member1, r.average_pae, r.interactions, r.interface_residues, r.cross_chain_cluster, r.n1, r.n2) == ("f", 2.0, 1, 2, True, 2, 2)


def test_error_clusters():
    pae = np.full((10, 10), 20.0)
    pae[:4, :4] = pae[4:8, 4:8] = 1.0
    np.fill_diagonal(pae, 0.5)
    got = X.error_clusters(pae)
    assert {frozenset(c) for c in got} == {frozenset(range(4)), frozenset(range(4, 8)), frozenset({8}), frozenset({9})}


def test_contact_probability(spark):
    rng = np.random.default_rng(2)
    logits, edges = rng.normal(size=(5, 5, 4)), [2.0, 6.0, 9.0]
    p = np.exp(logits) / np.exp(logits).sum(-1, keepdims=True)
    want = p[:2, 2:, :2].sum(-1).max()
    df = spark.createDataFrame([("f", logits.tolist(), edges, 2)], "file string, logits array<array<array<double>>>, bin_edges array<double>, n1 int")
    assert X.max_contact_probability(df, "n1").first().contact_probability == pytest.approx(want)
    for bad in (df.withColumn("n1", F.lit(5)), df.withColumn("bin_edges", F.array(F.lit(99.0)))):
        with pytest.raises(PySparkException):
            X.max_contact_probability(bad, "n1").collect()


def test_range_join(spark):
    p = spark.createDataFrame([("g", i) for i in range(0, 1000, 7)], "g string, at int")
    iv = spark.createDataFrame([("g", 3, 20), ("g", 250, 600), ("g", 255, 257)], "g string, s int, e int")
    want = sorted((x, s) for x in range(0, 1000, 7) for s, e in ((3, 20), (250, 600), (255, 257)) if s <= x <= e)
    assert sorted((r["at"], r.s) for r in X.range_join(p, iv, ["g"], "at", "s", "e").collect()) == want
