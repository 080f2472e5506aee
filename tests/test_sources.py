"""Scans, writers, connectors, streams and the command line on files written here."""

import gzip
import json

import pytest
from pyspark.errors import PySparkException

from tessaline import cli
from tessaline.sources import remote, sequences, sinks, structures, tables
from tessaline.streaming import rowwise


def put(tmp_path, name, text):
    (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def cells(df):
    return [tuple(r)[:-1] for r in df.orderBy("ordinal").collect()]


def test_policies(spark, tmp_path):
    p = put(tmp_path, "a.m8", 'query\ttarget\tx\nq1\t"t"\t\n\nquery\ttarget\tx\nquery7\tt\t1\r\n')
    assert cells(tables.scan_table(spark, p, "P2")) == [("q1", '"t"', ""), ("query7", "t", "1")]
    with pytest.raises(PySparkException):
        tables.scan_table(spark, p, "P1").collect()
    loose = put(tmp_path, "b.m8", "query\ttarget\tx\nq\tt\t1\nshort\tt\nquery\ttarget\tx\n")
    assert cells(tables.scan_table(spark, loose, "P3", required=["query"], keep=["target", "query"])) == [("t", "q"), ("target", "query")]
    with pytest.raises(PySparkException):
        tables.scan_table(spark, loose, "P2").collect()
    with pytest.raises(ValueError):
        tables.scan_table(spark, loose, "P3", required=["cigar"])
    plain = put(tmp_path, "c.tsv", "a\tb\n1\t2\n3\n4\t5\t6\n")
    assert cells(tables.scan_table(spark, plain, "P4")) == [("1", "2"), ("3", None), ("4", "5")]
    assert cells(tables.scan_table(spark, plain, "P4", "a,b"))[0] == ("1", "2") and cells(tables.scan_table(spark, plain, "P4", ["c", "d"]))[0] == ("a", "b")
    with pytest.raises(ValueError):
        tables.scan_table(spark, put(tmp_path, "e.tsv", ""), "P4")
    with pytest.raises(ValueError):
        tables.scan_table(spark, put(tmp_path, "h.tsv", "x\ty\n"), "P1")


def test_cluster_scans(spark, tmp_path):
    p = put(tmp_path, "c.tsv", "cluster_rep\tcluster_member\na\ta\na\tb\n")
    assert cells(tables.scan_clusters(spark, p)) == [("a", "a"), ("a", "b")]
    with pytest.raises(ValueError):
        tables.scan_clusters(spark, put(tmp_path, "d.tsv", "cluster_rep\tcluster_member\na\tb\nc\tb\n"))
    nested = put(tmp_path, "n.tsv", "x\ty\na.pdb\tb.fasta\n\n")
    assert cells(tables.scan_nested_clusters(spark, nested)) == [("a", "b")]


def test_small_scans(spark, tmp_path):
    look = put(tmp_path, "l.tsv", "P1\tg\tfull\t\nP2\nP1\tg2\tnew\t\n")
    assert sorted(map(tuple, tables.scan_name_lookup(spark, look).collect())) == [("P1", "g2", "new"), ("P2", "", "")]
    ids = put(tmp_path, "i.tsv", "query\ttarget\nq\tAF-P9-F1\nq\tP9\n")
    assert [r.id for r in tables.scan_accessions(spark, ids, 1).collect()] == ["P9"]
    assert sorted(r.id for r in tables.scan_ids(spark, put(tmp_path, "j", "a\nb\na\n")).collect()) == ["a", "b"]
    key = put(tmp_path, "k", "prot.pdb,,abcd\n")
    assert tuple(tables.scan_structure_key(spark, key).first()) == ("prot", "abcd")
    with pytest.raises(ValueError):
        tables.scan_structure_key(spark, put(tmp_path, "k2", "prot,,abc\n"))
    assert tuple(tables.scan_lengths(spark, put(tmp_path, "q", "a.pdb\t77\n")).first()) == ("a", 77)


def test_fasta(spark, tmp_path):
    text = ">a one\nMK\nLV\n>b\nGG\r\n>a two\nTT\n"
    p = put(tmp_path, "t.fasta", text)
    assert [(r.id, r.seq) for r in sequences.scan_fasta(spark, p).orderBy("ordinal").collect()] == [("a", "TT"), ("b", "GG")]
    with gzip.open(tmp_path / "u.fasta.gz", "wt") as f:
        f.write(text)
    got = sequences.scan_fasta(spark, str(tmp_path / "u.fasta.gz"), keep_last=False).orderBy("ordinal").collect()
    assert [(r.id, r.description, r.seq) for r in got] == [("a", "a one", "MKLV"), ("b", "b", "GG"), ("a", "a two", "TT")]


GENBANK = '''LOCUS       NC_1 100 bp
FEATURES             Location/Qualifiers
     source          1..100
                     /organism="x"
     CDS             complement(join(10..20,30..40))
                     /locus_tag="L_1"
                     /product="a long
                     name"
                     /protein_id="P1"
                     /translation="MK
                     LV"
     CDS             50..60
ORIGIN
        1 acgt
//
LOCUS
//
LOCUS       NC_2 5 bp
FEATURES             Location/Qualifiers
     gene            1..5
//
'''


def test_genbank(spark, tmp_path):
    df = sequences.genbank_proteins(sequences.scan_genbank(spark, put(tmp_path, "g.gb", GENBANK)))
    got = [tuple(r)[1:] for r in df.orderBy("gene_order").collect()]
    assert got[0] == ("NC_1__P1__L-1__00001", "NC_1", "L-1", "P1", 9, 40, -1, "00001", "NC-1", "a-long-name", "MKLV")
    assert got[1][0] == "NC_1__X__X__00002" and got[1][-1] == "None" and len(got) == 2
    none = spark.createDataFrame([("NC_2",)], "id string")
    assert sequences.genbank_proteins(sequences.scan_genbank(spark, str(tmp_path / "g.gb")), accessions=none).count() == 0


def pdb_line(i, name, res, chain, num, x, b, element="C"):
    return f"ATOM  {i:5d} {name:^4s} {res:3s} {chain}{num:4d}    {x:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{b:6.2f}          {element:>2s}  "


PDB = "\n".join([pdb_line(7, "N", "ALA", "A", 10, 1, 90.5, "N"), pdb_line(8, "CA", "ALA", "A", 10, 2, 80), pdb_line(9, "N", "GLY", "A", 12, 3, 70, "N"), "TER", "END"]) + "\n"


def test_pdb_round_trip(spark, tmp_path):
    put(tmp_path, "s/one.pdb", PDB)
    put(tmp_path, "s/skip.txt", "ATOM")
    df = structures.scan_pdb(spark, str(tmp_path / "s"))
    r = df.orderBy("atom_ordinal").first()
    assert (r.chain, r.resseq, r.resname, r.atom_name, r.x, r.bfactor, r.element, r.model) == ("A", 10, "ALA", "N", 1.0, 90.5, "N", 0) and df.count() == 3
    from tessaline.operators.structures import rebase

    text = sinks.pdb_text(rebase(df)).first().text.split("\n")
    assert [t[6:11] + t[22:26] for t in text[:3]] == ["    1   1", "    2   1", "    3   2"] and text[3].startswith("TER       4      GLY A   2") and text[4:] == ["END   ", ""]
    assert text[0][11:22] == PDB[11:22] and text[0][26:] == PDB.split("\n")[0][26:]


DALI = """# Job: test
# Query: 8ixzA
# No:  Chain   Z    rmsd lali nres  %id PDB  Description
   1:  8ixz-A 20.0  0.0  100   100  100   MOLECULE
   2:  cwtu-A  7.8  3.1   60   120   12   MOLECULE
   3:  bad
# Pairwise alignments

No 1: Query=8ixzA Sbjct=cwtuA Z-score=7.8

DSSP  LLHHLL
Query mKTA-w   5
ident
Sbjct -KTGgw   5
DSSP  LLHHLL

No 2: Query=8ixzA Sbjct=zzzzA Z-score=2.0
DSSP  LL
Query MK 2
Sbjct MK 2
DSSP  LL
# Translation-rotation matrices
"""


def test_dali(spark, tmp_path):
    p, key = put(tmp_path, "d.txt", DALI), tables.scan_structure_key(spark, put(tmp_path, "k", "query.pdb,,8ixz\ntarget.pdb,,cwtu\n"))
    blocks = structures.scan_dali_blocks(spark, p, key)
    got = {r.aln_number: r for r in blocks.collect()}
    assert (got[1].query, got[1].target, got[1].aln_qseq, got[1].aln_tseq, got[1].aln_tdssp) == ("query", "target", "mKTA-w", "-KTGgw", "LLHHLL") and got[2].target == "x"
    from tessaline.operators import alignments as A

    r = A.dali_attributes(blocks.where("aln_number = 1")).first()
    assert (r.qstart, r.qend, r.tstart, r.tend, r.qlen, r.tlen, r.pident) == (2, 4, 1, 3, 5, 5, 67)
    assert [r.aln_number for r in A.dali_motif(blocks, "2_K_0").collect()] == [1, 2] and [r.aln_number for r in A.dali_motif(blocks, "4_G_0").collect()] == [1]
    s = {r.target_id: r for r in structures.scan_dali_summary(spark, p, key).collect()}
    assert (s["8ixz"].qlen, s["8ixz"].cov) == (100, 1.0) and (s["cwtu"].query, s["cwtu"].target, s["cwtu"].qlen, s["cwtu"].cov) == ("query", "target", 0, 0.5) and len(s) == 2
    sheet = spark.createDataFrame([("query", 200)], "name string, qlen int")
    assert {r.target_id for r in structures.scan_dali_summary(spark, p, key, lengths=sheet, min_cov=0.4).collect()} == {"8ixz"}
    assert structures.rename_newick("(8ixzA:1.5,cwtuA:2,q:x);", {"8ixz": "one", "cwtu": "two"}) == "(one:1.5,two:2,q:x);"
    m = structures.rename_matrix(spark, put(tmp_path, "m", "2\n8ixzA\t1.0\t2.0\ncwtuA\t3\t4\n"), key).orderBy("n").collect()
    assert [(r.name, r["values"]) for r in m] == [("query", [1.0, 2.0]), ("target", [3.0, 4.0])]
    with pytest.raises(PySparkException):
        structures.scan_dali_blocks(spark, put(tmp_path, "none", "# nothing\n")).collect()


def test_scores(spark, tmp_path):
    p = put(tmp_path, "s.json", json.dumps({"pae": [[1, 2], [3, 4]], "plddt": [90, 80], "iptm": 0.5}))
    assert structures.scan_pae(spark, p).first().pae == [[1.0, 2.0], [3.0, 4.0]] and structures.scan_iptm(spark, p).first().iptm == "0.5"
    with pytest.raises(PySparkException):
        structures.scan_iptm(spark, put(tmp_path, "t.json", "{}")).collect()
    with pytest.raises(ValueError):
        structures.scan_iptm(spark, "x.txt")
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("x_all_rank_003_alphafold2_multimer_v3_model_2_seed_000.pickle", "#98,76\t1,1")], "n string, a string").select(structures.model_name_parts(F.col("n")).alias("p"), structures.first_chain_length(F.col("a")).alias("n")).first()
    assert (row.p.sample, row.p.rank, row.p.model, row.n) == ("x", "3", "model_2_seed_000", 98)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 1e-7, None, ["x", "y"], True), ('"q"', 2.0, 3, [], False)], "s string, d double, n int, l array<string>, b boolean")
    sinks.write_table(df, str(tmp_path / "t"), single=True, order=["d"])
    text = next((tmp_path / "t").glob("part-*")).read_text()
    assert text == 's\td\tn\tl\tb\na\tb\t1e-07\t\tx,y\tTrue\n"q"\t2.0\t3\t\tFalse\n'
    sinks.write_table(df, str(tmp_path / "u"), ["s"], header=False, single=True, guard=True, order=["d"])
    assert next((tmp_path / "u").glob("part-*")).read_text() == 'a_b\n"q"\n'
    sinks.append_table(df.limit(1), str(tmp_path / "u"))
    assert len(list((tmp_path / "u").glob("part-*"))) == 2
    sinks.write_fasta(spark.createDataFrame([("x", "MK")], "id string, seq string"), str(tmp_path / "f"), single=True)
    assert next((tmp_path / "f").glob("part-*")).read_text() == ">x\nMK\n"
    sinks.write_files(spark.createDataFrame([("a/../b c.txt", "hello")], "path string, text string"), str(tmp_path / "files"))
    assert [p.read_text() for p in (tmp_path / "files").rglob("*.txt")] == ["hello"] and not list(tmp_path.glob("*.txt"))
    sinks.write_csv(df.select("s", "d"), str(tmp_path / "c"), single=True)


def test_remote(spark):
    record = {"genes": [{"orfNames": [{"value": "orf"}]}], "proteinDescription": {"submissionNames": [{"fullName": {"value": "sub"}}]}}
    asked = spark.sparkContext.accumulator(0)

    def fetch(batch):
        asked.add(len(batch))
        return [{"from": b, "to": record} for b in batch if b != "missing"]

    ids = spark.createDataFrame([("P1",), ("P2",), ("missing",), ("P1",)], "id string")
    cache = spark.createDataFrame([("P2", "g", "cached")], "accession string, geneName string, fullName string")
    out, grown = remote.lookup_with_cache(ids, fetch, cache)
    assert sorted(map(tuple, out.collect())) == [("P1", "orf", "sub"), ("P2", "g", "cached")] and asked.value == 2

    def get(url):
        if "bad" in url:
            raise OSError("404")
        return json.dumps([{"pdbUrl": "pdb", "paeDocUrl": "pae"}]) if url.startswith("api") else "body " + url

    got = remote.download_models(spark.createDataFrame([("U1", "9"), ("bad", "8")], "uniprotID string, taxonID string"), get, "api/{}", extra=["taxonID"]).orderBy("uniprotID").collect()
    assert (got[0].out_name, got[0].pdb, got[0].pae) == ("U1__9", "body pdb", "body pae") and got[1].pdb is None and "404" in got[1].message


def test_streams(spark, tmp_path):
    put(tmp_path, "in/a.m8", "query\talntmscore\tcigar\tqlen\ttlen\nq\t0.5\t8M\t10\t16\nr\t0.1\t8M\t10\t16\n")
    s = rowwise.coverage_stream(rowwise.filter_stream(rowwise.read_alignments(spark, str(tmp_path / "in"), ["query", "alntmscore", "cigar", "qlen", "tlen"])))
    q = rowwise.per_batch(s, lambda b: b.groupBy("query").count(), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [(r["query"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("q", 1)]
    w = rowwise.windowed_counts(spark.readStream.format("rate").load(), "timestamp", ["value"])
    assert w.isStreaming and w.columns == ["window_start", "value", "count"]


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessaline.session.session", lambda *a, **k: spark)
    assert len(cli.COMMANDS) == 37
    aln = put(tmp_path, "a.m8", "query\ttarget\talntmscore\tcigar\tqlen\ttlen\na\tb\t6.166E-01\t80M\t100\t200\nb\tc\t0.2\t8M\t10\t10\n")

    def run(*argv):
        cli.main([*map(str, argv), "--single"])

    def text(name):
        return next((tmp_path / name).glob("part-*")).read_text()

    run("aln_filter", "-a", aln, "-o", tmp_path / "o1")
    assert text("o1") == "query\ttarget\talntmscore\tcigar\tqlen\ttlen\na\tb\t0.6166\t80M\t100\t200\n"
    run("aln_cigar_to_cov", "-a", aln, "-o", tmp_path / "o2")
    assert "a\tb\t6.166E-01\t80M\t0.800\t0.400\t100\t200\n" in text("o2")
    run("aln_cluster_connected_component", "-a", aln, "-o", tmp_path / "o3")
    assert sorted(text("o3").split("\n")[1:-1]) == ["a\ta", "a\tb", "a\tc"]
    run("aln_cluster_greedy", "-a", aln, "-o", tmp_path / "o4")
    assert sorted(text("o4").split("\n")[1:-1]) == ["b\ta", "b\tb", "b\tc"]
    run("aln_sample", "-a", aln, "-o", tmp_path / "o5", "-n", 1, "-s", "alntmscore")
    assert len(text("o5").split("\n")) == 4
    fasta = put(tmp_path, "t.fasta", ">s\n" + "ACDEFGHIKL" * 12 + "\n")
    run("seq_chunk", "-i", fasta, "-o", tmp_path / "o6", "-m", 100, "-s", 10)
    assert text("o6").startswith(">PART0_s\n")
    run("seq_multimerize", "-i", fasta, "-H", "dimer", "-o", tmp_path / "o7")
    assert text("o7").count(":") == 1
    put(tmp_path, "s/one.pdb", PDB)
    run("struc_to_seq", "-s", tmp_path / "s/one.pdb", "-o", tmp_path / "o8")
    assert text("o8") == ">one\nAG\n"
    run("struc_to_plddt", "-s", tmp_path / "s/one.pdb", "-o", tmp_path / "o9")
    assert text("o9") == "one\t80.25\n"
    domains = put(tmp_path, "dom.tsv", "chain_id\tchopping\none\t10-12\n")
    run("struc_get_domains", "-s", tmp_path / "s", "-d", domains, "--domain_column", "chopping", "-o", tmp_path / "doms")
    assert [p.name for p in (tmp_path / "doms").iterdir()] == ["one__D10-12.pdb"]
    for name, text_ in (("dom.csv", "chain_id,chopping\none,12\n"), ("dom.json", '{"chain_id": "one", "chopping": "10"}\n')):
        run("struc_get_domains", "-s", tmp_path / "s", "-d", put(tmp_path, name, text_), "--domain_column", "chopping", "-i", "chain_id", "-o", tmp_path / "doms")
    assert sorted(p.name for p in (tmp_path / "doms").iterdir()) == ["one__D10-12.pdb", "one__D10.pdb", "one__D12.pdb"]
    run("struc_rebase", "-s", tmp_path / "s/one.pdb", "-o", tmp_path / "o10")
    assert text("o10").endswith("END   \n")
