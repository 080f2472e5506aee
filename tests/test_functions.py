"""Column functions on literals."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessaline.functions import numbers as Num
from tessaline.functions import sequences as S
from tessaline.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    def get(col):
        return spark.range(1).select(col.alias("v")).first().v

    return get


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize("cigar,n", [("6M9I19M3I1M1I1M1I19M1D8M1D30M", 84), ("80M", 80), ("", 0), ("5I3D", 0), ("10M5X2M", 12)])
def test_cigar(value, cigar, n):
    assert value(T.cigar_matches(lit(cigar))) == n


def test_coverage(value):
    assert value(T.coverage(lit(80), lit(100))) == 0.8 and value(T.coverage(lit(80), lit(0))) == 0.0


@pytest.mark.parametrize("name,want", [("A.fasta.pdb", "A"), ("A.pdb.fasta", "A.pdb"), ("A.PDB.gz", "A"), ("A.fna", "A"), ("A", "A"), ("A.pdb.x", "A.pdb.x")])
def test_file_suffix(value, name, want):
    assert value(T.remove_file_suffix(lit(name))) == want


def test_names(value):
    assert value(T.remove_pdb_and_fasta_suffix(lit("abd.pdb"))) == "abd" and value(T.remove_pdb_and_fasta_suffix(lit("abd.pdb"), legacy=True)) == "a"
    assert value(T.strip_structure_suffix(lit("x.CIF"))) == "x"
    assert value(T.remove_bad_characters(lit("a:b c[d]\\e"))) == "a-b-c-d--e"
    assert value(T.pad_to_five_digits(lit(42))) == "00042"
    with pytest.raises(PySparkException):
        value(T.pad_to_five_digits(lit(100000)))
    assert value(T.accession_of(lit("AF-K0EZQ3-F1-model_v2"))) == "K0EZQ3" and value(T.accession_of(lit("K0EZQ3"))) == "K0EZQ3"
    assert value(T.cluster_taxid(lit("a__b__1234_domain1.pdb"))) == "1234" and value(T.cluster_taxid(lit("a__77__c"), position=1)) == "77"
    assert value(T.alignment_taxid(lit("a__12_x"))) == "12_x" and value(T.alignment_taxid(lit("a__12_domain2.pdb"))) == "12" and value(T.alignment_taxid(lit("a__12"), lit("9"))) == "9" and value(T.alignment_taxid(lit("a__12"), lit(""))) == "12"
    assert value(T.component_names(lit("/x/a__b.pdb"))) == ["a", "b"] and value(T.component_names(lit("/x/a__b__c.pdb"))) == ["a__b__c"] * 2
    assert value(T.is_missing(lit("N/A"))) and not value(T.is_missing(lit("1-5")))
    assert value(T.split_literal(lit("a||b"), "||")) == ["a", "b"]


@pytest.mark.parametrize("text,want", [("6.166E-01", 0.6166), (" 12 ", 12.0), ("-.5", -0.5)])
def test_strict_double(value, text, want):
    assert value(T.strict_double(lit(text))) == want


@pytest.mark.parametrize("text", ["1.0d", "x", "", "1_000"])
def test_strict_double_rejects(value, text):
    with pytest.raises(PySparkException):
        value(T.strict_double(lit(text)))


def test_float_text(value):
    assert value(Num.float_text(lit(1e-7))) == "1e-07" and value(Num.float_text(lit(1e7))) == "10000000.0"
    assert value(Num.fixed3(lit(0.0625))) == "0.062" and value(Num.python_round2(lit(2.675))) == 2.67


@pytest.mark.parametrize(
    "seq,n,overlap,want",
    [("ABCDEFGHIJKLMNO", 6, True, ["ABCDEF", "DEFGHI", "GHIJKL", "JKLMNO"]), ("ABCDEFGHIJKLMNO", 7, True, ["ABCDEFG", "DEFGHIJ", "GHIJKLM", "JKLMNO"]), ("ABCDEFG", 3, False, ["ABC", "DEF", "G"]), ("AAAA", 3, False, ["AAA"]), ("", 3, False, []), ("AB", 5, False, ["AB"])],
)
def test_chunks(value, seq, n, overlap, want):
    assert value(S.chunks(lit(seq), n, overlap)) == want


def brute_motif(seq, motif):
    """Every concrete string of the motif, its matches without overlap, as a plain enumeration."""
    import itertools
    import re

    out = set()
    for letters in itertools.product(*S.motif_classes(motif)):
        m = "".join(letters)
        out |= {(m, f.start() + 1, f.end()) for f in re.finditer(re.escape(m), seq)}
    return sorted(out)


@pytest.mark.parametrize("seq,motif", [("THTIXTH", "T[HI]"), ("AAAAA", "AA"), ("AAAXAAA", "A[AX]A"), ("TXTHT", "TxT"), ("", "A"), ("AXA", "A[X]A")])
def test_motifs(value, seq, motif):
    assert sorted((r.match, r.start, r.end) for r in value(S.motif_matches(lit(seq), motif))) == brute_motif(seq, motif)


def test_motif_length():
    with pytest.raises(ValueError):
        S.motif_classes("ABCDEFGHIJK")


def test_multimer(value):
    seqs = F.array(lit("ATG"), lit("TAG"), lit("GTA"))
    assert value(S.multimer(seqs, F.array(lit(2), lit(3), lit(1)))) == "ATG:ATG:TAG:TAG:TAG:GTA"
    with pytest.raises(PySparkException):
        value(S.multimer(seqs, F.array(lit(2))))


def test_trim(value):
    assert value(S.trim(lit("ABCDEF"), lit(2), lit(3))) == "BCD"
    with pytest.raises(PySparkException):
        value(S.trim(lit("ABC"), lit(2), lit(3)))


def test_aligned_pairs(value):
    q, t = lit("--aBCD-Ef"), lit("xy-BXDGEf")
    assert value(S.aligned_columns(q, t)) == [3, 4, 5, 7]
    assert value(S.percent_identity(q, t)) == 75
    assert value(S.sequence_position(q, lit(3))) == 2 and value(S.sequence_position(q, lit(7))) == 5
    assert value(S.residue_count(q)) == 6 and value(S.column_of_residue(q, lit(5))) == 7 and value(S.column_of_residue(q, lit(9))) is None
    for bad in (S.sequence_position(q, lit(0)), S.sequence_position(q, lit(50)), S.residue_count(lit("--"))):
        with pytest.raises(PySparkException):
            value(bad)
    with pytest.raises(PySparkException):
        value(S.aligned_columns(lit("a"), lit("A")))


@pytest.mark.parametrize("motif,want", [("2_B_0", True), ("2_D_0", False), ("2_D_2", True), ("2_B,X,D_0", True), ("2_c/B_0", True), ("2_B_0+5_E_0", True), ("2_B_0+5_K_0", False), ("40_B_1", False), ("5_E,X,X,X_0", False)])
def test_has_motif(value, motif, want):
    assert value(S.has_motif(lit("--aBCD-Ef"), lit("xy-BXDGEf"), motif)) is want


def test_ranges(value):
    assert value(S.range_residues(lit("10-12_20_30-31"))) == [10, 11, 12, 20, 30, 31]
    with pytest.raises(PySparkException):
        value(S.range_residues(lit("1-2,4-5")))
    assert value(S.residue_letter(lit("trp"))) == "W" and value(S.residue_letter(lit("ZZZ"))) == "X"
