"""Column functions on names, identifiers and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of structure and sequence files, removed one after another in this order.
FILE_SUFFIXES = (".pdb.gz", ".cif.gz", ".fasta.gz", ".fa.gz", ".pdb", ".cif", ".mmcif", ".ent", ".fasta", ".fa", ".faa", ".fna", ".ffn", ".frn")
# Suffixes that tie a domain table's ids to structure files.
STRUCTURE_SUFFIXES = (".pdb", ".cif", ".mmcif", ".ent")
# Characters that do not belong in a sequence name.
BAD_CHARACTERS = ":;_\\/?{}[]*!#+ "
# What an input table may write for a missing value.
NULL_TOKENS = ("null", "none", "nan", "", "na", "n/a", "missing")


def quoted(text: str) -> str:
    """A regular expression that matches ``text`` literally."""
    return "\\Q" + text + "\\E"


def split_literal(col: Column, delimiter: str) -> Column:
    return F.split(col, quoted(delimiter), -1)


def cigar_matches(cigar: Column) -> Column:
    """Residues in match runs of a CIGAR string; 0 without any."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)M"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long"))


def coverage(matches: Column, length: Column) -> Column:
    """Matches by length, 0 where the length is not positive."""
    return F.when(length > 0, matches / length).otherwise(F.lit(0.0))


def remove_file_suffix(col: Column) -> Column:
    """All known file suffixes, case-insensitively, in the order of ``FILE_SUFFIXES``; an inner one may go after an outer."""
    for suffix in FILE_SUFFIXES:
        col = F.regexp_replace(col, f"(?i){quoted(suffix)}$", "")
    return col


def remove_pdb_and_fasta_suffix(col: Column, legacy: bool = False) -> Column:
    """One ``.fasta`` and then one ``.pdb`` suffix. ``legacy`` strips the suffixes' characters instead, eating into names."""
    if legacy:
        return F.rtrim(F.rtrim(col, F.lit(".fasta")), F.lit(".pdb"))
    return F.regexp_replace(F.regexp_replace(col, r"\.fasta$", ""), r"\.pdb$", "")


def strip_structure_suffix(col: Column) -> Column:
    alternatives = "|".join(quoted(s) for s in STRUCTURE_SUFFIXES)
    return F.regexp_replace(col, f"(?i)({alternatives})$", "")


def remove_bad_characters(col: Column) -> Column:
    return F.translate(col, BAD_CHARACTERS, "-" * len(BAD_CHARACTERS))


def pad_to_five_digits(col: Column) -> Column:
    """Zero-padded; an error above 99999."""
    return F.when(col > 99999, F.raise_error(F.lit("more than five digits"))).otherwise(F.lpad(col.cast("string"), 5, "0"))


def accession_of(col: Column) -> Column:
    """The second dash-separated token of a model name, or the whole of a name without dashes."""
    return F.when(F.contains(col, F.lit("-")), F.get(F.split(col, "-"), F.lit(1))).otherwise(col)


def token(col: Column, delimiter: str, position: int) -> Column:
    """A token by position, from the end where negative; null out of range."""
    return F.try_element_at(split_literal(col, delimiter), F.lit(position if position < 0 else position + 1))


def cluster_taxid(member: Column, delimiter: str = "__", position: int = -1, legacy: bool = False) -> Column:
    """Taxon id in a cluster member's name: the token up to its first underscore, without a structure suffix."""
    own = token(member, delimiter, position)
    own = F.rtrim(own, F.lit(".pdb")) if legacy else F.regexp_replace(own, r"\.pdb$", "")
    return F.substring_index(own, "_", 1)


def alignment_taxid(name: Column, taxid: Column | None = None, delimiter: str = "__", position: int = -1) -> Column:
    """Taxon id in an aligned name; a ``taxid`` that is given and not empty goes first. Only domain names are cut."""
    own = F.regexp_replace(token(name, delimiter, position), r"\.pdb$", "")
    own = F.when(F.contains(own, F.lit("domain")), F.substring_index(own, "_", 1)).otherwise(own)
    return own if taxid is None else F.coalesce(F.nullif(taxid, F.lit("")), own)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.pdb$", "")


def component_names(path: Column, delimiter: str = "__") -> Column:
    """The two component names in a structure's file name; the whole name twice if it is not in two parts."""
    stem = file_stem(path)
    parts = split_literal(stem, delimiter)
    return F.when(F.size(parts) == 2, parts).otherwise(F.array(stem, stem))


def is_missing(col: Column) -> Column:
    return col.isNull() | F.lower(F.trim(col)).isin(*NULL_TOKENS)


def strict_double(col: Column) -> Column:
    """A double from text as strictly as the file format asks; an error otherwise."""
    ok = F.trim(col).rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$")
    return F.when(ok, F.trim(col).cast("double")).when(col.isNotNull(), F.raise_error(F.concat(F.lit("not a number: "), col)).cast("double"))
