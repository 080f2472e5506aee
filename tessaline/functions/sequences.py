"""Column functions on protein sequences, motifs and aligned pairs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter residue names and their one-letter codes.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "ASX": "B", "GLX": "Z", "XLE": "J", "SEC": "U", "PYL": "O", "XAA": "X",
}
# The residues that the motif wildcard stands for.
MOTIF_ALPHABET = "ARNDBCEQZGHILKMFPSTWYV"
MAX_MOTIF = 10


def residue_letter(name: Column) -> Column:
    """One-letter code of a residue name, X for those unknown."""
    table = F.create_map(*(F.lit(x) for pair in ONE_LETTER.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(name))), F.lit("X"))


def chunk_step(max_length: int, overlapping: bool) -> int:
    """Windows follow each other, or overlap by half a window rounded half to even."""
    return max_length - round(max_length / 2) if overlapping else max_length


def chunks(seq: Column, max_length: int, overlapping: bool = False) -> Column:
    """Windows of a sequence; the last one goes if the one before contains it. An empty sequence has none."""
    step = chunk_step(max_length, overlapping)
    # one pass cuts steps; a window is the steps that it spans, so no window walks the sequence from its start
    steps = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    span = -(-max_length // step)
    wide = lambda ps: F.transform(ps, lambda _, i: F.left(F.array_join(F.slice(ps, i + 1, F.lit(span)), ""), F.lit(max_length)))

    def trimmed(parts: Column) -> Column:
        n = F.size(parts)
        return F.when((n > 1) & F.contains(F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))), F.slice(parts, F.lit(1), n - 1)).otherwise(parts)

    return _let(_let(steps, wide) if span > 1 else steps, trimmed)


def motif_classes(motif: str) -> list[str]:
    """The residues allowed at each position of a motif such as ``T[HI]xC``; ``x`` is any residue and X inside brackets itself."""
    parts = re.findall(r"\[([^\]]*)\]|(.)", motif)
    out = [options.upper() if options else MOTIF_ALPHABET if single in "xX" else single.upper() for options, single in parts]
    if len(out) > MAX_MOTIF:
        raise ValueError(f"a motif has at most {MAX_MOTIF} positions")
    return out


def motif_matches(seq: Column, motif: str) -> Column:
    """``array<struct<match, start, end>>``: all places of a motif, 1-based, without overlap between equal matches.

    Different residues that match the same motif may overlap. The places are found by one character class expression.
    """
    classes = motif_classes(motif)
    k, pattern = len(classes), "".join("[" + re.sub(r"([\\\]\[^&-])", r"\\\1", c) + "]" for c in classes)
    # cut before every match, overlapping ones too: a piece begins with a match, but for the first that may not
    parts = F.split(seq, f"(?={pattern})", -1)

    def places(ps: Column, starts: Column) -> Column:
        text = lambda i: F.left(F.array_join(F.slice(ps, i + 1, F.lit(k)), ""), F.lit(k))
        found = F.transform(ps, lambda _, i: F.struct(text(i).alias("match"), F.get(starts, i).alias("start"), (F.get(starts, i) + k - 1).alias("end")))
        return F.filter(found, lambda h: h["match"].rlike(f"^{pattern}$"))

    def begins(ps: Column) -> Column:
        return F.aggregate(ps, F.array(F.lit(1)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))

    hits = _let(parts, lambda ps: _let(begins(ps), lambda starts: places(ps, starts)))
    return _let(hits, lambda hs: _apart(hs, k)) if _overlaps_itself(classes) else hits


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a lambda would compute it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _apart(hits: Column, k: int) -> Column:
    """The places of each string, kept where the kept one before ends ahead of it."""

    def of(match: Column) -> Column:
        own = F.transform(F.filter(hits, lambda h: h["match"] == match), lambda h: h["start"])
        start = F.struct(F.lit(-k).alias("last"), F.array().cast("array<int>").alias("kept"))
        kept = F.aggregate(own, start, lambda acc, i: F.when(i >= acc["last"] + k, F.struct(i.alias("last"), F.concat(acc["kept"], F.array(i)).alias("kept"))).otherwise(acc), lambda acc: acc["kept"])
        return F.transform(kept, lambda i: F.struct(match.alias("match"), i.alias("start"), (i + k - 1).alias("end")))

    order = lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0)
    return F.array_sort(F.flatten(F.transform(F.array_distinct(F.transform(hits, lambda h: h["match"])), of)), order)


def _overlaps_itself(classes: list[str]) -> bool:
    """Whether a string of the motif can begin within itself."""
    return any(all(set(a) & set(b) for a, b in zip(classes[shift:], classes, strict=False)) for shift in range(1, len(classes)))


def multimer(seqs: Column, cardinality: Column) -> Column:
    """Each sequence as often as its cardinality says, joined by colons; an error if the two differ in size."""
    pairs = F.transform(F.arrays_zip(seqs.alias("s"), cardinality.alias("n")), lambda p: F.array_repeat(p["s"], p["n"].cast("int")))
    return F.when(F.size(seqs) != F.size(cardinality), F.raise_error(F.lit("one cardinality for each sequence is needed")).cast("string")).otherwise(F.array_join(F.flatten(pairs), ":"))


def trim(seq: Column, start: Column, length: Column) -> Column:
    """The 1-based slice of a sequence; an error if the sequence ends before."""
    out = F.substr(seq, start.cast("int"), length.cast("int"))
    return F.when(F.length(out) == length, out).otherwise(F.raise_error(F.lit("the interval lies outside of the sequence")).cast("string"))


# --- aligned pairs -------------------------------------------------------------------------------------------------


def _aligned(query: Column, target: Column) -> Column:
    """``array<struct<i, same>>`` of the aligned columns; both sequences are cut into characters once."""

    def state(q: Column, t: Column) -> Column:
        up = lambda c: c.rlike("^[A-Z]$")
        letters = q.rlike("^[A-Za-z]$") & t.rlike("^[A-Za-z]$")
        return F.when(letters & (up(q) != up(t)), F.raise_error(F.lit("mixed case in an aligned column")).cast("boolean")).otherwise(up(q) & up(t))

    pairs = F.arrays_zip(_letters(query).alias("q"), _letters(target).alias("t"))
    own = F.transform(pairs, lambda p, i: F.when(state(F.coalesce(p["q"], F.lit("")), F.coalesce(p["t"], F.lit(""))), F.struct(i.alias("i"), (p["q"] == p["t"]).alias("same"))))
    return F.filter(own, lambda c: c.isNotNull())


def aligned_columns(query: Column, target: Column) -> Column:
    """0-based columns in which both residues are upper case; an error where only one of two residues is."""
    return F.transform(_aligned(query, target), lambda c: c["i"])


def _letters(seq: Column) -> Column:
    return F.regexp_extract_all(seq, F.lit("(?s)."), F.lit(0))


def sequence_position(aligned: Column, column: Column) -> Column:
    """1-based residue number at a 0-based column; an error on a gap or beyond the end."""
    here = F.substr(aligned, column + 1, F.lit(1))
    n = F.length(F.replace(F.substr(aligned, F.lit(1), column + 1), F.lit("-"), F.lit("")))
    return F.when((here == "") | (here == "-"), F.raise_error(F.lit("no residue in this column")).cast("int")).otherwise(n)


def percent_identity(query: Column, target: Column) -> Column:
    """Identical among aligned columns, in percent, rounded half up."""
    share = lambda cs: F.floor(F.when(F.size(cs) > 0, F.size(F.filter(cs, lambda c: c["same"])) * 100.0 / F.size(cs)) + 0.5).cast("int")
    return _let(_aligned(query, target), share)


def residue_count(aligned: Column) -> Column:
    """Residues of an aligned sequence; an error if it is all gaps."""
    n = F.length(F.replace(aligned, F.lit("-"), F.lit("")))
    return F.when(n == 0, F.raise_error(F.lit("a sequence of gaps alone")).cast("int")).otherwise(n)


def column_of_residue(aligned: Column, position: Column) -> Column:
    """0-based column of a 1-based residue; null out of range."""
    cols = F.filter(F.sequence(F.lit(0), F.length(aligned) - 1), lambda i: F.substr(aligned, i + 1, F.lit(1)) != "-")
    return F.when(position >= 1, F.try_element_at(cols, position.cast("int")))


def has_residues(aligned: Column, column: Column, residues: list[list[str]]) -> Column:
    """Whether the columns from ``column`` on hold the wanted residues; ``X`` is anything, gaps too. False out of range."""
    inside = column.isNotNull() & (column >= 0) & (column + len(residues) <= F.length(aligned))
    ok = F.lit(True)
    for k, options in enumerate(residues):
        if "X" not in options:
            ok = ok & F.upper(F.substr(aligned, column + k + 1, F.lit(1))).isin(*options)
    return F.coalesce(inside & ok, F.lit(False))


def _wants(target: Column, wanted: list[list[str]]):
    return lambda i: has_residues(target, i, wanted)


def has_motif(query: Column, target: Column, motif: str) -> Column:
    """A conjunction, joined by ``+``, of ``POSITION_RESIDUES_FLEX``.

    The target has the residues (comma-separated, options by slash) at the query's residue number, or up to FLEX columns away.
    """
    out = F.lit(True)
    for part in motif.split("+"):
        position, residues, flex = part.split("_")
        wanted = [[o.upper() for o in item.split("/")] for item in residues.split(",")]
        at = column_of_residue(query, F.lit(int(position)))
        near = F.sequence(at - int(flex), at + int(flex))
        out = out & F.coalesce(F.exists(near, _wants(target, wanted)), F.lit(False))
    return out


def range_residues(boundary: Column) -> Column:
    """Residue numbers of ``10-20_50-100``: pieces by underscore, single numbers allowed; a comma is an error."""

    def piece(p: Column) -> Column:
        ends = F.split(p, "-")
        return F.sequence(F.get(ends, F.lit(0)).cast("int"), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))).cast("int"))

    whole = F.flatten(F.transform(F.split(boundary, "_"), piece))
    return F.when(F.contains(boundary, F.lit(",")), F.raise_error(F.lit("one domain at a time; a comma separates domains")).cast("array<int>")).otherwise(whole)
