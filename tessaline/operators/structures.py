"""Operators on atoms, residues and residue matrices."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import range_residues, residue_letter
from ..functions.text import is_missing

# Van der Waals radii in Ångström, and what may lie between two touching atoms.
RADII = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}
GAP = 0.5
RESIDUE = ["file", "model", "chain", "resseq", "icode", "hetflag"]


def residues(atoms: DataFrame) -> DataFrame:
    """One row a residue: its name, place in the file, and as plddt its first atom's B-factor."""
    return atoms.groupBy(*RESIDUE).agg(F.min_by("resname", "atom_ordinal").alias("resname"), F.min("atom_ordinal").alias("ordinal"), F.min_by("bfactor", "atom_ordinal").alias("plddt"))


def mean_plddt(atoms: DataFrame) -> DataFrame:
    """(file, plddt): the mean over residue numbers, of equal numbers the last in the file, to two decimals."""
    per = residues(atoms).groupBy("file", "resseq").agg(F.max_by("plddt", "ordinal").alias("plddt"))
    return per.groupBy("file").agg(F.round(F.avg("plddt"), 2).alias("plddt"))


def quality(values: DataFrame, cutoff: float, by: str = "file", value: str = "plddt") -> DataFrame:
    """(by, total, passing, fraction) of values that reach the cutoff."""
    out = values.groupBy(by).agg(F.count(value).alias("total"), F.count_if(F.col(value) >= cutoff).alias("passing"))
    return out.withColumn("fraction", F.round(F.col("passing") / F.col("total"), 2))


def runs(values: DataFrame, by: str, order: str, keep: Column, min_length: int) -> DataFrame:
    """(by, start, end, length): maximal runs of rows for which ``keep`` holds, by their rank in the order, from 1."""
    w = Window.partitionBy(by).orderBy(order)
    v = values.withColumn("_i", F.row_number().over(w)).withColumn("_keep", keep).where("_keep")
    v = v.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(by).orderBy("_i")))
    return v.groupBy(by, "_g").agg(F.min("_i").cast("long").alias("start"), F.max("_i").cast("long").alias("end"), F.count("*").alias("length")).where(F.col("length") >= min_length).drop("_g")


def disorder(values: DataFrame, by: str = "file", order: str = "resseq", value: str = "plddt", order_cutoff: float = 60, disorder_cutoff: float = 50, n_sequential: int = 6, domain_length: int = 50) -> DataFrame:
    """(by, ordered, disordered, intermediate, total, there_is_a_domain): residues in runs at or above and at or below the cutoffs."""
    total = values.groupBy(by).agg(F.count("*").alias("total"))
    up = runs(values, by, order, F.col(value) >= order_cutoff, n_sequential).groupBy(by).agg(F.sum("length").alias("ordered"), F.max("length").alias("longest"))
    down = runs(values, by, order, F.col(value) <= disorder_cutoff, n_sequential).groupBy(by).agg(F.sum("length").alias("disordered"))
    out = total.join(up, by, "left").join(down, by, "left").na.fill(0, ["ordered", "disordered", "longest"])
    return out.select(by, "ordered", "disordered", (F.col("total") - F.col("ordered") - F.col("disordered")).alias("intermediate"), "total", (F.col("longest") >= domain_length).alias("there_is_a_domain"))


def rebase(atoms: DataFrame) -> DataFrame:
    """Atoms with residues renumbered from 1 across each structure, in file order."""
    r = residues(atoms)
    new = F.row_number().over(Window.partitionBy("file").orderBy("ordinal"))
    r = r.select(*(F.col(c).alias(f"_{c}") for c in RESIDUE), new.alias("_new"))
    return atoms.join(r, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in RESIDUE]).withColumn("resseq", F.col("_new")).drop("_new", *(f"_{c}" for c in RESIDUE))


def extract_chains(atoms: DataFrame, chains: Sequence[str], chain: str = "chain") -> DataFrame:
    """Atoms of the named chains; a name that no atom has is an error."""
    have = {r[0] for r in atoms.where(F.col(chain).isin(*chains)).select(chain).distinct().collect()}
    if missing := [c for c in chains if c not in have]:
        raise ValueError(f"chains not found: {', '.join(missing)}")
    return atoms.where(F.col(chain).isin(*chains))


def chain_sequences(atoms: DataFrame) -> DataFrame:
    """(file, seq) in one-letter codes; a structure of several chains is an error."""
    r = residues(atoms).withColumn("aa", residue_letter(F.col("resname")))
    out = r.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "aa"))).alias("s"), F.count_distinct("chain").alias("n"))
    seq = F.array_join(F.transform("s", lambda x: x["aa"]), "")
    return out.select("file", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several chains in "), "file")).cast("string")).otherwise(seq).alias("seq"))


def domain_table(table: DataFrame, key: str, boundaries: str, order: str = "ordinal") -> DataFrame:
    """(id, domain_no, boundary): the first row of an id counts; a missing value gives one row with a null boundary."""
    from ..functions.text import strip_structure_suffix

    first = table.groupBy(strip_structure_suffix(F.col(key)).alias("id")).agg(F.min_by(boundaries, order).alias("b"))
    parts = F.when(is_missing(F.col("b")), F.array(F.lit(None).cast("string"))).otherwise(F.split("b", ","))
    return first.select("id", F.posexplode(parts).alias("domain_no", "boundary"))


def domain_residues(atoms: DataFrame, domains: DataFrame, min_length: int = 1) -> DataFrame:
    """(file, id, label, resseq): residues of each domain that is long enough.

    Labels are ``__DUNK`` for a structure without known domains (all its residues), ``__DFULL`` where a domain is the whole chain,
    and otherwise ``__D`` and the boundary. Every structure needs a row of domains.
    """
    own = atoms.select("file", F.regexp_replace(F.substring_index("file", "/", -1), r"(?i)\.(pdb|cif|mmcif|ent)$", "").alias("id"), "resseq").distinct()
    size = own.groupBy("file", "id").agg(F.count("*").alias("n"))
    d = size.join(domains, "id", "left").withColumn("boundary", F.when(F.col("domain_no").isNull(), F.raise_error(F.concat(F.lit("no domains for "), "id")).cast("string")).otherwise(F.col("boundary")))
    known = d.where("boundary is not null").select("file", "id", "domain_no", "boundary", "n", F.array_distinct(range_residues(F.col("boundary"))).alias("r")).where(F.size("r") >= min_length)
    hit = known.select("file", "id", "domain_no", "boundary", "n", F.explode("r").alias("resseq"), F.size("r").alias("k")).join(own, ["file", "id", "resseq"])
    w = Window.partitionBy("file", "id", "domain_no")
    hit = hit.withColumn("found", F.count("*").over(w))
    label = F.when((F.col("found") == F.col("n")) & (F.col("k") == F.col("n")), "__DFULL").otherwise(F.concat(F.lit("__D"), "boundary"))
    unknown = d.where("domain_no is not null and boundary is null").select("file", "id").join(own, ["file", "id"]).select("file", "id", F.lit("__DUNK").alias("label"), "resseq")
    return hit.select("file", "id", label.alias("label"), "resseq").unionByName(unknown)


def extract_domains(atoms: DataFrame, domains: DataFrame, min_length: int = 1) -> DataFrame:
    """Atoms of each domain, with its ``label``."""
    return atoms.join(domain_residues(atoms, domains, min_length).select("file", "resseq", "label"), ["file", "resseq"])


def range_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], point: str, start: str, end: str, bin_size: int = 256) -> DataFrame:
    """Points within intervals of their group: both are dealt to bins, so a group's rows need not meet in one task."""
    p = points.withColumn("_bin", F.floor(F.col(point) / bin_size))
    i = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    return p.join(i, [*by, "_bin"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_bin")


def near_pairs(one: DataFrame, two: DataFrame, reach: float, by: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of points closer than ``reach``, as structs ``a`` and ``b`` with their ``distance``.

    Space is cut into cells as wide as the reach; one side is copied to its 27 cells, so every pair meets in one equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    a = one.select(*by, F.struct(*one.columns).alias("a"), *(cell(c).alias(f"_{c}") for c in axes))
    b = two.select(*by, F.struct(*two.columns).alias("b"), *(cell(c).alias(f"_{c}") for c in axes))
    for c in axes:
        b = b.withColumn(f"_{c}", F.explode(F.array(F.col(f"_{c}") - 1, F.col(f"_{c}"), F.col(f"_{c}") + 1)))
    pairs = a.join(b, [*by, *(f"_{c}" for c in axes)])
    square = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in axes), F.lit(0.0))
    return pairs.withColumn("distance", F.sqrt(square)).where(F.col("distance") < reach).select(*by, "a", "b", "distance")


def radius(element: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in RADII.items() for x in pair))
    return F.coalesce(F.try_element_at(table, element), F.lit(0.0))


def contacts(atoms: DataFrame) -> DataFrame:
    """(file, chain1, resseq1, chain2, resseq2): residues of the two chains with touching atoms. Structures need two chains."""
    first = Window.partitionBy("file")
    ranked = atoms.where("model = 0").withColumn("_c", F.min("atom_ordinal").over(Window.partitionBy("file", "chain")))
    ranked = ranked.withColumn("_first", F.col("_c") == F.min("_c").over(first)).withColumn("_r", radius(F.col("element")))
    cols = ["file", "chain", "resseq", "icode", "x", "y", "z", "_r"]
    reach = 2 * max(RADII.values()) + GAP
    pairs = near_pairs(ranked.where("_first").select(*cols), ranked.where("not _first").select(*cols), reach, ["file"])
    touching = pairs.where(F.col("distance") < F.col("a._r") + F.col("b._r") + GAP)
    return touching.select("file", F.col("a.chain").alias("chain1"), F.col("a.resseq").alias("resseq1"), F.col("b.chain").alias("chain2"), F.col("b.resseq").alias("resseq2")).distinct()


def matrix_cells(df: DataFrame, matrix: str, by: Sequence[str] = ("file",), value: str = "value") -> DataFrame:
    """Long form (i, j, value) of a matrix column, from 0."""
    rows = df.select(*by, F.posexplode(matrix).alias("i", "row"))
    return rows.select(*by, "i", F.posexplode("row").alias("j", value))


def interaction_summary(atoms: DataFrame, scores: DataFrame, delimiter: str = "__", pae_cutoff: float = 5) -> DataFrame:
    """One row a structure: its two names, mean error over interacting residues, their number, the interface's residues, whether a
    cluster of the error matrix spans both chains, and the chains' lengths. ``scores`` (file, pae) has the structure's file."""
    from ..functions.text import component_names

    r = residues(atoms.where("model = 0"))
    chains = r.groupBy("file", "chain").agg(F.count("*").alias("n"), F.min("ordinal").alias("o"))
    chains = chains.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("c"))
    chains = chains.select("file", F.when(F.size("c") == 2, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("two chains are needed in "), "file")).cast("array<struct<o:bigint,n:bigint>>")).alias("c"))
    chains = chains.select("file", F.col("c")[0]["n"].alias("n1"), F.col("c")[1]["n"].alias("n2"))
    pairs = contacts(atoms).join(chains, "file").join(scores.select("file", "pae"), "file")
    cell = F.try_element_at(F.try_element_at("pae", F.col("resseq1").cast("int")), (F.col("resseq2") + F.col("n1")).cast("int"))
    per = pairs.select("file", cell.alias("e"), "chain1", "resseq1", "chain2", "resseq2")
    total = per.groupBy("file").agg(F.avg("e").alias("average_pae"), F.count("*").alias("interactions"), (F.count_distinct("chain1", "resseq1") + F.count_distinct("chain2", "resseq2")).alias("interface_residues"))
    cross = scores.select("file", "pae").join(chains, "file").groupBy("file").applyInPandas(_crossing(pae_cutoff), "file string, cross_chain_cluster boolean")
    names = component_names(F.col("file"), delimiter)
    out = chains.join(total, "file", "left").join(cross, "file", "left")
    return out.select("file", names[0].alias("member1"), names[1].alias("member2"), "average_pae", F.coalesce("interactions", F.lit(0)).alias("interactions"), F.coalesce("interface_residues", F.lit(0)).alias("interface_residues"), "cross_chain_cluster", "n1", "n2")


def _crossing(cutoff: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        row = part.iloc[0]
        pae = np.array([list(r) for r in row["pae"]])
        n1 = int(row["n1"])
        spans = any(min(c) < n1 <= max(c) for c in error_clusters(pae, cutoff=cutoff))
        return pd.DataFrame({"file": [row["file"]], "cross_chain_cluster": [spans]})

    return run


def error_clusters(pae, power: float = 1, cutoff: float = 5, resolution: float = 1) -> list[set[int]]:
    """Communities of residues whose mutual error is below the cutoff, by greedy modularity.

    Edges weigh 1 / error ** power. Starting from single residues, the pair of communities whose union gains most modularity is
    merged, the least pair of equals first, until no union gains.
    """
    import numpy as np

    pae = np.maximum(np.asarray(pae, float), 1e-9)
    n = len(pae)
    near, weight = pae < cutoff, pae**-power
    below, above = np.where(np.tril(near, -1), weight, 0.0).T, np.where(np.triu(near, 1), weight, 0.0)
    w = np.where(below > 0, below, above)  # an edge given in both directions has its last weight, in row order
    w = w + w.T + np.diag(np.diag(np.where(near, weight, 0.0)))
    degree = w.sum(1) + np.diag(w)
    m = degree.sum() / 2
    members = {i: {i} for i in range(n)}
    if m == 0:
        return list(members.values())
    gain = w / m - resolution * np.outer(degree, degree) / (2 * m * m)
    gain[w == 0] = -np.inf
    np.fill_diagonal(gain, -np.inf)
    between = w.copy()
    alive = np.ones(n, bool)
    while True:
        at = int(gain.argmax())
        i, j = divmod(at, n)
        if not gain[i, j] > 0:
            break
        i, j = min(i, j), max(i, j)
        members[i] |= members.pop(j)
        between[i] += between[j]
        between[:, i] += between[:, j]
        degree[i] += degree[j]
        alive[j] = False
        between[j], between[:, j] = 0, 0
        gain[j], gain[:, j] = -np.inf, -np.inf
        fresh = between[i] / m - resolution * degree[i] * degree / (2 * m * m)
        fresh[(between[i] == 0) | ~alive] = -np.inf
        fresh[i] = -np.inf
        gain[i], gain[:, i] = fresh, fresh
    return sorted(members.values(), key=lambda s: (-len(s), min(s)))


def classify_members(members: Column, boundary: Column) -> Column:
    """struct(chain1, chain2): how many 0-based members lie on each side of a chain's length."""
    return F.struct(F.size(F.filter(members, lambda m: m < boundary)).alias("chain1"), F.size(F.filter(members, lambda m: m >= boundary)).alias("chain2"))


def contact_probability(logits: Column, edges: Column, cutoff: float = 8.0) -> Column:
    """Probability that a distance lies in the bins whose edge is at most the cutoff: a softmax over all bins, summed."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    n = F.size(F.filter(edges, lambda b: b <= cutoff))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    p = total(F.slice(e, F.lit(1), n)) / total(e)
    return F.when(n == 0, F.raise_error(F.lit("no bin lies within the cutoff")).cast("double")).otherwise(p)


def max_contact_probability(distograms: DataFrame, first_length: str, by: Sequence[str] = ("file",), cutoff: float = 8.0) -> DataFrame:
    """(*by, contact_probability): the greatest over residues of the first chain against the others."""
    rows = distograms.select(*by, F.col(first_length).alias("_n"), F.size("logits").alias("_size"), "bin_edges", F.posexplode("logits").alias("i", "row"))
    ok = (F.col("_n") > 0) & (F.col("_n") < F.col("_size"))
    rows = rows.withColumn("_n", F.when(ok, F.col("_n")).otherwise(F.raise_error(F.lit("the first chain must end within the matrix")).cast("int"))).where("i < _n")
    cells = rows.select(*by, "bin_edges", F.explode(F.slice("row", F.col("_n") + 1, F.size("row"))).alias("logits"))
    return cells.groupBy(*by).agg(F.max(contact_probability(F.col("logits"), F.col("bin_edges"), cutoff)).alias("contact_probability"))
