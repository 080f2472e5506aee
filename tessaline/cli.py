"""Command line: ``python -m tessaline.cli COMMAND --options``. Each command reads files, applies an operator and writes a table.

Outputs are folders of part files; ``--single`` writes one part.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import sequences as S
from .functions.numbers import fixed3
from .functions.text import file_stem
from .operators import alignments as A
from .operators import clusters as C
from .operators import structures as X
from .operators import taxonomy as N
from .sources import remote, sequences, sinks, structures, tables

Command = Callable[[SparkSession, argparse.Namespace], None]
COMMANDS: dict[str, tuple[Command, list[tuple]]] = {}
RANKS = ",".join(N.RANKS)


def command(*options: tuple) -> Callable[[Command], Command]:
    def put(f: Command) -> Command:
        COMMANDS[f.__name__] = (f, list(options))
        return f

    return put


def opt(*names: str, default=None, required: bool = False, kind: type = str, flag: bool = False, nargs=None) -> tuple:
    return names, {"action": "store_true"} if flag else {"default": default, "required": required, "type": kind, **({"nargs": nargs} if nargs else {})}


def need(*names: str, kind: type = str, nargs=None) -> tuple:
    return opt(*names, required=True, kind=kind, nargs=nargs)


def yes(text: str) -> bool:
    """Truth of yes/no words."""
    t = text.lower()
    if t in ("yes", "true", "t", "y", "1"):
        return True
    if t in ("no", "false", "f", "n", "0"):
        return False
    raise argparse.ArgumentTypeError("yes or no")


def _nodes(spark: SparkSession, path: str):
    """The node table (taxid, parent, rank, name) as Parquet or as tab-separated text with a header."""
    return spark.read.parquet(path) if path.endswith(".parquet") else tables.scan_table(spark, path, tables.PLAIN).drop("ordinal")


def _names(spark: SparkSession, args):
    return N.lineages(_nodes(spark, args.taxonomy))


@command(need("-a", "--alignment_file"), need("-o", "--output_file"), opt("-f", "--alignment_fields", default=""), opt("-x", "--filter_field", default="alntmscore"), opt("-m", "--min_val", default=0.4, kind=float), opt("-M", "--max_val", default=1.0, kind=float))
def aln_filter(spark, a):
    df = tables.scan_table(spark, a.alignment_file, tables.FILTER, a.alignment_fields)
    kept = A.range_filter(df, a.filter_field, a.min_val, a.max_val, strict=True)
    sinks.write_table(kept.withColumn(a.filter_field, F.col(a.filter_field).cast("double")), a.output_file, single=a.single, order=["ordinal"])


@command(need("-a", "--alignment_file"), need("-o", "--output_file"), opt("-f", "--alignment_fields", default=""), need("-n", "--n_alignments", kind=int), opt("-q", "--query_column", default="query"), opt("-s", "--sort_column", default=""), opt("-r", "--random_seed", default=42, kind=int))
def aln_sample(spark, a):
    df = tables.scan_table(spark, a.alignment_file, tables.NESTED, a.alignment_fields)
    cols = [c for c in df.columns if c != "ordinal"]
    out = A.top_n(df, a.n_alignments, a.query_column, a.sort_column) if a.sort_column else A.sample_n(df, a.n_alignments, a.query_column, cols, a.random_seed)
    sinks.write_table(out, a.output_file, cols, single=a.single, order=["ordinal"])


@command(need("-a", "--alignment_file"), need("-o", "--output_file"), opt("-c", "--colnames", default=""))
def aln_cigar_to_cov(spark, a):
    df = tables.scan_table(spark, a.alignment_file, tables.LOOSE, a.colnames, required=["cigar", "qlen", "tlen"])
    out = A.add_cigar_coverage(df)
    sinks.write_table(out.withColumns({c: fixed3(F.col(c)) for c in ("cigar_qcov", "cigar_tcov")}), a.output_file, single=a.single, order=["ordinal"])


@command(need("-1", "--aln1"), need("-2", "--aln2"), need("-o", "--output"), opt("-f", "--aln1_fields", default=""), opt("-F", "--aln2_fields", default=""), opt("-s", "--aln1_source", default=""), opt("-S", "--aln2_source", default=""))
def aln_merge(spark, a):
    one, two = (tables.scan_alignments(spark, p, f).drop("ordinal") for p, f in ((a.aln1, a.aln1_fields), (a.aln2, a.aln2_fields)))
    sinks.write_table(A.merge(one, two, a.aln1_source, a.aln2_source), a.output, single=a.single)


@command(need("-a", "--alignment_file"), need("-u", "--uniprot_information"), need("-o", "--outfile"), opt("-f", "--alignment_fields", default=""))
def aln_add_uniprot(spark, a):
    df = tables.scan_alignments(spark, a.alignment_file, a.alignment_fields)
    sinks.write_table(A.add_uniprot(df, tables.scan_name_lookup(spark, a.uniprot_information)), a.outfile, single=a.single, order=["ordinal"], guard=True)


@command(need("-a", "--alignment_file"), need("-c", "--cluster_file"), need("-r", "--rep_out"), need("-n", "--nr_out"), opt("-f", "--alignment_fields", default=""), opt("-l", "--linkage_threshold", default=0.5, kind=float))
def aln_add_clusters(spark, a):
    aln, clusters = tables.scan_alignments(spark, a.alignment_file, a.alignment_fields).drop("ordinal"), tables.scan_pairs(spark, a.cluster_file)
    every, rep = C.add_clusters(aln, C.super_clusters(clusters, aln, a.linkage_threshold))
    sinks.write_table(every, a.nr_out, single=a.single)
    sinks.write_table(rep, a.rep_out, single=a.single)


@command(need("-c", "--cluster_file"), need("-o", "--outfile"), opt("-F", "--cluster_file_fields", default=""))
def aln_connection_map(spark, a):
    df = tables.scan_clusters(spark, a.cluster_file, a.cluster_file_fields)
    if missing := {"family", "species"} - set(df.columns):
        raise ValueError(f"the cluster file has no column {', '.join(sorted(missing))}")
    sinks.write_table(C.connection_map(df), a.outfile, single=a.single)


@command(need("-a", "--alignment_file"), need("-o", "--outdir"), opt("-f", "--alignment_fields", default=""))
def aln_create_pairwise_aln_fasta(spark, a):
    df = tables.scan_table(spark, a.alignment_file, tables.LOOSE, a.alignment_fields, required=["query", "target", "qaln", "taln"])
    sinks.write_files(A.pairwise_fastas(df, qseq="qaln", tseq="taln"), a.outdir)


def _blocks(spark, a):
    return structures.scan_dali_blocks(spark, a.aln_file, tables.scan_structure_key(spark, a.key) if a.key else None)


@command(need("-i", "--aln_file"), opt("-k", "--key", default=""), need("-o", "--outfile"))
def aln_dali_alignment_attributes(spark, a):
    sinks.write_csv(A.dali_attributes(_blocks(spark, a)), a.outfile, single=a.single)


@command(need("-i", "--aln_file"), opt("-k", "--key", default=""), need("-m", "--motif"), need("-o", "--outfile"))
def aln_dali_motif_finder(spark, a):
    found = A.dali_motif(_blocks(spark, a), a.motif).select("aln_number", "query", "target", "query_id", "target_id", "z")
    sinks.write_table(found, a.outfile, header=False, single=a.single)


@command(need("-i", "--aln_file"), opt("-k", "--key", default=""), need("-o", "--outdir"))
def aln_dali_to_pairwise_fastas(spark, a):
    sinks.write_files(A.pairwise_fastas(_blocks(spark, a), per_query_dir=False), a.outdir)


@command(need("-a", "--alignment_file"), need("-o", "--output_file"), opt("-c", "--colnames", default=""), opt("-A", "--all_inputs", default=""), opt("-d", "--diagnose", flag=True))
def aln_cluster_connected_component(spark, a):
    df = tables.scan_table(spark, a.alignment_file, tables.LOOSE, a.colnames, ["query", "target"], ["query", "target"])
    if a.diagnose:
        C.graph_diagnostics(df).show(truncate=False)
        C.top_degrees(df).show(truncate=False)
    sinks.write_table(C.component_clusters(df, all_inputs=tables.scan_ids(spark, a.all_inputs) if a.all_inputs else None), a.output_file, single=a.single)


@command(need("-a", "--alignment_file"), need("-o", "--output_file"), opt("-c", "--colnames", default=""), opt("-s", "--score_column", default="alntmscore"), opt("-A", "--all_inputs", default=""), opt("--no_reassign", flag=True))
def aln_cluster_greedy(spark, a):
    df = tables.scan_table(spark, a.alignment_file, tables.LOOSE, a.colnames, ["query", "target", a.score_column], ["query", "target", a.score_column])
    df = df.withColumn(a.score_column, F.col(a.score_column).try_cast("double")).where(F.col(a.score_column).isNotNull())
    sinks.write_table(C.greedy_clusters(df, score=a.score_column, all_inputs=tables.scan_ids(spark, a.all_inputs) if a.all_inputs else None, reassign=not a.no_reassign), a.output_file, single=a.single)


@command(need("-1", "--file1"), need("-2", "--file2"), need("-o", "--output_file"), opt("--file1_colnames", default=""), opt("--file2_colnames", default=""))
def aln_merge_clusters(spark, a):
    one, two = tables.scan_nested_clusters(spark, a.file1, a.file1_colnames), tables.scan_nested_clusters(spark, a.file2, a.file2_colnames).drop("ordinal")
    out = C.merge_cluster_tables(one, two)
    sinks.write_table(out, a.output_file, single=a.single, order=out.columns)


@command(need("-a", "--alignment_file"), need("-s", "--structure_key"), need("-o", "--output_file"), opt("-z", "--min_z", default=0, kind=float), opt("-c", "--min_cov", default=0, kind=float), opt("-l", "--min_alnlen", default=0, kind=float), opt("-r", "--min_rsmd", default=0, kind=float), opt("-d", "--structure_key_delim", default=",,"), opt("-n", "--query_name", default=""), opt("-L", "--qlen_sheet", default=""))
def aln_parse_dali(spark, a):
    key = tables.scan_structure_key(spark, a.structure_key, a.structure_key_delim)
    out = structures.scan_dali_summary(spark, a.alignment_file, key, a.query_name, tables.scan_lengths(spark, a.qlen_sheet) if a.qlen_sheet else None, a.min_cov, a.min_z, a.min_alnlen, a.min_rsmd)
    sinks.write_table(out, a.output_file, single=a.single, order=["ordinal"])


@command(need("-k", "--key"), opt("-t", "--tree", default=""), opt("-T", "--tree_out", default=""), opt("-m", "--matrix", default=""), opt("-M", "--matrix_out", default=""))
def aln_parse_dali_matrix(spark, a):
    if not (a.tree or a.matrix) or bool(a.tree) != bool(a.tree_out) or bool(a.matrix) != bool(a.matrix_out):
        raise ValueError("a tree or a matrix is needed, each with its output")
    key = tables.scan_structure_key(spark, a.key)
    if a.tree:
        names = {r.id: r.structure for r in key.collect()}  # a key file names the leaves of one tree
        rename = F.udf(lambda t: structures.rename_newick(t, names), "string")
        spark.read.text(a.tree, wholetext=True).select(rename("value").alias("value")).coalesce(1).write.mode("overwrite").text(a.tree_out)
    if a.matrix:
        m = structures.rename_matrix(spark, a.matrix, key)
        sinks.write_table(m.orderBy("n").select("name", F.array_join(F.transform("values", lambda v: v.cast("string")), "\t").alias("values")), a.matrix_out, header=False, single=True)


@command(need("-i", "--infile"), need("-o", "--uniprot_lookup_output"), opt("-c", "--infile_col", default=1, kind=int), opt("-u", "--uniprot_cache", default=""), need("--service"))
def aln_query_uniprot(spark, a):
    import json

    ids = tables.scan_accessions(spark, a.infile, a.infile_col)
    service = a.service

    def fetch(batch: list[str]) -> list[dict]:
        return json.loads(remote.http_fetch(service.format(",".join(batch))))["results"]

    cache = spark.read.parquet(a.uniprot_cache) if a.uniprot_cache else None
    out, grown = remote.lookup_with_cache(ids, fetch, cache)
    sinks.write_table(out, a.uniprot_lookup_output, ["accession", "geneName", "fullName"], header=False, single=a.single)
    if a.uniprot_cache:
        grown.write.mode("overwrite").parquet(a.uniprot_cache + ".new")


@command(need("-c", "--cluster_file"), need("-o", "--output_file"), opt("-F", "--cluster_file_fields", default=""), opt("-a", "--alignment_file", default=""), opt("-f", "--alignment_fields", default=""), opt("-t", "--taxonomy_levels", default=RANKS), opt("-d", "--taxonID_finder_delimiter", default="__"), opt("-p", "--taxonID_finder_pos", default=-1, kind=int), need("--taxonomy"))
def aln_taxa_counts(spark, a):
    levels = a.taxonomy_levels.split(",")
    names = N.taxon_table(_names(spark, a), levels)
    aln = tables.scan_alignments(spark, a.alignment_file, a.alignment_fields) if a.alignment_file else None
    out = N.cluster_taxa_counts(tables.scan_clusters(spark, a.cluster_file, a.cluster_file_fields), names, aln, levels, a.taxonID_finder_delimiter, a.taxonID_finder_pos)
    sinks.write_table(out, a.output_file, single=a.single, order=["cluster_ID", "level", "taxon"])


@command(need("-a", "--alignment_file"), need("-c", "--alignment_fields"), need("-f", "--fasta_file"), need("-o", "--output_file"), opt("-s", "--short_aln_type", default=1, kind=int))
def aln_trim_target_fasta(spark, a):
    df = tables.scan_alignments(spark, a.alignment_file, a.alignment_fields)
    if missing := {"tstart", "tend"} - set(df.columns):
        raise ValueError(f"columns not found: {', '.join(sorted(missing))}")
    cut, lost = A.trim_targets(A.extreme_alignments(df, shortest=a.short_aln_type == 1), sequences.scan_fasta(spark, a.fasta_file))
    lost.show(truncate=False)
    sinks.write_fasta(cut, a.output_file, single=a.single, order=["id"])


@command(need("-i", "--infile"), need("-o", "--outfile"), opt("-c", "--colnames", default=""), opt("-t", "--taxonomy_levels", default=RANKS), need("--taxonomy"))
def tab_add_taxonomy(spark, a):
    df = tables.scan_table(spark, a.infile, tables.PLAIN, a.colnames, required=["taxid"])
    sinks.write_table(N.add_taxonomy(df, _names(spark, a), levels=a.taxonomy_levels.split(",")), a.outfile, single=a.single, order=["ordinal"])


@command(need("-s", "--scores"), need("-o", "--out_image"))
def plot_pae(spark, a):
    """The plot's data: the matrix in long form."""
    sinks.write_table(X.matrix_cells(structures.scan_pae(spark, a.scores), "pae"), a.out_image, ["i", "j", "value"], single=a.single)


@command(need("-i", "--in_fasta"), need("-o", "--outfile_dir"))
def seq_split_fasta(spark, a):
    if not a.in_fasta.endswith(".fasta"):
        raise ValueError("a .fasta file is needed")
    df = sequences.scan_fasta(spark, a.in_fasta, keep_last=False)
    sinks.write_files(df.select(F.concat("id", F.lit(".fasta")).alias("path"), F.concat(F.lit(">"), "description", F.lit("\n"), "seq", F.lit("\n")).alias("text")), a.outfile_dir)


@command(need("-i", "--in_fasta"), need("-o", "--out_fasta"), need("-m", "--max_seq_length", kind=int), opt("-s", "--minimum_sequence_output_size", default=50, kind=int), opt("-v", "--overlapping_chunks", default=False, kind=yes), opt("-n", "--individual", default=False, kind=yes))
def seq_chunk(spark, a):
    out = sequences.chunk_sequences(sequences.scan_fasta(spark, a.in_fasta), a.max_seq_length, a.minimum_sequence_output_size, a.overlapping_chunks)
    if a.individual:
        sinks.write_files(out.select(F.concat("id", F.lit(".fasta")).alias("path"), F.concat(F.lit(">"), "id", F.lit("\n"), "seq", F.lit("\n")).alias("text")), a.out_fasta)
    else:
        sinks.write_fasta(out, a.out_fasta, single=a.single, order=["ordinal", "part"])


@command(need("-i", "--infiles"), need("-H", "--header"), need("-o", "--out_file"), opt("-c", "--cardinality", default="2"))
def seq_multimerize(spark, a):
    files = a.infiles.split(",,")
    parts = [sequences.one_sequence_a_file(sequences.scan_fasta(spark, f, keep_last=False)).select(F.lit(i).alias("ordinal"), "seq") for i, f in enumerate(files)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    out = sequences.multimerise(df, [int(n) for n in a.cardinality.split(",,")])
    sinks.write_fasta(out.withColumn("id", F.lit(a.header)), a.out_file, single=True)


@command(need("-i", "--gb"), need("-f", "--out_fasta"), need("-c", "--out_csv"), opt("-d", "--delimiter", default="__"), opt("-n", "--nuc_accs_to_keep", default=""))
def seq_parse_genbank(spark, a):
    df = sequences.genbank_proteins(sequences.scan_genbank(spark, a.gb), a.delimiter, tables.scan_ids(spark, a.nuc_accs_to_keep) if a.nuc_accs_to_keep else None)
    sinks.write_fasta(df, a.out_fasta, "name", "sequence", single=a.single, order=["ordinal", "gene_order"])
    sinks.write_csv(df.orderBy("ordinal", "gene_order").drop("ordinal", "sequence"), a.out_csv, quoted=False, single=a.single)


@command(need("-s", "--structure"), need("-p", "--pae"), need("-o", "--out_file"), opt("-D", "--delimiter", default="__"))
def struc_detect_interaction(spark, a):
    atoms = structures.scan_pdb(spark, a.structure)
    scores = structures.scan_pae(spark, a.pae).select("pae").crossJoin(atoms.select("file").distinct())  # one structure and one file of scores
    sinks.write_table(X.interaction_summary(atoms, scores, a.delimiter).drop("file"), a.out_file, header=False, single=True)


@command(need("-s", "--structure_file"), need("-o", "--out_file"), opt("-c", "--disorder_cutoff", default=50, kind=float), opt("-C", "--order_cutoff", default=60, kind=float), opt("-n", "--n_sequential", default=6, kind=int), opt("-d", "--check_for_domain_len", default=50, kind=int))
def struc_disorder(spark, a):
    r = X.residues(structures.scan_pdb(spark, a.structure_file))
    out = X.disorder(r, "file", "ordinal", "plddt", a.order_cutoff, a.disorder_cutoff, a.n_sequential, a.check_for_domain_len)
    sinks.write_table(out.withColumn("file", file_stem(F.col("file"))), a.out_file, header=False, single=a.single)


@command(need("-i", "--infile"), need("-o", "--output_dir"), opt("-c", "--infile_columns", default="uniprotID"), opt("-d", "--additional_field_delimiter", default="__"), need("--service"))
def struc_download(spark, a):
    names = a.infile_columns.split(",")
    df = tables.scan_table(spark, a.infile, tables.PLAIN, names)
    got = remote.download_models(df, remote.http_fetch, a.service, names[0], names[1:], a.additional_field_delimiter).where("message is null")
    sinks.write_files(got.select(F.explode(F.array(F.struct(F.concat("out_name", F.lit(".pdb")).alias("path"), F.col("pdb").alias("text")), F.struct(F.concat("out_name", F.lit(".json")).alias("path"), F.col("pae").alias("text")))).alias("f")).select("f.*"), a.output_dir)


@command(need("-s", "--structure_file"), need("-c", "--chains"), need("-o", "--output_file"))
def struc_extract_chains(spark, a):
    sinks.write_pdb(X.extract_chains(structures.scan_pdb(spark, a.structure_file), a.chains.split(",")), a.output_file)


@command(need("-m", "--motif"), opt("-s", "--structure", default=""), opt("-f", "--fasta", default=""), opt("-q", "--seq", default=""))
def struc_find_motif(spark, a):
    if a.seq:
        df = spark.createDataFrame([("seq", a.seq)], "id string, seq string")
    elif a.structure:
        df = X.chain_sequences(structures.scan_pdb(spark, a.structure)).withColumnRenamed("file", "id")
    else:
        df = sequences.scan_fasta(spark, a.fasta)
    df.select("id", F.explode(S.motif_matches(F.col("seq"), a.motif)).alias("m")).select("id", "m.*").orderBy("id", "start").show(1_000_000, truncate=False)


@command(need("-i", "--in_dir"), need("-o", "--outfile"), opt("-d", "--distance_cutoff", default=8, kind=float))
def struc_get_contact_probability(spark, a):
    stem = lambda ext: F.regexp_replace(F.substring_index("file", "/", -1), ext + "$", "")
    grams = structures.scan_distograms(spark, a.in_dir + "/*.distogram.json").withColumn("name", stem(r"\.distogram\.json"))
    parts = structures.model_name_parts(F.col("name"))
    a3m = tables.lines(spark, a.in_dir + "/*.a3m").where(F.col("value").startswith("#")).select(F.regexp_replace(F.substring_index("ordinal.file", "/", -1), r"\.a3m$", "").alias("sample"), structures.first_chain_length(F.col("value")).alias("n1"))
    scores = structures.scan_iptm(spark, a.in_dir + "/*.scores.json").select(F.regexp_replace("name", r"\.scores$", "").alias("name"), "iptm")
    df = grams.withColumn("p", parts).select("name", "p.*", "logits", "bin_edges").join(a3m, "sample").join(scores, "name")
    out = X.max_contact_probability(df, "n1", ["sample", "model_type", "rank", "model", "iptm"], a.distance_cutoff)
    sinks.write_table(out, a.outfile, header=False, single=a.single, order=["sample", "rank"])


def _domain_table(spark, path: str, colnames: str):
    """Domain rows as tab-separated text, CSV with a header or JSON lines."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path).withColumn("ordinal", F.monotonically_increasing_id())
    if path.endswith(".json"):
        return spark.read.json(path).withColumn("ordinal", F.monotonically_increasing_id())
    return tables.scan_table(spark, path, tables.PLAIN, colnames)


@command(need("-s", "--structure_file_path"), need("-d", "--domain_file_path"), opt("-c", "--colnames", default=""), need("--domain_column"), opt("-i", "--id_column"), opt("-m", "--min_domain_length", default=1, kind=int), need("-o", "--outfile_dir"))
def struc_get_domains(spark, a):
    table = _domain_table(spark, a.domain_file_path, a.colnames)
    key = a.id_column or next(c for c in table.columns if c != "ordinal")
    found = X.extract_domains(structures.scan_pdb(spark, a.structure_file_path), X.domain_table(table, key, a.domain_column), a.min_domain_length)
    text = sinks.pdb_text(found, ["file", "label"])
    sinks.write_files(text.select(F.concat(file_stem(F.col("file")), "label", F.lit(".pdb")).alias("path"), "text"), a.outfile_dir)


@command(need("-i", "--infile"), need("-o", "--outfile"))
def struc_get_iptm(spark, a):
    sinks.append_table(structures.scan_iptm(spark, a.infile).select("name", "iptm"), a.outfile)


@command(need("-s", "--structure_file_path"), need("-p", "--plddt_cutoff", kind=float))
def struc_qc(spark, a):
    X.quality(X.residues(structures.scan_pdb(spark, a.structure_file_path)), a.plddt_cutoff).show(1_000_000, truncate=False)


@command(need("-s", "--structure_file"), need("-o", "--out_file"))
def struc_rebase(spark, a):
    sinks.write_pdb(X.rebase(structures.scan_pdb(spark, a.structure_file)), a.out_file)


@command(need("-s", "--structure_file"), opt("-o", "--out_file", default=""), opt("-t", "--threads", default=1, kind=int))
def struc_to_plddt(spark, a):
    out = X.mean_plddt(structures.scan_pdb(spark, a.structure_file)).withColumn("file", file_stem(F.col("file"))).orderBy("file")
    if a.out_file:
        sinks.append_table(out, a.out_file)
    else:
        out.show(1_000_000, truncate=False)


@command(need("-s", "--structure_file"), opt("-o", "--out_file", default=""), opt("-H", "--header", default=""), opt("-t", "--threads", default=1, kind=int))
def struc_to_seq(spark, a):
    out = X.chain_sequences(structures.scan_pdb(spark, a.structure_file)).select((F.lit(a.header) if a.header else file_stem(F.col("file"))).alias("id"), "seq")
    if a.out_file:
        sinks.write_fasta(out, a.out_file, mode="append", order=["id"])
    else:
        out.orderBy("id").show(1_000_000, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessaline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        p = sub.add_parser(name)
        for names, settings in options:
            p.add_argument(*names, **settings)
        p.add_argument("--single", action="store_true", help="write one part file")
    return top


def main(argv: list[str] | None = None) -> None:
    from .session import session

    args = parser().parse_args(argv)
    COMMANDS[args.command][0](session(), args)


if __name__ == "__main__":
    main()
