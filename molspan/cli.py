"""Commands: ``python -m molspan <command> --help``. Reads come from alignment files or Parquet folders."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molspan.functions import marks
from molspan.operators import call, contexts, controls, diagnose, duplicates, extract, posteriors, reads
from molspan.sources import alignments, models

Command = Callable[[SparkSession, argparse.Namespace], int]
COMMANDS: dict[str, tuple[Command, Callable[[argparse.ArgumentParser], None], str]] = {}


def command(name: str, arguments: Callable[[argparse.ArgumentParser], None], about: str) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        COMMANDS[name] = (f, arguments, about)
        return f

    return add


# Input and output


def is_alignments(path: str) -> bool:
    if path.endswith(".bam"):
        return True
    try:
        return bool(alignments.list_files(path))
    except (FileNotFoundError, OSError, ValueError):
        return False


def read_input(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The reads of --input, of the chosen contigs or region, without training reads left out (they are flagged)."""
    if is_alignments(a.input):
        alignments.register(spark)
        source = spark.read.format("alignments")
        for name in ("region", "split_bytes"):
            if getattr(a, name, None):
                source = source.option(name, str(getattr(a, name)))
        rows = source.load(a.input)
    else:
        rows = spark.read.parquet(a.input)
    if "chrom" in rows.columns:
        chosen = alignments.contig_filter(rows, chroms=getattr(a, "chroms", None), main=getattr(a, "skip_scaffolds", False))
        rows = chosen.unionByName(rows.where("chrom IS NULL")) if getattr(a, "unmapped", False) else chosen
    if getattr(a, "train_reads", None):
        rows = models.flag_trained(rows, models.training_ids(spark, a.train_reads))
    return rows


def version_key(text: str) -> tuple[int, ...]:
    """A version as numbers, so that 2.10 comes after 2.9; what follows the numbers is left out."""
    m = re.match(r"v?(\d+(?:\.\d+)*)", text.strip())
    return tuple(map(int, m[1].split("."))) if m else ()


def write_output(spark: SparkSession, a: argparse.Namespace, rows: DataFrame, *, marker: bool = True) -> None:
    """--output as alignment files (with --format bam, which needs such an input) or Parquet."""
    if a.format == "parquet":
        rows.write.mode("overwrite").parquet(a.output)
        return
    text, names = alignments.file_header(alignments.list_files(a.input)[0][0])
    text = alignments.with_program(text, "molspan", command=" ".join(sys.argv), about=a.command)
    alignments.write(rows, a.output, names, alignments.with_marker(text) if marker else text)
    if a.join:
        alignments.sort_and_index(spark, alignments.join_files(a.output, a.join, names, text))


def shared(p: argparse.ArgumentParser, *, model: bool = False) -> None:
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--format", choices=["parquet", "bam"], default="parquet")
    p.add_argument("--join", help="one indexed alignment file beside the folder")
    p.add_argument("--region")
    p.add_argument("--split-bytes", type=int)
    p.add_argument("--chroms", nargs="+")
    p.add_argument("--skip-scaffolds", action="store_true")
    p.add_argument("--max-reads", type=int)
    p.add_argument("--mode", choices=["pacbio-fiber", "nanopore-fiber", "daf", *sorted(marks.ALIASES)])
    if model:
        p.add_argument("-m", "--model")
        p.add_argument("--models", help="folder of models by enzyme", default=os.environ.get("MOLSPAN_MODELS", "."))
        p.add_argument("--enzyme", choices=sorted({e for e, _ in models.MODES}))
        p.add_argument("--platform", "--seq", choices=["pacbio", "nanopore"])


def filters(p: argparse.ArgumentParser, mapq: int, length: int, threshold: int) -> None:
    p.add_argument("--min-mapq", type=int, default=mapq)
    p.add_argument("--min-length", type=int, default=length)
    p.add_argument("-p", "--threshold", type=int, default=threshold)
    p.add_argument("--train-reads", help="list (column rid) of molecules to pass by")
    p.add_argument("--primary-only", action="store_true")


def saved_model(spark: SparkSession, a: argparse.Namespace, tool: str) -> models.Saved:
    if a.model:
        return models.load(a.model, spark=spark if "://" in a.model else None)
    if not a.enzyme:
        raise SystemExit("a model or an enzyme is needed")
    return models.load(models.registered(a.models, a.enzyme, tool, a.platform))


def mode(a: argparse.Namespace, rows: DataFrame, saved: models.Saved) -> str:
    told = models.mode_of(a.enzyme, a.platform) if getattr(a, "enzyme", None) else saved.mode
    return models.resolve_mode(a.mode, None if told != "unknown" else diagnose.sniff_mode(rows), told)


# Calls


def call_arguments(p: argparse.ArgumentParser) -> None:
    shared(p, model=True)
    filters(p, 0, 1000, 128)
    p.add_argument("--trim", type=int, default=10)
    p.add_argument("--msp-min-size", type=int, default=0)
    p.add_argument("--nuc-min-size", type=int, default=85)
    p.add_argument("--min-llr", type=float)
    p.add_argument("--min-opps", type=int, default=3)
    p.add_argument("--unify", type=int, default=90)
    p.add_argument("--split-llr", type=float, default=4.0)
    p.add_argument("--split-opps", type=int, default=3)
    p.add_argument("--phase", default="auto", help="auto, off, or the repeat length")
    p.add_argument("--profile", help="radial profile (JSON)")
    p.add_argument("--no-recall-nucs", action="store_true")
    p.add_argument("--scores", action="store_true")
    p.add_argument("--circular", action="store_true")
    p.add_argument("--downstream-compat", action="store_true")
    p.add_argument("--no-msps", action="store_true")
    p.add_argument("--no-legacy-tags", action="store_true")
    p.add_argument("--reference", help="FASTA, where MD texts are missing")
    p.add_argument("--dedup", action="store_true", help="collapse duplicates first")
    p.add_argument("--unmapped", action="store_true", help="call unmapped reads, too")


def options(a: argparse.Namespace, saved: models.Saved, way: str) -> call.Options:
    least = a.min_llr if a.min_llr is not None else call.MIN_LLR.get(a.enzyme or "", 5.0)
    return call.Options(
        mode=way, k=saved.k, trim=a.trim, threshold=a.threshold, nuc_min=a.nuc_min_size, msp_min=a.msp_min_size, recall=not a.no_recall_nucs, min_llr=least, min_opps=a.min_opps, unify=a.unify, split_llr=a.split_llr, split_opps=a.split_opps,
        repeat=int(a.phase) if a.phase.isdigit() else 0, profile=models.profile(a.profile) if a.profile else None, scores=a.scores, circular=a.circular, compat=a.downstream_compat, min_mapq=a.min_mapq, min_length=a.min_length, primary_only=a.primary_only, unmapped=a.unmapped,
    )


def tag_choice(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Without patches, or without the older tags, where that is asked for."""
    gone = [*(["as", "al", "aq"] if a.no_msps else []), *(["ns", "nl", "nq", "as", "al", "aq"] if a.no_legacy_tags else [])]
    return rows.withColumns({c: F.lit(None).cast(dict(rows.dtypes)[c]) for c in gone}) if gone else rows


def called(spark: SparkSession, a: argparse.Namespace, tool: str) -> int:
    rows = read_input(spark, a)
    saved = saved_model(spark, a, "apply" if tool != "recall" else "recall")
    o = options(a, saved, mode(a, rows, saved))
    if o.mode == "daf":
        diagnose.check_deaminase_input(rows, has_reference=bool(a.reference))
        if a.reference:
            rows = alignments.with_reference(rows, alignments.reference(spark, a.reference))
    if a.dedup:
        rows = deduplicated(rows, flag=False).drop("di", "ds", "is_duplicate")
    if a.max_reads:  # of those that are called
        rows = rows.where(call.reason_column(rows, o).isNull()).limit(a.max_reads)
    second = None
    if tool == "call" and not a.model and a.enzyme:
        second = models.load(models.registered(a.models, a.enzyme, "recall", a.platform)).model
    if a.phase == "auto" and o.recall and o.profile is None and tool != "apply":
        o = replace(o, repeat=call.estimate_repeat(rows, saved.model, o, second=second))
    if tool == "apply":
        made = call.apply(rows, saved.model, o)
    elif tool == "recall":
        made = call.recall_tagged(rows, saved.model, replace(o, molecular=a.input_frame != "query" and (a.input_frame == "molecular" or not is_alignments(a.input) or alignments.has_marker(alignments.file_header(alignments.list_files(a.input)[0][0])[0]))))
    else:
        made = call.call(rows, saved.model, o, second=second)
    write_output(spark, a, tag_choice(made, a))
    return 0


@command("call", call_arguments, "footprints, nucleosomes and binding calls in one pass")
def run_call(spark: SparkSession, a: argparse.Namespace) -> int:
    return called(spark, a, "call")


@command("apply", call_arguments, "footprints and patches by the chain alone")
def run_apply(spark: SparkSession, a: argparse.Namespace) -> int:
    return called(spark, a, "apply")


def recall_arguments(p: argparse.ArgumentParser) -> None:
    call_arguments(p)
    p.set_defaults(threshold=125)
    p.add_argument("--input-frame", choices=["auto", "molecular", "query"], default="auto")


@command("recall-tfs", recall_arguments, "binding calls in reads that are tagged already")
def run_recall_tfs(spark: SparkSession, a: argparse.Namespace) -> int:
    a.no_recall_nucs = True
    return called(spark, a, "recall")


@command("recall-nucs", recall_arguments, "nucleosomes with refined edges, and binding calls, in tagged reads")
def run_recall_nucs(spark: SparkSession, a: argparse.Namespace) -> int:
    return called(spark, a, "recall")


# Features, duplicates, deaminations


def extract_arguments(p: argparse.ArgumentParser) -> None:
    shared(p)
    p.add_argument("-t", "--types", nargs="+", choices=[*extract.FEATURES, *extract.ALIASES])
    p.add_argument("--min-tq", type=int, default=50)
    p.add_argument("-p", "--threshold", type=int, default=125)
    p.add_argument("--block-scores", action="store_true")
    p.add_argument("--circular-groups", action="store_true")
    p.add_argument("--haplotypes", action="store_true")
    p.add_argument("--no-scores", action="store_true")
    p.add_argument("--sample")


@command("extract", extract_arguments, "features as sorted BED12 lines, with table definitions and contig sizes")
def run_extract(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = read_input(spark, a)
    kinds = diagnose.outputs_to_write(list(a.types or extract.FEATURES), rows, explicit=bool(a.types))
    names = alignments.contigs(spark, a.input) if is_alignments(a.input) else None
    extract.write_bed(rows, a.output, tuple(kinds), sample=a.sample or extract.sample_of_file(a.input), block_scores=a.block_scores, circles=a.circular_groups, haplotypes=a.haplotypes, contigs=names, min_tq=a.min_tq, threshold=a.threshold, scored=not a.no_scores)
    return 0


def deduplicated(rows: DataFrame, *, threshold: float = 0.95, least: int = 10, flag: bool = True) -> DataFrame:
    """rows plus di, ds (cluster and its size, where it has several) and is_duplicate; without flag duplicates go.

    Molecules are compared by the reference places of their deaminations, within contig and
    strand; the best of a cluster (primary, mapping quality, aligned bases, fewest changes)
    stays. Those with fewer than ``least`` places stay.
    """
    numbered = rows.withColumn("__row", F.concat_ws("|", "read_id", F.coalesce(F.col("flag"), F.lit(0)), F.coalesce(F.col("chrom"), F.lit("")), F.coalesce(F.col("ref_start"), F.lit(-1))))
    found = extract.features(numbered.withColumn("read_id", F.col("__row")), ("deam",), threshold=0)
    places = found.select(F.col("name").alias("id"), F.concat_ws("|", "chrom", "strand").alias("scope"), F.transform("chromStarts", lambda x: (x + F.col("chromStart")).cast("long")).alias("items"))
    clusters = duplicates.clusters(places, group="scope", threshold=threshold, least=least).where("size > 1")
    nm = F.coalesce(F.col("nm"), F.lit(0)) if "nm" in rows.columns else F.lit(0)
    best = [F.col("flag").bitwiseAND(0x900) == 0, F.col("mapq"), F.coalesce(F.col("ref_end") - F.col("ref_start"), F.lit(0)), -nm]
    held = numbered.join(clusters.select(F.col("id").alias("__row"), F.col("cluster").alias("di"), F.col("size").cast("int").alias("ds")), "__row", "left")
    top = held.where("di IS NOT NULL").groupBy("di").agg(F.max_by("__row", F.struct(*[b.alias(f"b{k}") for k, b in enumerate(best)], F.col("__row").alias("tie"))).alias("__top"))
    out = held.join(top, "di", "left").withColumn("is_duplicate", F.coalesce(F.col("__top") != F.col("__row"), F.lit(False)))
    out = out.withColumn("flag", F.when(F.col("is_duplicate"), F.col("flag").bitwiseOR(0x400)).otherwise(F.col("flag"))) if flag else out.where(~F.col("is_duplicate"))
    return out.select(*rows.columns, "di", "ds", "is_duplicate")


def dedup_arguments(p: argparse.ArgumentParser) -> None:
    shared(p)
    p.add_argument("--threshold", type=float, default=0.95)
    p.add_argument("--min-sites", type=int, default=10)
    p.add_argument("--flag", action="store_true", help="mark duplicates instead of leaving them out")
    p.add_argument("--clusters", help="table of clusters and their sizes")


@command("dedup", dedup_arguments, "duplicates by their deaminations: left out or flagged")
def run_dedup(spark: SparkSession, a: argparse.Namespace) -> int:
    from molspan.session import cut

    made = cut(deduplicated(read_input(spark, a), threshold=a.threshold, least=a.min_sites, flag=True))
    if a.clusters:
        made.where("di IS NOT NULL").groupBy(F.col("di").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n_reads")).orderBy("cluster_id").write.mode("overwrite").csv(a.clusters, sep="\t", header=True)
    write_output(spark, a, made if a.flag else made.where(~F.col("is_duplicate")), marker=False)
    return 0


def encode_arguments(p: argparse.ArgumentParser) -> None:
    shared(p)
    filters(p, 20, 1000, 0)
    p.add_argument("--reference")
    p.add_argument("--strand", choices=["CT", "GA"])


@command("daf-encode", encode_arguments, "deaminations written into sequences as Y and R")
def run_encode(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = read_input(spark, a)
    rows = rows.where((F.col("mapq") >= a.min_mapq) & (F.length("seq") >= a.min_length) & (F.col("flag").bitwiseAND(0x904) == 0))
    if a.reference:
        rows = alignments.with_reference(rows, alignments.reference(spark, a.reference))
    from molspan.session import cut

    made = cut(marks.stamped(rows, forced=a.strand))
    print(json.dumps(diagnose.change_summary(made).first().asDict()))
    write_output(spark, a, made.where("st IS NOT NULL"), marker=False)
    return 0


# Posteriors, tables, training


def posterior_arguments(p: argparse.ArgumentParser) -> None:
    shared(p, model=True)
    p.add_argument("--trim", type=int, default=100)


@command("posteriors", posterior_arguments, "chances of protection by base, as tables by contig or gzipped lines (.tsv)")
def run_posteriors(spark: SparkSession, a: argparse.Namespace) -> int:
    rows, saved = read_input(spark, a), saved_model(spark, a, "apply")
    way = mode(a, rows, saved)
    posteriors.write(posteriors.export(rows, saved.model, mode=way, k=saved.k, trim=a.trim), a.output, mode=way, context_size=saved.k)
    return 0


def probs_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("-a", "--accessible", nargs="+", required=True)
    p.add_argument("-u", "--inaccessible", nargs="+", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--mode", default="pacbio-fiber")
    p.add_argument("-k", "--context-sizes", nargs="+", type=int, default=[3, 4, 5, 6])
    p.add_argument("--max-reads", type=int, default=100_000)
    filters(p, 20, 1000, 128)


@command("probs", probs_arguments, "tables of mark rates by context from controls")
def run_probs(spark: SparkSession, a: argparse.Namespace) -> int:
    top, tables = max(a.context_sizes), {}
    for name, paths in (("accessible", a.accessible), ("inaccessible", a.inaccessible)):
        rows = None
        for path in paths:
            part = read_input(spark, argparse.Namespace(input=path))
            kept = controls.funnel(part, min_mapq=a.min_mapq, min_length=a.min_length).where("reason = 'processed'").limit(a.max_reads)
            part = kept.select("seq", "mm", "ml", "flag", "mapq")
            rows = part if rows is None else rows.unionByName(part)
        from molspan.session import cut

        counts = cut(controls.control_counts(rows, mode=a.mode, k=top, threshold=a.threshold, min_mapq=a.min_mapq, min_length=a.min_length))
        for k, table in ((k, controls.tables_by_k(counts, top, [k]).drop("k", "ratio")) for k in a.context_sizes):
            models.write_probabilities(table, f"{a.output}/{name}_k{k}.tsv")
            tables[name, k] = table
    for k in a.context_sizes:
        both = contexts.joined_tables(tables["accessible", k], tables["inaccessible", k])
        models.write_table(both, f"{a.output}/combined_k{k}.tsv")
    return 0


def train_arguments(p: argparse.ArgumentParser) -> None:
    shared(p)
    filters(p, 20, 1000, 125)
    p.add_argument("-a", "--accessible", required=True, help="table of mark rates")
    p.add_argument("-u", "--inaccessible", required=True, help="table of mark rates")
    p.add_argument("-k", "--context-size", type=int, default=3)
    p.add_argument("-n", "--reads", type=int, default=500)
    p.add_argument("--restarts", type=int, default=10)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--trim", type=int, default=10)
    p.add_argument("--adjust", type=float, default=1.0)


@command("train", train_arguments, "start and transition chances of a chain, by expectation and maximisation")
def run_train(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = read_input(spark, a).where((F.col("flag").bitwiseAND(0x904) == 0) & (F.col("mapq") >= a.min_mapq) & (F.length("seq") >= a.min_length))
    way = models.resolve_mode(a.mode, diagnose.sniff_mode(rows), None)
    rates = [models.probabilities(spark, t).select("context", "ratio").collect() for t in (a.accessible, a.inaccessible)]  # at most 4 ** 2k rows each
    by = [{r["context"]: r["ratio"] for r in t} for t in rates]
    table = {c: (by[0].get(c, 0.0), by[1].get(c, 0.0)) for c in {*by[0], *by[1]}}
    centre = "C" if way == "daf" else "A"
    start = models.from_parts([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], models.emissions(table, a.context_size, centre, adjust=a.adjust), ordered=False)
    from molspan.session import cut

    chosen = cut(controls.sample_reads(rows, a.reads, a.seed))
    found = controls.train_all(controls.training_rows(controls.top_up(chosen, a.reads, a.seed), mode=way, k=a.context_size, trim=a.trim, threshold=a.threshold), start, restarts=a.restarts)
    best = models.Saved(found[0][0], a.context_size, way)
    models.write_training(a.output, best, found, {"reads": chosen.count(), "restarts": a.restarts, "seed": a.seed})
    chosen.select(F.col("read_id").alias("rid")).coalesce(1).write.mode("overwrite").csv(os.path.join(a.output, "training-reads.tsv"), sep="\t", header=True)
    return 0


def utils_arguments(p: argparse.ArgumentParser) -> None:
    sub = p.add_subparsers(dest="tool", required=True)
    for name, more in (("convert", [("output", {}), ("--by-symbol", {"action": "store_true"})]), ("inspect", []), ("adjust", [("output", {}), ("--state", {"type": int, "choices": [0, 1], "required": True}), ("--factor", {"type": float, "required": True})])):
        q = sub.add_parser(name)
        q.add_argument("model")
        for argument, settings in more:
            q.add_argument(argument, **settings)
    q = sub.add_parser("transfer")
    q.add_argument("--target", required=True, help="reads whose emissions are wanted")
    q.add_argument("--reference", help="tagged reads of another kind, for the accessibility of contexts")
    q.add_argument("--accessibility-priors", help="table of them instead")
    q.add_argument("-o", "--output", required=True)
    q.add_argument("--mode", default="pacbio-fiber")
    q.add_argument("-k", "--context-size", type=int, default=3)
    q.add_argument("--min-obs", type=int, default=100)
    q.add_argument("-p", "--threshold", type=int, default=125)
    q = sub.add_parser("sample")
    q.add_argument("definition", help="table definition to name the sample in")
    q.add_argument("--sample")


@command("utils", utils_arguments, "convert, inspect, adjust and transfer models; name the sample of a table definition")
def run_utils(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.tool == "sample":
        with open(a.definition, encoding="utf-8") as file:
            text = extract.with_sample(file.read(), a.sample or extract.sample_of_file(a.definition.removesuffix(".as")))
        with open(a.definition, "w", encoding="utf-8") as file:
            file.write(text)
        return 0
    if a.tool == "transfer":
        centre = "C" if a.mode == "daf" else "A"
        priors = models.priors(spark, a.accessibility_priors) if a.accessibility_priors else controls.footprint_contexts(read_input(spark, argparse.Namespace(input=a.reference)), k=a.context_size, centre=centre)
        rows = controls.with_marks(read_input(spark, argparse.Namespace(input=a.target)), mode=a.mode, threshold=a.threshold)
        target = contexts.mark_counts(rows, k=a.context_size, centre=centre)
        found = controls.transfer(target, priors, least=a.min_obs)
        names = [c for _, c in controls_contexts(a.context_size, centre)]
        for name, p in (("accessible", found.p_acc), ("inaccessible", found.p_prot)):
            models.write_table(spark.createDataFrame([(c, p) for c in names], "context string, ratio double"), f"{a.output}/{name}_k{a.context_size}.tsv")
        print(json.dumps(found.__dict__))
        return 0
    saved = models.load(a.model)
    if a.tool == "inspect":
        print(json.dumps(models.inspect(saved), indent=2))
    elif a.tool == "convert":
        models.save(saved, a.output, by_symbol=a.by_symbol)
    else:
        models.save(models.adjusted(saved, a.state, a.factor), a.output)
    return 0


def controls_contexts(k: int, centre: str) -> list[tuple[int, str]]:
    from molspan.functions.encoding import iter_contexts

    return list(iter_contexts(k, centre))


def report_arguments(p: argparse.ArgumentParser) -> None:
    shared(p)
    p.add_argument("--sample-reads", type=int)
    p.add_argument("--seed", type=int, default=42)


@command("report", report_arguments, "what footprints and patches look like: a table, a text and histograms")
def run_report(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = read_input(spark, a).where("ns IS NOT NULL OR `as` IS NOT NULL")
    if a.sample_reads:
        rows = reads.sample(rows, "read_id", a.sample_reads, a.seed)
    rows = rows.withColumn("read_length", F.length("seq"))
    found = reads.footprint_report(rows)
    models.write_table(found, f"{a.output}/summary.tsv")
    spark.createDataFrame([(reads.report_text(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.output}/summary.txt")
    for name, sizes in (("footprint_sizes", "nl"), ("msp_sizes", "al")):
        models.write_table(reads.histogram(rows.select(F.explode(sizes).alias("n")), "n", 10), f"{a.output}/{name}.tsv")
    return 0


@command("run", lambda p: None, "gone; use call")
def run_run(spark: SparkSession, a: argparse.Namespace) -> int:
    print("there is no such command any more; use call", file=sys.stderr)
    return 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="molspan", description=__doc__)
    p.add_argument("--version", action="version", version="0.2.0")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, arguments, about) in COMMANDS.items():
        arguments(sub.add_parser(name, help=about, description=about))
    return p


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "run":
        return run_run(None, a)
    spark = spark or SparkSession.builder.appName(f"molspan {a.command}").getOrCreate()
    try:
        return COMMANDS[a.command][0](spark, a)
    except (ValueError, KeyError, FileNotFoundError) as error:
        print(f"molspan {a.command}: {error}", file=sys.stderr)
        return 2
