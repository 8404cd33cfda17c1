"""Command line: preprocess, call and refine over files that Spark reads."""

from __future__ import annotations

import argparse
from functools import reduce
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinseg import schemas
from kinseg.operators import refine
from kinseg.plans import api
from kinseg.sources import bam, bigwig, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinseg")
    commands = top.add_subparsers(dest="command", required=True)
    first = commands.add_parser("preprocess")
    for flag in ("--reference", "--bams", "--ped", "--mappability", "--output"):
        first.add_argument(flag, required=True)
    first.add_argument("--window", type=int, default=200)
    first.add_argument("--deviation", type=float, default=9)
    first.add_argument("--min_mapping_quality", type=int, default=0)
    second = commands.add_parser("call")
    for flag in ("--input", "--ped", "--mappability", "--output"):
        second.add_argument(flag, required=True)
    second.add_argument("--exclude")
    second.add_argument("--min_mappability", type=float, default=0)
    second.add_argument("--min_distance", type=int, default=10_000)
    second.add_argument("--transition_prob", type=float, default=1e-5)
    second.add_argument("--mutation_rate", type=float, default=1e-4)
    second.add_argument("--outlier", type=float, default=0.025)
    second.add_argument("--gc_bin_size", type=int, default=1, help="accepted, without effect")
    third = commands.add_parser("refine")
    for flag in ("--reference", "--bams", "--ped", "--input", "--output"):
        third.add_argument(flag, required=True)
    third.add_argument("--size", type=int, default=400)
    third.add_argument("--deviation", type=float, default=9)
    third.add_argument("--assembler", type=named, default=refine.contigs, help="module:function in place of the library's own")
    third.add_argument("--aligner", type=named, default=refine.split_alignments, help="module:function in place of the library's own")
    return top


CALL_COLUMNS = [f.split()[0] for f in schemas.CALLS.split(", ")]


def signal(spark: SparkSession, path: str) -> DataFrame:
    """A binary signal file by its suffix .bw or .bigwig, else a text file."""
    return bigwig.read_bigwig(spark, path) if path.lower().endswith((".bw", ".bigwig")) else tables.signal(spark, path)


def named(name: str):
    """The function that module:function names."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def trio_reads(spark: SparkSession, bams: str, ped: str) -> DataFrame:
    """Records of the listed files, binary (.bam) or text, with sample_idx by the pedigree's first family; a sample outside it is an error."""
    paths = [r.value for r in spark.read.text(bams).collect() if r.value.strip()]
    parts = []
    for i, path in enumerate(paths):
        parts.append(bam.read_bam(spark, path, bam_ord=i) if path.endswith(".bam") else tables.sam(spark, path, bam_ord=i))
    return indexed(reduce(DataFrame.unionByName, parts), trio(spark, ped))


def trio(spark: SparkSession, ped: str) -> list[str]:
    """Father, mother and offspring of the first family."""
    family = tables.trios(tables.pedigree(spark, ped)).orderBy("family_id").first()
    if family is None:
        raise ValueError("the pedigree holds no trio")
    return [family.father, family.mother, family.offspring]


def indexed(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with the sample_idx of their sample."""
    index = rows.sparkSession.createDataFrame(list(zip(names, range(3))), "sample string, sample_idx int")
    both = rows.join(F.broadcast(index), "sample", "left")
    return both.withColumn("sample_idx", F.coalesce("sample_idx", F.raise_error(F.concat(F.lit("sample outside the trio: "), "sample"))))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kinseg").getOrCreate()
    names = trio(spark, args.ped)
    if args.command == "preprocess":
        reads = trio_reads(spark, args.bams, args.ped)
        done = api.preprocess(reads, tables.fasta(spark, args.reference), signal(spark, args.mappability), args.window, args.deviation, args.min_mapping_quality)
        counts = [F.col(f"rd{i}").alias(name) for i, name in enumerate(names)]
        tables.write_tsv(done.windows.select("chrom", "start", "end", *counts, "gc", "mappability"), f"{args.output}/windows", header=True)
        tables.write_tsv(done.parameters.select("sample", "median", "mad"), f"{args.output}/parameters")
        tables.write_pairs(done.pairs, f"{args.output}/pairs")
    elif args.command == "call":
        exclude = tables.intervals(spark, args.exclude) if args.exclude else None
        windows, parameters = tables.read_depth(spark, f"{args.input}/windows")[0], tables.parameters(spark, f"{args.input}/parameters")
        prepared = api.Prepared(windows, parameters, indexed(tables.read_pairs(spark, f"{args.input}/pairs"), names))
        made = api.call(prepared, signal(spark, args.mappability), exclude, args.min_mappability, args.min_distance, args.transition_prob, args.mutation_rate, args.outlier)
        for name, df in zip(("depth", "pairs"), made):
            tables.write_tsv(df.select(*CALL_COLUMNS), f"{args.output}/{name}")
        tables.write_tsv(parameters, f"{args.output}/parameters")
    else:
        reads = trio_reads(spark, args.bams, args.ped)
        depth, pairs = (tables.calls(spark, f"{args.input}/{name}") for name in ("depth", "pairs"))
        final = api.refined(depth, pairs, reads, tables.fasta(spark, args.reference), tables.parameters(spark, f"{args.input}/parameters"), args.size, args.deviation, args.assembler, args.aligner)
        tables.write_calls(final, args.output, names)


if __name__ == "__main__":
    main()
