"""Text files of the stages, and the command line from end to end on a small trio."""

import numpy as np
import pytest

from kinseg import cli
from kinseg.sources import bam, tables

from test_bigwig import written
from test_operators import rows

BASES = "".join(np.random.default_rng(8).choice(list("ACGT"), 30_000))


@pytest.mark.parametrize("split", [40, 1000, 10_000_000])
def test_fasta_chunks_across_blocks(spark, tmp_path, split):
    """Contigs are whole whatever blocks a file is read in; blank lines, spaces and text before the first head do not count."""
    contigs = {"a": BASES[:503], "b": "", "c": BASES[600:601], "d": BASES[700:1900]}
    lines = ["lost"]
    for name, text in contigs.items():
        lines += [f"> {name} some words", *(text[i : i + 61] for i in range(0, len(text), 61)), ""]
    (tmp_path / "r.fa").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = rows(tables.fasta(spark, str(tmp_path / "r.fa"), 200), "chrom", "chunk_start", "bases")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = {}
    for chrom, start, bases in found:
        assert start == len(whole.get(chrom, "")) + 1
        whole[chrom] = whole.get(chrom, "") + bases
    assert whole == {name: text for name, text in contigs.items() if text}


def test_pedigree_and_trio(spark, tmp_path):
    (tmp_path / "p.ped").write_text('F c f m 2 2\n\nF\tf\t0\t0\t1\t1\nF "m" 0 0 2 1\nG x 0 0 1 1\n')
    ped = tables.pedigree(spark, str(tmp_path / "p.ped"))
    assert rows(tables.trios(ped), "family_id", "father", "mother", "offspring", "offspring_sex") == [("F", "f", "m", "c", 2)]


def record(name, flag, start, cigar, mate, tlen):
    return "\t".join(map(str, (name, flag, 1, start, 60, cigar, "=", mate, tlen, BASES[start - 1 : start + 99], "*")))


def sam_text(sample, event=None):
    """Pairs 300 bases apart every 25; with an event also pairs and clipped reads that show a deletion or a duplication of 15,001 to 16,000."""
    lines = ["@HD\tVN:1.6", "@SQ\tSN:1\tLN:30000", f"@RG\tID:g\tSM:{sample}"]

    def pair(name, start, size, first="100M", second="100M", flags=(97, 145)):
        mate = start + size - 100
        lines.append(record(name, flags[0], start, first, mate, size))
        lines.append(record(name, flags[1], mate, second, start, -size))

    for i, start in enumerate(range(1, 29_000, 25)):
        pair(f"n{i}", start, 298 + i % 5)
    for i in range(6 if event == "DELETION" else 0):
        pair(f"d{i}", 14_880 + 4 * i, 1_300)
        pair(f"l{i}", 14_931, 1_290, "70M30S")
        pair(f"r{i}", 14_801, 1_300, "100M", "30S70M")
    for i in range(6 if event == "DUPLICATION" else 0):
        pair(f"d{i}", 15_020 + 4 * i, 970, flags=(81, 161))
        pair(f"l{i}", 15_001, 400, "30S70M")
        pair(f"r{i}", 15_631, 400, "100M", "70M30S")
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("event, place", [("DELETION", (15_000, 16_001)), ("DUPLICATION", (15_001, 16_000))])
def test_command_line_finds_a_planted_event(spark, tmp_path, event, place):
    """Text and binary reads, a text or a binary signal, text files between the stages."""
    paths = []
    for sample, own in (("dad", event), ("mum", None), ("kid", event)):
        (tmp_path / f"{sample}.sam").write_text(sam_text(sample, own))
        paths.append(str(tmp_path / f"{sample}.sam"))
    bam.write_bam(tables.sam(spark, paths[2]).coalesce(1), str(tmp_path / "kid.bam"), [("1", 30_000)], "kid")
    paths[2] = str(tmp_path / "kid.bam")
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    bams, ped = put("list", "\n".join(paths) + "\n"), put("t.ped", "T dad 0 0 1 1\nT mum 0 0 2 1\nT kid dad mum 1 2\n")
    reference, signal = put("r.fa", ">1 one\n" + "\n".join(BASES[i : i + 60] for i in range(0, 30_000, 60)) + "\n"), put("m.bg", "chr1\t0\t30000\t1.0\n")
    if event == "DUPLICATION":
        written(tmp_path / "m.bw", "<", [(0, 100 * i, 100 * i + 100, 1.0) for i in range(300)])
        signal = str(tmp_path / "m.bw")
    out = [str(tmp_path / d) for d in ("prepared", "called", "final")]
    cli.main(["preprocess", "--reference", reference, "--bams", bams, "--ped", ped, "--mappability", signal, "--output", out[0]], spark)
    assert rows(tables.parameters(spark, f"{out[0]}/parameters"), "sample", "median") == [("dad", 300), ("kid", 300), ("mum", 300)]
    windows, names = tables.read_depth(spark, f"{out[0]}/windows")
    assert names == ["dad", "mum", "kid"] and {r.mappability for r in windows.filter("end < 29000").collect()} == {1.0}
    cli.main(["call", "--input", out[0], "--ped", ped, "--mappability", signal, "--output", out[1]], spark)
    assert rows(tables.calls(spark, f"{out[1]}/pairs"), "type0", "type1", "type2", "evidence") == [(event, "REFERENCE", event, "RP")]
    cli.main(["refine", "--reference", reference, "--bams", bams, "--ped", ped, "--input", out[1], "--output", out[2]], spark)
    head = next(f for f in (tmp_path / "final").iterdir() if f.name.endswith(".csv")).read_text().splitlines()[0]
    assert head == "#CHROM\tSTART\tEND\tdad\tmum\tkid\tEvidence"
    assert [tuple(r) for r in tables.final_calls(spark, out[2]).collect()] == [("1", *place, event, "REFERENCE", event, "RP:BP")]


def test_places_of_intervals_and_calls_beyond_two_billion_come_back(spark, tmp_path):
    far = 9_000_000_123
    tables.write_tsv(spark.createDataFrame([("1", far, far + 9)], "chrom string, start long, end long"), str(tmp_path / "i"))
    assert rows(tables.intervals(spark, str(tmp_path / "i")), "chrom", "start", "end") == [("1", far, far + 9)]
    call = ("1", far, far + 9, "DELETION", "REFERENCE", "DELETION", "RP")
    tables.write_calls(spark.createDataFrame([call], "chrom string, start long, end long, type0 string, type1 string, type2 string, evidence string"), str(tmp_path / "c"))
    assert [tuple(r) for r in tables.final_calls(spark, str(tmp_path / "c")).collect()] == [call]


def test_pairs_beyond_two_billion_come_back(spark, tmp_path):
    far = [9_000_000_000 + i for i in (0, 99, 400, 499)]
    made = spark.createDataFrame([("a", "1", *far, "DELETION")], "sample string, chrom string, left_first long, right_first long, left_second long, right_second long, sv_type string")
    tables.write_pairs(made, str(tmp_path / "p"))
    assert rows(tables.read_pairs(spark, str(tmp_path / "p")), "left_first", "right_first", "left_second", "right_second", "sv_type") == [(*far, "DELETION")]


def test_no_pairs_are_an_empty_table(spark, tmp_path):
    tables.write_pairs(spark.createDataFrame([], "sample string, chrom string, left_first int, right_first int, left_second int, right_second int, sv_type string"), str(tmp_path / "pairs"))
    assert tables.read_pairs(spark, str(tmp_path / "pairs")).count() == 0


def test_a_sample_outside_the_trio_is_an_error(spark, tmp_path):
    (tmp_path / "x.sam").write_text(sam_text("stranger")[:400])
    (tmp_path / "list").write_text(str(tmp_path / "x.sam"))
    (tmp_path / "t.ped").write_text("T dad 0 0 1 1\nT mum 0 0 2 1\nT kid dad mum 1 2\n")
    with pytest.raises(Exception, match="sample outside the trio"):
        cli.trio_reads(spark, str(tmp_path / "list"), str(tmp_path / "t.ped")).collect()
