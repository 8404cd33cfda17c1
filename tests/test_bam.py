"""Binary alignment files: written by tasks, read in parts, indexed, and read by place."""

import random
from struct import pack

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinseg.sources import bam, bamrows, tables

CONTIGS = [("1", 3_000_000), ("chr2", 500_000)]
COLUMNS = ["qname", "flag", "chrom", "ref_idx", "start", "end", "mapq", "cigar", "mate_ref_idx", "mate_start", "tlen", "seq", "qual", "tags"]


def record(rng, n, at):
    size = rng.choice([1, 36, 101, 3000 if n % 97 == 0 else 50])
    cigar = rng.choice([f"{size}M", f"{size}M", "*"] + [f"{size - 11}M3D6I5S"] * (size > 11))
    mapped = n % 13 > 0
    return {
        "qname": f"r{n // 2}:{'x' * (n % 40)}", "flag": rng.choice([0, 16, 99, 147, 2048]) if mapped else 4,
        "chrom": CONTIGS[n % 2][0] if mapped else "*", "start": at if mapped else 0, "mapq": rng.randrange(61), "cigar": cigar if mapped else "*",
        "mate_ref_idx": n % 2 if n % 3 else None, "mate_start": at + 7 if n % 3 else 0, "tlen": rng.randrange(-500, 500),
        "seq": "".join(rng.choice("ACGTN") for _ in range(size)) if n % 17 else "*", "qual": "*" if n % 5 == 0 or n % 17 == 0 else "".join(chr(33 + rng.randrange(60)) for _ in range(size)),
        "tags": {"XA": "chr1,+5", "NM": "2"} if n % 4 == 0 else {},
    }


SCHEMA = "qname string, flag int, chrom string, start int, mapq int, cigar string, mate_ref_idx int, mate_start int, tlen int, seq string, qual string, tags map<string,string>"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """(folder, its records): reads along two contigs in the order of their places, in three files."""
    rng = random.Random(4)
    rows = [record(rng, n, 1 + 40 * (n // 2) + rng.randrange(30)) for n in range(9_000)]
    path = str(tmp_path_factory.mktemp("bam") / "reads")
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    bam.write_bam(df.repartitionByRange(3, "chrom", "start").sortWithinPartitions("chrom", "start"), path, CONTIGS, "kid")
    return path, rows


def plain(df):
    return sorted((tuple(sorted(r.items()) if isinstance(r, dict) else r for r in row) for row in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("split", [9_000, 70_000, 1 << 30])
def test_records_come_back_whatever_the_parts(spark, made, split):
    path, rows = made
    found = bam.read_bam(spark, path, split=split)
    assert split > 1 << 20 or found.rdd.getNumPartitions() > 8
    names = [n for n, _ in CONTIGS]
    from pyspark.sql.types import StructType

    want = spark.createDataFrame([tuple(r.values()) for r in rows], StructType.fromDDL(SCHEMA))
    want = want.withColumn("ref_idx", F.when(F.col("chrom") == names[0], 0).when(F.col("chrom") == names[1], 1)).withColumn("end", bam.end_position().cast("int"))
    assert plain(found) == plain(want)
    assert {r.sample for r in found.select("sample").distinct().collect()} == {"kid"}
    order = [(r.ord, r.qname) for r in found.filter("chrom = '1'").orderBy("ord").select("ord", "qname", "start").collect()]
    assert len({o for o, _ in order}) == len(order)


def test_each_part_begins_at_a_record_of_its_own(made):
    """Every guess of a record's beginning is one that a reading from the start of the file meets."""
    path = bam.files(made[0])[0]
    head, blocks = bam.header(path), bam.Blocks(path)
    known = [here for here, _, _ in bam.records(blocks, head.end, blocks.size << bam.OFFSET)]
    met = set()
    for low in range(0, blocks.size, 1_500):
        at = blocks.first(low)
        guess = bam.record_start(blocks, at, blocks.size, len(head.names)) if at << bam.OFFSET >= head.end else head.end
        want = next((k for k in known if k >= max(at << bam.OFFSET, head.end)), None)
        assert guess == want
        met.add(guess)
    assert len(met) > 5


def test_the_text_form_holds_the_same(spark, made, tmp_path):
    path, rows = made
    lines = ["@HD\tVN:1.6", *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in CONTIGS), "@RG\tID:1\tSM:kid"]
    for r in rows:
        mate = CONTIGS[r["mate_ref_idx"]][0] if r["mate_ref_idx"] is not None else "*"
        lines.append("\t".join(map(str, [r["qname"], r["flag"], r["chrom"], r["start"], r["mapq"], r["cigar"], mate, r["mate_start"], r["tlen"], r["seq"], r["qual"], *(f"{k}:Z:{v}" for k, v in r["tags"].items())])))
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    assert plain(tables.sam(spark, str(tmp_path / "x.sam"))) == plain(bam.read_bam(spark, path))


def test_tags_of_all_kinds():
    data = b"NMC\x05" + b"ASs" + pack("<h", -3) + b"XFf" + pack("<f", 1.5) + b"XCAq" + b"XZZab c\0" + b"XBBS" + pack("<iHH", 2, 7, 65_000) + b"XIi" + pack("<i", -70_000) + b"NMC\x09"
    assert bam.tags(data, 0) == {"NM": "5", "AS": "-3", "XF": "1.5", "XC": "q", "XZ": "ab c", "XB": "S,7,65000", "XI": "-70000"}


@pytest.mark.parametrize("low, high, want", [(0, 1, 4681), (16383, 16384, 4681), (16383, 16385, 585), (0, 1 << 29, 0), ((1 << 26) - 1, (1 << 26) + 1, 0), (1 << 26, (1 << 26) + 5, 4681 + (1 << 12))])
def test_bins(spark, low, high, want):
    assert bam.bin_of(low, high) == want
    assert spark.range(1).select(bam.bin_column(F.lit(low), F.lit(high)).alias("b")).first().b == want


def test_indexed_reads_take_few_blocks(spark, made, tmp_path):
    """Reads of some places equal a filter of all reads; of the file's blocks few are named."""
    path, _ = made
    every = bam.read_bam(spark, path, extra=True)
    bam.build_index(every).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for places in ([(0, 20_000, 20_200), (1, 5_000, 5_010), (0, 20_100, 20_900)], [(0, 1, 1 << 29), (1, 1, 3)], [(1, 499_000, 500_000)], [(0, 90_000, 80_000)]):
        windows = spark.createDataFrame(places, "ref_idx int, start int, end int")
        got = plain(bam.indexed_reads(spark, path, index, windows))
        inside = " or ".join(f"(ref_idx = {r} and start <= {b} and greatest(end, start) >= {a} and {a} <= {b})" for r, a, b in places)
        assert got == plain(every.filter(inside)), places
    few = bam.stretches(index, spark.createDataFrame([(0, 100_000, 100_100)], "ref_idx int, start int, end int")).collect()
    paths, read, total = bam.files(path), 0, 0
    for r in few:
        blocks = bam.Blocks(paths[r.file])
        mask = (1 << bam.FILE) - 1
        list(bam.records(blocks, r.begin & mask, r.stop & mask))
        read += blocks.read
    for p in paths:
        blocks = bam.Blocks(p)
        list(bam.records(blocks, bam.header(p).end, blocks.size << bam.OFFSET))
        total += blocks.read
    assert 0 < read <= total / 3


def test_empty_files_and_folders(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    bam.write_bam(df, str(tmp_path / "none"), CONTIGS, "kid")
    (tmp_path / "none" / "_part.bam").write_bytes(b"left by a task that failed")
    assert bam.read_bam(spark, str(tmp_path / "none"), "kid").count() == 0
    (tmp_path / "text.bam").write_bytes(b"no such thing")
    with pytest.raises(Exception, match="no block begins"):
        bam.read_bam(spark, str(tmp_path / "text.bam"), "kid").count()


def test_more_files_than_a_byte_counts(spark, tmp_path):
    """Places of records in files beyond the 128th are whole numbers that tell them apart."""
    n = 140
    df = spark.createDataFrame([(f"r{i}", 0, "1", 1 + i, 60, "4M", None, 0, 0, "ACGT", "IIII", {}) for i in range(n)], SCHEMA)
    bam.write_bam(df.repartitionByRange(n, "start"), str(tmp_path / "many"), CONTIGS, "kid")
    found = bam.read_bam(spark, str(tmp_path / "many")).select("ord", "qname").collect()
    assert len(bam.files(str(tmp_path / "many"))) > 128
    assert sorted(r.qname for r in found) == sorted(f"r{i}" for i in range(n)) and len({r.ord for r in found}) == n and min(r.ord for r in found) > 0


def test_parts_begin_at_records_where_their_bytes_look_like_longer_ones(spark, tmp_path):
    """Two bytes before a record of the first contig, at places from 65,537 to 98,304, its own size and place read like the head of one of 7 MB."""
    rows = [(f"q{100_000 + i}", 65, "1", 65_537 + 4 * i, 30, "32M", 0, 65_800 + 4 * i, 300, "ACGT" * 8, "I" * 32, {"XO": str(1_000_000 + i)}) for i in range(8_000)]
    bam.write_bam(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "like"), CONTIGS, "kid")
    path = bam.files(str(tmp_path / "like"))[0]
    head, blocks = bam.header(path), bam.Blocks(path)
    known = [here for here, _, _ in bam.records(blocks, head.end, blocks.size << bam.OFFSET)]
    starts = [at for at in sorted({k >> bam.OFFSET for k in known}) if at << bam.OFFSET > head.end]
    assert len(starts) > 8
    for at in starts:
        assert bam.record_start(blocks, at, blocks.size, len(head.names)) == next(k for k in known if k >= at << bam.OFFSET)
    found = bam.read_bam(spark, path, split=10_000).select("qname", "start", "tags").collect()
    assert sorted((r.qname, r.start, r.tags["XO"]) for r in found) == [(r[0], r[3], r[11]["XO"]) for r in rows]


def test_an_index_comes_from_one_reading_and_reads_by_place_from_many_tasks(spark, made, tmp_path, monkeypatch):
    """Stretches that go on over chunks of a file are read by the task of each chunk, and the index scans the files once."""
    path, _ = made
    found = bam.build_index(bam.read_places(spark, path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 1
    found.write.parquet(str(tmp_path / "index"))
    monkeypatch.setattr(bam, "CHUNK", 12)
    every = bam.read_bam(spark, path, extra=True)
    windows = spark.createDataFrame([(0, 1, 1 << 28), (1, 70_000, 100_000), (1, 9, 3)], "ref_idx int, start int, end int")
    got = bam.indexed_reads(spark, path, spark.read.parquet(str(tmp_path / "index")), windows)
    assert got.rdd.getNumPartitions() >= sum(bam.Blocks(f).size for f in bam.files(path)) >> 12 > 8
    assert plain(got) == plain(every.filter("ref_idx = 0 or (start <= 100000 and greatest(end, start) >= 70000)").filter("ref_idx is not null"))


@pytest.mark.parametrize("taken", [1, 500, 100_000])
def test_stretches_of_a_file_hold_the_records_that_are_met_one_by_one(made, taken):
    path = bam.files(made[0])[1]
    blocks, begin = bam.Blocks(path), bam.header(path).end
    want = list(bam.records(blocks, begin, blocks.size << bam.OFFSET))
    for low, high in ((0, len(want)), (7, 40), (len(want) - 1, len(want)), (5, 5)):
        stop = want[high][0] if high < len(want) else blocks.size << bam.OFFSET
        got = [(int(h), int(a), text[p + 4 : p + 4 + len(w[2])]) for text, places, here in bam.stretch(blocks, want[low][0], stop, taken) for p, h, a, w in zip(places, here, here[1:], want[low + sum(x < here[0] for x, _, _ in want[low:]) :])]
        assert got == want[low:high]


def test_tags_of_many_records_at_a_time():
    """Numbers, letters, lists, fractions and equal names, of records of any number of tags."""
    rng = random.Random(3)
    kinds = [b"c\xfb", b"C\xfb", b"s" + pack("<h", -300), b"S" + pack("<H", 65_000), b"i" + pack("<i", -70_000), b"I" + pack("<I", 4_000_000_000), b"Ab", b"Z\0", b"Zxy z\0", "Zé\0".encode(), b"H1AE3\0"]
    odd = [b"f" + pack("<f", 0.25), b"BS" + pack("<iHH", 2, 7, 9), b"BZ"[:1] + b"f" + pack("<if", 1, 1.5)]
    texts = [b"".join(bytes([65 + rng.randrange(3), 65 + i]) + rng.choice(kinds + odd * (n % 5 == 0)) for i in range(rng.randrange(5))) + (b"NMZa\0NMZb\0" if n % 7 == 0 else b"") for n in range(300)]
    ends = np.cumsum([len(t) for t in texts])
    text = b"".join(texts)
    got = bamrows.tag_column(text, np.frombuffer(text, np.uint8), ends - [len(t) for t in texts], ends).to_pylist()
    assert [dict(g) for g in got] == [bam.tags(t, 0) for t in texts]


def test_records_that_do_not_fit_are_refused(spark, tmp_path):
    good = ("r", 0, "1", 5, 60, "4M", None, 0, 0, "ACGT", "IIII", {})
    for at, value in ((0, "n" * 300), (4, 300), (10, "II"), (11, {"LONG": "x"})):
        with pytest.raises(Exception, match="ValueError"):
            bam.write_bam(spark.createDataFrame([good[:at] + (value,) + good[at + 1 :]], SCHEMA), str(tmp_path / f"bad{at}"), CONTIGS, "kid")
