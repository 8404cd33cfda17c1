"""Assembly of reads with errors, and split alignment against the full matrix."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinseg.operators import alignment, assembly, refine

from test_operators import rows


def bases(seed, n):
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), n))


def noisy_reads(text, seed, n, length=100, errors=0.01):
    rng = np.random.default_rng(seed)
    out = []
    for at in [0, len(text) - length, *rng.integers(0, len(text) - length + 1, n).tolist()] * 2:
        read = np.array(list(text[at : at + length]))
        wrong = rng.random(length) < errors
        read[wrong] = rng.choice(list("ACGT"), wrong.sum())
        out.append("".join(read))
    return out


def test_reads_with_errors_give_their_text_back(spark):
    """One substitution in a hundred letters, of several calls at once; every call's longest contig is its text, but for a few letters at its ends."""
    texts = {call: bases(call, 700 + 100 * call) for call in range(4)}
    reads = [(call, r) for call, text in texts.items() for r in noisy_reads(text, 50 + call, 140)]
    found = assembly.contigs(spark.createDataFrame(reads, "call_id long, seq string"))
    longest = {r.call_id: r.seq for r in found.filter("contig = 0").collect()}
    for call, text in texts.items():
        assert longest[call] in text and len(longest[call]) > len(text) - 12, call


def test_bubbles_tips_rings_and_short_reads(spark):
    """The commoner side of a bubble goes on, the other is a piece of its own; a ring is cut once; short reads and reads with N count nothing."""
    left, right = bases(1, 80), bases(2, 80)
    ring = bases(3, 60)
    reads = [(1, left + "A" + right)] * 5 + [(1, left + "C" + right)] * 3 + [(2, ring + ring[:12])] * 2 + [(3, "ACGT")] * 4 + [(4, "N" * 60)] * 4 + [(5, bases(4, 50)), (5, None)]
    df = spark.createDataFrame(reads, "call_id long, seq string")
    found = rows(assembly.contigs(df, 13, 2, 13), "call_id", "contig", "seq", "depth")
    assert found[0] == (1, 0, left + "A" + right, pytest.approx(7.84, abs=0.3))
    assert found[1][:2] == (1, 1) and "C" + right[:12] == found[1][2][-13:] and len(found[1][2]) == 25
    assert [f[:2] for f in found[2:]] == [(2, 0)] and len(found[2][2]) == 72 and found[2][2][:12] == found[2][2][-12:]
    assert assembly.contigs(df.limit(0)).count() == 0


def gotoh(q, t):
    """Best local score with affine gaps, cell by cell."""
    no = -(10**6)
    h, e, f = ([[0 if m == 0 else no] * (len(t) + 1) for _ in range(len(q) + 1)] for m in range(3))
    best = 0
    for i in range(1, len(q) + 1):
        h[i][0] = 0
        for j in range(1, len(t) + 1):
            h[0][j] = 0
            e[i][j] = max(h[i][j - 1] - 7, e[i][j - 1] - 1)
            f[i][j] = max(h[i - 1][j] - 7, f[i - 1][j] - 1)
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if q[i - 1] == t[j - 1] else -4), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def score_of(ops, q, t):
    total, i, j = 0, 0, 0
    for run in re.finditer(r"M+|I+|D+", ops):
        n = len(run[0])
        if run[0][0] == "M":
            total += sum(1 if a == b else -4 for a, b in zip(q[i : i + n], t[j : j + n]))
            i, j = i + n, j + n
        else:
            total -= 6 + n
            i, j = (i + n, j) if run[0][0] == "I" else (i, j + n)
    assert (i, j) == (len(q), len(t))
    return total


@pytest.mark.parametrize("seed", range(40))
def test_local_alignments_score_best(seed):
    """Random edits of random letters; the path found scores what it says and what the full matrix says."""
    rng = np.random.default_rng(seed)
    t = bases(seed, 90)
    q = list(t[int(rng.integers(0, 20)) : int(rng.integers(60, 90))])
    for _ in range(int(rng.integers(0, 5))):
        at, n = int(rng.integers(0, len(q))), int(rng.integers(1, 12))
        q[at : at + n * int(rng.integers(0, 2))] = list(bases(seed + 99, int(rng.integers(0, n + 1))))
    q = "".join(q) or "A"
    score, q0, q1, t0, t1, ops = alignment.local_alignment(q, t)
    assert score == gotoh(q, t) == score_of(ops, q[q0:q1], t[t0:t1])


def test_no_match_is_no_alignment():
    assert alignment.local_alignment("AAAA", "CCCC") is None
    assert alignment.local_alignment("", "ACGT") is None and alignment.local_alignment("ACGT", "") is None


SPLIT = "call_id", "contig", "ord", "flag", "start", "end", "mapq", "cigar"


def test_split_secondary_and_edited_contigs(spark):
    w = bases(7, 2000)
    twice = w[:400] + w[100:400] + w[700:1200]
    edited = w[200:260] + w[263:300] + ("A" if w[300] != "A" else "C") + w[301:340] + "ACGTT" + w[340:420]
    contigs = [
        (1, 0, w[100:300] + w[1200:1400]),  # a deletion
        (1, 1, w[500:700]),  # whole
        (2, 0, w[900:1000] + w[600:720]),  # a tandem duplication
        (3, 0, w[150:350]),  # lies in the window twice
        (4, 0, edited),
        (5, 0, bases(8, 300)),  # lies nowhere
        (6, 0, "ACGT"),
    ]
    windows = [(c, twice if c == 3 else w) for c in range(1, 7)]
    found = alignment.split_alignments(spark.createDataFrame(contigs, "call_id long, contig int, seq string"), spark.createDataFrame(windows, "call_id long, bases string"))
    got = rows(found, *SPLIT)
    assert [g[:3] for g in got] == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 0, 1), (3, 0, 0), (3, 0, 1), (4, 0, 0)]
    by = {g[:3]: g[3:] for g in got}
    assert by[1, 1, 0] == (0, 501, 700, 60, "200M")
    first, second = sorted([by[1, 0, 0], by[1, 0, 1]], key=lambda g: g[1])
    assert first[1] == 101 and abs(first[2] - 300) <= 4 and second[2] == 1400 and abs(second[1] - 1201) <= 4
    assert {by[1, 0, 0][0], by[1, 0, 1][0]} == {0, 2048} and "S" in by[1, 0, 0][4] and "H" in by[1, 0, 1][4]
    assert by[3, 0, 0][0] == 0 and by[3, 0, 0][3] == 0 and by[3, 0, 1][0] == 256 and by[3, 0, 1][3] == 0
    assert re.fullmatch(r"\d+M3D\d+M5I\d+M", by[4, 0, 0][4]) and by[4, 0, 0][1:4] == (201, 420, 60)
    calls = spark.createDataFrame([(c, "REFERENCE", "REFERENCE", "DUPLICATION" if c == 2 else "DELETION") for c in range(1, 7)], "call_id long, type0 string, type1 string, type2 string")
    places = rows(alignment.contig_breakpoints(calls, found), "call_id", "start", "end")
    assert places[0] == (1, first[2] + 1, second[1] - 1) and places[1][0] == 2 and len(places) == 2
    assert abs(places[1][1] - 601) <= 4 and abs(places[1][2] - 1000) <= 4


@pytest.mark.parametrize("kind, evidence", [("DELETION", "RP"), ("DUPLICATION", "RD:RP")])
def test_refinement_by_assembly(spark, kind, evidence):
    """Supporting reads with errors across a junction give its place; a call whose reads show none stays only with both kinds of evidence."""
    genome = bases(11, 12_000)
    start, end = 5_001, 6_500
    junction = genome[start - 401 : start - 1] + genome[end : end + 400] if kind == "DELETION" else genome[end - 400 : end] + genome[start - 1 : start + 399]
    reads = noisy_reads(junction, 12, 120)
    other = noisy_reads(genome[8_000:8_700], 13, 120)
    pairs = [(1, f"q{i}", a, b) for i, (a, b) in enumerate(zip(reads[::2], reads[1::2]))] + [(c, f"q{i}", a, b) for c in (2, 3) for i, (a, b) in enumerate(zip(other[::2], other[1::2]))]
    calls = [(1, "1", start + 30, end - 25, evidence), (2, "1", 8_100, 8_600, "RD:RP"), (3, "1", 8_100, 8_600, "RP"), (4, "1", 9_000, 9_900, "RD:RP")]
    df = spark.createDataFrame(calls, "call_id long, chrom string, start long, end long, evidence string").selectExpr("*", f"'{kind}' AS type0", "'REFERENCE' AS type1", f"'{kind}' AS type2")
    supporting = spark.createDataFrame(pairs, "call_id long, qname string, seq1 string, seq2 string").withColumn("bam_ord", F.lit(0))
    reference = spark.createDataFrame([("1", i + 1, genome[i : i + 3_000]) for i in range(0, 12_000, 3_000)], "chrom string, chunk_start int, bases string")
    got = rows(refine.assembled_breakpoints(df, supporting, reference), "start", "end", "evidence")
    assert len(got) == 2 and got[1] == (8_100, 8_600, "RD:RP")
    assert abs(got[0][0] - start) <= 4 and abs(got[0][1] - end) <= 4 and got[0][2] == f"{evidence}:BP"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_kmers_are_never_sent_whole(spark):
    """A few letters of input say nothing about the number of k-mers, so joins of k-mers shuffle."""
    found = assembly.contigs(spark.createDataFrame([(1, "ACGTACGTTT")], "call_id long, seq string"), 5, 1)
    assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    made = spark.createDataFrame([(1, 0, "ACGT" * 10)], "call_id long, contig int, seq string")
    met = alignment.chains(made, made.select("call_id", made.seq.alias("bases")))
    assert "SortMergeJoin" in plan(met) and "BroadcastHashJoin" not in plan(met)


def test_alignments_taken_together_are_those_of_each_pair(monkeypatch):
    """Pairs of unlike sizes share batches, small ones too; long texts, and letters that are no bases."""
    rng = np.random.default_rng(6)
    pairs = [("", "ACGT"), ("ACGT", ""), ("AAAA", "CCCC"), ("\x00\x01é漢", "\x00\x01é?"), (bases(1, 30) + bases(2, 4_100), bases(2, 4_100) + bases(3, 40))]
    for n in range(60):
        t = bases(n, int(rng.integers(1, 90)))
        q = t[: len(t) // 2] + bases(n + 100, int(rng.integers(0, 9))) + t[len(t) // 2 + int(rng.integers(0, 9)) :]
        pairs.append((q, t))
    got = alignment.local_alignments(pairs)
    assert got == [alignment.local_alignment(*p) for p in pairs]
    monkeypatch.setattr(alignment, "ROW", 300)
    assert got == alignment.local_alignments(pairs)
    assert got[3][0] == 4 and got[4][:5] == (4_100, 30, 4_130, 0, 4_100) and got[:3] == [None] * 3
    assert all(found[0] == gotoh(q, t) == score_of(found[5], q[found[1] : found[2]], t[found[3] : found[4]]) for (q, t), found in list(zip(pairs, got))[5:30] if found)


def test_few_bytes_are_dealt_over_all_tasks_and_aligned_once(spark):
    """One small partition of texts gives as many tasks as shuffles have, and no part is aligned twice."""
    w = bases(7, 300)
    made = spark.createDataFrame([(c, 0, w[20:120]) for c in range(8)], "call_id long, contig int, seq string").coalesce(1)
    found = alignment.split_alignments(made, made.select("call_id", F.lit(w).alias("bases")))
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("MapInPandas") == 1 and shown.count("RepartitionByExpression") >= 3
    assert {(r.start, r.end, r.cigar) for r in found.collect()} == {(21, 120, "100M")}


def test_seeds_are_all_stretches_of_a_text(spark):
    texts = [(n, bases(n, n)) for n in (18, 19, 82, 83, 84, 150, 1_280)]
    got = alignment._seeds(spark.createDataFrame(texts, "call_id long, bases string"), "bases", 19, "r").collect()
    assert sorted((r.call_id, r.r, r.kmer) for r in got) == [(n, i, t[i : i + 19]) for n, t in texts for i in range(len(t) - 18)]
