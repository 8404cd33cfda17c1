"""Small hand-computed cases of each operator."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinseg.functions import alignments, tensors
from kinseg.operators import depth, model, pairs, refine, relops, segment


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def reads(spark, values):
    return spark.createDataFrame(values, "chrom string, sample_idx int, start long").withColumn("flag", F.lit(0)).withColumn("mapq", F.lit(60))


def test_depth_windows_fill_gaps_and_leave_out_the_last(spark):
    r = reads(spark, [("1", 0, 3), ("1", 0, 12), ("1", 1, 35), ("1", 2, 12), ("1", 2, 41)])
    assert rows(depth.depth_windows(r, 10), "start", "end", "rd0", "rd1", "rd2") == [(1, 10, 1, 0, 0), (11, 20, 1, 0, 1), (21, 30, 0, 0, 0), (31, 40, 0, 1, 0)]


def test_depth_of_one_bin_is_empty(spark):
    assert depth.depth_windows(reads(spark, [("1", 0, 3)]), 10).count() == 0


def test_depth_drops_flags_mapq_and_odd_contigs(spark):
    r = spark.createDataFrame([("1", 0, 1, 1024, 60), ("1", 0, 1, 0, 3), ("MT", 0, 1, 0, 60), ("chrX", 0, 1, 0, 60), ("chrX", 0, 25, 0, 60)], "chrom string, sample_idx int, start long, flag int, mapq int")
    assert rows(depth.depth_windows(r, 10, 10), "chrom", "bin", "rd0") == [("chrX", 0, 1), ("chrX", 1, 0)]


@pytest.mark.parametrize("bases, gc", [("N" * 10 + "GG", -1), ("GGCCAATT", 50), ("ggcc", 0), ("GCA", 66), ("", -1)])
def test_gc_percent(spark, bases, gc):
    assert spark.createDataFrame([(bases,)], "b string").select(depth.gc_percent(F.col("b"))).first()[0] == gc


def test_gc_windows_join_chunks_and_shift_by_one(spark):
    text = "AGCTGGCCAATTGCGC"
    chunks = spark.createDataFrame([("c", i + 1, text[i : i + 5]) for i in range(0, len(text), 5)], "chrom string, chunk_start int, bases string")
    want = [(b, 100 * sum(x in "GC" for x in text[b * 4 + 1 : b * 4 + 5]) // len(text[b * 4 + 1 : b * 4 + 5])) for b in range(4)]
    assert rows(depth.gc_windows(chunks, 4), "bin", "gc") == want


def test_interval_mean_signal(spark):
    signal = spark.createDataFrame([("1", 0, 100, 1.0), ("1", 100, 200, 0.5)], "chrom string, start0 int, end0 int, value double")
    calls = spark.createDataFrame([("1", 51, 150), ("2", 1, 5)], "chrom string, start int, end int")
    assert rows(depth.interval_mean_signal(calls, signal, 64), "start", "mappability") == [(1, 0.0), (51, 0.75)]


def test_overlap_join_equals_nested_loop(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [(str(c), int(s), int(s + w)) for c, s, w in zip(rng.integers(0, 2, n), rng.integers(0, 500, n), rng.integers(0, 120, n))]
    a, b = make(80), make(80)
    schema = "chrom string, start int, end int"
    got = relops.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 37)
    want = sorted((*x, *y) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert rows(got, "chrom", "start", "end", "r_chrom", "r_start", "r_end") == want
    kept = relops.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b[:5], schema), 37, "left_anti")
    assert rows(kept, "chrom", "start", "end") == sorted(x for x in a if not any(x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2] for y in b[:5]))


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_overlap_join_of_all_lengths_over_many_levels(spark, how):
    """Lengths from one position to a hundred thousand on both sides, ends that fall on bin ends, repeats, nulls and empty sides."""
    rng = np.random.default_rng(5)

    def make(n: int) -> list[tuple]:
        start = rng.integers(0, 100_000, n) // 9 * 9
        length = (2.0 ** rng.uniform(0, 17, n)).astype(int) * rng.integers(0, 2, n)
        return [(str(c), int(s), int(s + w)) for c, s, w in zip(rng.integers(0, 3, n), start, length)]

    a, b = make(150), make(60)
    a += a[:5]
    schema = "chrom string, start long, end long"
    lone = [(None, 1, 2), ("1", None, 5), ("1", 5, None)]
    meets = lambda x, y: x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]
    for right in (b, b[:1], []):
        got = relops.overlap_join(spark.createDataFrame(a + lone, schema), spark.createDataFrame(right + lone[:2], schema), 9, how, fan=3)
        if how == "inner":
            assert rows(got, "chrom", "start", "end", "r_chrom", "r_start", "r_end") == sorted((*x, *y) for x in a for y in right if meets(x, y))
        else:
            want = [x for x in a if any(meets(x, y) for y in right) == (how == "left_semi")]
            found = [tuple(r) for r in got.select("chrom", "start", "end").collect()]
            assert sorted(r for r in found if None not in r) == sorted(want)
            assert len(found) - len(want) == (0 if how == "left_semi" else len(lone))


@pytest.mark.parametrize("length", [1, 999, 63_000, 65_000, 10**7, 10**9, 3 * 10**10])
def test_the_rows_of_an_interval_are_bounded_at_any_length(spark, length):
    """At its own level an interval lies in at most FAN + 1 bins, at a level above in at most two."""
    widths = relops._levels(1000, relops.FAN)
    one = spark.createDataFrame([("1", 501, 500 + length)], "chrom string, start long, end long")
    everywhere = relops._left_bins(one, F.array(*(F.lit(i) for i in range(len(widths)))), widths, relops.FAN)
    waiting = relops._right_bins(one.toDF("r_chrom", "r_start", "r_end"), widths, relops.FAN)
    most = relops.FAN + 1 + 2 * (len(widths) - 1)
    assert waiting.count() <= most and everywhere.count() <= most + relops.FAN + 1
    assert relops._left_bins(one, F.array(F.lit(0)), widths, relops.FAN).filter("_level >= 0").count() <= relops.FAN + 1


def plain_single_links(pairs_, apart, deletion):
    """Component of each sorted pair by the plain rule, all groups and members kept."""
    owner, groups = [], []
    for p, (a, i, o, f) in enumerate(pairs_):
        near = lambda q: a - q[0] < apart and abs(f - q[3]) < apart and (not deletion or max(i, q[1]) < min(o, q[2]))  # noqa: E731, B023
        home = next((g for g in groups if a - pairs_[g[-1]][0] <= apart and any(near(pairs_[m]) for m in g)), None)
        if home is None:
            groups.append(home := [])
        home.append(p)
        owner.append(home[0])
    return owner


@pytest.mark.parametrize("kind", ["DELETION", "DUPLICATION"])
def test_single_links_equal_the_plain_rule_over_small_batches(spark, kind):
    """Islands that end inside batches of seven rows; groups too small and too large are left out."""
    rng = np.random.default_rng(11)
    left = np.sort(rng.integers(0, 3000, 400))
    rows_ = [("1", kind, int(rng.integers(0, 3)), int(a), int(a + 30), int(a + 40 + d), int(a + 70 + d)) for a, d in zip(left, rng.choice([0, 5, 90, 200], 400))]
    df = spark.createDataFrame(rows_, "chrom string, sv_type string, sample_idx int, left_first long, right_first long, left_second long, right_second long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(pairs.components(df, 40, 3, 20), "island", "sample_idx", *pairs.PLACE, "component")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, island = [], []
    ordered = sorted((*r[3:], r[2]) for r in rows_)
    for i, r in enumerate(ordered):
        if i and r[0] - ordered[i - 1][0] >= 40:
            want, island = want + [island], []
        island.append(r)
    want.append(island)
    out = []
    for number, group in enumerate(want, 1):
        owner = plain_single_links([r[:4] for r in group], 40, kind == "DELETION")
        out += [(number, r[4], *r[:4], o) for r, o in zip(group, owner) if 3 <= owner.count(o) <= 20]
    assert out and got == sorted(out)
    assert max(len(g) for g in want) > 14


def test_open_groups_keep_no_island():
    """Half a million pairs of one island, handed on in parts: what is kept does not grow with it."""
    groups = pairs.OpenGroups(400, True, 3, 499, ("number", *pairs.PLACE))
    kept, given = [], 0
    for part in range(50):
        first = np.arange(part * 10_000, (part + 1) * 10_000) // 2 * 5
        far = first + 3000 + np.arange(10_000) % 7 * 500
        given += sum(1 for _ in groups.take({"number": np.arange(10_000), "left_first": first, "right_first": first + 100, "left_second": far - 100, "right_second": far}))
        kept.append(sum(len(g.near) + len(g.members) for g in groups.groups))
    assert max(kept[1:]) <= kept[1] + 499 and max(kept) < 5_000


@pytest.mark.parametrize("span", [7, 50, 10**9])
def test_scans_in_stretches_equal_a_pass_in_order(spark, span):
    """One contig over many stretches, some of them empty, with ties."""
    rng = np.random.default_rng(3)
    values = sorted((str(c), int(s), int(s + w)) for c, s, w in zip(rng.integers(0, 2, 120), rng.integers(0, 400, 120), rng.integers(0, 9, 120)))
    df = spark.createDataFrame(values, "chrom string, start int, end int")
    want, reach, number = [], {}, {}
    for chrom, start, end in values:
        if start > reach.get(chrom, -1):
            number[chrom] = number.get(chrom, 0) + 1
        want.append((chrom, start, end, number[chrom]))
        reach[chrom] = max(end, reach.get(chrom, -1))
    assert rows(relops.overlapping(df, ["chrom"], span=span), "chrom", "start", "end", "island") == want
    distinct = sorted({v[:2]: v for v in values}.values())
    prior = {"a": ("last", "end"), "b": ("max", "end"), "c": ("sum", "end")}
    seen, expected = {}, []
    for chrom, start, end in distinct:
        ends = seen.setdefault(chrom, [])
        expected.append((chrom, start, ends[-1] if ends else -1, max(ends, default=-1), sum(ends)))
        ends.append(end)
    got = relops.scanned(spark.createDataFrame(distinct, "chrom string, start int, end int"), ["chrom"], ["start"], prior, span).fillna(-1, ["a", "b"])
    assert rows(got, "chrom", "start", "a", "b", "c") == expected
    assert relops.overlapping(df.limit(0), ["chrom"]).count() == 0


def test_runs_gaps_and_majority(spark):
    states = spark.createDataFrame([("1", 0, 1, 200, 2, 2, 1), ("1", 0, 201, 400, 2, 2, 0), ("1", 0, 401, 600, 2, 2, 2), ("1", 0, 601, 800, 4, 2, 1)], "chrom string, contig long, start long, end long, s0 int, s1 int, s2 int")
    runs = segment.state_runs(states)
    assert rows(runs, "start", "end", "s0", "s1", "s2") == [(1, 400, 2, 2, 1), (601, 800, 3, 2, 1)]
    merged = segment.majority_states(segment.gap_clusters(runs))
    assert rows(merged, "start", "end", "s0", "s1", "s2") == [(1, 800, 2, 2, 1)]
    assert rows(segment.annotated(merged, None), "type0", "type1", "type2", "evidence") == [("REFERENCE", "REFERENCE", "DELETION", "RD")]


def test_contigs_by_gap_and_by_length(spark):
    schema = "chrom string, start long, end long"
    near = spark.createDataFrame([("1", 1, 200), ("1", 9801, 10000), ("1", 19602, 19801)], schema)
    assert rows(segment.contigs(near, 10000), "start", "contig") == [(1, 0), (9801, 0), (19602, 1)]
    row = [("1", i * 10 + 1, i * 10 + 10) for i in range(12)]
    want, contig, first, before = [], 0, 1, None
    for _, s, e in row:
        if before and before - first + 1 > 35:
            contig, first = contig + 1, s
        want.append((s, contig))
        before = e
    assert rows(segment.contigs(spark.createDataFrame(row, schema), 100, 35), "start", "contig") == want


def test_transition_tensor_and_inheritance():
    t = tensors.joint_transition()
    assert np.isfinite(t).all() and abs(t[0, 0] + 8.0e-5) < 1e-8 and abs(t[62, 62] + 1.8804e-3) < 1e-7
    assert np.abs(tensors.inheritance().sum(axis=2) - 1).max() < 1e-7
    assert [o for o in range(5) if not tensors.possible()[0, 4, o]] == [0, 4]


def test_viterbi_beats_random_paths_and_ties_go_low():
    rng = np.random.default_rng(2)
    t, s = tensors.joint_transition(), tensors.start_scores()
    e = rng.normal(0, 3, (6, 125))
    score = lambda p: s[p[0]] + e[0, p[0]] + sum(t[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))
    best = score(tensors.viterbi(e, t, s))
    assert all(score(rng.integers(0, 125, 6)) <= best + 1e-9 for _ in range(300))
    two = max(s[a] + e[0, a] + t[a, b] + e[1, b] for a in range(125) for b in range(125))
    assert abs(score(tensors.viterbi(e[:2], t, s)) - two) < 1e-9
    assert (tensors.viterbi(np.zeros((100, 125)), t, s) == 62).all()


def test_emission_edges(spark):
    rows_ = [(0, 50, "1", 1, 7, 0.5), (0, 40, "1", 2, 0, 0.5), (0, 40, "1", 3, 5001, 0.5), (0, 40, "1", 4, 9, 0.5)]
    d = spark.createDataFrame(rows_, "sample_idx int, gc int, chrom string, start int, rd int, mappability double")
    m = spark.createDataFrame([(0, 40, 10.0, 2.0, 0.5)], "sample_idx int, gc int, theta double, coef1 double, coef2 double")
    got = {r.start: r.scores for r in model.emission_scores(d, m).collect()}
    assert got[1] == [0.0] * 5
    assert got[2] == [-1e-100, -1000, -1000, -1000, -1000] and got[3] == [-1000, -1000, -1000, -1000, -1e-100]
    from math import ceil, exp, lgamma, log

    mu = exp(2.25)
    for state, k in enumerate((0.1, 0.5, 1.0, 1.5, 2.0)):
        size = min(10 * k, 500)
        p, r = size / (size + mu * k), ceil(size)
        assert abs(got[4][state] - (lgamma(9 + r) - lgamma(10) - lgamma(r) + r * log(p) + 9 * log(1 - p))) < 1e-8


def test_counts_model_recovers_parameters():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 4000)
    mu = np.exp(1.0 + 2.0 * x)
    y = rng.negative_binomial(8, 8 / (8 + mu))
    theta, a, b = model.fit_counts(y, x)
    assert abs(theta - 8) < 1 and abs(a - 1) < 0.05 and abs(b - 2) < 0.08


def test_models_need_enough_windows(spark):
    w = spark.range(1, 31).select(F.lit("1").alias("chrom"), F.col("id").alias("start"), (F.col("id") % 5).alias("rd0"), F.lit(3).cast("long").alias("rd1"), (F.col("id") % 7).alias("rd2"), F.lit(40).alias("gc"), (F.col("id") % 3 / 3).alias("mappability"))
    assert model.depth_models(w, least=30).count() == 0
    assert rows(model.depth_models(w, least=29), "sample_idx", "gc") == [(0, 40), (1, 40), (2, 40)]


def test_insert_statistics(spark):
    sizes = spark.createDataFrame([("a", x) for x in [*range(1, 101)]], "sample string, x int")
    got = pairs.insert_statistics(sizes).first()
    values = list(range(1, 101))[4:95]
    assert got["median"] == np.median(values) and got["mad"] == np.median(np.abs(np.arange(1, 101) - 50.5))
    padded = pairs.insert_statistics(spark.createDataFrame([("a", 9)] * 3, "sample string, x int"), pad_to=10).first()
    assert padded["median"] == 0


def test_insert_statistics_of_all_pairs_equal_the_plain_ones(spark):
    """Without a limit no pair is left out, and counted sizes have the medians of the sizes one by one."""
    rng = np.random.default_rng(5)
    sizes = {s: rng.integers(100, 160, n).tolist() for s, n in (("a", 1), ("b", 2), ("c", 3_001), ("d", 40))}
    made = spark.createDataFrame([(s, i, 65, 100, 150, 90 + x, x) for s, xs in sizes.items() for i, x in enumerate(xs)], "sample string, ord long, flag int, start int, end int, mate_start int, tlen int")
    made = made.withColumn("flag", F.lit(1 + 64 + 32)).withColumn("tags", F.lit(None).cast("map<string,string>"))
    assert pairs.insert_sizes(made, limit=2_000).count() == 2_043 and pairs.insert_sizes(made, limit=None).count() == 3_044
    got = {r.sample: (r.median, r.mad) for r in pairs.insert_statistics(pairs.insert_sizes(made, limit=None)).collect()}
    want = {}
    for s, xs in sizes.items():
        middle = sorted(xs)[max(int(len(xs) * 0.05) - 1, 0) : int(len(xs) * 0.95)]
        if middle:
            want[s] = float(np.median(middle)), float(np.median(np.abs(np.array(xs) - np.median(xs))))
    assert got == want


def test_pairs_by_name(spark):
    r = spark.createDataFrame([("s", "1", "DELETION", "q", 5000, 5099, 2), ("s", "1", "DELETION", "q", 100, 199, 1), ("s", "1", "DELETION", "z", 7, 9, 3)], "sample string, chrom string, sv_type string, qname string, start int, end int, ord long")
    assert rows(pairs.read_pairs(r), *pairs.PLACE) == [(100, 199, 5000, 5099)]


def test_cluster_clique_and_likelihood(spark):
    schema = "chrom string, sv_type string, sample_idx int, left_first long, right_first long, left_second long, right_second long"
    three = spark.createDataFrame([("1", "DELETION", 2, 901, 1000, 1999, 2300)] * 3, schema)
    apart = pairs.reach(400, 20)
    got = pairs.pair_calls(pairs.components(three, apart), apart, 400, 20)
    assert rows(got, "start", "end", "type0", "type1", "type2", "score", "evidence") == [(1000, 1999, "REFERENCE", "REFERENCE", "DELETION", 3750.0, "RP")]
    assert pairs.pair_calls(pairs.components(three.limit(2), apart), apart, 400, 20).count() == 0


def test_support_rule():
    cases = [((0, 0, 3), True), ((0, 0, 2), False), ((2, 0, 2), True), ((3, 0, 1), True), ((2, 2, 1), False)]
    assert all(bool(pairs.supported(*c)) == want for c, want in cases)


def compatible(rows, apart, deletion):
    """Neighbours of each pair, by the rule for two of them; the gap test looks at the later one only."""
    n = len(rows["left_first"])
    near = [set() for _ in range(n)]
    for j in range(n):
        for i in range(j if not deletion or rows["right_first"][j] < rows["left_second"][j] else 0):
            if abs(rows["left_first"][j] - rows["left_first"][i]) < apart and abs(rows["right_second"][j] - rows["right_second"][i]) < apart:
                near[i].add(j)
                near[j].add(i)
    return near


def cliques_by_search(near):
    best, size, stack = [], 0, [([], set(range(len(near))))]
    while stack:
        clique, open_ = stack.pop()
        if len(clique) > size:
            best, size = [], len(clique)
        if len(clique) == size:
            best.append(clique)
        stack += [([*clique, v], {u for u in open_ & near[v] if u > v}) for v in open_]
    return sorted(best)


def sorted_pairs(rng, n, width):
    first = np.sort(rng.integers(0, width, n))
    inner = first + rng.integers(1, 12, n)
    outer = first + rng.integers(4, 30, n)
    return {"left_first": first, "right_first": inner, "left_second": outer, "right_second": outer + rng.integers(1, 30, n)}


@pytest.mark.parametrize("seed", range(60))
@pytest.mark.parametrize("deletion", [True, False])
def test_largest_cliques_by_search(seed, deletion):
    rng = np.random.default_rng(seed)
    rows_ = sorted_pairs(rng, int(rng.integers(1, 14)), int(rng.integers(1, 40)))
    got = pairs.largest_cliques(rows_, 12.5, deletion)
    assert sorted(got) == cliques_by_search(compatible(rows_, 12.5, deletion))


def test_largest_cliques_of_a_large_component_are_fast():
    import time

    rows_ = sorted_pairs(np.random.default_rng(1), pairs.MOST_PAIRS, 900)
    start = time.process_time()
    found = pairs.largest_cliques(rows_, 150.5, True)
    assert time.process_time() - start < 1
    near = compatible(rows_, 150.5, True)
    assert found and all(v in near[u] for q in found for u in q for v in q if u != v)


def test_exclude_pairs(spark):
    schema = "chrom string, left_first int, right_first int, left_second int, right_second int"
    p = spark.createDataFrame([("1", 100, 199, 400, 499), ("1", 200, 299, 500, 599)], schema)
    region = spark.createDataFrame([("1", 150, 160)], "chrom string, start int, end int")
    assert rows(pairs.exclude_pairs(p, region), "left_first") == [(200,)]


def test_merges_agree_on_simple_cases(spark):
    schema = "chrom string, start long, end long, type0 string, type1 string, type2 string"
    t = ("DELETION", "REFERENCE", "DELETION")
    p = spark.createDataFrame([("1", 100, 200, *t), ("1", 300, 400, *t)], schema)
    d = spark.createDataFrame([("chr1", 140, 240, *t), ("chr1", 380, 600, *t)], schema)
    want = [(100, 200, "RD:RP"), (300, 400, "RP"), (380, 600, "RD")]
    assert rows(refine.merge_calls(p, d), "start", "end", "evidence") == want
    plain = d.withColumn("chrom", F.lit("1"))
    assert rows(refine.reciprocal_overlaps(p, plain), "start", "end", "evidence") == want


def test_breakpoint_windows(spark):
    calls = spark.createDataFrame([(1, "1", 1000, 1200), (2, "1", 1000, 2000)], "call_id long, chrom string, start int, end int")
    assert rows(refine.breakpoint_windows(calls), "call_id", "window", "start", "end") == [(1, 0, 800, 1400), (2, 0, 800, 1200), (2, 1, 1800, 2200)]


def test_mode_takes_the_first_of_equals(spark):
    v = spark.createDataFrame([(1, x, i) for i, x in enumerate([5, 7, 7, 5])], "k int, v int, i int")
    assert rows(refine.mode(v, ["k"], "v", ["i"]), "v", "n") == [(5, 2)]
    assert refine.mode(v.limit(0), ["k"], "v", ["i"]).count() == 0


def test_orientation(spark):
    r = spark.createDataFrame([(32, 100, 199, 300, 300), (16, 300, 399, 100, -300), (0, 100, 199, 300, 300), (16, 100, 199, 300, 300)], "flag int, start int, end int, mate_start int, tlen int")
    assert [x[0] for x in r.select(alignments.orientation()).collect()] == ["FR", "FR", "TANDEM", "RF"]


def test_groups_survive_batch_boundaries(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    df = spark.range(100).select((F.col("id") % 9).alias("k"), "id")
    got = relops.per_group(df, ["k"], ["id"], lambda g: [(g["k"][0], len(g["k"]))], "k long, n long")
    assert rows(got, "k", "n") == [(k, 12 if k == 0 else 11) for k in range(9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_bins_of_intervals_are_never_sent_whole(spark):
    """Calls, their windows and the names met in them shuffle; the table of samples alone is sent to all."""
    place = spark.createDataFrame([("1", 1, 9)], "chrom string, start long, end long")
    assert "BroadcastHashJoin" not in relops.overlap_join(place, place, 10)._jdf.queryExecution().executedPlan().toString()
    reads = spark.createDataFrame([], "sample string, sample_idx int, bam_ord int, ord long, qname string, flag int, chrom string, start long, end long, cigar string, mate_start long, tlen int, seq string")
    calls = spark.createDataFrame([], "call_id long, chrom string, start long, end long, type0 string, type1 string, type2 string")
    parameters = spark.createDataFrame([("a", 250.0, 10.0)], "sample string, median double, mad double")
    text = refine.supporting_pairs(calls, reads, parameters)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in text.splitlines() if "BroadcastHashJoin" in x and "sample#" not in x] == []


def test_near_pairs_take_one_row_and_gaps_hit_nothing(spark):
    """A region between the reads of a pair, near or far, excludes nothing; near pairs enter the join once."""
    rng = np.random.default_rng(3)
    made = [(str(i % 2), a, a + 99, a + 99 + g, a + 198 + g) for i in range(400) for a, g in [(int(rng.integers(1, 60_000)), int(rng.choice([-50, 30, 700, 5_000, 20_000])))]]
    regions = [("0", a, a + int(rng.integers(0, 300))) for a in rng.integers(1, 80_000, 60).tolist()]
    want = sorted(p for p in made if not any(p[0] == c and ((p[1] <= e and s <= p[2]) or (p[3] <= e and s <= p[4])) for c, s, e in regions))
    df = spark.createDataFrame(made, "chrom string, left_first long, right_first long, left_second long, right_second long")
    found = pairs.exclude_pairs(df, spark.createDataFrame(regions, "chrom string, start long, end long"), 10_000)
    assert rows(found, *df.columns) == want
