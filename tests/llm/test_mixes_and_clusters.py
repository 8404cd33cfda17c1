"""Token alignment, source mixing and ball clusters against brute force, on odd rows and on the small tables."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from kinseg.llm import align, balls, mixing, registry

from .conftest import prose

SMALL = "/root/testdata/sf0.001"
A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def own():
    return align.Aligner(A, B)


def ends(ids, of):
    return np.cumsum([len(of[i]) for i in ids]).tolist()


def by_hand(own, text):
    """(a, b, groups as text, linked pairs, overlaps) of a text encoded as a whole."""
    nothing = [], [], [], [], 0
    if not text:
        return nothing
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    want = (" " + text).encode()
    if b"".join(own.a_bytes[i] for i in a) != want or b"".join(own.b_bytes[i] for i in b) != want:
        return nothing
    a_ends, b_ends = ends(a, own.a_bytes), ends(b, own.b_bytes)
    groups, links, at = [], [], [0, 0]
    for cut in sorted(set(a_ends) & set(b_ends)):
        stop = [a_ends.index(cut, at[0]) + 1, b_ends.index(cut, at[1]) + 1]
        sides = a[at[0] : stop[0]], b[at[1] : stop[1]]
        groups.append("|".join(",".join(map(str, s)) for s in sides))
        links.append((sides[0][-1], sides[1][-1]))
        at = stop
    spans = [list(zip([0, *e[:-1]], e)) for e in (a_ends, b_ends)]
    overlaps = sum(s < f and t < e for s, e in spans[0] for t, f in spans[1]) if len(a) < 400 else len(a) + len(b) - len(groups)
    return a, b, groups, links, overlaps


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]


def expected_links(own, rows):
    found = [(i, by_hand(own, text)) for i, text in rows]
    count = Counter(link for _, x in found for link in x[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, (a, b, groups, links, overlaps) in found:
        digest = sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest, overlaps))
    return sorted(out, key=repr)


TRICKY = ["", " ", "a▁b c", "  two  spaces \n new\tline <s> </s> <|endoftext|> <0x41> x", "日本語 émigré 🙂🙂 ß x  y \x1c z \x85 w", "x" * 3000, "a ​ b", "﻿ x　y", "it's 'll they're", "end ", "\n", "▁"]


def test_links_on_odd_rows(spark, odd, none, own):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    want = expected_links(own, [(r.doc_id, r.text) for r in docs.collect()])
    for frequent in (50, 200_000):
        assert rows_of(align.links(docs, A, B, frequent), *COLUMNS) == want
    assert align.links(none, A, B).count() == 0
    assert rows_of(align.links(docs.filter("text = '▁'"), A, B), *COLUMNS) == [(111, 0, 0, 0, 0, 0, 0, "", 0)]


def test_links_of_the_small_table(spark, own):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = expected_links(own, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(align.links(docs.repartition(5), A, B, 300), *COLUMNS) == want


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sé日 .,\n\t  \x1c\x85▁12<|>"), max_size=40))
def test_stretches_join_to_what_the_whole_text_gives(own, text):
    a, b, groups, links, _ = by_hand(own, text)
    numbers = own.numbers([own.stretches(text) if text else []])[0]
    counts = own.counts[numbers]
    if not numbers or counts.min() < 0:
        assert not a
        return
    assert ";".join(own.groups[i] for i in numbers) == ";".join(groups)
    assert counts[:, :2].sum(axis=0).tolist() == [len(a), len(b)]
    pairs = np.frombuffer(b"".join(own.pairs[i] for i in numbers), np.int64)
    assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs] == links


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(align, "KEPT", 40)
    monkeypatch.setattr(align, "TABLE", 16)
    monkeypatch.setattr(align, "RUN", 3)
    small = align.Aligner(A, B)
    for seed in range(6):
        text = prose(seed, 30)
        groups = by_hand(small, text)[2]
        numbers = small.numbers([small.stretches(text)])[0]
        assert ";".join(small.groups[i] for i in numbers) == ";".join(groups)


def reshared(sizes, weights):
    """Targets by the rule as it is worded: excess over twice a source's size is shared again until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, excess, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    for _ in range(50):
        if not open_:
            break
        total = sum(w[i] for i in open_)
        for i in open_:
            out[i] += excess * w[i] / total
        excess = sum(max(0, out[i] - 2 * sizes[i]) for i in open_)
        full = {i for i in open_ if out[i] >= 2 * sizes[i]}
        for i in full:
            out[i] = 2.0 * sizes[i]
        open_ -= full
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=9))
def test_targets(sizes):
    assert mixing.targets(sizes) == pytest.approx(reshared(sizes, mixing.WEIGHTS), abs=1e-3)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutations_and_their_inverses(size):
    there = mixing.permuted(np.arange(size), size, "key")
    assert sorted(there.tolist()) == list(range(size))
    assert mixing.permuted(there, size, "key", True).tolist() == list(range(size))
    assert size < 64 or there.tolist() != mixing.permuted(np.arange(size), size, "other").tolist()


def test_shards_are_drawn_alike_from_anywhere(monkeypatch):
    counts = np.array([1000, 37, 0, 5000])
    every = list(mixing.shard_counts(counts, 13, 0, 13))
    assert sum(own for _, own, _ in every).tolist() == counts.tolist()
    assert np.ptp([own.sum() for _, own, _ in every]) <= 1
    seen = np.zeros(4, int)
    for _, own, before in every:
        assert before.tolist() == seen.tolist()
        seen += own
    part = list(mixing.shard_counts(counts, 13, 4, 9))
    assert [x[1].tolist() for x in part] == [x[1].tolist() for x in every[4:9]]
    monkeypatch.setattr(mixing, "DRAWN", 100)
    assert sum(own for _, own, _ in mixing.shard_counts(counts, 13, 0, 13)).tolist() == counts.tolist()


def test_mix_of_odd_rows(spark, odd, none):
    docs = odd.unionByName(odd.limit(0)).unionByName(spark.createDataFrame([(50 + i, prose(i, 700), "s") for i in range(8)], "doc_id long, text string, source string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.source, len(SPLIT.findall(r.text or ""))) for r in docs.collect()]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    want = dict(zip(names, zip(sizes, mixing.targets(sizes))))
    got = mixing.mixed(docs).collect()
    expected = sorted(((i, n, want[s][0]) for i, s, n in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.source_size) for r in got), key=repr) == expected
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    for size, target in want.values():
        assert abs(taken[size, round(target, 6)] - target) <= 0.5
    assert rows_of(mixing.mixed(docs.repartition(5)), "*") == sorted(map(tuple, got), key=repr)
    assert mixing.mixed(none).count() == 0
    assert mixing.mixed(docs.filter("text is null")).agg({"taken": "sum"}).first()[0] == 0


def test_texts_of_a_mix_are_its_spans(spark):
    """Blocks hold the words that their spans name; whole blocks repeat at most once an epoch, and sources keep their targets."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = mixing.mix(docs, block=50, shard=64)
    words = {r.doc_id: SPLIT.findall(r.text or "") for r in docs.collect()}
    texts = {(r.shard, r.position): r for r in made.texts(docs).collect()}
    spans = defaultdict(list)
    for r in made.spans().collect():
        spans[r.shard, r.position].append((r["from"], words[r.doc_id][r.start : r.start + r.n]))
    assert {k: " ".join(w for _, x in sorted(v) for w in x) for k, v in spans.items()} == {k: r.text for k, r in texts.items()}
    shards = Counter(k[0] for k in texts)
    assert max(shards.values()) <= 64 and all(sorted(p for s, p in texts if s == shard) == list(range(n)) for shard, n in shards.items())
    total = Counter()
    for r in texts.values():
        total[r.source] += len(r.text.split(" "))
    for r in made.plan.collect():
        assert abs(total[r.name] - r.target) <= 0.5
    drawn = made.drawn.collect()
    assert max(Counter((r.source_no, r.block, r.epoch) for r in drawn).values()) == 1
    first = [r.block for r in sorted(drawn, key=lambda r: (r.shard, r.position)) if r.source_no == 0]
    assert first != sorted(first)


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(i, "x", str(i)) for i in range(4)], "doc_id long, text string, source string"))


def plain_k_means(rows, k=8, rounds=10, dimensions=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    start = sorted(kept, key=lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]
    vectors = np.array([v for _, v in kept])
    for last in [False] * rounds + [True]:
        apart = ((vectors[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
        own, distance = apart.argmin(axis=1), apart.min(axis=1)
        for i in range(len(centroids)):
            members = vectors[own == i]
            if len(members) and not last:
                centroids[i] = [int(s) // len(members) for s in members.sum(axis=0)]
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, int(c), int(d), int(distance[own == c].sum()), int(distance.sum()), names[c]) for (i, _), c, d in zip(kept, own, distance)), key=repr)


def test_ball_clusters_are_those_of_plain_k_means(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = plain_k_means([(r.vec_id, r.embedding) for r in vectors.collect()])
    assert rows_of(balls.ball_clusters(vectors.repartition(3)), "*") == want


def test_ball_clusters_on_odd_rows(spark):
    """Nulls, wrong lengths, non-finite components, equal vectors, ties between centroids, fewer vectors than centroids."""
    rng = np.random.default_rng(5)
    grid = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows = grid + [(3, grid[3][1]), (None, [0.0] * 4), (None, None), (70, [1.0] * 3), (71, [1.0] * 5), (72, []), (73, [1.0, None, 0.0, 0.0]), (74, [float("nan")] * 4), (75, [float("inf"), 0.0, 0.0, 0.0]), (76, [1e-9, -1e-9, 0.5, -0.5])]
    schema = "vec_id long, embedding array<double>, cluster int, v string"
    make = lambda rows: spark.createDataFrame([(*r, 9, "x") for r in rows], schema)
    for some, k in ((rows, 8), (rows[:3], 8), (rows, 1), ([(1, [0.5] * 4)] * 5, 3)):
        assert rows_of(balls.ball_clusters(make(some), k, 4, 4), "*") == plain_k_means(some, k, 4, 4)
    assert balls.ball_clusters(make(rows).limit(0), 8, 4, 4).count() == 0
    with pytest.raises(Exception, match="would not fit"):
        balls.ball_clusters(make([(1, [1e300] * 4)]), 2, 1, 4).count()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=2, max_size=6), st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=30), st.data())
def test_cores_and_annuli_lose_nothing(centroids, vectors, data):
    """Whatever centroid a vector starts with, the neighbours within its ball decide as all centroids would."""
    v, c = np.array(vectors), np.array(centroids)
    own = np.array([data.draw(st.integers(0, len(c) - 1)) for _ in v])
    made = []
    for i, centroid in enumerate(centroids):
        members = ((v[own == i] - c[i]) ** 2).sum(axis=1)
        made.append(balls.Ball(centroid, len(members), balls.root_above(int(members.max())) if len(members) else 0))
    best, distance = balls.reassigned(v, own, c, balls.neighbours(made))
    apart = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert best.tolist() == apart.argmin(axis=1).tolist() and distance.tolist() == apart.min(axis=1).tolist()


def test_sql_of_the_clusters(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    sql = con.execute(registry.oracles()["op13_ball_clusters"]).fetchall()
    assert sorted(sql, key=repr) == rows_of(registry.op13_ball_clusters(spark, SMALL), "*")
