"""Binary signal files, written here by hand."""

import zlib
from struct import pack

import numpy as np
import pytest

from kinseg.sources import bigwig

NAMES = ["chr1", "chr10", "chr2"]


def signal(seed, contigs=3, n=900):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(contigs):
        at = 0
        for _ in range(n):
            at += int(rng.integers(0, 9))
            end = at + int(rng.integers(1, 30))
            rows.append((c, at, end, float(np.float32(rng.random()))))
            at = end
    return rows


def written(path, order, rows, per_block=50, fan=4, packed=True, kinds=(1,)):
    """The file of rows: blocks of one contig each, of the kinds in turn (stepped kinds take the spans of their first row), trees of nodes of `fan` items."""
    key = max(map(len, NAMES))
    head = 64
    names_at = head
    leaf = lambda items: pack(order + "BBH", 1, 0, len(items)) + b"".join(items)
    entries = [pack(order + f"{key}sII", n.encode(), i, 1 << 28) for i, n in enumerate(NAMES)]
    # Two levels of names: a root over two leaves.
    first, second = leaf(entries[:2]), leaf(entries[2:])
    root_size = 4 + 2 * (key + 8)
    at = names_at + 32 + root_size
    root = pack(order + "BBH", 0, 0, 2) + pack(order + f"{key}sQ", NAMES[0].encode(), at) + pack(order + f"{key}sQ", NAMES[2].encode(), at + len(first))
    tree = pack(order + "IIIIQQ", bigwig.NAMES, 2, key, 8, 3, 0) + root + first + second
    out = bytearray(tree)
    told, blocks, kept, n = pack(order + "Q", 0), [], [], 0
    out += told
    for c in range(3):
        own = [r for r in rows if r[0] == c]
        for i in range(0, len(own), per_block):
            part, kind = own[i : i + per_block], kinds[n % len(kinds)]
            n += 1
            if kind == 1:
                body, step, span = b"".join(pack(order + "IIf", *r[1:]) for r in part), 0, 0
            elif kind == 2:
                span, step = 1, 0
                part = [(c, s, s + 1, v) for _, s, _, v in part]
                body = b"".join(pack(order + "If", s, v) for _, s, _, v in part)
            else:
                step, span = 5, 3
                part = [(c, part[0][1] + 5 * j, part[0][1] + 5 * j + 3, r[3]) for j, r in enumerate(part)]
                body = b"".join(pack(order + "f", r[3]) for r in part)
            data = pack(order + "IIIIIBBH", c, part[0][1], part[-1][2], step, span, kind, 0, len(part)) + body
            data = zlib.compress(data) if packed else data
            blocks.append((c, part[0][1], c, max(r[2] for r in part), head + len(out), len(data)))
            kept += part
            out += data
    tree_at = head + len(out)
    out += pack(order + "IIQIIIIQII", bigwig.BLOCKS, fan, len(blocks), 0, 0, 2, 1 << 28, 0, per_block, 0)
    # Levels from the leaves up; the root comes first, so sizes are worked out before places.
    levels = [[blocks[i : i + fan] for i in range(0, len(blocks), fan)]]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([last[i : i + fan] for i in range(0, len(last), fan)])
    place = tree_at + 48
    places = []
    for depth, level in enumerate(reversed(levels)):
        item = 32 if depth == len(levels) - 1 else 24
        places.append([])
        for node in level:
            places[-1].append(place)
            place += 4 + item * len(node)

    def span(node):
        flat = node if isinstance(node[0], tuple) else [span(x) for x in node]
        low, high = min((b[0], b[1]) for b in flat), max((b[2], b[3]) for b in flat)
        return (*low, *high)

    for depth, level in enumerate(reversed(levels)):
        below = iter(places[depth + 1]) if depth + 1 < len(places) else None
        for node in level:
            if below is None:
                out += pack(order + "BBH", 1, 0, len(node)) + b"".join(pack(order + "IIIIQQ", *b) for b in node)
            else:
                out += pack(order + "BBH", 0, 0, len(node)) + b"".join(pack(order + "IIIIQ", *span(x), next(below)) for x in node)
    top = pack(order + "IHHQQQHHQQIQ", bigwig.FILE, 4, 0, names_at, 0, tree_at, 0, 0, 0, 0, 1 << 15 if packed else 0, 0)
    path.write_bytes(top + bytes(out))
    return kept


@pytest.mark.parametrize("order, packed, kinds, parts", [("<", True, (1,), 64), (">", False, (1, 2, 3), 3), ("<", True, (2, 3), 1)])
def test_every_value_comes_back(spark, tmp_path, order, packed, kinds, parts):
    kept = written(tmp_path / "x.bw", order, signal(1), packed=packed, kinds=kinds)
    found = bigwig.read_bigwig(spark, str(tmp_path / "x.bw"), parts)
    assert sorted(map(tuple, found.collect())) == sorted((NAMES[c], s, e, pytest.approx(v, abs=1e-7)) for c, s, e, v in kept)


def test_filters_reach_the_tree(spark, tmp_path):
    kept = written(tmp_path / "x.bw", "<", signal(2), per_block=20)
    found = bigwig.read_bigwig(spark, str(tmp_path / "x.bw"))
    low, high = 3_000, 3_200
    got = sorted(map(tuple, found.filter(f"chrom = 'chr10' and end0 > {low} and start0 < {high}").collect()))
    assert got == sorted((NAMES[c], s, e, v) for c, s, e, v in kept if c == 1 and e > low and s < high) and got
    assert found.filter("chrom in ('chr2', 'none') and value < 0.5").count() == sum(c == 2 and v < 0.5 for c, _, _, v in kept)
    reader = bigwig.Reader({"path": str(tmp_path / "x.bw")})
    filters = [bigwig.EqualTo(("chrom",), "chr10"), bigwig.GreaterThan(("end0",), low), bigwig.LessThan(("start0",), high)]
    assert list(reader.pushFilters(filters)) == filters
    blocks = sum(1 for part in reader.partitions() for _ in reader.read(part))
    every = bigwig.Reader({"path": str(tmp_path / "x.bw")})
    total = sum(1 for part in every.partitions() for _ in every.read(part))
    assert total == 135 and 0 < blocks <= 4


def test_empty_and_wrong_files(spark, tmp_path):
    written(tmp_path / "x.bw", "<", signal(3, 3, 1))
    assert bigwig.read_bigwig(spark, str(tmp_path / "x.bw")).filter("chrom = 'none'").count() == 0
    (tmp_path / "y.bw").write_text("text")
    with pytest.raises(Exception, match="no binary signal file"):
        bigwig.read_bigwig(spark, str(tmp_path / "y.bw")).count()
