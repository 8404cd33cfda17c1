"""Split alignment of contigs to the windows of their calls: seeds and chains in tables, affine gaps row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinseg.functions.alignments import SECONDARY, SUPPLEMENTARY, left_clipped, right_clipped
from kinseg.operators.relops import pair_by_key

#: Scores of a match, a mismatch, a gap's first and each further letter (as of its own); lowest score kept.
MATCH, MISMATCH, OPEN, EXTEND, LOWEST = 1, -4, -7, -1, 30
#: Length of seeds, how often one may occur in a window, how far the diagonals of one chain may lie apart, and the longest gap beyond its seeds.
SEED, COMMON, BAND, SLACK = 19, 500, 100, 30
HIGHEST = 60


#: Letters of a text from which seeds are taken at a time.
STRETCH = 64
#: Letters of queries and targets that do not reach as far as the others of their batch; cells of a batch, and of one of its rows.
NO_QUERY, NO_TARGET = -1, -2
CELLS, ROW = 1 << 24, 1 << 15

#: (score, query start, query end, target start, target end, operations), 0-based and half open.
Found = tuple[int, int, int, int, int, str]


def local_alignment(query: str, target: str) -> Found | None:
    """local_alignments() of one pair."""
    return local_alignments([(query, target)])[0]


def local_alignments(pairs: list[tuple[str, str]]) -> list[Found | None]:
    """The best local alignment of each query and target; None without a match.

    Pairs of like size go through their matrices together, a row of each at a time: gaps in the query come from the
    row above, gaps in the target from a running maximum along the row. Of equal ends the first in the query, then in
    the target, counts.
    """
    out: list[Found | None] = [None] * len(pairs)
    order = sorted((i for i, (q, t) in enumerate(pairs) if q and t), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    batch: list[int] = []
    rows = 0
    for i in order:
        q, t = len(pairs[i][0]) + 1, len(pairs[i][1]) + 1
        if batch and ((len(batch) + 1) * t > ROW or (len(batch) + 1) * t * max(rows, q) > CELLS):
            _aligned(pairs, batch, out)
            batch, rows = [], 0
        batch.append(i)
        rows = max(rows, q)
    if batch:
        _aligned(pairs, batch, out)
    return out


def _letters(texts: list[str], absent: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), absent, np.int16)
    for row, text in zip(out, texts):
        row[: len(text)] = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return out


def _aligned(pairs: list[tuple[str, str]], batch: list[int], out: list[Found | None]) -> None:
    """local_alignments() of one batch. What lies behind a shorter text matches nothing, so it never holds a best end."""
    q, t = _letters([pairs[i][0] for i in batch], NO_QUERY), _letters([pairs[i][1] for i in batch], NO_TARGET)
    n, height, width = len(batch), q.shape[1] + 1, t.shape[1] + 1
    # No score or place exceeds the sizes, and nothing falls lower than a gap along a whole text below the floor.
    kind = np.int16 if height + width < 8_000 else np.int32
    floor = -16_000 if kind is np.int16 else -(10**9)
    at = (np.arange(width) * -EXTEND).astype(kind)
    score, gap = np.zeros((n, width), kind), np.full((n, width), floor, kind)
    news, moves = np.zeros((height, n, width), kind), np.zeros((height, n, width), np.uint8)
    opened, longer, run = np.empty_like(score), np.empty_like(score), np.full((n, width), floor, kind)
    both, top = np.empty((n, width - 1), kind), np.empty((n, width - 1), kind)
    diagonal = np.zeros((n, width), bool)
    best, row, column = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(1, height):
        np.add(score, OPEN, out=opened)
        np.add(gap, EXTEND, out=longer)
        np.maximum(opened, longer, out=gap)
        np.multiply((t == q[:, i - 1 : i]).view(np.int8), MATCH - MISMATCH, out=both)
        both += score[:, :-1]
        both += MISMATCH
        new = news[i]
        np.maximum(gap, 0, out=new)
        np.maximum(new[:, 1:], both, out=new[:, 1:])
        np.equal(new[:, 1:], both, out=diagonal[:, 1:])
        np.add(new[:, :-1], at[:-1], out=top)
        np.maximum.accumulate(top, axis=1, out=top)
        np.subtract(top, at[:-1] - OPEN, out=run[:, 1:])
        along = run > new
        np.maximum(run, new, out=score)
        # 0 stop, 1 both, 2 a letter of the query alone, 3 one of the target alone; 4 more where a gap in the query goes on.
        move = moves[i]
        np.subtract(2, diagonal.view(np.uint8), out=move)
        np.maximum(move, along.view(np.uint8) * np.uint8(3), out=move)
        move *= score > 0
        move |= (longer > opened).view(np.uint8) << np.uint8(2)
        most = score.max(axis=1)
        for k in np.flatnonzero(most > best).tolist():
            best[k], row[k], column[k] = most[k], i, score[k].argmax()
    for k, pair in enumerate(batch):
        if best[k]:
            out[pair] = _traced(moves[:, k], news[:, k], at, int(best[k]), int(row[k]), int(column[k]))


def _traced(moves: np.ndarray, news: np.ndarray, at: np.ndarray, score: int, i: int, j: int) -> Found:
    """The way back from the end of the best alignment."""
    end, stop = i, j
    ops, column = [], False
    while column or moves[i, j] & 3:
        move = 2 if column else moves[i, j] & 3
        if move == 1:
            ops.append("M")
            i, j = i - 1, j - 1
        elif move == 2:
            ops.append("I")
            column = bool(moves[i, j] & 4)
            i -= 1
        else:
            # The last of the places from which the gap costs least.
            start = j - 1 - int(np.argmax((news[i, :j] + at[:j])[::-1]))
            ops.append("D" * (j - start))
            j = start
    return score, i, end, j, stop, "".join(reversed(ops))


def pieces(parts: list[tuple[str, str, int, int]], lowest: int = LOWEST) -> list[list[Found]]:
    """Of each part (query, target, first, last) the best local alignment of the whole query, and of what it leaves over before and behind where seeds lie (from `first` to `last`), as long as scores reach `lowest`."""
    found: list[list[Found]] = [[] for _ in parts]
    spans = [(n, 0, len(query)) for n, (query, *_) in enumerate(parts)]
    while spans := [(n, low, high) for n, low, high in spans if parts[n][2] < high and low < parts[n][3]]:
        left = []
        for (n, low, high), best in zip(spans, local_alignments([(parts[n][0][low:high], parts[n][1]) for n, low, high in spans])):
            if best and best[0] >= lowest:
                score, q0, q1, *rest = best
                found[n].append((score, low + q0, low + q1, *rest))
                left += [(n, *x) for x in ((low, low + q0), (low + q1, high)) if x[1] - x[0] >= lowest]
        spans = left
    return found


def cigar(ops: str, before: int, behind: int, clip: str) -> str:
    cuts = [0, *(i for i in range(1, len(ops)) if ops[i] != ops[i - 1]), len(ops)]
    middle = "".join(f"{b - a}{ops[a]}" for a, b in zip(cuts, cuts[1:]))
    return f"{before}{clip}" * (before > 0) + middle + f"{behind}{clip}" * (behind > 0)


def _seeds(df: DataFrame, text: str, seed: int, at: str) -> DataFrame:
    """call_id, contig where df has one, kmer, and where it begins in the text, 0-based.

    Texts are few bytes and much work, so they are dealt over all tasks first; a k-mer is taken from a stretch of its text, as letters are counted from the front.
    """
    own = ["call_id", *(c for c in ("contig",) if c in df.columns)]
    dealt = df.filter(F.length(text) >= seed).select(*own, text).repartition(_tasks(df), *own)
    cut = dealt.withColumn("_low", F.explode(F.sequence(F.lit(0), F.length(text) - seed, F.lit(STRETCH))))
    cut = cut.select(*own, "_low", F.substring(text, F.col("_low") + 1, F.lit(STRETCH + seed - 1)).alias("_text"))
    each = cut.withColumn("_i", F.explode(F.sequence(F.lit(0), F.length("_text") - seed)))
    return each.select(*own, (F.col("_low") + F.col("_i")).alias(at), F.substring("_text", F.col("_i") + 1, F.lit(seed)).alias("kmer"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def chains(contigs: DataFrame, windows: DataFrame, seed: int = SEED, common: int = COMMON, band: int = BAND) -> DataFrame:
    """(call_id, contig, size, part, at, piece, low, first, last): parts of contigs, and of their calls' windows (call_id, bases), that seeds on near diagonals bring together.

    An equi-join of k-mers finds the seeds; those met over `common` times in a window are left out. A contig's part
    begins at letter `at`, `band` before its first seed, and ends as far behind its last one, the window's part
    where these ends would lie, and `SLACK` further; first and last bound the seeds in the contig's part.
    """
    q = _seeds(contigs, "seq", seed, "q")
    r = _seeds(windows, "bases", seed, "r")
    rare = r.withColumn("n", F.count("*").over(Window.partitionBy("call_id", "kmer"))).filter(F.col("n") <= common).drop("n")
    hits = q.hint("merge").join(rare, ["call_id", "kmer"]).select("call_id", "contig", "q", (F.col("r") - F.col("q")).alias("d"))
    diagonals = hits.groupBy("call_id", "contig", "d").agg(F.min("q").alias("q0"), F.max("q").alias("q1"))
    order = Window.partitionBy("call_id", "contig").orderBy("d")
    before = F.lag("d").over(order)
    marked = diagonals.withColumn("new", F.when(before.isNull() | (F.col("d") - before > band), 1).otherwise(0))
    numbered = marked.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("call_id", "contig", "chain").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("q0").alias("q0"), (F.max("q1") + seed).alias("q1"))
    met = spans.hint("merge").join(contigs.select("call_id", "contig", "seq"), ["call_id", "contig"]).hint("merge").join(windows.select("call_id", "bases"), "call_id")
    at, stop = F.greatest(F.col("q0") - band, F.lit(0)), F.least(F.col("q1") + band, F.length("seq"))
    low = F.greatest(at + F.col("d0") - SLACK, F.lit(0))
    high = stop + F.col("d1") + SLACK
    part, piece = F.substring("seq", at + 1, stop - at), F.substring("bases", low + 1, high - low)
    return met.select("call_id", "contig", F.length("seq").alias("size"), part.alias("part"), at.alias("at"), piece.alias("piece"), low.alias("low"), (F.col("q0") - at).alias("first"), (F.col("q1") - at).alias("last"))


def split_alignments(contigs: DataFrame, windows: DataFrame, lowest: int = LOWEST, seed: int = SEED, common: int = COMMON, band: int = BAND) -> DataFrame:
    """call_id, contig, ord, flag, start, end (1-based in the window), mapq, cigar, score of every local alignment of contigs (call_id, contig, seq).

    The best one of a contig is its first record; what lies over half under a better one is secondary, of
    mapping quality 0, the rest is supplementary and clipped hard. Quality falls with the score
    of the best competitor.
    """
    call = dict(contigs.dtypes)["call_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = pieces(list(zip(batch["part"], batch["piece"], batch["first"].tolist(), batch["last"].tolist())), lowest)
            rows = [(r.call_id, r.contig, r.size, score, r.at + q0, r.at + q1, r.low + t0 + 1, r.low + t1, ops) for r, own in zip(batch.itertuples(index=False), parts) for score, q0, q1, t0, t1, ops in own]
            yield pd.DataFrame(rows, columns=["call_id", "contig", "size", "score", "q0", "q1", "start", "end", "ops"])

    # The parts are few bytes and much work, so tasks are not left to be joined by their bytes.
    met = chains(contigs, windows, seed, common, band)
    dealt = met.repartition(_tasks(met), "call_id", "contig", "at", "low")
    found = dealt.mapInPandas(run, f"call_id {call}, contig int, size int, score int, q0 int, q1 int, start int, end int, ops string").distinct()
    ranked = found.withColumn("ord", F.row_number().over(Window.partitionBy("call_id", "contig").orderBy(F.desc("score"), "q0", "q1", "start", "end", "ops")) - 1)
    # A contig's alignments look at each other in one row, so that they are made once.
    every = F.collect_list(F.struct("ord", "score", "q0", "q1")).over(Window.partitionBy("call_id", "contig"))
    over = lambda x: F.least("q1", x["q1"]) - F.greatest("q0", x["q0"]) > F.least(F.col("q1") - F.col("q0"), x["q1"] - x["q0"]) / 2
    met = ranked.withColumn("every", every).withColumn("rivals", F.filter("every", lambda x: (x["ord"] != F.col("ord")) & over(x)))
    rows = met.select("*", F.array_max(F.transform("rivals", lambda x: x["score"])).alias("second"), F.array_min(F.transform("rivals", lambda x: x["ord"])).alias("above")).drop("every", "rivals")
    under = F.coalesce(F.col("above") < F.col("ord"), F.lit(False))
    flag = F.when(under, SECONDARY).when(F.col("ord") > 0, SUPPLEMENTARY).otherwise(0)
    quality = F.when(under, 0).otherwise(F.least(F.lit(HIGHEST), F.floor(6.02 * (F.col("score") - F.coalesce("second", F.lit(0))) + 0.5))).cast("int")
    written = F.udf(cigar, "string", useArrow=False)(F.col("ops"), F.col("q0"), F.col("size") - F.col("q1"), F.when(F.col("ord") > 0, "H").otherwise("S"))
    return rows.select("call_id", "contig", F.col("ord").cast("int").alias("ord"), flag.alias("flag"), "start", "end", quality.alias("mapq"), written.alias("cigar"), "score")


def contig_breakpoints(calls: DataFrame, found: DataFrame) -> DataFrame:
    """call_id, start, end in the window that split contigs show: of each call the first contig with a pair of records that makes an interval.

    Records of mapping quality above 0 are paired by contig in their order. A deletion lies between the end of the
    record clipped on its right and the start of the one clipped on its left; where
    no sample has a deletion, from the start of the one clipped on its left to the end of the other.
    """
    pairs = pair_by_key(found.filter("mapq > 0"), ["call_id", "contig"], ["ord"], ["start", "end", "cigar"])
    right = lambda shift: F.coalesce(*(F.when(right_clipped(f"cigar_{i}", "SH"), F.col(f"end_{i}") + shift) for i in (1, 2)))
    left = lambda shift: F.coalesce(*(F.when(left_clipped(f"cigar_{i}", "SH"), F.col(f"start_{i}") + shift) for i in (1, 2)))
    deletion = (F.col("type0") == "DELETION") | (F.col("type1") == "DELETION") | (F.col("type2") == "DELETION")
    edges = pairs.join(calls.select("call_id", "type0", "type1", "type2"), "call_id")
    edges = edges.select("call_id", "contig", F.when(deletion, right(1)).otherwise(left(0)).alias("start"), F.when(deletion, left(-1)).otherwise(right(0)).alias("end"))
    return edges.filter("start < end").groupBy("call_id").agg(F.min_by(F.struct("start", "end"), "contig").alias("at")).select("call_id", "at.start", "at.end")
