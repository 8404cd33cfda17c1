"""Relational building blocks: interval joins, islands, top-1, dense bins, pairing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinseg.sources.scratch import settled


#: Bins of one level that one bin of the next covers; an interval lies in at most one bin more at its own level.
FAN = 64
#: Lines up to this length have a level for their longest intervals.
LINE = 1 << 40


def _levels(bucket: int, fan: int) -> list[int]:
    """Widths of the bins of each level: the bucket's, and `fan` times the one before."""
    widths = [bucket]
    while widths[-1] * fan < LINE:
        widths.append(widths[-1] * fan)
    return widths


def _own_level(start: str, end: str, widths: list[int], fan: int) -> Column:
    """The lowest level at which the interval covers no more than about `fan` bins."""
    length = F.col(end) - F.col(start)
    level = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        level = F.when(length < widths[i] * fan, i).otherwise(level)
    return level


def _in_bins(df: DataFrame, start: str, end: str, widths: list[int], fan: int, at: dict[int, Callable[[int, Column], Column]], names: tuple[str, str]) -> DataFrame:
    """df with a row for each (level, bin) where it meets rows of the other side; columns `names`.

    at: for 1 and for -1 which levels, by (level, own level), count; those of -1 get a negative number, so
    that the two kinds of meeting stay apart. Plain expressions, which stay in generated code, not higher-order functions.
    """
    found = []
    for sign, chosen in at.items():
        for level, width in enumerate(widths):
            if sign > 0 or level:
                bins = F.struct(F.lit(sign * level).alias("level"), F.floor(F.col(start) / width).alias("low"), F.floor(F.col(end) / width).alias("high"))
                found.append(F.when(chosen(level, F.col("_own")), bins))
    own = df.withColumn("_own", _own_level(start, end, widths, fan)).withColumn("_at", F.explode(F.array(*found))).filter("_at is not null")
    return own.withColumns({names[0]: F.col("_at.level"), names[1]: F.explode(F.sequence("_at.low", "_at.high"))}).drop("_own", "_at")


def _left_bins(left: DataFrame, levels: Column, widths: list[int], fan: int) -> DataFrame:
    """Left looks for intervals of right, its own level's and longer, at the `levels` that right has, and waits for shorter ones at its own."""
    at = {1: lambda level, own: (own <= level) & F.array_contains("_present", level), -1: lambda level, own: own == level}
    return _in_bins(left.withColumn("_present", levels), "start", "end", widths, fan, at, ("_level", "_bin")).drop("_present")


def _right_bins(right: DataFrame, widths: list[int], fan: int) -> DataFrame:
    """Right waits at its own level, and looks for longer intervals of left at all levels above."""
    at = {1: lambda level, own: own == level, -1: lambda level, own: own < level}
    return _in_bins(right, "r_start", "r_end", widths, fan, at, ("_r_level", "_r_bin"))


def overlap_join(left: DataFrame, right: DataFrame, bucket: int, how: str = "inner", key: str = "chrom", fan: int = FAN) -> DataFrame:
    """Rows of left and right whose closed intervals overlap, within equal keys.

    An equi-join on (key, level, bin) that shuffles by place. Bins are `bucket` positions wide at level 0 and
    `fan` times wider at each level above. An interval lies in the bins of the level that suits its length,
    fan + 1 at most, so one as long as a contig costs no more rows than a short one; and as it lies in
    that many bins, what meets it is spread over as many tasks. The shorter of two intervals looks for the
    longer at the longer's level, in two bins at most: left for those of right, which should be the smaller side,
    only at levels that right has (a subquery tells them, so short intervals on both sides cost one level), and
    right for longer ones of left at all levels above its own. A pair counts in the bin of its overlap's
    first position only. Columns of right come back as r_<name>. Rows without key, start or end meet
    nothing. how may be inner, left_semi or left_anti.
    """
    if how != "inner":
        place = [key, "start", "end"]
        hits = overlap_join(left.select(*place).distinct(), right, bucket, key=key, fan=fan).select(*place).distinct()
        return left.join(hits, place, how)
    widths = _levels(bucket, fan)
    present = right.agg(F.collect_set(_own_level("start", "end", widths, fan))).scalar()
    r = _right_bins(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)), widths, fan)
    same = (F.col(key) == F.col(f"r_{key}")) & (F.col("_level") == F.col("_r_level")) & (F.col("_bin") == F.col("_r_bin"))
    # Right is guessed as large as its intervals, not as the rows of their bins, so it is not sent whole to all.
    met = _left_bins(left, present, widths, fan).hint("merge").join(r, same)
    width = F.get(F.array(*(F.lit(w) for w in widths)), F.abs("_level"))
    first = F.floor(F.greatest("start", "r_start") / width)
    met = met.filter((F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) & (F.col("_bin") == first))
    return met.drop("_level", "_bin", "_r_level", "_r_bin")


#: Positions of one contig that a task takes at a time in scans along it.
SPAN = 1_000_000


def scanned(df: DataFrame, keys: list[str], order: list[str], prior: dict[str, tuple[str, str]], span: int = SPAN) -> DataFrame:
    """df plus, for each name: (how, column) of prior, what the rows before hold within keys: their "max" or "sum", or the "last" one's value.

    Rows lie along a line by order[0]. Each stretch of `span` positions is scanned on its own; the totals of stretches, a
    row each, are scanned along their keys and joined back. So one long contig is as many tasks as it has stretches.
    """
    stretch = F.floor(F.col(order[0]) / span).alias("_stretch")
    place = F.struct(*order)
    total = {"max": F.max, "sum": F.sum, "last": lambda c: F.max_by(c, place)}
    totals = df.groupBy(*keys, stretch).agg(*(total[how](column).alias(name) for name, (how, column) in prior.items()))
    along = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    over = {"max": lambda c, w: F.max(c).over(w), "sum": lambda c, w: F.sum(c).over(w), "last": lambda c, w: F.last(c).over(w)}
    carried = totals.select(*keys, "_stretch", *(over[how](name, along).alias(f"_carried_{name}") for name, (how, _) in prior.items()))
    own = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_stretch", stretch).select("*", *(over[how](column, own).alias(f"_own_{name}") for name, (how, column) in prior.items()))
    both = rows.join(carried, [*keys, "_stretch"])
    joined = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "last": lambda a, b: F.coalesce(b, a)}
    return both.select(*df.columns, *(joined[how](F.col(f"_carried_{name}"), F.col(f"_own_{name}")).alias(name) for name, (how, _) in prior.items()))


def islands(df: DataFrame, keys: list[str], order: list[str], prior: dict[str, tuple[str, str]], begins: Column, name: str = "island", span: int = SPAN) -> DataFrame:
    """df with a running island number per keys, from 1 on: a new one at the first row and where `begins`, which may use the names of prior (see scanned()), is true.

    The marked rows are written to the shared folder, so that numbering them does not run what made them again.
    """
    first = F.col(next(iter(prior))).isNull()
    marked = scanned(df, keys, order, prior, span).withColumn("_new", F.when(first | begins, 1).otherwise(0)).drop(*prior)
    # Of rows that tie in order the one that begins an island comes first.
    marked = settled(marked.withColumn("_later", 1 - F.col("_new")), "marked")
    counted = scanned(marked, keys, [*order, "_later"], {"_before": ("sum", "_new")}, span)
    return counted.withColumn(name, F.col("_before") + F.col("_new")).drop("_new", "_later", "_before")


def overlapping(df: DataFrame, keys: list[str], name: str = "island", span: int = SPAN) -> DataFrame:
    """df (start, end) with the number of the stretch of overlapping closed intervals that each row is in."""
    return islands(df, keys, ["start", "end"], {"_reach": ("max", "end")}, F.col("start") > F.col("_reach"), name, span)


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def dense_bins(counts: DataFrame, keys: list[str], bin_name: str, fill: dict[str, object], last: bool = False) -> DataFrame:
    """counts with a row for every bin from each key's first to its last occupied one, which itself is left out unless `last`.

    Keys with one occupied bin give no row then, as the descending sequence would.
    """
    bounds = counts.groupBy(*keys).agg(F.min(bin_name).alias("_lo"), (F.max(bin_name) - (0 if last else 1)).alias("_hi")).filter("_hi >= _lo")
    every = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(bin_name))
    return every.join(counts, [*keys, bin_name], "left").fillna(fill)


def pair_by_key(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Consecutive pairs within keys: the 1st and 2nd row in order, the 3rd and 4th, and so on; an odd last row goes.

    One shuffle and a sort instead of a self-join. fields come back as <field>_1 and <field>_2.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    paired = df.withColumn("_n", number - 1).withColumn("_pair", F.floor(F.col("_n") / 2))
    pick = [f(F.struct(*fields), "_n").alias(name) for f, name in ((F.min_by, "_one"), (F.max_by, "_two"))]
    pairs = paired.groupBy(*keys, "_pair").agg(F.count("*").alias("_size"), *pick).filter("_size = 2")
    return pairs.select(*keys, *(F.col(f"_one.{f}").alias(f"{f}_1") for f in fields), *(F.col(f"_two.{f}").alias(f"{f}_2") for f in fields))


Rows = dict[str, np.ndarray]


def _edges(rows: Rows, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin."""
    size = len(rows[keys[0]])
    new = np.ones(size, bool)
    new[1:] = np.any([rows[k][1:] != rows[k][:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


#: Result rows that a task gathers before it hands them on.
GATHERED = 10_000


def _runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[bool, Rows]]:
    """The rows of each group that lie in one batch, and whether they begin the group."""
    last = None
    for batch in batches:
        if batch.empty:
            continue
        rows = {c: batch[c].to_numpy() for c in batch.columns}
        starts = _edges(rows, keys).tolist()
        for start, end in zip(starts, [*starts[1:], len(batch)]):
            own = tuple(rows[k][start] for k in keys)
            yield own != last, {c: x[start:end] for c, x in rows.items()}
            last = own


def _tables(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as tables of some GATHERED rows."""
    rows = iter(rows)
    while part := list(islice(rows, GATHERED)):
        yield pd.DataFrame(part, columns=names)


def _sorted_stream(df: DataFrame, keys: list[str], order: list[str], made: Callable[[Iterator[tuple[bool, Rows]]], Iterable[tuple]], schema: str) -> DataFrame:
    """made() on the runs of each task's groups, which travel in one sorted stream, so that a group costs no start-up of its own."""
    names = [f.split()[0] for f in schema.split(", ")]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(lambda batches: _tables(made(_runs(batches, keys)), names), schema)


def per_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[Rows], Iterable[tuple]], schema: str) -> DataFrame:
    """run on each group's sorted rows, as one array per column, giving rows of the schema; meant for very many small groups.

    A group that batches end inside waits for its last one and is then put together once.
    """

    def made(runs: Iterator[tuple[bool, Rows]]) -> Iterator[tuple]:
        held: list[Rows] = []
        whole = lambda: {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]
        for begins, rows in runs:
            if begins and held:
                yield from run(whole())
                held.clear()
            held.append(rows)
        if held:
            yield from run(whole())

    return _sorted_stream(df, keys, order, made, schema)


class Fold(Protocol):
    """What goes along one group's sorted rows and gives result rows as soon as it can."""

    def take(self, rows: Rows) -> Iterable[tuple]: ...

    def close(self) -> Iterable[tuple]: ...


def folded(df: DataFrame, keys: list[str], order: list[str], begin: Callable[[Rows], Fold], schema: str) -> DataFrame:
    """A fold of begin(first rows) along each group's sorted rows; no task holds a group, only what its fold keeps."""

    def made(runs: Iterator[tuple[bool, Rows]]) -> Iterator[tuple]:
        fold: Fold | None = None
        for begins, rows in runs:
            if begins:
                if fold is not None:
                    yield from fold.close()
                fold = begin(rows)
            yield from fold.take(rows)
        if fold is not None:
            yield from fold.close()

    return _sorted_stream(df, keys, order, made, schema)


def merge_intervals(df: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """Overlapping closed intervals of each key coalesced: keys, start, end."""
    return overlapping(df, keys, "_run", span).groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
