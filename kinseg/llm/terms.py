"""Corpus-wide term tables, and lookups of them from every document.

Terms follow a heavy-tailed law and their number grows with the corpus. A table
of at most `bound` frequent terms goes to every executor; all others are looked
up by a join, so nothing is dropped whatever the size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinseg.llm.shared import whole

#: Frequent terms that are sent to every executor: at most so many, some 20 bytes each.
FREQUENT = 200_000
#: Terms of equal frequency are told apart by so many slots of a hash.
SLOTS = 4096
#: A task counts so many distinct terms in memory before it passes them on.
HELD = 400_000


def term_counts(texts: DataFrame, split: Callable[[str], Iterable]) -> DataFrame:
    """(term, n) over every row's `text`, split by `split` into str or bytes terms.

    Each task adds up its own terms first; a term of any frequency is at most one
    row per task and flush.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            terms = pa.array(list(held)) if held else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                held.update(split(text.as_py()))
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    return texts.select(whole("text").alias("text")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, bound: int = FREQUENT) -> Column:
    """A condition on counts(term, n) that holds for at most `bound` terms, none of them rarer, to an eighth of an octave, than any other.

    Terms of the last such step that has room for some only are chosen by hash. Only two
    histograms of at most some 500 and SLOTS rows reach the driver.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS)).cast("int")
    held = 0
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("terms")).orderBy(F.desc("step")).toLocalIterator():
        if held + row.terms > bound:
            cut = 0
            for part in counts.filter(step == row.step).groupBy(slot.alias("slot")).agg(F.count("*").alias("terms")).orderBy("slot").toLocalIterator():
                held += part.terms
                if held > bound:
                    break
                cut = part.slot + 1
            return (step > row.step) | ((step == row.step) & (slot < cut))
        held += row.terms
    return F.lit(True)
