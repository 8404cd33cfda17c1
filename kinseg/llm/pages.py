"""Main text of web pages: flat blocks, judged by their own and their neighbours' words and links.

The page is cut into blocks beside the text; neighbours, the decision tree and
the joined text are DataFrame expressions over the array of blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinseg.llm.labelled_pages import PAGES
from kinseg.llm.markup import blocks
from kinseg.llm.shared import whole

#: What is known of a block, see markup.blocks().
FIELDS = "array<struct<text:string,words:int,linked:double,furniture:int,article:int,heading:int>>"
#: What the tree sees: of a block and of the ones before and after it.
FEATURES = ("words", "linked", "furniture", "article", "heading", "words_before", "linked_before", "words_after", "linked_after")
#: A tree's depth and the blocks that a leaf holds at least; of equally good cuts the first is taken.
DEPTH, LEAST_LEAF = 10, 3


def features(found: list[tuple]) -> np.ndarray:
    """Rows of FEATURES for the blocks of one page; beyond its ends there are no words."""
    own = np.array([b[1:] for b in found], float).reshape(-1, 5)
    edge = np.zeros((1, 2))
    return np.hstack([own, np.vstack([edge, own[:-1, :2]]), np.vstack([own[1:, :2], edge])])


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A decision tree by Gini impurity: (probability,) or (feature, threshold, at or below, above)."""
    share = float(y.mean())
    best = (share * (1 - share) * len(y) - 1e-9, None)
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                if min(low.sum(), (~low).sum()) < LEAST_LEAF:
                    continue
                cost = sum(p * (1 - p) * n for p, n in ((y[m].mean(), m.sum()) for m in (low, ~low)))
                if cost < best[0]:
                    best = (cost, (f, float(cut), low))
    if best[1] is None:
        return (share,)
    f, cut, low = best[1]
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def learnt(pages: tuple[str, ...]) -> tuple:
    """The tree of labelled pages, whose main blocks begin with a plus sign.

    It first asks whether the page says that the block is furniture, then
    whether it lies outside the page's article, on a page that marks none, or
    inside, and is grown on the blocks of each case.
    """
    found = [blocks(page) for page in pages]
    x, y = np.vstack([features(f) for f in found]), np.array([b[0].startswith("+") for f in found for b in f], float)
    says, mark = FEATURES.index("furniture"), FEATURES.index("article")
    named = x[:, says] > 1.5
    outside, unmarked, inside = (grow(x[~named & (x[:, mark] == case)], y[~named & (x[:, mark] == case)]) for case in (-1, 0, 1))
    return says, 1.5, (mark, -0.5, outside, (mark, 0.5, unmarked, inside)), grow(x[named], y[named])


@lru_cache(maxsize=1)
def tree() -> tuple:
    return learnt(PAGES)


def decided(node: tuple, value: Callable[[str], Column]) -> Column:
    """The tree as a condition on the columns that value() gives for feature names."""
    if len(node) == 1:
        return F.lit(node[0] >= 0.5)
    f, cut, low, high = node
    return F.when(value(FEATURES[f]) <= cut, decided(low, value)).otherwise(decided(high, value))


def block_column(page: Column) -> Column:
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
    names = ["text", "words", "linked", "furniture", "article", "heading"]

    @F.arrow_udf(FIELDS)
    def of(pages: pa.Array) -> pa.Array:
        found = [blocks(p.as_py() or "") for p in pages]
        ends = np.cumsum([0, *map(len, found)])
        columns = list(zip(*(b for one in found for b in one))) or [()] * len(kinds)
        struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)

    return of(page)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (main text, blocks joined by a newline), n_chars.

    A null html is empty; a page without main text gives an empty text; repeated
    rows and null ids come back as they came; an empty table gives no rows. Other columns are ignored.
    """
    cut = pages.select("page_id", "url", block_column(whole("html")).alias("blocks"))

    def chosen(block: Column, i: Column) -> Column:
        near = {"before": F.get("blocks", i - 1), "after": F.get("blocks", i + 1)}

        def value(name: str) -> Column:
            field, _, side = name.partition("_")
            return F.coalesce(near[side][field], F.lit(0)) if side else block[field]

        return decided(tree(), value)

    text = F.array_join(F.transform(F.filter("blocks", chosen), lambda b: b["text"]), "\n")
    return cut.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
