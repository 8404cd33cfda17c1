"""Class-based bigram language model: exchange clustering, class transitions, word emissions.

Words are clustered in three steps, each with the classes of the one before:
the commonest CORE words one by one, in one task; the commonest VOCABULARY words
all at once in rounds, as Spark jobs over the corpus's counts of neighbouring words; and
every other word of the training texts by its own left neighbours.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinseg.llm.shared import remainder, whole, written
from kinseg.llm.simhash import FOLD
from kinseg.llm.terms import FREQUENT, commonest, term_counts

FOLDS, HELD_OUT = 7, 2
#: Words clustered one by one, words clustered by exchange in all, classes (0 is the edge of a text), rounds of either exchange.
CORE, VOCABULARY, CLASSES, ROUNDS, SPREAD = 512, 20_000, 48, 8, 4
#: What a token follows: a class, or any word beyond the vocabulary.
OTHER, HISTORIES = CLASSES, CLASSES + 1
#: What a token may be: a word of a class, the end of the text (class 0), or a word that the training texts do not have.
UNSEEN, OUTCOMES = CLASSES, CLASSES + 1
#: Smoothing of transitions towards the frequencies of outcomes, as a number of tokens.
PRIOR = 20.0
#: Tokens counted at once, distinct pairs with a rare word held by a task, words assigned at once.
BLOCK, HELD, CHUNK = 1_000_000, 400_000, 256


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z lowered, as UTF-8; the end of the text is counted apart."""
    return text.encode().translate(FOLD).split()


def numbers(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    """Numbers of words in the index, -1 outside."""
    return np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))


def successions(texts: DataFrame, words: list[bytes], vocabulary: int) -> DataFrame:
    """(u, v, term, n): how often v, or the rare word `term` where v is null, follows u, over every row's text.

    Words are numbered from 1 in the order given; 0 is the edge of a text. u is
    at most `vocabulary`, and one more than that for all other words. Each task
    adds up its own, so rows may repeat.
    """
    shared = texts.sparkSession.sparkContext.broadcast(words)
    size, other = len(words) + 1, vocabulary + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i + 1 for i, w in enumerate(shared.value)}
        parts, pending, rare = [], 0, Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, pending
            keys, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
            late = list(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[keys // size, np.array([u for _, u in late], np.int64)].astype(np.int32)),
                    pa.concat_arrays([pa.array((keys % size).astype(np.int32)), pa.nulls(len(late), pa.int32())]),
                    pa.concat_arrays([pa.nulls(len(keys), pa.string()), pa.array([w for w, _ in late], pa.binary()).cast(pa.string())]),
                    pa.array(np.r_[n, np.fromiter(rare.values(), np.int64, len(late))].astype(np.int64)),
                ],
                ["u", "v", "term", "n"],
            )
            parts, pending = [], 0
            rare.clear()

        for batch in batches:
            for text in batch.column(0):
                found = tokens(text.as_py())
                path = np.r_[0, numbers(found, index), 0]
                before = np.where((path < 0) | (path > vocabulary), other, path)[:-1]
                known = path[1:] >= 0
                parts.append(before[known] * size + path[1:][known])
                late = np.flatnonzero(~known)
                rare.update(zip(map(found.__getitem__, late.tolist()), before[late].tolist()))
                pending += len(path)
                if pending > BLOCK or len(rare) > HELD:
                    yield from flush()
        yield from flush()

    return texts.select(whole("text").alias("text")).mapInArrow(count, "u int, v int, term string, n long")


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def gains(right: np.ndarray, left: np.ndarray, pair: np.ndarray, self_n: np.ndarray | float = 0.0) -> np.ndarray:
    """What each unit adds to the likelihood in each class, up to a constant of the unit; never class 0.

    right and left are the counts of classes after and before each unit, self_n how
    often it follows itself, pair the counts of class after class without it.
    """
    self_n = np.reshape(self_n, (-1, 1))
    diagonal = np.einsum("nkk->nk", pair)
    rows = _h(pair + right[:, None, :]) - _h(pair)
    columns = _h(pair + left[:, :, None]) - _h(pair)
    gain = rows.sum(2) - np.einsum("nkk->nk", rows) + columns.sum(1) - np.einsum("nkk->nk", columns)
    gain += _h(diagonal + right + left + self_n) - _h(diagonal)
    # Wherever the unit goes, its neighbours' classes get their side of its pairs back.
    out, into = pair.sum(2) + left, pair.sum(1) + right
    gain -= _h(out + right.sum(1)[:, None] + self_n) - _h(out) + _h(into + left.sum(1)[:, None] + self_n) - _h(into)
    gain[:, 0] = -np.inf
    return gain


def exchange(follow: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit, from the counts follow[u, v] of v after u, by moving one unit at a time.

    Class 0 is the edge of a text alone. The commonest units start in classes of
    their own, the others in turn. Then each unit in order of frequency goes to the class
    that gives the training text the highest likelihood, for some rounds or
    until none moves.
    """
    size = len(follow)
    follow = follow.astype(np.float64)
    order = [u for u in np.argsort(-follow.sum(0), kind="stable") if u != 0]
    own = np.zeros(size, np.int64)
    for i, u in enumerate(order):
        own[u] = 1 + i % (classes - 1)
    member = np.eye(classes)[own]
    ahead, behind = follow @ member, follow.T @ member
    pair = member.T @ ahead
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not ahead[u].any() and not behind[u].any():
                continue
            was, self_n = own[u], follow[u, u]
            right, left = ahead[u].copy(), behind[u].copy()
            right[was] -= self_n
            left[was] -= self_n
            pair[was] -= right
            pair[:, was] -= left
            pair[was, was] -= self_n
            gain = gains(right[None], left[None], pair[None], self_n)[0]
            now = int(np.argmax(gain))
            if gain[now] - gain[was] <= 1e-9:
                now = was
            pair[now] += right
            pair[:, now] += left
            pair[now, now] += self_n
            if now != was:
                moved += 1
                own[u] = now
                ahead[:, was] -= follow[:, u]
                ahead[:, now] += follow[:, u]
                behind[:, was] -= follow[u]
                behind[:, now] += follow[u]
        if not moved:
            break
    return own


def spread(pairs: DataFrame, own: np.ndarray, turn: int) -> np.ndarray:
    """A round of exchange over all words at once: each may move to its best class, given those of its neighbours.

    pairs is (u, v, n) over numbered words, own the class of each number or -1.
    Words that have a class move in one of two rounds only, so that neighbours do
    not swap classes forever. Words after themselves count for no class.
    """
    spark, pairs = pairs.sparkSession, pairs.filter("u <> v")
    known = np.flatnonzero(own >= 0)
    classes = F.broadcast(spark.createDataFrame(pa.table({"x": pa.array(known, pa.int32()), "k": pa.array(own[known], pa.int32())})))
    after = pairs.join(classes.withColumnRenamed("x", "v"), "v").groupBy(F.col("u").alias("w"), (F.col("k") * 2).alias("cell")).agg(F.sum("n").alias("n"))
    before = pairs.join(classes.withColumnRenamed("x", "u"), "u").groupBy(F.col("v").alias("w"), (F.col("k") * 2 + 1).alias("cell")).agg(F.sum("n").alias("n"))
    around = after.unionByName(before).filter("w <> 0")
    pair = np.zeros((CLASSES, CLASSES))
    both = pairs.join(classes.toDF("u", "a"), "u").join(classes.toDF("v", "b"), "v").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for r in both.collect():
        pair[r.a, r.b] = r.n
    shared = spark.sparkContext.broadcast((own, pair))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pair = shared.value
        for batch in batches:
            words, cells = batch.column(0).to_numpy(), batch.column(1)
            counts = np.zeros((len(words), CLASSES * 2))
            flat = cells.flatten()
            counts[np.repeat(np.arange(len(words)), cells.value_lengths().to_numpy()), flat.field("cell").to_numpy()] = flat.field("n").to_numpy()
            now = own[words]
            for start in range(0, len(words), CHUNK):
                part = slice(start, start + CHUNK)
                right, left = counts[part, ::2], counts[part, 1::2]
                without, member = np.repeat(pair[None], len(right), 0), np.flatnonzero(now[part] >= 0)
                was = np.maximum(now[part], 0)
                without[member, was[member]] -= right[member]
                without[member, :, was[member]] -= left[member]
                gain = gains(right, left, without)
                found = gain.argmax(1)
                better = (now[part] < 0) | (gain.max(1) > np.take_along_axis(gain, was[:, None], 1)[:, 0] + 1e-9)
                now[part] = np.where(better, found, now[part])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(now, pa.int32())], ["w", "k"])

    vectors = around.groupBy("w").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    table = vectors.mapInArrow(best, "w int, k int").toArrow()
    words, found = table["w"].to_numpy(), table["k"].to_numpy()
    moves = (own[words] < 0) | ((words + turn) % 2 == 0)
    own = own.copy()
    own[words[moves]] = found[moves]
    return own


def transitions(first: np.ndarray, once: np.ndarray) -> np.ndarray:
    """log10 of the smoothed probability of each outcome after each history.

    first counts classes after histories; words that occur once, counted by
    history in `once`, stand for the ones that the training texts do not have.
    """
    counts = np.hstack([first, once[:, None]])
    usual = (counts.sum(0) + 1) / (counts.sum() + OUTCOMES)
    return np.log10((counts + PRIOR * usual) / (counts.sum(1, keepdims=True) + PRIOR))


class Model:
    """What scoring needs of the training texts. `rare`, a table, grows with them; all else is of bounded size."""

    def __init__(self, train: DataFrame, frequent: int = FREQUENT, vocabulary: int = VOCABULARY, core: int = CORE):
        spark = train.sparkSession
        counts = written(term_counts(train, lambda text: tokens(text)), "words")
        self.texts = train.count()
        sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.total, self.distinct = sums[0] + self.texts, sums[1] + (self.texts > 0)
        common = commonest(counts, frequent)
        listed = sorted(((-r.n, r.term.encode()) for r in counts.filter(common).toLocalIterator()))
        self.words, self.n = [w for _, w in listed], np.array([0, *(-n for n, _ in listed)], np.int64)
        self.vocabulary = min(vocabulary, len(self.words))
        seen = written(successions(train, self.words, self.vocabulary), "successions")
        pairs = written(seen.filter("term is null").groupBy("u", "v").agg(F.sum("n").alias("n")), "pairs")
        within = pairs.filter((F.col("u") <= self.vocabulary) & (F.col("v") <= self.vocabulary))
        own = np.full(self.vocabulary + 1, -1)
        own[: core + 1] = self._core(within.filter((F.col("u") <= core) & (F.col("v") <= core)), min(core, self.vocabulary))
        for turn in range(SPREAD):
            own = spread(within, own, turn)
        own[own < 0] = 1
        #: Class of each numbered word, for those beyond the vocabulary set below.
        self.own = np.r_[own, np.full(len(self.words) - self.vocabulary, -1)]
        self._histories(seen, pairs)
        self.rare = written(self.rare.join(counts.filter(~common), "term").select("term", F.col("n").alias("c"), "k"), "rare-words")

    def _core(self, pairs: DataFrame, size: int) -> np.ndarray:
        """Classes of the edge and the commonest words, by one task over at most (size + 1) squared counts."""

        def cluster(rows: pa.Table) -> pa.Table:
            follow = np.zeros((size + 1, size + 1))
            follow[rows["u"].to_numpy(), rows["v"].to_numpy()] = rows["n"].to_numpy()
            return pa.table({"own": pa.array([exchange(follow).tolist()], pa.list_(pa.int32()))})

        row = pairs.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(cluster, "own array<int>").first()
        return np.array(row.own if row else [0] + [1] * size)

    def _histories(self, seen: DataFrame, pairs: DataFrame) -> None:
        """Classes of the words beyond the vocabulary, and the transitions."""
        spark, size = seen.sparkSession, self.vocabulary
        places = pa.table({"u": pa.array(range(size + 2), pa.int32()), "h": pa.array([*self.own[: size + 1].tolist(), OTHER], pa.int32())})
        places = F.broadcast(spark.createDataFrame(places))
        first, once = np.zeros((HISTORIES, CLASSES)), np.zeros(HISTORIES)
        own = F.broadcast(spark.createDataFrame(pa.table({"v": pa.array(range(size + 1), pa.int32()), "k": pa.array(self.own[: size + 1], pa.int32())})))
        for r in pairs.join(places, "u").join(own, "v").groupBy("h", "k").agg(F.sum("n").alias("n")).collect():
            first[r.h, r.k] = r.n
        shared = spark.sparkContext.broadcast(first)

        @F.arrow_udf("int")
        def best(lists: pa.Array) -> pa.Array:
            """The class whose words are likeliest to follow what the word follows."""
            first = shared.value
            usual = (first.sum(1) + 1) / (first.sum() + HISTORIES)
            follows = np.log((first + PRIOR * usual[:, None]) / (first.sum(0) + PRIOR))
            flat = lists.flatten()
            counts = np.zeros((len(lists), HISTORIES))
            counts[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), flat.field("h").to_numpy()] = flat.field("n").to_numpy()
            fit = counts @ follows
            fit[:, 0] = -np.inf
            return pa.array(fit.argmax(1), pa.int32())

        def placed(rows: DataFrame, key: str) -> DataFrame:
            by = rows.join(places, "u").groupBy(key, "h").agg(F.sum("n").alias("n"))
            lists = by.groupBy(key).agg(F.collect_list(F.struct("h", "n")).alias("hs"), F.sum("n").alias("c"))
            return lists.select(key, "hs", "c", best("hs").alias("k"))

        middle = written(placed(pairs.filter(F.col("v") > size), "v"), "middle-words")
        self.rare = written(placed(seen.filter("term is not null"), "term"), "placed-words")
        for r in middle.select("v", "k").toLocalIterator():
            self.own[r.v] = r.k
        for late in (middle, self.rare):
            each = late.select("c", "k", F.explode("hs").alias("x")).groupBy("x.h", "k").agg(F.sum("x.n").alias("n"), F.sum(F.when(F.col("c") == 1, F.col("x.n")).otherwise(0)).alias("once"))
            for r in each.collect():
                first[r.h, r.k] += r.n
                if late is self.rare:
                    once[r.h] += r.once
        single = np.flatnonzero(self.n[1:] == 1) + 1
        if len(single):  # Numbers fall with frequency, so these are the last ones.
            for r in pairs.filter(F.col("v") >= int(single[0])).join(places, "u").groupBy("h").agg(F.sum("n").alias("n")).collect():
                once[r.h] += r.n
        self.step = transitions(first, once)
        self.size = first.sum(0)
        #: log10 of the probability of each numbered word in its class; the end of a text is all of class 0.
        emit = np.log10(np.maximum(self.n, 1)) - np.log10(np.maximum(self.size[self.own], 1))
        emit[0] = 0.0
        self.emit = emit


def scores(docs: DataFrame, frequent: int = FREQUENT, vocabulary: int = VOCABULARY, core: int = CORE) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id) modulo 7 is not 2 teach. score is log10 of the
    probability of the text: for each token, and for its end, the class given what
    comes before, times the word given its class. A token follows the class of
    the word before it, or OTHER where that is beyond the vocabulary. "A word that
    the training texts do not have" is one outcome, as likely as words that occur
    once there; base_score, the unigram model with one added to each count, likewise has one
    outcome for all of them. After every history the outcomes' probabilities add up to 1.

    Counts cover the whole corpus. Those of the `frequent` commonest words go to
    every executor; the others meet the documents' rare words in a join. Null and
    empty texts consist of their end; rows repeat and null ids stay as they came (an id that is
    no whole number is an error); an empty table gives no rows; without training rows all tokens
    are unseen. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"), (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    model = Model(rows.filter("not held_out"), frequent, vocabulary, core)
    shared = spark.sparkContext.broadcast((model.words, model.n, model.own, model.emit, model.step))
    ends, size = model.texts, model.vocabulary

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, own, emit, step = shared.value
        index = {w: i + 1 for i, w in enumerate(words)}
        histories = np.where(np.arange(len(own)) <= size, own, OTHER)
        base_of = np.log10(n + 1)
        base_of[0] = np.log10(ends + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            at, rare, times, after = [], [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                found = tokens(text.as_py())
                path = np.r_[numbers(found, index), 0]
                before = np.r_[0, np.where(path < 0, OTHER, histories[path])[:-1]]
                known = path >= 0
                here = path[known]
                for column, value in zip(out, (len(path), int(known.sum()) - (ends == 0), float(base_of[here].sum()), float((step[before[known], own[here]] + emit[here]).sum()))):
                    column.append(value)
                late = np.flatnonzero(~known)
                if len(late):
                    each = Counter(zip(map(found.__getitem__, late.tolist()), before[late].tolist()))
                    at += [row] * len(each)
                    rare += [w for w, _ in each]
                    after += [h for _, h in each]
                    times += each.values()
            m = len(rare)
            more = lambda kind: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("row"), pa.array(at, pa.int64())]),
                    pa.concat_arrays([batch.column("doc_id"), more(pa.int64())]),
                    pa.concat_arrays([batch.column("held_out"), more(pa.bool_())]),
                    pa.array(out[0] + times, pa.int64()),
                    pa.concat_arrays([pa.array(out[1], pa.int64()), more(pa.int64())]),
                    pa.concat_arrays([pa.array(out[2], pa.float64()), more(pa.float64())]),
                    pa.concat_arrays([pa.array(out[3], pa.float64()), more(pa.float64())]),
                    pa.concat_arrays([pa.nulls(len(out[0]), pa.string()), pa.array(rare, pa.binary()).cast(pa.string())]),
                    pa.concat_arrays([pa.nulls(len(out[0]), pa.int32()), pa.array(after, pa.int32())]),
                ],
                ["row", "doc_id", "held_out", "n", "n_known", "base", "score", "term", "h"],
            )

    schema = "row long, doc_id long, held_out boolean, n long, n_known long, base double, score double, term string, h int"
    parts = written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(resolve, schema), "scored")
    late = parts.filter("term is not null").select("row", "term", "n", "h")
    # Of each history and outcome, the transition and what a word's count is divided by.
    table = [(h, k, float(model.step[h, k] - (np.log10(max(model.size[k], 1)) if k < UNSEEN else 0))) for h in range(HISTORIES) for k in range(OUTCOMES)]
    steps = F.broadcast(spark.createDataFrame(table, "h int, k int, s double"))
    met = late.join(model.rare, "term", "left").withColumn("k", F.coalesce("k", F.lit(UNSEEN))).join(steps, ["h", "k"])
    found = met.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more_base"),
        F.sum(F.col("n") * (F.col("s") + F.coalesce(F.log10("c"), F.lit(0.0)))).alias("more_score"),
    )
    joined = parts.filter("term is null").join(found, "row", "left")
    zero, scale = F.lit(0), float(np.log10(model.total + model.distinct + 1))
    return joined.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) - F.col("n") * scale).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
