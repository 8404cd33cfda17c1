"""Toxicity from subword bags: character n-gram vectors, averaged over short windows, into a linear softmax."""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinseg.llm.shared import held, release, remainder, whole, written

TOKEN = re.compile(r"[^\W_]+(?:['’*@$!][^\W_]+)*")
#: Hashed subword buckets, width of a vector, lengths of the character n-grams.
BUCKETS, WIDTH, NGRAMS = 1 << 18, 8, (4, 5)
#: Words averaged together. A text is as toxic as its worst window, so length does not dilute it.
SPAN = 8
#: Bound of the labelled sample: at most so many documents of either label.
SAMPLE = 1_500
#: Subwords seen in fewer sample documents keep the zero vector; of few toxic ones, a fortieth of them will do.
LEAST_DOCS = 20
#: Descent over each text's worst window: steps, rate, momentum, decay.
STEPS, RATE, MOMENTUM, DECAY, SEED = 30, 100.0, 0.9, 0.003, 7
FOLDS = 5
#: Training gathers so many rows of vectors at a time, some 16 MB.
BLOCK = 1 << 19
#: A worker keeps the weights of so many distinct words, then starts anew.
KEPT = 200_000


def subwords(word: str) -> list[int]:
    """Buckets of a lower-case word: the whole of it, and its n-grams, with the ends marked."""
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)}
    return [crc32(g.encode()) % BUCKETS for g in grams]


def _sums(values: np.ndarray, at: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Row sums of values[at] by their sorted owner; some BLOCK rows are gathered at a time, whole owners only."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        cuts = np.unique(np.r_[np.searchsorted(first, np.arange(0, len(owner), BLOCK)), len(first)])
        for a, b in zip(cuts, cuts[1:]):
            low, high = first[a], first[b] if b < len(first) else len(owner)
            out[owner[first[a:b]]] = np.add.reduceat(values[at[low:high]], first[a:b] - low, axis=0)
    return out


def _weighed(unit: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n units the sum of weight[owner] (whole numbers, so the blocks do not show)."""
    out = np.zeros(n)
    for a in range(0, len(unit), BLOCK):
        out += np.bincount(unit[a : a + BLOCK], weights=weight[owner[a : a + BLOCK]], minlength=n)
    return out


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, gain, bias): vectors of subwords and the softmax over them, learnt together.

    Two classes need one difference of softmax rows, w. A word is the mean of its
    subwords' vectors, a window the mean of its words, and its logit is w . mean
    + bias. Vectors start at how much likelier their subword is under label 1;
    then each step fits, for every text, the window with the largest logit, and
    moves vectors, w and bias together, both labels weighing the same. As all is
    linear after the averages, scoring needs only gain = vector . w of each subword.
    """
    if len(set(labels)) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
    rng = np.random.default_rng(SEED)
    ids: dict[str, int] = {}
    word_of, window_of, sizes, text_of = array("i"), array("i"), array("i"), array("i")
    for k, text in enumerate(texts):
        words = TOKEN.findall(text.lower())
        for start in range(0, max(len(words), 1), SPAN):
            part = words[start : start + SPAN]
            window_of.extend([len(sizes)] * len(part))
            word_of.extend(ids.setdefault(w, len(ids)) for w in part)
            sizes.append(max(len(part), 1))
            text_of.append(k)
    word_of, window_of, text_of = (np.frombuffer(a, np.int32) if len(a) else np.zeros(0, np.int32) for a in (word_of, window_of, text_of))
    sizes, y, n_words, n_windows, n_texts = np.frombuffer(sizes, np.int32).astype(np.float32)[:, None], np.array(labels, np.float32), len(ids), len(sizes), len(texts)
    if not n_words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
    flat, lengths = array("i"), np.zeros(n_words, np.float32)
    for word, i in ids.items():
        own = subwords(word)
        flat.extend(own)
        lengths[i] = len(own)
    ids.clear()
    unit, owner = np.frombuffer(flat, np.int32), np.repeat(np.arange(n_words, dtype=np.int32), lengths.astype(np.int64))
    in_texts = text_of[window_of].astype(np.int64) * n_words
    in_texts += word_of
    in_texts = np.unique(in_texts)
    per_label = [np.bincount(in_texts[y[in_texts // n_words] == t] % n_words, minlength=n_words) for t in (0, 1)]
    del in_texts
    often = _weighed(unit, per_label[0] + per_label[1], owner, BUCKETS) >= max(3, min(LEAST_DOCS, int(y.sum()) // 40))
    taken = often[unit]
    buckets = np.flatnonzero(often & (np.bincount(unit, minlength=BUCKETS) > 0))
    unit, owner, lengths = (np.cumsum(often, dtype=np.int32) - 1)[unit[taken]], owner[taken], lengths[:, None]
    del flat, taken
    if not len(buckets):
        return buckets, np.zeros(0, np.float32), 0.0
    by_unit = np.argsort(unit, kind="stable")
    sorted_unit, unit_owner = unit[by_unit], owner[by_unit]
    del by_unit
    by_word = np.argsort(word_of, kind="stable")
    sorted_word, word_window = word_of[by_word], window_of[by_word]
    del by_word
    first_window = np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]])
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n_texts - y.sum(), 1)).astype(np.float32)
    vectors, w, bias = rng.normal(0, 0.01, (len(buckets), WIDTH)).astype(np.float32), rng.normal(0, 0.01, WIDTH).astype(np.float32), 0.0
    usual = [(_weighed(unit, c, owner, len(buckets)) + 0.5) / (np.bincount(y > 0, minlength=2)[t] + 1) for t, c in enumerate(per_label)]
    vectors[:, 0] += (np.log(usual[1]) - np.log(usual[0])).astype(np.float32)
    w[0] += 1
    speed, speed_w = np.zeros_like(vectors), np.zeros_like(w)
    for step in range(STEPS):
        means = _sums(_sums(vectors, unit, owner, n_words) / lengths, word_of, window_of, n_windows) / sizes
        logit = means @ w + bias
        highest = np.maximum.reduceat(logit, first_window)
        if step == 0:
            middle, apart = (highest[y > 0].mean() + highest[y == 0].mean()) / 2, highest[y > 0].mean() - highest[y == 0].mean()
            w, bias = w * 4 / max(apart, 1e-3), -middle * 4 / max(apart, 1e-3)
            continue
        top = np.flatnonzero(logit == highest[text_of])
        text, first = np.unique(text_of[top], return_index=True)
        slope = np.zeros(n_windows, np.float32)
        slope[top[first]] = (1 / (1 + np.exp(-np.clip(logit[top[first]], -30, 30))) - y[text]) * weight[text]
        speed_w = MOMENTUM * speed_w + means.T @ slope
        on_word = _sums((slope / sizes[:, 0])[:, None] * w, word_window, sorted_word, n_words) / lengths
        speed = MOMENTUM * speed + _sums(on_word, unit_owner, sorted_unit, len(buckets))
        vectors -= RATE * speed + DECAY * vectors
        w = w - RATE / 1000 * speed_w
        bias -= 0.5 * float(slope.sum())
    return buckets, vectors @ w, bias


class Scorer(dict):
    """Maps a word to its weight; scores texts."""

    def __init__(self, gain: np.ndarray, bias: float):
        super().__init__()
        self.gain, self.bias = gain, bias

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = float(self.gain[subwords(word)].mean())
        return found

    def score(self, text: str) -> float:
        """Probability of label 1 by the worst window; windows overlap by half."""
        words = TOKEN.findall(text.lower())
        if not words:
            return 1 / (1 + np.exp(-self.bias))
        total = np.cumsum(np.r_[0.0, np.fromiter(map(self.__getitem__, words), float, len(words))])
        start = np.arange(0, max(len(words) - SPAN // 2, 1), SPAN // 2)
        end = np.minimum(start + SPAN, len(words))
        worst = ((total[end] - total[start]) / (end - start)).max() + self.bias
        return float(1 / (1 + np.exp(-np.clip(worst, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The model of train() from at most `sample` documents of each label, or None where a label is missing.

    Only rows whose crc32(doc_id) modulo 5 is not 0 teach; of these the ones with
    the smallest hashes of doc_id. They are at most 2 * sample rows, so they are
    sent to where the texts are, and one task fits the model.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", FOLDS) != 0))
    share = usable.agg(F.avg("toxic")).first()[0]
    if share in (None, 0.0, 1.0):
        return None
    picked = [usable.filter(F.col("toxic") == t).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    picked = written(picked[0].unionByName(picked[1]), "labelled")
    texts = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(picked), "doc_id").withColumn("one", F.lit(0))

    def fitted(rows: pa.Table) -> pa.Table:
        release()
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        buckets, gain, bias = train(rows["text"].to_pylist(), rows["toxic"].to_pylist())
        return pa.table({"buckets": pa.array([buckets.astype("<i4").tobytes()]), "gain": pa.array([gain.astype("<f4").tobytes()]), "bias": pa.array([float(bias)])})

    row = texts.groupBy("one").applyInArrow(fitted, "buckets binary, gain binary, bias double").first()
    if row is None:
        return None
    return np.frombuffer(row.buckets, "<i4"), np.frombuffer(row.gain, "<f4"), row.bias


def score_column(text: Column, model, spark) -> Column:
    """Score of every text by a model of fit(); 0 for all without one."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)
    name = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        def make() -> Scorer:
            buckets, gain, bias = shared.value
            dense = np.zeros(BUCKETS, np.float32)
            dense[buckets] = gain
            return Scorer(dense, bias)

        scorer = held(("toxicity", name), make)
        return pa.array([scorer.score(t.as_py() or "") for t in texts], pa.float64())

    return of(text)


def toxicity(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    The score sees the text only. A null or empty text gets the score of no words;
    rows repeat and null ids stay as they came; labels without text teach nothing; without rows of
    both labels every score is 0. An empty table gives no rows. Other columns are ignored.
    """
    model = fit(docs, labels, **limits)
    scored = docs.select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), score_column(whole("text"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, **limits) -> DataFrame:
    """The documents that toxicity() predicts 0 for, all columns as they came.

    The texts of labelled rows come from `corpus` where it is given (docs may lack some by now).
    """
    model = fit(docs if corpus is None else corpus, labels, **limits)
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    scored = plain.withColumn("score", score_column(whole(f"c{columns.index('text')}"), model, docs.sparkSession))
    return scored.filter(F.col("score") < 0.5).drop("score").toDF(*columns)
