"""Quality rules on tokeniser fertility: how well a public vocabulary fits a text, against bands per language or script."""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinseg.llm.shared import LOWER, UPPER, held, whole, written

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Byte-fallback pieces of the vocabulary are ids 3 to 258.
FIRST_BYTE, PAST_BYTES = 3, 259
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai")
#: A worker keeps the pieces of so many distinct words, then starts anew: beside the other stages of a pipeline, and alone.
KEPT, ALONE = 200_000, 400_000
#: A band reaches so many interquartile ranges from the median; both sides are also at least FLOOR wide,
#: about the reach that the distinct texts of one language give.
REACH = 4.0
FLOOR = {"chars_per_token": 0.16, "chars_per_token_multi": 0.16, "byte_share": 0.1, "entropy": 0.36}
#: Quartiles are taken of values in steps of one over GRID, of lengths in steps of one over LENGTHS of a natural logarithm.
GRID, LENGTHS = 1000, 100
#: Quartiles of n texts are uncertain by some root of n: bands are wider by this over that root.
UNSURE = 3.0
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
MEASURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,chars_per_token:double,chars_per_token_multi:double,byte_share:double,entropy:double,stratum:string,digest:bigint>"


class Pieces(dict):
    """Maps a word's bytes to its piece ids as unsigned 16-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__()
        self.kept = kept
        from sentencepiece import SentencePieceProcessor

        self.encode = SentencePieceProcessor(model_file=path).encode

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        found = self[word] = np.array(self.encode(word.decode()), "<u2").tobytes()
        return found


class Counts(dict):
    """Maps a word's bytes to the number of its tokens, with the space before it, in a file of byte-level ranks."""

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__()
        self.kept = kept
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.kept:
            self.clear()
        found = self[word] = len(self.encode(" " + word.decode()))
        return found


def vocabularies(path: str, multi: str, kept: int = KEPT) -> tuple[Pieces, Counts]:
    return held(("fertility", path, multi, kept), lambda: (Pieces(path, kept), Counts(multi, kept)))


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen = Counter(zip(words, words[1:], words[2:]))
    if len(seen) == n:
        return 0
    often = np.fromiter(map(seen.__getitem__, zip(words, words[1:], words[2:])), np.int64, n) > 1
    inside = np.zeros(n + 2, bool)
    for shift in range(3):
        inside[shift : shift + n] |= often
    return int(inside.sum())


def script(text: str) -> str:
    """The script of most letters among the text's distinct characters weighted by use; 'none' without letters."""
    use = Counter(text)
    best = {s: sum(n for c, n in use.items() if regex.match(rf"\p{{{s}}}", c)) for s in SCRIPTS}
    name = max(best, key=best.get)
    return name if best[name] else "none"


def measure(text: str, lang: str | None, vocabulary: Pieces, multi: Counts) -> tuple:
    """The values of MEASURES for one text."""
    raw = text.encode()
    words = raw.split()
    n_chars = len(text) - sum(map(text.count, BLANKS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ids = np.frombuffer(b"".join(map(vocabulary.__getitem__, words)), "<u2")
    stratum = lang or f"script {script(text)}"
    last = (stratum, xxhash.xxh64_intdigest(b" ".join(words).translate(FOLD)) - 2**63)
    base = (len(words), n_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))
    if not len(ids):
        return (*base, 0.0, 0.0, 0.0, 0.0, *last)
    uses = np.bincount(ids)
    share = uses[uses > 0] / len(ids)
    entropy = float(-(share * np.log2(share)).sum() / np.log2(len(ids))) if len(ids) > 1 else 0.0
    return (*base, n_chars / len(ids), n_chars / sum(map(multi.__getitem__, words)), float(uses[FIRST_BYTE:PAST_BYTES].sum() / len(ids)), entropy, *last)


def measures(text: Column, lang: Column, path: str, multi: str, kept: int = KEPT) -> Column:
    """Column of MEASURES; path is a SentencePiece model file, multi a file of byte-level ranks for many languages."""
    fields = [f.split(":")[0] for f in MEASURES[7:-1].split(",")]
    kinds = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.string(), pa.int64()]

    @F.arrow_udf(MEASURES)
    def of(texts: pa.Array, langs: pa.Array) -> pa.Array:
        known = vocabularies(path, multi, kept)
        rows = [measure(t.as_py() or "", x, *known) for t, x in zip(texts, langs.to_pylist())]
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)

    return of(text, lang)


def base_failed() -> Column:
    return (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))


def bands(measured: DataFrame, reach: float = REACH) -> DataFrame:
    """stratum, words (median length) and <measure>_mid, <measure>_reach per language or script, from its own sound documents.

    Texts that differ in space and the case of A-Z only count once, so copies
    cannot pull a band onto themselves. The fewer texts a stratum has, the wider its bands.
    Quartiles are exact up to the grid: values are counted by step, on the map
    side first, so that a hot language sends one row per step and task, and the
    same table gives the same bands however it is partitioned.
    """
    values = F.struct("m.n_words", *(f"m.{name}" for name in FLOOR))
    once = measured.filter(~F.col("failed")).groupBy(F.col("m.stratum").alias("stratum"), F.col("m.digest").alias("digest")).agg(F.min(values).alias("m"))
    steps = [F.struct(F.lit(name).alias("name"), F.round(F.col(f"m.{name}") * GRID).cast("long").alias("step")) for name in FLOOR]
    steps.append(F.struct(F.lit("words").alias("name"), F.round(F.log("m.n_words") * LENGTHS).cast("long").alias("step")))
    counted = once.select("stratum", F.explode(F.array(*steps)).alias("x")).groupBy("stratum", "x.name", "x.step").agg(F.count("*").alias("n"))
    own = Window.partitionBy("stratum", "name")
    placed = counted.withColumn("docs", F.sum("n").over(own)).withColumn("below", F.sum("n").over(own.orderBy("step")))
    quarter = {q: F.min(F.when(F.col("below") * 4 >= F.col("docs") * q, F.col("step"))) for q in (1, 2, 3)}
    found = placed.groupBy("stratum", "name").agg(F.first("docs").alias("docs"), *(column.alias(f"q{q}") for q, column in quarter.items()))
    wider = 1 + UNSURE / F.sqrt("docs")
    out = [F.max(F.when(F.col("name") == "words", F.exp(F.col("q2") / LENGTHS))).alias("words")]
    for name, floor in FLOOR.items():
        its = F.col("name") == name
        out.append(F.max(F.when(its, F.col("q2") / GRID)).alias(f"{name}_mid"))
        out.append(F.max(F.when(its, wider * F.greatest(reach * (F.col("q3") - F.col("q1")) / GRID, F.lit(floor)))).alias(f"{name}_reach"))
    return found.groupBy("stratum").agg(*out)


def judged(measured: DataFrame, **limits) -> DataFrame:
    """measured (with `m` and `failed`) plus `kept`: not failed, and every measure within the band of its stratum.

    A text shorter than its stratum's median length gets a band wider by the root
    of how much shorter it is, as its shares vary that much more. Entropy and
    characters per token of both vocabularies are bounded on both sides, byte fallback above only.
    """
    limit = written(bands(measured, **limits), "bands")
    joined = measured.join(limit, F.col("m.stratum") == F.col("stratum"), "left")
    slack = F.sqrt(F.greatest(F.lit(1.0), F.col("words") / F.greatest(F.col("m.n_words"), F.lit(1))))
    far = {n: (F.col(f"m.{n}") - F.col(f"{n}_mid")) / (F.col(f"{n}_reach") * slack) for n in FLOOR}
    fits = far["byte_share"] <= 1
    for name in ("chars_per_token", "chars_per_token_multi", "entropy"):
        fits = fits & (F.abs(far[name]) <= 1)
    return joined.select(*(measured[c] for c in measured.columns), (~F.col("failed") & F.coalesce(fits, F.lit(True))).alias("kept"))


def quality(docs: DataFrame, path: str, multi: str, **limits) -> DataFrame:
    """One row per document: doc_id, the base counts, the four fertility measures, stratum, base_failed, kept.

    A null or empty text has no words and fails the base rules; a null lang is
    judged by the script of the text; repeated rows and null ids come back as
    they came; an empty table gives no rows. Other columns are ignored.
    """
    seen = docs.select("doc_id", measures(whole("text"), F.col("lang").cast("string"), path, multi, ALONE).alias("m"))
    seen = written(seen.withColumn("failed", base_failed()), "fertility")
    return judged(seen, **limits).select("doc_id", "m.*", F.col("failed").alias("base_failed"), "kept").drop("digest")


def keep_sound(docs: DataFrame, path: str, multi: str, **limits) -> DataFrame:
    """The documents that quality() keeps, all columns as they came; nulls, empty texts, repeated rows and empty tables as there."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text, lang = (F.col(f"c{columns.index(c)}") for c in ("text", "lang"))
    seen = written(plain.withColumn("m", measures(whole(text), lang.cast("string"), path, multi)).withColumn("failed", base_failed()), "fertility")
    return judged(seen, **limits).filter("kept").select(*plain.columns).toDF(*columns)
