"""Ids of whole texts from a word-level BPE file, each distinct word tokenised once per worker."""

from __future__ import annotations

from struct import pack

import regex

from kinseg.llm.counts import library, spelled
from kinseg.llm.shared import Recent, held

#: Fixed value: the pattern of the word tokenizer's pre-tokenizer.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: Words of these characters need no normaliser but lowering; others go through the library as they are.
PLAIN = regex.compile(r"[!-~¡-Ƞ]+")
#: A worker keeps the ids of so many distinct words and parts of words, for two generations: beside the other stages of a pipeline, and alone.
KEPT, ALONE = 100_000, 300_000
#: What often follows a word; a run of these is one part.
STOPS = b".,;:!?"


class WordIds(Recent):
    """Maps a word's bytes to its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its white-space-separated words in order.
    """

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__(kept, self.of_word)
        self.path = path
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        self.parts = Recent(kept, self.of_part)

    def of_part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(spelled(part))]
        return pack(f"<{len(ids)}I", *ids)

    def of_word(self, word: bytes) -> bytes:
        head = word.rstrip(STOPS)
        if head.isalpha():  # of bytes: A-Z and a-z only
            ids = self.parts[head.lower().decode()]
            return ids if head == word else ids + self.parts[word[len(head) :].decode()]
        text = word.decode()
        if "<|" in text or not PLAIN.fullmatch(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.parts.__getitem__, PATTERN.findall(text.lower())))

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


def word_ids(path: str, kept: int = KEPT) -> WordIds:
    """One cache per Python worker, kept between its tasks."""
    return held(("word ids", path, kept), lambda: WordIds(path, kept))
