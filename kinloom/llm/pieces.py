"""Ids of whole texts, word by word.

With the word vocabulary used here no merge, normalisation or pre-token crosses ASCII
white space, so a text's ids are those of its words in order. Words repeat, so each
worker keeps the ids of the words it has met.
"""

from __future__ import annotations

import numpy as np

from .common import kept, tokenizer

WORDS = 800_000  # words that a worker keeps, in two generations
LONGEST = 64  # bytes of a word that is kept


def plain_case(text: bytes) -> bytes:
    """The text in lower case (A-Z) where that can't change its ids.

    The vocabulary lower-cases anyway. But control strings are matched before that, and a
    small letter may combine with a mark (U+0300 to U+036F) where its capital doesn't.
    """
    if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
        return text
    return text.lower()


class WordIds:
    """Ids of words as little-endian unsigned 32-bit integers, with a bounded memory of words.

    Words met lately are in the new generation; when it is full, it becomes the old one
    and what only the old one had is forgotten.
    """

    def __init__(self, json_text: str, words: int = WORDS):
        self.encoder, self.half, self.new, self.old = tokenizer(json_text), words // 2, {}, {}

    def of_words(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.new.get, words))
        if None not in found:
            return found
        missing = {w for w, ids in zip(words, found) if ids is None}
        made = {w: ids for w in missing if (ids := self.old.get(w)) is not None}
        strange = list(missing.difference(made))
        coded = self.encoder.encode_batch_fast([w.decode() for w in strange], add_special_tokens=False)
        made.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(strange, coded))
        if len(self.new) + len(made) > self.half:
            self.old, self.new = self.new, {}
        if len(made) <= self.half:
            self.new.update((w, ids) for w, ids in made.items() if len(w) <= LONGEST)
        return [made[w] if ids is None else ids for w, ids in zip(words, found)]

    def of_text(self, text: bytes) -> bytes:
        return b"".join(self.of_words(plain_case(text).split()))


def word_ids(json_text: str) -> WordIds:
    return kept("word ids", hash(json_text), lambda: WordIds(json_text))
