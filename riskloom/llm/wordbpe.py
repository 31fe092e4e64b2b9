"""Token ids of whole texts by a public word-level BPE file, with a bounded memory of words per Python worker.

The vocabulary drops white space and never merges across it, so the ids of a text are those of its words between ASCII white space,
one after the other. Nor does it merge from a letter to the sign after it, so a stem of letters and the signs that follow are
encoded each for itself; since the vocabulary composes and lower-cases a word first, which turns some letters into a letter and a
mark (the capital I with a dot, some of Devanagari), only a stem that is all letters after that is parted. A batch's words are numbered by Arrow, each distinct word
is encoded once, and the ids are laid out by index. A worker keeps the words it met first, up to a bound.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict[str, WordBpe] = {}
SIGNS = ".,!?;:&%$#*"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """max_words bounds each of two tables: spellings as they stand, and the stems and signs that they are made of."""

    def __init__(self, path: str, max_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        self.stems: dict[str, bytes] = {}
        self.known: dict[str, int] = {}
        self.pool, self.begins = np.empty(0, np.uint32), np.zeros(1, np.int64)  # the ids of word k: pool[begins[k]:begins[k + 1]]

    def _encode(self, stems: list[str]) -> dict[str, bytes]:
        """The stems are encoded as one text and the ids dealt out by where each begins."""
        found = self.tokenizer.encode(" ".join(stems), add_special_tokens=False)
        ends = np.cumsum([len(s) + 1 for s in stems])
        begins = np.array([start for start, _ in found.offsets], np.int64)
        ids = np.array(found.ids, "<u4").tobytes()
        cuts = [0, *(4 * np.searchsorted(begins, ends)).tolist()]
        return {s: ids[cuts[i] : cuts[i + 1]] for i, s in enumerate(stems)}

    @staticmethod
    def parts(word: str) -> tuple[str, ...]:
        """What is encoded for itself: the letters, without capitals of ASCII, and the signs that follow them."""
        if word.isascii():
            word = word.lower()
        stem = word.rstrip(SIGNS)
        letters = stem if stem.isascii() else unicodedata.normalize("NFC", stem).lower()
        return (stem, word[len(stem) :]) if len(stem) < len(word) and letters.isalpha() else (word,)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each of the words, which are distinct, and a pool and begins that hold them all."""
        known, stems = self.known, self.stems
        number = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        unmet = np.flatnonzero(number < 0)
        if not len(unmet):
            return number, self.pool, self.begins
        new = [words[i] for i in unmet.tolist()]
        split = [self.parts(w) for w in new]
        missing = list({s for parts in split for s in parts if s not in stems})
        fresh: dict[str, bytes] = {}
        for at in range(0, len(missing), 2000):
            fresh |= self._encode(missing[at : at + 2000])
        if len(stems) + len(fresh) <= self.max_words:
            stems.update(fresh)
            fresh = stems
        ids = [b"".join([fresh[s] if s in fresh else stems[s] for s in parts]) for parts in split]
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(x) // 4 for x in ids])])
        number[unmet] = np.arange(len(self.begins) - 1, len(begins) - 1)
        if len(known) + len(new) <= self.max_words:
            known.update(zip(new, number[unmet].tolist(), strict=True))
            self.pool, self.begins = pool, begins
        return number, pool, begins

    def encode_texts(self, texts: list[str] | pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begins): the ids of text k with end after them are ids[begins[k]:begins[k + 1]]. A null text counts as empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        # words hold no space, so all of them become Python's as one text
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py().split(" ") if len(coded.dictionary) else []
        number, pool, begins = self._words(words)
        word = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
        # one more "word" after each text: the end id, which lies behind the pool
        pool = np.append(pool, np.uint32(end))
        stops = np.asarray(split.offsets)[1:] - np.asarray(split.offsets)[0]
        word_begin, word_length = np.insert(begins[:-1][word] if len(word) else word, stops, len(pool) - 1), np.insert(np.diff(begins)[word] if len(word) else word, stops, 1)
        at = np.concatenate([[0], np.cumsum(word_length)])
        ids = pool[np.repeat(word_begin - at[:-1], word_length) + np.arange(at[-1])]
        return ids, np.concatenate([[0], at[stops + np.arange(1, len(stops) + 1)]])


def encoder(path: str) -> WordBpe:
    """The worker's encoder for this file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]
