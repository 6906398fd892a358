"""Ids of a word-level BPE tokenizer file, a distinct word at a time.

The tokenizer's own normaliser and splitter treat white space as a boundary that no
token crosses, so a text's ids are the ids of its space-separated words in order. Words
are told apart by 64-bit hashes (see words); each distinct word goes through the
tokenizers library once per worker while a bounded cache holds it, and the ids of the
texts are gathered from the cache in numpy. A word of plain Latin letters, perhaps with
one mark of punctuation behind it, goes straight to the library's merge model; every
other word passes the file's whole chain of normaliser, splitter and model.
"""

from __future__ import annotations

from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from trivalent.llm.words import buffer_of, hash_words, ragged, words_of

#: Distinct words that a Python worker keeps.
CACHE_WORDS = 600_000
#: Words that go to the library in one call.
CALL_WORDS = 20_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordIds:
    def __init__(self, path: str, keep: int = CACHE_WORDS):
        self.keep = keep
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.clear()
        self.marks = {m: self.chain([m])[0] for m in ",.;:!?"}
        self.direct = all(self.straight(w) == self.chain([w])[0] for w in ("Word", "Été", "straße", "a"))

    def clear(self) -> None:
        #: The row of each word's hash; ids of row r are flat[ends[r]:ends[r + 1]].
        self.rows: dict[int, int] = {}
        self.flat, self.ends, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0

    def chain(self, words: list[str]) -> list[list[int]]:
        """The whole chain of the file, many words in one call."""
        done = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ends, ids = np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(words) + 1)).tolist(), done.ids
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def straight(self, word: str) -> list[int]:
        """A word of Latin letters through the merge model alone."""
        word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.merge(word)]

    def ids_of(self, words: list[str]) -> list[list[int]]:
        out, rest = [None] * len(words), []
        for i, word in enumerate(words):
            letters, mark = (word[:-1], word[-1]) if word[-1] in self.marks else (word, "")
            if self.direct and letters.isalpha() and (letters.isascii() or max(letters) < "ɐ" and "İ" not in letters and is_normalized("NFC", letters)):
                out[i] = self.straight(letters) + self.marks.get(mark, [])
            else:
                rest.append(i)
        for at in range(0, len(rest), CALL_WORDS):
            part = rest[at : at + CALL_WORDS]
            for i, ids in zip(part, self.chain([words[i] for i in part])):
                out[i] = ids
        return out

    def learn(self, hashes: list[int], words: list[str]) -> None:
        ids = self.ids_of(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter((x for word in ids for x in word), np.uint32, int(sizes.sum()))
        count, end = len(self.rows), self.used + len(new)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(end, np.uint32)])
        if count + len(ids) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(count + len(ids) + 1, np.int64)])
        self.flat[self.used : end] = new
        self.ends[count + 1 : count + 1 + len(ids)] = self.used + np.cumsum(sizes)
        self.used = end
        self.rows.update(zip(hashes, range(count, count + len(ids))))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, and each text's first place among them (one more at the end)."""
        raw, offsets = buffer_of(column)
        starts, ends, first = words_of(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, sample, which = np.unique(hash_words(raw, starts, ends), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.rows) > self.keep:
            self.clear()
        rows = list(map(self.rows.get, keys))
        missing = [i for i, r in enumerate(rows) if r is None]
        if missing:
            data, places = raw.tobytes(), sample[missing]
            self.learn([keys[i] for i in missing], [data[a:b].decode() for a, b in zip(starts[places].tolist(), ends[places].tolist())])
            rows = list(map(self.rows.__getitem__, keys))
        row = np.array(rows, np.int64)[which]
        begins, sizes = self.ends[row], self.ends[row + 1] - self.ends[row]
        return self.flat[ragged(begins, sizes)], np.concatenate([[0], np.cumsum(sizes)])[first]


@lru_cache(maxsize=2)
def word_ids(path: str, keep: int = CACHE_WORDS) -> WordIds:
    return WordIds(path, keep)
