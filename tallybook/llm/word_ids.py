"""Token ids of the word-end BPE vocabulary, with every distinct word encoded once per Python worker."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers (about 70 MB); beyond that it drops the latest quarter.
REMEMBERED = 400_000
#: Of these it keeps so many when a task ends (a few tens of MB): the common ones, which come early.
KEPT = 150_000
#: Characters that one call of the tokenizer gets, a longer word excepted.
CALL_CHARS = 100_000


class WordIds:
    """Encodes texts as the tokenizers library does without special tokens.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so a text's ids are those of its words
    between spaces, tabs and line ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self):
        self.index: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _learn(self, words: list[str]):
        at, counts, flat = 0, [], [self.flat]
        while at < len(words):
            end, chars = at, 0
            while end < len(words) and (end == at or chars + len(words[end]) < CALL_CHARS):
                chars += len(words[end]) + 1
                end += 1
            part = words[at:end]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0, *[len(w) + 1 for w in part]])
            owner = np.searchsorted(begins, np.array([o[0] for o in got.offsets], np.int64), side="right") - 1
            counts.append(np.bincount(owner, minlength=len(part)))
            flat.append(np.array(got.ids, np.uint32))
            at = end
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.flat = np.concatenate(flat)
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(np.concatenate(counts))]

    def keep_first(self, n: int = KEPT):
        """Drop what came last: common words come early."""
        if len(self.index) <= n:
            return
        self.index = dict(islice(self.index.items(), n))
        self.starts = self.starts[: len(self.index) + 1]
        self.flat = self.flat[: self.starts[-1]].copy()

    @staticmethod
    def _key(word: str) -> str:
        return word.lower() if word.isascii() and "<|" not in word else word

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text. Null counts as empty."""
        rows = pa.array([t or "" for t in texts], pa.string())
        for blank in "\n\t\r":
            rows = pc.replace_substring(rows, blank, " ")
        words = pc.split_pattern(rows, " ")
        sizes = pc.list_value_length(words).to_numpy().astype(np.int64)
        if not sizes.sum():
            return np.empty(0, np.uint32), np.zeros(len(rows), np.int64)
        coded = words.flatten().dictionary_encode()
        codes, unique = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        keys = list(map(self._key, unique))
        new = [k for k in dict.fromkeys(keys) if k not in self.index]
        if new:
            self._learn(new)
        word = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[codes]
        lengths = np.diff(self.starts)[word]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[word] - (ends - lengths), lengths) + np.arange(int(ends[-1]))
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
        out = self.flat[places], np.diff(bounds)
        if len(self.index) > REMEMBERED:
            self.keep_first(REMEMBERED * 3 // 4)
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def batch_rows(texts: list, chars: int = 2_000_000):
    """Slices of a batch that hold about so many characters each; behind each, Arrow gives back what memory it keeps unused."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or i + 1 == len(texts):
            yield slice(at, i + 1)
            at, held = i + 1, 0
            pa.default_memory_pool().release_unused()
