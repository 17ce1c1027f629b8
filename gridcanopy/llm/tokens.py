"""Whole-text tokenisation by a public vocabulary, through a cache of the encodings of words."""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps for good, further ones that it keeps for a while, and characters of texts
#: whose words are looked up together.
CACHE_WORDS, YOUNG_WORDS, GROUP_CHARS = 700_000, 200_000, 1 << 23
#: Characters that Python's and Arrow's splits drop and the tokenizer does not take for white space.
_ODD = "\x1c\x1d\x1e\x1f"
# Fixed: the vocabulary's token runs, over lower-cased ASCII.
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Below this code point letters are lower-cased one for one by every Unicode version.
_LATIN = "ɐ"

_encoders: dict[str, WordEncoder] = {}


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


def word_encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder for a vocabulary file; its cache outlives the task."""
    path = _path(path)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget_words(path: str | None = None) -> None:
    """Drop the worker's encoder for a vocabulary file, with its cache."""
    _encoders.pop(_path(path), None)


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in own:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(256 + k)
    return out


class Runs(dict):
    """The ids of token runs, given in letters that stand for bytes; each run is merged once."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, run: str) -> list[int]:
        self[run] = ids = [t.id for t in self.merge(run)]
        return ids


class WordEncoder:
    """Encode texts as bytes of little-endian unsigned 32-bit ids.

    ``word_bpe_49k.json`` never joins characters across white space, so a text's ids are the ids of
    its white-space-separated words in order.  Arrow splits a group of texts and numbers its distinct
    words, each is looked up once, and the ids of all words are gathered by number.  A word that is not
    in the cache goes through the library: one of printable ASCII or of Latin letters is lower-cased and
    cut into token runs here and only merged there; others, and whole texts with characters on whose
    class Arrow and the library disagree, pass all its steps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.number: dict[str, int] = {}
        self.young: dict[str, int] = {}
        # ids of all kept words one after another; where each word's begin and how many they are
        self.pool, self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_words = self.n_ids = 0

    def _each(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids(self, word: str, runs: Runs) -> list[int] | None:
        """The ids of a word by its runs, None if the library has to find them."""
        if word.isascii():
            if not word.isprintable() or "<|" in word:
                return None
            low = word.lower()
            return runs[low] if low.isalpha() else [i for r in RUNS.findall(low) for i in runs[r]]
        if word.isalpha() and max(word) < _LATIN and unicodedata.is_normalized("NFC", word):
            low = word.lower()
            if len(low) == len(word):
                return runs["".join(map(self.letters.__getitem__, low.encode()))]
        return None

    def _learn(self, words: list[str]) -> np.ndarray:
        """Put words that are not cached into the pool: their numbers."""
        young = bool(self.young) or len(self.number) + len(words) > CACHE_WORDS
        if young and len(self.young) + len(words) > YOUNG_WORDS:
            self.young.clear()
            self.n_words = len(self.number)
            self.n_ids = int(self.at[self.n_words - 1] + self.size[self.n_words - 1]) if self.n_words else 0
        runs = Runs(self.merge)
        found = [self._ids(w, runs) for w in words]
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, self._each([words[k] for k in rest])):
            found[k] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        lo, hi = self.n_words, self.n_words + len(words)
        self.at, self.size = _room(self.at, hi), _room(self.size, hi)
        self.pool = _room(self.pool, self.n_ids + len(ids))
        self.size[lo:hi] = sizes
        self.at[lo:hi] = self.n_ids + np.cumsum(sizes) - sizes
        self.pool[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_words, self.n_ids = hi, self.n_ids + len(ids)
        (self.young if young else self.number).update(zip(words, range(lo, hi)))
        return np.arange(lo, hi)

    def _numbers(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(out < 0)
        if len(miss) and self.young:
            out[miss] = np.fromiter((self.young.get(words[k], -1) for k in miss.tolist()), np.int64, len(miss))
            miss = miss[out[miss] < 0]
        if len(miss):
            old = out[out >= len(self.number)]
            if len(old) and len(self.young) + len(miss) > YOUNG_WORDS:  # the young ones found here are about to go
                miss = np.flatnonzero((out < 0) | (out >= len(self.number)))
            out[miss] = self._learn([words[k] for k in miss.tolist()])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if any(c in text for c in _ODD):
                out += self._group(held)
                held, size = [], 0
                out.append(np.array(self._each([text])[0], "<u4").tobytes())
                continue
            held.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                out += self._group(held)
                held, size = [], 0
        return out + self._group(held)

    def _group(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct = pc.binary_join(_one_list(words.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        if not len(words):
            return [b""] * len(texts)
        number = self._numbers(distinct)
        which = words.indices.to_numpy()
        size = self.size[number][which]
        ends = np.cumsum(size)
        narrow = np.int32 if max(len(self.pool), int(ends[-1])) < 1 << 31 else np.int64
        place = np.repeat((self.at[number][which] - ends + size).astype(narrow), size)
        place += np.arange(ends[-1], dtype=narrow)
        ids = self.pool[place].astype("<u4", copy=False)
        cuts = (4 * np.append(0, ends)[split.offsets.to_numpy()]).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _one_list(values: pa.Array) -> pa.Array:
    """One list that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, made longer by doubling if it is too short for ``n``."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out
