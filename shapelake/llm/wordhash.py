"""Hashes of words and of runs of words, the same on every worker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

from shapelake.llm.common import SPACE_CLASS, WORD

BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Characters of text that a worker takes up at once.
BLOCK_CHARS = 300_000

#: Bytes of texts that are hashed at once, and of the longest word that is hashed with others.
CHUNK, LONG_WORD = 1 << 18, 64

_low_bytes = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_odd = np.uint64(BASE_2)
_word, _space = re.compile(WORD), re.compile(SPACE_CLASS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Memo of 64-bit word hashes, emptied when its words hold over `limit` characters; long words are not kept."""

    limit, longest = 1_500_000, 48

    def __init__(self) -> None:
        super().__init__()
        self.chars = 0

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= self.longest:
            if self.chars > self.limit:
                self.empty()
            self.chars += len(word) + 8
            self[word] = h
        return h

    def of(self, words: Iterable[str], n: int = -1) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)

    def empty(self) -> None:
        self.clear()
        self.chars = 0


_hashes = WordHashes()


def forget() -> None:
    """Empties the memo, for the end of a task: workers live on between tasks."""
    _hashes.empty()


def split(text: str | None) -> list[str]:
    return _word.findall(text) if text else []


class Piece(NamedTuple):
    """Words of a text from its word number `first` on; of them `own` aren't again in the text's next piece."""

    row: int
    first: int
    words: list[str]
    own: int


def parts(row: int, text: str | None, overlap: int, most_chars: int) -> Iterator[Piece]:
    """A text as one piece, or a long one as pieces of about most_chars; each has the last `overlap` words of the one before."""
    if not text or len(text) <= most_chars:
        words = split(text)
        yield Piece(row, 0, words, len(words))
        return
    at, first, tail = 0, 0, []
    while at < len(text):
        gap = _space.search(text, at + most_chars)
        stop = gap.start() if gap else len(text)
        words = tail + _word.findall(text, at, stop)
        own = len(words) if stop == len(text) else max(len(words) - overlap, 0)
        yield Piece(row, first, words, own)
        at, first, tail = stop, first + own, words[own:]


def word_blocks(texts: pa.Array, overlap: int = 0, most_chars: int = BLOCK_CHARS, most_texts: int = 4096) -> Iterator[list[Piece]]:
    """Pieces of all texts in lists of about most_chars, so that what a worker holds at once has a bound, however long a text is."""
    block, chars = [], 0
    for row, text in enumerate(texts):
        text = text.as_py()
        for piece in parts(row, text, overlap, most_chars):
            block.append(piece)
            chars += min(len(text or ""), most_chars)
            if chars >= most_chars or len(block) >= most_texts:
                yield block
                block, chars = [], 0
    if block:
        yield block


def word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and the number of words of each text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return _hashes.of(chain.from_iterable(texts), int(lens.sum())), lens


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are ASCII white space."""
    return (data == 32) | (data - np.uint8(9) < 5)


def _hashed(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hash of each word of UTF-8 bytes (eight more follow the last), eight bytes at a time; of long words, by xxhash."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).astype(np.uint64)
    out = mix(lens.astype(np.uint64))
    at, left, some = starts, np.where(lens <= LONG_WORD, lens, 0), slice(None)
    for k in np.flatnonzero(lens > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + lens[k]].tobytes())
    while True:
        live = np.flatnonzero(left > 0)
        if not len(live):
            return out
        at, left, some = at[live], left[live], live if isinstance(some, slice) else some[live]
        out[some] = mix(out[some] ^ mix((eight.take(at) & _low_bytes.take(np.minimum(left, 8))) + _odd))
        at, left = at + 8, left - 8


def text_hashes(texts: list[str | None], digests: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and the number of words of each; worked out on CHUNK bytes at a time.

    A list given as `digests` gets the 128-bit digest of each text's words.
    """
    coded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    begin = np.cumsum([1] + [len(c) + 1 for c in coded])
    data = np.frombuffer(b"\n" + b"\n".join(coded) + b"\n" * 9, np.uint8)
    del coded
    flat, places, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    open_, some = [hashlib.blake2b(digest_size=16) for _ in texts] if digests is not None else [], np.zeros(len(texts), bool)
    at, end = 0, len(data) - 8  # at a white space that ends what is done
    while at < end - 1:
        stop = min(at + CHUNK, end)
        white = spaces(data[at:stop])
        if stop < end:
            last = CHUNK - 1 - int(white[::-1].argmax())
            while not last:  # a word that is longer
                more = spaces(data[stop : stop + CHUNK])
                if more.any():
                    last, white = stop + int(more.argmax()) - at, np.zeros(0, bool)
                stop = min(stop + CHUNK, end)
            stop = at + last + 1
            white = white[: last + 1] if len(white) else spaces(data[at:stop])
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        starts, lens = edge[::2], edge[1::2] - edge[::2]
        if len(starts) == 1 and lens[0] > LONG_WORD:
            flat.append(np.array([xxhash.xxh3_64_intdigest(data[at + starts[0] : at + edge[1]].tobytes())], np.uint64))
        else:
            flat.append(_hashed(data[at : stop + 8], starts, lens))
        places.append(starts + at)
        if digests is not None and len(starts):
            keep = ~white
            keep[starts - 1] = True  # one space before each word
            joined = np.where(white, np.uint8(32), data[at:stop])[keep].tobytes()
            ends = np.concatenate([[0], np.cumsum(lens + 1)])
            row, upto = (int(x) for x in np.searchsorted(begin, (places[-1][0], places[-1][-1]), "right") - 1)
            cuts = ends[np.searchsorted(places[-1], begin[row : upto + 2])].tolist()
            for k, (a, b) in enumerate(zip(cuts, cuts[1:]), row):
                if a < b:
                    open_[k].update(joined[a + (not some[k]) : b])
                    some[k] = True
        at = stop - 1
    if digests is not None:
        digests += [d.digest() for d in open_]
    return np.concatenate(flat), np.diff(np.searchsorted(np.concatenate(places), begin))


def rolling(v: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of `width` values: by doubling, so in a logarithm of the width passes."""
    n = len(v) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(base, k, 2**64))
    out, done, part, size = None, 0, v, 1
    while True:
        if width & size:
            out = part[done : done + n] if out is None else out * power(size) + part[done : done + n]
            done += size
        if done == width:
            return mix(out)
        part = part[: len(part) - size] * power(size) + part[size:]
        size *= 2
