"""Hashes of words from bytes, and samples by tables."""

import hashlib
import re

import numpy as np
import pytest

from shapelake.llm import near_dedup, wordhash

RNG = np.random.default_rng(3)
SPACES = " \t\n\x0b\x0c\r"
LETTERS = "abcdeé  \x1c漢😀"


def made(words: int, longest: int) -> str:
    word = lambda: "".join(RNG.choice(list(LETTERS), RNG.integers(1, longest)))
    gap = lambda: "".join(RNG.choice(list(SPACES), RNG.integers(1, 4)))
    return "".join(RNG.choice(["", gap()]) + word() + gap() for _ in range(words))


@pytest.mark.parametrize("chunk", [9, 40, 333, 1 << 18])
def test_hashes_and_digests_of_bytes(monkeypatch, chunk):
    texts = [None, "", " ", "a", "\n a", "b \x0b", "abcdefgh", "abcdefghi", "abcdefgh i", "x" * 64, "x" * 65, "x" * 700 + " y", "y " + "é" * 500, *(made(int(RNG.integers(1, 60)), int(k)) for k in RNG.choice([3, 12, 90], 40)), None, " \t"]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    monkeypatch.setattr(wordhash, "CHUNK", chunk)
    digests: list[bytes] = []
    hashes, lens = wordhash.text_hashes(texts, digests)
    assert lens.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    of = dict(zip(flat, hashes.tolist()))
    assert [of[w] for w in flat] == hashes.tolist() and len(set(of.values())) == len(of)
    assert digests == [hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest() for w in words]
    monkeypatch.undo()
    assert wordhash.text_hashes(texts)[0].tolist() == hashes.tolist()


def test_no_texts():
    digests: list[bytes] = []
    assert [len(x) for x in wordhash.text_hashes([], digests)] == [0, 0] and not digests


def test_shingles_look_up_no_single_words(monkeypatch):
    def of(*_):
        raise AssertionError("words were looked up one by one")

    monkeypatch.setattr(wordhash.WordHashes, "of", of)
    assert len(near_dedup.shingles(["a b c d e f g", None, "x y"], [])[1]) == 4


def test_samples_are_those_of_the_formula():
    lens = RNG.integers(1, 80, 50)
    text, n = np.repeat(np.arange(50), lens), int(lens.sum())
    shingle, weight = RNG.integers(0, 2**50, n).astype(np.uint64), (1 + RNG.random(n)).astype(np.float32)
    s = near_dedup._sampler
    got = s.sample(text, shingle, weight, 50)
    log_w, low = np.log(weight).astype(np.float32), np.uint64(0xFFFF)
    for k, odd in enumerate(s.odd):
        z = shingle * odd
        z = ((z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(16)
        r, beta = s.r[z & low], s.beta[(z >> np.uint64(16)) & low]
        t = np.floor(log_w / r + beta)
        a = s.log_c[z >> np.uint64(32)] - r * (t - beta) - r
        at = np.array([f + a[f : f + m].argmin() for f, m in zip(np.cumsum(lens) - lens, lens)])
        want = wordhash.mix(shingle[at] ^ wordhash.mix(t[at].astype(np.int64).view(np.uint64) + np.uint64(k))) >> np.uint64(32)
        assert got[:, k].tolist() == want.tolist()
