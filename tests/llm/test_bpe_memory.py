"""What the encoder's workers hold: they share an executor's memory with its JVM."""

import random
import re
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest

from textgate.llm import bpe
from textgate.llm.common import give_back

RANKS = {bytes([b]): 1000 + b for b in range(256)}


def texts_of(seed, n, letters):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdefghij", k=letters)) for _ in range(100)) for _ in range(n)]


def held_by(codec, texts):
    tracemalloc.start()
    for k in range(0, len(texts), 20):
        codec.encode(texts[k : k + 20])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    return held


def test_a_known_word_is_small():
    codec = bpe.ByteBpe(RANKS, r"\S+|\s+")
    assert held_by(codec, texts_of(1, 200, 8)) < 300 * len(codec.known)


def test_known_words_are_bounded_by_their_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 1 << 20, raising=False)
    codec = bpe.ByteBpe(RANKS, r"\S+|\s+")
    assert held_by(codec, texts_of(2, 60, 300)) < 8 << 20
    few = texts_of(3, 5, 300)
    assert [codec.decode(map(int, ids)) for ids in codec.encode(few)] == [t.encode() for t in few]


def test_arrow_memory_is_given_back():
    if pa.default_memory_pool().backend_name != "mimalloc":
        pytest.skip("of the pool that Spark's workers have here")

    def mb():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    give_back()
    before = mb()
    arrays = [pa.array(["x" * 2000] * 500) for _ in range(100)]
    most = mb()
    del arrays
    give_back()
    assert most > before + 80 and mb() < before + 20
