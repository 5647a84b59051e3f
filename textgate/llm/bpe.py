"""Byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices.

Words (matches of the vocabulary's pattern) that a worker has not met yet are gathered, dealt into buckets by length and
put into matrices of ids, a row each. In every round each row merges its leftmost pair of minimum rank: pair ranks come
from a hashed table, and the matrix is compacted, so that it loses one column a round; finished rows leave it. A word of
over LONG bytes would need as many rounds, so it is merged with a heap instead, by the same rule.

A worker keeps the ids of the words it has met in a dictionary, packed as bytes, and empties it when it takes about
KNOWN_BYTES. Texts stay in their Arrow batch; PART_BYTES of them at a time become Python strings. The ranks are read on the
driver and shipped, so executors need no vocabulary file.

Nulls: a null text is an empty one; an empty text has no ids. Repeated rows and an empty table need no care; only
doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.llm.common import give_back, table

LONG = 512
KNOWN_BYTES = 64 << 20
ENTRY_BYTES = 160  # of an entry, besides its characters and ids
PART_BYTES = 1_000_000
MATRIX_BYTES = 1 << 21
NONE = np.int64(1) << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """The lines of a rank file: base64 bytes, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _latin1(pattern: str) -> str:
    """The same pattern for texts of code points under 256 alone: classes are written out, so that re can match it."""
    every = "".join(map(chr, range(256)))
    of = lambda kind: "".join(f"\\x{ord(c):02x}" for c in regex.findall(kind, every))
    letters, numbers, spaces = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for name, chars in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", spaces)):
        out = out.replace(name, f"[{chars}]")
    return out.replace(r"\S", f"[^{spaces}]")


class PairTable:
    """Open addressing in numpy: (left id, right id) -> id of the two together, which is also the pair's rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [
            ((ranks[left] << 32) | ranks[right], rank)
            for word, rank in ranks.items()
            for k in range(1, len(word))
            if (left := word[:k]) in ranks and (right := word[k:]) in ranks
        ]
        keys = np.array([k for k, _ in pairs], np.uint64)
        values = np.array([v for _, v in pairs], np.int64)
        self.shift = np.uint64(64 - max(4, int(4 * len(pairs)).bit_length()))
        self.mask = np.int64((1 << (64 - int(self.shift))) - 1)
        self.keys = np.full(int(self.mask) + 1, ~np.uint64(0))
        self.values = np.full(int(self.mask) + 1, NONE)
        left = np.arange(len(keys))
        slot = self._home(keys)
        while left.size:
            free = self.keys[slot[left]] == ~np.uint64(0)
            taken, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[taken], self.values[taken] = keys[won], values[won]
            left = left[~np.isin(left, won)]
            slot[left] = (slot[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is none; a negative id is padding."""
        out = np.full(left.shape, NONE)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = (left.ravel()[at].astype(np.uint64) << np.uint64(32)) | right.ravel()[at].astype(np.uint64)
        slot, flat = self._home(keys), out.ravel()
        while at.size:
            there = self.keys[slot]
            hit = there == keys
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (there != ~np.uint64(0))
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & self.mask
        return flat.reshape(left.shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split, self.split_latin1 = regex.compile(pattern), re.compile(_latin1(pattern))
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimals = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split.findall(text)
        return self.split_latin1.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, int32."""
        if self.known_bytes > KNOWN_BYTES:
            self.known, self.known_bytes = {}, 0
        split = [self.words(t) for t in texts]
        new = list(set(chain.from_iterable(split)) - self.known.keys())
        ids = self.encode_words([w.encode("utf-8") for w in new])
        self.known |= zip(new, ids, strict=True)
        self.known_bytes += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, ids))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of an int32 array."""
        out = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.ranks:
                out[i] = np.int32(self.ranks[w]).tobytes()
            elif len(w) > LONG:
                out[i] = self._with_heap(w)
            else:
                buckets.setdefault((len(w) + 1) // 2 if len(w) <= 16 else 8 + len(w).bit_length(), []).append(i)
        for members in buckets.values():
            rows = max(1, MATRIX_BYTES // (8 * max(len(words[i]) for i in members)))
            for k in range(0, len(members), rows):
                some = members[k : k + rows]
                for i, ids in zip(some, self._merged([words[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _merged(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.of_byte[flat], -1)
        costs = self.pairs(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(words)), [b""] * len(words)
        while rows.size:
            best = costs.argmin(1) if costs.shape[1] else np.zeros(len(rows), np.int64)
            merged = costs[np.arange(len(rows)), best] if costs.shape[1] else np.full(len(rows), NONE)
            done = merged == NONE
            if done.any():
                lines, step = ids[done].astype(np.int32).tobytes(), 4 * ids.shape[1]
                for k, (r, n) in enumerate(zip(rows[done].tolist(), lengths[done].tolist(), strict=True)):
                    out[r] = lines[k * step : k * step + 4 * n]
                on = ~done
                rows, ids, costs, lengths, best, merged = (x[on] for x in (rows, ids, costs, lengths, best, merged))
                if not rows.size:
                    break
            n, width = ids.shape
            at = np.arange(n)
            ids[at, best] = merged
            keep = np.arange(width) != (best + 1)[:, None]
            ids = ids[keep].reshape(n, width - 1)
            keep = np.arange(width - 1) != best[:, None]
            costs = costs[keep].reshape(n, width - 2)
            lengths = lengths - 1
            before = best > 0
            costs[at[before], best[before] - 1] = self.pairs(ids[at[before], best[before] - 1], merged[before])
            after = best < width - 2
            costs[at[after], best[after]] = self.pairs(merged[after], ids[at[after], best[after] + 1])
        return out

    def _with_heap(self, word: bytes) -> bytes:
        parts: list[bytes | None] = [bytes([b]) for b in word]
        follows, precedes = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and follows[i] < len(parts):
                both = parts[i] + parts[follows[i]]
                if (rank := self.ranks.get(both)) is not None:
                    heapq.heappush(heap, (rank, i, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or follows[i] == len(parts) or parts[i] + parts[follows[i]] != both:
                continue
            gone = follows[i]
            parts[i], parts[gone] = both, None
            follows[i] = follows[gone]
            if follows[i] < len(parts):
                precedes[follows[i]] = i
            offer(precedes[i])
            offer(i)
        return np.array([self.ranks[p] for p in parts if p is not None], np.int32).tobytes()


def _each(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, make: Callable[[ByteBpe, list[str]], dict[str, pa.Array]], schema: str
) -> DataFrame:
    """Encodes in parts of bounded text; make(codec, texts) gives the other columns, as in schema."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: a few MB, whatever the input
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or ByteBpe(shipped.value, pattern)
            for part in _parts(batch.column(1)):
                texts = ["" if t is None else t for t in batch.column(1)[part].to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[part], **make(codec, texts)})
            del batch
            give_back()
        codec = None
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {schema}")


def _parts(texts: pa.Array) -> Iterator[slice]:
    start = total = 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        total += n
        if total >= PART_BYTES or i + 1 == len(sizes):
            yield slice(start, i + 1)
            start, total = i + 1, 0


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids array<int>."""
    return _each(docs, ranks, pattern, lambda codec, texts: {"ids": _lists(codec.encode(texts))}, "ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, bytes binary. Null ids decode to no bytes."""
    shipped = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = shipped.value.__getitem__
            out = [b"".join(map(of, ids.values.to_pylist())) if ids.is_valid else b"" for ids in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "bytes": pa.array(out, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, bytes binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes each text, decodes its ids, keeps digests of both."""

    def digests(codec: ByteBpe, texts: list[str]) -> dict[str, pa.Array]:
        encoded, of_ids, of_bytes = codec.encode(texts), [], []
        for ids in encoded:
            line = ids.tolist()
            of_ids.append(hashlib.sha256(" ".join(map(codec.decimals.__getitem__, line)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(codec.decode(line)).hexdigest())
        return {
            "n_tokens": pa.array([len(ids) for ids in encoded], pa.int64()),
            "ids_sha256": pa.array(of_ids, pa.string()),
            "decoded_sha256": pa.array(of_bytes, pa.string()),
        } | ({"ids": _lists(encoded)} if with_ids else {})

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _each(docs, ranks, pattern, digests, schema)


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())
