"""Language ID: averaged embeddings of hashed subwords, a linear softmax, stochastic gradient descent in numpy.

Subwords are runs of 2 and 3 characters of the lower-cased text; everything but letters counts as one boundary sign.
They are hashed to BUCKETS rows of an embedding table. A text's vector is the mean over its subwords; a linear layer and
a softmax give the languages' probabilities. After training, embedding and linear layer are folded into one table, so
that a prediction is one gather and one mean over the whole text.

Training uses at most TRAIN_ROWS rows, spread evenly over the languages by a hash of doc_id, and of each a window of at
most TRAIN_CHARS characters at a hashed place. A fifth of them is kept for calibration: a temperature for the
probabilities, and the rejection threshold, which lies where it rejects at most REJECT_SHARE of the texts that were
classified rightly.

Nulls: a text that is null or has no letter is `und` with score 0 and is rejected. Rows with null lang or null doc_id
are never learned from. Where no language can be learned (an empty table, no labels), texts are `und` with score 0, and
only those without a letter are rejected. Very long texts are read whole, in parts of PART_CHARS characters. Ties go to the
first language by name. Repeated rows are each predicted. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.llm.common import table

BUCKETS = 1 << 15
DIMENSIONS = 16
TRAIN_ROWS = 4_000
TRAIN_CHARS = 2_000
EPOCHS = 4
REJECT_SHARE = 0.001
PART_CHARS = 500_000

_letter_codes: np.ndarray | None = None


def _codes() -> np.ndarray:
    """For each code point a hash if it is a letter, else 0."""
    global _letter_codes
    if _letter_codes is None:
        points = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _letter_codes = np.where(letter, (points * np.uint32(2654435761)) >> np.uint32(7) | np.uint32(1), 0).astype(np.uint32)
    return _letter_codes


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each subword (-1: no letter in it), where each text's subwords begin, whether the text has a letter."""
    texts = [t.lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
    c = _of_letters("".join("\n\n" + t for t in texts) + "\n\n")
    has = np.add.reduceat(c[:-2] != 0, starts) > 0 if len(texts) else np.zeros(0, bool)
    return _hashed(c), starts, has


def _of_letters(text: str) -> np.ndarray:
    return _codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _hashed(c: np.ndarray) -> np.ndarray:
    """The buckets of the two subwords that begin at each place but the last two."""
    a, b, d = c[:-2], c[1:-1], c[2:]
    two = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    three = (two ^ (two >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + d * np.uint32(0x27D4EB2F)
    out = np.empty((len(a), 2), np.int32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    out[:, 0] = np.where((a | b) != 0, (two * np.uint32(0x9E3779B1)) >> shift, -1)
    out[:, 1] = np.where((a | b | d) != 0, (three ^ np.uint32(0x165667B1)) * np.uint32(0x9E3779B1) >> shift, -1)
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # BUCKETS + 1 rows; the last, for -1, is zero and its count 0
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any(len(t) > PART_CHARS for t in texts):
            sums, has = map(np.array, zip(*map(self._sum_in_parts, texts), strict=True))
        else:
            grams, starts, has = subwords(texts)
            sums = np.add.reduceat(self.table[grams[:, 0]] + self.table[grams[:, 1]], starts, dtype=np.float64)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias, has

    def _sum_in_parts(self, text: str) -> tuple[np.ndarray, bool]:
        """The same sum, with memory for PART_CHARS characters at a time."""
        padded = f"\n\n{text.lower()}\n\n"
        total, has = np.zeros(self.table.shape[1]), False
        for at in range(0, len(padded) - 2, PART_CHARS):
            c = _of_letters(padded[at : at + PART_CHARS + 2])
            grams = _hashed(c)
            total += (self.table[grams[:, 0]] + self.table[grams[:, 1]]).sum(0, dtype=np.float64)
            has = has or bool((c != 0).any())
        return total, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability, rejected."""
        texts = ["" if t is None else t for t in texts]
        if not self.langs:
            _, _, has = subwords(texts)
            return ["und"] * len(texts), np.zeros(len(texts)), ~has
        z, has = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        score = np.where(has, p[np.arange(len(p)), best], 0.0)
        return [self.langs[k] if h else "und" for k, h in zip(best, has, strict=True)], score, ~has | (score < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> LanguageModel:
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(texts))
    kept, rest = order[: len(order) // 5], order[len(order) // 5 :]
    y = np.array([names.index(x) for x in langs])
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    out, bias = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    samples = []
    for i in rest:
        short = int(rng.integers(8, 160))
        at = int(rng.integers(0, max(1, len(texts[i]) - short)))
        for text in (texts[i], texts[i][at : at + short]):
            grams = subwords([text])[0].ravel()
            ids, counts = np.unique(grams[grams >= 0], return_counts=True)
            if ids.size:
                samples.append((ids, counts / counts.sum(), y[i]))
    steps, done = max(1, EPOCHS * len(samples)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            ids, share, label = samples[k]
            rate = 0.5 * (1 - done / steps)
            rows = emb[ids]
            mean = share @ rows
            error = softmax(mean @ out + bias)
            error[label] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            emb[ids] = rows - (rate * 20) * share[:, None] * back
            done += 1
    folded = np.zeros((BUCKETS + 1, len(names) + 1), np.float32)
    folded[:-1, :-1], folded[:-1, -1] = emb @ out, 1
    model = LanguageModel(names, folded, bias, 1.0, 0.0)
    if len(kept):
        z, has = model.logits([texts[i] for i in kept])
        z, truth = z[has], y[kept][has]
        if len(truth):
            loss = lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
            model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
            p = softmax(z / model.temperature)
            right = p.max(1)[p.argmax(1) == truth]
            if right.size:
                model.reject_below = float(min(np.quantile(right, REJECT_SHARE), 0.5))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> LanguageModel:
    """Learns from docs (doc_id, text, lang); rows that are held out, or lack an id or a lang, are left aside."""
    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [])
    each = TRAIN_ROWS / len(sizes)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS)).cast("int")
    taken = (
        rows.filter(draw < F.element_at(share, F.col("lang")) * (1 << 20))
        .select(F.substr("text", at + 1, F.lit(TRAIN_CHARS)).alias("text"), "lang", draw.alias("draw"), "doc_id")
        .orderBy("draw", "doc_id", "text")
        .limit(2 * TRAIN_ROWS)
        .toPandas()
    )
    return fit(taken["text"].tolist(), taken["lang"].tolist())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs -> its columns and lang_pred, lang_score, lang_rejected; only the text is used."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + 1) x (languages + 1) floats

    @F.pandas_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts, parts = texts.tolist(), []
            start = chars = 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars >= PART_CHARS or i + 1 == len(texts):
                    parts.append(shipped.value.predict(texts[start : i + 1]))
                    start, chars = i + 1, 0
            yield pd.DataFrame(
                {
                    "lang_pred": [x for p in parts for x in p[0]],
                    "lang_score": np.concatenate([p[1] for p in parts]) if parts else [],
                    "lang_rejected": np.concatenate([p[2] for p in parts]) if parts else [],
                }
            )

    names = ["lang_pred", "lang_score", "lang_rejected"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*kept, predict("text").alias("_lang")).select(*kept, *(F.col(f"_lang.{n}") for n in names))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), train(docs)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
