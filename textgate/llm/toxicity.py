"""Toxicity: a weighted finite-state grammar over clauses.

Transducers rewrite the words of a clause into signs from left to right; each arc has a weight, and the weights along a
path multiply. They are composed into one machine:

* insult: a word of the learned lexicon becomes an insult with its log odds as weight; words of the other fixed lists become
  signs for target, negation, report and quotation marks;
* threat: a verb of violence becomes a threat, of more weight up to three words behind a word of intent;
* negation: an insult or threat up to three words behind a negation becomes a negated one, of less weight;
* report: behind a reporting verb or inside quotation marks it becomes a reported one, of less weight;
* target: next to a person addressed or spoken of in the clause it becomes an aimed one, of more weight.

So a clause is scored by the signs and weights that leave the machine, not by isolated words. A text's features sum up its
clauses and a logistic layer turns them into the probability that `labels.toxic` is 1.

What is learned, from at most about TRAIN_ROWS labelled rows drawn by a hash of doc_id (near copies among them count
once): the insult lexicon (words and word beginnings that are significantly tied to label 1, with their log odds) and
the logistic layer. Both start from fixed seeds and a prior, which stand where labels are few or missing. Scoring then
goes over the whole text of every row; only clauses with an insult or threat are run through the machine.

Nulls: a null text is an empty one and gets the score of a text without any sign. Labels that are null or without id are
left aside; of contradicting labels of a doc_id the larger counts. Repeated rows are each scored. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.llm.common import stored, table
from textgate.llm.langid import held_out

TRAIN_ROWS = 12_000
THRESHOLD = 0.3
LEAST_COUNT = 5
LEAST_PRECISION = 0.7
MAX_KNOWN = 100_000
PREFIXES = range(4, 9)

# Seeds of the grammar: fixed word lists.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool imbecile bastard"
THREATS = "kill hurt destroy beat punch murder shoot stab strangle burn die"
INTENTS = "will gonna going shall should must i'll we'll they'll you'll werde werden wirst vais vas va allons voy vamos vais"
TARGETS = "you your yours yourself u he she him her his they them their these those people everyone du dich dir ihr euch sie tu toi te vous vos tú ti usted ustedes ellos ils elles"
NEGATIONS = "not no never neither nor hardly isn't aren't don't won't nicht kein keine nie ne pas jamais nunca ni sin"
REPORTS = "said says say called calls wrote writes claimed claims quoted quote reported reports told sagte schrieb nannte dit écrit appelé dijo escribió llamó"

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
SIGN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
CLAUSE_END = re.compile(r"[.!?;\n]+")


@dataclass
class Transducer:
    """arcs: (state, sign) -> (next state, sign out, weight). A sign without an arc passes unchanged with weight 1, and the
    state goes on by `passing` (default: it stays)."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, str, float]]
    passing: dict[str, str] = field(default_factory=dict)

    def step(self, state: str, sign: str) -> tuple[str, str, float]:
        return self.arcs.get((state, sign)) or (self.passing.get(state, state), sign, 1.0)


class Insult:
    """The transducer of one state whose arcs are the lexicon's words, and all words that begin as its beginnings do."""

    start = ""

    def __init__(self, insult: Callable[[str], float | None]) -> None:
        self.insult = insult

    def step(self, state: str, word: str) -> tuple[str, str, float]:
        weight = self.insult(word)
        return (state, FIXED.get(word, word), 1.0) if weight is None else (state, "insult", weight)


class Composed:
    """Transducers in a row: what leaves one enters the next, the weights multiply. Product states are made when first reached."""

    def __init__(self, *machines: Transducer | Insult) -> None:
        self.machines, self.known = machines, {}
        self.start = tuple(m.start for m in machines)

    def step(self, state: tuple[str, ...], sign: str) -> tuple[tuple[str, ...], str, float]:
        if (found := self.known.get((state, sign))) is None:
            out, after, weight = sign, [], 1.0
            for machine, s in zip(self.machines, state, strict=True):
                s, out, w = machine.step(s, out)
                after.append(s)
                weight *= w
            if len(self.known) >= MAX_KNOWN:
                self.known.clear()
            found = self.known[state, sign] = tuple(after), out, weight
        return found

    def run(self, signs: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for sign in signs:
            state, left, weight = self.step(state, sign)
            out.append((left, weight))
        return out


# Fixed weights of the grammar.
INTENDED, NEGATED, REPORTED, AIMED = 1.5, 0.25, 0.4, 1.5
KINDS = ("insult", "threat")
THREAT = Transducer(
    "calm",
    {(s, w): ("calm", "threat", 1.0 if s == "calm" else INTENDED) for s in ("calm", "3", "2", "1") for w in THREATS.split()}
    | {(s, w): ("3", w, 1.0) for s in ("calm", "3", "2", "1") for w in INTENTS.split()},
    {"3": "2", "2": "1", "1": "calm"},
)
NEGATION = Transducer(
    "free",
    {(s, "negation"): ("3", "negation", 1.0) for s in ("free", "3", "2", "1")}
    | {(s, kind): ("free", f"negated {kind}", NEGATED) for s in ("3", "2", "1") for kind in KINDS},
    {"3": "2", "2": "1", "1": "free"},
)
REPORT = Transducer(
    "own",
    {("own", "report"): ("told", "report", 1.0), ("own", "quote"): ("quoted", "quote", 1.0), ("told", "quote"): ("quoted", "quote", 1.0)}
    | {("quoted", "quote"): ("own", "quote", 1.0)}
    | {(s, kind): (s, f"reported {kind}", REPORTED) for s in ("told", "quoted") for kind in KINDS},
)
TARGET = Transducer(
    "nobody",
    {("nobody", "target"): ("somebody", "target", 1.0), ("insulted", "target"): ("somebody", "aimed insult", AIMED), ("threatened", "target"): ("somebody", "aimed threat", AIMED)}
    | {("nobody", "insult"): ("insulted", "insult", 1.0), ("nobody", "threat"): ("threatened", "threat", 1.0)}
    | {("somebody", kind): ("somebody", f"aimed {kind}", AIMED) for kind in KINDS},
)
GRAMMAR = (THREAT, NEGATION, REPORT, TARGET)
OUTPUTS = [f"{how}{kind}" for kind in ("insult", "threat") for how in ("", "aimed ", "negated ", "reported ")]
# Prior of the logistic layer: for each output, then distinct insults, then the strongest insult; the intercept is last.
PRIOR = np.array([1.0, 1.2, 0.3, 0.3, 0.2, 1.0, 0.0, 0.0, 0.5, 0.4, -4.0])
FIXED = (
    {w: "target" for w in TARGETS.split()}
    | {w: "negation" for w in NEGATIONS.split()}
    | {w: "report" for w in REPORTS.split()}
    | dict.fromkeys('"“”„«»', "quote")
)
VERBS = {*THREATS.split(), *INTENTS.split()}


@dataclass
class ToxicityModel:
    words: dict[str, float]
    prefixes: dict[str, float]
    weights: np.ndarray
    _machine: Composed | None = None
    _finder: object = None

    def __getstate__(self) -> tuple:
        return self.words, self.prefixes, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.words, self.prefixes, self.weights = state
        self._machine = self._finder = None

    def insult(self, word: str) -> float | None:
        found = self.words.get(word)
        for n in PREFIXES:
            if n > len(word):
                break
            if (x := self.prefixes.get(word[:n])) is not None:
                found = x if found is None else max(found, x)
        return found

    def _known(self, token: str) -> bool:
        return token in FIXED or token in VERBS or self.insult(token) is not None

    def features(self, text: str) -> np.ndarray:
        import ahocorasick

        if self._finder is None:
            self._machine, self._finder = Composed(Insult(self.insult), *GRAMMAR), ahocorasick.Automaton()
            for w in {*self.words, *self.prefixes, *THREATS.split()}:
                self._finder.add_word(w, len(w))
            self._finder.make_automaton()
        out = np.zeros(len(PRIOR))
        out[-1] = 1
        low = text.lower()
        hits = [s for end, n in self._finder.iter(low) if not ((s := end - n + 1) and low[s - 1].isalpha())]
        if not hits:
            return out
        ends = [m.end() for m in CLAUSE_END.finditer(low)]
        bounds = [0, *ends, len(low)]
        terms: dict[str, float] = {}
        for k in sorted({bisect_right(ends, s) for s in hits}):
            tokens = SIGN.findall(low[bounds[k] : bounds[k + 1]])
            last = 1.0
            for token, (sign, weight) in zip(tokens, self._machine.run([t if self._known(t) else "other" for t in tokens]), strict=True):
                if (w := self.insult(token)) is not None:
                    terms[token] = last = w
                if sign in _AT:
                    # A target that follows an insult stands for it, with the insult's weight.
                    out[_AT[sign]] += weight * last if sign == "aimed insult" and w is None else weight
        n = len(OUTPUTS)
        out[:n] = np.log1p(out[:n])
        out[n], out[n + 1] = math.log1p(len(terms)), max(terms.values(), default=0.0)
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text or "") @ self.weights, -30, 30))))


_AT = {name: k for k, name in enumerate(OUTPUTS)}


def features_of(text: str) -> tuple[set[str], set[str]]:
    """Words and word beginnings of a text."""
    words = {w for w in WORD.findall(text.lower()) if 3 <= len(w) <= 40}
    return words, {w[:n] for w in words for n in PREFIXES if n < len(w)}


def copy_key(text: str) -> str:
    """Near copies share it mostly: the three smallest hashes of its words."""
    return ",".join(map(str, sorted({crc32(w.encode()) for w in WORD.findall(text.lower())})[:3]))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most about TRAIN_ROWS labelled rows that are not held out; near copies once."""
    usable = (
        labels.select("doc_id", "toxic")
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    n = usable.count()
    # A hash keeps about TRAIN_ROWS ids, so the broadcast is bounded.
    few = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, TRAIN_ROWS / max(n, 1)))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            yield pd.DataFrame({"key": [copy_key(t) for t in texts], "toxic": b["toxic"], "text": texts})

    once = rows.mapInPandas(keyed, "key string, toxic int, text string").groupBy("key", "toxic").agg(F.min("text").alias("text"))
    return stored(once.select("toxic", "text"), "toxicity-sample")


def _counted(sample: DataFrame, toxic: int, among: set[str] | None) -> DataFrame:
    shipped = sample.sparkSession.sparkContext.broadcast(among)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: Counter[str] = Counter()
            for text in b["text"]:
                words, beginnings = features_of(text)
                found = [f"w{w}" for w in words] + [f"p{p}" for p in beginnings]
                total.update(found if shipped.value is None else shipped.value.intersection(found))
            if total:
                yield pd.DataFrame({"feature": list(total.keys()), "n": list(total.values())})

    counts = sample.filter(F.col("toxic") == toxic).mapInPandas(count, "feature string, n long")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings tied to label 1, with log odds; seeds that the labels speak against are left out."""
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = total.get(1, 0), total.get(0, 0)
    seeds = INSULTS.split()
    if not n_toxic or not n_clean:
        return dict.fromkeys(seeds, 1.0), {}
    # In a bounded sample at most (its words / LEAST_COUNT) features are common enough.
    toxic = {
        r["feature"]: r["n"]
        for r in _counted(sample, 1, None)
        .filter((F.col("n") >= LEAST_COUNT) | F.col("feature").isin([f"w{w}" for w in seeds]))
        .collect()
    }
    clean = {r["feature"]: r["n"] for r in _counted(sample, 0, set(toxic) | {f"w{w}" for w in seeds}).collect()}
    base = n_toxic / (n_toxic + n_clean)
    needed = math.log(100 * max(1, len(toxic)))

    def precise(f: str) -> bool:
        p = toxic.get(f, 0) / (toxic.get(f, 0) + clean.get(f, 0))
        gain = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
        return p >= max(LEAST_PRECISION, 1.5 * base) and (toxic[f] + clean.get(f, 0)) * gain >= needed

    kept = {f for f in toxic if precise(f)}
    beginnings = {f[1:] for f in kept if f[0] == "p"}
    words = {f[1:] for f in kept if f[0] == "w"}
    best_word: Counter[str] = Counter()
    for f, n in toxic.items():
        if f[0] == "w":
            for k in PREFIXES:
                best_word[f[1 : k + 1]] = max(best_word[f[1 : k + 1]], n)
    # A beginning that stands for one word alone is left to that word; of nested ones with the same texts the longest stays.
    beginnings = {p for p in beginnings if best_word[p] < 0.67 * toxic["p" + p]}
    same = {q[:k] for q in beginnings for k in PREFIXES if k < len(q) and toxic["p" + q] >= 0.97 * toxic.get("p" + q[:k], 1e9)}
    beginnings -= same
    inside = lambda w: any(w[:k] in beginnings for k in PREFIXES if k < len(w))
    beginnings = {p for p in beginnings if not inside(p)}
    words = {w for w in words if not inside(w)}
    odds = lambda f: min(6.0, math.log((toxic.get(f, 0) + 0.5) / (clean.get(f, 0) + 0.5) * (1 - base) / base))
    lexicon = {w: odds("w" + w) for w in words}
    for w in seeds:
        if w not in lexicon and odds("w" + w) > 0:
            lexicon[w] = min(1.0, odds("w" + w)) if "w" + w in toxic or "w" + w in clean else 1.0
    return lexicon, {p: odds("p" + p) for p in beginnings}


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards PRIOR."""
    w, pull = PRIOR.copy(), np.full(len(PRIOR), 1.0)
    pull[-1] = 0.01
    for _ in range(25 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    sample = labelled_sample(docs, labels)
    words, prefixes = learn_lexicon(sample)
    model = ToxicityModel(words, prefixes, PRIOR)
    shipped = sample.sparkSession.sparkContext.broadcast(model)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "x": [shipped.value.features(t).tolist() for t in b["text"]]})

    rows = sample.mapInPandas(featured, "toxic int, x array<double>").toPandas()  # at most about 2 * TRAIN_ROWS short rows
    x = np.array(rows["x"].tolist()).reshape(-1, len(PRIOR))
    return ToxicityModel(words, prefixes, fit_weights(x, rows["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs -> its columns and toxicity, the probability of label 1; only the text is used."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon learned from a bounded sample, a few KB

    @F.pandas_udf("double")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shipped.value.score(t) for t in texts], dtype=float)

    kept = [F.col(f"`{c}`") for c in docs.columns if c != "toxicity"]
    return docs.select(*kept, of_texts("text").alias("toxicity"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
