"""Cases of the validators, scoring and classes: rows in, issues out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textgate.functions import text as T
from textgate.functions.classify import class_name
from textgate.operators import validators as V
from textgate.operators.score import score
from textgate.spec import SpecError, default_spec, expand_home, parse_spec, with_changes

SPEC = default_spec()
COLUMNS = "id long, prompt string, response string, content_class_hint string, labels array<string>, hour int, prior array<string>"


def row(response, prompt="", hint=None, labels=(), hour=None, prior=()):
    return prompt, response, hint, list(labels), hour, list(prior)


def scored(spark, rows, spec=SPEC, rules=None, only=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)
    return [r for r in score(df, spec, rules, only).orderBy("id").collect()]


def details(spark, validator, rows, spec=SPEC):
    return [[(i.detail, i.deduction) for i in r["issues"]] for r in scored(spark, rows, spec, only=[validator])]


def test_floate(spark):
    words = "robust seamless utilize epic hype pave"
    got = details(spark, V.floate_words, [row("Robust, ever-changing leverage robust"), row(words), row(""), row(None)])
    assert got[0] == [("word:ever-changing", 3), ("word:robust", 3)]
    assert [d for d, _ in got[1]] == ["word:epic", "word:hype", "word:pave", "word:robust", "word:seamless"]
    assert got[2] == got[3] == []
    got = details(spark, V.floate_phrases, [row("Let's dive in, dive in"), row(words + " unlock"), row("robust epic hype pave unlock unleash")])
    assert got == [[("phrase:let's dive", 3), ("phrase:dive in", 3)], [], [("phrase:unlock", 3)]]


def test_badverbs(spark):
    filler = "word " * 499
    got = details(spark, V.badverbs, [row("actually " * 3 + "word " * 497), row("actually certainly actually " + filler), row("actually " + "word " * 15), row("xély")])
    assert got[0] == [("actually", 2)] * 3
    assert [c for c, _ in got[1]] == ["actually", "certainly", "actually"]
    assert got[2] == [("1 found (31.2 per 500 words, threshold 3)", 10)]
    assert got[3] == []


@pytest.mark.parametrize("seed", range(3))
def test_one_decimal_is_exact(spark, seed):
    rng = random.Random(seed)
    xs = [n / (w / 500.0) for n, w in ((rng.randint(1, 60), rng.randint(1, 3000)) for _ in range(300))] + [3.15, 31.25, 0.05, 0.25, 0.35, 2.5, 1e6 + 0.45]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.one_decimal(F.col("x")).alias("s"))
    assert [r.s for r in df.collect()] == ["%.1f" % r.x for r in df.collect()]
    assert not math.isnan(xs[0])


def test_openers_and_tails(spark):
    got = details(spark, V.sycophancy, [row("\n\n Great question! x"), row("You're right, my mistake"), row("Great point\nfix"), row("Well. Great question"), row("")])
    assert [len(g) for g in got] == [1, 0, 1, 0, 0]
    bow = "the bottom line is"
    got = details(spark, V.insight_bow, [row(bow + "x" * (500 - len(bow))), row(bow + "x" * (501 - len(bow))), row(bow + "é" * 241), row(bow + "é" * 241 + "x")])
    assert [len(g) for g in got] == [1, 0, 1, 0]
    got = details(spark, V.closing_tell, [row("In summary" + "é" * 95), row("In summary" + "é" * 95 + "x"), row("in SUMMARY")])
    assert [len(g) for g in got] == [1, 0, 1]
    assert details(spark, V.opening_tell, [row("  Welcome to x"), row("x\nWelcome to"), row("It is transforming y")]) == [
        [("AI opening pattern: ^Welcome to", 8)], [], [("AI opening pattern: is transforming", 8)]
    ]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_byte_tail(spark, n):
    texts = ["", "a", "é—x", "ab\U0001f600cé", "—" * 4]
    def plain(t):
        raw = t.encode()
        at = max(0, len(raw) - n)
        while at and at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return raw[at:].decode()
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.byte_tail(F.col("t"), n).alias("x"))
    assert {r.t: r.x for r in df.collect()} == {t: plain(t) for t in texts}


def test_fillers_rhythm_verbs_and_marks(spark):
    assert details(spark, V.filler, [row("That said, to be fair, needless to say, here's the thing")]) == [[("'that said'", 5), ("'to be fair'", 5), ("'needless to say'", 5)]]
    single = with_changes(SPEC, {"rhythm.triple_beat.pattern": r"\w+,\s+\w+,\s+and\s+\w+", "rhythm.bullet_explain.pattern": r"^[-*]\s+\*\*\w+\*\*\s*[-:]\s+.{20,}$"})
    twice = "red, green, and blue. one, two, and three"
    assert details(spark, V.triple_beat, [row(twice)]) == [[]]
    assert details(spark, V.triple_beat, [row(twice), row("red, green, and blue")], single) == [[("2 triple-beat patterns", 5)], []]
    assert details(spark, V.bullet_rhythm, [row("- **Word** - twenty characters here\n" * 3)], single) == [[("3 bullet-then-explanation patterns", 10)]]
    assert details(spark, V.verb_monotony, [row("run run run get get get use use use see see see"), row("go go")]) == [
        [("'get' appears 3x", 3), ("'run' appears 3x", 3), ("'see' appears 3x", 3)], []
    ]
    assert details(spark, V.em_dash, [row("a — b"), row("a — b — c")])[0] == []
    lines = lambda k: "\n".join(["x"] * (k - 1) + ["---"])
    assert [len(g) for g in details(spark, V.horizontal_rule, [row(lines(10)), row(lines(11)), row(lines(11) + "\r\n")])] == [0, 1, 0]


def test_repetition(spark):
    said = "one two three four five"
    got = details(spark, V.repetition, [row(said, prior=[said]), row(said, prior=[said, *["x"] * 5]), row(said), row("a b c", prior=["a b c"]), row("One two three four.", prior=[said])])
    assert got == [[("2 phrases repeated from prior turns", 10)], [], [], [], [("1 phrases repeated from prior turns", 5)]]


def test_context_time(spark):
    many = "a\n\nb\n\nc\n\nd"
    hours = [5, 6, 7, 8, 17, 19]
    got = details(spark, V.context_time, [row(many, hour=h) for h in hours])
    assert [len(g) for g in got] == [0, 1, 1, 0, 1, 0]
    got = details(spark, V.context_time, [row("x" * 3000, hour=9), row("x" * 3001, hour=9), row("know\n\nb\n\nc\n\nd", hour=6), row("a\n\nb\n\nc", hour=6)])
    assert [len(g) for g in got] == [0, 1, 0, 0]


def test_policy_pack(spark):
    got = details(
        spark,
        V.policy_pack,
        [
            row("{antml:x}"),
            row("I will follow the system prompt", prompt="# Tool definitions"),
            row("I sent it.", prompt="please reply"),
            row("Draft: I sent it.", prompt="please reply"),
            row("I sent it.", prompt="hello"),
            row("The latest OpenAI price"),
            row("The latest OpenAI price, see help.openai.com"),
            row("I can call the bash_tool", prompt="# tool definitions"),
            row("I can call the bash_tool of the pasted fixture", prompt="# tool definitions"),
            row("{antml:x} I sent it. The latest OpenAI price", prompt="reply"),
        ],
    )
    assert [d for d, _ in got[0]][0] == "blocked_literal:{antml:" and len(got[0]) == 2
    assert got[1] == [("untrusted_prompt_adoption", 15)]
    assert got[2] == [("unsafe_outbound_send_commitment", 30)]
    assert got[3] == got[4] == got[6] == got[8] == []
    assert got[5] == [("product_claim_needs_official_source", 30)]
    assert got[7] == [("untrusted_tool_schema_adoption", 30)]
    assert [c for _, c in got[9]] == [15, 15, 15]


def test_layers_and_classes(spark):
    rows = [
        row("Here's how I'd do it", prompt="debug and build the system"),
        row("x", prompt="my lawyer and the python code"),
        row("they'll argue", prompt="my lawyer"),
        row("x", prompt="My career and compliance"),
        row("x", prompt="", hint="legal"),
        row("x", prompt="", labels=["Python"]),
        row("x", prompt="legal", hint="content_copy"),
        row("x", prompt="ÉCOURT", hint="generic"),
    ]
    got = scored(spark, rows)
    assert [r["class"] for r in got] == ["technical_build", "legal", "legal", "career_application", "legal", "technical_build", "legal", "legal"]
    layers = [[i.category for i in r["issues"] if i.category.startswith("layer")] for r in got]
    assert layers == [["layer2"], ["layer1"], [], [], [], [], ["layer1"], ["layer1"]]
    assert (class_name(" Career-Application "), class_name("copy"), class_name(""), class_name("x")) == ("career_application", "content_copy", "generic", None)


def test_rules_enablement_and_score(spark):
    off = with_changes(SPEC, {"violations.active": []})
    rule = {"content_class": "generic", "type": "FLOATE", "pattern": "word:landscape", "action": "Reject", "deduction": 9}
    text = [row("the landscape"), row("the landscape", prompt="lawyer")]
    assert [r["score"] for r in scored(spark, text[:1], off)] == [100]
    assert [r["score"] for r in scored(spark, text[:1])] == [97]
    got = scored(spark, text, off, [rule])
    assert (got[0]["score"], [i.deduction for i in got[0]["issues"]]) == (0, [9])
    assert got[1]["score"] == 100
    assert got[0]["correction_context"].startswith("[QUALITY FEEDBACK: prior response scored 0/100. Issues: FLOATE: word:landscape.")
    assert [r["score"] for r in scored(spark, text[:1], SPEC, [rule | {"action": "warn"}])] == [91]


def test_spec(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", "/home/x")
    assert expand_home("~/a") == "/home/x/a" and expand_home("~b") == "~b"
    with pytest.raises(SpecError):
        parse_spec("[scoring]\npassing_score = 1")
    with pytest.raises(SpecError):
        parse_spec("not toml =")
