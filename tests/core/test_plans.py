"""Each validator stands once in a plan, however much is built on its issues."""

import pytest

from textgate.operators import validators
from textgate.operators.score import score
from textgate.plans import queries as Q
from textgate.spec import default_spec, with_changes

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["issues_flat", "score_all", "score_with_rules", "corrections_fanout", "corrections_window_counts"])
def test_validators_are_not_repeated(spark, name):
    plan = optimized(Q.queries()[name](spark, SF))
    assert plan.count("regexp_extract_all") <= 6
    assert plan.count("regexp_replace(") <= 30
    assert len(plan) < 60_000


def test_badverbs_extracts_once(spark):
    plan = optimized(Q.queries()["badverbs"](spark, SF))
    assert plan.count("regexp_extract_all") <= 2


def phrases_found(spark, text, phrases):
    spec = with_changes(default_spec(), {"filters.floate.phrases": phrases, "filters.floate.words": []})
    rows = spark.createDataFrame([("", text)], "prompt string, response string")
    return [i.detail.removeprefix("phrase:") for i in score(rows, spec, only=[validators.floate_phrases]).first()["issues"]]


def earliest_end(text, phrases):
    """Plain version: the match that ends first counts, of several the longest; the next one begins behind it."""
    low, at, found = text.lower(), 0, []
    while True:
        ends = [(low.find(p.lower(), at) + len(p), -len(p), p) for p in phrases if low.find(p.lower(), at) >= 0]
        if not ends:
            return list(dict.fromkeys(found))[:5]
        end, _, phrase = min(ends)
        found.append(phrase)
        at = end


@pytest.mark.parametrize(
    ("text", "phrases"),
    [
        ("say abcdef now", ["abcdef", "cd"]),
        ("xx abcd cd", ["abcd", "cd"]),
        ("abc abcd", ["abc", "abcd"]),
        ("let's dive in and Dive In", ["let's dive", "dive in"]),
        ("abcdx bcd", ["abc", "cdx", "bcd"]),
        ("a.b a?b (x) $y", ["a.b", "a?b", "(x)", "$y"]),
    ],
)
def test_phrases_that_overlap_or_hold_each_other(spark, text, phrases):
    assert phrases_found(spark, text, phrases) == earliest_end(text, phrases)
