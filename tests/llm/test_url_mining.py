from itertools import combinations

import pytest

from textgate.llm import url_filter


def brute(rows):
    """All association rules over the transactions by counting each subset of tokens, pruned alike."""
    n = len(rows)
    least = max(url_filter.MIN_SUPPORT, url_filter.MIN_ROWS / n)
    held = {}
    for i, (tokens, _) in enumerate(rows):
        for t in set(tokens):
            held.setdefault(t, set()).add(i)
    # Tokens on equal transactions are told apart by the transactions' texts, so rows of equal tokens are one kind.
    names = {}
    for t in sorted(held):
        names.setdefault(tuple(sorted(held[t])), t)
    items = sorted(t for t in names.values() if len(held[t]) >= least * n)
    found = []
    for size in range(1, url_filter.MAX_TOKENS + 1):
        for subset in combinations(items, size):
            both = set.intersection(*(held[t] for t in subset))
            for verdict in url_filter.VERDICTS:
                hits = sum(rows[i][1] == verdict for i in both)
                total = sum(v == verdict for _, v in rows)
                if hits and hits >= least * n and hits / len(both) >= url_filter.MIN_CONFIDENCE and hits / len(both) * n / total > 1:
                    found.append((subset, verdict, hits / len(both)))
    kept = []
    for r in sorted(found, key=lambda r: (len(r[0]), r[0])):
        if not any(k[1] == r[1] and k[2] >= r[2] and set(k[0]) < set(r[0]) for k in kept):
            kept.append(r)
    return {(t, v): pytest.approx(c) for t, v, c in kept}


def transactions():
    rows = []
    for i in range(400):
        tokens = [f"host:{'ab'[i % 2]}", "scheme:http", f"path:{i % 5}", *(["site:a", "type:x"] if i % 2 == 0 else [])] + [f"query:{i}"]
        rows.append((tokens, "block" if i % 2 and i % 5 < 3 or i % 50 == 0 else "allow"))
    return rows


def test_mined_rules_equal_counted_ones(spark):
    rows = transactions()
    got = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert {(r.tokens, r.verdict): r.confidence for r in got} == brute(rows)
    assert got


def test_few_rows_make_no_rule(spark):
    rows = [(["host:a"], "block")] * (url_filter.MIN_ROWS - 1)
    assert url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")) == []


def test_tokens_that_always_occur_together_are_one_item(spark):
    many = [f"path:{i:02d}" for i in range(40)]
    rows = [(["host:a", *many] if i % 2 else ["host:b"], "block" if i % 2 else "allow") for i in range(100)]
    got = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert {(r.tokens, r.verdict) for r in got} == {(("host:a",), "block"), (("host:b",), "allow")}
