import datetime

import pytest

from textgate.operators import corrections
from textgate.spec import default_spec, with_changes


def test_unfinished_promotions_are_an_error(spark, monkeypatch):
    rows = [(1, datetime.datetime(2026, 1, 1), 0, [("filler", "x")], "generic", "r")]
    scored = spark.createDataFrame(rows, "seq long, ts timestamp, score int, issues array<struct<category string, detail string>>, class string, response string")
    monkeypatch.setattr(corrections, "with_issues", lambda exchanges, spec: scored)
    monkeypatch.setattr(corrections, "ruled", lambda found, spec, rules: scored)
    spec = with_changes(default_spec(), {"corrections.promotion_threshold": 1})
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        corrections.promotion_fixpoint(scored, spec, most_rounds=1)
    assert [r["after"] for r in corrections.promotion_fixpoint(scored, spec, most_rounds=2)[1]] == [1]
