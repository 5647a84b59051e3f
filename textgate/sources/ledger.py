"""The corrections ledger, the rules file and the validation log."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.operators.corrections import LEDGER, ledger_time
from textgate.spec import expand_home

NEEDED = ["ts", "type", "pattern", "session", "score", "source", "context"]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows and `at`; lines that aren't such rows are left out, a missing class is generic."""
    rows = spark.read.schema(LEDGER).option("mode", "PERMISSIVE").json(expand_home(path))
    for c in NEEDED:
        rows = rows.filter(F.col(c).isNotNull())
    return rows.withColumns({"content_class": F.coalesce("content_class", F.lit("generic")), "at": ledger_time(F.col("ts"))})


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(expand_home(path))


def read_rules(path: str) -> list[dict]:
    """The promoted rules; a file that is missing or lacks something has none."""
    try:
        found = json.loads(Path(expand_home(path)).read_text("utf-8"))
        assert isinstance(found["last_aggregation"], str)
        return [
            {
                "content_class": r.get("content_class", "generic"), "type": str(r["type"]), "pattern": str(r["pattern"]), "action": str(r["action"]),
                "deduction": int(r["deduction"]), "promoted_date": str(r["promoted_date"]), "occurrence_count": int(r["occurrence_count"]),
            }
            for r in found["promoted_rules"]
        ]
    except (OSError, ValueError, KeyError, TypeError, AssertionError, AttributeError):
        return []


def write_rules(rules: list[dict], path: str, as_of: str) -> None:
    file = Path(expand_home(path))
    file.parent.mkdir(parents=True, exist_ok=True)
    part = file.with_suffix(".part")
    part.write_text(json.dumps({"promoted_rules": rules, "last_aggregation": as_of}, indent=2), "utf-8")
    part.replace(file)
