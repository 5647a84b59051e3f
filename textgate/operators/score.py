"""Scores: all validators, enablement, promoted rules, the sum of deductions. One projection without a shuffle."""

from __future__ import annotations

import json

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgate.functions import text as T
from textgate.functions.classify import classify
from textgate.operators import validators
from textgate.spec import Section

CONTEXT_BELOW = 75  # fixed value: not the passing score
# Which name of violations.active enables a category.
SWITCHES = {"insight_bow": "insight_bow", "rhetorical_crutch": "rhetorical_crutch_isnt_just_x", "layer1": "layer1_missing_adversarial", "layer2": "layer2_bot_as_architect"}
WORD_SWITCHES = {"word:landscape": "floate_landscape", "word:significant": "floate_significant"}
RULES = "content_class string, type string, pattern string, action string, deduction int, promoted_date string, occurrence_count int"


def rule_key(content_class: Column, category: Column, detail: Column) -> Column:
    return F.concat_ws("::", content_class, category, detail)


def enabled(issue: Column, spec: Section) -> Column:
    active = set(spec.violations.active)
    out = F.lit(True)
    for category, switch in SWITCHES.items():
        if switch not in active:
            out = out & (issue["category"] != category)
    for detail, switch in WORD_SWITCHES.items():
        if switch not in active:
            out = out & ~((issue["category"] == "FLOATE") & (issue["detail"] == detail))
    if not spec.policy_pack.enabled and "policy_pack" not in active:
        out = out & (issue["category"] != "policy_pack")
    return out


def displays(issues: Column) -> Column:
    return F.transform(issues, lambda i: F.concat(i["category"], F.lit(": "), i["detail"]))


def correction_context(score: Column, issues: Column, template: str) -> Column:
    listed = F.array_join(F.slice(displays(issues), 1, 4), "; ")
    text = F.replace(F.replace(F.lit(template), F.lit("{score}"), score.cast("string")), F.lit("{issues}"), listed)
    return F.when((score < CONTEXT_BELOW) & (F.size(issues) > 0), text)


_COLUMNS: dict[tuple, Column] = {}


def _all_issues(spec: Section, only: list | None) -> Column:
    """The issues of the validators as one column. Thousands of calls to the JVM make it, so it is kept for each configuration."""
    used = only or validators.ALL
    key = (id(SparkContext._gateway), json.dumps(spec, sort_keys=True, default=str), *(v.__name__ for v in used))
    if key not in _COLUMNS:
        if len(_COLUMNS) >= 64:
            _COLUMNS.clear()
        _COLUMNS[key] = F.concat(*(v(spec) for v in used))
    return _COLUMNS[key]


def with_issues(exchanges: DataFrame, spec: Section, only: list | None = None) -> DataFrame:
    """Adds class, found (the issues of all validators, before enablement and rules) and response_bytes.

    exchanges: prompt, response; optionally content_class_hint, labels, hour, prior."""
    defaults = {"content_class_hint": F.lit(None).cast("string"), "labels": F.array().cast("array<string>"), "hour": F.lit(None).cast("int"), "prior": F.array().cast("array<string>")}
    extra = [c for c in defaults if c not in exchanges.columns]
    df = exchanges.withColumns({c: defaults[c] for c in extra})
    df = validators.prepared(df.withColumn("class", classify(F.col("prompt"), F.col("content_class_hint"), F.col("labels"))))
    df = df.withColumns({"found": _all_issues(spec, only), "response_bytes": F.octet_length("response").cast("long")})
    return df.drop("low", "low_prompt", "words", "tokens", *extra)


def ruled(found: DataFrame, spec: Section, rules: list[dict] | None = None) -> DataFrame:
    """found of with_issues -> issues, score and correction_context, under the rules.

    rules: promoted rules, a small list kept on the driver; of several with one key the first counts. A rule with `after`
    acts on rows of a larger seq only."""
    known: dict[str, dict] = {}
    for r in rules or []:
        known.setdefault(f"{r.get('content_class') or 'generic'}::{r['type']}::{r['pattern']}", r)
    table = {
        key: F.struct(
            F.lit(int(r["deduction"])).alias("cost"), F.lit(str(r["action"]).lower() == "reject").alias("rejects"), F.lit(r.get("after")).cast("long").alias("after")
        )
        for key, r in known.items()
    }
    none = F.lit(None).cast("struct<cost:int,rejects:boolean,after:bigint>")
    lookup = F.create_map(*(x for key, r in table.items() for x in (F.lit(key), r))) if table else None
    late = any(r.get("after") is not None for r in known.values())

    def rule_of(i: Column) -> Column:
        if lookup is None:
            return none
        rule = F.try_element_at(lookup, rule_key(F.col("class"), i["category"], i["detail"]))
        return T.let(rule, lambda r: F.when(r["after"].isNull() | (F.col("seq") > r["after"]), r)) if late else rule

    both = F.filter(F.transform("found", lambda i: F.struct(i.alias("i"), rule_of(i).alias("r"))), lambda x: enabled(x["i"], spec) | x["r"].isNotNull())
    cost = lambda x: F.greatest(x["i"]["deduction"], F.coalesce(x["r"]["cost"], F.lit(0)))
    judged = T.let(
        both,
        lambda b: F.struct(
            F.transform(b, lambda x: F.struct(x["i"]["category"].alias("category"), x["i"]["detail"].alias("detail"), cost(x).alias("deduction"))).alias("issues"),
            F.exists(b, lambda x: F.coalesce(x["r"]["rejects"], F.lit(False))).alias("rejected"),
        ),
    )

    def scored(j: Column) -> Column:
        total = F.aggregate(j["issues"], F.lit(0), lambda acc, i: acc + i["deduction"])
        points = F.when(j["rejected"], 0).otherwise(F.greatest(F.lit(0), 100 - F.least(total, F.lit(spec.scoring.max_deductions))))
        return F.struct(j["issues"].alias("issues"), points.cast("int").alias("score"))

    with_context = lambda v: F.struct(
        v["issues"].alias("issues"), v["score"].alias("score"), correction_context(v["score"], v["issues"], spec.corrections.context_template).alias("correction_context")
    )
    df = found.withColumn("_result", T.let(T.let(judged, scored), with_context))
    return df.select(*(F.col(f"`{c}`") for c in found.columns if c != "found"), "_result.issues", "_result.score", "_result.correction_context")


def score(exchanges: DataFrame, spec: Section, rules: list[dict] | None = None, only: list | None = None) -> DataFrame:
    """Adds class, issues, score, response_bytes and correction_context: with_issues and ruled in one projection."""
    return ruled(with_issues(exchanges, spec, only), spec, rules)


def exploded(scored: DataFrame, issues: Column, *keep: Column | str) -> DataFrame:
    """A row for each issue: keep, ord (from 0), i. An outer explode, since Spark would write the issues' whole expression
    once more as a filter below an inner one; a filter on the score would do the same."""
    return scored.select(*keep, F.posexplode_outer(issues).alias("ord", "i")).filter("ord is not null")


def flat_issues(scored: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each issue: keys, ord (from 0), category, detail, deduction."""
    return exploded(scored, F.col("issues"), *keys).select(*keys, "ord", "i.category", "i.detail", "i.deduction")


def log_record(scored: DataFrame) -> DataFrame:
    """The validation log's columns."""
    return scored.select(F.col("class").alias("content_class"), displays(F.col("issues")).alias("issues"), F.col("response_bytes").alias("response_chars"), "score", F.col("session_id").alias("session"), "source")
