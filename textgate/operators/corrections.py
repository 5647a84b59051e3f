"""The corrections ledger: fan-out, counts in a time window, promotion of frequent violations to rules."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgate.operators.score import exploded, ruled, with_issues
from textgate.spec import Section

KEY = ["content_class", "type", "pattern"]
LEDGER = "ts string, type string, pattern string, session string, score int, source string, context string, content_class string"
ACTION, DEDUCTION, CONTEXT_CHARS = "reject", 5, 200  # fixed values of new rules, and of the stored context
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def fan_out(scored: DataFrame, spec: Section, keep: list[str]) -> DataFrame:
    """A row for each issue of a failing response."""
    failing = F.when(F.col("score") < spec.scoring.passing_score, F.col("issues"))
    rows = exploded(scored, failing, *keep, F.col("class").alias("content_class"), "score", F.substring("response", 1, CONTEXT_CHARS).alias("context"))
    return rows.select(*keep, "ord", "content_class", F.col("i.category").alias("type"), F.col("i.detail").alias("pattern"), "score", "context")


def ledger_time(ts: Column) -> Column:
    """The instant of an RFC 3339 string, else null."""
    return F.when(F.rlike(ts, F.lit(RFC3339)), F.try_to_timestamp(F.upper(ts)))


def in_window(ledger: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Rows from as_of - days on (inclusive); ledger needs a timestamp `at`. Later rows count too."""
    return ledger.filter(F.col("at") >= as_of - F.make_interval(days=F.lit(days)))


def counts(ledger: DataFrame, as_of: Column, days: int) -> DataFrame:
    keyed = in_window(ledger, as_of, days).withColumn("content_class", F.coalesce("content_class", F.lit("generic")))
    return keyed.groupBy(*KEY).agg(F.count("*").alias("occurrence_count"))


def candidates(ledger: DataFrame, rules: DataFrame, as_of: Column, spec: Section) -> DataFrame:
    """New rules: keys that reached the threshold and aren't rules yet, in order of the key."""
    often = counts(ledger, as_of, spec.corrections.aggregation_window_days).filter(F.col("occurrence_count") >= spec.corrections.promotion_threshold)
    return often.join(rules.select(*KEY).distinct(), KEY, "left_anti").select(
        *KEY, F.lit(ACTION).alias("action"), F.lit(DEDUCTION).alias("deduction"), F.date_format(as_of, "yyyy-MM-dd").alias("promoted_date"), F.col("occurrence_count").cast("int")
    )


def due_keys(ledger: DataFrame, written: DataFrame, as_of: Column, spec: Section) -> DataFrame:
    """Which of the keys just written have reached the threshold, with their counts."""
    keyed = lambda rows: rows.withColumn("content_class", F.coalesce("content_class", F.lit("generic")))
    mine = keyed(ledger).join(keyed(written).select(*KEY).distinct(), KEY, "left_semi")
    return counts(mine, as_of, spec.corrections.aggregation_window_days).filter(F.col("occurrence_count") >= spec.corrections.promotion_threshold)


def any_due(ledger: DataFrame, written: DataFrame, as_of: Column, spec: Section) -> bool:
    return not due_keys(ledger, written, as_of, spec).limit(1).isEmpty()


def promotion_fixpoint(exchanges: DataFrame, spec: Section, most_rounds: int = 1000) -> tuple[DataFrame, list[dict]]:
    """Scores a batch as a sequential reader would, who promotes after each failing message.

    exchanges: seq (order), ts, and what score() needs. A key is promoted by the message at which its count within the
    window reaches the threshold, and acts on later messages. The validators run once, their issues are kept; then all
    messages are scored with the promotions known so far, those are computed anew, until they stay: promotions only come
    earlier, and each round settles one at least. Promotions that still move after most_rounds are an error. Rows of
    one instant count in the order of seq.
    Returns the scored rows and the rules (with `after`: the seq of the promoting message). The rules are few: each needs
    a threshold of occurrences of one text."""
    days = spec.corrections.aggregation_window_days
    found = with_issues(exchanges, spec).persist(StorageLevel.DISK_ONLY)
    after: dict[tuple, dict] = {}
    for _ in range(most_rounds):
        scored = ruled(found, spec, _rules(after))
        rows = fan_out(scored, spec, ["seq", "ts"])
        n = _counts_so_far(rows, days)
        due = n.filter(F.col("n") >= spec.corrections.promotion_threshold)
        firsts = due.groupBy(*KEY).agg(F.min(F.struct("seq", "ts", "n")).alias("m")).select(*KEY, "m.*").collect()
        new = {(r["content_class"], r["type"], r["pattern"]): {"after": r["seq"], "n": r["n"], "ts": r["ts"]} for r in firsts}
        if {k: v["after"] for k, v in new.items()} == {k: v["after"] for k, v in after.items()} or not spec.corrections.auto_promote:
            break
        after = new
    else:
        raise RuntimeError(f"promotions still move after {most_rounds} rounds")
    return scored, _rules(after)


def _counts_so_far(rows: DataFrame, days: int) -> DataFrame:
    """rows (seq, ts, KEY) -> KEY, seq, ts, n: how often the key was written up to and with that message, from ts - days on.

    A message counts once for each of its issues of the key, as its rows are written together."""
    each = rows.groupBy(*KEY, "seq", "ts").agg(F.count("*").alias("m")).withColumn("at", F.unix_micros("ts"))
    in_order = Window.partitionBy(*KEY).orderBy("at", "seq")
    so_far = F.sum("m").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    too_old = F.coalesce(F.sum("m").over(Window.partitionBy(*KEY).orderBy("at").rangeBetween(Window.unboundedPreceding, -days * 86_400_000_000 - 1)), F.lit(0))
    return each.select(*KEY, "seq", "ts", (so_far - too_old).alias("n"))


def _rules(after: dict[tuple, dict]) -> list[dict]:
    return [
        dict(zip(KEY, k, strict=True)) | {"action": ACTION, "deduction": DEDUCTION, "promoted_date": f"{v['ts']:%Y-%m-%d}", "occurrence_count": v["n"], "after": v["after"]}
        for k, v in sorted(after.items(), key=lambda x: (x[1]["after"], x[0]))
    ]
