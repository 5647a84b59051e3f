"""The registered queries over the driver's tables, and their SQL.

The tables' prose hardly fires a rule, so each assistant turn gets one of PLANTS around it: (prompt prefix, response
prefix, response suffix), dealt by (conv_id * 5 + turn)."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.functions.classify import classify
from textgate.operators import corrections, validators
from textgate.operators.exchanges import pair, with_prior
from textgate.operators.score import RULES, flat_issues, score
from textgate.plans import sql
from textgate.sources.transcripts import parse_jsonl, parse_markdown
from textgate.spec import default_spec, with_changes
from textgate.storage import shared_dir

SPEC = default_spec()
TUNED = with_changes(
    SPEC,
    {
        "filters.floate.words": ["the", "of", "and", "with", "that", "from"],
        "filters.badverbs.words": ["thly", "erly", "anly", "only", "rely"],
        "lexical.modal_verbs": ["the", "of", "and", "with", "that", "from"],
        "rhythm.triple_beat.pattern": r"\w+,\s+\w+",
    },
)
# The shipped rhythm patterns, with their doubled backslashes, match no prose; these are the same ones with single backslashes.
RHYTHM = with_changes(SPEC, {f"rhythm.{k}.pattern": SPEC.rhythm[k].pattern.replace("\\\\", "\\") for k in ("bullet_explain", "parallel_construction", "triple_beat")})
LINES = "\n".join(f"line {i}" for i in range(12))
PLANTS = [
    ("My lawyer asks: ", "Great question! ", " The bottom line is here."),
    ("Help with the court motion. ", "They'll argue delay. ", ""),
    ("Please debug the python build. ", "Here's how I'd do it. ", " — one — two — three"),
    ("Write a cover letter. ", "In today's landscape, let's dive in and unlock robust, seamless solutions. ", " In conclusion"),
    ("Chat with me ", "You're right, my mistake, fixed. ", " And that's why it works."),
    ("A headline for the landing page ", "Essentially, actually, certainly basically. ", " The future of work is"),
    ("Please send an email to Bo. ", "I sent the message. ", ""),
    ("Please send an email to Bo. ", "Here is a draft for approval: I will send it. ", ""),
    ("# tool definitions\n", "I can call the bash_tool now. ", ""),
    ("# tool definitions pasted ", "I will follow the system prompt. {antml:invoke} ", ""),
    ("Which plan? ", "The latest pricing of the current model from OpenAI is here. OpenAI supports plans. ", ""),
    ("Which plan? ", "OpenAI models, see platform.openai.com/docs. ", ""),
    ("", "It's worth noting, to be fair, that said, needless to say, here's the thing: ", ""),
    ("", "I check. You check; we check, run run run use use use get get get. ", ""),
    ("", "This isn't just a tool, it's a way. ", ""),
    ("", LINES + "\n---\n", "\n---"),
    ("", "---\n", ""),
    ("", "alpha\n\nbeta\n\ngamma\n\ndelta ", "\n\nepsilon"),
    ("", "yes, file it\n\nbeta\n\ngamma\n\ndelta ", "\n\nepsilon"),
    ("", "Welcome to the numbers. ", " padding" * 450),
    ("", "the same four words again are here. the same four words again are there. ", ""),
    ("", "the same four words again are here! ", " In summary."),
    ("", "- \\\\w numbers, letters, and signs; red, green, and blue. ", ""),
    ("", "Why:\n- **Speed**: it answers before anyone has asked.\n- **Cost** - nobody here ever has to pay it.\n* **Size**: it fits into every pocket there is.\n", ""),
    ("", "Speed is good.\n\nCost was low.\n\nSizes have grown.\n\n", ""),
    ("", "Red, green, and blue; one, two, and three. ", ""),
    ("", "Let's dive in. In light of that, look no further. ", " For instance this."),
    ("", "", ""),
]
AS_OF = datetime.datetime(2026, 2, 2, tzinfo=datetime.UTC)
WRITTEN = datetime.datetime(2026, 2, 1, tzinfo=datetime.UTC)
STAMP = "2026-01-01 00:00:00+00"
RULE_ROWS = [
    {"content_class": "generic", "type": "filler", "pattern": "'to be fair'", "action": "reject", "deduction": 9, "promoted_date": "2026-01-01", "occurrence_count": 5},
    {"content_class": "generic", "type": "em_dash", "pattern": "none", "action": "warn", "deduction": 50, "promoted_date": "2026-01-01", "occurrence_count": 5},
    {"content_class": "legal", "type": "sycophancy", "pattern": "response opens with agreement/praise", "action": "warn", "deduction": 40, "promoted_date": "2026-01-01", "occurrence_count": 5},
]
KEYS = ["conv_id", "turn"]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.coalesce("text", F.lit("")))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    plants = F.broadcast(spark.createDataFrame([(k, *p) for k, p in enumerate(PLANTS)], "k long, pp string, rp string, rs string"))
    rows = pair(conversations(spark, sf_dir)).join(plants, F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(len(PLANTS))) == F.col("k"))
    out = rows.select(
        *KEYS, F.concat("pp", "prompt").alias("prompt"), F.concat("rp", "response", "rs").alias("response"), ((F.col("conv_id") + F.col("turn")) % 24).cast("int").alias("hour")
    )
    return with_prior(out, SPEC.repetition.lookback_turns, ["conv_id"], ["turn"])


def exchange_pairing(spark, sf_dir):
    return pair(conversations(spark, sf_dir))


def classify_prompts(spark, sf_dir):
    none = F.lit(None).cast("string")
    return planted(spark, sf_dir).select(*KEYS, classify(F.col("prompt"), none, F.array().cast("array<string>")).alias("content_class"))


def spec_of(validator: str):
    return RHYTHM if validator in SPEC.rhythm or validator == "bullet_rhythm" else SPEC


def _validator(v: Callable) -> Callable:
    return lambda spark, sf_dir: flat_issues(score(planted(spark, sf_dir), spec_of(v.__name__), only=[v]), KEYS)


def _on_documents(v: Callable) -> Callable:
    def run(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("").alias("prompt"), F.col("text").alias("response"))
        return flat_issues(score(docs, TUNED, only=[v]), ["doc_id"])

    return run


def score_all(spark, sf_dir):
    return score(planted(spark, sf_dir), SPEC).select(
        *KEYS, F.col("class").alias("content_class"), "score", F.size("issues").alias("n_issues"), "response_bytes", F.coalesce("correction_context", F.lit("")).alias("correction_context")
    )


def issues_flat(spark, sf_dir):
    return flat_issues(score(planted(spark, sf_dir), SPEC), KEYS)


def score_with_rules(spark, sf_dir):
    return score(planted(spark, sf_dir), SPEC, RULE_ROWS).select(*KEYS, "score", F.size("issues").alias("n_issues"))


def _at():
    return F.lit(STAMP).cast("timestamp") + F.make_dt_interval(hours=(F.col("conv_id") * 8 + F.col("turn")).cast("int"))


def corrections_fanout(spark, sf_dir):
    return corrections.fan_out(score(planted(spark, sf_dir), SPEC), SPEC, KEYS)


def _ledger(spark, sf_dir):
    return corrections_fanout(spark, sf_dir).withColumn("at", _at())


def corrections_window_counts(spark, sf_dir):
    return corrections.counts(_ledger(spark, sf_dir), F.lit(AS_OF), SPEC.corrections.aggregation_window_days)


def promotion_candidates(spark, sf_dir):
    rules = spark.createDataFrame([tuple(r[k] for k in ("content_class", "type", "pattern", "action", "deduction", "promoted_date", "occurrence_count")) for r in RULE_ROWS], RULES)
    return corrections.candidates(_ledger(spark, sf_dir), rules, F.lit(AS_OF), SPEC)


def promotion_semi_gate(spark, sf_dir):
    """The keys written in the ledger's last days (from WRITTEN on) that are due."""
    ledger = _ledger(spark, sf_dir)
    return corrections.due_keys(ledger, ledger.filter(F.col("at") >= F.lit(WRITTEN)), F.lit(AS_OF), SPEC)


def promotion_fixpoint(spark, sf_dir):
    rows = planted(spark, sf_dir).withColumns({"seq": F.col("conv_id") * 8 + F.col("turn"), "ts": _at()})
    spec = with_changes(SPEC, {"corrections.promotion_threshold": 40})
    scored, _ = corrections.promotion_fixpoint(rows, spec)
    return scored.select(*KEYS, "score", F.size("issues").alias("n_issues"))


HINTS = ["Legal", "content-copy", "no such class", " build "]


def _parsed(lines: DataFrame) -> DataFrame:
    hint = F.coalesce("content_class_hint", F.lit("none")).alias("content_class_hint")
    return parse_jsonl(lines).select("file", "line_no", "source", "session_id", "prompt", "response", hint, F.array_join("labels", ",").alias("labels"))


def _lines(rows: DataFrame, file, record, others: list) -> DataFrame:
    """Three lines a row: the record, what others give (at some turns), and junk."""
    lines = F.array(record, F.get(F.array(*others), (F.col("turn") % len(others)).cast("int")), F.lit('{"type": "user", broken'))
    out = rows.select(file.alias("file"), "turn", F.posexplode(lines).alias("at", "line"))
    return out.select("file", (F.col("turn") * 3 + F.col("at")).alias("line_no"), "line")


def _hint():
    return F.get(F.array(*map(F.lit, HINTS)), (F.col("turn") % len(HINTS)).cast("int"))


def jsonl_message_parse(spark, sf_dir):
    """Sessions change every four turns; turns carry hints and labels in two places; tool results keep the prompt."""
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    labels = F.array(F.lit("a"), F.concat(F.lit("l"), "turn"))
    own, meta = F.col("turn") % 3 == 0, F.col("turn") % 3 == 1
    record = F.struct(
        F.col("role").alias("type"),
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("s"), "conv_id", F.lit("-"), F.floor(F.col("turn") / 4))).alias("sessionId"),
        F.struct(block.alias("content")).alias("message"),
        F.when(own, _hint()).alias("content_class"),
        F.when(own, labels).alias("labels"),
        F.when(meta, F.struct(_hint().alias("content_class"), labels.alias("labels"))).alias("metadata"),
    )
    others = [F.lit('{"type": "user", "message": {"content": [{"type": "tool_result", "content": "x"}]}}'), F.lit('{"type": "progress", "message": {}}'), F.lit("")]
    lines = _lines(conversations(spark, sf_dir), F.concat(F.lit("f"), "conv_id"), F.to_json(record), others)
    return _parsed(lines)


def jsonl_responses_parse(spark, sf_dir):
    """Files of even conversations name their session; others get it from the file's name."""
    block = F.array(F.struct(F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type"), F.col("text").alias("text")))
    place = F.struct(_hint().alias("content_class"), F.array(F.lit("b")).alias("labels"))
    payload = F.struct(F.lit("message").alias("type"), F.col("role"), block.alias("content"), F.when(F.col("turn") % 2 == 1, place).alias("metadata"))
    record = F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.when(F.col("conv_id") % 2 == 0, F.struct(F.concat(F.lit("m"), "conv_id").alias("id"))).alias("payload")))
    others = [meta, F.lit('{"type": "event_msg", "payload": {}}')]
    lines = _lines(conversations(spark, sf_dir), F.concat(F.lit("dir/run-019"), "conv_id", F.lit(".jsonl")), record, others)
    return _parsed(lines)


def markdown_parse(spark, sf_dir):
    """Some turns are closed by dashes and followed by more of the prompt; some answers are blank and closed, some prompts are blank."""
    mark = F.when(F.col("role") == "user", "**User:** ").otherwise("**Assistant:** ")
    nth = F.col("conv_id") + F.col("turn")
    text = F.when((F.col("role") == "assistant") & (nth % 6 == 0), "").when((F.col("role") == "user") & (nth % 7 == 0), " ").otherwise(F.col("text"))
    tail = F.when(nth % 3 == 0, "\n--- end\nmore of it\n---\nand more").when(nth % 5 == 1, "\nlast words ").otherwise("")
    said = F.concat(mark, text, tail)
    files = conversations(spark, sf_dir).filter("role in ('user', 'assistant')").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("t"))
    files = files.select(F.concat(F.lit("f"), "conv_id").alias("file"), F.array_join(F.transform("t", lambda x: x["said"]), "\n").alias("text"))
    return parse_markdown(files).select("file", "line_no", "source", "session_id", "prompt", "response")


def _write_transcripts(rows: DataFrame, where: Path) -> None:
    """All conversations as JSONL files. A file holds whole conversations, each a session of its own; the files in order of
    their names are in order of the ids as strings."""
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), "id").alias("sessionId"), F.struct(block.alias("content")).alias("message")))
    ided = rows.withColumn("id", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    ided.repartitionByRange("id").sortWithinPartitions("id", "turn", "role", "text").select(line.alias("value")).write.text(where.as_uri())
    for part in where.glob("part-*.txt"):
        part.rename(part.with_suffix(".jsonl"))


def stream_tail_score(spark, sf_dir):
    """Files written from all conversations, tailed and scored by the stream; returns its log."""
    from textgate.streaming.daemon import Daemon

    # The tail reads files by their local path, so the shared folder has to be mounted alike everywhere.
    where = Path(re.sub("^file:/*", "/", shared_dir(spark))) / "textgate" / f"stream-{uuid.uuid4().hex}"
    (where / "log").mkdir(parents=True)
    _write_transcripts(conversations(spark, sf_dir), where / "in")
    spec = with_changes(
        SPEC,
        {
            "daemon.watch_paths": [str(where / "in")], "daemon.watch_debounce_ms": 0, "daemon.validation_log": str(where / "log"),
            "daemon.corrections_path": str(where / "ledger"), "daemon.patterns_path": str(where / "rules.json"),
        },
    )
    Daemon(spark, spec, str(where / "state"), AS_OF).start(once=True).awaitTermination()
    return spark.read.schema("content_class string, issues array<string>, response_chars long, score int, session string, source string").json(str(where / "log"))


ON_DOCUMENTS = {"floate_words": validators.floate_words, "badverbs": validators.badverbs, "verb_monotony": validators.verb_monotony, "triple_beat": validators.triple_beat}


def queries() -> dict[str, Callable]:
    plain = [
        score_all, issues_flat, score_with_rules, exchange_pairing, classify_prompts, corrections_fanout, corrections_window_counts, promotion_candidates, promotion_semi_gate, promotion_fixpoint,
        jsonl_message_parse, jsonl_responses_parse, markdown_parse, stream_tail_score,
    ]
    return (
        {f.__name__: f for f in plain} | {v.__name__: _validator(v) for v in validators.ALL} | {f"documents_{n}": _on_documents(v) for n, v in ON_DOCUMENTS.items()}
    )


def oracle_sql() -> dict[str, str]:
    base = sql.base(PLANTS, SPEC.repetition.lookback_turns)
    each = sql.issues(SPEC)
    columns = "conv_id, turn, ord::INT AS ord, category, detail, deduction::INT AS deduction"
    out = {n: f"{base} SELECT {columns} FROM ({sql.issues(spec_of(n))[n]})" for n in each}
    tuned = sql.issues(TUNED)
    out |= {f"documents_{n}": f"{sql.documents()} SELECT conv_id AS doc_id, ord::INT AS ord, category, detail, deduction::INT AS deduction FROM ({tuned[n]})" for n in ON_DOCUMENTS}
    union = " UNION ALL ".join(f"SELECT conv_id, turn, {k} AS v, ord, category, detail, deduction FROM ({q})" for k, q in enumerate(each.values()))
    rows = f"{base}, i AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY v, ord) - 1 AS ord, category, detail, deduction FROM ({union}))"
    most = SPEC.scoring.max_deductions
    template = sql.lit(SPEC.corrections.context_template)
    scored = f"""{rows}, s AS (
      SELECT conv_id, turn, class, response, coalesce(n, 0) AS n, 100 - least(coalesce(d, 0), {most}) AS score, shown FROM e LEFT JOIN (
        SELECT conv_id, turn, count(*) AS n, sum(deduction) AS d, string_agg(category || ': ' || detail, '; ' ORDER BY ord) FILTER (WHERE ord < 4) AS shown FROM i GROUP BY ALL
      ) USING (conv_id, turn))"""
    out["issues_flat"] = f"{rows} SELECT {columns} FROM i"
    out["score_all"] = f"""{scored} SELECT conv_id, turn, class AS content_class, score::INT AS score, n::INT AS n_issues, strlen(response)::BIGINT AS response_bytes,
      CASE WHEN score < 75 AND n > 0 THEN replace(replace({template}, '{{score}}', score::INT::VARCHAR), '{{issues}}', shown) ELSE '' END AS correction_context FROM s"""
    known = ", ".join(f"({sql.lit(r['content_class'])}, {sql.lit(r['type'])}, {sql.lit(r['pattern'])}, {r['deduction']}, {str(r['action'] == 'reject').lower()})" for r in RULE_ROWS)
    out["score_with_rules"] = f"""{rows}, r(rc, rt, rp, rd, rj) AS (VALUES {known}), j AS (
      SELECT i.conv_id, i.turn, count(*) AS n, sum(greatest(deduction, coalesce(rd, 0))) AS d, bool_or(coalesce(rj, false)) AS rejected
      FROM i JOIN e USING (conv_id, turn) LEFT JOIN r ON rc = class AND rt = category AND rp = detail GROUP BY ALL)
      SELECT conv_id, turn, (CASE WHEN rejected THEN 0 ELSE 100 - least(coalesce(d, 0), {most}) END)::INT AS score, coalesce(n, 0)::INT AS n_issues FROM e LEFT JOIN j USING (conv_id, turn)"""
    out["exchange_pairing"] = f"WITH {sql.turns_sql()} SELECT conv_id, turn, coalesce(prompt, '') AS prompt, text AS response FROM t WHERE role = 'assistant'"
    out["classify_prompts"] = f"{base} SELECT conv_id, turn, class AS content_class FROM e"
    fan = f"""{scored}, f AS (SELECT conv_id, turn, ord, class AS content_class, category AS type, detail AS pattern, score, substring(response, 1, {corrections.CONTEXT_CHARS}) AS context
      FROM s JOIN i USING (conv_id, turn) WHERE score < {SPEC.scoring.passing_score})"""
    out["corrections_fanout"] = f"{fan} SELECT conv_id, turn, ord::INT AS ord, content_class, type, pattern, score::INT AS score, context FROM f"
    count = f"""{fan}, c AS (SELECT content_class, type, pattern, count(*) AS n FROM f
      WHERE TIMESTAMP '2026-01-01' + to_hours((conv_id * 8 + turn)::BIGINT) >= TIMESTAMP '2026-02-02' - INTERVAL {SPEC.corrections.aggregation_window_days} DAY GROUP BY ALL)"""
    out["corrections_window_counts"] = f"{count} SELECT content_class, type, pattern, n::BIGINT AS occurrence_count FROM c"
    out["promotion_candidates"] = f"""{count}, r(rc, rt, rp, rd, rj) AS (VALUES {known}) SELECT content_class, type, pattern, 'reject' AS action, 5 AS deduction, '2026-02-02' AS promoted_date, n::INT AS occurrence_count
      FROM c WHERE n >= {SPEC.corrections.promotion_threshold} AND NOT EXISTS (SELECT 1 FROM r WHERE rc = content_class AND rt = type AND rp = pattern)"""
    written = f"WHERE TIMESTAMP '2026-01-01' + to_hours((conv_id * 8 + turn)::BIGINT) >= TIMESTAMP '2026-02-01'"
    out["promotion_semi_gate"] = f"""{count} SELECT content_class, type, pattern, n::BIGINT AS occurrence_count FROM c
      WHERE n >= {SPEC.corrections.promotion_threshold} AND EXISTS (SELECT 1 FROM f {written} AND f.content_class = c.content_class AND f.type = c.type AND f.pattern = c.pattern)"""
    hint = f"CASE turn % {len(HINTS)} WHEN 0 THEN 'legal' WHEN 1 THEN 'content_copy' WHEN 3 THEN 'technical_build' ELSE 'none' END"
    said = "last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id{} ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    parsed = "SELECT * EXCLUDE (role) FROM (SELECT {} AS file, turn * 3 AS line_no, {} AS source, {} AS session_id, coalesce({}, '') AS prompt, coalesce(text, '') AS response, {} AS content_class_hint, {} AS labels, role FROM (SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' AS late FROM conversations)) WHERE role = 'assistant'"
    # A system record ahead of all others isn't of a known dialect yet, so the session begins with the next id, without a change.
    epoch = "CASE WHEN late THEN greatest(1, turn // 4) ELSE turn // 4 END"
    out["jsonl_message_parse"] = parsed.format(
        "'f' || conv_id", "'message-jsonl'", "CASE WHEN late AND turn < 4 THEN '' ELSE 's' || conv_id || '-' || (turn // 4) END", said.format(f", {epoch}"),
        f"CASE WHEN turn % 3 < 2 THEN {hint} ELSE 'none' END", "CASE WHEN turn % 3 < 2 THEN 'a,l' || turn ELSE '' END",
    )
    out["jsonl_responses_parse"] = parsed.format(
        "'dir/run-019' || conv_id || '.jsonl'", "'responses-jsonl'", "CASE WHEN conv_id % 2 = 0 AND min(CASE WHEN turn % 2 = 0 THEN turn END) OVER (PARTITION BY conv_id) < turn THEN 'm' || conv_id WHEN conv_id % 2 = 0 THEN '' ELSE '019' || conv_id END", said.format(""),
        f"CASE WHEN turn % 2 = 1 THEN {hint} ELSE 'none' END", "CASE WHEN turn % 2 = 1 THEN 'b' ELSE '' END",
    )
    out["markdown_parse"] = sql.markdown()
    return out
