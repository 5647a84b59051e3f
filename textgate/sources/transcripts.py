"""Transcripts: two JSONL dialects and a Markdown one, read as DataFrames.

Lines of a file are put in order and read with running values over the file: one shuffle by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESPONSES = ["session_meta", "response_item", "event_msg", "turn_context"]
MESSAGES = ["assistant", "user", "human"]
ALLOW_DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def read_lines(spark: SparkSession, path: str | list[str], ends_only: bool = True) -> DataFrame:
    """file, line_no, line of all *.jsonl below path. A last line without a line feed is left out (it may be unfinished).

    Files are split at line feeds by position in their bytes, a file at a time."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").format("binaryFile").load(path)
    text = F.decode(F.encode(F.make_valid_utf8(F.col("content").cast("string")), "utf-8"), "utf-8")
    lines = F.split(text, "\n")
    full = F.slice(lines, F.lit(1), F.size(lines) - 1) if ends_only else lines
    return whole.select(F.col("path").alias("file"), F.posexplode(full).alias("line_no", "line")).select(
        "file", F.col("line_no").cast("long"), F.regexp_replace("line", r"\r+\z", "").alias("line")
    )


def _string(v: Column, path: str) -> Column:
    """A JSON string's value at path; null for other types."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def _blocks(v: Column, path: str, kinds: list[str]) -> Column:
    """Text blocks of those kinds joined by line feeds; null without one, or where path isn't an array."""
    is_array = F.startswith(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("ARRAY"))
    texts = F.filter(
        F.transform(F.try_variant_get(v, path, "array<variant>"), lambda b: F.when(_string(b, "$.type").isin(kinds), _string(b, "$.text"))), lambda t: t.isNotNull()
    )
    return F.when(is_array & (F.size(texts) > 0), F.array_join(texts, "\n"))


def _meta(v: Column, root: str) -> tuple[Column, Column]:
    """Content class hint and labels: the first place that is there counts, whatever its type."""
    from textgate.functions.classify import class_of

    places = ["content_class", "metadata.content_class", "payload.metadata.content_class"]
    hint = F.lit(None).cast("string")
    for p in reversed(places):
        hint = F.when(F.try_variant_get(v, f"{root}.{p}", "variant").isNotNull(), class_of(_string(v, f"{root}.{p}"))).otherwise(hint)
    labels = F.lit(None).cast("array<string>")
    for p in reversed([x.replace("content_class", "labels") for x in places]):
        items = F.filter(F.transform(F.try_variant_get(v, f"{root}.{p}", "array<variant>"), lambda x: _string(x, "$")), lambda x: x.isNotNull())
        labels = F.when(F.try_variant_get(v, f"{root}.{p}", "variant").isNotNull(), F.coalesce(items, F.array().cast("array<string>"))).otherwise(labels)
    return hint, F.coalesce(labels, F.array().cast("array<string>"))


def session_of_path(file: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(file, "/", -1), r"\.[^.]*\z", "")
    return F.when(F.contains(stem, F.lit("-019")), F.concat(F.lit("019"), F.regexp_extract(stem, r"(?s)^.*-019(.*)\z", 1))).otherwise(stem)


STATE = "file string, source string, session_id string, cwd string, prompt string"


def walked(lines: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """lines (file, line_no, line) -> the records of known files in order, with what a reader of the file knows behind each:
    source, session_id, cwd, prompt; and role, said, content_class_hint, labels of the record itself.

    state (STATE): what was known of a file when its earlier lines were read; it stands ahead of the file's lines."""
    # The setting takes effect when the plan runs, so it can't be put back here.
    lines.sparkSession.conf.set(ALLOW_DUPLICATES, "true")  # of repeated keys the last counts
    v = F.col("v")
    by_line = Window.partitionBy("file").orderBy("line_no")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.filter(F.rlike("line", F.lit(r"(?U)\S"))).select("file", F.col("line_no").cast("long"), F.try_parse_json("line").alias("v")).filter("v is not null")
    type_ = _string(v, "$.type")
    dialect = F.when(type_.isin(RESPONSES), "responses-jsonl").when(type_.isin(MESSAGES), "message-jsonl")
    known = lambda c: F.lit(None).cast("string").alias(c)
    rows = rows.select("file", "line_no", "v", type_.alias("type"), dialect.alias("dialect"), known("known_id"), known("known_cwd"), known("known_prompt"))
    if state is not None:
        kept = state.select(
            "file", F.lit(-1).cast("long").alias("line_no"), F.lit(None).cast("variant").alias("v"), F.lit(None).cast("string").alias("type"), F.col("source").alias("dialect"),
            F.col("session_id").alias("known_id"), F.col("cwd").alias("known_cwd"), F.col("prompt").alias("known_prompt"),
        )
        rows = rows.unionByName(kept)
    rows = rows.withColumn("source", F.first("dialect", ignorenulls=True).over(so_far)).filter("source is not null")
    is_message = F.col("source") == "message-jsonl"
    meta = F.col("type") == "session_meta"
    own_id = F.when(is_message, _string(v, "$.sessionId")).when(meta, _string(v, "$.payload.id"))
    cwd = F.when(is_message, _string(v, "$.cwd")).when(meta, _string(v, "$.payload.cwd"))
    item = (F.col("type") == "response_item") & (_string(v, "$.payload.type") == "message")
    role = F.when(is_message, F.when(F.col("type").isin("user", "human"), "user").when(F.col("type") == "assistant", "assistant")).when(item, _string(v, "$.payload.role"))
    said = F.when(
        is_message,
        F.when(role == "user", F.coalesce(_blocks(v, "$.message.content", ["text"]), _string(v, "$.message.content"))).otherwise(_blocks(v, "$.message.content", ["text"])),
    ).otherwise(_blocks(v, "$.payload.content", ["input_text", "output_text", "text"]))
    (m_hint, m_labels), (r_hint, r_labels) = _meta(v, "$"), _meta(v, "$.payload")
    rows = rows.select(
        "file", "line_no", "source", F.nullif(F.coalesce("known_id", own_id), F.lit("")).alias("own_id"), F.coalesce("known_cwd", cwd).alias("own_cwd"),
        F.when(F.col("line_no") < 0, "user").otherwise(role).alias("role"), F.coalesce("known_prompt", said).alias("said"),
        F.when(is_message, m_hint).otherwise(r_hint).alias("content_class_hint"), F.when(is_message, m_labels).otherwise(r_labels).alias("labels"),
    )
    rows = rows.withColumns({"session_id": F.last("own_id", ignorenulls=True).over(so_far), "id_before": F.last("own_id", ignorenulls=True).over(before)})
    # Another id in a message file begins a new epoch, without the prompt and folder of the one before.
    turned = (F.col("source") == "message-jsonl") & F.col("own_id").isNotNull() & F.col("id_before").isNotNull() & (F.col("own_id") != F.col("id_before"))
    rows = rows.withColumn("epoch", F.sum(F.when(turned, 1).otherwise(0)).over(so_far))
    in_epoch = Window.partitionBy("file", "epoch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("file")
    rows = rows.withColumns(
        {
            "prompt": F.coalesce(F.last(F.when(F.col("role") == "user", F.col("said")), ignorenulls=True).over(in_epoch), F.lit("")),
            "cwd": F.coalesce(F.last("own_cwd", ignorenulls=True).over(in_epoch), F.lit("")),
            "any_id": F.max("own_id").over(whole),
        }
    )
    fallback = F.when((F.col("source") == "responses-jsonl") & F.col("any_id").isNull(), session_of_path(F.col("file"))).otherwise("")
    return rows.select("file", "line_no", "source", F.coalesce("session_id", fallback).alias("session_id"), "cwd", "prompt", "role", "said", "content_class_hint", "labels")


def exchanges_of(rows: DataFrame) -> DataFrame:
    """rows of walked -> exchanges."""
    return rows.filter((F.col("role") == "assistant") & F.col("said").isNotNull()).select(
        "file", "line_no", "source", "session_id", "cwd", "prompt", F.col("said").alias("response"), "content_class_hint", "labels"
    )


def state_of(rows: DataFrame) -> DataFrame:
    """rows of walked -> STATE behind the last record of each file."""
    last = F.max_by(F.struct("source", "session_id", "cwd", "prompt"), "line_no").alias("s")
    return rows.groupBy("file").agg(last).select("file", "s.*")


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, line) -> exchanges: file, line_no, source, session_id, cwd, prompt, response, content_class_hint, labels."""
    return exchanges_of(walked(lines))


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_jsonl(read_lines(spark, path))


USER, ASSISTANT = "**User:**", "**Assistant:**"


def parse_markdown(files: DataFrame) -> DataFrame:
    """files (file, text) -> exchanges as of parse_jsonl; line_no is the response's first line. Windows by file.

    A response ends at the next mark, at a line that begins with three dashes, or at the end. It counts if it isn't blank, and
    also if dashes close it. What follows closed responses goes to the prompt, unless that was empty from its begin."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    split = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")
    rows = files.select("file", F.posexplode(split).alias("line_no", "line"))
    kind = (
        F.when(F.startswith("line", F.lit(USER)), "user").when(F.startswith("line", F.lit(ASSISTANT)), "assistant").when(F.startswith("line", F.lit("---")), "rule")
    )
    rows = rows.withColumn("kind", kind)
    by_line = Window.partitionBy("file").orderBy("line_no")
    marks = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), 1).otherwise(0))
    rows = rows.withColumns({"part": marks("user", "assistant").over(by_line), "asked": marks("user").over(by_line)}).filter("part > 0")
    in_part = Window.partitionBy("file", "part").orderBy("line_no")
    rows = rows.withColumns({"opens": F.first("kind").over(in_part), "rules": marks("rule").over(in_part)})
    content = (
        F.when(F.col("kind") == "user", trim(F.substr("line", F.lit(len(USER) + 1))))
        .when(F.col("kind") == "assistant", trim(F.substr("line", F.lit(len(ASSISTANT) + 1))))
        .when(F.col("kind").isNull(), F.col("line"))
    )
    answers = (F.col("opens") == "assistant") & (F.col("rules") == 0)
    joined = lambda lines: F.array_join(F.transform(F.array_sort(lines), lambda x: x["content"]), "\n")
    gathered = lambda goes: F.collect_list(F.when(goes & F.col("content").isNotNull(), F.struct("line_no", "content")))
    parts = (
        rows.withColumn("content", content)
        .groupBy("file", "asked", "part", "opens")
        .agg(
            F.min("line_no").alias("line_no"),
            F.max("rules").alias("rules"),
            F.first(F.when(F.col("kind") == "user", F.col("content")), ignorenulls=True).alias("begin"),
            gathered(answers).alias("response"),
            gathered(~answers).alias("prompt"),
        )
        .withColumns({"response": trim(joined(F.col("response"))), "prompt": F.when(F.size("prompt") > 0, joined(F.col("prompt")))})
    )
    before = Window.partitionBy("file", "asked").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.first("begin").over(before)
    prompt = F.when(begin != "", trim(F.array_join(F.collect_list("prompt").over(before), "\n"))).otherwise("")
    return (
        parts.withColumn("prompt", prompt)
        .filter("opens = 'assistant' and (response <> '' or rules > 0)")
        .select(
            "file", F.col("line_no").cast("long"), F.lit("markdown").alias("source"), F.lit("markdown").alias("session_id"), F.lit("").alias("cwd"), "prompt",
            "response", F.lit(None).cast("string").alias("content_class_hint"), F.array().cast("array<string>").alias("labels"),
        )
    )


def read_markdown(spark: SparkSession, path: str | list[str], after: dict[str, int] | None = None) -> DataFrame:
    """All *.md below path. after: how many bytes of a file (by its path as Spark gives it) have been read before."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").format("binaryFile").load(path)
    content = F.col("content")
    if after:
        offset = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in after.items() for x in pair)), F.col("path")), F.lit(0))
        content = F.substring(content, offset + 1, F.length(content))
    return parse_markdown(files.select(F.col("path").alias("file"), F.make_valid_utf8(content.cast("string")).alias("text")))
