r"""Benchmark decontamination by a distributed positional inverted index.

Words are runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of the text with A-Z lower-cased. A window is WINDOW consecutive words
of a benchmark item; an item of fewer words, but not none, is one window.

1. The terms of the benchmark are counted over all training words (map-side sums; one row for each term).
2. Each window's terms are ordered from the rarest on; the rarest is its anchor.
3. The index stores a posting (document, position, the words around) for each training word that is an anchor. Postings
   meet the windows by their anchor, and the lists of the other terms are intersected offset by offset, the rarest first,
   within the words around. With slop > 0 a term may lie that many places off: a proximity match.
4. The matches of a document are merged: its words inside any match are hit.

The windows are broadcast while there are at most MAX_BROADCAST of them; beyond that they are joined by shuffling on the
anchor. Terms are literals while there are at most MAX_LITERAL; beyond that they are a table.

Nulls: null or empty texts have no words; such items have no window. Repeated rows are each reported. A null item_id is
reported as the string `null`. An empty benchmark hits nothing; empty documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.llm.common import ascii_lower, stored, table

WINDOW = 13
MAX_BROADCAST = 50_000
MAX_LITERAL = 20_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """The words; the first and the last entry may be empty. Null for null."""
    return F.split(ascii_lower(text), BETWEEN)


def n_words(words: Column) -> Column:
    ends = (F.get(words, F.lit(0)) == "").cast("int") + ((F.size(words) > 1) & (F.get(words, F.size(words) - 1) == "")).cast("int")
    return F.coalesce(F.size(words) - ends, F.lit(0)).cast("long")


def windows(benchmark: DataFrame, length: int) -> DataFrame:
    """benchmark (item_id, text) -> distinct (item_id, window array<string>)."""
    words = F.filter(F.coalesce(split_words(F.col("text")), F.array().cast("array<string>")), lambda w: w != "")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words.alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - length + 1))
    return (
        items.filter(F.size("words") > 0)
        .select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("words", F.col("start"), F.lit(length)).alias("window"))
        .distinct()
    )


def _among(c: str, terms: list[str]) -> str:
    """SQL, which is planned far faster than thousands of literal columns. Words hold no quote and no backslash."""
    return f"{c} IN ({', '.join(f"'{t}'" for t in terms)})" if terms else "false"


def indexed_windows(docs: DataFrame, windows_of: DataFrame) -> DataFrame:
    """Adds anchor, anchor_at and terms: array<struct<n, term, at>>, the rarest first. docs: (words)."""
    terms = windows_of.select(F.explode("window").alias("term")).distinct()
    some = [r["term"] for r in terms.limit(MAX_LITERAL + 1).collect()]
    words = docs.select(F.explode("words").alias("term"))
    few = words.filter(_among("term", some)) if len(some) <= MAX_LITERAL else words.join(terms, "term", "left_semi")
    # A row for each term of the benchmark. Broadcast, so that a term of many windows is no hot key.
    counts = stored(few.groupBy("term").agg(F.count("*").alias("n")), "benchmark-counts")
    counts = F.broadcast(counts) if len(some) <= MAX_LITERAL else counts
    by_rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at")))
    return (
        windows_of.select("item_id", "window", F.posexplode("window").alias("at", "term"))
        .join(counts, "term", "left")
        .groupBy("item_id", "window")
        .agg(by_rarity.alias("terms"))
        .select(
            "item_id",
            F.size("window").alias("length"),
            F.get("terms", F.lit(0))["term"].alias("anchor"),
            F.get("terms", F.lit(0))["at"].alias("anchor_at"),
            "terms",
        )
        # A window with a term that the training words lack can't occur exactly.
    )


def matches(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = 0) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, row (hash of doc_id and text), anchor, item_id, start, length.

    A row for each match, and one with null item_id for each document row."""
    read = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), split_words(F.col("text")).alias("words"))
    index = stored(indexed_windows(read, windows(benchmark, length)), "benchmark-windows")
    n_windows = index.count()
    anchors = index.select("anchor").distinct()
    around = length - 1 + slop
    first = lambda i: F.greatest(i - around, F.lit(0))
    posting = lambda i, w: F.struct(
        i.alias("pos"), w.alias("term"), F.slice("words", first(i) + 1, F.lit(2 * around + 1)).alias("near")
    )
    document = F.struct(F.lit(-1).alias("pos"), F.lit("").alias("term"), F.array().cast("array<string>").alias("near"))
    places = "sequence(0, greatest(size(words) - 1, 0))"
    if n_windows <= MAX_BROADCAST:
        known = [r["anchor"] for r in anchors.collect()]
        of_anchors = F.expr(f"filter({places}, i -> {_among('get(words, i)', known)})")
    else:
        of_anchors = F.expr(places)
    postings = F.transform(of_anchors, lambda i: posting(i, F.get("words", i)))
    rows = read.select(
        "doc_id",
        "row",
        n_words(F.col("words")).alias("n_words"),
        F.explode(F.concat(F.array(document), F.coalesce(postings, F.array().cast(postings_type())))).alias("p"),
    ).select("doc_id", "row", "n_words", "p.*")
    joined = rows.join(F.broadcast(index) if n_windows <= MAX_BROADCAST else index, rows["term"] == index["anchor"], "left")
    start = F.col("pos") - F.col("anchor_at")
    in_near = start - first(F.col("pos"))
    at = lambda t, off=0: F.when(in_near + t["at"] + off >= 0, F.get("near", in_near + t["at"] + off))
    if slop:
        fits = lambda t: F.exists(F.sequence(F.lit(-slop), F.lit(slop)), lambda d: F.coalesce(at(t, d) == t["term"], F.lit(False)))
        whole = F.lit(True)
    else:
        fits, whole = lambda t: F.coalesce(at(t) == t["term"], F.lit(False)), in_near >= 0
    return joined.filter((F.col("pos") < 0) | (F.col("anchor").isNotNull() & whole & F.forall("terms", fits))).select(
        "doc_id", "row", "n_words", "item_id", F.when(F.col("item_id").isNotNull(), start).alias("start"), "length"
    )


def postings_type() -> str:
    return "array<struct<pos:int,term:string,near:array<string>>>"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row, n_words, n_hit, items array<string> (sorted), contaminated."""
    found = matches(docs, benchmark)
    per_doc = found.groupBy("doc_id", "row", "n_words").agg(
        F.count(F.when(F.col("item_id").isNull(), 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("item_id").isNotNull(), F.struct("start", "length")))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("hit"),
        ),
    )["hit"].cast("long")
    out = per_doc.withColumn("n_hit", merged).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "row", "n_words", "n_hit", "items", "contaminated"
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold any window of the benchmark, however long they are; all columns stay."""
    bad = contamination(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    bad = stored(bad, "contaminated")
    small = bad.count() <= MAX_BROADCAST
    keyed = docs.withColumn("_doc_row", F.xxhash64("doc_id", "text"))
    at = (F.col("_doc_row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return keyed.join(F.broadcast(bad) if small else bad, at, "left_anti").drop("_doc_row")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS length, array_to_string(words[s : s + 12], ' ') AS window_text
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS s FROM i WHERE len(words) > 0)
), spot AS (
  SELECT r, words, length, unnest(range(1, len(words) - length + 2)) AS s
  FROM w, (SELECT DISTINCT length FROM win)
), hit AS (
  SELECT r, s, length, item_id FROM (SELECT r, s, length, array_to_string(words[s : s + length - 1], ' ') AS window_text FROM spot)
  JOIN win USING (window_text, length)
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + length)) AS p FROM hit) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""
