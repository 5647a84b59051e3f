"""URL filters: explicit host and path rules, and association rules mined from the urls that those rules label.

A url's tokens are its scheme, the labels and the last two labels of its host, its path segments, its file extension and
the names of its query parameters. Urls that an explicit rule judges are the labelled transactions: their tokens and
their verdict go into Spark's FP-growth. Tokens on the very same transactions are one item, named by the first of them, so
that tokens that always occur together don't multiply the itemsets. Of the association rules with a verdict as consequent
stay those of at least MIN_SUPPORT and of MIN_ROWS transactions, MIN_CONFIDENCE, lift above 1 and at most MAX_TOKENS tokens,
and of these only such that no rule with fewer of the same tokens is as confident.

Rules are matched by an inverted index, token -> rules that ask for it: a rule matches when all its tokens were found.
While there are at most MAX_LITERAL rules the index is a literal map and no row moves; beyond that it is a table, joined
by token. Both ways give the same verdicts. Where no explicit rule fits, the most confident matching rule decides, allow
before block at a tie; where none matches the url is allowed.

Nulls: a url that is null or without `://` has an empty host and path, no tokens, and is allowed by the method. Without
labelled urls there are no mined rules. Repeated rows are each judged. Rules of equal confidence tie: allow wins. A very long
url is one row like any other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.llm.common import LOWER, UPPER, stored, table

MIN_SUPPORT = 0.01
MIN_ROWS = 20
MIN_CONFIDENCE = 0.8
MAX_TOKENS = 3
MAX_LITERAL = 256
VERDICTS = ("allow", "block")
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Mined:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host and path."""
    rest = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": host, "path": path})


def explicit_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule (host, then path) that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        of_host, _, of_path = rule.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit(f".{of_host}"))) & F.startswith(path, F.lit(f"/{of_path}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens_of() -> Column:
    """Distinct tokens of url, host and path."""
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    query = F.regexp_extract("url", r"(?s)\?([^#]*)", 1)
    tokens = F.concat(
        named("scheme", F.array(F.translate(F.regexp_extract("url", r"(?s)^(.*?)://", 1), UPPER, LOWER))),
        named("host", F.split("host", r"\.")),
        named("site", F.array(F.substring_index("host", ".", -2))),
        named("path", F.split("path", "/")),
        named("type", F.array(F.regexp_extract("path", r"\.([^./]*)$", 1))),
        named("query", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
    )
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tokens))


def mine(labelled: DataFrame) -> list[Mined]:
    """labelled (tokens, verdict) -> pruned association rules."""
    n = labelled.count()
    if n < MIN_ROWS:
        return []
    least = max(MIN_SUPPORT, MIN_ROWS / n)
    # Two digests of the transactions that hold a token tell tokens of equal transactions.
    rows = labelled.select(F.xxhash64("tokens").alias("row"), F.explode("tokens").alias("token"))
    part = lambda seed: F.sum(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)))
    held = rows.groupBy("token").agg(F.count("*").alias("n"), part(1).alias("x"), part(2).alias("y")).filter(F.col("n") >= least * n)
    # At most (a url's tokens / MIN_SUPPORT) tokens are frequent enough.
    items_of = sorted(r["token"] for r in held.groupBy("n", "x", "y").agg(F.min("token").alias("token")).collect())
    frequent = F.array_intersect("tokens", F.array(*map(F.lit, items_of)) if items_of else F.array().cast("array<string>"))
    items = labelled.select(F.array_append(frequent, F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    model = FPGrowth(minSupport=least, minConfidence=MIN_CONFIDENCE).fit(items)
    found = model.associationRules.filter(
        F.col("consequent")[0].isin([f"verdict:{v}" for v in VERDICTS]) & (F.size("antecedent") <= MAX_TOKENS) & (F.col("lift") > 1)
    )
    # Each url has at most (its tokens over MAX_TOKENS) antecedents, each of at least MIN_SUPPORT: a bounded number.
    rules = [Mined(tuple(sorted(r["antecedent"])), r["consequent"][0][8:], r["confidence"]) for r in found.collect()]
    rules.sort(key=lambda r: (len(r.tokens), r.tokens))
    kept: list[Mined] = []
    for r in rules:
        if not any(k.verdict == r.verdict and k.confidence >= r.confidence and set(k.tokens) < set(r.tokens) for k in kept):
            kept.append(r)
    return kept


def _decided(matched: Column) -> Column:
    """matched: array<struct<confidence, allow, ..>>; the verdict of the greatest, or allow."""
    best = F.array_max(matched)
    return F.when(best["allow"] == 0, F.lit("block")).otherwise(F.lit("allow"))


def judged(urls: DataFrame, rules: list[Mined]) -> DataFrame:
    """urls (with tokens) -> mined_verdict besides."""
    if not rules:
        return urls.withColumn("mined_verdict", F.lit("allow"))
    if len(rules) > MAX_LITERAL:
        return _judged_by_join(urls, rules)
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        for t in r.tokens:
            index.setdefault(t, []).append(k)
    lookup = F.create_map(*(x for t, ks in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    facts = F.array(
        *(F.struct(F.lit(r.confidence).alias("confidence"), F.lit(int(r.verdict == "allow")).alias("allow"), F.lit(len(r.tokens)).alias("n")) for r in rules)
    )
    hits = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(lookup, t), F.array().cast("array<int>"))))
    found = urls.withColumn("_hits", hits)
    matched = F.transform(
        F.filter(
            F.array_distinct("_hits"),
            lambda k: F.size(F.filter("_hits", lambda h: h == k)) == F.get(facts, k)["n"],
        ),
        lambda k: F.get(facts, k),
    )
    return found.withColumn("mined_verdict", _decided(matched)).drop("_hits")


def _judged_by_join(urls: DataFrame, rules: list[Mined]) -> DataFrame:
    spark = urls.sparkSession
    rows = [(t, k, len(r.tokens), r.confidence, int(r.verdict == "allow")) for k, r in enumerate(rules) for t in r.tokens]
    index = spark.createDataFrame(rows, "_token string, _rule int, _n int, confidence double, allow int")
    tokens = urls.select("url", "tokens").filter(F.col("url").isNotNull()).dropDuplicates(["url"])
    matched = (
        tokens.select("url", F.explode("tokens").alias("_token"))
        .join(index, "_token")
        .groupBy("url", "_rule", "_n", "confidence", "allow")
        .agg(F.count("*").alias("_found"))
        .filter("_found = _n")
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "allow")).alias("_best"))
        .select("url", F.when(F.col("_best.allow") == 0, "block").otherwise("allow").alias("mined_verdict"))
    )
    return urls.join(matched, "url", "left").withColumn("mined_verdict", F.coalesce("mined_verdict", F.lit("allow")))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages (page_id, url) -> page_id, url, host, path, rule, verdict, tokens, mined_verdict."""
    parts = with_parts(pages.select("page_id", "url"))
    parts = parts.withColumns({"rule": explicit_rule(F.col("host"), F.col("path"), rules), "tokens": tokens_of()})
    of_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        of_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(of_rule)
    labelled = parts.filter(F.col("rule").isNotNull()).select("tokens", of_rule.alias("verdict"))
    out = judged(parts, mine(stored(labelled, "url-labelled")))
    return out.withColumn("verdict", F.coalesce(of_rule, "mined_verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "mined_verdict")
