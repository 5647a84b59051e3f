r"""Document fingerprints: spot signatures, with DataFrame expressions alone.

Words are runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of the text with A-Z lower-cased. Behind each common word (anchor),
and behind the text's begin, the next CHAIN content words within SPAN words form a chain; chain and anchor are hashed to
a spot signature. Where anchors are rarer than one in SPAN words, every word between an anchor and the
next one is an anchor too, so that all parts of a text count, whatever its language. A document's fingerprint is the
set of its signatures; without any chain it is one hash of the text.
The string of a fingerprint is the set's size and a digest of its sorted signatures.

Two fingerprints are compared by the Jaccard likeness of their sets; the query compares a row with its edited text and with
the next row.

Search (`similar_documents`): documents of equal sets are one class. Classes are partitioned by set length, so that sets
of a likeness of THRESHOLD or more lie in the same partition or in adjacent ones; each signature of a class's prefix
(rarest first, as many as needed to meet every alike set) is posted to an inverted index by (signature, partition), in its
own partition and the one below. A pair is compared only if its lengths and the places of the signature leave enough behind
for the threshold. Buckets of frequent signatures are dealt into chunks, and groups of alike classes are contracted
around pivots instead of being expanded into pairs (see ngram_join.contracted).

Neighbours (`with_next`): rows are ordered by descending doc_id, ties by a hash of the text, null ids last. They are dealt
into buckets of nearly equal row counts by quantiles of doc_id; the head of each bucket is also dealt to the bucket
before it, so that every row meets the row behind it without one task having to sort everything. All rows of one doc_id
fall into one bucket.

Nulls: a null text is an empty one; empty texts have a fingerprint and are alike to each other. Repeated rows follow each
other. In a table of one row the row follows itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textgate.llm import ngram_join
from textgate.llm.common import stored, table
from textgate.llm.decontaminate import split_words

CHAIN = 3
SPAN = 10
THRESHOLD = 0.75  # as ngram_join has it
BUCKET_ROWS = 512
MAX_BUCKETS = 16_384
COARSE = 128
# Anchors: common words of English, German, French and Spanish (fixed values).
ANCHORS = sorted(
    set(
        "the of and to in a is that it was for on are with as be at by this from or an not have has but "
        "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
        "de la le et les en un une du est pour que qui dans par sur au pas avec il "
        "el y los se del las por con su para al lo como más o".split()
    )
)


def signatures(text: Column) -> Column:
    """Distinct spot signatures of a text, array<long>; needs `_words` and `_common` from with_signatures."""
    words, common = F.col("_words"), F.col("_common")
    # Position i stands for the anchor words[i - 1]; 0 is the begin.
    following = F.concat(F.slice(common, F.lit(2), F.size(common)), F.array(F.size(words) + 1))
    rare = F.zip_with(
        common,
        following,
        lambda at, then: F.when(then - at > SPAN, F.sequence(at + 1, then - 1)).otherwise(F.array().cast("array<int>")),
    )
    anchor_at = F.concat(common, F.flatten(rare))
    chain = lambda i: F.slice(F.filter(F.slice(words, i + 1, F.lit(SPAN)), lambda w: ~w.isin(ANCHORS)), 1, CHAIN)
    chains = F.filter(
        F.transform(
            anchor_at,
            lambda i: F.struct(F.when(i > 0, F.get(words, i - 1)).otherwise("").alias("anchor"), chain(i).alias("words")),
        ),
        lambda c: F.size(c["words"]) > 0,
    )
    found = F.array_distinct(F.transform(chains, lambda c: F.xxhash64(c["anchor"], c["words"])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.xxhash64(text)))


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    words = F.filter(split_words(F.col(text)), lambda w: w != "")
    common = F.filter(F.sequence(F.lit(0), F.size("_words")), lambda i: (i == 0) | F.get(F.col("_words"), i - 1).isin(ANCHORS))
    return rows.withColumn("_words", words).withColumn("_common", common).withColumn(name, signatures(F.col(text))).drop("_words", "_common")


def fingerprint(sigs: Column) -> Column:
    """The string of a signature set."""
    return F.concat(
        F.size(sigs).cast("string"), F.lit(":"), F.md5(F.array_join(F.array_sort(sigs).cast("array<string>"), ","))
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def length_class(n: Column) -> Column:
    """Partition by set length: alike sets lie in the same one or in adjacent ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / THRESHOLD))).cast("int")


def similar_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint, component_id: the smallest doc_id reachable over likenesses of at least
    THRESHOLD. Nulls and empty texts are alike to each other. A null doc_id never names a component, unless no other row does."""
    rows = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sigs")
    rows = rows.select("doc_id", F.sort_array("sigs").alias("sigs")).withColumn("k", F.xxhash64("sigs"))
    rows = stored(rows.select("doc_id", "k", F.size("sigs").alias("n"), fingerprint(F.col("sigs")).alias("fingerprint"), "sigs"), "spot-rows")
    postings = rows.groupBy("k", "n").agg(F.min("sigs").alias("sigs")).select("k", "n", F.explode("sigs").alias("token"))
    postings = stored(postings, "spot-postings")
    counts = postings.groupBy("token").agg(F.count("*").alias("count")).filter("count > 1")
    level = F.least("count", F.lit(ngram_join.FREQUENT - 1)).cast("int").alias("level")
    sets = ngram_join.sets_of(postings.join(counts, "token").select("k", "n", "token", level))
    lengths = F.array(length_class(F.col("n")), length_class(F.col("n")) - 1)
    members = ngram_join.members_of(sets, F.transform(lengths, lambda x: F.xxhash64(F.col("token"), x)))
    return ngram_join.with_components(rows.drop("sigs"), ngram_join.contracted(sets, members)).select("doc_id", "fingerprint", "component_id")


def _bucket(docs: DataFrame) -> tuple[Column, int]:
    """Bucket of a row: 0 for the largest doc_ids."""
    n, low, high = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    coarse = min(COARSE, buckets)
    if not n or coarse == 1:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0), 2
    cuts = docs.agg(F.percentile_approx("doc_id", [k / coarse for k in range(1, coarse)], 10_000)).first()[0]
    cuts = sorted({low, *cuts, high + 1})
    fine = -(-buckets // coarse)
    edges = F.array(*(F.lit(c).cast("long") for c in cuts))
    at = F.size(F.filter(edges, lambda c: c <= F.col("doc_id"))) - 1
    share = (F.col("doc_id") - F.get(edges, at)) / (F.get(edges, at + 1) - F.get(edges, at))
    place = at * fine + F.least(F.floor(share * fine).cast("int"), F.lit(fine - 1))
    last = (len(cuts) - 1) * fine
    return F.coalesce(F.lit(last) - place, F.lit(last + 1)), last + 2


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, sigs, next_text, next_sigs; texts aren't null."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bucket, _ = _bucket(rows)
    rows = rows.withColumns({"bucket": bucket, "tie": F.xxhash64("text")})
    # The first row of each bucket, at most MAX_BUCKETS of them and a few.
    heads = sorted(
        rows.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "tie"), F.struct("doc_id", "tie")).alias("head")).collect(),
        key=lambda r: r["bucket"],
    )
    targets = [(heads[k]["bucket"], heads[k]["head"]["doc_id"], heads[k]["head"]["tie"], heads[k - 1]["bucket"]) for k in range(len(heads))]
    ghosts = docs.sparkSession.createDataFrame(targets, "bucket int, _id long, tie long, _to int")
    marked = rows.join(
        F.broadcast(ghosts),
        (rows["bucket"] == ghosts["bucket"]) & rows["doc_id"].eqNullSafe(ghosts["_id"]) & (rows["tie"] == ghosts["tie"]),
        "left",
    ).select("doc_id", "text", rows["bucket"].alias("bucket"), rows["tie"].alias("tie"), "_to")
    places = F.filter(
        F.array(
            F.struct(F.col("bucket").alias("at"), F.lit(0).alias("ghost")),
            F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("at"), F.lit(1).alias("ghost"))),
        ),
        lambda p: p.isNotNull(),
    )
    dealt = (
        marked.select("doc_id", "text", "tie", F.explode(places).alias("p"))
        .select("doc_id", "text", "tie", F.col("p.at").alias("at"), F.col("p.ghost").alias("ghost"))
        .repartition("at")
    )
    order = Window.partitionBy("at").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("tie"))
    both = F.lead(F.struct("text", "sigs")).over(order)
    return (
        with_signatures(dealt, "text", "sigs")
        .withColumn("_next", both)
        .filter("ghost = 0")
        .select("doc_id", "text", "sigs", F.col("_next.text").alias("next_text"), F.col("_next.sigs").alias("next_sigs"))
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - k), F.substr("next_text", F.lit(1), k))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "sigs", edited.alias("edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next")
    )
    return with_signatures(rows, "edited", "edited_sigs").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        "near_next",
    )
