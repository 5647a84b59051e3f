"""Exchanges: each assistant turn with the user's last prompt, and the responses before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEPT, DROPPED = 20, 10  # fixed values: over 20 kept responses the oldest 10 are dropped
BLOCK_BITS = 16  # a block of with_prior_by_block: so many values of `order`, as a power of two
ROWS_A_TASK = 32  # a task is begun for so many responses at least, up to the shuffle's number of partitions


def pair(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, turn, prompt, response. One shuffle, by conversation.

    Its number of partitions is given, so that they aren't joined again by their few bytes: scoring a text, which comes
    behind it, takes milliseconds."""
    turns = turns.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prompt = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    return turns.withColumn("prompt", F.coalesce(prompt, F.lit(""))).filter("role = 'assistant'").select("conv_id", "turn", "prompt", F.col("text").alias("response"))


def kept_after(n: Column) -> Column:
    """How many responses are kept after n."""
    return F.when(n <= KEPT, n).otherwise(KEPT - DROPPED + 1 + (n - KEPT - 1) % DROPPED)


def with_prior(exchanges: DataFrame, lookback: int, within: list[str], order: list[str]) -> DataFrame:
    """Adds prior: the last responses, oldest first.

    within: [] is one history over everything, as one sequential reader has it (one task sorts all: exact mode for small
    inputs); ['conv_id'] or the like keeps a history for each key, which is the mode for large inputs."""
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order)
    lookback = min(lookback, KEPT)
    prior = F.collect_list("response").over(w.rowsBetween(-lookback, -1)) if lookback else F.array().cast("array<string>")
    out = exchanges.withColumn("prior", prior)
    if lookback > KEPT - DROPPED + 1:
        kept = kept_after(F.row_number().over(w) - 1)
        out = out.withColumn("prior", F.reverse(F.slice(F.reverse("prior"), F.lit(1), F.greatest(F.lit(1), kept.cast("int")))))
    return out


def _last(items: Column, n: int) -> Column:
    return F.reverse(F.slice(F.reverse(items), 1, n))


def with_prior_by_block(exchanges: DataFrame, lookback: int, group: str, order: str, across: bool) -> DataFrame:
    """What with_prior adds for within=[] (across) or [group], and order [group, order], without a task that gets a whole history.

    order: a long that tells a group's rows apart (the byte or line in a file); group is never null. Rows are dealt out by
    blocks of 2^BLOCK_BITS values of order. Behind the responses of its own block, a row takes the last ones ahead of the
    block: those of the group's blocks before it and, across groups, of the groups before. The latter are the only rows
    that meet in one task, one for each group with at most `lookback` responses.

    The number of partitions is given, as in pair; exchanges are read three times."""
    lookback, trimmed = min(lookback, KEPT), lookback > KEPT - DROPPED + 1
    most = int(exchanges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, exchanges.count() // ROWS_A_TASK))
    said = F.struct("response")  # keeps the places of nulls, which collect_list leaves out
    rows = exchanges.withColumn("_block", F.shiftright(F.col(order).cast("long"), BLOCK_BITS))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), said.alias("said")))), lambda x: x["said"])
    blocks = rows.groupBy(group, "_block").agg(F.count("*").alias("n"), _last(in_order, lookback).alias("last"))
    of_group = Window.partitionBy(group).orderBy("_block")
    blocks = _with_ahead(blocks, of_group, lookback)
    if across:
        groups = blocks.groupBy(group).agg(F.sum("n").alias("n"), F.max_by(_last(F.concat("ahead", "last"), lookback), "_block").alias("last"))
        groups = _with_ahead(groups, Window.orderBy(group), lookback).select(group, F.col("ahead").alias("outer"), F.col("n_ahead").alias("n_outer"))
        blocks = blocks.join(groups, group).withColumns({"ahead": _last(F.concat("outer", "ahead"), lookback), "n_ahead": F.col("n_outer") + F.col("n_ahead")})
    # What is ahead of a block stands as one row before the block's own. A join could send the rows themselves to every task.
    both = rows.unionByName(blocks.select(group, "_block", "ahead", "n_ahead"), allowMissingColumns=True).repartition(parts, group, "_block")
    in_block = Window.partitionBy(group, "_block").orderBy(F.col("n_ahead").isNull(), order)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.collect_list(F.when(F.col("n_ahead").isNull(), said)).over(in_block.rowsBetween(-lookback, -1))
    known = {c: F.first(c, ignorenulls=True).over(so_far) for c in ("ahead", "n_ahead")}
    out = both.withColumns({"_own": own, "_nth": F.row_number().over(in_block) - 1, "_is_row": F.col("n_ahead").isNull()}).withColumns(known).filter("_is_row")
    prior = F.transform(F.filter(_last(F.concat("ahead", "_own"), lookback), lambda x: x["response"].isNotNull()), lambda x: x["response"])
    if trimmed:
        prior = F.reverse(F.slice(F.reverse(prior), F.lit(1), F.greatest(F.lit(1), kept_after(F.col("n_ahead") + F.col("_nth") - 1).cast("int"))))
    return out.select(*(F.col(f"`{c}`") for c in exchanges.columns), prior.alias("prior"))


def _with_ahead(parts: DataFrame, by: WindowSpec, lookback: int) -> DataFrame:
    """parts (n, last) -> with the last responses ahead of each, and their number."""
    ahead = _last(F.flatten(F.collect_list("last").over(by.rowsBetween(-lookback, -1))), lookback)
    return parts.withColumns({"ahead": ahead, "n_ahead": F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
