import json

from pyspark.sql import functions as F

from textgate.operators.exchanges import with_prior, with_prior_by_block
from textgate.operators.score import score as whole_score
from textgate.spec import default_spec, with_changes
from textgate.streaming import daemon


def test_blocks_give_what_one_task_gives(spark):
    at = F.when(F.col("id") % 7 == 0, F.col("id")).otherwise(F.col("id") * 30_011)  # blocks of one row up to many; some start late
    said = F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("r"), "id"))
    rows = spark.range(300).select(F.concat(F.lit("f"), F.col("id") * F.col("id") % 5).alias("file"), (at + 100_000 * (F.col("id") % 2)).alias("line_no"), said.alias("response"))
    for lookback in (1, 5, 12, 20):
        for within in ([], ["file"]):
            want = with_prior(rows, lookback, within, ["file", "line_no"])
            got = with_prior_by_block(rows, lookback, "file", "line_no", across=not within)
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (lookback, within)
    one_block = spark.range(50).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("response"))
    assert sorted(map(str, with_prior_by_block(one_block, 20, "file", "line_no", True).collect())) == sorted(map(str, with_prior(one_block, 20, [], ["line_no"]).collect()))
    assert with_prior_by_block(one_block.limit(0), 5, "file", "line_no", True).collect() == []


def test_a_batch_is_scored_once_and_by_several_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for f in range(8):
        said = [{"type": "assistant", "message": {"content": [{"type": "text", "text": f"answer {f} {i}"}]}} for i in range(40)]
        (tmp_path / "in" / f"{f}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in said))
    scored = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        scored.add(1)
        return n

    monkeypatch.setattr(daemon, "score", lambda *a: whole_score(*a).withColumn("score", counted("score")))
    paths = {"watch_paths": [str(tmp_path / "in")], "watch_debounce_ms": 0, "validation_log": str(tmp_path / "log"), "corrections_path": str(tmp_path / "ledger"), "patterns_path": str(tmp_path / "rules")}
    spec = with_changes(default_spec(), {f"daemon.{k}": v for k, v in paths.items()})
    daemon.Daemon(spark, spec, str(tmp_path / "state")).start(once=True).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == scored.value == 320
    assert len([p for p in (tmp_path / "log").glob("part-*.json") if p.stat().st_size]) > 1
    assert not list((tmp_path / "state").glob("work/*"))
