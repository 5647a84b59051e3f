"""The scoring stream: tails transcripts, scores each micro-batch, appends to log and ledger, promotes rules.

Batch and stream share one parser: what is known of a file behind its last line (dialect, session, folder, prompt) stands as
one row ahead of the file's next lines. That state and the last responses are tables in the checkpoint folder, one for each
micro-batch, written by Spark; a batch reads those of the last batch before it, so a batch that is run again after a
failure, or after a restart, starts from the same state. Rules and configuration are read anew for each batch; promotions
act from the next batch on. The checkpoint gives at-least-once.

Scoring takes milliseconds a response, so it is dealt out to all tasks, and done once for each batch: what was parsed and
what was scored are tables in the checkpoint folder while the batch lasts, since Spark doesn't find them again in its cache.

history: "all" keeps one history of responses over everything, as one sequential reader has it; "file" keeps one for each
file, and deals out a batch by file where the kept responses are too large to be broadcast."""

from __future__ import annotations

import datetime
import signal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.operators.corrections import any_due, candidates, fan_out
from textgate.operators.exchanges import with_prior_by_block
from textgate.operators.score import RULES, log_record, score
from textgate.sources.ledger import append_json, read_ledger, read_rules, write_rules
from textgate.sources.tail import TailSource
from textgate.sources.transcripts import STATE, exchanges_of, parse_markdown, state_of, walked
from textgate.spec import Section, SpecError, expand_home, load_spec

KEPT_STATE = f"{STATE}, generation long"
RECENT = "file string, recent array<string>"
WORK = "work"  # the folder of the tables that last as long as their batch


class Daemon:
    def __init__(self, spark: SparkSession, spec: Section | str, checkpoint: str, as_of=None, history: str = "all") -> None:
        if history not in ("all", "file"):
            raise ValueError(f"history: {history}")
        self.spark, self.checkpoint, self.as_of, self.history = spark, checkpoint.rstrip("/"), as_of, history
        self.path = spec if isinstance(spec, str) else None
        self.spec = load_spec(spec) if isinstance(spec, str) else spec
        self.modified = self._mtime()
        self.asked = False
        spark.dataSource.register(TailSource)

    def _mtime(self) -> float | None:
        try:
            return Path(expand_home(self.path)).stat().st_mtime if self.path else None
        except OSError:
            return None

    def reload_on_signal(self) -> None:
        """SIGHUP makes the next batch read the configuration, changed or not."""
        signal.signal(signal.SIGHUP, lambda *_: setattr(self, "asked", True))

    def reload(self) -> None:
        """Reads a changed configuration; one that can't be read leaves the old one, and is tried again."""
        now = self._mtime()
        if now is not None and (self.asked or now != self.modified):
            self.asked = False
            try:
                self.spec = load_spec(self.path)
                self.modified = now
            except SpecError as e:
                print(f"configuration kept: {e}")

    def lines(self) -> DataFrame:
        paths = ",".join(map(expand_home, self.spec.daemon.watch_paths))
        return self.spark.readStream.format("transcript_tail").option("path", paths).option("debounce_ms", self.spec.daemon.watch_debounce_ms).load()

    def now(self) -> datetime.datetime:
        return self.as_of or datetime.datetime.now(datetime.UTC)

    def promote(self) -> list[dict]:
        """One aggregation over the ledger; new rules are added to the rules file."""
        c = self.spec.corrections
        if not c.auto_promote:
            return []
        try:
            ledger = read_ledger(self.spark, self.spec.daemon.corrections_path)
            rules = read_rules(self.spec.daemon.patterns_path)
            known = self.spark.createDataFrame([tuple(r[k] for k in ("content_class", "type", "pattern", "action", "deduction", "promoted_date", "occurrence_count")) for r in rules], RULES)
            found = [r.asDict() for r in candidates(ledger, known, F.lit(self.now()), self.spec).orderBy("content_class", "type", "pattern").collect()]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        if found:
            write_rules(rules + found, self.spec.daemon.patterns_path, self.now().isoformat())
        return found

    def _batches(self, name: str) -> dict[int, str]:
        """The written tables of that name by batch, in any file system that Spark can reach."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}/{name}")
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(root):
            return {}
        found = [x.getPath() for x in fs.listStatus(root)]
        done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {int(p.getName().split("-")[1]): p.toString() for p in done}

    def _kept(self, name: str, schema: str, batch_id: int) -> DataFrame:
        before = {k: path for k, path in self._batches(name).items() if k < batch_id}
        return self.spark.read.schema(schema).parquet(before[max(before)]) if before else self.spark.createDataFrame([], schema)

    def _keep(self, name: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.checkpoint}/{name}/batch-{batch_id}")
        for k, old in self._batches(name).items():
            if k < batch_id - 1:
                self._delete(old)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def _written(self, name: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """rows as a table of this batch alone; process deletes it."""
        where = f"{self.checkpoint}/{WORK}/batch-{batch_id}/{name}"
        rows.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(rows.schema).parquet(where)

    def _with_history(self, found: DataFrame, recent: DataFrame, lookback: int) -> DataFrame:
        """Adds prior: the last responses, of this batch and of those before it."""
        rows = with_prior_by_block(found, lookback, "file", "line_no", across=self.history == "all")
        if self.history == "all":
            last = recent.first()  # one row of at most `lookback` responses
            ahead = F.array(*map(F.lit, last["recent"])) if last and last["recent"] else F.array().cast("array<string>")
            rows = rows.withColumn("recent", ahead)
        else:
            rows = rows.join(recent, "file", "left").withColumn("recent", F.coalesce("recent", F.array().cast("array<string>")))
        return rows.withColumn("prior", _last(F.concat("recent", "prior"), lookback)).drop("recent")

    def _recent(self, found: DataFrame, recent: DataFrame, lookback: int) -> DataFrame:
        """The last responses behind this batch."""
        after = F.max_by(F.concat("prior", F.array("response")), F.struct("file", "line_no"))
        if self.history == "all":
            new = found.agg(after.alias("recent")).filter("recent is not null").select(F.lit("").alias("file"), "recent")
            new = recent if new.isEmpty() else new
        else:
            new = found.groupBy("file").agg(after.alias("recent"))
            new = new.unionByName(recent.join(new, "file", "left_anti"))
        return new.select("file", _last(F.col("recent"), lookback).alias("recent"))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.reload()
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                self._process(batch, batch_id)
        finally:
            batch.unpersist()
            self._delete(f"{self.checkpoint}/{WORK}/batch-{batch_id}")

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        lookback = max(1, min(self.spec.repetition.lookback_turns, 20))
        kept, recent = self._kept("parser-state", KEPT_STATE, batch_id), self._kept("recent", RECENT, batch_id)
        is_markdown = F.endswith("file", F.lit(".md"))
        jsonl = batch.filter(~is_markdown)
        # A file that was truncated or replaced has a new generation, and begins without state.
        now = jsonl.groupBy("file").agg(F.max("generation").alias("generation"))
        rows = self._written("parsed", walked(jsonl.select("file", "line_no", "line"), kept.join(now, ["file", "generation"]).drop("generation")), batch_id)
        markdown = parse_markdown(batch.filter(is_markdown).select("file", F.col("line").alias("text")))
        found = exchanges_of(rows).unionByName(markdown).withColumn("hour", F.hour(F.lit(self.now())))
        found = self._with_history(found, recent, lookback)
        scored = score(found, self.spec, read_rules(self.spec.daemon.patterns_path)).select("session_id", "source", "class", "response", "response_bytes", "issues", "score")
        scored = self._written("scored", scored, batch_id)
        append_json(log_record(scored), self.spec.daemon.validation_log)
        ledger = fan_out(scored, self.spec, ["session_id", "source"])
        stamp = F.lit(self.now().isoformat()).alias("ts")
        written = ledger.select(stamp, "type", "pattern", F.col("session_id").alias("session"), "score", "source", "context", "content_class")
        append_json(written, self.spec.daemon.corrections_path)
        if self.spec.corrections.auto_promote and not written.isEmpty() and any_due(read_ledger(self.spark, self.spec.daemon.corrections_path), written, F.lit(self.now()), self.spec):
            self.promote()
        state = state_of(rows).join(now, "file").unionByName(kept.join(now, "file", "left_anti"))
        self._keep("parser-state", state, batch_id)
        self._keep("recent", self._recent(found, recent, lookback), batch_id)

    def start(self, once: bool = False):
        self.promote()
        writer = self.lines().writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.checkpoint}/stream")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def _last(items, n: int):
    return F.reverse(F.slice(F.reverse(items), 1, n))
