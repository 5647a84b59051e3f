import datetime
import json

from textgate.operators import corrections
from textgate.operators.exchanges import pair, with_prior
from textgate.plans import queries as Q
from textgate.sources.ledger import append_json, read_ledger, read_rules, write_rules
from textgate.sources.transcripts import parse_jsonl, parse_markdown, read_jsonl, read_markdown
from textgate.spec import default_spec, with_changes


def parsed(spark, files):
    rows = [(f, i, json.dumps(x) if isinstance(x, dict) else x) for f, lines in files.items() for i, x in enumerate(lines)]
    out = parse_jsonl(spark.createDataFrame(rows, "file string, line_no long, line string")).orderBy("file", "line_no")
    return [(r.file, r.source, r.session_id, r.cwd, r.prompt, r.response) for r in out.collect()]


def said(kind, text, **more):
    return {"type": kind, "message": {"content": text if isinstance(text, str) and kind != "assistant" else [{"type": "text", "text": text}]}, **more}


def test_message_dialect(spark):
    tool = {"type": "user", "message": {"content": [{"type": "tool_result", "content": "x"}]}}
    got = parsed(
        spark,
        {
            "a": ["junk", {"type": "other"}, said("user", "p1", cwd="/a"), said("assistant", "r1", sessionId="s1"), tool, said("assistant", "r2")],
            "b": [said("user", "p1", sessionId="s1", cwd="/b"), said("assistant", "r1", sessionId="s2"), {"type": "assistant", "message": {"content": "text"}}, said("assistant", "")],
        },
    )
    m = "message-jsonl"
    assert got == [("a", m, "s1", "/a", "p1", "r1"), ("a", m, "s1", "/a", "p1", "r2"), ("b", m, "s2", "", "", "r1"), ("b", m, "s2", "", "", "")]


def test_responses_dialect(spark):
    item = lambda role, text: {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}}
    meta = {"type": "session_meta", "payload": {"id": "native", "cwd": "/w"}}
    got = parsed(spark, {"x/run-019ab-0190.jsonl": [item("user", "p"), item("assistant", "r"), item("system", "s")], "y.jsonl": [meta, item("user", "p"), item("assistant", "r"), said("assistant", "no")]})
    assert got == [("x/run-019ab-0190.jsonl", "responses-jsonl", "0190", "", "p", "r"), ("y.jsonl", "responses-jsonl", "native", "/w", "p", "r")]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.jsonl").write_text(json.dumps(said("user", "p")) + "\r\n" + json.dumps(said("assistant", "r")) + "\n" + json.dumps(said("assistant", "unfinished")))
    (tmp_path / "b.md").write_text("**User:** Ask\nmore\n---\n**Assistant:** Answer\n\nend\n---\n**Assistant:** Again\n")
    assert [(r.prompt, r.response) for r in read_jsonl(spark, str(tmp_path)).collect()] == [("p", "r")]
    got = read_markdown(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.prompt, r.response) for r in got] == [("Ask\nmore", "Answer\n\nend"), ("Ask\nmore", "Again")]
    assert parse_markdown(spark.createDataFrame([("f", "no marks")], "file string, text string")).count() == 0


def test_pairing_and_history(spark):
    turns = spark.createDataFrame([(1, 0, "user", "p"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (2, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    out = with_prior(pair(turns), 5, [], ["conv_id", "turn"]).orderBy("conv_id", "turn").collect()
    assert [(r.prompt, r.response, r.prior) for r in out] == [("p", "a", []), ("p", "b", ["a"]), ("", "c", ["a", "b"])]


def test_history_drops_the_oldest(spark):
    turns = spark.createDataFrame([(1, i, "assistant", str(i)) for i in range(35)], "conv_id long, turn long, role string, text string")
    out = {r.turn: r.prior for r in with_prior(pair(turns), 20, [], ["conv_id", "turn"]).collect()}
    kept: list[str] = []
    for i in range(35):
        assert out[i] == kept[-20:]
        kept.append(str(i))
        if len(kept) > 20:
            kept = kept[10:]


def test_ledger_and_rules(spark, tmp_path):
    rows = [{"ts": f"2026-01-0{d}T00:00:00Z", "type": "t", "pattern": "p", "session": "s", "score": 1, "source": "x", "context": "c"} for d in (1, 2, 3)]
    (tmp_path / "l.jsonl").write_text("\n".join([*map(json.dumps, rows), "junk", '{"type": "t"}', json.dumps(rows[0] | {"ts": "2026-01-04"})]) + "\n")
    ledger = read_ledger(spark, str(tmp_path / "l.jsonl"))
    from pyspark.sql import functions as F

    as_of = F.lit(datetime.datetime(2026, 2, 1, tzinfo=datetime.UTC))
    assert [(r.content_class, r.occurrence_count) for r in corrections.counts(ledger, as_of, 30).collect()] == [("generic", 2)]
    spec = with_changes(default_spec(), {"corrections.promotion_threshold": 2})
    none = spark.createDataFrame([], "content_class string, type string, pattern string")
    assert corrections.candidates(ledger, none, as_of, spec).count() == 1
    assert corrections.any_due(ledger, ledger, as_of, spec)
    rules = [{"content_class": "generic", "type": "t", "pattern": "p", "action": "reject", "deduction": 5, "promoted_date": "2026-02-01", "occurrence_count": 2}]
    write_rules(rules, str(tmp_path / "r.json"), "now")
    assert read_rules(str(tmp_path / "r.json")) == rules
    assert read_rules(str(tmp_path / "none.json")) == []
    append_json(ledger.drop("at"), str(tmp_path / "out"))
    assert read_ledger(spark, str(tmp_path / "out")).count() == 4


def test_fixpoint_equals_a_sequential_reader(spark):
    spec = with_changes(default_spec(), {"corrections.promotion_threshold": 2, "scoring.passing_score": 98})
    texts = ["robust", "fine", "robust epic", "epic", "robust", "fine"]
    t0 = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(i, t0 + datetime.timedelta(hours=i), "", t) for i, t in enumerate(texts)], "seq long, ts timestamp, prompt string, response string")
    scored, rules = corrections.promotion_fixpoint(rows, spec)
    assert [r.score for r in scored.orderBy("seq").collect()] == [97, 100, 94, 97, 0, 100]
    assert [(r["pattern"], r["after"]) for r in rules] == [("word:robust", 2), ("word:epic", 3)]


def test_stream(spark):
    log = Q.stream_tail_score(spark, "/root/testdata/sf0.001")
    assert log.count() == pair(Q.conversations(spark, "/root/testdata/sf0.001")).count()
