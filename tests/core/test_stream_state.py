import json
import os
import time

import pytest

from textgate import cli
from textgate.operators.score import score
from textgate.sources.tail import TailReader
from textgate.sources.transcripts import parse_jsonl
from textgate.spec import default_spec, with_changes
from textgate.streaming.daemon import Daemon

LOG = "content_class string, issues array<string>, response_chars long, score int, session string, source string"


def said(kind, text, **more):
    return {"type": kind, "message": {"content": [{"type": "text", "text": text}]}, **more}


TOOL = {"type": "user", "message": {"content": [{"type": "tool_result", "content": "x"}]}}
META = {"type": "session_meta", "payload": {"id": "native"}}


def item(role, text):
    return {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "output_text", "text": text}]}}


def transcripts():
    """For each of 60 files the lines of two batches."""
    out = {}
    for i in range(60):
        first = [{"type": "other", "sessionId": "early"}, said("user", "my lawyer", sessionId=f"s{i}"), said("assistant", f"one {i}"), said("user", "debug the python build"), TOOL]
        second = [said("assistant", f"another {'x' * i}")]
        if i % 3 == 1:
            second = [said("assistant", "cleared", sessionId="next"), *second]
        if i % 3 == 2:
            first = [item("user", "my lawyer"), item("assistant", f"one {i}")] + ([META] if i % 2 else [])
            second = [item("assistant", f"two {'y' * i}"), item("user", "a cover letter"), item("assistant", "three")]
        out[f"/t/run-019{i:02d}.jsonl"] = (first, second)
    return out


def daemon(spark, folder):
    spec = with_changes(
        default_spec(), {"daemon.validation_log": f"{folder}/log", "daemon.corrections_path": f"{folder}/ledger", "daemon.patterns_path": f"{folder}/rules.json"}
    )
    return Daemon(spark, spec, f"file://{folder}/state")


def batch(spark, rows):
    return spark.createDataFrame(rows, "file string, generation long, line_no long, line string")


def logged(spark, folder):
    return sorted((r.session, r.source, r.content_class, r.response_chars) for r in spark.read.schema(LOG).json(f"{folder}/log").collect())


def test_two_batches_and_a_restart_equal_one_reading(spark, tmp_path):
    files = transcripts()
    lines = lambda k: [(f, 0, n + 100 * k, json.dumps(x)) for f, parts in files.items() for n, x in enumerate(parts[k])]
    daemon(spark, tmp_path).process(batch(spark, lines(0)), 0)
    daemon(spark, tmp_path).process(batch(spark, lines(1)), 1)
    whole = parse_jsonl(batch(spark, lines(0) + lines(1)))
    # The name of a file without an id counts from the first batch on, whether the id comes later or not.
    want = sorted((r.session_id, r.source, r["class"], r.response_bytes) for r in score(whole, default_spec()).collect())
    got = logged(spark, tmp_path)
    assert len(got) == 60 + 60 + 20 + 20
    assert got == want


def test_a_batch_that_runs_again_starts_from_the_same_state(spark, tmp_path):
    one = batch(spark, [("/a.jsonl", 0, 0, json.dumps(said("user", "my lawyer", sessionId="s"))), ("/a.jsonl", 0, 1, json.dumps(said("assistant", "first")))])
    two = batch(spark, [("/a.jsonl", 0, 2, json.dumps(said("assistant", "second")))])
    new = batch(spark, [("/a.jsonl", 1, 0, json.dumps(said("assistant", "replaced")))])
    d = daemon(spark, tmp_path)
    for k, rows in ((0, one), (1, two), (1, two), (2, new)):
        d.process(rows, k)
    assert logged(spark, tmp_path) == [("", "message-jsonl", "generic", 8), ("s", "message-jsonl", "legal", 5), ("s", "message-jsonl", "legal", 6), ("s", "message-jsonl", "legal", 6)]


@pytest.mark.parametrize("history", ["all", "file"])
def test_history_goes_on_in_the_next_batch(spark, tmp_path, history):
    d = daemon(spark, tmp_path)
    d.history = history
    text = "these four words come again and again"
    d.process(batch(spark, [("/a.jsonl", 0, 0, json.dumps(said("assistant", text)))]), 0)
    d = daemon(spark, tmp_path)
    d.history = history
    d.process(batch(spark, [(f"/{f}.jsonl", 0, 1, json.dumps(said("assistant", f"{text} {f}", sessionId=f))) for f in "ab"]), 1)
    found = {r.session: any("repeated from prior" in i for i in r.issues) for r in spark.read.schema(LOG).json(f"{tmp_path}/log").collect()}
    assert found == {"": False, "a": True, "b": history == "all"}


def test_markdown_in_the_stream(spark, tmp_path):
    d = daemon(spark, tmp_path)
    d.process(batch(spark, [("/a.md", 0, 0, "**User:** my lawyer\n**Assistant:** yes\n---\n"), ("/b.jsonl", 0, 0, "junk")]), 0)
    assert logged(spark, tmp_path) == [("markdown", "markdown", "legal", 3)]


def test_tail_reads_appended_lines_replaced_files_and_markdown(tmp_path):
    a, m, odd = tmp_path / "a.jsonl", tmp_path / "sub" / "m.md", tmp_path / "odd.md"
    m.parent.mkdir()
    a.write_bytes(b'{"a": 1}\r\n\n{"b"')
    m.write_text("**User:** é")
    odd.write_bytes(b"\xff\xfe")
    reader = TailReader({"path": str(tmp_path)})
    read = lambda s, e: [(r[0].rsplit("/", 1)[1], *r[1:]) for p in reader.partitions(s, e) for r in reader.read(p)]
    first = reader.latestOffset()
    assert sorted(read({}, first)) == [("a.jsonl", 0, 0, '{"a": 1}'), ("m.md", 0, 0, "**User:** é")]
    with a.open("ab") as f:
        f.write(b": 2}\n")
    with m.open("a") as f:
        f.write("\n**Assistant:** x")
    second = reader.latestOffset()
    assert sorted(read(first, second)) == [("a.jsonl", 0, 11, '{"b": 2}'), ("m.md", 0, 12, "\n**Assistant:** x")]
    a.write_bytes(b"{}\n")
    m.write_text("**User:** short")
    third = reader.latestOffset()
    assert read(second, third) == [("a.jsonl", 1, 0, "{}")]
    other = tmp_path / "other"
    other.write_bytes(b"{}\n[1]\n")
    os.replace(other, a)
    assert read(third, reader.latestOffset()) == [("a.jsonl", 2, 0, "{}"), ("a.jsonl", 2, 3, "[1]")]


def test_tail_waits_until_a_file_is_quiet(tmp_path):
    a = tmp_path / "a.jsonl"
    a.write_text("{}\n")
    reader = TailReader({"path": str(tmp_path), "debounce_ms": "60000"})
    assert reader.latestOffset() == {}
    os.utime(a, (time.time() - 100, time.time() - 100))
    assert list(reader.latestOffset()) == [str(a)]


def test_reload_keeps_a_configuration_that_can_be_read(spark, tmp_path, monkeypatch):
    from textgate.spec import DEFAULT

    path = tmp_path / "spec.toml"
    path.write_text(DEFAULT.read_text("utf-8"))
    d = Daemon(spark, str(path), f"file://{tmp_path}/state")
    before = d.spec
    path.write_text("broken = [")
    os.utime(path, (1, 1))
    d.reload()
    assert d.spec is before
    path.write_text(DEFAULT.read_text("utf-8").replace("passing_score = 75", "passing_score = 60"))
    os.utime(path, (2, 2))
    d.reload()
    assert d.spec is not before
    kept = d.spec
    d.asked = True
    d.reload()
    assert d.spec is not kept and not d.asked


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setenv("HOME", str(tmp_path))
    assert cli.main(["--validate", "--content-class", "no such"]) == 2
    assert cli.main(["--config", str(tmp_path / "none.toml"), "text"]) == 1
    assert cli.main([]) == 0
    assert "--validate" in capsys.readouterr().out
    assert cli.main(["--validate", "--prompt", "x", "--content-class", "legal", "--label", "a", "Great", "question!"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("Class: legal\nScore: ") and "sycophancy" in out
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO("A plain text."))
    assert cli.main(["--validate"]) == 0
    assert "No issues found." in capsys.readouterr().out
    (tmp_path / ".textgate").mkdir()
    (tmp_path / ".textgate/spec.toml").write_text("broken = [")
    assert cli.main([]) == 1
