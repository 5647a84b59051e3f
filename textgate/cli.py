"""Command line: python -m textgate.cli [--config FILE] [--validate | --daemon] [--prompt P] [--content-class C] [--label L] TEXT..."""

from __future__ import annotations

import sys
from pathlib import Path

from textgate.functions.classify import class_name
from textgate.spec import SpecError, expand_home, load_spec


HOME_FOLDER = "~/.textgate"


def own_config() -> str | None:
    """The user's own configuration, if there is one; else the built-in one counts."""
    path = f"{HOME_FOLDER}/spec.toml"
    return path if Path(expand_home(path)).is_file() else None


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()


def report(spark, spec, text: str, prompt: str, hint: str | None, labels: list[str]) -> str:
    import datetime

    from textgate.operators.score import score
    from textgate.sources.ledger import read_rules

    rows = spark.createDataFrame([(prompt, text, hint, labels, datetime.datetime.now().hour)], "prompt string, response string, content_class_hint string, labels array<string>, hour int")
    r = score(rows, spec, read_rules(spec.daemon.patterns_path)).first()
    out = [f"Class: {r['class']}", f"Score: {r['score']}/100"]
    out += [f"  {i.category}: {i.detail} (-{i.deduction})" for i in r["issues"]] or ["  No issues found."]
    return "\n".join(out + (["", r["correction_context"]] if r["correction_context"] else []))


def main(args: list[str]) -> int:
    values: dict[str, list[str]] = {"--config": [], "--prompt": [], "--content-class": [], "--label": []}
    mode, words, rest = "", [], iter(args)
    for a in rest:
        if a in values:
            values[a].append(next(rest, ""))
        elif a in ("--validate", "--daemon"):
            mode = a
        else:
            words.append(a)
    hint = None
    if values["--content-class"]:
        hint = class_name(values["--content-class"][-1])
        if hint is None:
            print(f"unknown content class: {values['--content-class'][-1]}", file=sys.stderr)
            return 2
    try:
        path = values["--config"][-1] if values["--config"] else own_config()
        spec = load_spec(path)
    except SpecError as e:
        print(e, file=sys.stderr)
        return 1
    if mode == "--validate":
        text = " ".join(words) if words else sys.stdin.read()
        print(report(session(), spec, text, (values["--prompt"] or [""])[-1], hint, values["--label"]))
    elif mode == "--daemon":
        from textgate.streaming.daemon import Daemon

        daemon = Daemon(session(), path or spec, Path(expand_home(f"{HOME_FOLDER}/checkpoint")).absolute().as_uri())
        daemon.reload_on_signal()
        daemon.start().awaitTermination()
    else:
        print(f"textgate: {len(spec.daemon.watch_paths)} watched paths, passing score {spec.scoring.passing_score}. Use --validate or --daemon.")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
