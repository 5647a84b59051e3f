"""A streaming source of what is appended to transcripts. Files must be on a path that driver and executors both see.

JSONL: a row for each line, read from byte offsets; it waits for line feeds and begins anew when a file was truncated or
replaced. Markdown: a row for all that is behind the offset, if the file is UTF-8; the offset then is the file's length, so
a file that shrank is read again from there on only."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


SUFFIXES = (".jsonl", ".md")


def _is_markdown(file: str) -> bool:
    return file.endswith(".md")


def _is_utf8(path: str) -> bool:
    with open(path, "rb") as f:
        try:
            f.read().decode("utf-8")
        except UnicodeDecodeError:
            return False
    return True


class Piece(InputPartition):
    def __init__(self, file: str, start: int, end: int, generation: int) -> None:
        self.file, self.start, self.end, self.generation = file, start, end, generation


def _last_line_end(path: str, start: int, size: int) -> int:
    """Where the last whole line between start and size ends."""
    with open(path, "rb") as f:
        end = size
        while end > start:
            begin = max(start, end - 65536)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["path"].split(",")
        self.debounce_s = float(options.get("debounce_ms", 0)) / 1000

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> Iterator[str]:
        for p in map(Path, self.paths):
            if p.is_dir():
                yield from sorted(str(f) for f in p.rglob("*") if f.suffix in SUFFIXES and f.is_file())
            elif p.suffix in SUFFIXES and p.is_file():
                yield str(p)

    def latestOffset(self) -> dict:
        known = dict(getattr(self, "_last", {}))
        out = dict(known)
        for f in self._files():
            try:
                s = os.stat(f)
                was = known.get(f)
                if _is_markdown(f):
                    if time.time() - s.st_mtime >= self.debounce_s and (was is None or s.st_size != was["at"]) and _is_utf8(f):
                        out[f] = {"at": s.st_size, "ino": [s.st_dev, s.st_ino], "generation": 0}
                    continue
                fresh = was is None or was["ino"] != [s.st_dev, s.st_ino] or s.st_size < was["at"]
                if time.time() - s.st_mtime < self.debounce_s:
                    continue
                start = 0 if fresh else was["at"]
                out[f] = {"at": _last_line_end(f, start, s.st_size), "ino": [s.st_dev, s.st_ino], "generation": (was["generation"] + 1 if was else 0) if fresh else was["generation"]}
            except OSError:
                continue
        self._last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self._last = {**start, **getattr(self, "_last", {})}
        out = []
        for f, e in end.items():
            s = start.get(f)
            begin = s["at"] if s and s["generation"] == e["generation"] else 0
            if e["at"] > begin:
                out.append(Piece(f, begin, e["at"], e["generation"]))
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        with open(piece.file, "rb") as f:
            f.seek(piece.start)
            at = piece.start
            if _is_markdown(piece.file):
                yield piece.file, piece.generation, at, f.read(piece.end - at).decode("utf-8", "replace")
                return
            while at < piece.end:
                line = f.readline()
                if not line:
                    return
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text.strip():
                    yield piece.file, piece.generation, at, text
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """format("transcript_tail").option("path", "a,b").option("debounce_ms", "500")"""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return "file string, generation long, line_no long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
