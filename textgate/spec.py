"""The configuration: a TOML file, read on the driver. Its values become literals of Column expressions."""

from __future__ import annotations

import copy
import os
import tomllib
from pathlib import Path
from typing import Any

DEFAULT = Path(__file__).with_name("default_spec.toml")
# Keys that a file must have, by section; unknown keys are ignored.
REQUIRED = {
    "daemon": ["watch_paths", "watch_debounce_ms", "validation_log", "corrections_path", "patterns_path"],
    "scoring": ["passing_score", "max_deductions"],
    "filters": ["floate", "badverbs"],
    "sycophancy": ["deduction", "opener_patterns", "correction_exemptions"],
    "insight_bow": ["deduction", "scan_region", "patterns"],
    "filler": ["deduction_per_phrase", "max_deduction", "phrases"],
    "rhythm": ["bullet_explain", "parallel_construction", "triple_beat"],
    "lexical": ["verb_monotony_threshold", "deduction_per_monotone", "max_deduction", "modal_verbs"],
    "repetition": ["min_phrase_length", "lookback_turns", "deduction_per_repeat", "max_deduction", "max_reported"],
    "context_time": ["deduction_per_issue", "commute_hours", "commute_max_paragraphs_before_action", "office_hours", "office_max_chars"],
    "layers": ["deduction_per_issue", "architect", "adversarial"],
    "rhetorical_crutch": ["deduction", "patterns"],
    "punctuation": ["em_dash", "horizontal_rule"],
    "tells": ["opening", "closing"],
    "violations": [],
    "corrections": ["promotion_threshold", "aggregation_window_days", "auto_promote", "context_template"],
}


class SpecError(ValueError):
    pass


class Section(dict):
    """A TOML table whose keys are attributes too."""

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise SpecError(f"the configuration lacks {name}") from None


def _sections(value: Any) -> Any:
    return Section({k: _sections(v) for k, v in value.items()}) if isinstance(value, dict) else value


def expand_home(path: str) -> str:
    """Only a leading `~/`, and only if HOME is set."""
    home = os.environ.get("HOME")
    return os.path.join(home, path[2:]) if path.startswith("~/") and home else path


def default_spec() -> Section:
    return _sections(tomllib.loads(DEFAULT.read_text("utf-8")))


def parse_spec(text: str) -> Section:
    try:
        spec = _sections(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise SpecError(str(e)) from e
    for section, keys in REQUIRED.items():
        if section not in spec:
            raise SpecError(f"the configuration lacks [{section}]")
        for k in keys:
            if k not in spec[section]:
                raise SpecError(f"the configuration lacks {section}.{k}")
    spec["policy_pack"] = Section({**default_spec()["policy_pack"], **spec.get("policy_pack", {})})
    spec.filters.floate.setdefault("domain_exceptions", [])
    spec.violations.setdefault("active", [])
    for rule in spec.rhythm.values():
        rule.setdefault("multiline", False)
    return spec


def load_spec(path: str | None = None) -> Section:
    """The file at path, or the default. SpecError if it can't be read or lacks something."""
    if path is None:
        return default_spec()
    try:
        return parse_spec(Path(expand_home(path)).read_text("utf-8"))
    except (OSError, UnicodeDecodeError) as e:
        raise SpecError(f"{path}: {e}") from e


def with_changes(spec: Section, changes: dict[str, Any]) -> Section:
    """A copy with values at dotted keys replaced."""
    out = copy.deepcopy(spec)
    for key, value in changes.items():
        *path, last = key.split(".")
        at = out
        for p in path:
            at = at[p]
        at[last] = _sections(value)
    return out
