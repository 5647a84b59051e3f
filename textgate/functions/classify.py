"""Classes of exchanges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The signals of each class, in order of priority.
SIGNALS = {
    "legal": ["legal", "lawyer", "attorney", "court", "lawsuit", "litigation", "contract dispute", "opposing counsel", "liability", "settlement", "lease dispute"],
    "career_application": ["career", "job application", "apply for", "resume", "résumé", "cover letter", "interview", "recruiter", "hiring manager", "job search", "candidate"],
    "technical_build": ["build", "implement", "code", "debug", "bug", "deploy", "api", "rust", "typescript", "python", "architecture", "test suite", "database"],
    "content_copy": ["content copy", "copywriting", "headline", "landing page", "article", "blog post", "social post", "email campaign", "content brief", "sales page"],
    "conversational": ["let's talk", "lets talk", "chat with me", "how are you", "talk this through", "brainstorm with me"],
}
# Other names of classes.
NAMES = {name: name for name in [*SIGNALS, "generic"]} | {"": "generic", "career": "career_application", "content": "content_copy", "copy": "content_copy", "technical": "technical_build", "build": "technical_build", "conversation": "conversational"}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def class_name(text: str) -> str | None:
    """A class by its name or another name of it, else None."""
    text = text.strip()
    return NAMES.get("".join(c.lower() if c in UPPER else c for c in text).replace("-", "_"))


def class_of(c: Column) -> Column:
    """The same for a column; null where there is no such class."""
    known = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    return F.try_element_at(known, F.translate(ascii_lower(trimmed), "-", "_"))


def classify(prompt: Column, explicit: Column, labels: Column) -> Column:
    """The first class that is the explicit one or has a signal in the prompt or a label."""
    text = F.concat(F.coalesce(prompt, F.lit("")), F.array_join(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.concat(F.lit("\n"), x)), ""))
    low = ascii_lower(text)
    return F.coalesce(
        *(F.when((explicit == name) | F.rlike(low, F.lit("|".join(map(re.escape, words)))), F.lit(name)) for name, words in SIGNALS.items()),
        F.lit("generic"),
    )
