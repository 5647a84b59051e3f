"""Text expressions whose results must not depend on the engine's dialect."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "struct<category:string,detail:string,deduction:int>"
ISSUES = f"array<{ISSUE}>"


def java_pattern(pattern: str, flags: str = "") -> str:
    """A pattern with Unicode classes and case, `.` that only excludes line feeds, and `$` only at the text's end.

    Within multi-line patterns `$` stays (it then means before a line feed)."""
    leading = re.match(r"\(\?([a-z]+)\)", pattern)
    if "m" not in flags + (leading[1] if leading else ""):
        out, escaped, in_class = [], False, False
        for c in pattern:
            if not escaped and not in_class and c == "$":
                c = r"\z"
            in_class = not escaped and (c == "[" or in_class and c != "]") or escaped and in_class
            escaped = not escaped and c == "\\"
            out.append(c)
        pattern = "".join(out)
    return f"(?dU{flags}){pattern}"


def usable(pattern: str) -> bool:
    """Whether the JVM compiles it."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is None:
        return True
    try:
        session._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # noqa: BLE001  py4j wraps a PatternSyntaxException
        return False


def patterns(given: list[str], flags: str = "") -> list[tuple[str, str]]:
    """(as given, for the JVM), without such that don't compile."""
    return [(p, j) for p in given if usable(j := java_pattern(p, flags))]


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def first_line(c: Column) -> Column:
    """The first line of the trimmed text, trimmed."""
    return trim(F.substring_index(trim(c), "\n", 1))


def tokens(c: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def byte_tail(c: Column, n: int) -> Column:
    """The last n bytes, from n on backwards to a character's begin."""
    right = F.right(c, F.lit(n))
    kept = F.aggregate(
        F.reverse(F.split(right, "")),
        F.lit(""),
        lambda acc, ch: F.when(F.octet_length(acc) >= n, acc).otherwise(F.concat(ch, acc)),
    )
    return F.when(F.octet_length(right) <= n, right).otherwise(kept)


def tail_size(region: str | None, default: int) -> int:
    found = re.fullmatch(r"tail_(\d+)", region or "")
    return int(found[1]) if found else default


def strings(values: list[str]) -> Column:
    """An array literal, as one SQL text: far fewer calls to the JVM than a literal each."""
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({', '.join(quoted)})") if values else F.array().cast("array<string>")


def has_any(c: Column, needles: list[str]) -> Column:
    """Whether the lowered text contains one of the (lowered) needles; empty needles don't count."""
    kept = [n.lower() for n in needles if n]
    return F.exists(strings(kept), lambda n: F.contains(c, n)) if kept else F.lit(False)


def first_match(c: Column, given: list[tuple[str, str]]) -> Column:
    """The pattern, as given, that is the first to match; or null."""
    return F.coalesce(*(F.when(F.rlike(c, F.lit(j)), F.lit(p)) for p, j in given), F.lit(None).cast("string"))


def any_match(c: Column, given: list[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for _, j in given:
        out = out | F.rlike(c, F.lit(j))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written, and evaluated, once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_decimal(x: Column) -> Column:
    """x >= 0 with one decimal: the nearest to the double's exact value, halves to even.

    20 x is formed with its rounding error (16 x and 4 x are exact), so that a half is known from a near half."""

    def rounded(v: Column) -> Column:
        low, over = v["low"], v["over"]
        tenths = low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)
        return let(tenths, lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")))

    def summed(v: Column) -> Column:
        s, a, b = v["s"], v["a"], v["b"]
        error = let(s - a, lambda bb: (a - (s - bb)) + (b - bb))
        low = F.floor(s / 2)
        return F.struct(low.alias("low"), ((s - (low * 2 + 1)) + error).alias("over"))

    parts = let(x, lambda v: F.struct((v * 16 + v * 4).alias("s"), (v * 16).alias("a"), (v * 4).alias("b")))
    return let(let(parts, summed), rounded)


def issue(category: str, detail: Column | str, deduction: Column | int) -> Column:
    return F.struct(
        F.lit(category).alias("category"),
        (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
        (F.lit(deduction) if isinstance(deduction, int) else deduction).cast("int").alias("deduction"),
    )


def none() -> Column:
    return F.array().cast(ISSUES)


def one_if(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found)).otherwise(none())


def capped(items: Column, category: str, detail, each: int, cap: Column | int) -> Column:
    """An issue for each item while something of the cap is left; the last may cost less."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    costed = F.transform(items, lambda x, i: issue(category, detail(x), F.least(F.lit(each), cap - i * each)))
    return F.filter(costed, lambda x: x["deduction"] > 0) if each else F.when(cap > 0, costed).otherwise(none())
