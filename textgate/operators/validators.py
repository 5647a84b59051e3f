"""The validators. Each takes the columns of `prepared` and its part of the configuration, and gives an ordered array of
issues. All are built-in expressions: no shuffle, no Python on the executors.

Columns: response, low (lowered), prompt, low_prompt, words (their number), tokens (lowered), class, hour, prior (array, oldest
first). Null texts are empty ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgate.functions import text as T
from textgate.spec import Section

# Words that make a first paragraph actionable, as substrings.
ACTIONS = ["don't", "do", "file", "wait", "hold", "send", "ignore", "respond", "stop", "start", "call", "yes", "no", "skip", "proceed"]
C = F.col


def prepared(df: DataFrame) -> DataFrame:
    """Adds what several validators share; df needs response, prompt, class, hour and prior."""
    texts = df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("response", "prompt")})
    return texts.withColumns(
        {"low": F.lower("response"), "low_prompt": F.lower("prompt"), "words": F.greatest(F.lit(1), T.word_count(C("response"))), "tokens": T.tokens(F.lower("response"))}
    )


def floate_words(s: Section) -> Column:
    cfg = s.filters.floate
    left_out = set(cfg.domain_exceptions)
    lexicon = T.strings([w for w in cfg.words if w not in left_out])
    found = F.array_sort(F.array_intersect(F.array_distinct(F.split("low", r"[^\p{IsAlphabetic}\p{N}-]+")), lexicon))
    return T.capped(F.slice(found, 1, 5), "FLOATE", lambda w: F.concat(F.lit("word:"), w), cfg.deduction_per_hit, cfg.max_deduction)


def floate_phrases(s: Section) -> Column:
    """Non-overlapping phrases, of those that are there the one that ends first; in order of their first place."""
    cfg = s.filters.floate
    phrases = [p for p in cfg.phrases if p]
    if not phrases:
        return T.none()
    used = F.aggregate(floate_words(s), F.lit(0), lambda acc, x: acc + x["deduction"])
    return T.let(
        used,
        lambda u: F.when(
            u < cfg.max_deduction,
            T.capped(F.slice(_phrases_in(C("low"), phrases), 1, 5), "FLOATE", lambda p: F.concat(F.lit("phrase:"), p), cfg.deduction_per_hit, F.lit(cfg.max_deduction) - u),
        ).otherwise(T.none()),
    )


def _phrases_in(low: Column, phrases: list[str]) -> Column:
    """Distinct phrases in their own spelling."""
    by_low: dict[str, str] = {}
    for p in phrases:
        by_low.setdefault(p.lower(), p)
    # A phrase that holds another one inside, not at its end, is never reached: the inner one ends first. One that holds another at
    # its end ends with it, and the one that begins first counts. So the first branch that matches at the leftmost end is the one.
    reached = [p for p in by_low if not any(q in p[:-1] for q in by_low if q != p)]
    order = sorted(reached, key=len, reverse=True)
    spelled = F.create_map(*(F.lit(x) for p in order for x in (p, by_low[p])))
    return F.transform(
        F.array_distinct(F.regexp_extract_all(low, F.lit("(?iu)(" + "|".join(r"\Q" + p + r"\E" for p in order) + ")"), 1)),
        lambda p: F.coalesce(F.try_element_at(spelled, F.lower(p)), p),
    )


def badverbs(s: Section) -> Column:
    cfg = s.filters.badverbs
    # Only whole words of \w+ly count, whatever else the list holds.
    words = [w for w in dict.fromkeys(cfg.words) if re.fullmatch(r"\w+ly", w)]
    if not words:
        return T.none()
    hits = F.regexp_extract_all("low", F.lit(r"(?U)\b(?:" + "|".join(words) + r")\b"), 0)

    def found(h: Column) -> Column:
        density = F.size(h) / (C("words") / 500.0)
        detail = lambda d: F.concat(F.size(h).cast("string"), F.lit(" found ("), T.one_decimal(d), F.lit(f" per 500 words, threshold {cfg.threshold_per_500_words})"))
        mild = F.transform(F.slice(h, 1, 3), lambda w: T.issue("badverb", w, cfg.deduction_mild))
        dense = lambda d: F.array(T.issue("badverbs", detail(d), cfg.deduction_over_threshold))
        return F.when(F.size(h) == 0, T.none()).otherwise(T.let(density, lambda d: F.when(d > float(cfg.threshold_per_500_words), dense(d)).otherwise(mild)))

    return T.let(hits, found)


def sycophancy(s: Section) -> Column:
    cfg = s.sycophancy
    line = F.lower(T.first_line(C("response")))
    opens = lambda x: (x != "") & T.any_match(x, T.patterns(cfg.opener_patterns, "i")) & ~T.has_any(x, cfg.correction_exemptions)
    return T.let(line, lambda x: T.one_if(opens(x), T.issue("sycophancy", "response opens with agreement/praise", cfg.deduction)))


def insight_bow(s: Section) -> Column:
    cfg = s.insight_bow
    tail = F.lower(T.byte_tail(C("response"), T.tail_size(cfg.scan_region, 500)))
    return T.let(tail, lambda x: T.one_if(T.any_match(x, T.patterns(cfg.patterns, "i")), T.issue("insight_bow", "neat conclusion wrapping the thread", cfg.deduction)))


def filler(s: Section) -> Column:
    cfg = s.filler
    found = F.filter(T.strings(cfg.phrases), lambda p: F.contains(C("low"), F.lower(p)))
    return T.capped(found, "filler", lambda p: F.concat(F.lit("'"), p, F.lit("'")), cfg.deduction_per_phrase, cfg.max_deduction)


def _rhythm(cfg: Section, category: str, what: str) -> Column:
    pattern = T.java_pattern(cfg.pattern, "m" if cfg.get("multiline") else "")
    if not T.usable(pattern):
        raise ValueError(f"{category}: not a pattern: {cfg.pattern}")
    n = F.regexp_count("response", F.lit(pattern))
    return T.let(n, lambda n: T.one_if(n >= cfg.threshold, T.issue(category, F.concat(n.cast("string"), F.lit(f" {what}")), cfg.deduction)))


def bullet_rhythm(s: Section) -> Column:
    return _rhythm(s.rhythm.bullet_explain, "bullet_rhythm", "bullet-then-explanation patterns")


def parallel_construction(s: Section) -> Column:
    return _rhythm(s.rhythm.parallel_construction, "parallel_construction", "parallel sentence groups")


def triple_beat(s: Section) -> Column:
    return _rhythm(s.rhythm.triple_beat, "triple_beat", "triple-beat patterns")


def verb_monotony(s: Section) -> Column:
    """Ties of the count go by the verb."""
    cfg = s.lexical
    verbs = T.strings(sorted(set(cfg.modal_verbs)))
    hits = F.filter(F.split("low", r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: F.array_contains(verbs, x))

    def found(h: Column) -> Column:
        counts = F.transform(F.array_distinct(h), lambda v: F.struct((-F.size(F.filter(h, lambda x: x == v))).alias("n"), v.alias("v")))
        often = F.filter(counts, lambda c: c["n"] <= -cfg.verb_monotony_threshold)
        return T.capped(
            F.slice(F.array_sort(often), 1, 3),
            "verb_monotony",
            lambda c: F.concat(F.lit("'"), c["v"], F.lit("' appears "), (-c["n"]).cast("string"), F.lit("x")),
            cfg.deduction_per_monotone,
            cfg.max_deduction,
        )

    return T.let(hits, found)


def _neighbours(words: Column) -> Column:
    """Each word with the next one."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y))


def repetition(s: Section) -> Column:
    """A shingle inside an earlier text has its two middle words next to each other there as whole words, so only shingles
    with such a pair are searched for in the texts."""
    cfg = s.repetition
    w = C("tokens")
    prior = F.transform(F.slice(F.reverse("prior"), 1, cfg.lookback_turns), lambda p: F.lower(p)) if cfg.lookback_turns else F.array().cast("array<string>")

    def found(v: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(w) - 3), lambda i: F.array_contains(v["pairs"], F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))
        shingles = F.transform(places, lambda i: F.regexp_replace(F.array_join(F.slice(w, i, F.lit(4)), " "), r"[.,!?;:]+\z", ""))
        return F.filter(F.array_distinct(shingles), lambda x: (F.octet_length(x) >= cfg.min_phrase_length) & F.exists(v["prior"], lambda p: F.contains(p, x)))

    def pairs(p: Column) -> Column:
        common = F.array_intersect(_neighbours(w), F.flatten(F.transform(p, lambda t: _neighbours(T.tokens(t)))))
        return F.struct(p.alias("prior"), common.alias("pairs"))

    n = F.when((F.size("prior") == 0) | (F.size(w) < 4), 0).otherwise(T.let(T.let(prior, pairs), lambda v: F.least(F.size(found(v)), F.lit(cfg.max_reported))))
    return T.let(
        n,
        lambda n: T.one_if(
            n > 0, T.issue("repetition", F.concat(n.cast("string"), F.lit(" phrases repeated from prior turns")), F.least(n * cfg.deduction_per_repeat, F.lit(cfg.max_deduction)))
        ),
    )


def context_time(s: Section) -> Column:
    cfg = s.context_time
    paragraphs = F.filter(F.transform(F.split("response", "\n\n"), T.trim), lambda p: p != "")
    commute = F.lit(False)
    for r in cfg.commute_hours:
        if len(r) == 2:
            commute = commute | ((C("hour") >= r[0]) & (C("hour") < r[1]))
    first = F.lower(F.coalesce(F.get(paragraphs, F.lit(0)), F.lit("")))
    buried = commute & (F.size(paragraphs) > cfg.commute_max_paragraphs_before_action + 2) & ~T.has_any(first, ACTIONS)
    size = F.octet_length("response")
    office = F.lit(False)
    if len(cfg.office_hours) == 2:
        office = (C("hour") >= cfg.office_hours[0]) & (C("hour") < cfg.office_hours[1]) & (size > cfg.office_max_chars)
    return F.concat(
        T.one_if(buried, T.issue("context_time", "commute: actionable answer buried past first paragraph", cfg.deduction_per_issue)),
        T.one_if(office, T.issue("context_time", F.concat(F.lit("office_hours: response "), size.cast("string"), F.lit(f" chars (max {cfg.office_max_chars})")), cfg.deduction_per_issue)),
    )


def policy_pack(s: Section) -> Column:
    p = s.policy_pack
    if not p.enabled:
        return T.none()
    text, low, prompt, low_prompt = C("response"), C("low"), C("prompt"), C("low_prompt")
    when = lambda condition, detail, cost: T.one_if(condition, T.issue("policy_pack", detail, cost))
    literals = F.transform(
        F.filter(T.strings([x for x in p.blocked_literals if x]), lambda x: F.contains(low, F.lower(x))),
        lambda x: T.issue("policy_pack", F.concat(F.lit("blocked_literal:"), x), p.deduction_per_issue),
    )
    asked = F.concat(
        literals,
        *(when(F.rlike(text, F.lit(j)), f"blocked_regex:{r}", p.deduction_per_issue) for r, j in T.patterns(p.blocked_regexes)),
        when(T.has_any(low_prompt, p.prompt_spoof_signals) & T.has_any(low, p.adoption_tells), "untrusted_prompt_adoption", p.deduction_per_issue),
        when(
            T.has_any(low_prompt, p.outbound_prompt_signals) & T.any_match(text, T.patterns(p.outbound_commitment_regexes)) & ~T.has_any(low, p.outbound_approval_markers),
            "unsafe_outbound_send_commitment",
            p.outbound_deduction,
        ),
        when(T.any_match(text, T.patterns(p.product_claim_regexes)) & ~T.has_any(low, p.official_source_markers), "product_claim_needs_official_source", p.product_claim_deduction),
        when(
            T.any_match(prompt, T.patterns(p.tool_schema_prompt_regexes)) & T.any_match(text, T.patterns(p.tool_schema_response_regexes)) & ~T.has_any(low, p.tool_schema_safe_markers),
            "untrusted_tool_schema_adoption",
            p.tool_schema_deduction,
        ),
    )
    state = f"struct<used:int,kept:{T.ISSUES}>"
    start = F.struct(F.lit(0).alias("used"), T.none().alias("kept")).cast(state)
    return F.aggregate(
        asked,
        start,
        lambda acc, x: F.when(
            acc["used"] < p.max_deduction,
            F.struct(
                (acc["used"] + F.least(x["deduction"], F.lit(p.max_deduction) - acc["used"])).cast("int").alias("used"),
                F.concat(acc["kept"], F.array(T.issue("policy_pack", x["detail"], F.least(x["deduction"], F.lit(p.max_deduction) - acc["used"])))).alias("kept"),
            ).cast(state),
        ).otherwise(acc),
    )["kept"]


def layer_architect(s: Section) -> Column:
    cfg = s.layers.architect
    tell = F.get(F.filter(T.strings(cfg.positioning_tells), lambda t: F.contains(C("low"), F.lower(t))), F.lit(0))
    applies = (C("class") == "technical_build") & T.has_any(C("low_prompt"), cfg.prompt_signals) & tell.isNotNull()
    return T.one_if(applies, T.issue("layer2", F.replace(F.lit(cfg.issue_template), F.lit("{tell}"), tell), s.layers.deduction_per_issue))


def layer_adversarial(s: Section) -> Column:
    cfg = s.layers.adversarial
    applies = (C("class") == "legal") & T.has_any(C("low_prompt"), cfg.prompt_signals) & ~T.has_any(C("low"), cfg.required_markers)
    return T.one_if(applies, T.issue("layer1", cfg.missing_modeling_issue, s.layers.deduction_per_issue))


def rhetorical_crutch(s: Section) -> Column:
    cfg = s.rhetorical_crutch
    hit = T.first_match(C("low"), T.patterns(cfg.patterns, "i"))
    return T.let(hit, lambda h: T.one_if(h.isNotNull(), T.issue("rhetorical_crutch", F.concat(F.lit("matched: "), h), cfg.deduction)))


def em_dash(s: Section) -> Column:
    cfg = s.punctuation.em_dash
    detail = lambda v: F.concat(v["n"].cast("string"), F.lit(" em dashes ("), T.one_decimal(v["d"]), F.lit(f" per 500 words, max {cfg.max_per_500_words})"))
    dense = lambda v: T.one_if((v["n"] > 1) & (v["d"] > float(cfg.max_per_500_words)), T.issue("em_dash", detail(v), cfg.deduction))
    n = F.length("response") - F.length(F.replace("response", F.lit("—"), F.lit("")))
    return T.let(T.let(n, lambda n: F.struct(n.alias("n"), (n / (C("words") / 500.0)).alias("d"))), dense)


def horizontal_rule(s: Section) -> Column:
    cfg = s.punctuation.horizontal_rule
    line = F.array_min(F.filter(F.transform(F.split("response", "\n"), lambda x, i: F.when(x == "---", i + 1)), lambda k: k > 10))
    return T.let(line, lambda line: T.one_if(line.isNotNull(), T.issue("horizontal_rule", F.concat(F.lit("--- divider on line "), line.cast("string"), F.lit(" (only valid in frontmatter)")), cfg.deduction)))


def opening_tell(s: Section) -> Column:
    cfg = s.tells.opening
    hit = T.let(T.first_line(C("response")), lambda x: T.first_match(x, T.patterns(cfg.patterns, "i")))
    return T.let(hit, lambda h: T.one_if(h.isNotNull(), T.issue("opening_tell", F.concat(F.lit("AI opening pattern: "), h), cfg.deduction)))


def closing_tell(s: Section) -> Column:
    cfg = s.tells.closing
    tail = T.byte_tail(C("response"), T.tail_size(cfg.get("scan_region"), 200))
    hit = T.let(tail, lambda x: T.first_match(x, T.patterns(cfg.patterns, "i")))
    return T.let(hit, lambda h: T.one_if(h.isNotNull(), T.issue("closing_tell", F.concat(F.lit("AI closing pattern: "), h), cfg.deduction)))


# In the order in which their issues are listed.
ALL = [
    floate_words, floate_phrases, badverbs, sycophancy, insight_bow, filler, bullet_rhythm, parallel_construction, triple_beat, verb_monotony, repetition,
    context_time, policy_pack, layer_architect, layer_adversarial, rhetorical_crutch, em_dash, horizontal_rule, opening_tell, closing_tell,
]
