"""The same results in DuckDB SQL, put together from the configuration. Each text in ISSUES selects conv_id, turn, ord,
category, detail, deduction from e(conv_id, turn, hour, prompt, response, low, low_prompt, words, class, prior)."""

from __future__ import annotations

from textgate.functions.classify import SIGNALS
from textgate.operators.validators import ACTIONS
from textgate.spec import Section


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lst(xs: list[str]) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]::VARCHAR[]"


def any_in(col: str, xs: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(x.lower())})" for x in xs if x) + ")"


def any_rx(col: str, xs: list[str], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {lit(flags + x)})" for x in xs) + ")"


def first_rx(col: str, xs: list[str], flags: str = "") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {lit(flags + x)}) THEN {lit(x)}" for x in xs) + " END"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def one(category: str, detail: str, cost: int, condition: str) -> str:
    return f"SELECT conv_id, turn, 0 AS ord, {lit(category)} AS category, {detail} AS detail, {cost} AS deduction FROM e WHERE {condition}"


def capped(category: str, detail: str, each: int, cap: str, rows: str) -> str:
    """rows selects conv_id, turn, i, x."""
    return f"SELECT conv_id, turn, i AS ord, {lit(category)} AS category, {detail} AS detail, least({each}, {cap} - i * {each}) AS deduction FROM ({rows}) WHERE {cap} - i * {each} > 0"


def unnested(values: str, source: str = "e", extra: str = "") -> str:
    return f"SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS x{extra} FROM (SELECT *, {values} AS l FROM {source})"


def class_sql(col: str = "prompt") -> str:
    low = f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return "CASE " + " ".join(f"WHEN {any_in(low, words)} THEN {lit(name)}" for name, words in SIGNALS.items()) + " ELSE 'generic' END"


FIRST_LINE = trim(f"split_part({trim('response')}, chr(10), 1)")


def issues(s: Section) -> dict[str, str]:
    """SQL of each validator, in the order of validators.ALL."""
    f, b, p = s.filters.floate, s.filters.badverbs, s.policy_pack
    lexicon = [w for w in f.words if w not in set(f.domain_exceptions)]
    floate = rf"list_sort(list_intersect(regexp_split_to_array(low, '[^\p{{L}}\p{{M}}\p{{N}}-]+'), {lst(lexicon)}))[1:5]"
    phrases = "(" + "|".join(f.phrases) + ")"
    found_phrases = (
        f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS i, x, {f.max_deduction} - least({f.max_deduction}, {f.deduction_per_hit} * nw) AS left_over FROM "
        f"(SELECT conv_id, turn, x, nw, min(i) AS i FROM ({unnested(f'regexp_extract_all(low, {lit(phrases)})', f'(SELECT *, len({floate}) AS nw FROM e)', ', nw')}) GROUP BY ALL)"
    )
    hits = rf"list_filter(regexp_extract_all(low, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: list_contains({lst(b.words)}, x))"
    r = s.repetition
    shingles = (
        r"SELECT DISTINCT conv_id, turn, prior, x FROM (SELECT conv_id, turn, prior, unnest(list_transform(range(1, len(w) - 2), lambda i: "
        r"regexp_replace(lower(array_to_string(w[i : i + 3], ' ')), '[.,!?;:]+$', ''))) AS x FROM "
        rf"(SELECT conv_id, turn, prior, list_filter(regexp_split_to_array(response, '\s+'), lambda x: x <> '') AS w FROM e) WHERE len(w) >= 4) WHERE strlen(x) >= {r.min_phrase_length}"
    )
    repeated = f"SELECT conv_id, turn, least(count(*), {r.max_reported}) AS n FROM ({shingles}) WHERE len(list_filter(prior, lambda q: contains(lower(q), x))) > 0 GROUP BY ALL"
    c = s.context_time
    commute = " OR ".join(f"(hour >= {a} AND hour < {z})" for a, z in c.commute_hours)
    paragraphs = f"list_filter(list_transform(string_split(response, chr(10) || chr(10)), lambda q: {trim('q')}), lambda q: q <> '')"
    v = s.lexical
    verbs = (
        rf"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, x) - 1 AS i, x, n FROM (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(low, '[^\p{{L}}\p{{M}}\p{{N}}]+')) AS x FROM e) "
        f"WHERE list_contains({lst(v.modal_verbs)}, x) GROUP BY ALL) WHERE n >= {v.verb_monotony_threshold} QUALIFY i < 3"
    )
    asked = [(f"contains(low, {lit(x.lower())})", f"blocked_literal:{x}", p.deduction_per_issue) for x in p.blocked_literals]
    asked += [(any_rx("response", [x]), f"blocked_regex:{x}", p.deduction_per_issue) for x in p.blocked_regexes]
    asked += [
        (f"{any_in('low_prompt', p.prompt_spoof_signals)} AND {any_in('low', p.adoption_tells)}", "untrusted_prompt_adoption", p.deduction_per_issue),
        (f"{any_in('low_prompt', p.outbound_prompt_signals)} AND {any_rx('response', p.outbound_commitment_regexes)} AND NOT {any_in('low', p.outbound_approval_markers)}", "unsafe_outbound_send_commitment", p.outbound_deduction),
        (f"{any_rx('response', p.product_claim_regexes)} AND NOT {any_in('low', p.official_source_markers)}", "product_claim_needs_official_source", p.product_claim_deduction),
        (f"{any_rx('prompt', p.tool_schema_prompt_regexes)} AND {any_rx('response', p.tool_schema_response_regexes)} AND NOT {any_in('low', p.tool_schema_safe_markers)}", "untrusted_tool_schema_adoption", p.tool_schema_deduction),
    ]
    policy = " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS i, {lit(d)} AS detail, {cost} AS cost FROM e WHERE {cond}" for i, (cond, d, cost) in enumerate(asked))
    arch, adv, em = s.layers.architect, s.layers.adversarial, s.punctuation.em_dash
    tell = f"list_filter({lst(arch.positioning_tells)}, lambda q: contains(low, lower(q)))[1]"
    dashes = "(length(response) - length(replace(response, '—', '')))"
    before, after = arch.issue_template.split("{tell}")
    rule = "list_filter(generate_series(1, len(string_split(response, chr(10)))), lambda k: k > 10 AND string_split(response, chr(10))[k] = '---')[1]"
    tail = lambda n: f"response[-{n} :]"  # noqa: E731  the planted tails are ASCII; byte tails have tests of their own
    letters = lambda x: x.replace(r"\w", r"[\p{L}\p{M}\p{N}_]")
    rhythm = lambda cfg, flags: f"len(regexp_extract_all(response, {lit(flags + (cfg.pattern if chr(92) * 2 in cfg.pattern else letters(cfg.pattern)))}))"
    return {
        "floate_words": capped("FLOATE", "'word:' || x", f.deduction_per_hit, str(f.max_deduction), unnested(floate)),
        "floate_phrases": capped("FLOATE", "'phrase:' || x", f.deduction_per_hit, "left_over", found_phrases),
        "badverbs": f"SELECT conv_id, turn, 0 AS ord, 'badverbs' AS category, len(h) || ' found (' || printf('%.1f', len(h) / (words / 500.0::DOUBLE)) || ' per 500 words, threshold {b.threshold_per_500_words})' AS detail, {b.deduction_over_threshold} AS deduction FROM (SELECT *, {hits} AS h FROM e) WHERE len(h) / (words / 500.0::DOUBLE) > {b.threshold_per_500_words}"
        f" UNION ALL SELECT conv_id, turn, i AS ord, 'badverb' AS category, x AS detail, {b.deduction_mild} AS deduction FROM ({unnested(f'({hits})[1:3]', f'(SELECT * FROM e WHERE len({hits}) / (words / 500.0::DOUBLE) <= {b.threshold_per_500_words})')})",
        "sycophancy": one("sycophancy", "'response opens with agreement/praise'", s.sycophancy.deduction, f"{any_rx('lower(' + FIRST_LINE + ')', s.sycophancy.opener_patterns, '(?i)')} AND NOT {any_in('lower(' + FIRST_LINE + ')', s.sycophancy.correction_exemptions)}"),
        "insight_bow": one("insight_bow", "'neat conclusion wrapping the thread'", s.insight_bow.deduction, any_rx(f"lower({tail(500)})", s.insight_bow.patterns, "(?i)")),
        "filler": capped("filler", "'''' || x || ''''", s.filler.deduction_per_phrase, str(s.filler.max_deduction), unnested(f"list_filter({lst(s.filler.phrases)}, lambda q: contains(low, lower(q)))")),
        "bullet_rhythm": one("bullet_rhythm", f"{rhythm(s.rhythm.bullet_explain, '(?m)')} || ' bullet-then-explanation patterns'", s.rhythm.bullet_explain.deduction, f"{rhythm(s.rhythm.bullet_explain, '(?m)')} >= {s.rhythm.bullet_explain.threshold}"),
        "parallel_construction": one("parallel_construction", f"{rhythm(s.rhythm.parallel_construction, '')} || ' parallel sentence groups'", s.rhythm.parallel_construction.deduction, f"{rhythm(s.rhythm.parallel_construction, '')} >= {s.rhythm.parallel_construction.threshold}"),
        "triple_beat": one("triple_beat", f"{rhythm(s.rhythm.triple_beat, '')} || ' triple-beat patterns'", s.rhythm.triple_beat.deduction, f"{rhythm(s.rhythm.triple_beat, '')} >= {s.rhythm.triple_beat.threshold}"),
        "verb_monotony": capped("verb_monotony", "'''' || x || ''' appears ' || n || 'x'", v.deduction_per_monotone, str(v.max_deduction), verbs),
        "repetition": f"SELECT conv_id, turn, 0 AS ord, 'repetition' AS category, n || ' phrases repeated from prior turns' AS detail, least(n * {r.deduction_per_repeat}, {r.max_deduction}) AS deduction FROM ({repeated})",
        "context_time": one("context_time", "'commute: actionable answer buried past first paragraph'", c.deduction_per_issue, f"({commute}) AND len({paragraphs}) > {c.commute_max_paragraphs_before_action + 2} AND NOT {any_in(f'lower({paragraphs}[1])', ACTIONS)}")
        + " UNION ALL "
        + one("context_time", f"'office_hours: response ' || strlen(response) || ' chars (max {c.office_max_chars})'", c.deduction_per_issue, f"hour >= {c.office_hours[0]} AND hour < {c.office_hours[1]} AND strlen(response) > {c.office_max_chars}"),
        "policy_pack": f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS ord, 'policy_pack' AS category, detail, least(cost, {p.max_deduction} - before) AS deduction FROM (SELECT *, sum(cost) OVER (PARTITION BY conv_id, turn ORDER BY i) - cost AS before FROM ({policy})) WHERE before < {p.max_deduction}",
        "layer_architect": one("layer2", f"{lit(before)} || {tell} || {lit(after)}", s.layers.deduction_per_issue, f"class = 'technical_build' AND {any_in('low_prompt', arch.prompt_signals)} AND {tell} IS NOT NULL"),
        "layer_adversarial": one("layer1", lit(adv.missing_modeling_issue), s.layers.deduction_per_issue, f"class = 'legal' AND {any_in('low_prompt', adv.prompt_signals)} AND NOT {any_in('low', adv.required_markers)}"),
        "rhetorical_crutch": one("rhetorical_crutch", f"'matched: ' || {first_rx('low', s.rhetorical_crutch.patterns, '(?i)')}", s.rhetorical_crutch.deduction, any_rx("low", s.rhetorical_crutch.patterns, "(?i)")),
        "em_dash": one("em_dash", f"{dashes} || ' em dashes (' || printf('%.1f', {dashes} / (words / 500.0::DOUBLE)) || ' per 500 words, max {em.max_per_500_words})'", em.deduction, f"{dashes} > 1 AND {dashes} / (words / 500.0::DOUBLE) > {em.max_per_500_words}"),
        "horizontal_rule": one("horizontal_rule", f"'--- divider on line ' || {rule} || ' (only valid in frontmatter)'", s.punctuation.horizontal_rule.deduction, f"{rule} IS NOT NULL"),
        "opening_tell": one("opening_tell", f"'AI opening pattern: ' || {first_rx(FIRST_LINE, s.tells.opening.patterns, '(?i)')}", s.tells.opening.deduction, any_rx(FIRST_LINE, s.tells.opening.patterns, "(?i)")),
        "closing_tell": one("closing_tell", f"'AI closing pattern: ' || {first_rx(tail(200), s.tells.closing.patterns, '(?i)')}", s.tells.closing.deduction, any_rx(tail(200), s.tells.closing.patterns, "(?i)")),
    }


def turns_sql() -> str:
    return """t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt
  FROM conversations
)"""


def base(plants: list[tuple], lookback: int) -> str:
    rows = ", ".join(f"({i}, {lit(a)}, {lit(b)}, {lit(c)})" for i, (a, b, c) in enumerate(plants))
    return f"""WITH plants(k, pp, rp, rs) AS (VALUES {rows}), {turns_sql()}, x AS (
  SELECT conv_id, turn, (conv_id + turn) % 24 AS hour, pp || coalesce(prompt, '') AS prompt, rp || text || rs AS response
  FROM t JOIN plants ON k = (conv_id * 5 + turn) % {len(plants)} WHERE role = 'assistant'
), e AS (
  SELECT *, lower(response) AS low, lower(prompt) AS low_prompt, greatest(1, len(regexp_extract_all(response, '\\S+'))) AS words, {class_sql()} AS class,
         coalesce(list(response) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING), []) AS prior
  FROM x
)"""


def documents(text: str = "text") -> str:
    return f"""WITH e AS (
  SELECT doc_id AS conv_id, row_number() OVER () AS turn, coalesce({text}, '') AS response, lower(coalesce({text}, '')) AS low,
         greatest(1, len(regexp_extract_all(coalesce({text}, ''), '\\S+'))) AS words FROM documents
)"""


def markdown() -> str:
    return f"""WITH d AS (
  SELECT 'f' || conv_id AS file, turn, conv_id + turn AS nth, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant')
), x AS (
  SELECT file, string_split(string_agg(CASE role WHEN 'user' THEN '**User:** ' ELSE '**Assistant:** ' END
      || CASE WHEN role = 'assistant' AND nth % 6 = 0 THEN '' WHEN role = 'user' AND nth % 7 = 0 THEN ' ' ELSE text END
      || CASE WHEN nth % 3 = 0 THEN chr(10) || '--- end' || chr(10) || 'more of it' || chr(10) || '---' || chr(10) || 'and more' WHEN nth % 5 = 1 THEN chr(10) || 'last words ' ELSE '' END,
    chr(10) ORDER BY turn), chr(10)) AS lines FROM d GROUP BY file
), l AS (
  SELECT file, unnest(range(len(lines))) AS no, unnest(lines) AS line FROM x
), k AS (
  SELECT *, CASE WHEN starts_with(line, '**User:**') THEN 'u' WHEN starts_with(line, '**Assistant:**') THEN 'a' WHEN starts_with(line, '---') THEN 'r' ELSE 'o' END AS kind FROM l
), p AS (
  SELECT *, sum((kind IN ('u', 'a'))::INT) OVER w AS part, sum((kind = 'u')::INT) OVER w AS asked FROM k WINDOW w AS (PARTITION BY file ORDER BY no)
), q AS (
  SELECT *, first_value(kind) OVER w AS opens, sum((kind = 'r')::INT) OVER w AS rules,
         CASE kind WHEN 'u' THEN {trim("substring(line, 10)")} WHEN 'a' THEN {trim("substring(line, 15)")} WHEN 'o' THEN line END AS content
  FROM p WHERE part > 0 WINDOW w AS (PARTITION BY file, part ORDER BY no)
), r AS (
  SELECT file, asked, part, min(no) AS no, max(rules) AS rules, {trim("string_agg(content, chr(10) ORDER BY no) FILTER (WHERE rules = 0)")} AS response
  FROM q WHERE opens = 'a' GROUP BY ALL
), b AS (
  SELECT file, asked, content AS begin FROM q WHERE kind = 'u' AND content <> ''
), m AS (
  SELECT r.file, r.part, {trim("string_agg(q.content, chr(10) ORDER BY q.no)")} AS prompt
  FROM r JOIN b USING (file, asked) JOIN q ON q.file = r.file AND q.asked = r.asked AND q.no < r.no AND NOT (q.opens = 'a' AND q.rules = 0) AND q.content IS NOT NULL GROUP BY ALL
)
SELECT file, no::BIGINT AS line_no, 'markdown' AS source, 'markdown' AS session_id, coalesce(prompt, '') AS prompt, response
FROM r LEFT JOIN m USING (file, part) WHERE response <> '' OR rules > 0"""
