"""SQL for the same results, for an engine whose regular expressions have ASCII word boundaries."""

from __future__ import annotations

from ..operators.recognizers import PatternRecognizer


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans_sql(source: str, recognizer: PatternRecognizer, verdicts: dict[str, str] | str | None = None) -> str:
    """Rows (id, entity_type, start, end, score) of a recognizer over source (id, text).

    verdicts: a boolean expression over the match v, for all patterns or by pattern; NULL is neutral.
    """
    parts = []
    for number, p in enumerate(recognizer.patterns):
        verdict = verdicts.get(p.name) if isinstance(verdicts, dict) else verdicts
        regex = _quoted(p.regex)
        parts.append(f"""
  SELECT id, {_quoted(recognizer.entity)} AS entity_type, v, CAST(s AS INTEGER) AS start, CAST(s + length(v) AS INTEGER) AS "end", {p.score}::DOUBLE AS base, ({verdict or 'NULL::BOOLEAN'}) AS ok, {number} AS pat, i FROM (
    SELECT id, m[i] AS v, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM (
      SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT id, regexp_extract_all(text, {regex}) AS m, string_split_regex(text, {regex}) AS g FROM ({source}) src)))""")
    return "SELECT id, entity_type, start, \"end\", CASE WHEN ok THEN 1.0::DOUBLE ELSE base END AS score, base, v, pat, i FROM (" + "\n  UNION ALL".join(parts) + "\n) q WHERE ok IS NULL OR ok"


def luhn_sql(v: str) -> str:
    d = f"list_transform(string_split({v}, ''), lambda c: CAST(c AS INTEGER))"
    return f"(list_sum(list_transform(range(1, length({v}) + 1), lambda k: CASE WHEN (length({v}) - k) % 2 = 0 THEN {d}[k] ELSE CASE WHEN {d}[k] * 2 > 9 THEN {d}[k] * 2 - 9 ELSE {d}[k] * 2 END END)) % 10 = 0)"


def digit_sql(v: str, i: int) -> str:
    return f"CAST(substr({v}, {i}, 1) AS INTEGER)"


def weighted_sql(v: str, weights: list[int]) -> str:
    return " + ".join(f"{digit_sql(v, i + 1)} * {w}" for i, w in enumerate(weights))


def mod97_sql(v: str) -> str:
    spelt = f"array_to_string(list_transform(string_split({v}, ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
    return f"list_reduce(list_transform(string_split({spelt}, ''), lambda c: CAST(c AS INTEGER)), lambda a, b: (a * 10 + b) % 97)"


SSN_SQL = (
    "CASE WHEN len(list_distinct(regexp_extract_all(v, '[-. ]'))) > 1 OR len(list_distinct(string_split(regexp_replace(v, '[^0-9]', '', 'g'), ''))) = 1 "
    "OR substr(regexp_replace(v, '[^0-9]', '', 'g'), 4, 2) = '00' OR substr(regexp_replace(v, '[^0-9]', '', 'g'), 6, 4) = '0000' "
    "OR substr(regexp_replace(v, '[^0-9]', '', 'g'), 1, 3) IN ('000', '666') OR regexp_replace(v, '[^0-9]', '', 'g') IN ('123456789', '987654320', '078051120') THEN false END"
)
_PLAIN = "translate(v, '- ', '')"
_FRENCH = "translate(v, ' .-', '')"
_NIR_BODY = f"CASE WHEN contains(substr({_FRENCH}, 1, 13), '2A') THEN regexp_replace(substr({_FRENCH}, 1, 13), '2A', '19') ELSE regexp_replace(substr({_FRENCH}, 1, 13), '2B', '18') END"
VERDICTS: dict[str, dict[str, str] | str | None] = {
    "CreditCardRecognizer": f"NOT (length({_PLAIN}) = 13 AND substr({_PLAIN}, 1, 1) = '1') AND {luhn_sql(_PLAIN)}",
    "IbanRecognizer": f"{mod97_sql('substr(v, 5) || substr(v, 1, 4)')} = 1",
    "IpRecognizer": {
        "IPv4": r"CASE WHEN NOT regexp_matches(v, '^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$') THEN false END",
        "IPv6 (candidate)": "CASE WHEN NOT (NOT regexp_matches(v, ':$') AND ((NOT contains(v, '::') AND len(string_split(v, ':')) = 8) OR (contains(v, '::') AND len(list_filter(string_split(v, ':'), lambda x: x <> '')) <= 7))) THEN false END",
    },
    "UsSsnRecognizer": SSN_SQL,
    "AbaRoutingRecognizer": f"({weighted_sql(_PLAIN, [3, 7, 1] * 3)}) % 10 = 0",
    "UsNpiRecognizer": f"len(list_distinct(string_split(substr({_PLAIN}, 1, length({_PLAIN}) - 1), ''))) > 1 AND {luhn_sql(f'''('80840' || {_PLAIN})''')}",
    "MedicalLicenseRecognizer": f"({weighted_sql(f'substr({_PLAIN}, 3)', [1, 2] * 3)}) % 10 = {digit_sql(f'substr({_PLAIN}, 3)', 7)}",
    "FrNirRecognizer": f"97 - CAST({_NIR_BODY} AS BIGINT) % 97 = CAST(substr({_FRENCH}, 14, 2) AS INTEGER)",
    "FrSirenRecognizer": luhn_sql(_FRENCH),
    "FrSiretRecognizer": luhn_sql(_FRENCH),
}


def window_sql(source: str = "text", start: str = "start", before: int = 5) -> str:
    r"""The last words before a span, lower-cased: the context window."""
    return rf"lower(array_to_string(regexp_extract_all(substr({source}, 1, {start}), '[\p{{L}}\p{{Nd}}]+')[-{before}:], ' '))"


def boosted_sql(window: str, words: tuple[str, ...], score: str, factor: float = 0.35, floor: float = 0.4) -> str:
    hit = " OR ".join(f"contains({window}, {_quoted(w.lower())})" for w in words)
    return f"CASE WHEN {hit} THEN least(1.0::DOUBLE, greatest({floor}::DOUBLE, {score} + {factor}::DOUBLE)) ELSE {score} END"
