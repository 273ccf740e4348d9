"""For each query, the SQL that gives the same rows on DuckDB."""

from __future__ import annotations

import json

from checks.queries import STORED_THRESHOLD, UNUSUAL
from keysift.functions import chars
from keysift.functions.profile import LAYOUT, RATIOS, SHAPES
from keysift.operators.encrypt import OVERHEAD
from keysift.operators.evaluate import CLASS_NAMES
from keysift.operators.rules import DEFAULT_RULES
from keysift.operators.synth import NEGATIVE_TEMPLATES, POSITIVE_TEMPLATES
from keysift.plans import reports
from keysift.plans.config import TrainingConfig

WS = chars.WHITESPACE


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count_of(bracket: str, text: str = "text") -> str:
    return f"length(regexp_replace({text}, {quote(f'[^{bracket}]')}, '', 'g'))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


# Text profiles

_COUNTS = {"length": "length(text)::INT"} | {
    name: f"{count_of(bracket)}::INT"
    for name, bracket in [
        ("upper", "A-Z"),
        ("lower", "a-z"),
        ("digit", "0-9"),
        ("special", chars.SPECIAL),
        ("whitespace", WS),
    ]
}
_RUNS = f"[A-Z]+|[a-z]+|[0-9]+|[{chars.SPECIAL}]+|[^A-Za-z0-9{chars.SPECIAL}]+"
_TRANSITIONS = f"greatest(length(regexp_replace(text, {quote(_RUNS)}, 'x', 'g')) - 1, 0)"
_FLAGS = {
    "has_eq": "contains(text, '=')",
    "has_colon": "contains(text, ':')",
    "has_quotes": "regexp_matches(text, '[''\"]')",
    "has_password_kw": "regexp_matches(text, '(?i)password|senha|pwd')",
    "has_api_kw": "regexp_matches(text, '(?i)api|key|token|secret')",
    "has_hex": "regexp_matches(text, '(?i)[0-9a-f]{8,}')",
    "has_base64": "regexp_matches(text, '[A-Za-z0-9+/]{4,}={0,2}')",
}
assert set(_FLAGS) == set(SHAPES)
_RATIO_SQL = {
    **{f"prop_{c}": f'"{c}" / length' for c in ("upper", "lower", "digit", "special")},
    "char_set_richness": '(("upper" > 0)::INT + ("lower" > 0)::INT + (digit > 0)::INT '
    "+ (special > 0)::INT)::DOUBLE / 4",
    "avg_word_length": "CASE WHEN whitespace > 0 THEN (length - whitespace) / (whitespace + 1) "
    "ELSE length::DOUBLE END",
    "transition_rate": "CASE WHEN length > 1 THEN transitions / (length - 1) ELSE 0.0::DOUBLE END",
}


def columns(exprs: dict[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in exprs.items())


_PROFILE = f"""
counted AS (SELECT doc_id, {columns(_COUNTS)}, ({_TRANSITIONS})::INT AS transitions,
  {columns({name: f"({sql})::INT" for name, sql in _FLAGS.items()})} FROM documents),
profiled AS (SELECT *, {columns(_RATIO_SQL)} FROM counted)
"""


def _feature_string() -> str:
    lines = []
    for i, names in enumerate(LAYOUT):
        parts = [
            f"'{name}:' || " + (f"printf('%.2f', {name})" if name in RATIOS else f'"{name}"')
            for name in names
        ]
        lines.append(" || ' ' || ".join(parts) + (" || ' '" if i == 0 else ""))
    rendered = " || chr(10) || '    ' || ".join(lines)
    return f"WITH {_PROFILE} SELECT doc_id, CASE WHEN length = 0 THEN '' ELSE {rendered} END AS features FROM profiled"


_BINARY = (
    r"(regexp_matches(text, '[\x00-\x08\x0e-\x1f\x7f]|[^\x00-\x{ff}]') OR "
    + count_of(r"\t-\r\x{80}-\x{a0}\x{ad}")
    + " > length(text) * 0.1::DOUBLE)"
)

# Rules

_DEFAULT = [(rule.name, rule.pattern) for rule in DEFAULT_RULES]
_CUSTOM = [
    ("assignment", r"[\p{L}\p{N}_]+ ?= ?\"[\p{L}\p{N}_]+\""),
    ("address", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
]
_JSON = [
    ("address", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("shout", r"(?i)token|es[oa]s"),
    ("dollars", r"[$]{3}"),
]


def any_rule(rules: list[tuple[str, str]]) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, {quote(p)})" for _, p in rules) + ")"


def spans(rules: list[tuple[str, str]], source: str = "documents", keys: str = "doc_id") -> str:
    """CTE ``spans(keys, rule_order, start, end, type, match)``: text between matches gives starts."""
    scans = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS rule_order, {quote(name)} AS type, "
        f"regexp_extract_all(text, {quote(p)}) AS m, string_split_regex(text, {quote(p)}) AS g "
        f"FROM {source} WHERE regexp_matches(text, {quote(p)})"
        for i, (name, p) in enumerate(rules)
    )
    return f"""scans AS ({scans}),
numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM scans),
spans AS (SELECT {keys}, rule_order, type, m[i] AS match,
  (list_sum(list_transform(g[1:i], lambda x: length(x)))
   + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT AS start,
  (list_sum(list_transform(g[1:i], lambda x: length(x)))
   + list_sum(list_transform(m[1:i], lambda x: length(x))))::INT AS "end"
  FROM numbered)"""


def detected(
    rules: list[tuple[str, str]], source: str = "documents", keys: str = "doc_id", score: str = ""
) -> str:
    """Flat detection results; ``score`` is a SQL expression over text, without one rules decide."""
    confidence = "CASE WHEN matches IS NOT NULL THEN 1.0::DOUBLE ELSE {} END"
    confidence = confidence.format(f"coalesce({score}, 0.0::DOUBLE)" if score else "0.0::DOUBLE")
    using = ", ".join(keys.split(", "))
    return f"""{spans(rules, source, keys)},
listed AS (SELECT {keys},
  string_agg(match, chr(10) ORDER BY rule_order, start) AS matches,
  string_agg(start || '-' || "end" || '-' || type, ';' ORDER BY rule_order, start) AS positions
  FROM spans GROUP BY ALL),
decided AS (SELECT {keys}, text, matches, positions, {confidence} AS confidence
  FROM {source} LEFT JOIN listed USING ({using})),
detected AS (SELECT {keys}, confidence >= 0.7::DOUBLE AS has_credential, confidence,
  CASE WHEN matches IS NOT NULL THEN matches WHEN confidence >= 0.7::DOUBLE THEN text ELSE '' END AS matches,
  coalesce(positions, '') AS positions FROM decided)"""


_SCORE = f"least(1.0::DOUBLE, {count_of('0-9')} / nullif(length(text), 0) * 20.0::DOUBLE)"


def _masked(rules: list[tuple[str, str]]) -> str:
    masked = "text"
    for name, pattern in rules:
        masked = f"regexp_replace({masked}, {quote(pattern)}, {quote(f'[{name}]')}, 'g')"
    return masked


_UNUSUAL = (
    "CASE doc_id % 3 "
    + " ".join(f"WHEN {i} THEN {quote(plain)}" for i, plain in enumerate(UNUSUAL.values()))
    + " END"
)


def _detect(rules, **kwargs) -> str:
    return f"WITH {detected(rules, **kwargs)} SELECT * FROM detected"


# Labelled data

_LABELLED = """labelled AS (SELECT doc_id, text, quality AS label
  FROM documents JOIN labels USING (doc_id))"""


def split_of(source: str) -> str:
    """CTE ``split_rows``: the first of each class by hash, in shares by largest remainder."""
    return f"""sizes AS (SELECT label, count(*) AS size FROM {source} GROUP BY label),
shares AS (SELECT label, ceil(0.2::DOUBLE * sum(size) OVER ()) AS wanted,
  ceil(0.2::DOUBLE * sum(size) OVER ()) * (size / sum(size) OVER ()) AS share FROM sizes),
quotas AS (SELECT label, floor(share) + (row_number() OVER (ORDER BY share - floor(share) DESC, label)
  <= wanted - sum(floor(share)) OVER ())::INT AS quota FROM shares),
split_rows AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY label
  ORDER BY md5('42:' || doc_id)) <= quota THEN 'test' ELSE 'train' END AS split
  FROM {source} s JOIN quotas USING (label))"""


def _draw(index: str, choices: int) -> str:
    return f"(('0x' || substr(digits, ({index}) * 8 + 1, 8))::BIGINT % {choices})"


def _filled(template: list) -> str:
    parts, drawn = [], 1
    for part in template:
        if isinstance(part, str):
            parts.append(quote(part))
        elif isinstance(part[0], str):
            alphabet, length = part
            pick = f"substr({quote(alphabet)}, {_draw(f'i + {drawn}', len(alphabet))} + 1, 1)"
            parts.append(f"array_to_string(list_transform(range({length}), lambda i: {pick}), '')")
            drawn += length
        else:
            low, high = part
            parts.append(f"({_draw(str(drawn), high - low + 1)} + {low})")
            drawn += 1
    return " || ".join(parts)


def synthetic(ids: str, key: str, positive: bool) -> str:
    kind = "positive" if positive else "negative"
    templates = POSITIVE_TEMPLATES if positive else NEGATIVE_TEMPLATES
    blocks = " || ".join(f"md5('42:{kind}:' || {key} || ':{b}')" for b in range(17 if positive else 1))
    cases = " ".join(
        f"WHEN {_draw('0', len(templates))} = {i} THEN {_filled(t)}" for i, t in enumerate(templates)
    )
    return f"""SELECT {key}, CASE {cases} END AS text, {positive} AS is_credential, 'synthetic' AS source
  FROM (SELECT {key}, {blocks} AS digits FROM {ids})"""


_EXAMPLES = """SELECT text, quality = 1 AS is_credential, 'manual' AS source
  FROM documents JOIN labels USING (doc_id)"""

# Vectors

_NORMAL = "strip_accents(lower(text))"
_GRAMS = f"""words AS (SELECT doc_id, unnest(list_filter(
    string_split_regex({_NORMAL}, '[{WS}]+'), lambda w: w <> '')) AS w FROM documents),
padded AS (SELECT doc_id, ' ' || w || ' ' AS p FROM words),
sized AS (SELECT doc_id, p, unnest([1, 2, 3]) AS n FROM padded),
placed AS (SELECT doc_id, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM sized),
grams AS (SELECT doc_id, substr(p, i, n) AS gram FROM placed)"""
_FIT = f"""{_GRAMS},
per_gram AS (SELECT gram, count(*) AS tf, count(DISTINCT doc_id) AS df FROM grams GROUP BY gram),
top AS (SELECT * FROM per_gram
  WHERE df >= 2 AND df <= 0.95::DOUBLE * (SELECT count(*) FROM documents)
  ORDER BY tf DESC, gram LIMIT 1500),
vocabulary AS (SELECT gram, (row_number() OVER (ORDER BY gram) - 1)::INT AS idx, df, tf,
  ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM top)"""
_RAW = """raw_chars AS (SELECT doc_id, string_split(text, '') AS c FROM documents),
raw_grams AS (SELECT doc_id, unnest(c) AS gram FROM raw_chars
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) FROM raw_chars
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))
  FROM raw_chars),
raw_counts AS (SELECT doc_id, idx, idf, count(*) AS c FROM raw_grams JOIN vocabulary USING (gram) GROUP BY ALL)"""

# Evaluation

_SCORED = f"""WITH {detected(_DEFAULT, score=_SCORE)},
scored AS (SELECT toxic AS label, has_credential::INT AS prediction, confidence
  FROM detected JOIN labels USING (doc_id)),
cells AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) AS n FROM scored),
points AS (SELECT confidence AS threshold, sum(label) AS pos, sum(1 - label) AS neg
  FROM scored GROUP BY confidence),
curve AS (SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC)::BIGINT AS tp,
  sum(neg) OVER (ORDER BY threshold DESC)::BIGINT AS fp FROM points),
sides AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM scored),
area AS (SELECT sum((a.label > b.label)::INT * CASE WHEN a.confidence > b.confidence THEN 1.0::DOUBLE
    WHEN a.confidence = b.confidence THEN 0.5::DOUBLE ELSE 0 END) / (SELECT p * n FROM sides) AS auc
  FROM scored a, scored b)"""
_CLASS0, _CLASS1 = (quote(name) for name in CLASS_NAMES)


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(({part}) / nullif({whole}, 0), 0)::DOUBLE"


_P0, _R0, _F0 = _ratio("tn", "tn + fn"), _ratio("tn", "tn + fp"), _ratio("2 * tn", "2 * tn + fn + fp")
_P1, _R1, _F1 = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn"), _ratio("2 * tp", "2 * tp + fp + fn")
_S0, _S1 = "(tn + fp)", "(tp + fn)"


def _report_row(name: str, p: str, r: str, f: str, support: str) -> str:
    return (
        f'SELECT {name} AS "class", round({p}, 6) AS precision, round({r}, 6) AS recall, '
        f"round({f}, 6) AS f1, {support} AS support FROM cells"
    )


def _weighted(a: str, b: str) -> str:
    return f"({a} * {_S0} + {b} * {_S1}) / n"


_REPORT = " UNION ALL ".join(
    [
        _report_row(_CLASS0, _P0, _R0, _F0, _S0),
        _report_row(_CLASS1, _P1, _R1, _F1, _S1),
        _report_row("'accuracy'", "NULL::DOUBLE", "NULL::DOUBLE", "(tn + tp) / n", "n"),
        _report_row("'macro avg'", f"({_P0} + {_P1}) / 2", f"({_R0} + {_R1}) / 2", f"({_F0} + {_F1}) / 2", "n"),
        _report_row("'weighted avg'", _weighted(_P0, _P1), _weighted(_R0, _R1), _weighted(_F0, _F1), "n"),
    ]
)


def _rules_object() -> str:
    entries = [
        (i, quote(rule.pattern), quote(json.dumps(rule.name) + ":" + json.dumps(
            {"pattern": rule.pattern, "flags": rule.flags}, ensure_ascii=False, separators=(",", ":")
        )))
        for i, rule in enumerate(DEFAULT_RULES)
    ]
    cases = " UNION ALL ".join(
        f"SELECT {i} AS ord, {entry} AS entry WHERE EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, {p}))"
        for i, p, entry in entries
    )
    return f"SELECT '{{' || coalesce(string_agg(entry, ',' ORDER BY ord), '') || '}}' AS value FROM ({cases})"


_CLASSES = f"""WITH {_LABELLED}, {split_of('labelled')},
keyed AS (SELECT *, md5(trim(regexp_replace({_NORMAL}, '[{WS}]+', ' ', 'g'))) AS content FROM split_rows),
classes AS (SELECT content, count(*) AS n, count(*) FILTER (split = 'train') AS n_train,
  count(*) FILTER (split = 'test') AS n_test, {", ".join(
      f"count(*) FILTER (split = '{part}' AND label = {label}) AS {part}_{label}"
      for part in ("train", "test") for label in (0, 1)
  )} FROM keyed GROUP BY content),
leaks AS (SELECT *, (train_1 + test_1 > 0) AND (train_0 + test_0 > 0) AS conflict FROM classes
  WHERE n_train > 0 AND n_test > 0)"""

_CHAT = """everything AS (SELECT conv_id, turn, text FROM conversations
  UNION ALL SELECT doc_id, -1, text FROM documents)"""

ORACLE: dict[str, str] = {
    "char_counts": f"SELECT doc_id, {columns(_COUNTS)} FROM documents",
    "char_ratios": f"WITH {_PROFILE} SELECT doc_id, prop_upper, prop_lower, prop_digit, prop_special, "
    "char_set_richness, avg_word_length FROM profiled",
    "shape_flags": "SELECT doc_id, "
    + columns({name: f"({sql})::INT" for name, sql in _FLAGS.items()})
    + " FROM documents",
    "transitions": f"WITH {_PROFILE} SELECT doc_id, transitions, transition_rate FROM profiled",
    "char_class": f"""SELECT char, count(*) AS docs, CASE WHEN regexp_matches(char, '[A-Z]') THEN 'upper'
      WHEN regexp_matches(char, '[a-z]') THEN 'lower' WHEN regexp_matches(char, '[0-9]') THEN 'digit'
      WHEN regexp_matches(char, {quote('[' + chars.SPECIAL + ']')}) THEN 'special' ELSE 'other' END AS class
      FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '(?s).'))) AS char FROM documents)
      GROUP BY char""",
    "feature_string": _feature_string(),
    "classifier_features": f"""SELECT doc_id, length(text)::INT AS length,
      regexp_matches(text, {quote('[' + chars.SPECIAL_WITH_QUOTES + ']')}) AS has_special_chars,
      {count_of(r'\p{Lu}')} / greatest(length(text), 1) AS uppercase_ratio,
      {count_of(chars.unicode_digits())} / greatest(length(text), 1) AS digit_ratio,
      {_BINARY} AS is_binary FROM documents""",
    "is_binary": f"SELECT doc_id, {_BINARY} AS is_binary FROM documents",
    "tokenize": f"""SELECT doc_id, len(tokens)::INT AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest
      FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text,
      {quote('([' + chars.SPECIAL + '])')}, ' \\1 ', 'g'), '[{WS}]+'), lambda t: t <> '') AS tokens FROM documents)""",
    "rule_matches": f"SELECT doc_id, {any_rule(_DEFAULT)} AS matched FROM documents",
    "match_spans": f"WITH {spans(_DEFAULT)} SELECT * FROM spans",
    "spans_exploded": f"""WITH {_CHAT}, {spans(_DEFAULT, 'everything', 'conv_id, turn')}
      SELECT conv_id, turn, start, "end", type, match AS slice FROM spans""",
    "rule_stats": f"""WITH {spans(_DEFAULT)} SELECT type, count(*) AS matches, count(DISTINCT doc_id) AS texts
      FROM spans GROUP BY type""",
    "mask_flagged": f"SELECT doc_id, {_masked(_DEFAULT)} AS masked FROM documents",
    "encrypt_flagged": f"""SELECT doc_id, {any_rule(_DEFAULT)} AS flagged, true AS opened,
      CASE WHEN {any_rule(_DEFAULT)} THEN octet_length(encode(text))::INT + {OVERHEAD} END AS n_bytes FROM documents""",
    "detect_rules": _detect(_DEFAULT),
    "detect_custom_rules": _detect(_CUSTOM),
    "detect_hybrid": _detect(_DEFAULT, score=_SCORE),
    "detect_json": f"""WITH {detected(_DEFAULT)}, {spans(_DEFAULT).replace('scans', 'scans2').replace('numbered', 'numbered2').replace('spans AS', 'spans2 AS')}
      SELECT has_credential, confidence, count(*) AS n, sum(length(text))::BIGINT AS chars,
      sum((SELECT count(*) FROM spans2 s WHERE s.doc_id = d.doc_id))::BIGINT AS matches
      FROM detected d JOIN documents USING (doc_id) GROUP BY ALL""",
    "rules_from_json": f"""WITH {spans(_JSON)} SELECT doc_id, rule_order, type, start, "end" FROM spans""",
    "export_rules": _rules_object(),
    "detect_from_artifacts": _detect(_DEFAULT, score=_SCORE).replace("0.7::DOUBLE", f"{STORED_THRESHOLD}::DOUBLE"),
    "detect_stream": _detect(_DEFAULT, source="conversations", keys="conv_id, turn", score=_SCORE),
    "ingest_jsonl": _EXAMPLES,
    "ingest_jsonl_repair": """SELECT doc_id, text, true AS is_credential, NULL::VARCHAR AS rejected FROM documents
      WHERE lang <> 'de' UNION ALL SELECT doc_id, lang, false, NULL FROM documents WHERE lang = 'fr'
      UNION ALL SELECT doc_id, text, true, NULL FROM documents WHERE lang = 'de'
      UNION ALL SELECT doc_id, NULL, NULL, '{"text":' FROM documents WHERE lang = 'de'""",
    "ingest_csv": f"""SELECT {strip('text')} AS text, CASE WHEN lang <> 'es' THEN n_chars % 3 - 1 <> 0 END AS is_credential,
      'csv_import' AS source, CASE WHEN lang = 'es' THEN '' END AS bad_label FROM documents WHERE lang <> 'fr'""",
    "ingest_lines": f"""SELECT text, false AS is_credential, true AS named, count(*) AS n FROM
      (SELECT {strip('line')} AS text FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents))
      WHERE text <> '' GROUP BY text""",
    "ingest_testset": r"""SELECT pos, line AS text, regexp_matches(line, '[0-9]')::INT AS label, count(*) AS n
      FROM (SELECT unnest(range(0, len(lines)))::INT AS pos, unnest(lines) AS line
        FROM (SELECT string_split(text, chr(10)) AS lines FROM documents)) GROUP BY ALL""",
    "ingest_testset_object": """SELECT 0 AS pos, NULL::VARCHAR AS text, NULL::INT AS label UNION ALL
      SELECT row_number() OVER (ORDER BY doc_id)::INT, text, regexp_matches(text, '[0-9]')::INT FROM documents""",
    "append_examples": """SELECT text, false AS is_credential, 'manual' AS source FROM documents
      UNION ALL SELECT text, true, 'user_input' FROM conversations""",
    "append_stream": "SELECT text, true AS is_credential, 'user_input' AS source FROM conversations",
    "label_union": f"WITH {_LABELLED} SELECT text, label FROM labelled",
    "class_deficit": f"""SELECT is_credential, count(e.is_credential) AS n,
      greatest(500 - count(e.is_credential), 0) AS deficit
      FROM (VALUES (true), (false)) c(is_credential) LEFT JOIN ({_EXAMPLES}) e USING (is_credential)
      GROUP BY is_credential""",
    "topup_examples": f"""WITH examples AS ({_EXAMPLES}), wanted AS (SELECT count(*) AS n FROM labels),
      yes AS (SELECT unnest(range(0, (SELECT greatest(max(wanted.n) - count(*), 0) FROM wanted, examples WHERE is_credential))) AS id),
      no AS (SELECT unnest(range(0, (SELECT greatest(max(wanted.n) - count(*), 0) FROM wanted, examples WHERE NOT is_credential))) AS id)
      SELECT * FROM examples
      UNION ALL SELECT text, is_credential, source FROM ({synthetic('yes', 'id', True)})
      UNION ALL SELECT text, is_credential, source FROM ({synthetic('no', 'id', False)})""",
    "synth_positive": synthetic("documents", "doc_id", True),
    "synth_negative": synthetic("documents", "doc_id", False),
    "stratified_split": f"""WITH labelled AS (SELECT doc_id, quality AS label FROM labels),
      {split_of('labelled')} SELECT doc_id, label, split FROM split_rows""",
    "split_roundtrip": f"WITH {_LABELLED}, {split_of('labelled')} SELECT doc_id, text, label, split FROM split_rows",
    "leakage_audit": f"""{_CLASSES} SELECT doc_id, label, n_train, n_test,
      CASE label WHEN 1 THEN train_1 ELSE train_0 END AS same_label,
      CASE label WHEN 1 THEN train_0 ELSE train_1 END AS other_label, conflict
      FROM keyed JOIN leaks USING (content) WHERE split = 'test'""",
    "leakage_classes": f"{_CLASSES} SELECT * FROM leaks",
    "leakage_summary": f"""{_CLASSES} SELECT label, sum(n_test)::BIGINT AS n_test, sum(n_leaked)::BIGINT AS n_leaked,
      sum(n_contradicted)::BIGINT AS n_contradicted, round(sum(n_leaked) / sum(n_test), 6) AS share FROM (
      {" UNION ALL ".join(
          f"SELECT {x} AS label, test_{x} AS n_test, CASE WHEN n_train > 0 THEN test_{x} ELSE 0 END AS n_leaked, "
          f"CASE WHEN train_{x} = 0 AND train_{1 - x} > 0 THEN test_{x} ELSE 0 END AS n_contradicted FROM classes"
          for x in (0, 1)
      )}) GROUP BY label""",
    "normalize_text": f"SELECT doc_id, {_NORMAL} || {_UNUSUAL} AS text FROM documents",
    "char_wb_ngrams": f"""WITH {_GRAMS}, digests AS (SELECT doc_id, count(*)::INT AS n,
      md5(string_agg(gram, '|' ORDER BY gram)) AS digest FROM grams GROUP BY doc_id)
      SELECT doc_id, coalesce(n, 0) AS n, coalesce(digest, md5('')) AS digest
      FROM documents LEFT JOIN digests USING (doc_id)""",
    "gram_counts": f"WITH {_GRAMS} SELECT gram, count(*) AS tf, count(DISTINCT doc_id) AS df FROM grams GROUP BY gram",
    "tfidf_fit": f"WITH {_FIT} SELECT gram, idx, df, tf, round(idf, 6) AS idf FROM vocabulary",
    "tfidf_transform": f"""WITH {_FIT}, weighted AS (SELECT doc_id, idx, count(*) * idf AS w
      FROM grams JOIN vocabulary USING (gram) GROUP BY doc_id, idx, idf)
      SELECT doc_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted""",
    "vocab_from_json": f"WITH {_FIT} SELECT gram, idx, round(idf, 6) AS idf FROM vocabulary",
    "export_vocab": f"""WITH {_FIT} SELECT md5(string_agg(gram, '|' ORDER BY idx)) AS digest, count(*)::INT AS n,
      '1-3' AS ngram_range, 'l2' AS norm, 0.95::DOUBLE AS max_df, 'char_wb' AS analyzer FROM vocabulary""",
    "export_config": f"""WITH {_FIT} SELECT 'detector' AS model_name, count(*)::INT AS input_dim,
      string_agg(gram, '|' ORDER BY idx) AS feature_names, 0.7::DOUBLE AS confidence_threshold,
      {quote("|".join(sorted(f"{name}={pattern}" for name, pattern in _DEFAULT)))} AS patterns,
      {quote("|".join(sorted(f"{key}={value}" for key, value in TrainingConfig().as_dict().items())))} AS config
      FROM vocabulary""",
    "raw_vector_without_idf": f"""WITH {_FIT}, {_RAW} SELECT doc_id, idx,
      round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw_counts""",
    "raw_ngram_vector": f"""WITH {_FIT}, {_RAW} SELECT doc_id, idx,
      round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) * idf, 6) AS weight FROM raw_counts""",
    "eval_confusion": f"""{_SCORED} SELECT label, prediction, count(s.label) AS n
      FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) grid(label, prediction)
      LEFT JOIN scored s USING (label, prediction) GROUP BY ALL""",
    "eval_report": f"{_SCORED} {_REPORT}",
    "eval_summary": f"""{_SCORED} SELECT n, round((tn + tp) / n, 6) AS accuracy, round({_F1}, 6) AS f1,
      round(auc, 6) AS roc_auc FROM cells, area""",
    "eval_joined": f"""WITH {detected(_DEFAULT, score=_SCORE)},
      found AS (SELECT doc_id, has_credential::INT AS p FROM detected),
      predictions AS (SELECT CASE WHEN doc_id % 10 <> 3 THEN doc_id END AS key, p FROM found
        UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 - p ELSE p END FROM found WHERE doc_id % 7 = 0),
      marks AS (SELECT doc_id AS key, toxic AS l FROM labels
        UNION ALL SELECT doc_id, toxic FROM labels WHERE doc_id % 4 = 0
        UNION ALL SELECT -1 - doc_id, toxic FROM labels WHERE doc_id % 5 = 0),
      ps AS (SELECT key, count(*) AS n, min(p) AS lo, max(p) AS hi FROM predictions WHERE key IS NOT NULL GROUP BY key),
      ls AS (SELECT key, count(*) AS n, min(l) AS lo, max(l) AS hi FROM marks WHERE key IS NOT NULL GROUP BY key),
      pairs AS (SELECT ps.n AS np, ls.n AS nl, ps.lo AS p, ls.lo AS l, ps.lo = ps.hi AND ls.lo = ls.hi AS ok
        FROM ps FULL JOIN ls USING (key))
      SELECT {", ".join(f"count(*) FILTER (ok AND l = {t} AND p = {p}) AS {c}" for c, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))},
      count(*) FILTER (ok) AS matched, count(*) FILTER (np > 0 AND nl > 0 AND NOT ok) AS conflicting,
      count(*) FILTER (nl IS NULL) AS predicted_only, count(*) FILTER (np IS NULL) AS labelled_only,
      count(*) FILTER (np > 1) AS repeated_predictions, count(*) FILTER (nl > 1) AS repeated_labels,
      (SELECT count(*) FROM predictions WHERE key IS NULL) AS predictions_without_key,
      (SELECT count(*) FROM marks WHERE key IS NULL) AS labels_without_key FROM pairs""",
    "pr_curve": f"""{_SCORED} SELECT round(threshold, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
      round(tp / (SELECT p FROM sides), 6) AS recall FROM curve UNION ALL SELECT NULL, 1.0, 0.0""",
    "roc_curve": f"""{_SCORED}, stepped AS (SELECT *, row_number() OVER (ORDER BY threshold DESC) AS i,
      lead(pos) OVER (ORDER BY threshold DESC) AS next_pos, lead(neg) OVER (ORDER BY threshold DESC) AS next_neg
      FROM curve)
      SELECT round(threshold, 6) AS threshold, fp, tp, round(fp / (SELECT n FROM sides), 6) AS fpr,
      round(tp / (SELECT p FROM sides), 6) AS tpr FROM stepped
      WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
      UNION ALL SELECT NULL, 0, 0, 0.0, 0.0""",
    "auc": f"{_SCORED} SELECT round(auc, 6) AS auc FROM area",
    "train_forest": f"""WITH {_LABELLED}, {split_of('labelled')},
      tested AS (SELECT label FROM split_rows WHERE split = 'test')
      SELECT class, count(label) AS support, true AS sound FROM
      (VALUES {", ".join(f"({quote(name)}, {i})" for i, name in enumerate(CLASS_NAMES))}) c(class, label)
      LEFT JOIN tested USING (label) GROUP BY class
      UNION ALL SELECT class, (SELECT count(*) FROM tested), true
      FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) a(class)""",
    "train_report": f"""SELECT value FROM (VALUES {", ".join(
        f"({quote(line)})"
        for line in [
            reports.REPORT,
            reports.MATRIX,
            reports.SETTINGS,
            *[f"{key}: {value}" for key, value in TrainingConfig().as_dict().items()],
            *[f"{name}: true" for name in (*CLASS_NAMES, "accuracy", "macro avg", "weighted avg")],
            *[f"{name}: true" for name in ("total", "matrix row 0", "matrix row 1")],
        ]
    )}) lines(value)""",
    "score_model": f"""WITH {detected(_DEFAULT)} SELECT doc_id, has_credential AS rule_hit, true AS sound,
      CASE WHEN has_credential THEN matches END AS matches, positions FROM detected""",
    "model_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "profile_model_roundtrip": "SELECT doc_id, true AS same, 5 AS n_profile FROM documents",
}
