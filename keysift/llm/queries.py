"""One query per operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm import (
    audit,
    decontam,
    dedup,
    langid,
    licenses,
    mixing,
    pii,
    quality,
    rules,
    substrings,
    tokens,
    urls,
    whitening,
)
from keysift.llm.common import fold, whole
from keysift.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_pii(spark, sf_dir):
    found = pii.find(texts(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["type"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    digest = F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256")
    spans = pii.listed(F.concat("base", "terms")).alias("spans")
    return found.select("doc_id", *counts, digest, spans)


def op2_quality(spark, sf_dir):
    docs, labels = texts(spark, sf_dir), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality.fit(docs.where(~held_out), labels.where(~held_out))
    scored = quality.with_quality(docs.withColumn("held_out", held_out), model)
    predicted = (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    return scored.select("doc_id", "held_out", "score", predicted)


def op3_urls(spark, sf_dir):
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.rules_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_near_duplicates(spark, sf_dir):
    found = dedup.near_duplicates(texts(spark, sf_dir), dedup.MinHash(words=4))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    found = langid.with_language(docs.drop("lang"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op6_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select(
        "doc_id",
        "source",
        mixing.word_count(F.col("text")).alias("size"),
        F.md5(whole(F.col("text"))).alias("content"),
    )
    mixed = mixing.with_copies(sized, F.col("size"), content=F.col("content"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_rules(spark, sf_dir):
    rated = rules.rate(texts(spark, sf_dir))
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return rated.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (F.col("kept") & ~base_failed).alias("kept"),
    )


def op8_decontamination(spark, sf_dir):
    return decontam.contaminated(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark, sf_dir):
    scanned = licenses.scan(texts(spark, sf_dir))
    phrases, own = F.col("scan.phrases"), F.col("scan.licenses")
    places = phrases["start"].cast("array<long>")
    return scanned.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.size(phrases).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        licenses.joined(phrases["label"]).alias("base_labels"),
        licenses.joined(F.concat(phrases["label"], own["label"])).alias("labels"),
        licenses.score(phrases, own).alias("score"),
    )


def op10_tokens(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(texts(spark, sf_dir), path)
    return tokens.digest(spark, path)


def op11_substrings(spark, sf_dir):
    found = substrings.with_repeats(texts(spark, sf_dir))
    lost = F.aggregate(
        F.col("repeats.removed"), F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])
    )
    return found.select(
        "doc_id",
        F.col("repeats.n_words").alias("n_words"),
        lost.alias("n_removed"),
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


def op12_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels")
    marks = {
        "good": labels.where("quality = 1").select("doc_id"),
        "toxic": labels.where("toxic = 1").select("doc_id"),
    }
    return audit.audit(docs, marks, audit.text_filters(whole(F.col("text"))))


def op13_whitening(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = whitening.with_whitened(rows).where("whitened IS NOT NULL")
    parts = F.arrays_zip("whitened.values", "whitened.explained")
    return found.select("vec_id", "whitened", F.posexplode(parts).alias("place", "part")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "whitened.n",
        "whitened.deviation",
        F.col("part.values").alias("whitened"),
        F.col("part.explained").alias("explained"),
        F.col("whitened.identity_error").alias("identity_error"),
    )


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_urls": op3_urls,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_mix": op6_mix,
    "op7_rules": op7_rules,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_tokens": op10_tokens,
    "op11_substrings": op11_substrings,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {}

ORACLE["op3_urls"] = rf"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS r,
    {LOWERED.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(h, p, verdict) AS (VALUES
  {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)}
), fits AS (
  SELECT r, h || p AS rule, verdict,
    row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS place
  FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (r)
"""

ORACLE["op4_near_duplicates"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_transform({WORDS}, lambda x: {LOWERED.format("x")}) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words
), classes AS (
  SELECT md5(array_to_string(list_sort(s), chr(10))) AS c, any_value(s) AS s, min(doc_id) AS doc
  FROM sets WHERE len(s) > 0 GROUP BY c
), items AS (SELECT c, unnest(s) AS x FROM classes),
common AS (
  SELECT a.c AS a, b.c AS b, count(*) AS n FROM items a JOIN items b USING (x)
  WHERE a.c <> b.c GROUP BY a.c, b.c
), edges AS (
  SELECT a, b FROM common JOIN classes p ON p.c = a JOIN classes q ON q.c = b
  WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), reached AS (
  SELECT c, c AS other FROM classes
  UNION SELECT reached.c, edges.b FROM reached JOIN edges ON edges.a = reached.other
), least AS (
  SELECT reached.c, min(doc) AS doc FROM reached JOIN classes ON classes.c = other GROUP BY reached.c
), named AS (
  SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS c
  FROM sets
)
SELECT doc_id, n AS n_shingles, coalesce(doc, doc_id) AS component_id,
  doc_id IS NOT DISTINCT FROM coalesce(doc, doc_id) AS kept
FROM named LEFT JOIN least USING (c)
"""

ORACLE["op6_mix"] = rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS}) AS size,
    md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS ord
  FROM documents
), keyed AS (
  SELECT *, len(bin(size)) * 8 + (size >> greatest(len(bin(size)) - 3, 0)) AS cls FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, list_extract([3.0, 1.0, 2.0]::DOUBLE[],
    ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT) AS weight
  FROM sized GROUP BY source
), capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER
      (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER
      (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    AS level FROM capped
), targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM levels) * weight) AS target FROM levels
), ranked AS (
  SELECT doc_id, size, source_size, target, row_number() OVER
      (PARTITION BY k.source ORDER BY cls, ord, doc_id, size)::DOUBLE AS place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected,
    ('0x' || substr(md5('{mixing.SEED}|' || coalesce('=' || k.source, '')), 1, 8))::BIGINT
      / 4294967296.0::DOUBLE AS u
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * least(
  floor(u + place * expected) - floor(u + (place - 1) * expected), ceil(expected))::BIGINT AS taken
FROM ranked
"""


def _broken(rule: rules.Rule) -> str:
    against = f"greatest({rule.denominator or 1}, 1)"
    tests = []
    if rule.least is not None:
        tests.append(f"{rule.numerator} < {against} * {rule.least}::DOUBLE")
    if rule.most is not None:
        tests.append(f"{rule.numerator} > {against} * {rule.most}::DOUBLE")
    return f"(({' OR '.join(tests)}) AND {against} >= {rule.since})"


ORACLE["op7_rules"] = rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM again) GROUP BY r
), measured AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT
      AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in rules.STOP_WORDS)}))) AS n_stop_words
  FROM words LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR {" OR ".join(map(_broken, rules.RULES))}) AS kept
FROM measured
"""


def _pattern(parts: list) -> str:
    """A template as a regular expression over words written ``<word>``."""
    found = ""
    for part in parts:
        if isinstance(part, str):
            found += f"<{part}>"
        elif isinstance(part, int):
            found += f"(?:<[^>]*>){{0,{part}}}"
        else:
            found += f"(?:{_pattern(part)})?"
    return found


def _places(phrase: str) -> str:
    words = phrase.split()
    test = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))
    return f"[i FOR i IN range(0, len(w)) IF {test}]"


ORACLE["op9_licenses"] = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")},
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), found AS (
  SELECT doc_id, w, array_to_string(list_transform(w, lambda x: '<' || x || '>'), '') AS t,
    {", ".join(f"{_places(p)} AS p{k}" for k, p in enumerate(licenses.PHRASES.values()))}
  FROM words
), listed AS (
  SELECT *, {" || ".join(f"p{k}" for k in range(len(licenses.PHRASES)))} AS p,
    list_filter([{", ".join(
      f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(licenses.PHRASES)
    )}], lambda x: x IS NOT NULL) AS base,
    list_filter([{", ".join(
      f"CASE WHEN regexp_matches(t, '{_pattern(licenses.parse(template))}') THEN '{label}' END"
      for label, template in licenses.TEMPLATES.items()
    )}], lambda x: x IS NOT NULL) AS own
  FROM found
)
SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || own)), ',') AS labels,
  CASE WHEN len(list_filter(own, lambda x: x NOT IN ({", ".join(f"'{label}'" for label in sorted(licenses.SHORT))}))) > 0
      THEN 1.0 WHEN len(own) > 0 THEN 0.75 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM listed
"""

ORACLE["op11_substrings"] = rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents
), windows AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS x
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
), lost AS (
  SELECT r, i FROM (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY x) AS loses FROM windows) WHERE loses
), gone AS (
  SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 50)) AS j FROM lost)
), placed AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM placed ANTI JOIN gone USING (r, j) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""

ORACLE["op12_filter_audit"] = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, {WORDS} AS w FROM documents
), failing AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[{audit.SYMBOLS}]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM texts
), counted AS (
  SELECT part, f, count(*) AS n,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM failing GROUP BY part, f
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) AS r(s)
), tried AS (
  SELECT *, contains(f, x) AS fails, translate(earlier, f, '') <> earlier AS gone FROM steps, counted
), summed AS (
  SELECT part, o AS filter_order, s::INT AS step, x,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f = x), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM tried GROUP BY part, o, s, x
)
SELECT * EXCLUDE (x), sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM summed
"""
