import pytest
import regex
from pyspark.sql import functions as F

from keysift.operators.detect import detect, match_spans, matches_any_rule
from keysift.operators.rules import (
    ASCII,
    DEFAULT_RULES,
    DOTALL,
    IGNORECASE,
    MULTILINE,
    VERBOSE,
    Rule,
    rules_table,
)
from keysift.plans.detector import Detector, export_results, load_detector
from keysift.session import scratch_path
from keysift.sources import artifacts
from tests.samples import FLAGGED, HARMLESS, random_texts


def results(df, **kwargs):
    return {row.text: row for row in detect(df, **kwargs).collect()}


def python_spans(text, rules):
    """All matches by Python's regex module, in rule order."""
    found = []
    for rule in rules:
        # ASCII rules fold case over ASCII only, as the engine does.
        pattern = regex.compile(rule.pattern, rule.flags)
        found += [(m.start(), m.end(), rule.name, m.group()) for m in pattern.finditer(text)]
    return found


def test_flagged_texts(texts):
    for text, row in results(texts(list(FLAGGED))).items():
        assert row.has_credential and row.confidence >= 0.7 and len(row.matches) > 0
        assert FLAGGED[text] in {p.type for p in row.match_positions}


def test_harmless_texts(texts):
    for row in results(texts([*HARMLESS, None])).values():
        assert (row.has_credential, row.confidence) == (False, 0.0)
        assert row.matches == [] and row.match_positions == []


def test_custom_rules_replace_the_defaults(texts):
    df = texts(["test_secret=abc123", 'api_key="AbCdEfGhIjKlMnOpQrStUvWxYz123456"', "test_secret=ação"])
    rows = results(df, rules={"test_pattern": r"test_secret=(\w+)"})
    assert rows["test_secret=abc123"].matches == ["test_secret=abc123"]
    assert rows["test_secret=ação"].matches == ["test_secret=ação"]
    assert not rows['api_key="AbCdEfGhIjKlMnOpQrStUvWxYz123456"'].has_credential


def test_no_rules_find_nothing(texts):
    assert not any(row.has_credential for row in results(texts(list(FLAGGED)), rules={}).values())


def test_spans_match_python(texts):
    rules = [
        Rule("words", r"\w+"),
        Rule("fold", "k[ey]*|s", IGNORECASE),
        Rule("line", "^[a-z].*$", MULTILINE),
        Rule("across", "a.b", DOTALL),
        Rule("spaced", "a  [a-c] # comment", VERBOSE),
        Rule("ascii", r"\w+", ASCII),
        Rule("astral", "[😀𝔸]+"),
    ]
    # Marks and joiners count as word characters in only one of the engines.
    samples = [t.replace("\u0301", "").replace("①", "").replace("²", "").replace("½", "") for t in random_texts(400)]
    samples += ["kK\u212asſ", "abc\nabc\r\nabc", "a\nb"]
    df = texts(samples)
    spans = match_spans(df, rules=rules).collect()
    found = {}
    for row in sorted(spans, key=lambda r: (r.id, r.rule_order, r.start)):
        found.setdefault(row.id, []).append((row.start, row.end, row.type, row.match))
    for i, text in enumerate(samples):
        assert found.get(i, []) == python_spans(text, rules), repr(text)


def test_default_rules_match_python(texts):
    glue = ["", " ", "\n", '"', " é ", "token = ", "😀"]
    pieces = list(FLAGGED) + HARMLESS
    samples = [a + g + b for i, a in enumerate(pieces) for g in glue for b in pieces[i % 3 :: 3]]
    rows = results(texts(samples))
    for text in samples:
        expected = python_spans(text, DEFAULT_RULES)
        assert [(p.start, p.end, p.type) for p in rows[text].match_positions] == [e[:3] for e in expected]
        assert rows[text].matches == [e[3] for e in expected]


def test_needles_never_hide_a_match(texts):
    """The literal test before a regex may not change the result."""
    bare = [Rule(r.name, r.pattern, r.flags) for r in DEFAULT_RULES]
    df = texts([t.upper() for t in FLAGGED] + [t.lower() for t in FLAGGED] + list(FLAGGED) + HARMLESS)
    assert results(df) == results(df, rules=bare)


def test_many_matches_in_one_text(texts):
    text = "ab " * 20_000
    row = detect(texts([text]), rules={"word": "[a-z]+"}).first()
    assert len(row.match_positions) == 20_000
    assert [p.start for p in row.match_positions] == list(range(0, 60_000, 3))


def test_partitions_do_not_matter(texts):
    samples = [*FLAGGED, *HARMLESS]
    assert results(texts(samples, 1)) == results(texts(samples, 3)) == results(texts(samples, 8))


def test_empty_table(texts):
    assert detect(texts([])).count() == 0 and match_spans(texts([])).count() == 0


def test_hybrid_scores_only_what_no_rule_matched(texts):
    def score(df):
        return df.withColumn("confidence", F.length("score_text") / F.lit(10.0))

    rows = results(texts(["password=Password123!", "1234567", "123456", None]), score=score)
    assert rows["password=Password123!"].confidence == 1.0
    assert rows["password=Password123!"].matches == ["password=Password123!"]
    assert rows["1234567"].has_credential and rows["1234567"].matches == ["1234567"]
    assert rows["1234567"].match_positions == []
    assert not rows["123456"].has_credential and rows["123456"].confidence == 0.6
    assert rows[None].confidence == 0.0 and rows[None].matches == []


def test_bad_rules_are_rejected(texts):
    with pytest.raises(ValueError, match="empty string"):
        detect(texts(["a"]), rules={"any": "x*"})
    with pytest.raises(ValueError, match="flags"):
        detect(texts(["a"]), rules=[Rule("v1", "a", 256)])
    with pytest.raises(ValueError, match="empty string"):
        detect(texts(["ab"]), rules={"ahead": "(?=a)|b"}).collect()


def test_matches_any_rule_agrees_with_spans(texts):
    df = texts([*FLAGGED, *HARMLESS])
    flagged = {r.text for r in df.where(matches_any_rule(F.col("text"))).collect()}
    assert flagged == {r.text for r in match_spans(df).collect()} == set(FLAGGED)


def test_rules_survive_json(spark, texts):
    path = scratch_path(spark, "rules")
    artifacts.write_rules(rules_table(spark), path)
    read = artifacts.read_rules(spark, path)
    assert read.orderBy("ord").collect() == rules_table(spark).orderBy("ord").collect()
    df = texts([*FLAGGED, *HARMLESS])
    assert results(df, rules=read) == results(df)


def test_rules_json_forms(spark):
    value = '{"z": {"pattern": "a\\\\d", "flags": 2}, "b": "{x}", "n": 5, "o": {"flags": 1}, "l": ["q"], "a": {"pattern": "p"}}'
    rows = artifacts.rules_from_json(spark.createDataFrame([(value,)], "value STRING")).orderBy("ord").collect()
    assert [(r.rule, r.pattern, r.flags) for r in rows] == [("z", "a\\d", 2), ("b", "{x}", 0), ("a", "p", 0)]


def test_loader_without_artifacts_finds_nothing(spark, texts):
    detector = load_detector(spark, scratch_path(spark, "none"))
    assert detector == Detector([], None, 0.7)
    assert not any(r.has_credential for r in detector.detect(texts(list(FLAGGED))).collect())


def test_exported_results(spark, texts):
    path = scratch_path(spark, "results")
    export_results(Detector(list(DEFAULT_RULES)), texts(["password=Password123!", "ação"]), path)
    rows = {r.text: r for r in spark.read.json(path).collect()}
    assert rows["ação"].matches == [] and rows["ação"].has_credential is False
    position = rows["password=Password123!"].match_positions[0]
    assert (position.start, position.end, position.type) == (0, 21, "password")


def test_rules_without_width_or_of_one_name_are_rejected(texts):
    for pattern in (r"\b", "^", "(?=a)", "x*"):
        with pytest.raises(ValueError, match="matches the empty string"):
            detect(texts(["a"]), rules={"bad": pattern})
    with pytest.raises(ValueError, match="same name: twice"):
        detect(texts(["a"]), rules=[Rule("twice", "a"), Rule("twice", "b")])


def test_columns_by_the_names_of_results_are_replaced(texts):
    rows = texts(["senha: abcdef1", "none"]).withColumns(
        {"confidence": F.lit("old"), "score_text": F.lit(1), "Matches": F.lit(2), "text_chars": F.lit(3)}
    )
    found = detect(rows, score=lambda df: df.withColumn("confidence", F.lit(0.9)))
    assert found.columns == ["id", "text", "has_credential", "confidence", "matches", "match_positions"]
    assert sorted((r.id, r.confidence) for r in found.collect()) == [(0, 1.0), (1, 0.9)]


def test_mask_and_stats(texts):
    from keysift.operators.detect import mask_flagged, rule_stats

    rows = texts(["my senha: abcdef1 and senha: abcdef2", "none", None])
    assert {r.id: r.masked for r in mask_flagged(rows).collect()} == {
        0: "my [password] and [password]", 1: "none", 2: None
    }
    assert [tuple(r) for r in rule_stats(rows, "id").collect()] == [("password", 2, 1)]
