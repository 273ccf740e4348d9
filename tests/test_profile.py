import re

from pyspark.sql import functions as F

from keysift.functions import chars, profile
from keysift.operators.profile import (
    with_char_counts,
    with_classifier_features,
    with_feature_string,
    with_profile,
)
from tests.samples import FLAGGED, HARMLESS, random_texts

SPECIALS = "!@#$%^&*()_+-=[]{}|;:,.<>?/~`"
TEXTS = [*FLAGGED, *HARMLESS, *random_texts(1500), "x", "aB", "Key ſecret paſſword", "12345678"]


def kind(c):
    if "A" <= c <= "Z":
        return "upper"
    if "a" <= c <= "z":
        return "lower"
    if "0" <= c <= "9":
        return "digit"
    return "special" if c in SPECIALS else "other"


def counts(text):
    found = {name: sum(kind(c) == name for c in text) for name in ("upper", "lower", "digit", "special")}
    return {"length": len(text), "whitespace": sum(c.isspace() for c in text), **found}


def changes(text):
    return sum(kind(a) != kind(b) for a, b in zip(text, text[1:]))


def expected_profile(text):
    n = counts(text)
    length, spaces = n["length"], n["whitespace"]
    flags = {
        "has_eq": "=" in text,
        "has_colon": ":" in text,
        "has_quotes": "'" in text or '"' in text,
        "has_password_kw": bool(re.search("(?i)password|senha|pwd", text)),
        "has_api_kw": bool(re.search("(?i)api|key|token|secret", text)),
        "has_hex": bool(re.search("(?i)[0-9a-f]{8,}", text)),
        "has_base64": bool(re.search("[A-Za-z0-9+/]{4,}={0,2}", text)),
    }
    classes = ("upper", "lower", "digit", "special")
    ratios = {f"prop_{c}": n[c] / length for c in classes}
    ratios["char_set_richness"] = sum(n[c] > 0 for c in classes) / 4
    ratios["avg_word_length"] = (length - spaces) / (spaces + 1) if spaces else length
    ratios["transition_rate"] = changes(text) / (length - 1) if length > 1 else 0
    shown = {**n, **{k: int(v) for k, v in flags.items()}, **{k: f"{v:.2f}" for k, v in ratios.items()}}
    return shown


def by_text(df, text="text"):
    return {row[text]: row for row in df.collect()}


def test_counts(texts):
    for text, row in by_text(with_char_counts(texts(TEXTS))).items():
        assert {k: row[k] for k in counts(text)} == counts(text), repr(text)


def test_transitions_and_ratios(texts):
    for text, row in by_text(with_profile(texts(TEXTS))).items():
        assert row.transitions == changes(text), repr(text)
        if text:
            assert row.transition_rate == (changes(text) / (len(text) - 1) if len(text) > 1 else 0)
            assert row.prop_upper == counts(text)["upper"] / len(text)


def test_feature_string(texts):
    rows = by_text(with_feature_string(texts(TEXTS)))
    assert rows[""].features == ""
    for text, row in rows.items():
        if not text:
            continue
        lines = row.features.split("\n")
        assert lines[0].endswith(" ") and all(line.startswith("    ") for line in lines[1:])
        assert len(lines) == 9 and not any(line.endswith(" ") for line in lines[1:])
        pairs = dict(pair.split(":") for pair in row.features.split())
        assert pairs == {k: str(v) for k, v in expected_profile(text).items()}, repr(text)


def test_feature_string_keeps_columns_of_the_same_name(spark):
    df = spark.createDataFrame([("kept", "abc")], "length STRING, text STRING")
    row = with_feature_string(df).first()
    assert row.length == "kept" and row.features.startswith("length:3 ")


def test_two_decimals_match_python(spark):
    ratios = sorted({a / b for b in range(1, 200) for a in range(b + 1)})
    df = spark.createDataFrame([(r,) for r in ratios], "r DOUBLE")
    shown = df.select("r", profile.two_decimals(F.col("r")).alias("s")).collect()
    assert all(row.s == f"{row.r:.2f}" for row in shown)


def test_is_binary(texts):
    def binary(text):
        if any(ord(c) <= 8 or 14 <= ord(c) <= 31 or ord(c) == 127 or ord(c) > 255 for c in text):
            return True
        return sum(not c.isprintable() for c in text) > len(text) * 0.1

    df = texts(TEXTS + ["a\nb", "0123456789\n", "01234567890\n"])
    rows = df.select("text", profile.is_binary(F.col("text")).alias("b")).collect()
    assert all(row.b == binary(row.text) for row in rows)
    assert {row.b for row in rows} == {True, False}


def test_classifier_features(texts):
    special = "!@#$%^&*()_+-=[]{}|;:'\"<>,.?/~`"
    for text, row in by_text(with_classifier_features(texts(TEXTS))).items():
        size = max(len(text), 1)
        assert row.length == len(text)
        assert row.has_special_chars == any(c in special for c in text)
        assert row.uppercase_ratio == sum(c.isupper() for c in text) / size, repr(text)
        assert row.digit_ratio == sum(c.isdigit() for c in text) / size, repr(text)


def test_never_classes_hold_no_member():
    upper = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), chars.NEVER_UPPER) + "]")
    digit = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), chars.NEVER_DIGIT) + "]")
    for cp in range(0x700):
        assert not (chr(cp).isupper() and upper.match(chr(cp)))
        assert not (chr(cp).isdigit() and digit.match(chr(cp)))


def test_tokenize(texts):
    def tokens(text):
        for c in SPECIALS:
            text = text.replace(c, f" {c} ")
        return text.split()

    df = texts(TEXTS)
    for row in df.select("text", profile.tokenize(F.col("text")).alias("t")).collect():
        assert row.t == tokens(row.text), repr(row.text)


def test_space_classes_match_python(spark):
    every = [chr(cp) for cp in range(0x110000) if not 0xD800 <= cp <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in every if c.isspace() or ord(c) < 0x3100], "c STRING")
    df = df.select("c", F.col("c").rlike(chars.SPACES).alias("a"), F.col("c").rlike(f"[{chars.WHITESPACE}]").alias("b"))
    assert all(r.a == r.b == r.c.isspace() for r in df.collect())


def test_char_class_and_strip(spark):
    every = [chr(cp) for cp in range(1, 0x250)]
    df = spark.createDataFrame([(c,) for c in every], "c STRING")
    assert all(r.k == kind(r.c) for r in df.select("c", chars.char_class(F.col("c")).alias("k")).collect())
    padded = spark.createDataFrame([(f"{c}a{c}b{c}",) for c in every], "c STRING")
    assert all(r.s == r.c.strip() for r in padded.select("c", chars.strip(F.col("c")).alias("s")).collect())


def test_null_text_gives_null(texts):
    row = with_profile(texts([None])).first()
    assert row.length is None and row.upper is None and row.transition_rate is None
    assert with_feature_string(texts([None])).first().features is None
