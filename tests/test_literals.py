"""Literals of patterns: what they are, and that no match is lost by testing them first."""

import random
import re

import pytest
from pyspark.sql import functions as F

from checks.queries import CUSTOM_RULES
from keysift.functions.literals import MOST, required
from keysift.operators.detect import detect, matches_any_rule
from keysift.operators.rules import ASCII, DEFAULT_RULES, IGNORECASE, VERBOSE, Rule, as_rules, check_rules


@pytest.mark.parametrize(
    "pattern, expected",
    [
        (r"test_secret=(\w+)", {"test_secret="}),
        (r"API_KEY=\w+", {"api_key="}),
        (r"\w+ ?= ?\"\w+\"", {'="', '= "'}),
        (r"\d+\.\d+", {"."}),
        (r"(?:ab|cd)x?ef", {"abef", "abxef", "cdef", "cdxef"}),
        (r"(?:foo|ba[rz])+!", {"foo", "bar", "baz"}),
        (r"[$]{3}", {"$$$"}),
        (r"a{2,}b", {"aa"}),
        (r"(?:long)?x", {"x"}),
        (r"^\bkey\b$", {"key"}),
        (r"a(?=b)c", {"ac"}),
        (r"(\w)-\1-end", ()),  # an escape with a digit
        (r"x|\d", ()),
        (r"\d*", ()),
        (r"", ()),
        (r"[a-z]+", ()),
        (r"[a[bc]]x", ()),
        (r"[ab&&[b]]x", ()),
        (r"\Qa.b\E", ()),
        (r"a\vb", ()),
        (r"\p{Lu}x", ()),
        (r"(?x) a b", ()),
        (r"é", ()),
        (r"café=1", {"caf"}),
        (r"(unclosed", ()),
    ],
)
def test_literals_of_patterns(pattern, expected):
    assert set(required(pattern)) == set(expected)


def test_literals_without_case():
    assert set(required("disk", ignore_case=True, all_unicode=False)) == {"disk"}
    # The long s and two forms of i fold to these letters in Java.
    assert set(required("(?i)disk")) == {f"d{i}{s}k" for i in ("i", "ı", "i̇") for s in "sſ"}
    assert set(required("(?i:KEY)=A")) == {"key=a"}
    assert required("a b", free_spacing=True) == ()
    assert all(len(required("(?i)" + "s" * n)) <= MOST for n in range(40))
    assert Rule("r", "abc", VERBOSE).literals() == ()
    assert Rule("r", "i", IGNORECASE | ASCII).literals() == ("i",)
    assert all(rule.literals() == rule.needles for rule in DEFAULT_RULES)


ALPHABET = "abikS=.1 ſıİKé\n"


def random_pattern(chosen: random.Random, depth: int = 0) -> str:
    parts = []
    for _ in range(chosen.randrange(1, 4)):
        kind = chosen.randrange(9 if depth < 3 else 5)
        if kind < 3:
            part = re.escape(chosen.choice(ALPHABET[:9]))
        elif kind == 3:
            part = chosen.choice([".", r"\w", r"\d", "[ab]", "[^a]", "[i-k]", "[s=]", r"[\s.]", "S", "é"])
        elif kind == 4:
            part = chosen.choice(["ab", "ik", "sS", "k1", "is="])
            part = f"(?:{part})"
        elif kind == 5:
            part = f"(?:{random_pattern(chosen, depth + 1)}|{random_pattern(chosen, depth + 1)})"
        elif kind == 6:
            part = f"(?i:{random_pattern(chosen, depth + 1)})"
        elif kind == 7:
            part = f"({random_pattern(chosen, depth + 1)})"
        else:
            part = chosen.choice(["(?=a|b)", r"\b", "(?!k)", "^"]) + random_pattern(chosen, depth + 1)
        if chosen.random() < 0.4 and not part.startswith(("^", "\\b", "(?=", "(?!")):
            part += chosen.choice(["?", "*", "+", "{2}", "{1,2}", "+?", "{2,}", "*+"])
        parts.append(part)
    return "".join(parts)


@pytest.mark.parametrize("seed", range(4))
def test_no_match_is_lost(spark, seed):
    chosen = random.Random(seed)
    rules = [
        Rule(f"r{i}", random_pattern(chosen), chosen.choice([0, IGNORECASE, ASCII, IGNORECASE | ASCII]))
        for i in range(60)
    ]
    texts = ["".join(chosen.choices(ALPHABET, k=chosen.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    lowered = F.lower("text")
    tests = [
        F.struct(F.col("text").rlike(r.java_pattern()).alias("hit"), r.may_match(lowered).alias("may"))
        for r in rules
    ]
    counted = [F.count_if(t["hit"] & ~t["may"]).alias(f"lost{i}") for i, t in enumerate(tests)]
    counted += [F.count_if(~t["may"]).alias(f"spared{i}") for i, t in enumerate(tests)]
    row = df.agg(*counted).first()
    lost = [(rules[i].java_pattern(), rules[i].literals(), row[f"lost{i}"]) for i in range(60) if row[f"lost{i}"]]
    assert not lost
    assert sum(row[f"spared{i}"] > 0 for i in range(60)) >= 20


def test_custom_rules_test_literals_first(spark, texts):
    rules = as_rules(CUSTOM_RULES)
    assert all(rule.literals() for rule in rules)
    df = texts(["nothing here", 'a = "b"', 'a= "b"', "at 1.2.3.4.", "1.2.3", '= "'])
    plan = df.where(matches_any_rule(F.col("text"), CUSTOM_RULES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") == 3 and plan.lower().count("rlike") == 2
    found = {r.text: r.has_credential for r in detect(df, rules=CUSTOM_RULES).collect()}
    assert [found[t] for t in ("nothing here", 'a = "b"', 'a= "b"', "at 1.2.3.4.", "1.2.3", '= "')] == [
        False, True, True, True, False, False,
    ]


def test_rules_with_the_same_literals(spark, texts):
    rules = {"a": r"key=\d+", "b": r"key=[a-f]+", "c": r"\d{9}"}
    check_rules(spark, as_rules(rules))
    values = ["KEY=1", "key=1", "key=b", "key=x", "123456789", "x", "", None]
    matched = {r.text: r.m for r in texts(values).select("text", matches_any_rule(F.col("text"), rules).alias("m")).collect()}
    assert matched == {t: None if t is None else bool(re.search(r"key=\d+|key=[a-f]+|\d{9}", t)) for t in values}
