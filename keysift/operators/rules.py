"""Rule sets for the regex scan: the default catalogue, flags, and rules as a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.functions.literals import holds_any, required

# Flag bits of the Python ``regex`` module, as written in exported rule files.
IGNORECASE, MULTILINE, DOTALL, UNICODE, VERBOSE, ASCII, VERSION0 = 2, 8, 16, 32, 64, 128, 8192

RULE_SCHEMA = "ord INT, rule STRING, pattern STRING, flags INT"


@dataclass(frozen=True)
class Rule:
    """One named pattern with Python flag bits.

    ``needles`` are lowercase literals of which any match must hold at least one, up to case. They are a
    cheap test before the regex. Where none are given, they are derived from the pattern; a rule whose
    pattern has none either runs its regex on every text.
    """

    name: str
    pattern: str
    flags: int = 0
    needles: tuple[str, ...] = ()

    def java_pattern(self) -> str:
        """The pattern with its flags inlined, reading like Python's regex.

        ``d`` makes newline the only line end for ``.``, ``^`` and ``$``; ``U`` makes ``\\w``, case
        folding and the like cover all of Unicode, unless the rule asks for ASCII.
        """
        known = IGNORECASE | MULTILINE | DOTALL | UNICODE | VERBOSE | ASCII | VERSION0
        if self.flags & ~known:
            raise ValueError(f"rule {self.name!r} uses unsupported flags {self.flags & ~known}")
        letters = "d" if self.flags & ASCII else "dU"
        for bit, letter in ((IGNORECASE, "i"), (MULTILINE, "m"), (DOTALL, "s"), (VERBOSE, "x")):
            letters += letter if self.flags & bit else ""
        return f"(?{letters}){self.pattern}"

    def literals(self) -> tuple[str, ...]:
        """The needles, or else what the pattern says that any match must hold."""
        flags = self.flags
        return self.needles or required(
            self.pattern, bool(flags & IGNORECASE), not flags & ASCII, bool(flags & VERBOSE)
        )

    def may_match(self, lowered: Column) -> Column:
        """False only where the rule cannot match; takes the lowercased text."""
        return holds_any(lowered, self.literals()) if self.literals() else F.lit(True)


# Separator and optional opening quote between a keyword and its value.
_SEP = r"[ \t]*[=:]"
_OPEN = r"[ \t]*[\"\x27]?"

# Our own catalogue. No lookaround, \b, \s or \w, so that engines agree on every match.
DEFAULT_RULES = (
    Rule("api_key", rf"(?i)api[_-]?key{_SEP}{_OPEN}[a-z0-9_\-]{{16,}}", ASCII, ("api",)),
    Rule(
        "password",
        rf"(?i)(?:password|passwd|pwd|senha)[ \t]*(?:=|:|é){_OPEN}[^ \t\r\n\"\x27]{{6,}}",
        ASCII,
        ("passw", "pwd", "senha"),
    ),
    Rule("aws_access_key", r"AKIA[0-9A-Z]{16,}", ASCII, ("akia",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", ASCII, ("eyj",)),
    Rule(
        "token",
        rf"(?i)(?:(?:access|auth|refresh)[_-]?)?token{_SEP}{_OPEN}[a-z0-9_\-.]{{16,}}",
        ASCII,
        ("token",),
    ),
    Rule("bearer", r"(?i)bearer[ \t]+[a-z0-9_\-.=]{16,}", ASCII, ("bearer",)),
    Rule(
        "client_secret",
        rf"(?i)(?:client[_-]?secret|secret[_-]?key){_SEP}{_OPEN}[a-z0-9_\-]{{16,}}",
        ASCII,
        ("secret",),
    ),
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----",
        ASCII,
        ("private key-----",),
    ),
)


def as_rules(rules: Mapping[str, str] | Iterable[Rule] | DataFrame | None) -> list[Rule]:
    """Accept a ``{name: pattern}`` mapping, rules, a rule table, or None for the default catalogue.

    Given rules replace the default ones. A rule set is configuration, a handful of rows that end
    up as literals in the plan, so a rule table is collected here. Names must differ: a match is told
    by the name of its rule.
    """
    found = _listed(rules)
    names = [rule.name for rule in found]
    twice = sorted({name for name in names if names.count(name) > 1})
    if twice:
        raise ValueError(f"rules of the same name: {', '.join(twice)}")
    return found


def _listed(rules: Mapping[str, str] | Iterable[Rule] | DataFrame | None) -> list[Rule]:
    if rules is None:
        return list(DEFAULT_RULES)
    if isinstance(rules, DataFrame):
        rows = rules.orderBy("ord").select("rule", "pattern", "flags").collect()
        needles = {(rule.pattern, rule.flags): rule.needles for rule in DEFAULT_RULES}
        return [
            Rule(r.rule, r.pattern, r.flags, needles.get((r.pattern, r.flags), ())) for r in rows
        ]
    if isinstance(rules, Mapping):
        return [Rule(name, pattern) for name, pattern in rules.items()]
    return list(rules)


# Texts with borders of words, lines, digits and letters.
PROBES = ("", "a", " a b1.\n\n_=\"é\" A-9\tz")


def check_rules(spark: SparkSession, rules: list[Rule]) -> None:
    """Reject patterns the engine cannot compile, and those that match no characters in some probe:
    the empty string, and texts with borders of words and lines."""
    if not rules:
        return

    def without_width(rule: Rule, probe: str) -> Column:
        found = F.regexp_extract_all(F.lit(probe), F.lit(rule.java_pattern()), F.lit(0))
        return F.array_contains(found, "")

    tests = [
        reduce(lambda a, b: a | b, [without_width(rule, probe) for probe in PROBES]) for rule in rules
    ]
    matched = spark.range(1).select(F.array(*tests)).first()[0]
    for rule, empty in zip(rules, matched):
        if empty:
            raise ValueError(f"rule {rule.name!r} matches the empty string")


def rules_table(spark: SparkSession, rules=None) -> DataFrame:
    """The rule set as a table ``(ord, rule, pattern, flags)``."""
    rows = [(i, r.name, r.pattern, r.flags) for i, r in enumerate(as_rules(rules))]
    return spark.createDataFrame(rows, RULE_SCHEMA)
