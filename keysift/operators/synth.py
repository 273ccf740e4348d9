"""Synthetic examples, one per row of a table of ids.

Every character comes from a hash of seed, class and id. A row is the same whichever task makes it
and however often, which ``rand`` does not give when a lost partition is computed again.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alphabets and templates of the synthetic examples.
ALNUM = string.ascii_lowercase + string.ascii_uppercase + string.digits
PASSWORD_CHARS = ALNUM + "!@#$%^&*"
AWS_CHARS = string.ascii_uppercase + string.digits
JWT_CHARS = ALNUM + "_-"
JWT_HEADER = "eyJ0eXAiOiJKV1QiLCJhbGciOiJIUzI1NiJ9."
POSITIVE_TEMPLATES = [
    ['api_key="', (ALNUM, 32), '"'],
    ["password=", (PASSWORD_CHARS, 16)],
    ["AKIA", (AWS_CHARS, 16)],
    [JWT_HEADER, (JWT_CHARS, 32), ".", (JWT_CHARS, 32)],
    ['access_token="', (ALNUM, 40), '"'],
]
NEGATIVE_TEMPLATES = [
    ["Este é um exemplo de texto que não contém credenciais."],
    ["Olá, como vai você hoje?"],
    ["O clima está agradável nesta época do ano."],
    ["O valor do produto é ", (10, 1000), " reais."],
    ["Tenho ", (1, 100), " anos de idade."],
    ["ID do usuário: USER_", (100, 9999)],
    ["Código do produto: PROD-", (1000, 9999)],
    ["Visite nosso site em https://exemplo.com.br"],
    ["O documento está em https://docs.exemplo.com/pagina"],
]

# A draw is eight hex digits of the hash; an MD5 holds four.
_DRAW = 8
_DRAWS_PER_HASH = 4


def _random_digits(key: Column, draws: int) -> Column:
    blocks = range(-(-draws // _DRAWS_PER_HASH))
    return F.concat(*[F.md5(F.concat(key, F.lit(f":{block}"))) for block in blocks])


def _draw(digits: Column, index: Column, choices: int) -> Column:
    """A number in ``[0, choices)`` from the draw at ``index``."""
    part = F.substring(digits, index * _DRAW + 1, F.lit(_DRAW))
    return (F.conv(part, 16, 10).cast("bigint") % choices).cast("int")


def _random_text(digits: Column, first: int, alphabet: str, length: int) -> Column:
    picks = F.transform(
        F.sequence(F.lit(first), F.lit(first + length - 1)),
        lambda i: F.substring(F.lit(alphabet), _draw(digits, i, len(alphabet)) + 1, F.lit(1)),
    )
    return F.array_join(picks, "")


def _fill(template: list, digits: Column) -> Column:
    """Draw 0 picks the template, so its random parts start at draw 1."""
    parts, drawn = [], 1
    for part in template:
        if isinstance(part, str):
            parts.append(F.lit(part))
        elif isinstance(part[0], str):
            alphabet, length = part
            parts.append(_random_text(digits, drawn, alphabet, length))
            drawn += length
        else:
            low, high = part
            number = _draw(digits, F.lit(drawn), high - low + 1) + low
            parts.append(number.cast("string"))
            drawn += 1
    return F.concat(*parts)


def _generate(
    ids: DataFrame, key: str, seed: int, templates: list, is_credential: bool, draws: int
) -> DataFrame:
    kind = "positive" if is_credential else "negative"
    hash_key = F.concat(F.lit(f"{seed}:{kind}:"), F.col(key).cast("string"))
    drawn = ids.withColumn("_digits", _random_digits(hash_key, draws))
    digits = F.col("_digits")
    choice = _draw(digits, F.lit(0), len(templates))
    text = F.when(choice == 0, _fill(templates[0], digits))
    for i, template in enumerate(templates[1:], 1):
        text = text.when(choice == i, _fill(template, digits))
    return drawn.select(
        F.col(key),
        text.alias("text"),
        F.lit(is_credential).alias("is_credential"),
        F.lit("synthetic").alias("source"),
    )


def positive_examples(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A made-up credential per id, from one of five equally likely templates."""
    return _generate(ids, key, seed, POSITIVE_TEMPLATES, True, draws=65)


def negative_examples(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A harmless sentence per id, from one of nine equally likely templates."""
    return _generate(ids, key, seed, NEGATIVE_TEMPLATES, False, draws=2)
