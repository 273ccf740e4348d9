"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are those of a public vocabulary, fixed; each language has its own probability for each. A
word's probability in a language is the sum, over all ways to cut it into pieces, of the products of
their probabilities, which a forward pass over its characters computes. Probabilities are learned by
expectation maximisation: a forward-backward pass gives the expected count of each piece over all
segmentations of the training words of a language.

Pieces do not span words, so a text's log probability is a sum over its words, and a task computes
each distinct word once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import per_process, small_batches, stored, whole

VOCABULARY = "piece_bpe_32k.model"
ROWS_PER_LANGUAGE = 2_000
ROUNDS = 3
SMOOTHING = 0.1
START = "▁"  # marks the beginning of a word, in the vocabulary and here
LONG = 32  # letters of a word at most: longer runs, as of scripts without spaces, are several words
CACHED_WORDS = 400_000  # up to 8 languages, fewer for more
UNDETERMINED = "und"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the mark of a word's beginning."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = {p for p in found if p.lower() == p and (p == START or p.removeprefix(START).isalpha())}
    return sorted(kept | {START})


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lowered. A run of over ``LONG`` letters is cut into words of as many, in training
    and in scoring alike: no letter is left out, and no table grows with a run."""
    import regex

    return regex.findall(rf"\p{{L}}{{1,{LONG}}}", (text or "").lower())


class Lattice:
    """Pieces of words. Piece number ``unknown`` is any one character that is no piece."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.longest = max((len(p) for p in pieces), default=1)
        # The number of each piece, and -1 for what only begins one: no longer piece begins otherwise.
        self.number = {piece[:end]: -1 for piece in pieces for end in range(1, len(piece))}
        self.number.update((piece, i) for i, piece in enumerate(pieces))

    def tables(self, words: list[str]) -> np.ndarray:
        """Of words of one length, the number of the piece from each character, of each length;
        ``unknown + 1`` where there is none."""
        n, longest, get = len(START + words[0]), self.longest, self.number.get
        places, found = [], []
        for row, word in enumerate(words):
            marked, base = START + word, row * n * longest - 1
            for i in range(n):
                for j in range(i + 1, n + 1):
                    piece = get(marked[i:j])
                    if piece is None:
                        break
                    if piece >= 0:
                        places.append(base + j - i)
                        found.append(piece)
                base += longest
        table = np.full((len(words), n, longest), self.unknown + 1, np.int32)
        table.reshape(-1)[places] = found
        first = table[:, :, 0]
        first[first > self.unknown] = self.unknown
        return table

    def groups(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Words of equal length together: their places in ``words`` and their tables, stacked."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for places in by_length.values():
            for first in range(0, len(places), 4096):
                some = places[first : first + 4096]
                yield some, self.tables([words[i] for i in some])


def forward(tables: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """``alpha[word, end, language]`` of stacked tables; the last row of the probabilities is zero."""
    n_words, n, longest = tables.shape
    alpha = np.zeros((n_words, n + 1, probabilities.shape[1]))
    alpha[:, 0] = 1.0
    for start in range(n):
        for length in range(1, min(longest, n - start) + 1):
            alpha[:, start + length] += alpha[:, start] * probabilities[tables[:, start, length - 1]]
    return alpha


def backward(tables: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    n_words, n, longest = tables.shape
    beta = np.zeros((n_words, n + 1, probabilities.shape[1]))
    beta[:, n] = 1.0
    for start in range(n - 1, -1, -1):
        for length in range(1, min(longest, n - start) + 1):
            beta[:, start] += beta[:, start + length] * probabilities[tables[:, start, length - 1]]
    return beta


def log_probability(table: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Log probability per language of one word of any length."""
    with np.errstate(divide="ignore"):
        logs = np.log(probabilities)
    n, longest = table.shape
    alpha = np.full((n + 1, probabilities.shape[1]), -np.inf)
    alpha[0] = 0.0
    for end in range(1, n + 1):
        starts = np.arange(max(0, end - longest), end)
        terms = alpha[starts] + logs[table[starts, end - starts - 1]]
        top = terms.max(axis=0)
        alpha[end] = top + np.log(np.exp(terms - top).sum(axis=0))
    return alpha[n]


def word_scores(words: list[str], lattice: Lattice, probabilities: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    scores = np.zeros((len(words), probabilities.shape[1]))
    for places, tables in lattice.groups(words):
        scores[places] = np.log(forward(tables, probabilities)[:, -1])
    for i, word in enumerate(words):
        if len(word) > LONG:
            scores[i] = log_probability(lattice.tables([word])[0], probabilities)
    return scores


class Model(NamedTuple):
    """Languages, their log shares, the pieces, and the probability per piece and language. The last
    two rows are those of an unknown character and of no piece at all (zero)."""

    languages: list[str]
    priors: np.ndarray
    pieces: list[str]
    probabilities: np.ndarray


def _normalised(counts: np.ndarray) -> np.ndarray:
    smooth = counts + SMOOTHING
    return np.vstack([smooth / smooth.sum(axis=0), np.zeros((1, counts.shape[1]))])


def training_words(docs: DataFrame, counts: dict[str, int], rows_per_language: int) -> DataFrame:
    """``(lang, word, n)`` over about ``rows_per_language`` rows of each language, chosen by hash."""
    unit = F.pmod(F.xxhash64("lang_id", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    share = F.lit(None).cast("double")
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_language / n))).otherwise(share)
    chosen = docs.where(unit < share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(lang, w) for lang, text in zip(batch["lang"], batch["text"]) for w in words_of(text)]
            found = pd.DataFrame(rows, columns=["lang", "word"])
            yield found.groupby(["lang", "word"], as_index=False).size().rename(columns={"size": "n"})

    parts = chosen.select("lang", "text").mapInPandas(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(words: DataFrame, model: Model) -> np.ndarray:
    """Expected count of each piece in each language, over all segmentations of all words."""
    languages = {lang: i for i, lang in enumerate(model.languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(model.pieces)
        total = np.zeros_like(model.probabilities)
        for batch in batches:
            column = batch["lang"].map(languages).to_numpy()
            n, texts = batch["n"].to_numpy(float), batch["word"].tolist()
            for places, tables in lattice.groups(texts):
                p = model.probabilities
                alpha, beta = forward(tables, p), backward(tables, p)
                own = column[places]
                pick = np.arange(len(places))
                weight = n[places] / alpha[pick, -1, own]
                for start in range(tables.shape[1]):
                    for length in range(1, min(tables.shape[2], tables.shape[1] - start) + 1):
                        piece = tables[:, start, length - 1]
                        share = (
                            alpha[pick, start, own] * p[piece, own] * beta[pick, start + length, own]
                        )
                        np.add.at(total, (piece, own), share * weight)
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "language": lang, "n": total[piece, lang]})

    parts = words.mapInPandas(run, "piece int, language int, n double")
    sums = parts.groupBy("piece", "language").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(model.pieces) + 1, len(model.languages)))
    for row in sums:
        counts[row.piece, row.language] = row.n
    return counts


def fit(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    vocabulary: str | None = None,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    rounds: int = ROUNDS,
) -> Model:
    """Learn from rows with an id, a text and a language.

    About ``rows_per_language`` rows of each language are used, chosen by a hash of the id; that
    bounds the training. Runs of letters of any length are learned from. What reaches the driver is
    a count per piece and language. Without rows the model knows no language.
    """
    rows = docs.select(
        F.col(doc_id).alias("lang_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).dropna()
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    pieces = read_pieces(vocabulary or vocabulary_path())
    n = np.array([counts[x] for x in languages], float)
    start = np.zeros((len(pieces) + 1, len(languages)))
    model = Model(languages, np.log(n / n.sum()), pieces, _normalised(start))
    if languages:
        words = stored(training_words(rows, counts, rows_per_language), "lang-words")
        for _ in range(rounds):
            model = model._replace(probabilities=_normalised(expected_counts(words, model)))
    return model


class Scorer:
    """Scores texts, remembering the words it has seen."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.place))
        if len(self.place) > CACHED_WORDS // max(1, len(self.model.languages) // 8):
            self.place, new = {}, list(words)
            self.scores = self.scores[:0]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.scores = np.vstack([self.scores, word_scores(new, self.lattice, self.model.probabilities)])

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        found = [words_of(text) for text in texts]
        self._learn(set().union(*found))
        for words in found:
            if not words or not self.model.languages:
                yield UNDETERMINED, 0.0
                continue
            total = self.scores[list(map(self.place.__getitem__, words))].sum(axis=0)
            total = total + self.model.priors
            best = int(total.argmax())
            yield self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def with_language(
    docs: DataFrame, model: Model, *, text: str = "text", out: str = "language"
) -> DataFrame:
    """Rows of ``docs`` with a struct ``out`` of ``lang`` and ``score``, the posterior probability.

    A null text, and one without a letter, gets ``und`` and score 0, as does every text under a model
    that knows no language. Of languages alike the first by name wins. A column named ``out`` is
    replaced. Each row is scored by itself, over its whole text.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    key = uuid.uuid4().hex

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = per_process("languages", key, lambda: Scorer(Model(*shared.value)))
        for texts in batches:
            rows = []
            for first in range(0, len(texts), 1000):
                rows += scorer(texts.iloc[first : first + 1000].tolist())
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return docs.withColumn(out, run(whole(F.col(text))))
