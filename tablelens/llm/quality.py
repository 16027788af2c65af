"""Quality rules by weak supervision.

Every rule looks at one property of a document and votes *good* (+1), *bad*
(-1) or abstains.  Nothing labels the documents: an expectation-maximisation
run over the votes of the whole corpus estimates the share of good documents
and the accuracy of each rule, that is how often it votes on documents of
either hidden quality.  A document is kept when its posterior probability
of being good reaches ``threshold`` and it passes the two base rules; a single
sign of damage need not condemn it.

The corpus enters the estimate through the count of each vote pattern.  There
are at most ``2 ** number of rules`` patterns whatever the corpus, so counts,
not documents, come to the driver.  The posterior is a sum of one weight per
rule and vote, evaluated as a column expression.

Edge cases: a NULL or empty text has no words, fails the base rules and is not
kept; repeated rows are judged each for itself; an empty table gives an empty
result; other columns of the input are passed through by ``filter_documents``
and ignored by ``judge``.  A clashing column named ``_quality`` is replaced.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_columns, give_back, ship

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
UPPER = string.ascii_uppercase.encode()
DIGITS = string.digits.encode()
MARKS = b".!?"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_MIX = np.uint64(0x9E3779B97F4A7C15)

FEATURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_lines long, n_chars_all long, n_upper long, n_digits long, n_marks long, n_distinct long")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside a window of ``width`` words that occurs at least twice."""
    last = len(words) - width + 1
    if last < 2 or not _may_repeat(words, width):
        return 0
    grams = list(zip(*(words[i:last + i] for i in range(width))))
    seen: dict[tuple, int] = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = reach = 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + width - max(i, reach)
            reach = i + width
    return covered


def _may_repeat(words: list[bytes], width: int) -> bool:
    """False only if all windows differ: equal windows have equal rolling hashes."""
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    last = len(h) - width + 1
    rolled = h[:last].copy()
    for i in range(1, width):
        rolled *= _MIX
        rolled += h[i:last + i]
    rolled.sort()
    return bool((rolled[1:] == rolled[:-1]).any())


def repeated_lines(raw: bytes) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def _count(raw: bytes, letters: bytes) -> int:
    return len(raw) - len(raw.translate(None, letters))


def text_features(text: str | None) -> tuple[int, ...]:
    """The values of FEATURES for one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # on exactly the six ASCII blanks
    n_lines, n_dup = repeated_lines(raw)
    return (len(words), len(text) - _count(raw, BLANKS), _count(raw, SYMBOLS), n_dup, repeated_words(words), n_lines,
            len(text), _count(raw, UPPER), _count(raw, DIGITS), _count(raw, MARKS), len(set(words)))


def _feature_frames(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for texts in batches:
        yield pd.DataFrame([text_features(t) for t in texts], columns=names, dtype="int64")
    give_back()


def _features(column: str) -> Column:
    return F.pandas_udf(_feature_frames, FEATURES)(F.col(column))


@dataclass(frozen=True)
class Rule:
    """Votes ``vote`` (+1 good, -1 bad) on documents where ``fires`` holds, else abstains.

    ``belief`` holds how often it is expected to vote on bad and on good
    documents before any document is seen.
    """

    name: str
    vote: int
    belief: tuple[float, float]
    fires: Column


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def default_rules() -> list[Rule]:
    """Signs of damage vote bad, signs of running prose vote good; the limits are parameters of the operator."""
    words = F.col("n_words")
    marks, distinct = _share("n_marks", "n_words"), _share("n_distinct", "n_words")
    length, symbols = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
    capitals = _share("n_upper", "n_chars_all")
    often, mostly = (0.25, 0.005), (0.3, 0.9)
    return [
        Rule("symbols", -1, often, symbols > 0.1),
        Rule("repeated windows", -1, often, (words >= 10) & (_share("n_repeat_words", "n_words") > 0.2)),
        Rule("repeated lines", -1, often, (F.col("n_lines") >= 4) & (_share("n_dup_lines", "n_lines") > 0.3)),
        Rule("capitals", -1, often, (words >= 5) & (capitals > 0.25)),
        Rule("few different words", -1, often, (words >= 20) & (distinct < 0.3)),
        Rule("marks everywhere", -1, often, (words >= 10) & (marks > 0.8)),
        Rule("digits", -1, often, _share("n_digits", "n_chars_all") > 0.5),
        Rule("odd word length", -1, often, (words >= 10) & ((length > 12) | (length < 2))),
        Rule("sentences", 1, mostly, marks.between(0.02, 0.35) & (symbols <= 0.02) & (capitals <= 0.1)),
        Rule("varied words", 1, mostly, (distinct >= 0.45) & (symbols <= 0.02) & (capitals <= 0.1)),
    ]


@dataclass(frozen=True)
class Model:
    """Share of good documents and, by rule, the log odds that a vote of it adds."""

    prior: float
    weights: tuple[float, ...]

    def posterior(self, rules: list[Rule]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, w in zip(rules, self.weights):
            odds = odds + F.when(rule.fires, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def _log_odds(rates: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """What a vote adds; never against its own direction."""
    gain = np.log(rates[:, 1] / rates[:, 0])
    return np.where(votes > 0, np.maximum(gain, 0), np.minimum(gain, 0))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, votes: np.ndarray, beliefs: np.ndarray,
              rounds: int = 200) -> Model:
    """Expectation-maximisation over vote patterns (rows of fired 0/1 per rule) and their counts.

    Votes are independent given the class; an abstention says nothing.  The
    belief about a rule weighs as much as the documents and the belief about
    the share of good ones (0.85) as a tenth of them, so both have the same
    say at every size.  That settles rules that never meet another one and
    keeps the classes from swapping.
    """
    total = float(counts.sum())
    prior, rates = 0.85, beliefs.astype(float)
    for _ in range(rounds if total else 0):
        good = 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + patterns @ _log_odds(rates, votes))))
        mass = np.stack([(1 - good) * counts, good * counts], axis=1)
        seen = patterns.T @ mass / np.maximum(mass.sum(axis=0), 1e-300)
        new, new_prior = (seen + beliefs) / 2, (float(mass[:, 1].sum()) + 0.085 * total) / (1.1 * total)
        moved = max(float(np.abs(new - rates).max()), abs(new_prior - prior))
        prior, rates = new_prior, new
        if moved < 1e-9:
            break
    return Model(prior, tuple(float(a) for a in _log_odds(rates, votes)))


def fit(featured: DataFrame, rules: list[Rule]) -> Model:
    """Fit the label model on the vote patterns of every row."""
    names = [f"v{i}" for i in range(len(rules))]
    found = (featured.select(*[F.coalesce(r.fires, F.lit(False)).alias(n) for r, n in zip(rules, names)])
             .groupBy(*names).count().collect())
    patterns = np.array([[r[n] for n in names] for r in found], dtype=float).reshape(len(found), len(rules))
    return fit_votes(patterns, np.array([r["count"] for r in found], dtype=float),
                     np.array([r.vote for r in rules], dtype=float), np.array([r.belief for r in rules]))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _verdict(model: Model, rules: list[Rule], threshold: float) -> list[Column]:
    posterior = model.posterior(rules)
    return [base_failed().alias("base_failed"), (~base_failed() & (posterior >= threshold)).alias("kept"),
            F.round(posterior, 6).alias("quality")]


def judge(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, the features, base_failed, kept and the posterior ``quality`` of every row of ``docs``.

    The features (a few numbers a document) are checkpointed, so texts are read
    and split once for both the estimate and the verdict.
    """
    rules = rules or default_rules()
    ship(docs.sparkSession)
    featured = cut(doc_columns(docs, "doc_id", "text").select("doc_id", _features("text").alias("f"))
                   .select("doc_id", "f.*"))
    model = fit(featured, rules)
    return featured.select("*", *_verdict(model, rules, threshold))


def filter_documents(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Texts stay where they are: features are computed once for the estimate and
    once beside the text they decide on, which costs less than moving texts.
    """
    rules = rules or default_rules()
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c != "_quality"]
    model = fit(doc_columns(docs, "text").select(_features("text").alias("f")).select("f.*"), rules)
    scored = docs.select(*[F.col(f"`{c}`") for c in columns], _features("text").alias("_quality"))
    kept = scored.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "_quality.*")
    return kept.filter(_verdict(model, rules, threshold)[1]).select("row.*")
