"""Toxicity: a learned lexicon, matched through misspellings and weighed by context.

*Lexicon.*  ``learn`` counts words of labelled documents, each with the two
words beside it once per label, so copies of a document add nothing.  Words and
word beginnings that toxic documents use far more often (log likelihood ratio)
become terms; of a beginning and its extensions the one with the clearest
difference stays.  A beginning that goes on in many ways is an open stem, one
that always ends alike a whole word.  Each term weighs the logarithm of how much
more often toxic documents use it.

*Matching.*  Terms form a trie.  A Levenshtein automaton (a row of edit
distances) is run along the trie: a state of the intersection is the set of trie
nodes still in reach with the edits spent, and a letter leads to the next state.
States are made when first reached and kept, so a word is read once, letter by
letter, whatever the size of the lexicon.  Short terms and stems allow no edit,
others one, long words two.  How much a misspelled match weighs is learned from
the labelled sample too; ordinary words that happen to be near a term weigh what
they weigh by themselves.

*Context.*  A match inside quotation marks, or after words that report or
mention it within its window, counts as quoted and weighs a fraction; one beside
an address of the reader weighs more.  These factors are parameters, as labels
rarely mark quotations.  A logistic model over the weighed matches of a
document, fitted on the same sample, gives the score.

Only the labelled sample (bounded by ``max_toxic`` and ``max_clean``, chosen by a
hash of the id among labelled documents that are not held out) comes to the
driver, and that as word counts and as a few numbers a document.

Edge cases: a NULL or empty text has no match and gets the score of a document
without one; a NULL id has no label and is scored; rows that repeat, or share
an id, are scored each for itself, and their label counts for each; an id with
several labels is toxic if one of them says so; without labels of both kinds
nothing is learned and every score is the base rate, 0 without labels; an empty
table gives an empty result; other columns are not read.  A very long text is
read word by word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, map_batches

#: Bounds of the labelled sample that is learned from.
MAX_TOXIC, MAX_CLEAN = 3000, 6000

#: A term differs from chance by this log likelihood ratio, is used this many times as often, and has so many letters.
MIN_RATIO, MIN_GAIN, MIN_LETTERS, MAX_TERMS = 40.0, 2.0, 4, 5000

#: Share of a match's weight by context: plain, quoted, addressed to the reader.
PLAIN, QUOTED, ADDRESSED = 1.0, 0.15, 1.25
WINDOW_WORDS, WINDOW_CHARS = 6, 80

#: Edits by letters of a whole word; a misspelling weighs at first this share of its term's weight, by edits.
EDITS = ((9, 2), (5, 1), (0, 0))
STEM_EDIT_LETTERS = 7
FUZZY_SHARE = (1.0, 0.7, 0.45)
FUZZY_EVIDENCE = 4.0

THRESHOLD = 0.7

#: Words inside which signs may stand for letters; marks around them are not part of them.
WORD = re.compile(r"[^\W_](?:[\w@$!*'’]*[^\W_])?")
END = "\0"

#: A text of more characters is read word by word, and a task keeps the matches of so many words.
LONG_TEXT, HELD_WORDS = 1 << 20, 1 << 18

#: Words that report or mention rather than use, and words that address the reader (fixed lists, lower case).
REPORTING = frozenset(
    "say says said saying call calls called quote quotes quoted quoting word words term terms insult insults slur slurs "
    "phrase means meaning wrote reported reports alleged mentioned mentions example "
    "dit disait appelé mot insulte sagt sagte wort beleidigung nannte dijo dice llamó palabra insulto".split())
ADDRESSING = frozenset("you your you're youre u ur yourself tu toi vous du dich dir ihr tú eres usted".split())
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "‚": "‘"}


def words_of(text: str) -> Iterator[str]:
    """The words of a text in lower case."""
    return (m[0] for m in WORD.finditer(text.lower())) if len(text) > LONG_TEXT else iter(WORD.findall(text.lower()))


# --- the automaton -----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Term:
    """``open``: any ending may follow.  ``weights`` by number of edits."""

    text: str
    open: bool
    weights: tuple[float, ...]

    @property
    def edits(self) -> int:
        if self.open:
            return int(len(self.text) >= STEM_EDIT_LETTERS)
        return next(k for letters, k in EDITS if len(self.text) >= letters)


class Matcher:
    """The trie of the terms crossed with a Levenshtein automaton, determinised as words reach new states.

    A state is a set of (trie node, edits spent).  Reading a letter keeps
    the nodes it leads to, those that skip or replace it, and those reached by
    leaving out letters of the term; of one node only the fewest edits stay.
    """

    MAX_STATES = 100_000

    def __init__(self, terms: list[Term], exceptions: dict[str, float] | None = None):
        self.terms, self.exceptions = terms, exceptions or {}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach: list[int] = [0]  # edits that some term below a node allows
        for k, term in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], term.edits)
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], term.edits)
            self.ends[node].append(k)
        self._forget()

    def _forget(self) -> None:
        start = self._closed({0: 0})
        self.states: list[frozenset[tuple[int, int]]] = [start]
        self.numbers = {start: 0}
        self.steps: list[dict[str, int]] = [{}]
        self.stems: list[tuple[int, int] | None] = [self._accepts(start, True)]
        self.found: dict[str, tuple[int, int] | None] = {}

    def _closed(self, spent: dict[int, int]) -> frozenset[tuple[int, int]]:
        """With the nodes reached by leaving out letters of a term."""
        queue = list(spent)
        while queue:
            node = queue.pop()
            for child in self.children[node].values():
                cost = spent[node] + 1
                if cost <= self.reach[child] and cost < spent.get(child, 99):
                    spent[child] = cost
                    queue.append(child)
        return frozenset(spent.items())

    def _next(self, state: frozenset[tuple[int, int]], letter: str) -> frozenset[tuple[int, int]]:
        spent: dict[int, int] = {}

        def put(node: int, cost: int) -> None:
            if cost <= self.reach[node] and cost < spent.get(node, 99):
                spent[node] = cost

        for node, cost in state:
            put(node, cost + 1)  # a letter too many
            for own, child in self.children[node].items():
                put(child, cost + (own != letter))
        return self._closed(spent)

    def _accepts(self, state: frozenset[tuple[int, int]], stems: bool) -> tuple[int, int] | None:
        """(edits, term) of the best term that ends here; only open ones if ``stems``."""
        return min(((cost, k) for node, cost in state for k in self.ends[node]
                    if cost <= self.terms[k].edits and self.terms[k].open >= stems), default=None)

    def _run(self, word: str) -> tuple[int, int] | None:
        at, best = 0, None
        for letter in word:
            step = self.steps[at].get(letter)
            if step is None:
                state = self._next(self.states[at], letter)
                step = self.numbers.get(state)
                if step is None:
                    step = self.numbers[state] = len(self.states)
                    self.states.append(state)
                    self.steps.append({})
                    self.stems.append(self._accepts(state, True))
                self.steps[at][letter] = step
            at = step
            stem = self.stems[at]
            if stem is not None and (best is None or stem < best):
                best = stem
            if not self.states[at]:
                return best
        whole = self._accepts(self.states[at], False)
        return whole if best is None or (whole is not None and whole < best) else best

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the nearest term, or None."""
        if word in self.found:
            return self.found[word]
        if len(self.found) >= HELD_WORDS or len(self.states) >= self.MAX_STATES:
            self._forget()
        hit = self.found[word] = self._run(word) if self.terms else None
        return hit

    def weight(self, word: str) -> float:
        """What the word says for toxic; 0 without a match."""
        hit = self.match(word)
        if hit is None:
            return 0.0
        edits, k = hit
        return self.exceptions[word] if edits and word in self.exceptions else self.terms[k].weights[edits]


# --- context -----------------------------------------------------------------------------------------------------

def quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks of one kind enclose the place within its line and window of characters."""
    before = text[max(0, start - WINDOW_CHARS):start].rsplit("\n", 1)[-1]
    after = text[end:end + WINDOW_CHARS].split("\n", 1)[0]
    for opened, closed in QUOTES.items():
        if opened == closed:
            if before.count(opened) % 2 and opened in after:
                return True
        elif before.rfind(opened) > before.rfind(closed) and closed in after:
            return True
    return False


def context_factor(text: str, start: int, end: int) -> float:
    """The share of its weight that a match keeps where it stands."""
    if quoted(text, start, end):
        return QUOTED
    before = WORD.findall(text[max(0, start - WINDOW_CHARS):start].lower())[-WINDOW_WORDS:]
    after = WORD.findall(text[end:end + WINDOW_CHARS].lower())[:WINDOW_WORDS]
    if any(w in ADDRESSING for w in before + after):
        return ADDRESSED
    return QUOTED if any(w in REPORTING for w in before) else PLAIN


@dataclass(frozen=True)
class Hit:
    """A match in a text: code points, term, edits, weight of the match and share of it kept in its context."""

    start: int
    end: int
    term: str
    edits: int
    weight: float
    factor: float


def hits(text: str, matcher: Matcher) -> list[Hit]:
    """All matches of a text that weigh something."""
    weigh = matcher.weight
    if not matcher.terms or not any(map(weigh, set(words_of(text)))):
        return []
    out = []
    for m in WORD.finditer(text):
        word = m[0].lower()
        if w := weigh(word):
            edits, k = matcher.match(word)
            out.append(Hit(m.start(), m.end(), matcher.terms[k].text, edits, w, context_factor(text, *m.span())))
    return out


def features(found: list[Hit], n_words: int) -> tuple[float, float, float]:
    """Weight of the matches in use, the largest of quoted ones, and the weight in use per hundred words."""
    used = sum(h.weight * h.factor for h in found if h.factor > QUOTED)
    mentioned = max((h.weight * h.factor for h in found if h.factor <= QUOTED), default=0.0)
    return math.log1p(used), math.log1p(mentioned), math.log1p(100 * used / max(n_words, 1))


def text_features(text: str, matcher: Matcher) -> tuple[float, float, float]:
    found = hits(text, matcher)
    return features(found, sum(1 for _ in words_of(text)) if found else 0)


# --- the model ---------------------------------------------------------------------------------------------------

@dataclass
class Model:
    """The lexicon, the weights of near words and the logistic model over ``features``."""

    terms: list[Term] = field(default_factory=list)
    exceptions: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (-math.inf, 0.0, 0.0, 0.0)

    def matcher(self) -> Matcher:
        return Matcher(self.terms, self.exceptions)

    def score(self, values: tuple[float, ...]) -> float:
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], values))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC,
                    max_clean: int = MAX_CLEAN) -> tuple[DataFrame, float]:
    """(text, toxic) of a bounded sample of labelled documents that are not held out, and the share of toxic labels.

    Of either label the ids with the smallest hashes; of rows that share an id, one.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
             .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("doc_id")]
    chosen = cut(known.filter("toxic = 1").orderBy(*order).limit(max_toxic)
                 .unionByName(known.filter("toxic = 0").orderBy(*order).limit(max_clean)))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
            .agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
            .select("text", "toxic")), (toxic or 0) / n if n else 0.0


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic to the words of each text with a check sum of the words beside them."""
    for batch in batches:
        for raw, toxic in zip(column_bytes(batch.column(0)), batch.column(1).to_pylist()):
            before, now, seen = "", "", set()
            for after in [*words_of(raw.decode("utf-8", "replace")), ""]:
                if now:
                    seen.add((now, hash_words(before, after)))
                before, now = now, after
            words, beside = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(beside, pa.int64()),
                                              pa.array([toxic] * len(seen), pa.int32())], ["word", "beside", "toxic"])


def hash_words(before: str, after: str) -> int:
    return zlib.crc32(f"{before}\n{after}".encode())


def word_uses(sample: DataFrame) -> DataFrame:
    """word, a, b: in how many different surroundings toxic and clean texts of the sample use it."""
    uses = map_batches(sample.select("text", "toxic"), _uses, "word string, beside long, toxic int").distinct()
    return uses.groupBy("word").agg(F.sum("toxic").cast("long").alias("a"),
                                    F.sum(1 - F.col("toxic")).cast("long").alias("b"))


def _gain(a: Column, b: Column, total_a: int, total_b: int) -> Column:
    """Logarithm of how much more often toxic texts use a word."""
    return F.log((a + 0.5) / (total_a + 1)) - F.log((b + 0.5) / (total_b + 1))


def mine_terms(uses: DataFrame, total_a: int, total_b: int) -> list[Term]:
    """The words and stems that toxic texts use far more often, at most MAX_TERMS, each with its weights unless misspelled."""
    word = F.concat("word", F.lit(END))
    starts = F.transform(F.sequence(F.lit(MIN_LETTERS), F.length(word)), lambda i: F.substring(word, F.lit(1), i))
    a, b = F.col("a"), F.col("b")
    expected = (a + b) * (total_a / (total_a + total_b))
    ratio = 2 * (a * F.log(F.greatest(a, F.lit(1)) / expected)
                 + b * F.log(F.greatest(b, F.lit(1)) / (a + b - expected)))
    found = (uses.filter(F.length("word") >= MIN_LETTERS).select(F.explode(starts).alias("start"), "a", "b")
             .groupBy("start").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a > 0")
             .select("start", "a", F.round(ratio, 6).alias("ratio"), _gain(a, b, total_a, total_b).alias("gain"))
             .filter((F.col("ratio") >= MIN_RATIO) & (F.col("gain") >= MIN_GAIN))
             .orderBy(F.desc("ratio"), F.desc(F.length("start")), "start").limit(10 * MAX_TERMS).collect())
    gains = {r["start"]: (r["a"], r["gain"]) for r in found}
    chosen: dict[str, float] = {}
    shadowed: set[str] = set()  # beginnings of chosen ones
    for start, (_, gain) in gains.items():
        begins = [start[:k] for k in range(MIN_LETTERS, len(start))]
        if start not in shadowed and not any(x in chosen for x in begins) and len(chosen) < MAX_TERMS:
            chosen[start] = gain
            shadowed.update(begins)
    terms = []
    for start, gain in chosen.items():
        weights = tuple(gain * share for share in FUZZY_SHARE)
        if start.endswith(END):
            terms.append(Term(start[:-1], False, weights))
        else:
            terms.append(Term(start, True, weights))
            whole = gains.get(start + END)
            if whole and 5 * whole[0] >= gains[start][0]:  # often a word by itself: misspelled as one
                terms.append(Term(start, False, weights))
    return terms


def _near(batches: Iterator[pa.RecordBatch], terms: list[Term]) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(terms)
    for batch in batches:
        rows = [(word, hit[1], hit[0], a, b) for word, a, b in zip(*(c.to_pylist() for c in batch.columns))
                if (hit := matcher.match(word)) and hit[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5,
                                            (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
            ["word", "term", "edits", "a", "b"])


def weigh_near(uses: DataFrame, terms: list[Term], total_a: int, total_b: int) -> tuple[list[Term], dict[str, float]]:
    """The terms with learned weights of misspelled matches, and the weights of ordinary words near a term."""
    near = cut(map_batches(uses.select("word", "a", "b"), lambda x: _near(x, terms),
                           "word string, term int, edits int, a long, b long"))
    ordinary = F.col("b") >= 2
    own = near.filter(ordinary).select("word", _gain(F.col("a"), F.col("b"), total_a, total_b).alias("gain")).collect()
    pooled = {(r["term"], r["edits"]): (r["a"], r["b"]) for r in near.filter(~ordinary).groupBy("term", "edits")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    weighed = []
    for k, t in enumerate(terms):
        weights = [t.weights[0]]
        for edits in range(1, len(t.weights)):
            a, b = pooled.get((k, edits), (0, 0))
            clean = FUZZY_EVIDENCE * (total_b / total_a) * math.exp(-t.weights[edits])
            gain = math.log((a + FUZZY_EVIDENCE) / total_a) - math.log((b + clean) / total_b)
            weights.append(min(gain, weights[-1]) if gain >= 1 else 0.0)
        weighed.append(Term(t.text, t.open, tuple(weights)))
    return weighed, {r["word"]: r["gain"] if r["gain"] >= 1 else 0.0 for r in own}


def _featured(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """toxic and features; a toxic text again as if all its matches were misspelled."""
    matcher = model.matcher()
    misspelled = {t.text: t.weights[1] for t in model.terms if t.edits}
    for batch in batches:
        rows = []
        for raw, toxic in zip(column_bytes(batch.column(0)), batch.column(1).to_pylist()):
            text = raw.decode("utf-8", "replace")
            found, n = hits(text, matcher), sum(1 for _ in words_of(text))
            rows.append((toxic, *features(found, n)))
            if toxic and any(h.term in misspelled for h in found):
                again = [replace(h, weight=misspelled[h.term]) for h in found if h.term in misspelled]
                rows.append((2, *features(again, n)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4,
                                            (pa.int32(), pa.float64(), pa.float64(), pa.float64()))],
            ["toxic", "f0", "f1", "f2"])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights (intercept first) of a logistic model with a ridge on all but the intercept, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(weight @ (np.logaddexp(0, z) - y * z) + v @ keep @ v / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (p - y)) + keep @ w)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """The model, from labelled rows of ``docs`` (doc_id, text) that are not held out; see the module."""
    sample, share = labelled_sample(docs, labels, max_toxic, max_clean)
    if not 0 < share < 1:
        return Model(weights=(math.inf if share else -math.inf, 0.0, 0.0, 0.0))
    sample = cut(sample)
    uses = cut(word_uses(sample))
    total_a, total_b = (x or 0 for x in uses.agg(F.sum("a"), F.sum("b")).first())
    model = Model()
    if total_a and total_b:
        model.terms, model.exceptions = weigh_near(uses, mine_terms(uses, total_a, total_b), total_a, total_b)
    table = map_batches(sample, lambda b: _featured(b, model), "toxic int, f0 double, f1 double, f2 double").collect()
    rows = np.array([tuple(r) for r in table], dtype=float).reshape(-1, 4)
    y, again = rows[:, 0] > 0, rows[:, 0] == 2
    n_toxic, n_clean = int((y & ~again).sum()), int((~y).sum())
    if not n_toxic or not n_clean:
        model.weights = (math.log(share / (1 - share)), 0.0, 0.0, 0.0)
        return model
    weight = np.where(y, share / n_toxic, (1 - share) / n_clean) * (n_toxic + n_clean)
    model.weights = fit_logistic(rows[:, 1:], y.astype(float), np.where(again, 0.25, 1.0) * weight)
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    matcher = model.matcher()
    for batch in batches:
        scores = [model.score(text_features(raw.decode("utf-8", "replace"), matcher))
                  for raw in column_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                                         ["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return (map_batches(rows, lambda b: _scored(b, model), "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def _found(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    matcher = model.matcher()
    names = ["doc_id", "start", "end", "term", "edits", "weight", "factor"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
    for batch in batches:
        rows = [(d, *astuple(h)) for d, raw in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)))
                for h in hits(raw.decode("utf-8", "replace"), matcher)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 7, types)], names)


def matches(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end (code points), term, edits, weight and context factor of every match in ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, lambda b: _found(b, model),
                       "doc_id long, start long, end long, term string, edits int, weight double, factor double")
