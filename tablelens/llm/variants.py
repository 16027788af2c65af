"""Spelling variants: frequent words one edit apart, grouped under their most frequent form.

``count_words`` takes the words of all texts; ``near_pairs`` is a similarity
join at edit distance one by *pivotal grams*; ``forms`` gives every word its
most frequent near word and follows those to a root.

The join.  The bigrams of a word are ordered from rare to frequent (counts
over the whole vocabulary).  Its *prefix* is the first three of them, with all
that tie with the third, and its two *pivots* are the disjoint pair of prefix
bigrams that is rarest together, found by dynamic programming.  One edit
spoils at most two bigrams, and only one of two disjoint ones, so of two near
words the one whose prefix ends earlier in the order keeps a pivot that the
other has in its prefix.  Pivots are therefore matched with prefixes only.

The position limit is as sharp as one edit allows: it lies on one side of the
pivot that is kept, so the letters on the other side, up to and with the pivot,
agree one by one.  Those letters, which side they are on and the length of
the word (one more, one less, or equal) are the join key.  What meets and has
much the same letters is verified by the edit distance itself.  No list of candidates is kept for a
bigram, and no word meets all others that share a frequent one.

All joins here are of tables that grow with the vocabulary and go through a
shuffle (``shuffled``).  Spark would guess a side's size from a compressed file
of words, of which every word makes many keys, and send it to the driver.

Edge cases: a NULL or empty text has no words; a NULL id counts as an empty one
in the check sum that spoils runs; repeated rows and rows that share an id count
each; an empty table gives an empty result; other columns are not read.  Ties
between forms go to the word first in code point order.  Very long texts
are taken run by run.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, map_batches, store

RUN = re.compile("[a-zÀ-ÿ]+")
SPOILED_EVERY = 97
MIN_LETTERS = 5
MIN_COUNT = 3

#: Bigrams that one edit can spoil, and disjoint bigrams of which one survives it.
SPOILED, PIVOTS = 2, 2

#: A text of more bytes is read run by run; a task passes its counts on at so many words.
LONG_TEXT, HELD_WORDS = 1 << 20, 1 << 17

_SCHEMA = pa.schema([("word", pa.string()), ("n", pa.int64())])


def spoil(doc_id: str, run: str, every: int = SPOILED_EVERY) -> str:
    """``run`` without one code point if the check sum of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _words(batches: Iterator[pa.RecordBatch], every: int, letters: int) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
                                         schema=_SCHEMA)
        seen.clear()
        return out

    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1))):
            text = raw.lower().decode("utf-8", "replace")  # bytes: A-Z only
            runs = RUN.findall(text) if len(raw) < LONG_TEXT else (m[0] for m in RUN.finditer(text))
            for run, n in Counter(runs).items():
                if len(run) >= letters and len(word := spoil(doc_id or "", run, every)) >= letters:
                    seen[word] += n
            if len(seen) >= HELD_WORDS:
                yield flush()
    yield flush()


def count_words(docs: DataFrame, every: int = SPOILED_EVERY, letters: int = MIN_LETTERS,
                least: int = MIN_COUNT) -> DataFrame:
    """word and n: the words of ``letters`` or more code points with ``least`` or more occurrences in all texts.

    Every task adds up its words before they are shuffled, so a word in every
    text costs a few rows a task.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (map_batches(rows, lambda b: _words(b, every, letters), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Occurrences of every bigram in the vocabulary; at most 90 * 90 of them, the squares of the alphabet."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    return dict(map(tuple, words.select(F.explode(grams).alias("g")).groupBy("g").count().collect()))


def prefix(word: str, counts: dict[str, int]) -> list[tuple[int, str, int]]:
    """(count, bigram, place) of the rarest bigrams: as many as hold one that any edit leaves, and ties with the last."""
    grams = sorted((counts[g], g, at) for at in range(len(word) - 1) for g in [word[at:at + 2]])
    last = SPOILED  # SPOILED * 1 edit + 1 bigrams, counted from 0
    end = last + 1
    while end < len(grams) and grams[end][:2] == grams[last][:2]:
        end += 1
    return grams[:end]


def pivots(grams: list[tuple[int, str, int]], wanted: int = PIVOTS) -> list[tuple[int, str, int]]:
    """The ``wanted`` disjoint bigrams of a prefix with the least sum of counts, by dynamic programming over places."""
    placed = sorted(grams, key=lambda g: g[2])
    best: list[list[tuple[int, list[tuple[int, str, int]]] | None]] = [[(0, [])] + [None] * wanted]
    for i, g in enumerate(placed):
        row = list(best[-1])
        before = next((j for j in range(i, 0, -1) if placed[j - 1][2] <= g[2] - 2), 0)
        for k in range(1, wanted + 1):
            if (old := best[before][k - 1]) is not None:
                new = (old[0] + g[0], old[1] + [g])
                if row[k] is None or new < row[k]:
                    row[k] = new
        best.append(row)
    return best[-1][wanted][1]


def odd_letters(word: str) -> int:
    """Bits of the letters that occur an odd number of times (63 bits, shared by letters with one remainder).

    An edit changes at most two of them, a quick test before the edit distance.
    """
    bits = 0
    for letter in word:
        bits ^= 1 << ord(letter) % 63
    return bits


def _sides(word: str, at: int) -> tuple[tuple[str, str], tuple[str, str]]:
    return ("l", word[:at + 2]), ("r", word[at:])


def _keys(batches: Iterator[pa.RecordBatch], counts: dict[str, int], probe: bool) -> Iterator[pa.RecordBatch]:
    """Index keys of the prefix of each word, or probe keys of its pivots: side, letters, length."""
    for batch in batches:
        out: dict[str, list] = {"side": [], "part": [], "length": [], "word": [], "n": [], "odd": []}
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams = prefix(word, counts)
            lengths = (len(word) - 1, len(word), len(word) + 1) if probe else (len(word),)
            keys = dict.fromkeys((side, part, size) for _, _, at in (pivots(grams) if probe else grams)
                                 for side, part in _sides(word, at) for size in lengths)
            odd = odd_letters(word)
            for side, part, size in keys:
                for column, value in zip(out.values(), (side, part, size, word, n, odd)):
                    column.append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("side", pa.string()), ("part", pa.string()), ("length", pa.int32()), ("word", pa.string()),
            ("n", pa.int64()), ("odd", pa.int64())]))


def _keyed(words: DataFrame, counts: dict[str, int], probe: bool, name: str) -> DataFrame:
    schema = "side string, part string, length int, word string, n long, odd long"
    return (map_batches(words.select("word", "n"), lambda b: _keys(b, counts, probe), schema)
            .select(F.xxhash64("side", "part", "length").alias("key"), F.col("word").alias(name),
                    F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}")))


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` for a join by shuffle and sort, never by broadcast, however small its files look."""
    return side.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b with a < b: every two words (of four or more letters) exactly one edit apart, once.

    ``words`` holds distinct ``word`` and its count ``n``; it is read three times.
    """
    counts = gram_counts(words)
    probe, index = _keyed(words, counts, True, "p"), _keyed(words, counts, False, "i")
    alike = F.bit_count(F.col("odd_p").bitwiseXOR(F.col("odd_i"))) <= 2
    met = probe.join(shuffled(index), "key").filter(alike & (F.col("p") != F.col("i")) & (F.levenshtein("p", "i", 1) == 1))
    first = F.col("p") < F.col("i")
    return met.select(F.least("p", "i").alias("a"), F.when(first, F.col("n_p")).otherwise(F.col("n_i")).alias("n_a"),
                      F.greatest("p", "i").alias("b"),
                      F.when(first, F.col("n_i")).otherwise(F.col("n_p")).alias("n_b")).distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, form) to (word, root): from each word along forms to the last, by doubling the steps each round.

    A form is at least twice as frequent as its word, so a path is at most as
    long as the logarithm of the largest count and the rounds the logarithm of that.
    """
    now, left = links.select("word", F.col("form").alias("root")), None
    while True:
        step = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        now = cut(now.join(shuffled(step), F.col("root") == F.col("via"), "left")
                  .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        left = now.filter("moved").isEmpty()
        now = now.select("word", "root")
        if left:
            return now


def forms(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (distinct ``word`` with its count ``n``).

    The form is the near word of largest count (ties: the first in code point
    order) if it is at least twice as frequent, else NULL.
    """
    pairs = store(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"),
                                          F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    chosen = store(
        words.join(shuffled(best), "word", "left").withColumn("best_n", -F.col("best.less"))
        .withColumn("is_form", F.coalesce(F.col("best_n") >= 2 * F.col("n"), F.lit(False)))
        .select("word", F.when(F.col("is_form"), F.col("best.b")).alias("form"), "n",
                F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(F.col("is_form"), F.col("best_n")).alias("form_n")))
    ends = roots(chosen.filter("form is not null").select("word", "form"))
    return chosen.join(shuffled(ends), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, every: int = SPOILED_EVERY, letters: int = MIN_LETTERS,
                   least: int = MIN_COUNT) -> DataFrame:
    """The forms and roots of all words of ``docs`` (columns doc_id and text)."""
    if letters < 4:
        raise ValueError("words of under four letters have too few bigrams for two disjoint ones")
    return forms(store(count_words(docs, every, letters, least)))
