"""op11 to op13 against brute force, hand-made cases and held-out labels."""

import os
import re
import sys
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablelens.llm import filter_audit, op_queries, toxicity, variants  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, part string, score double"

WORDS = "[^\\x20\\x09-\\x0D]+"


def doc_rows(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", "y", 0.5) for d, t, s in rows], DOCS)


LONG = " ".join(f"wörd{i % 70}x plain" for i in range(40_000))
AWKWARD = [
    (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one", ""), (5, "Shout LOUD NOW", "a"), (6, "a | b", "b"),
    (7, "same words here", "b"), (7, "same words here", "b"), (8, "same words here", None), (9, LONG, "a"),
    (None, "same words here", "b"), (None, "only without id", "b"), (None, "only without id", "b"), (10, LONG, "b"),
    (11, " ".join(f"w{i}" for i in range(60)), "c"), (12, " ".join(f"w{i}" for i in range(60)), "c"),
    (13, "ÀÉ straße naïve Naïve NAÏVE naive", "c"), (2**63 - 1, "same words here", "c"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return doc_rows(spark, AWKWARD)


# --- op12 --------------------------------------------------------------------------------------------------------

def brute_audit(rows, labels):
    last = 1 << 63
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", last), last if d is None else d)
    found = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(WORDS, t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": first[t] < (last if d is None else d)}
        found.append((s or "", fails, *labels.get(d, (0, 0))))
    out = {}
    for part in {f[0] for f in found}:
        own = [f for f in found if f[0] == part]
        totals = Counter()
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                alive = [f for f in own if not any(f[1][y] for y in order[:k])]
                gone = [f for f in alive if f[1][x]]
                totals[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(alive) - len(gone), len(gone), sum(f[1][x] for f in own) - len(gone),
                    sum(f[1][x] and sum(f[1].values()) == 1 for f in own), sum(f[2] for f in gone),
                    sum(f[3] for f in gone), x]
        for key, row in out.items():
            if key[0] == part:
                row[6] = totals[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def audit_of(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_audit_awkward(spark, awkward):
    labels = spark.createDataFrame([(5, 1, 0, "x"), (5, 0, 1, "x"), (8, 1, None, "x"), (None, 1, 1, "x"), (7, 0, 1, "x"),
                                    (99, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    got = audit_of(filter_audit.audit(awkward, labels))
    assert got == brute_audit(AWKWARD, {5: (1, 1), 8: (1, 0), 7: (0, 1)})


def test_audit_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = {r["doc_id"]: (int(r["quality"] == 1), int(r["toxic"] == 1))
              for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert audit_of(op_queries.op12_filter_interaction_audit(spark, SF)) == brute_audit(rows, labels)


def test_audit_empty(spark, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(awkward.limit(0), labels).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 2048, 2049, 12_345])
def test_popcounts(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert filter_audit.popcounts(words).tolist() == [int((words >> b & 1).sum()) for b in range(32)]


def test_truth_word():
    for failed in range(32):
        word = filter_audit.truth_word(failed)
        assert all((word >> s & 1) == (not s & failed) for s in range(32))


# --- op13 --------------------------------------------------------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, every=97):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % every == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    beside = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and near(v, w)] for w in n}
    best = {w: min(b, key=lambda v: (-n[v], v)) for w, b in beside.items() if b}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n[w], len(beside[w]), n[form[w]] if w in form else -1) for w in n)


def variants_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"])
                  for r in df.collect())


def test_variants_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert variants_of(op_queries.op13_spelling_variant_grouping(spark, SF)) == brute_variants(rows)


@pytest.mark.parametrize("every", [97, 3])
def test_variants_awkward(spark, awkward, every):
    got = variants_of(variants.group_variants(awkward, every=every))
    assert got == brute_variants(AWKWARD, every) and got


def test_variants_empty(spark, awkward):
    assert variants.group_variants(awkward.limit(0)).count() == 0


def test_variants_are_not_broadcast(spark):
    """A table of words looks small in its files; what is made of it must not go to the driver."""
    words = spark.createDataFrame([("abcde", 9), ("abcdf", 3), ("other", 5)], "word string, n long")
    for made in (variants.near_pairs(words), variants.forms(words)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_variants_dense(spark):
    """Few letters, many repeated bigrams, long paths to the root."""
    rng = np.random.default_rng(3)
    words = ["".join("abé"[i] for i in rng.integers(0, 3, rng.integers(5, 9))) for _ in range(250)]
    words += ["banana", "bananna", "baanana", "ananas", "anananas", "aaaaa", "aaaaaa", "aaaaaaa"]
    rows = [(i, " ".join([w] * int(2 ** rng.integers(2, 9))), "s") for i, w in enumerate(words)]
    got = variants_of(variants.group_variants(doc_rows(spark, rows)))
    assert got == brute_variants(rows)
    assert any(root != form != "" for _, form, root, *_ in got)


def test_pivots():
    counts = Counter()
    words = ["banana", "aaaaaa", "straße", "abcde", "mississippi"]
    for w in words:
        counts.update(w[i:i + 2] for i in range(len(w) - 1))
    for w in words:
        grams = variants.prefix(w, counts)
        a, b = variants.pivots(grams)
        assert b[2] - a[2] >= 2 and {a, b} <= set(grams)
        assert a[0] + b[0] == min(x[0] + y[0] for x in grams for y in grams if y[2] - x[2] >= 2)


def test_short_words_refused(awkward):
    with pytest.raises(ValueError):
        variants.group_variants(awkward, letters=3)


# --- op11 --------------------------------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_automaton_against_distances():
    whole = ["abcba", "abccba", "aabbccaabb", "cab", "abcabcabca"]
    terms = [toxicity.Term(t, False, (3.0, 2.0, 1.0)) for t in whole]
    terms += [toxicity.Term("bbcc", True, (3.0, 2.0, 1.0)), toxicity.Term("cccabba", True, (3.0, 2.0, 1.0))]
    matcher = toxicity.Matcher(terms)
    rng = np.random.default_rng(1)
    words = ["".join("abc"[i] for i in rng.integers(0, 3, rng.integers(1, 13))) for _ in range(1500)]
    words += whole + [w[:3] + w[4:] for w in whole] + ["bbccabc", "cccabbaabc", "ccabbaabc", "cccabb"]
    hits = 0
    for w in words:
        expected = min(((d, k) for k, t in enumerate(terms) for d in [
            min(distance(w[:j], t.text) for j in range(len(w) + 1)) if t.open else distance(w, t.text)]
            if d <= t.edits), default=None)
        assert matcher.match(w) == expected, w
        hits += expected is not None
    assert hits > 20


def test_context():
    matcher = toxicity.Matcher([toxicity.Term("dummox", False, (8.0, 5.0, 3.0))])

    def factors(text):
        return [h.factor for h in toxicity.hits(text, matcher)]

    assert factors("a dummox at work, Dumm0x!") == [toxicity.PLAIN] * 2
    assert factors('he wrote of it: "dummox" at most') == [toxicity.QUOTED]
    assert factors("er las „dummox“ vor") == [toxicity.QUOTED]
    assert factors("the word dummox is old") == [toxicity.QUOTED]
    assert factors("you dummox") == [toxicity.ADDRESSED]
    assert factors('"x" dummox') == [toxicity.PLAIN]
    assert [h.edits for h in toxicity.hits("dumox dummmox dammox dimmax", matcher)] == [1, 1, 1]
    assert toxicity.hits("x", toxicity.Matcher([])) == []


@pytest.fixture(scope="module")
def learned(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.learn(docs, labels)


def test_toxicity_held_out(learned):
    docs, labels, model = learned
    rows = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    caught = [r["predicted"] for r in held if r["toxic"]]
    clean = [r["predicted"] for r in held if not r["toxic"]]
    assert sum(caught) / len(caught) > 0.9 and sum(clean) / len(clean) < 0.01


def test_toxicity_labels_held_back(spark, learned):
    """Held-out labels change nothing."""
    docs, labels, model = learned
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    again = toxicity.learn(docs, turned)
    assert again.terms == model.terms and again.exceptions == model.exceptions
    assert np.allclose(again.weights, model.weights, atol=1e-6)


def test_toxicity_misspelled_and_quoted(spark, learned):
    model = learned[2]
    rows = [(1, "onan the idiot hest", "s"), (2, "onan the idi0t hest", "s"), (3, "onan the worthlss hest", "s"),
            (4, 'onan the "idiot" hest', "s"), (5, "onan the hest", "s"), (6, None, "s"), (None, "", "s"),
            (7, LONG + " moron and scum", "s"), (7, LONG, "s")]
    got = toxicity.score(doc_rows(spark, rows), model).collect()
    assert [(r["doc_id"], r["predicted"]) for r in got] == [
        (1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (None, 0), (7, got[7]["predicted"]), (7, 0)]
    assert got[7]["score"] > got[8]["score"] and all(0 <= r["score"] <= 1 for r in got)
    found = toxicity.matches(doc_rows(spark, rows), model).filter("doc_id = 2").collect()
    assert [(r["start"], r["end"], r["term"], r["edits"]) for r in found] == [(9, 14, "idiot", 1)]


def test_toxicity_without_labels(spark, awkward):
    for rows, expected in [([], 0.0), ([(1, 0), (2, None), (None, 1)], 0.0), ([(1, 1), (3, 1), (6, 1)], 1.0)]:
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        scores = [r["score"] for r in toxicity.score(awkward, toxicity.learn(awkward, labels)).collect()]
        assert len(scores) == len(AWKWARD) and set(scores) == {expected}
    assert toxicity.score(awkward.limit(0), toxicity.Model()).count() == 0
    both = spark.createDataFrame([(i, i % 2) for i in range(14)], "doc_id long, toxic int")
    assert toxicity.score(awkward, toxicity.learn(awkward, both)).count() == len(AWKWARD)
