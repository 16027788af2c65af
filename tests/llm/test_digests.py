"""Every query against brute force over whole small tables and over awkward rows."""

import os
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from tablelens.llm import bpe, counts, licenses, neighbours, op_queries, packing, pii  # noqa: E402
from tablelens.llm import quality, secrets, simhash, suffix  # noqa: E402

SF = "/root/testdata/sf0.001"

#: Nulls, blanks, ties, repeated rows, rows that share an id, odd characters and long runs.
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One two"), (6, "é́ 日本語 🙂 \x1cx y"),
    (7, "word " * 300), (7, "word " * 300), (8, "a" * 5000), (9, "line\nline\nother\nline\n"), (10, "# * $ %"),
    (11, 'token = "abcdef123456" AKIA' + "Z" * 20 + " " + "0123456789abcdef" * 3), (12, "ſecret=abcdefg PassWord: x"),
    (13, "mail a.b@c-d.example.org, 10.0.0.256 10.0.0.255 +1 (212) 555-0199, 4111 1111 1111 1111"),
    (14, "1" * 3000 + " " + "1 2-" * 500), (15, "All rights reserved. CC BY general public  license cc-by cc by"),
    (None, "no id here, just words that are long enough to count as text"), (None, None),
    (16, "Released under the quite free MIT license"), (3, "another text with the same id"), (17, "<|endoftext|> x"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(d, t, "en", "s", len(t or ""), d, "x") for d, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "id long, spans string")


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def net(documents):
    return secrets.fit(documents[0])


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(got, expected):
    assert got == sorted(expected, key=repr)


@pytest.fixture(params=["documents", "awkward"])
def case(request, documents, awkward):
    return documents if request.param == "documents" else (awkward, AWKWARD)


def test_secrets(case, net):
    df, rows = case
    expected = []
    for d, t in rows:
        found = brute.secrets(t or "")
        expected.append((d, *[sum(k == kind for *_, k in found) for kind in secrets.KINDS],
                         brute.sha(brute.spans_text(found))))
    scanned = secrets.scan(df, net)
    same(rows_of(scanned, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), expected)
    for r in scanned.collect():
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert len([k for k in kinds if k != secrets.LEARNED]) == r["n_assign"] + r["n_access"] + r["n_hex"]


def test_quality(case):
    df, rows = case
    judged = quality.judge(df)
    same(rows_of(judged, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed"), [(d, *brute.quality(t or "")) for d, t in rows])
    assert judged.filter("kept and base_failed").count() == 0
    assert rows_of(judged.filter("kept"), "doc_id") == rows_of(quality.filter_documents(df), "doc_id")


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(case, capacity):
    df, rows = case
    path = op_queries.public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(df, path, capacity).collect()
    tokenizer = brute.word_tokenizer()
    same(sorted((tuple(r)[:5] for r in packed), key=repr),
         [p for d, t in rows for p in brute.pieces(d, t or "", tokenizer, capacity)])
    filled = defaultdict(list)
    for r in packed:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in packed)
    assert len(filled) <= max(-(-total // capacity) + 1, 1.05 * total / capacity)


def test_bpe(case):
    df, rows = case
    name = "byte_bpe_multi_50k.tiktoken"
    reference = brute.byte_tokenizer(name)
    path, pattern = op_queries.public_tokenizers.path(name), op_queries.public_tokenizers.PATTERN
    expected = []
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        expected.append((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t or "")))
    same(rows_of(bpe.round_trip(df, path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), expected)
    decoded = bpe.decode_documents(bpe.encode_documents(df, path, pattern), path)
    same(rows_of(decoded, "doc_id", "text"), [(d, t or "") for d, t in rows])


@pytest.mark.parametrize("length, gram, hot", [(100, 24, 20_000), (40, 10, 2)])
def test_repeats(case, length, gram, hot):
    df, rows = case
    same(rows_of(suffix.repeats(df, length, gram, hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
         brute.repeats(rows, length))


def test_simhash(case):
    df, rows = case
    prints = [brute.simhash(t or "") for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = brute.components(near, len(rows))
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    expected = [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, roots)]
    got = simhash.near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    same(rows_of(got, "*"), expected)
    first = [d for (d, _), r in zip(rows, roots) if d is not None and least[r] == d]
    kept = [r["doc_id"] for r in simhash.keep_first(df).collect()]
    assert sorted(d for d in kept if d is not None) == sorted(set(first))
    assert kept.count(None) == sum(d is None for d, _ in rows)
    assert simhash.keep_first(df).columns == df.columns


def test_personal_data(case):
    df, rows = case
    expected = []
    for d, t in rows:
        found = brute.personal(t or "")
        expected.append((d, *[sum(k == kind for *_, k in found) for kind in pii.KINDS],
                         brute.sha(brute.spans_text(found))))
    scanned = pii.scan(df)
    same(rows_of(scanned, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), expected)
    for r in scanned.collect():
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert len([k for k in kinds if k != pii.TERM]) == sum(r[f"n_{k}"] for k in pii.KINDS)
    masked = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect() if r["doc_id"] in (1, 13)}
    if 13 in masked and rows is AWKWARD:
        assert masked[1] is None
        assert masked[13].startswith("mail [EMAIL], 10.0.0.256 [IP] [PHONE], [CARD]")


def test_licenses(awkward):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(awkward).collect()}
    assert got[1, 0]["score"] == 0 and got[1, 0]["labels"] == "" and got[1, 0]["first_word"] is None
    r = got[15, 12]
    assert (r["n_base"], r["first_word"], r["last_word"]) == (5, 0, 10)
    assert r["base_labels"] == "cc-by,gpl,reserved" and r["score"] == 1.0
    r = got[16, 7]  # two words put in
    assert r["labels"] == "mit" and r["base_labels"] == "" and 0.6 <= r["score"] < 1
    assert licenses.scan(awkward).count() == len(AWKWARD)


def test_token_counts(spark, case, tmp_path):
    df, rows = case
    reference = brute.byte_tokenizer("byte_bpe_50k.tiktoken")
    path, pattern = op_queries.public_tokenizers.path("byte_bpe_50k.tiktoken"), op_queries.public_tokenizers.PATTERN
    rollup = counts.Rollup(spark, str(tmp_path / "rollup"))
    versions = {"words": counts.word_tokenizer, "bpe": counts.rank_tokenizer(path, pattern)}
    rollup.insert("a", counts.counted(df, versions))
    assert not rollup.insert("a", counts.counted(df, versions))
    whole = rollup.totals().groupBy("version").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"),
                                                   F.sum("n_chars").alias("c"))
    texts = [t or "" for _, t in rows]
    chars = sum(map(len, texts))
    same(rows_of(whole, "version", "d", "t", "c"),
         [("words", len(rows), sum(len(t.encode().split()) for t in texts), chars),
          ("bpe", len(rows), sum(len(reference.encode_ordinary(t)) for t in texts), chars)])
    before = rows_of(rollup.totals(), "*")
    ids = df.select("doc_id").withColumn("version", F.lit("bpe"))
    assert rollup.delete("b", ids) and rollup.totals().filter("version = 'bpe'").count() == 0
    assert not rollup.delete("b", ids)
    rollup.revise("c", counts.counted(df, {"words": lambda: lambda ts: [1] * len(ts)}))
    assert rollup.totals().agg(F.sum("n_tokens")).first()[0] == len(rows)
    base = rollup.compact()
    assert base in rollup.committed() and not rollup.insert("a", counts.counted(df, versions))
    assert rollup.totals().agg(F.sum("n_tokens")).first()[0] == len(rows)
    rollup.revise("d", counts.counted(df, versions))
    assert rows_of(rollup.totals(), "*") == before


def test_change_feed(spark, documents, tmp_path):
    df, rows = documents
    rollup = counts.Rollup(spark, str(tmp_path / "feed"))
    totals = counts.change_feed(rollup, df, {"words": counts.word_tokenizer})
    seen, words = set(), 0
    for _, t in sorted(rows):
        if t not in seen:
            seen.add(t)
            words += len("".join(c for c in t if c not in "#*$%&|<>").encode().split())
    first = totals.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    assert tuple(first) == (len(seen), words)


def test_change_feed_by_group(spark, tmp_path):
    """Every total of the registered feed, with texts that share an id and ids that share a text."""
    rows = [(1, "a", "en", "x y"), (5, "a", "en", "x y"), (5, "a", "de", "only * here"), (5, "b", "en", "x  y"),
            (1, "a", "en", "x y"), (None, "a", None, "x y"), (None, None, None, None), (7, "b", "en", "$1 and & two"),
            (8, "b", "en", "$1 and & two"), (9, "b", "en", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    versions = {"words": counts.word_tokenizer, "chars": lambda: lambda ts: [len(t) for t in ts]}
    got = rows_of(counts.change_feed(counts.Rollup(spark, str(tmp_path / "groups")), df, versions), "*")
    least = {}
    for d, _, _, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    sums = {}
    for d, source, lang, t in rows:
        t = t or ""
        if d is not None and d > least[t]:
            continue
        t = "".join(c for c in t if c not in "#*$%&|<>")
        for version, n in (("words", len(t.split())), ("chars", len(t))):
            old = sums.get((source, lang, version), (0, 0, 0))
            sums[source, lang, version] = (old[0] + 1, old[1] + n, old[2] + len(t))
    same(got, [(*k, *v) for k, v in sums.items()])


def test_concurrent_commits(spark, tmp_path):
    """Of two deletes made from one state, the second is made anew; nothing is taken out twice."""
    folder = str(tmp_path / "race")
    df = spark.createDataFrame([(i, "s", "en", "a b") for i in range(9)], "doc_id long, source string, lang string, text string")
    entries = counts.counted(df, {"w": counts.word_tokenizer})
    one, two = counts.Rollup(spark, folder), counts.Rollup(spark, folder)
    one.insert("load", entries)
    ids = df.filter("doc_id < 3").select("doc_id", F.lit("w").alias("version"))
    claim, states = one._claim, []

    def late(seq, record):
        if not states:
            two.delete("first", ids)
        states.append(seq)
        return claim(seq, record)

    one._claim = late
    assert one.delete("second", ids) and states == [1, 2]
    assert one.committed() == ["first", "load", "second"]
    assert one.totals().select("n_docs", "n_tokens").first() == (6, 12) and one.ledger().count() == 6
    states.clear()
    one._claim = lambda seq, record: (not states and two.insert("same", entries), states.append(seq),
                                      claim(seq, record))[-1]
    assert not one.insert("same", entries) and one.totals().first()["n_docs"] == 15
    one._claim = claim
    one.compact()
    assert two.totals().first()["n_docs"] == 15 and two.delete("again", ids) and two.totals().first()["n_docs"] == 12


def test_neighbours(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame(
        [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0, None] * 32), (1004, [1.0]),
         (1005, [float("inf")] * 64), (None, [1.0] * 64), (1006, []), (1020, None)], "vec_id long, embedding array<float>")
    copies = df.filter("vec_id = 40").select(F.explode(F.sequence(F.lit(2000), F.lit(2059))).alias("vec_id"),
                                             "embedding")
    table = df.unionByName(odd).unionByName(copies).unionByName(df.filter("vec_id < 10"))
    usable = neighbours.usable(table)
    got = defaultdict(list)
    for r in neighbours.search(usable, usable.filter("id % 20 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    vectors = {r["id"]: np.array(r["vector"], dtype=np.float64) for r in usable.collect()}
    ids = np.array(sorted(vectors))
    matrix = np.stack([vectors[i] for i in ids])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        scores = (matrix * vectors[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        hits += len({int(ids[i]) for i in order} & {v for _, v, _ in found})
        for _, v, s in found:
            assert s == (vectors[v] * vectors[q]).sum()
    assert hits >= 0.9 * 20 * len(got)
    assert [v for _, v, _ in sorted(got[40])] == list(range(2000, 2020))  # ties to smaller ids


def test_few_vectors(spark):
    few = neighbours.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])],
                                                  "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in neighbours.search(few, few.filter("id = 0")).orderBy("rank").collect()] == [
        (0, 1, 1, 0.5), (0, 2, 2, -1.0)]


def test_empty_tables(spark, net):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    path = op_queries.public_tokenizers.path
    assert secrets.scan(none).count() == 0 and secrets.redact(none, net).count() == 0
    assert quality.judge(none).count() == 0 and quality.filter_documents(none).count() == 0
    assert packing.pack(none, path("word_bpe_49k.json")).count() == 0
    assert bpe.round_trip(none, path("byte_bpe_multi_50k.tiktoken"), op_queries.public_tokenizers.PATTERN).count() == 0
    assert suffix.repeats(none).count() == 0 and suffix.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0
    assert licenses.scan(none).count() == 0 and pii.scan(none).count() == 0
    vectors = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.search(vectors, vectors).count() == 0
