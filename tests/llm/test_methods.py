"""The parts the operators are made of, and what they learn."""

import os
import random
import sys
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from tablelens.llm import bpe, graph, licenses, neighbours, op_queries, packing, pii, quality, secrets  # noqa: E402
from tablelens.llm import simhash, suffix  # noqa: E402
from tablelens.llm.tokens import word_ids  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_network_on_held_out_findings():
    made = secrets.built_findings(1600, seed=1)
    x = np.array([secrets.window(t, s, e) for t, s, e, _ in made], dtype=np.int16)
    y = np.array([m[3] for m in made], dtype=np.float32)
    shapes = np.array([secrets.shape(t[s:e]) for t, s, e, _ in made])
    net = secrets.train(x[:2400], y[:2400])
    secrets.calibrate(net, x[2400:2800], y[2400:2800], shapes[2400:2800])
    p = net.probability(x[2800:])
    assert ((p > 0.5) == (y[2800:] > 0)).mean() > 0.93
    limits = np.array(net.thresholds)[shapes[2800:]]
    assert (p >= limits)[y[2800:] > 0].mean() > 0.93
    again = secrets.train(x[:2400], y[:2400])
    assert np.array_equal(again.filters, net.filters)


def test_network_finds_what_patterns_miss(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36))
    docs = spark.createDataFrame([(1, f"the deploy uses ghp_{key} for now"),
                                  (2, "plain words only, on 2024-05-06T10:11:12 at the usual-long-place-name")],
                                 "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert spans[1] == f"learned:16:{16 + 40}" and spans[2] == ""
    assert secrets.redacted("a bb c", [(2, 4, "x")], "#") == "a # c"
    assert secrets.redacted("abcdef", [(0, 3, "x"), (2, 5, "y")], "#") == "#f"


def test_whole_candidates_are_read(spark):
    """A key is found wherever it stands in a long run, whatever its shape, and beside a base span."""
    net = secrets.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = random.Random(4)

    def some(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    lower, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    paths = ["see " + "/".join(some(lower, rng.randint(3, 9)) for _ in range(10)) + f"/ghp_{some(alnum, 36)} now"
             for _ in range(200)]
    assert sum(s == [(4, len(t) - 4, "learned")] for t, (_, s) in zip(paths, secrets.find(net, paths))) >= 196
    texts = ["the db_pass: Ab3$kLm9xQ is here", "use postgres://user:p4ss.w0rd9Z@host for it",
             "set h8Kd.92jF.aQ0x.Zp3L there", "key QWERTZUIOPASDFGHJKLY works"]
    assert [s for _, s in secrets.find(net, texts)] == [[(13, 23, "learned")], [(4, 36, "learned")],
                                                        [(4, 23, "learned")], [(4, 24, "learned")]]
    both = '{"password":"abc123def","other":"ghp_' + some(alnum, 36) + '"}'
    (base, spans), = secrets.find(net, [both])
    assert len(base) == 1 and len(spans) == 2 and both[spans[1][0]:spans[1][1]].endswith(both[-38:-2])
    long = "x/" * 200_000 + "ghp_" + some(alnum, 36)
    (_, spans), = secrets.find(net, [long])
    assert spans == [(0, len(long), "learned")]
    assert [s for _, s in secrets.find(net, ["plain words only", "the token is required here", "", "on 2024-05-06"])] \
        == [[], [], [], []]


def test_candidates_and_windows():
    assert secrets.candidates("Something ordinary, (however) IMPORTANT words; shortw0") == []
    text = "run ab12-cd.34! then 'pass': swordfish end"
    assert [text[s:e] for s, e in secrets.candidates(text)] == ["ab12-cd.34", "swordfish"]
    for n in (8, 56, 57, 84, 85, 300):
        starts = range(0, max(1, n - secrets.INSIDE + secrets.STEP), secrets.STEP)
        assert len(secrets.windows("x" * n, 0, n)) == len(starts) and starts[-1] + secrets.INSIDE >= n
    assert secrets.beside("abcdefgh1234567890", 0, 18, [(0, 3, "x")]) == [(3, 18)]
    assert secrets.best_of(np.array([1.0, 3.0, 2.0]), np.array([0, 0, 1])).tolist() == [3.0, 2.0]


def test_quality_against_labels(spark):
    """No label is used in fitting; clean documents are kept, damaged ones go."""
    judged = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"))
    both = judged.join(spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    rows = both.filter("not base_failed").groupBy("label").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, rows))
    assert share[1] > 0.99 and share[0] < 0.1


def test_votes_of_rules_that_never_meet():
    # good documents fire the two good rules, damaged ones one bad rule each, on a third of the corpus or a hundredth
    for damaged in (300, 10):
        patterns = np.array([[0, 0, 1, 1], [1, 0, 0, 0], [0, 1, 0, 0]], dtype=float)
        counts = np.array([1000, damaged, damaged], dtype=float)
        votes = np.array([-1, -1, 1, 1], dtype=float)
        beliefs = np.array([(0.25, 0.005)] * 2 + [(0.3, 0.9)] * 2)
        model = quality.fit_votes(patterns, counts, votes, beliefs)
        odds = np.log(model.prior / (1 - model.prior)) + patterns @ np.array(model.weights)
        assert odds[0] > 2 and odds[1] < 0 and odds[2] < 0


def test_best_fit_of_runs():
    rng = random.Random(2)
    for capacity in (10, 64):
        lengths = {n: rng.randrange(1, 40) for n in rng.sample(range(1, capacity + 1), 8)}
        matches, n = packing.match(lengths, capacity)
        room = [capacity] * n
        placed = dict.fromkeys(lengths, 0)
        for m in matches:
            assert m.first == placed[m.length]
            placed[m.length] = m.last
            for k in range(m.last - m.first):
                at = m.sequence + k // m.each
                assert capacity - room[at] == m.offset + k % m.each * m.length
                room[at] -= m.length
        assert placed == lengths and min(room) >= 0
        # as many sequences as best fit, document by document, opens
        gaps = []
        for length in sorted((x for x, c in lengths.items() for _ in range(c)), reverse=True):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(capacity - length)
        assert n == len(gaps)


def test_packed_sequences(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 7)) for i in range(40)], "doc_id long, text string")
    path = op_queries.public_tokenizers.path("word_bpe_49k.json")
    made = packing.sequences(docs, packing.pack(docs, path, 32), path, 32).collect()
    tokenizer = brute.word_tokenizer()
    total = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(len(r["ids"]) for r in made) == total and max(len(r["ids"]) for r in made) <= 32


def test_words_in_bulk():
    path = op_queries.public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = brute.word_tokenizer(), word_ids(path)
    rng = random.Random(1)
    odd = ["", "İstanbul ΑΣ ΟΔΟΣ. ΣΑΣ'S it's We'LL", "日本語 123４５ ½", "Straße ŉ ǅ ſ K Å x y\x1cz\x85q", "aaaaaaa aaaa",
           "don't DON'T I'M you'RE", "\x00a b 한가", "ÀÉÎ×÷ß öÖ12a!!b"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 384), rng.randrange(32, 0x2FFF), rng.randrange(1, 0xD7FF)]))
                    for _ in range(40)) for _ in range(400)]
    for text, raw in zip(odd, own.encode_many([t.encode() for t in odd])):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_transducer_against_definition():
    encoder = bpe.TextEncoder(op_queries.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                              op_queries.public_tokenizers.PATTERN)
    t = encoder.transducer
    rng = random.Random(3)
    letters = [" ", "th", "e", "ing", "é", "日", "a", "tion", "s", "Q"]
    for _ in range(300):
        piece = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))).encode()
        assert t.encode(piece) == ([t.ranks[piece]] if piece in t.ranks else t.merge(piece))
    for pair, stands in list(t._pairs.items())[:2000]:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        assert stands == (t.merge(t.tokens[a] + t.tokens[b]) == [a, b])
    t._reset()
    assert t.encode("thetionings".encode()) == t.merge("thetionings".encode())


def test_white_space_between_chunks():
    name = "byte_bpe_multi_50k.tiktoken"
    reference = brute.byte_tokenizer(name)
    encoder = bpe.text_encoder(op_queries.public_tokenizers.path(name), op_queries.public_tokenizers.PATTERN)
    rng = random.Random(5)
    parts = ["a", " ", "\n", "\t", "B", "é", "日", "1", "'s", "!", " ", "\x85", "\xa0", " ", "ing", " the"]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(40))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_utf8_machine():
    rng = random.Random(6)
    for _ in range(5000):
        raw = bytes(rng.choice([rng.randrange(256), 0xE0, 0xED, 0xF0, 0xF4, 0x80, 0x9F, 0xA0, 0xBF, 65, 0xC3])
                    for _ in range(rng.randrange(12)))
        machine = bpe.Utf8Machine()
        cuts = sorted(rng.randrange(len(raw) + 1) for _ in range(3))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        assert "".join(map(machine.feed, parts)) + machine.end() == raw.decode("utf-8", "replace")


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 9, 25, 100])
def test_suffix_ranks(length):
    rng = random.Random(7)
    data = bytes(rng.choice(b"ab") for _ in range(300))
    keys = [(data[i:i + length] + b"\0" * length)[:length] for i in range(len(data))]
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    assert suffix.suffix_ranks(np.frombuffer(data, np.uint8), length).tolist() == [order[k] for k in keys]


@pytest.mark.parametrize("hot", [20_000, 1])
@pytest.mark.parametrize("length", [60, 300])
def test_repeats_of_other_lengths(spark, length, hot):
    """Runs of over 128 starts, and the largest id, which is not NULL."""
    rng = random.Random(11)
    some = ["".join(rng.choices("abcdefgh ", k=900)) for _ in range(4)]
    rows = [(1, some[0] + some[1]), (2, "x" + some[1][:700]), (3, some[2] + some[0][100:500] + some[2][:350]),
            (suffix.LAST_ID, some[3] + some[2]), (None, some[1][200:]), (7, "a" * 700)]
    got = suffix.repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, hot_runs=hot).collect()
    seen, expected = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i:i + length] in seen:
                gone[i:i + length] = b"1" * length
            seen.add(t[i:i + length])
        expected[d] = gone.count(b"1")
    assert {r["doc_id"]: r["n_removed"] for r in got} == expected and sum(expected.values()) > 1000


def test_texts_without_repeats(spark):
    a, b = "éabcdefghijklmnopqrstuvwxyz0123456789éABCDEFGHIJK", "some other words"
    docs = spark.createDataFrame([(1, a + b, "k"), (2, "12" + a, "k"), (3, None, "k")],
                                 "doc_id long, text string, row string")
    left = {r["doc_id"]: r["text"] for r in suffix.remove_repeats(docs, 40, 10).collect()}
    assert left == {1: a + b, 2: "12", 3: None}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (5, 5)]
    got = graph.components(spark.createDataFrame(links, "u long, v long"))
    assert {r["u"]: r["root"] for r in got.collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_within_distance(spark, distance):
    rng = random.Random(8)
    points = {rng.getrandbits(64) for _ in range(12)}
    for p in list(points):
        for _ in range(6):
            q = p
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                q ^= 1 << bit
            points.add(q)
    points = sorted(int(x) for x in np.array(sorted(points), dtype=np.uint64).view(np.int64))
    near = [(a, b) for a in range(len(points)) for b in range(a)
            if ((points[a] ^ points[b]) & (2 ** 64 - 1)).bit_count() <= distance]
    frame = spark.createDataFrame([(p,) for p in points], "fp long")
    found = [(points.index(r["u"]), points.index(r["v"])) for r in simhash.links(frame, distance).collect()]
    assert set(found) <= set(near)
    assert brute.components(found, len(points)) == brute.components(near, len(points))


def test_license_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.execute(licenses.scan_sql()).fetchall()
    got = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(expected, key=repr)


def test_disclosing_terms(spark):
    """A name that only ever stands near one address gives it away; an ordinary word does not."""
    fill = ["ordinary words fill these lines without any name", "people write about weather and music"] * 40
    near = [f"{w} contact Zephyrine quickly under jane@corp.example today" for w in ("please", "always", "maybe")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near + fill + ["contact people today"] * 20)],
                                 "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.scan(docs).collect()}
    for i, text in enumerate(near):
        at = text.index("Zephyrine")
        kinds = dict(reversed(s.split(":", 1)) for s in found[i].split(","))
        assert kinds[f"{at}:{at + 9}"] == "term" and "email" in found[i]
        start = text.index("contact")
        assert f"{start}:{start + 7}" not in kinds
    assert all(found[i] == "" for i in range(len(near), len(near) + len(fill)))
    masked = pii.sanitise(docs).filter("doc_id = 0").first()["text"]
    assert "Zephyrine" not in masked and "[EMAIL]" in masked and "[TERM]" in masked


@pytest.mark.parametrize("disclosure", [0.95, 0.5])
def test_disclosing_terms_against_brute_force(spark, disclosure):
    """Short names, other scripts, numbers, terms beside other entities and letters that go on into an entity."""
    rng = random.Random(8)
    rows = [(d, r["text"]) for d, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect())]
    rows += [(200 + i, f"{w} write to Lee Wu or 李明 (staff 4711) under jane.wu@corp.example {w} 10.0.0.{i} and "
                       f"+1 212 555 019{i} 10.0.0.1xyz") for i, w in enumerate(["please", "now", "maybe"])]
    rows += [(210, "Lee"), (211, "éjane@corp.example Lee"), (212, ""), (213, None), (200, rows[150][1]),
             (None, rows[151][1]), (214, "under " * 40), (215, "x" * 80 + "10.0.0.7" + "é" * 70 + " Wu 10.0.0.7 Wu")]
    rows += [(300 + i, " ".join(rng.choice(["ab", "é", "10.0.0.9", "a@b.c", "+1 212 555 0199", "李", "x1"])
                                for _ in range(60))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted((repr(d), sorted(s)) for (d, _), s in zip(rows, brute.disclosing(
        rows, pii.CONTEXT, disclosure, pii.SUPPORT)))
    got = sorted((repr(r["doc_id"]), sorted(tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",")
                                           if s.startswith("term"))) for r in pii.scan(df, disclosure).collect())
    assert got == expected
    assert sum(len(s) for _, s in expected) > 10
    if disclosure == 0.95:
        text = pii.sanitise(df).filter("doc_id = 201").first()["text"]
        assert all(w not in text for w in ("Lee", "Wu", "李明", "4711")) and text.startswith("now")


def test_sanitise_keeps_any_column(spark):
    names = ["_key", "_id", "key", "row", "spans", "text_hash", "_spans", "hash", "id", "a.b"]
    df = spark.createDataFrame([(1, "mail jane@corp.example", *names), (1, "mail jane@corp.example", *names),
                                (2, None, *names)],
                               "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = pii.sanitise(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [(1, "mail [EMAIL]", *names)] * 2 + [(2, None, *names)], key=repr)


def test_text_with_many_personal_data(spark):
    """Time grows in step with the matches; places stay exact."""
    n = 3_000
    text = "é " + "a@b.cd 10.0.0.1 " * n
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.scan(df).first()
    assert (r["n_email"], r["n_ip"]) == (n, n)
    spans = [f"{k}:{2 + 16 * i + at}:{2 + 16 * i + to}" for i in range(n)
             for k, at, to in (("email", 0, 6), ("ip", 7, 15))]
    assert r["base_sha256"] == brute.sha(",".join(spans))
    assert pii.sanitise(df).first()["text"] == "[TERM] " + "[EMAIL] [IP] " * n


@pytest.mark.parametrize("hashes", [1, 3, 6])
def test_probes_in_order_of_chance(hashes):
    """The buckets listed are those of the full enumeration, at any number of hashes."""
    rng = np.random.default_rng(3)
    q = rng.normal(size=(12, 8))
    radius = rng.uniform(0.05, 1.2, 12)
    tables = neighbours.Tables(8, hashes, 1.0, 0.5, 2)
    steps = np.arange(-neighbours.REACH, neighbours.REACH + 1)
    at = tables._projected(1, tables.asked(q))
    for one, r, found in zip(at, radius, tables.probes(1, q, radius)):
        home = np.floor(one)
        edges = home[:, None] + np.append(steps, neighbours.REACH + 1) - one[:, None]
        below = neighbours._normal(edges / (r / neighbours.WIDTH))
        grid = np.stack(np.meshgrid(*[np.arange(len(steps))] * hashes, indexing="ij"), -1).reshape(-1, hashes)
        chance = np.prod([(below[:, 1:] - below[:, :-1])[j, grid[:, j]] for j in range(hashes)], axis=0)
        order = np.argsort(-chance, kind="stable")
        total = np.cumsum(chance[order])
        if total[-1] < tables.wanted - 1e-6:
            assert found is None
        elif found is not None:
            n = len(found)
            assert total[n - 1] >= tables.wanted - 1e-9 and (n == 1 or total[n - 2] < tables.wanted + 1e-9)
            assert len(set(found.tolist()) ^ set(tables._name(home + steps[grid[order[:n]]]).tolist())) <= 2  # ties
            few = next(tables.probes(1, q[:1], radius[:1], n - 1)) if n > 1 else None
            assert few is None or len(few) < n
        else:
            assert total[-1] < tables.wanted + 1e-6


def test_scores_of_double_vectors(spark):
    """Components that no float holds are not rounded before they are compared."""
    rows = [(i, [1.0 + i * 1e-12, 0.1, 0.2]) for i in range(30)]
    usable = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in
             neighbours.search(usable, usable.filter("id = 0"), top=3).collect()}
    assert [found[0, k][0] for k in (1, 2, 3)] == [29, 28, 27]
    assert found[0, 1][1] == float((np.array(rows[0][1]) * np.array(rows[29][1])).sum())


def test_neighbours_of_mixed_density(spark):
    """Most rows in tight clusters, the rest sparse: every query gets all its rows, and the nearest ones."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 24))
    tight = centres[rng.integers(0, 12, 1900)] + rng.normal(size=(1900, 24)) * 0.03
    sparse = rng.normal(size=(100, 24))
    every = np.concatenate([tight, sparse])
    every = (every / np.linalg.norm(every, axis=1, keepdims=True)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "id long, vector array<float>")
    asked = vectors.filter("id % 20 = 0 or id >= 1980")
    near = defaultdict(list)
    for r in neighbours.search(vectors, asked, bucket=16, block=300).collect():
        near[r["query_id"]].append(r["vec_id"])
    exact = every.astype(np.float64) @ every.astype(np.float64).T
    ids = [i for i in range(2000) if i % 20 == 0 or i >= 1980]
    assert sorted(near) == ids and all(len(found) == 20 for found in near.values())
    for some in ([i for i in ids if i < 1900], [i for i in ids if i >= 1900]):
        hits = sum(len(set(near[i]) & {j for j in np.argsort(-exact[i])[:21] if j != i}) for i in some)
        assert hits >= 0.95 * 20 * len(some)


def test_groups_led_by_one_id(spark):
    """Unrelated texts that share an id are groups of their own, each with its survivor."""
    rng = random.Random(10)
    a, b = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (2, b), (1, a)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_first(docs).collect()) == sorted([(1, a), (1, b)])


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_under_one_id(spark, hot):
    """Different texts under one id, or without one, are documents of their own: one copy of a passage stays."""
    passage = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQ"
    rows = [(d, f"{passage} {i} " + "".join(random.Random(i).choices("abcdefghij", k=30)))
            for d in (5, None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r["text"] for r in suffix.remove_repeats(docs, 40, 10, hot).collect()]
    assert len(texts) == 6 and sum(passage in t for t in texts) == 1
    # texts whose hashes agree in the first 23 bits keep their own runs
    digest = F.sha2(F.col("id").cast("string"), 256)
    many = spark.range(9000).select(
        F.lit(5).cast("long").alias("doc_id"), "id",
        F.concat(digest, F.when(F.col("id") % 2 == 0, F.lit(passage)).otherwise("")).alias("text"))
    whole = 0
    for r in suffix.remove_repeats(many, 40, 10, hot).withColumn("digest", digest).collect():
        if r["id"] % 2 or len(r["text"]) > 64:
            assert r["text"] == r["digest"] + ("" if r["id"] % 2 else passage)
            whole += r["id"] % 2 == 0
        else:  # a few last digits may repeat along with the passage
            assert r["digest"].startswith(r["text"]) and len(r["text"]) >= 54
    assert whole == 1
