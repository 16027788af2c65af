"""The network of the secret scans learns from all findings."""

import numpy as np
from pyspark.sql import functions as F

from tablelens.llm import secrets


def test_every_candidate_of_every_document_is_a_finding(spark):
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("see a1-%08d for it", "id").alias("text"))
    assert secrets.labelled(docs).distinct().count() == n
    long = "-".join(f"b{i}" for i in range(500))
    rows = secrets.labelled(spark.createDataFrame([(1, f"é {long} ."), (2, None)], "doc_id long, text string")).collect()
    assert [len(r["codes"]) for r in rows] == [secrets.LEFT + len(long) + secrets.RIGHT]


def test_windows_from_codes_are_the_windows_of_the_text():
    texts = ["", "é" * 30 + " " + "x1-" * 70 + "Ж", "ab12-cd.34", "k=" + "Z" * 57]
    codes, starts = secrets.coded(texts)
    spans = [(i, s, e) for i, t in enumerate(texts) for s, e in ((0, len(t)), (3, len(t) - 2)) if e > s]
    of, s, e = np.array(spans).T
    first, last, bag = secrets.places(starts[of] + s, starts[of] + e)
    expected = [(k, w) for k, (i, s, e) in enumerate(spans) for w in secrets.windows(texts[i], s, e)]
    assert bag.tolist() == [k for k, _ in expected]
    assert np.array_equal(secrets.gathered(codes, first, last), np.stack([w for _, w in expected]))


def test_shards_train_on_all_their_findings_and_are_averaged(spark):
    rng = np.random.default_rng(5)
    docs = [(i, f"w {'token=' if i % 9 == 0 else ''}{rng.integers(10 ** 12)}-{'y2/' * int(rng.integers(1, 90))} w")
            for i in range(400)]
    found = secrets.labelled(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3, "rank")
    made = secrets.built_findings(60, seed=2)
    built = (np.stack([secrets.window(t, s, e) for t, s, e, _ in made]).astype(np.uint8),
             np.array([m[3] for m in made], dtype=np.float32))
    net = secrets.train(*built, epochs=1)
    mean = secrets.averaged(net, found, built, (300.0, 40.0), 0.25)
    total, used = 0, 0
    parts = found.select(F.spark_partition_id(), "rank", "codes", "label").collect()
    for part in sorted({r[0] for r in parts}):
        rows = sorted((r[1], bytes(r[2]), r[3]) for r in parts if r[0] == part)
        own = secrets.Network(*[w.copy() for w in net.weights()])
        n = secrets.refine(own, [c for _, c, _ in rows], np.array([k for *_, k in rows]), built, (300.0, 40.0), 0.25,
                           rows[0][0])
        others = sum(len(secrets.windows("", 0, len(c) - secrets.LEFT - secrets.RIGHT)) for _, c, k in rows if not k)
        assert n == others + sum(k for *_, k in rows)
        total, used = total + n * own.filters.astype(np.float64), used + n
    # other numbers of threads add in another order, which Adam magnifies a little
    assert np.abs(mean.filters - total / used).mean() < np.abs(mean.filters - net.filters).mean() / 5


def test_one_label_alone_trains_too():
    made = secrets.built_findings(40, seed=2)
    built = (np.stack([secrets.window(t, s, e) for t, s, e, _ in made]).astype(np.uint8),
             np.array([m[3] for m in made], dtype=np.float32))
    codes, (at,) = secrets.coded(["ab12-cd.34"])
    found = codes[at - secrets.LEFT:at + 10 + secrets.RIGHT].tobytes()
    for label in (0, 1):
        net = secrets.train(*built, epochs=1)
        assert secrets.refine(net, [found], np.array([label]), built, (1.0 - label, 1.0 * label), 0.0, 1) == 1
        assert all(np.isfinite(w).all() for w in net.weights())


def test_thresholds_are_exact_over_all_secrets(spark):
    rng = np.random.default_rng(6)
    z = np.concatenate([rng.normal(size=3000), rng.normal(size=3000).round(1), [0.0, -0.0, 1e-30]]).astype(np.float32)
    shapes = rng.integers(0, 2, len(z))
    here = rng.integers(0, 4, len(z)) == 0
    bits = z.view(np.int32)
    key = bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))
    rows = spark.createDataFrame([(int(k), int(s)) for k, s in zip(key[~here], shapes[~here])], "key int, shape int")
    for share in (0.0, 0.02, 0.5):
        expected = []
        for k in (0, 1):
            v, w = z[shapes == k], np.where(here[shapes == k], 1.0, 0.25)
            expected.append(max(x for x in v if w[v < x].sum() <= share * w.sum() + 1e-9))
        assert secrets._least(rows, 0.25, z[here], shapes[here], share) == [*expected, None]
