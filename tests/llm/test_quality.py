import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from tests.llm import hard
from textloom.llm import quality_classifier as C
from textloom.llm import quality_rules as Q
from textloom.llm.queries import table

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def odd_texts(n=800, seed=3):
    r = random.Random(seed)
    parts = ["a", "b", "é", "日x", "\x1f", " ", "  ", "\n", "\t", "\x0b", "#<", "\x85", " "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, r.choice([0, 3, 40, 200])))) for _ in range(n)]


def test_base_counts():
    texts = odd_texts()
    got = Q.base_counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in Q.COUNTS) == plain_counts(t), repr(t)


def test_scores_against_plain(spark):
    docs, labels = table(spark, SF, "documents").where("doc_id < 120"), table(spark, SF, "labels")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = [(r.doc_id, r.text.encode()) for r in docs.collect()]
    bucket = lambda g: int(Q.buckets([g])[0][0])
    cache: dict[bytes, int] = {}
    grams = {i: [cache.setdefault(t[k : k + 4], -1) and t[k : k + 4] for k in range(len(t) - 3)] for i, t in rows}
    cache = {g: bucket(g) for g in cache}
    raw, target = np.ones(1 << Q.BITS), np.ones(1 << Q.BITS)
    for i, gs in grams.items():
        for g in gs:
            raw[cache[g]] += 1
            target[cache[g]] += i in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    out = {r.doc_id: r for r in Q.quality_rules(docs, labels.where("quality = 1").select("doc_id")).collect()}
    for i, t in rows:
        want = np.mean([ratio[cache[g]] for g in grams[i]]) if grams[i] else 0.0
        assert abs(out[i].score - want) < 1e-9
        n = plain_counts(t.decode())
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert out[i].base_failed == failed and out[i].kept == (not failed and want >= Q.THRESHOLD)


def test_clean_documents_stay(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = Q.quality_rules(docs, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in out if r.quality == 1)
    assert sum(r.kept for r in out if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in out)


def test_rules_on_hard_documents(spark):
    df = hard.frame(spark)
    trusted = spark.createDataFrame([(1,), (1,), (None,), (999,)], "doc_id long")
    out = Q.quality_rules(df, trusted)
    got = sorted((r.doc_id or -1, r.n_words) for r in out.collect())
    assert got == sorted((i or -1, plain_counts(t or "")[0]) for i, t, *_ in hard.documents())
    kept = Q.keep_quality(df, trusted)
    assert kept.columns == df.columns and kept.count() == out.where("kept").count()
    assert Q.quality_rules(hard.empty(spark), trusted).count() == 0
    assert {r.score for r in Q.quality_rules(df, trusted.limit(0)).collect()} == {0.0}


def test_classifier_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    out = C.classify_quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.held_out]
    assert np.mean([r.predicted == r.quality for r in test]) > 0.98
    assert np.mean([r.predicted for r in test if r.quality == 1]) > 0.99


def test_classifier_never_reads_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 5 = 0, 1 - quality, quality) AS quality")
    score = lambda x: sorted((r.doc_id, r.score) for r in C.classify_quality(docs, x).collect())
    assert score(labels) == score(other)


def test_features_against_plain():
    texts = [t.encode() for t in odd_texts(200, 4)]
    places, first = C.features(texts)
    for i, t in enumerate(texts):
        alone, f = C.features([t])
        assert (alone == places[first[i] : first[i + 1]]).all() and f[1] == len(t.split())


def plain_leader(examples, epochs=C.EPOCHS):
    """Follow-the-regularised-leader, one coordinate after the other, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= C.L1:
            return 0.0
        return -(z[i] - math.copysign(C.L1, z[i])) / ((C.BETA + math.sqrt(n[i])) / C.ALPHA + C.L2)

    for _ in range(epochs):
        for x, y in examples:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / C.ALPHA * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z}


def test_training_against_a_plain_loop(spark):
    docs = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").where("crc32(cast(doc_id AS string)) % 5 <> 0").limit(60)
    rows = docs.selectExpr("xxhash64(doc_id) AS sort", "text", "cast(quality AS double) AS label").collect()
    examples = []
    for r in sorted(rows, key=lambda r: r.sort):
        places, _ = C.features([r.text.encode()])
        x = Counter(places.ravel().tolist())
        examples.append(({i: c * C.SCALE / len(places) for i, c in x.items()} | {1 << C.BITS: 1.0}, r.label))
    want = plain_leader(examples)
    got = C.train(spark.createDataFrame([tuple(r) for r in rows], "sort long, text string, label double").repartition(3))
    assert max(abs(got[i] - w) for i, w in want.items()) < 1e-6
    assert set(np.flatnonzero(got).tolist()) <= set(want)


def test_sample_is_cut_among_documents_that_are_there(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} words here {i}") for i in range(1, 41)], "doc_id long, text string")
    labels = spark.range(0, 5000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    out = C.classify_quality(docs, labels, sample=50).collect()
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in out)


def test_a_long_text_is_counted_in_bounded_memory():
    text = " ".join(f"word{i % 70_000}" for i in range(150_000)).encode()
    tracemalloc.start()
    got = Q.base_counts([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["n_repeat_words"][0] == plain_counts(text.decode())[4]
    assert peak < 60 * len(text)


def test_classifier_on_hard_documents(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 0), (999, 1)], "doc_id long, quality int")
    out = C.classify_quality(hard.frame(spark), labels).collect()
    assert len(out) == len(hard.documents()) and all(0 <= r.score <= 1 for r in out)
    assert C.classify_quality(hard.empty(spark), labels).count() == 0
    assert {r.score for r in C.classify_quality(hard.frame(spark), labels.limit(0)).collect()} == {0.5}
