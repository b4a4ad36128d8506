import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import duplicates as D
from textloom.operators import metrics as M
from textloom.operators import near_duplicates as N
from textloom.operators import profile as P
from textloom.operators import retrieval as R
from textloom.operators import split as S
from textloom.operators import training as T
from textloom.operators.components import connected_components, local_labels
from textloom.sources.readers import latest_checkpoint, with_position


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


# --- profiles


def test_percentiles(spark):
    df = frame(spark, [(1,), (2,), (3,), (10,)], "x long")
    r = P.length_report(df, "x", 9).first()
    assert r.p95_interpolated == pytest.approx(8.95) and r.p95 == 10 and r.over_limit and r.median == 2.5


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.sampled_from([0.0, 0.5, 0.9, 0.95]))
def test_nearest_rank(spark, values, q):
    assert P.nearest_rank(spark.createDataFrame([(v,) for v in values], "x long"), "x", q).first()[0] == sorted(values)[int(q * len(values))]


def test_row_statistics_counts_null_and_empty_once(spark):
    r = P.row_statistics(frame(spark, [(None,), ("",), ("a b",), ("a b",)], "t string"), "t").first()
    assert (r.n_rows, r.n_missing, r.n_unique, r.words_max) == (4, 1, 2, 2)


def test_roles(spark):
    assert P.infer_roles(spark.createDataFrame([], "id long, output string, input string")) == ("input", "output")
    assert P.infer_roles(spark.createDataFrame([], "id long, text string")) == ("text", "text")
    named_prompt_only = frame(spark, [("q", "long text here", "mid txt")], "question string, a string, b string")
    assert P.infer_roles(named_prompt_only) == ("question", "a")
    assert P.infer_roles(frame(spark, [("q", "only")], "question string, n string").select("question")) == ("question", "question")
    with pytest.raises(ValueError, match="no prompt"):
        P.infer_roles(spark.createDataFrame([], "id long"))


def test_top_tokens_ties_by_first_sight(spark):
    df = frame(spark, [(2, "b a"), (1, "c c a")], "id long, t string")
    assert [(r.token, r.n) for r in P.top_tokens(df, "t", "id", 3).collect()] == [("c", 2), ("a", 2), ("b", 1)]


def test_keywords_count_distinct_texts(spark):
    df = frame(spark, [("Chest pain",), ("Chest pain",), ("no PAIN",), (None,)], "t string")
    assert {r.keyword: r.n for r in P.keyword_hits(df, "t").collect()} == {"pain": 2, "chest pain": 1}


# --- duplicates


def test_conflicts(spark):
    rows = [(1, "p", "a"), (2, "p", "b"), (3, "", "a"), (4, "", "b"), (5, "q", None), (6, "q", ""), (7, None, "z")] + [(i, "many", str(i % 2)) for i in range(100, 130)]
    df = frame(spark, rows, "id long, p string, r string")
    got = {r.prompt: (r.n_rows, r.n_responses, r.row_ids) for r in D.conflicting_groups(df, "p", "r", "id").collect()}
    assert got == {"p": (2, 2, [1, 2]), "many": (30, 2, list(range(100, 110)))}
    assert {r.prompt for r in D.prompt_groups(df, "p", "r", "id").collect()} == {"p", "q", "many"}


def test_duplicates_and_overlap(spark):
    train = frame(spark, [(1, "a"), (2, "a"), (3, None), (4, "")], "id long, p string")
    test = frame(spark, [(9, "a"), (10, "A"), (11, ""), (12, "b")], "id long, p string")
    assert D.duplicate_counts(train, "p", ["p"]).first().asDict() == {"full_row_duplicates": 1, "prompt_duplicates": 2}
    assert [r.id for r in D.overlap_rows(test, train, "p").collect()] == [9]
    assert sorted(r.id for r in D.overlap_rows(test, train, "p", normalize=True).collect()) == [9, 10]
    assert [tuple(r) for r in D.overlap_pairs(test, train, "p", "id").collect()] == [(9, "a", [1, 2])]
    assert sorted(r.id for r in D.keep_first(train, "p", "id").collect()) == [1, 3]


def cosine(a, b):
    from tests.test_text import plain_grams

    x, y = Counter(plain_grams(a)), Counter(plain_grams(b))
    dot = sum(v * y[k] for k, v in x.items())
    return round(dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())), 6) if x and y else 0.0


def near_corpus():
    r = random.Random(1)
    base = [" ".join(r.choices(["pain", "fever", "head", "ache", "জ্বর", "ব্যথা", "doctor", "what", "is"], k=r.randint(2, 12))) for _ in range(25)]
    rows = []
    for i in range(150):
        w = r.choice(base).split()
        if r.random() < 0.6:
            w[r.randrange(len(w))] = r.choice(["fevers", "x", "heads"])
        rows.append((i, ("  " if r.random() < 0.2 else "") + " ".join(w) + ("" if i % 9 else "   ")))
    return [*rows, (200, ""), (201, None)]


def test_near_duplicates_against_all_pairs(spark):
    rows = near_corpus()
    norm = {i: " ".join((t or "").split()).lower() for i, t in rows}
    test, train = [x for x in rows if x[0] % 3 == 0], [x for x in rows if x[0] % 3]
    first = lambda part: {t: i for i, t in sorted(((i, norm[i]) for i, _ in part if norm[i]), reverse=True)}
    l, r = first(test), first(train)
    low, high = min(map(len, [*l, *r])), max(map(len, [*l, *r]))
    bucket = lambda t: 0 if low == high else min(4, max(0, math.ceil((len(t) - low) / ((high + 1 - low) / 5)) - 1))
    want = {}
    for t, i in l.items():
        best = max(((cosine(t, u), -j) for u, j in r.items() if abs(bucket(t) - bucket(u)) <= 1), default=(0, 0))
        if best[0] >= 0.9:
            want[i] = (-best[1], best[0])
    got = N.near_duplicates(frame(spark, test, "id long, t string"), frame(spark, train, "id long, t string"), "t", "id").collect()
    assert {x.test_id: (x.train_id, x.score) for x in got} == want and len(want) > 10
    assert N.near_duplicate_status(spark.createDataFrame([], "id long, t string"), frame(spark, train, "id long, t string"), "t")["status"] == "insufficient_rows"


@pytest.mark.parametrize("turned", [False, True])
def test_near_duplicates_deal_the_smaller_side(spark, monkeypatch, turned):
    rows = near_corpus()
    norm = {i: " ".join((t or "").split()).lower() for i, t in rows}
    small, large = [x for x in rows if x[0] % 3 == 0], [x for x in rows if x[0] % 3]
    test, train = (large, small) if turned else (small, large)
    dealt, real = [], N.each_block
    monkeypatch.setattr(N, "each_block", lambda rows, size, corpus, *a, **k: dealt.append((rows.count(), corpus.count())) or real(rows, size, corpus, *a, **k))
    got = {x.test_id: (x.train_id, x.score) for x in N.near_duplicates(frame(spark, test, "id long, t string"), frame(spark, train, "id long, t string"), "t", "id", reference_mode=True, most=10_000).collect()}
    assert len(dealt) == 1 and dealt[0][0] <= dealt[0][1]
    low, high = min(len(t) for _, t in rows if t), max(len(t) for _, t in rows if t)
    raw = {i: t or "" for i, t in rows}
    bucket = lambda i: min(4, max(0, math.ceil((len(raw[i]) - low) / ((high + 1 - low) / 5)) - 1))
    first = lambda part: {t: i for i, t in sorted(((i, t) for i, t in part if norm[i]), reverse=True)}.values()
    want = {}
    for i in first(test):
        best = max(((cosine(norm[i], norm[j]), -j) for j in first(train) if bucket(i) == bucket(j)), default=(0, 0))
        if best[0] >= 0.9:
            want[i] = (-best[1], best[0])
    assert got == want and len(want) > 10


def test_connected_texts_are_not_compared_again(monkeypatch):
    r = random.Random(8)
    base = [f"word{k}" for k in range(300)]
    texts = [" ".join(w if r.random() > 0.01 else "other" for w in base) for _ in range(120)] + [f"lone{k} text{k}" for k in range(20)]
    rows = [(i, *N.gram_counts(t)) for i, t in enumerate(texts)]
    table = pa.table({"id": [i for i, _, _ in rows], "terms": pa.array([h for _, h, _ in rows], pa.list_(pa.int64())), "weights": pa.array([c / np.sqrt((c * c).sum()) for _, _, c in rows], pa.list_(pa.float64())), "bucket": pa.array([0] * len(rows), pa.int32())})
    calls, real, edges = [], N.Block.score, []
    monkeypatch.setattr(N.Block, "score", lambda self, p: calls.append(p) or real(self, p))
    monkeypatch.setattr(N, "_size", lambda: None)
    monkeypatch.setattr(N, "each_block", lambda rows, size, corpus, link, *a, **k: edges.extend(link(table, iter(table.to_batches(max_chunksize=10)))) or True)
    N.similar_forest(None, 0.9)
    found = [(e["l"], e["r"]) for b in edges for e in b.to_pylist()]
    label = local_labels(len(rows), np.array([l for l, _ in found]), np.array([q for _, q in found]))
    assert (label[:120] == label[0]).all() and len(set(label.tolist())) == 21
    assert len(calls) < 2500  # the pairs are 14,400


@pytest.mark.parametrize("most", [R.BLOCK_BYTES, 20_000])
def test_near_components_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(R.each_block, "__defaults__", (most,))  # small: several blocks
    rows = [*near_corpus(), (300, "a doctor for the fever"), (301, "a doctor for the fever " * 4)]  # lengths far apart
    norm = {i: " ".join((t or "").split()).lower() for i, t in rows}
    texts = sorted(set(norm.values()) - {""})
    links = [(a, b) for a in range(len(texts)) for b in range(a) if cosine(texts[a], texts[b]) >= 0.9]
    assert any(max(len(texts[a]), len(texts[b])) > 2.5 * min(len(texts[a]), len(texts[b])) for a, b in links)
    label = local_labels(len(texts), np.array([a for a, _ in links]), np.array([b for _, b in links]))
    of = {t: int(label[k]) for k, t in enumerate(texts)} | {"": -1}
    least = {}
    for i, t in sorted(norm.items()):
        least.setdefault(of[t], i)
    got = {r.id: r.component for r in N.near_components(frame(spark, rows, "id long, t string"), "t", "id").collect()}
    assert got == {i: least[of[t]] for i, t in norm.items()}


def test_bins(spark):
    df = frame(spark, [(i, i) for i in range(1, 101)], "id long, length long")
    edges = np.linspace(1, 101, 6)
    got = {r.length: r.bucket for r in N.binned(df, N.length_range(df)).collect()}
    assert all(b == max(0, int(np.searchsorted(edges, n, "left")) - 1) for n, b in got.items())
    flat = frame(spark, [(1, 7), (2, 7)], "id long, length long")
    assert {r.bucket for r in N.binned(flat, N.length_range(flat)).collect()} == {0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (None, 3), (7, 8)]
    star = [(1000, i) for i in range(1001, 1200)]
    got = {r.node: r.component for r in connected_components(frame(spark, chain + star, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {i: 1000 for i in range(1000, 1200)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- metrics


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=80), st.lists(st.sampled_from("abcd"), max_size=80))
def test_lcs(a, b):
    assert M.lcs_length(a, b) == plain_lcs(a, b) == M.lcs_length(b, a)


def test_scores(spark):
    rows = [(1, "a b c", "a b c"), (2, "a b c d e", "a b c"), (3, "", ""), (4, "", "x"), (5, "x", None), (6, "a a b", "a a a c b"), (7, "z", "y")]
    df = frame(spark, rows, "query_id long, prediction string, target string")
    token = {r.query_id: tuple(r)[1:] for r in M.token_scores(df).collect()}
    rouge = {r.query_id: tuple(r)[1:] for r in M.rouge_scores(df).collect()}
    assert token[1] == rouge[1] == (1.0, 1.0, 1.0)
    assert rouge[2] == pytest.approx((0.6, 1.0, 0.75)) and token[2] == pytest.approx((0.6, 1.0, 0.75))
    assert token[3] == rouge[3] == (1.0, 1.0, 1.0)
    assert token[4] == rouge[4] == token[5] == rouge[5] == token[7] == (0.0, 0.0, 0.0)
    assert token[6] == pytest.approx((1.0, 0.6, 0.75))
    swapped = {r.query_id: tuple(r)[1:] for r in M.token_scores(df.selectExpr("query_id", "target AS prediction", "prediction AS target")).collect()}
    assert all((swapped[k][1], swapped[k][0]) == token[k][:2] and rouge[k][2] <= token[k][2] + 1e-12 for k in token)


def test_reuse_rate(spark):
    r = random.Random(1)
    answers = [r.choice("abcdefghijklmnopqrstuvwxyz0123") for _ in range(500)]
    counts = sorted(Counter(answers).values(), reverse=True)
    got = M.reuse_rate(frame(spark, [(a,) for a in answers], "prediction string")).first()
    assert got.unique_responses_retrieved == len(counts) and got.top_10_response_reuse_rate == pytest.approx(sum(counts[: max(1, int(0.1 * len(counts)))]) / 500)
    few = M.reuse_rate(frame(spark, [("a",), ("a",), ("b",)], "prediction string")).first()
    assert few.top_10_response_reuse_rate == pytest.approx(2 / 3)


def test_record(spark):
    df = frame(spark, [(1, "aaaa", "bb", True), (2, "aaaa", "bb", True)], "query_id long, prediction string, target string, is_fallback boolean")
    r = M.evaluate(df, "M", 2.0).first()
    assert (r.fallback_rate, r.ms_per_query, r.unique_responses_retrieved, r.length_mismatch_flag, r.bert_score_is_proxy) == (1.0, 1000.0, 1, True, True)


# --- retrieval


CORPUS = [(10, "fever and cough", "r10"), (11, "head pain", "r11"), (12, "head pain now", "r12"), (13, "fever", "r13")]


def test_exact_match(spark):
    corpus = frame(spark, [*CORPUS, (9, " Head  PAIN", "r9")], "id long, p string, r string")
    got = {r.query_id: (r.prediction, r.is_fallback) for r in R.exact_match(frame(spark, [(1, "head pain"), (2, "none")], "id long, p string"), corpus, "p", "r", "id", "F").collect()}
    assert got == {1: ("r9", False), 2: ("F", True)}


def test_bm25_and_tfidf_against_plain(spark):
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(100 + i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(150)]
    asked = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(40)] + [(90, "unknownword"), (91, "")]
    tf = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    n, avg = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    bm = lambda q, i: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[i][w] * 2.5 / (tf[i][w] + 1.5 * (0.25 + 0.75 * sum(tf[i].values()) / avg)) for w in set(q) if w in tf[i])

    def unit(c):
        v = {w: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items() if w in df}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vec = {i: unit(c) for i, c in tf.items()}
    ti = lambda q, i: sum(x * vec[i].get(w, 0) for w, x in unit(Counter(q)).items())
    corpus = frame(spark, [(i, t, f"r{i}") for i, t in docs], "id long, p string, r string")
    queries = frame(spark, asked, "id long, p string")
    for op, score in ((R.bm25_top1, bm), (R.tfidf_top1, ti)):
        got = {x.query_id: x for x in op(queries, corpus, "p", "r", "id").collect()}
        for i, t in asked:
            best = max((round(score(t.split(), d), 6), -d) for d, _ in docs)
            if best[0] > 0:
                assert (got[i].doc_id, got[i].score, got[i].matched) == (-best[1], pytest.approx(best[0], abs=2e-6), True)
            else:
                assert (got[i].doc_id, got[i].matched, got[i].prediction) == (100, False, "r100")


def test_sparse_scores_of_pairs_are_never_written(spark, monkeypatch):
    written, real = [], R.materialize

    def counted(df, path=None):
        out = real(df, path)
        written.append(out.count())
        return out

    monkeypatch.setattr(R, "materialize", counted)
    corpus = frame(spark, [(i, f"a b c{i % 7} d{i % 5}", "r") for i in range(400)], "id long, p string, r string")
    queries = frame(spark, [(i, f"a b c{i % 7}") for i in range(100)], "id long, p string")
    for op in (R.tfidf_top1, R.bm25_top1):
        got = {x.query_id: x.doc_id for x in op(queries, corpus, "p", "r", "id").collect()}
        assert got.keys() == set(range(100)) and all(got[i] % 7 == i % 7 for i in got)
    assert max(written) <= 1600  # the postings; the pairs are 40,000


def stages(spark) -> list:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    of = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    found = sc.statusStore().stageList(None, False, False, of, None)
    return [found.apply(i) for i in range(found.size())]


def shuffled(spark, run) -> int:
    """Rows that are shuffled while run() runs."""
    last = max([-1, *(x.stageId() for x in stages(spark))])
    run()
    return sum(x.shuffleWriteRecords() for x in stages(spark) if x.stageId() > last)


def test_postings_are_never_shuffled(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(100)) + f" x{i}", f"a b {i}") for i in range(400)]  # 40,400 postings
    corpus = frame(spark, rows, "id long, p string, r string").repartition(4)
    queries = frame(spark, [(i, f"w1 x{i}") for i in range(20)], "id long, p string")
    for op in (R.tfidf_top1, R.bm25_top1):
        assert shuffled(spark, lambda op=op: op(queries, corpus, "p", "r", "id").collect()) < 10_000
    texts = frame(spark, [(i, p, p, False) for i, p, _ in rows], "query_id long, prediction string, target string, is_fallback boolean")
    assert shuffled(spark, lambda: M.evaluate(texts, "M", distinct=M.distinct_keys(texts, "query_id")).collect()) < 10_000


def test_repeated_keys(spark):
    corpus = frame(spark, [(10, "fever", "r"), (10, "cough cough", "r"), (11, "head", "r"), (12, None, "r"), (13, " ", "r")], "id long, p string, r string")
    assert {r.id: dict(zip(r.terms, r.counts, strict=True)) for r in R.term_counts(corpus, "p", "id").collect()} == {10: {"fever": 1, "cough": 2}, 11: {"head": 1}}
    once = frame(spark, [(1, "a a b", "a a a c b"), (2, "", None), (3, "x", ""), (4, "a b c d", "d a c")], "query_id long, prediction string, target string")
    assert M.distinct_keys(once, "query_id") and not M.distinct_keys(once.union(once), "query_id")
    assert not M.distinct_keys(frame(spark, [(None,), (1,)], "query_id long"), "query_id")
    both = M.token_scores(once).join(M.rouge_scores(once), "query_id").drop("query_id")
    assert sorted(map(tuple, M.pair_scores(once).collect())) == sorted(map(tuple, both.collect()))


def test_sparse_without_rows(spark):
    corpus, none = frame(spark, CORPUS, "id long, p string, r string"), frame(spark, [], "id long, p string, r string")
    blank = frame(spark, [(1, "", "r"), (2, None, "s")], "id long, p string, r string")
    for op in (R.tfidf_top1, R.bm25_top1):
        assert op(none, corpus, "p", "r", "id").count() == op(corpus, none, "p", "r", "id").count() == 0
        assert {(r.query_id, r.doc_id, r.matched) for r in op(corpus, blank, "p", "r", "id").collect()} == {(i, 1, False) for i in (10, 11, 12, 13)}
        assert {(r.query_id, r.doc_id, r.matched) for r in op(blank, corpus, "p", "r", "id").collect()} == {(1, 10, False), (2, 10, False)}


def test_retrieval_eval_keeps_the_answers_only(spark, tmp_path, monkeypatch):
    from textloom import queries as Q
    from textloom.plans import storage

    rows = [(c, t, ("user", "assistant")[t % 2], f"a b c{c % 3} t{t}") for c in range(40) for t in range(4)]
    frame(spark, rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs_written, real, had = [], Q.pairs, len(storage._WRITTEN)
    monkeypatch.setattr(Q, "pairs", lambda *a: pairs_written.append(1) or real(*a))
    got = Q.QUERIES["retrieval_eval"](spark, str(tmp_path))
    assert len(pairs_written) == 1 and len(storage._WRITTEN) - had == 3
    assert got.count() == 3


def test_sparse_blocks_in_small_pieces(monkeypatch):
    g = np.random.default_rng(4)
    rows = lambda n, at: [(at + i, [f"t{k}" for k in g.choice(20, g.integers(0, 6), replace=False)]) for i in range(n)]
    table = lambda rs: pa.table({"id": [i for i, _ in rs], "terms": pa.array([t for _, t in rs], pa.list_(pa.string())), "weights": pa.array([[1.0] * len(t) for _, t in rs], pa.list_(pa.float64()))})
    asked, known = rows(30, 0), rows(200, 1000)[::-1]
    want = {}
    for q, t in asked:
        s, d = max((len({*t} & {*u}), -d) for d, u in known)
        want |= {q: (-d, s)} if s else {}
    for cells in (1, 50, 1000, 1 << 21):
        monkeypatch.setattr(R, "CELLS", cells)
        got = pa.Table.from_batches(R._nearest_sparse(table(asked), iter(table(known).to_batches()))).to_pylist()
        assert {r["query_id"]: (r["doc_id"], r["score"]) for r in got} == want


def test_dense(spark):
    g = np.random.default_rng(1)
    x, q = g.normal(size=(300, 8)), g.normal(size=(20, 8))
    x[7] = 0
    corpus = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = {r.query_id: r.doc_id for r in R.dense_top1(frame(spark, [(i, v.tolist()) for i, v in enumerate(q)], "id long, v array<double>"), corpus, "id", "v").collect()}
    sims = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).T, 6)
    assert got == dict(enumerate(sims.argmax(axis=1).tolist()))


def test_models_by_interface(spark):
    texts = frame(spark, [(1, "aa"), (2, "bbb"), (3, None)], "id long, t string")
    v = R.embedded(texts, "t", "id", lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert {r.id: r.v for r in v.collect()} == {1: [2.0, 1.0], 2: [3.0, 1.0], 3: [0.0, 1.0]}
    assert {r.query_id: r.doc_id for r in R.dense_top1(v, v, "id", "v").collect()} == {1: 1, 2: 2, 3: 3}
    df = frame(spark, [(1, "aaaa", "bb", False), (2, "a", "bb", False)], "query_id long, prediction string, target string, is_fallback boolean")
    r = M.evaluate(df, "M", scorer=lambda p, t: [len(a) / 10 for a in p]).first()
    assert r.bert_score_f1 == pytest.approx(0.25) and not r.bert_score_is_proxy and r.ms_per_query is None


# --- splits


def prompts(n=400):
    r = random.Random(2)
    return [(i, "word " * r.randint(1, 60) + str(r.randrange(150))) for i in range(n)]


def test_split(spark):
    df = frame(spark, prompts(), "id long, p string")
    one = S.split_assign(df, "p", "id")
    assert S.leakage_check(one).first().no_leakage and one.count() == 400
    parts = one.selectExpr("component", "side", "label").distinct().collect()
    n, held = len(parts), [p for p in parts if p.side == "validation"]
    assert len(held) == math.ceil(0.1 * n)
    for label, size in Counter(p.label for p in parts).items():
        assert abs(sum(p.label == label for p in held) - len(held) * size / n) < 1
    again = S.split_assign(df.repartition(7), "p", "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, one.collect()))
    exact = R.exact_match(S.members(df, one.where("side = 'validation'").select("id"), "id"), S.members(df, one.where("side = 'train'").select("id"), "id"), "p", "p", "id")
    assert all(r.is_fallback for r in exact.collect())  # a leakage-free split leaves nothing to find


def test_collapsed_tertiles(spark):
    got = S.length_tertiles(frame(spark, [(i, "same") for i in range(9)], "id long, p string"), "p", "id").orderBy("id").collect()
    assert [r.label for r in got] == ["short"] * 3 + ["medium"] * 3 + ["long"] * 3


def test_samples(spark):
    df = frame(spark, [(i,) for i in range(1000)], "id long")
    assert [r.id for r in S.evenly_spaced(df, "id", 7).orderBy("id").collect()] == np.linspace(0, 999, num=7, dtype=int).tolist()
    assert S.random_subset(df, "id", 0.05).count() == 50 and S.random_subset(df.limit(3), "id", 0.05).count() == 1
    f = S.fallback_split(df, "id")
    assert f.where("side = 'train'").count() == 900
    assert [(r.id, r.position) for r in with_position(df, "id").orderBy("id").collect()] == [(i, i) for i in range(1000)]
    assert S.fixed_sample(df, "id", 5).count() == 5 and S.first_rows(df, "id", 0).count() == 1000


# --- training sets


def test_examples(spark):
    df = frame(spark, [(1, "a b c"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r for r in T.tokenized(df, "t", "id", most=2, multiple=4).collect()}
    assert got[1].n_tokens == 2 and got[1].input_ids[2:] == [0, 0] and got[1].labels == [*got[1].input_ids[:2], -100, -100]
    assert got[2].input_ids == got[3].input_ids == []
    lengths = {r.id: r.input_ids for r in T.tokenized(df, "t", "id", most=9, multiple=1, encode=lambda ts: [[len(t)] for t in ts]).collect()}
    assert lengths == {1: [5], 2: [0], 3: [0]}


def test_budgets():
    assert T.parameter_report([(10, False), (30, True)]) == {"total": 40, "trainable": 30, "percent": 75.0}
    with pytest.raises(ValueError, match="more than"):
        T.check_parameters(3_000_000_001)


def test_checkpoints(spark):
    df = frame(spark, [("x/checkpoint-50",), ("x/checkpoint-100/",), ("x/final",)], "path string")
    assert tuple(latest_checkpoint(df).first()) == ("x/checkpoint-100/", 100)
    assert latest_checkpoint(df.where("path = 'x/final'")).count() == 0


def test_prompt_groups_with_null_and_repeated_ids(spark):
    rows = [(None, "A  b", "x"), (None, "a b", "y"), (1, "c", None), (1, "c", ""), (2, "c", "z"), (3, "", "x"), (4, None, "x"), (5, "only", "x"), (None, "d", "x"), (None, "d", "x")]
    df = spark.createDataFrame(rows, "id long, p string, r string")
    got = {r.prompt: (r.n_rows, r.n_responses, r.row_ids) for r in D.prompt_groups(df, "p", "r", "id", normalize=True).collect()}
    texts = dict(got)
    assert texts.pop("c") == (3, 2, [1, 1, 2]) and texts.pop("d") == (2, 1, [])
    (prompt, group), = texts.items()
    assert prompt == "a b" and group == (2, 2, [])
    plain = {r.prompt: r.n_rows for r in D.prompt_groups(df, "p", "r", "id").collect()}
    assert plain == {"c": 3, "d": 2}
    assert D.prompt_groups(df.limit(0), "p", "r", "id").count() == 0
    parts = {}
    for r in D.exact_components(df.where("id IS NOT NULL"), "p", "id").collect():
        parts.setdefault(r.component, set()).add(r.id)
    assert parts == {1: {1, 2}, 3: {3, 4}, 5: {5}}


def test_vectors_are_packed_exactly(monkeypatch):
    """Grams that the sample does not know, counts beyond 8 bits and steps beyond 254 keep their part in a score, and bounds
    hold for all pairs, also by a basis of few texts."""
    r = random.Random(3)
    texts = ["a" * 400 + " b", "a" * 390 + " c", "zzz " * 700, *(" ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(r.randint(3, 120))) for _ in range(60))]
    texts += [t + " more" for t in texts[:20]]
    grams = [N.gram_counts(t) for t in texts]
    monkeypatch.setattr(N, "WORDS", 3000)
    basis = N.Basis(grams[1:12])
    hubs = N.Hubs(basis, [1, 2], grams[1:3], [0, 0], 0.9, 1)
    packed = pa.Table.from_batches([basis.pack(list(range(len(texts))), grams, [0] * len(texts), hubs)])
    block, v = N.Block(packed), N.Vectors(packed)
    want = np.array([[cosine(texts[a], texts[b]) for b in block.ids] for a in v.ids])
    for i in range(len(texts)):
        block.take(v, i)
        assert [block.score(p) for p in range(len(texts))] == pytest.approx(want[i].tolist(), abs=1e-6)
    monkeypatch.setattr(N, "SPARSE", 1 << 40)  # every tile by its grams
    i, p, most = block.near(v, lambda r, c, pairs=False: np.full(len(c), 0.9), lambda r, c: np.ones((len(r), len(c)), bool))
    assert {(a, b) for a, b in zip(i.tolist(), p.tolist())} >= set(zip(*(x.tolist() for x in np.nonzero(want >= 0.9))))
    assert (most + N.MARGIN >= want[i, p]).all() and len(i) < want.size / 2
    floor = dict(zip(v.ids.tolist(), v.floor.tolist()))
    assert all(floor[a] <= max(cosine(t, texts[1]), cosine(t, texts[2])) for a, t in enumerate(texts))
