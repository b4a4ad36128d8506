import itertools
import random
import time

import numpy as np

from tests.llm import hard
from textloom.llm import decontaminate as D
from textloom.llm.queries import QUERIES


def corpus(seed=2):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(words, k=r.randint(3, 60)))) for i in range(60)]
    items += [(99, items[5][1].upper() + "!"), (None, items[7][1]), (100, None), (101, "")]
    docs = []
    for i in range(400):
        doc = r.choices(words, k=r.randint(0, 80))
        w = (items[r.randrange(60)][1]).split()
        if r.random() < 0.7:
            w = [x if r.random() > 0.12 else r.choice(words) for x in w[r.randint(0, len(w) // 2) :]]
            at = r.randint(0, len(doc))
            doc[at:at] = w
        docs.append((i, " ".join(doc)))
    return items, docs


def plain(words, index):
    """All items with a good enough overlap on any diagonal."""
    out = set()
    for n, w in enumerate(index.items):
        for d in range(-len(w) + 1, len(words)):
            a, z = max(0, -d), min(len(w), len(words) - d)
            match, need = words[a + d : z + d] == w[a:z], min(D.LEAST_MATCHES, D.SHARE * len(w))
            if z - a >= min(5, len(w)) and match.sum() >= need and D.best_stretch(match)[2] >= need:
                out.add(n)
                break
    return out


def test_finds_what_a_full_comparison_finds():
    items, docs = corpus()
    index = D.Index([(i, t or "") for i, t in items])
    spellings = D.Spellings(index.known)
    some = 0
    for _, t in docs:
        words = spellings.words(t)
        want = plain(words, index)
        some += len(want)
        assert {o[0] for o in index.overlaps(words)} == want
    assert some > 100


def most_matches(match):
    """By all stretches: the most matches of one of which at most a fifth differ."""
    n = len(match)
    return max((m for a in range(n) for z in range(a + 1, n + 1) if 5 * (m := sum(match[a:z])) >= 4 * (z - a)), default=0)


def test_stretch_with_the_most_matches():
    r = random.Random(3)
    cases = [[c == "1" for c in f"{i:0{n}b}"] for n in range(11) for i in range(1 << n)]
    cases += [[r.random() < share for _ in range(n)] for share in (0.7, 0.8, 0.9) for n in range(11, 60)]
    for match in cases:
        start, length, matches = D.best_stretch(np.array(match, bool))
        part = match[start : start + length]
        assert matches == sum(part) == most_matches(match) and 5 * matches >= 4 * length
        assert not length or (part[0] and part[-1])


def test_substitutions_anywhere():
    """Items of 8 words and more are found wherever the words that the rule lets differ stand."""
    for n, most in ((8, 1), (9, 1), (10, 2), (13, 2), (14, 2), (16, 3), (18, 3), (20, 4)):
        item = [f"w{i}" for i in range(n)]
        index = D.Index([(1, " ".join(item))])
        spellings = D.Spellings(index.known)
        for k in range(most + 1):
            for at in itertools.combinations(range(n), k):
                words = spellings.words(" ".join("x" if i in at else w for i, w in enumerate(item)))
                wanted = most_matches([i not in at for i in range(n)])
                found = index.overlaps(words)
                if 5 * wanted >= 4 * n or wanted >= 13:
                    assert [o[4] for o in found] == [wanted], (n, at)
                else:
                    assert not found


def test_every_pattern_of_replaced_words():
    """Items of 1 to 21 words, with every set of words replaced that the rule may accept, at any place of a text."""
    for n in range(1, 22):
        index = D.Index([(1, " ".join(f"w{i}" for i in range(n)))])
        item = index.items[0]
        most = n - int(np.ceil(min(D.LEAST_MATCHES, D.SHARE * n) - 1e-9))
        need = min(D.LEAST_MATCHES, D.SHARE * n)
        for k in range(min(4, most) + 1):
            for at in itertools.combinations(range(n), k):
                match = np.ones(n, bool)
                match[list(at)] = False
                wanted = D.best_stretch(match)[2]
                words = np.concatenate([[D.UNKNOWN] * 3, np.where(match, item, D.UNKNOWN), [D.UNKNOWN]])
                assert [o[4] for o in index.overlaps(words)] == ([wanted] if wanted >= need else []), (n, at)


def test_equal_words_cost_little():
    began = time.monotonic()
    for period in (1, 2, 3):
        words = [f"w{i % period}" for i in range(20_000)]
        index = D.Index([(1, " ".join(words[:2000]))])
        found = index.overlaps(D.Spellings(index.known).words(" ".join(words)))
        assert found == [(0, 0, 0, 2000, 2000)]
    assert time.monotonic() - began < 60


def test_registered_query_against_a_full_comparison(spark):
    """The query on all documents of the smallest table: every diagonal of every document and item is compared."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect()
    items = [(r.item_id, r.text or "") for r in read("benchmark")]
    index = D.Index(items)
    spellings = D.Spellings(index.known)
    want = set()
    for r in read("documents"):
        words = spellings.words(r.text or "")
        for n, w in enumerate(index.items):
            # only diagonals with enough words in common can matter
            common = np.flatnonzero(np.isin(words, w))
            places = {x: np.flatnonzero(w == x) for x in set(w.tolist())}
            d = [int(i - j) for i in common for j in places[int(words[i])]]
            values, counts = np.unique(np.array(d, np.int64), return_counts=True)
            need = min(D.LEAST_MATCHES, D.SHARE * len(w))
            for x in values[counts >= need].tolist():
                a, z = max(0, -x), min(len(w), len(words) - x)
                if D.best_stretch(words[a + x : z + x] == w[a:z])[2] >= need:
                    want |= {(r.doc_id, i) for i in index.ids[n]}
                    break
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and want


def test_short_items_with_a_word_replaced_or_cut_off():
    for n in (5, 6, 7):
        item = [f"w{i}" for i in range(n)]
        index = D.Index([(1, " ".join(item))])
        spellings = D.Spellings(index.known)
        for at in range(n):
            words = ["x" if i == at else w for i, w in enumerate(item)]
            for text in (words, ["y", "z", *words, "y"]):
                found = index.overlaps(spellings.words(" ".join(text)))
                assert [o[4] for o in found] == [n - 1], (n, at)
        assert index.overlaps(spellings.words(" ".join(item[1:])))


def test_broadcast_and_join_agree(spark, monkeypatch):
    items, docs = corpus()
    b = spark.createDataFrame(items, "item_id long, text string")
    docs += [(3, docs[3][1]), (None, docs[4][1]), (900, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted((tuple(r) for r in D.contaminated(d, b).collect()), key=repr)
    left = sorted((tuple(r) for r in D.decontaminate(d, b).collect()), key=repr)
    assert {r[0] for r in one if r[1] == 5} == {r[0] for r in one if r[1] == 99} != set()  # items that read alike
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    assert sorted((tuple(r) for r in D.contaminated(d, b).collect()), key=repr) == one
    assert sorted((tuple(r) for r in D.decontaminate(d, b).collect()), key=repr) == left
    hit = {r[0] for r in one}
    assert {i for i, _ in left if i is not None} == {i for i, _ in docs if i is not None} - hit


def test_hard_documents(spark):
    df = hard.frame(spark)
    b = spark.createDataFrame([(1, hard.documents()[0][1] or "some words that nobody says"), (2, None)], "item_id long, text string")
    assert D.decontaminate(df, b).columns == df.columns
    assert D.contaminated(hard.empty(spark), b).count() == 0
    assert D.decontaminate(df, b.limit(0)).count() == df.count()
    long_item = max((t for _, t, *_ in hard.documents() if t), key=lambda t: len(t.split()))
    found = D.contaminated(df, spark.createDataFrame([(7, long_item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_words, r.n_matches) for r in found] == [(34, 7, 6000, 6000)]
