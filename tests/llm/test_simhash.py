import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm import hard
from textloom.llm import simhash as S
from textloom.operators.components import connected_components


def plain_fingerprint(text: str) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids):
    u, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 4):
            parent[root(int(j) + i + 1)] = root(i)
    least = {}
    for i, x in enumerate(ids):
        r = root(i)
        least[r] = x if least.get(r) is None else least[r] if x is None else min(least[r], x)
    return [least[root(i)] for i in range(len(u))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_spark_hash_is_the_shingle_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] == signed(xxhash.xxh64_intdigest(b"a b c d", 42))


def test_hard_documents(spark):
    rows = [(i, t or "") for i, t, *_ in hard.documents()]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components(fps, [i for i, _ in rows]), strict=True)]
    got = [tuple(r) for r in S.simhash_components(hard.frame(spark)).collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert S.simhash_components(hard.empty(spark)).count() == 0


@pytest.mark.parametrize(("most", "centres", "each", "flips"), [(20_000, 150, 8, 5), (50, 20, 60, 6), (20, 3, 400, 7), (10, 800, 1, 0)])
def test_join_of_clusters(spark, monkeypatch, most, centres, each, flips):
    monkeypatch.setattr(S, "MOST_LEAVES", most)  # small: sub-tries are cut into node pairs
    r, fps = random.Random(5), set()
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(r.randint(0, flips)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    edges = S.near_pairs(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    named = {x.node: x.component for x in connected_components(edges).collect()}
    assert [named.get(signed(x), signed(x)) for x in fps] == plain_components(fps, [signed(x) for x in fps])
    assert edges.count() < (S.BUDGET + 1) * len(fps) * (1 if most > 1000 else 400)
