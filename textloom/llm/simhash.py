"""SimHash near-dedup by a binary-trie self-join.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Equal fingerprints are one leaf of a
binary trie over the bits. The trie is joined with itself: pairs of nodes are traversed together from the root, differing
bits add up on the way, and a pair is pruned as soon as they exceed the error budget.

To spread the join over a cluster, the 64 bits are cut into blocks, one more than the budget: two fingerprints within the
budget agree in one block at least. For each block the fingerprints that agree in it form a sub-trie, the unit of work; a
node pair of a sub-trie starts with no error in that block. Sub-tries with very many leaves are cut further into node
pairs at a greater depth (only pairs within the budget exist), each again a unit of work, so none exceeds what a task
holds, and no link is lost. A unit gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from textloom.llm.common import arrow_map, doc_rows, hex_of
from textloom.operators.components import connected_components
from textloom.plans.storage import materialize

SHINGLE, SEED, BUDGET, BITS = 4, 42, 4, 64
#: A sub-trie of more leaves is cut into node pairs.
MOST_LEAVES = 20_000
#: The deepest cut: at most 2**DEEPEST nodes of one sub-trie.
DEEPEST = 10
#: Leaves of one vectorised traversal, node pairs of one step of it, and leaf pairs below which a node pair is compared.
TOGETHER, STEP, COMPARE = 100_000, 400_000, 128


def fingerprint(text: str) -> int:
    """Of the text with A-Z lower-cased; its shingles are runs of four words, or all of fewer words; no word gives zero."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line, k = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter([digest(line[a:z], SEED) for a, z in zip(starts[:n], (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 14):
        part = h[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of each row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return arrow_map(doc_rows(df, id_col, text_col), run, "doc_id long, fp long")


# --- the trie self-join of many units at once


class Trie:
    """Leaves of several units side by side, ascending within each; a node is a range of leaves with a common prefix."""

    def __init__(self, leaves: np.ndarray):
        self.leaves = leaves
        self.label = np.arange(len(leaves))
        self._ones: dict[int, np.ndarray] = {}

    def ones(self, bit: int) -> np.ndarray:
        """Prefix counts of the leaves that have the bit: where a node's children part is a difference of two."""
        c = self._ones.get(bit)
        if c is None:
            c = np.zeros(len(self.leaves) + 1, np.int32)
            np.cumsum((self.leaves >> np.uint64(bit)) & np.uint64(1), out=c[1:], dtype=np.int32)
            self._ones[bit] = c
        return c

    def join(self, pairs: np.ndarray) -> None:
        """Link all leaves within the budget, from node pairs (start a, end a, start b, end b; equal nodes or disjoint)."""
        todo = [(BITS - 1, np.hstack([pairs, np.zeros((len(pairs), 1), np.int64)]))]
        while todo:
            bit, p = todo.pop()
            if len(p) > STEP:
                todo += [(bit, p[i : i + STEP]) for i in range(0, len(p), STEP)]
                continue
            p = p[~self.joined(p)]
            small = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]) <= COMPARE
            if bit < 0:
                small[:] = True
            if small.any():
                self.compare(p[small])
            p = p[~small]
            if len(p):
                todo.append((bit - 1, self.children(bit, p)))

    def joined(self, p: np.ndarray) -> np.ndarray:
        """Which pairs hold leaves of one known component only: nothing new can come of them."""
        change = np.zeros(len(self.label), np.int64)
        change[1:] = np.cumsum(self.label[1:] != self.label[:-1])
        same = (change[p[:, 0]] == change[p[:, 1] - 1]) & (change[p[:, 2]] == change[p[:, 3] - 1])
        return same & (self.label[p[:, 0]] == self.label[p[:, 2]]) & ((p[:, 0] != p[:, 2]) | (p[:, 1] - p[:, 0] > 1))

    def children(self, bit: int, p: np.ndarray) -> np.ndarray:
        c = self.ones(bit)
        a0, a1, b0, b1, e = p.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        own = a0 == b0
        found = [
            np.stack([a0, am, b0, bm, e], 1),
            np.stack([am, a1, bm, b1, e], 1),
            np.stack([a0, am, bm, b1, e + 1], 1),
            np.stack([am, a1, b0, bm, e + 1], 1)[~own],  # of a node with itself, the mirror image
        ]
        q = np.concatenate(found)
        return q[(q[:, 0] < q[:, 1]) & (q[:, 2] < q[:, 3]) & (q[:, 4] <= BUDGET)]

    def compare(self, p: np.ndarray) -> None:
        wide = p[:, 3] - p[:, 2]
        size = (p[:, 1] - p[:, 0]) * wide
        bounds = np.concatenate([[0], np.cumsum(size)])
        for s in np.split(np.arange(len(p)), np.searchsorted(bounds, np.arange(STEP, bounds[-1], STEP))):
            if not len(s):
                continue
            which = np.repeat(s, size[s])
            k = np.arange(len(which)) - np.repeat(bounds[s] - bounds[s[0]], size[s])
            i, j = p[which, 0] + k // wide[which], p[which, 2] + k % wide[which]
            near = (i < j) & (self.label[i] != self.label[j])
            i, j = i[near], j[near]
            near = np.bitwise_count(self.leaves[i] ^ self.leaves[j]) <= BUDGET
            self.link(i[near], j[near])

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        self.label = label


def _joined_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit (block, agreed bits, node pair), then fingerprint -> edges of spanning forests."""

    def edges(unit: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate([[0], np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1, [len(unit)]])
        start, end = first[:-1], first[1:]
        # a unit of two different nodes joins only the one with the other
        middle = start + np.add.reduceat((node == unit[:, 2]).astype(np.int64), start)
        own = unit[start, 2] == unit[start, 3]
        pairs = np.stack([start, np.where(own, end, middle), np.where(own, start, middle), end], 1)
        trie = Trie(fp)
        trie.join(pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])])
        at = np.flatnonzero(trie.label != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[at]), pa.array(signed[trie.label[at]])], ["u", "v"])

    def judged(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        return edges(rows[:, :4], rows[:, 5].copy().view(np.uint64) ^ np.uint64(1 << 63), rows[:, 4])

    # whole units wait until they are many; the rows of the last unit, which may go on, are apart
    whole: list[np.ndarray] = []
    last: list[np.ndarray] = []
    size = 0
    for b in batches:
        rows = np.stack([np.asarray(c) for c in b.columns], 1)
        if not len(rows):
            continue
        before = last[-1][-1:, :4] if last else rows[:1, :4]
        new = np.flatnonzero((rows[:, :4] != np.concatenate([before, rows[:-1, :4]])).any(axis=1))
        if len(new):
            done = [*last, rows[: new[-1]]]
            whole += done
            size += sum(map(len, done))
            last = [rows[new[-1] :]]
        else:
            last.append(rows)
        if size >= TOGETHER:
            yield judged(whole)
            whole, size = [], 0
    if whole or last:
        yield judged(whole + last)


def near_pairs(fps: DataFrame) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fp`` that connect all and only those within the budget."""
    blocks = BUDGET + 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    agreed = F.array(*(F.struct(F.lit(i).cast("long").alias("block"), F.col("fp").bitwiseAND(_signed(((1 << (z - a)) - 1) << a)).alias("bits")) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))))
    rows = fps.select("fp", F.explode(agreed).alias("k")).select("fp", "k.*")
    # how deep each sub-trie is cut, so that a node has about MOST_LEAVES leaves; a sub-trie below that is one unit
    deep = F.least(F.lit(DEEPEST), F.ceil(F.log2(F.col("n") / MOST_LEAVES))).cast("int")
    hot = rows.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_LEAVES).select("block", "bits", deep.alias("deep"))
    hot = materialize(hot)
    if hot.isEmpty():
        units = rows.select("block", "bits", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("node"), "fp")
    else:
        marked = rows.join(hot, ["block", "bits"], "left").withColumn("deep", F.coalesce("deep", F.lit(0)))
        # the node: the highest bits outside the agreed block
        high = F.expr(f"shiftrightunsigned(fp, {BITS} - deep - if(block = {blocks - 1}, {BITS - cuts[-2]}, 0))")
        node = F.when(F.col("deep") == 0, F.lit(0).cast("long")).otherwise(high.bitwiseAND(F.expr("shiftleft(1L, deep) - 1")))
        other = F.expr(f"filter(sequence(0L, shiftleft(1L, deep) - 1), x -> bit_count(x ^ node) <= {BUDGET})")
        marked = marked.withColumn("node", node).withColumn("other", F.explode(other))
        units = marked.select("block", "bits", F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"), "node", "fp")
    # fingerprints are sorted as unsigned numbers: the sign bit is flipped, and back when they are read
    units = units.withColumn("fp", F.col("fp").bitwiseXOR(_signed(1 << 63)))
    dealt = units.repartition("block", "bits", "lo", "hi").sortWithinPartitions("block", "bits", "lo", "hi", "node", "fp")
    return arrow_map(dealt.select("block", "bits", "lo", "hi", "node", "fp"), _joined_units, "u long, v long")


def _signed(x: int):
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``: the least id that is reachable
    over fingerprints with at most four differing bits, the row's own included.

    Null and empty texts have fingerprint zero and are linked like any other. A null id takes no part in the least id; a
    component of null ids only has a null ``component_id``. Repeated rows give repeated rows, an empty table gives none,
    further columns are ignored. Texts are never shuffled; copies collapse into one fingerprint by partial aggregation
    before anything is joined.
    """
    docs = materialize(fingerprints(df, id_col, text_col))
    leaves = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(near_pairs(leaves.select("fp")))
    root = materialize(leaves.join(linked, leaves.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    # written before it is joined back: a join right above the aggregation could not split a component of very many rows
    ids = materialize(root.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r"))
    named = root.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return docs.join(named, docs.fp == named.f).select("doc_id", hex_of(docs.fp).alias("fingerprint"), "component_id")


def first_of_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each component, all columns kept: the row with the least id (null ids come after all others),
    of several such rows the first by its columns. Rows are told apart by their own fingerprints, so a null id, or an id
    that is repeated in another component, takes no row away.

    Each row carries its fingerprint and is joined by it and the id with the fingerprints that hold their component's
    least id; what is left is one row a component, but for repeated and null ids.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t or "") for t in b.column(text_col).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], [*b.schema.names, "row_fp"])

    rows = materialize(arrow_map(df, run, StructType([*df.schema.fields, StructField("row_fp", LongType())])))
    leaves = materialize(rows.groupBy(F.col("row_fp").alias("fp")).agg(F.min(id_col).alias("least")))
    linked = connected_components(near_pairs(leaves.select("fp")))
    root = materialize(leaves.join(linked, leaves.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    ids = materialize(root.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r"))
    lead = root.join(ids, (F.col("root") == F.col("r")) & F.col("least").eqNullSafe(F.col("component_id"))).select("fp", "least", "root")
    kept = rows.hint("merge").join(lead, (rows.row_fp == lead.fp) & rows[id_col].eqNullSafe(lead.least))
    first = F.row_number().over(W.partitionBy("root").orderBy(*columns))
    return kept.withColumn("first_of_root", first).where("first_of_root = 1").select(*columns)
