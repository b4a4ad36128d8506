import hashlib
import re

import numpy as np
import sentencepiece

import corpus_pipeline
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_quality import plain_counts
from tests.llm.test_simhash import plain_components, plain_fingerprint
from textloom.llm import decontaminate as D
from textloom.llm import quality_rules as Q
from textloom.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


def plain_pipeline(docs, good, items):
    """{doc_id: text} through all stages, by the plain versions of the operators."""
    raw, target = np.ones(1 << Q.BITS), np.ones(1 << Q.BITS)
    grams = {i: Q.buckets([t.encode()])[0] for i, t in docs.items()}
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(target, g, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())

    def keep(i, t):
        n = plain_counts(t)
        return n[0] >= 20 and 100 * n[4] <= 30 * n[0] and (ratio[grams[i]].mean() if len(grams[i]) else 0) >= Q.THRESHOLD

    docs = {i: t for i, t in docs.items() if keep(i, t)}
    lines = plain_lines(list(docs.items()))
    docs = {i: lines[i, t] for i, t in docs.items()}
    ids = sorted(docs)
    group = plain_components([plain_fingerprint(docs[i]) for i in ids], ids)
    docs = {i: docs[i] for i, g in zip(ids, group, strict=True) if i == g}
    index = D.Index(items)
    spellings = D.Spellings(index.known)
    docs = {i: t for i, t in docs.items() if not index.overlaps(spellings.words(t))}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    encoded = {i: sp.encode(t) for i, t in docs.items()}
    return {(i, len(e), sha(",".join(map(str, e))), sha(sp.decode(e))) for i, e in encoded.items()}


def test_run_against_plain(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = {r.doc_id: r.text for r in read("documents").collect()}
    good = {r.doc_id for r in read("labels").where("quality = 1").collect()}
    want = plain_pipeline(docs, good, [(r.item_id, r.text) for r in read("benchmark").collect()])
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 0 < len(want) < len(docs)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    odd = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (77777, "", "en", "s", 0)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, docs.limit(0)):
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns or name == "encoding"
            assert (out.count() == 0) == (rows is not odd)
    assert re.match(r"doc_id", out.columns[0])


def test_every_group_keeps_one_row(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, None), (5, text("c")), (5, text("d")), (5, text("d")), (2, text("e")), (7, text("e")), (7, text("f")), (None, text("f")), (9, text("g")), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()), key=repr)
    want = [(None, text("a")), (None, text("b")), (5, text("c")), (5, text("d")), (2, text("e")), (7, text("f")), (9, text("g")), (9, "")]
    assert got == sorted(want, key=repr)
