import re

from pyspark.sql import functions as F

from tests.llm import hard
from textloom.llm.line_dedup import dedup_lines


def plain(rows):
    """(id, text) in any order -> the kept text of each, by (id, text)."""
    places = sorted({(i is not None, i, t) for i, t in rows}, key=lambda x: (x[0], x[1] or 0, x[2]))
    first, gone = {}, {}
    for p in places:
        lines = p[2].split("\n")
        content = [k for k, x in enumerate(lines) if re.search(r"[^ \t-\r]", x)]
        for a in range(len(content) - 2):
            w = content[a : a + 3]
            if first.setdefault(tuple(lines[k] for k in w), (p, a)) != (p, a):
                gone.setdefault(p, set()).update(w)
    return {(p[1], p[2]): "\n".join(x for k, x in enumerate(p[2].split("\n")) if k not in gone.get(p, ())) for p in places}


def test_against_plain(spark):
    rows = [(i, t or "") for i, t, *_ in hard.documents()]
    rows = [r for r in rows if r[0] != 6]  # two texts of one id are ordered by a hash, which plain() does not know
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    want = plain(rows)
    out = dedup_lines(df, stats_col="n")
    assert out.columns == ["doc_id", "text", "source", "n"]
    got = [(r.doc_id, r.text) for r in out.collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(((i, want[i, t]) for i, t in rows), key=key)


def test_blocks_of_lines(spark):
    block = "one a\ntwo b\n\nthree c\nfour d"
    rows = [(1, f"head\n{block}\ntail"), (2, f"{block}"), (3, "one a\ntwo b\nother"), (4, f"x\n{block}\n{block}"), (5, "\n\n\n\n"), (6, "\n\n\n\n")]
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1]
    assert out[2] == ""  # the blank line between goes only if a line around it does: it is no content and stays
    assert out[3] == rows[2][1]
    assert out[5] == out[6] == "\n\n\n\n"
    assert out[4].startswith("x")


def test_clashing_columns_and_empty(spark):
    df = hard.frame(spark)
    out = dedup_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert dedup_lines(hard.empty(spark)).count() == 0
    assert "Python" not in dedup_lines(df.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert out.where(F.col("text").isNull()).count() == 0
