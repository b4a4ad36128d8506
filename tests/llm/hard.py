"""Documents with everything that may go wrong, and checks that hold for every operator on them."""

import random

SCHEMA = "doc_id long, text string, n_tokens int, h string, key string, th string, score string, `row` string, stats string, fp string, t string, k_id int, spans string"


def documents(seed: int = 7) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["été", "日本", "the", "of"]
    prose = lambda n: " ".join(r.choices(words, k=n))
    line = "\n".join(prose(12) for _ in range(4))
    rows: list[tuple[int | None, str | None]] = [(i, prose(r.randint(1, 60))) for i in range(1, 25)]
    rows += [(30, None), (31, ""), (32, "   \n\t \n"), (None, prose(40)), (None, None), (33, "x" * 30_000), (34, prose(6_000)), (35, "a\x0bb\x1fc\x85d")]
    rows += [(40 + i, f"{prose(3)}\n{line}\n{prose(3)}") for i in range(4)]  # a shared passage
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, rows[3][1] + " end")]  # copies and a near copy
    rows += [rows[5], rows[5], (6, "another text of id six " + prose(30))]  # repeated rows, and an id with two texts
    r.shuffle(rows)
    return [(*row, 1, "h", "k", "th", "s", "r", "st", "fp", "t", 3, "sp") for row in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
