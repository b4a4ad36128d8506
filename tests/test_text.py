import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.near_duplicates import gram_counts

TEXTS = ["  জ্বর   ও  ব্যথা ", None, "", " \t\n", "a\xa0b", "A\x1cB", "একটি", "abc 123 ১২৩ ক", "রোগীabc12।", "Tab\tNew\nLine", "é É"]


def column(spark, expr, rows=TEXTS, name="t"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], f"i long, {name} string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def plain_normalized(t):
    return re.sub(r"\s+", " ", t or "").strip().lower()


def test_normalized(spark):
    assert column(spark, X.normalized("t")) == [plain_normalized(t) for t in TEXTS]
    assert column(spark, X.normalized("t"))[0] == "জ্বর ও ব্যথা" and column(spark, X.normalized("t"))[1] == ""
    again = column(spark, X.normalized("t"))
    assert column(spark, X.normalized("t"), again) == again


def test_words_and_lengths(spark):
    assert column(spark, X.tokens("t")) == [plain_normalized(t).split() for t in TEXTS]
    assert column(spark, X.n_words("t")) == [len((t or "").split()) for t in TEXTS]
    assert column(spark, X.n_chars("t")) == [len(t or "") for t in TEXTS]


def test_scripts(spark):
    assert column(spark, X.class_count("t", X.BANGLA)) == [len(re.findall("[ঀ-৿]", t or "")) for t in TEXTS]
    assert column(spark, X.class_ratio("t", X.DIGIT)) == [len(re.findall("[0-9]", t or "")) / len(t) if t else 0 for t in TEXTS]
    assert column(spark, X.script_tokens("t"))[7] == ["abc", "123", "১২৩", "ক"]
    assert column(spark, X.script_tokens("t"))[8] == ["রোগী", "abc", "12"]


def test_small_functions(spark):
    assert column(spark, X.slug("t"), ["TF-IDF x"]) == ["tf_idf_x"] and column(spark, X.slug("t", hyphens=False), ["TF-IDF x"]) == ["tf-idf_x"]
    assert column(spark, X.contains_ignoring_case("t", "PAIN"), ["Chest pain", "pai n", None]) == [True, False, False]
    assert column(spark, X.key_values([("a", F.lit(0.123456), "%.4f"), ("b", F.lit(3), "%d")]), ["x"]) == ["a=0.1235;b=3"]
    assert re.fullmatch(r"smoke-\d{8}T\d{6}", column(spark, X.run_id("smoke"), ["x"])[0])
    assert column(spark, X.sha256("t"), ["é"]) == [hashlib.sha256("é".encode()).hexdigest()]
    assert column(spark, X.prefix("t", 2), ["abc", None]) == ["ab", ""]


def test_chat(spark):
    open_ = column(spark, X.chat_text(X.chat_messages("t", None, "S"), True), ["q"])[0]
    assert open_ == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"
    closed = column(spark, X.chat_text(X.chat_messages("t", F.lit(None), "S")), ["q"])[0]
    assert closed == open_ + "<|im_end|>\n"


def test_padding(spark):
    ids = F.array(*map(F.lit, range(5)))
    assert column(spark, X.padded(ids, 4, -100), ["x"]) == [[0, 1, 2, 3, 4, -100, -100, -100]]
    assert column(spark, X.padded(X.truncated(ids, 4), 4), ["x"]) == [[0, 1, 2, 3]]


def plain_grams(t):
    out = []
    for w in t.split():
        p = f" {w} "
        for n in range(3, 6):
            if len(p) <= n:
                out.append(p)
                break
            out += [p[i : i + n] for i in range(len(p) - n + 1)]
    return sorted(out)


def test_grams(spark):
    rows = ["ab cde a", "", "জ্বর ব্যথা", "x", "abcdefgh"]
    assert [sorted(g) for g in column(spark, X.char_grams("t"), rows)] == [plain_grams(t) for t in rows]
    assert len(plain_grams("ab cde a")) == 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé日", min_size=1, max_size=7), max_size=8))
def test_hashed_grams_are_the_same_multiset(words):
    from collections import Counter

    _, counts = gram_counts(" ".join(words))
    assert sorted(counts.tolist()) == sorted(Counter(plain_grams(" ".join(words))).values())
