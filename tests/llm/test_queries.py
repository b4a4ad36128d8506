import pytest

from tests.oracle import compare
from textloom.llm.queries import FURTHER, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES | FURTHER) and all(isinstance(s, str) for s in ORACLE_SQL.values())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, (QUERIES | FURTHER)[name], ORACLE_SQL[name]) == ""


def test_results_have_the_columns_agreed_on(spark):
    want = {
        "op1": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op2": {"doc_id", "fingerprint", "component_id"}, "op5": {"doc_id", "held_out", "score", "predicted"},
        "op6": {"page_id", "host", "path", "rule", "verdict"}, "op7": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}, "op8": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op9": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op10": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    }
    long = {"n_bytes", "n_tokens", "n_turns", "loss_chars", "formatted_chars", "n_removed", "n_spans", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    for name, query in QUERIES.items():
        if (op := name.split("_")[0]) in want:
            types = dict(query(spark, "/root/testdata/sf0.001").dtypes)
            assert want[op] <= set(types), name
            assert all(types[c] == "bigint" for c in long & set(types)), name
            assert types.get("predicted", "int") == "int" and types.get("score", "double") == "double"
