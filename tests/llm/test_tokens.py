import hashlib
import json
import random

import pytest

from tests.llm import hard
from textloom.llm.pieces import Digests, check_model, decode_ids, encode_texts, encoding_digests, model_for
from textloom.llm.queries import tokenizer
from textloom.llm.token_counts import check_settings, counts_for, count_tokens

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
PARTS = ["a", "b", "the", " ", "  ", " " * 15, " " * 31, "\n", "\t", "é", "日", "😀", "<s>", "<0x0A>", "<|endoftext|>", "<|", "▁", "23", "'s", "!", "\xa0", "ſ", "ab" * 40, "hello", " world", "\x00", "при", "[", "];\n", "://", "x" * 700]


def strings(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(tokenizer(BYTES)), counts_for(tokenizer(BYTES))
    for s in strings(4000, 1):
        assert mine.of(s) == len(lib.encode(s, add_special_tokens=False).ids), repr(s)


def test_whole_strings_are_proven():
    from tokenizers import Tokenizer

    lib, v = Tokenizer.from_file(tokenizer(BYTES)), counts_for(tokenizer(BYTES)).vocabulary
    for s in random.Random(2).sample(sorted(v.whole), 2000):
        assert len(lib.encode(s, add_special_tokens=False).ids) == 1


def test_short_and_long_merges_agree():
    v = counts_for(tokenizer(BYTES)).vocabulary
    r = random.Random(3)
    for _ in range(300):
        s = "".join(r.choices("abcdetionsr", k=r.randint(1, 90)))
        symbols = [v.byte_id[b] for b in s.encode()]
        assert v._merge_short(list(symbols)) == v._merge_long(list(symbols))


def test_pieces_equal_the_library():
    import sentencepiece

    lib, m = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES)), model_for(tokenizer(PIECES))
    d = Digests(m)
    for s in strings(4000, 4):
        ids = lib.encode(s)
        assert m.encode(s) == ids, repr(s)
        assert m.decode(ids) == lib.decode(ids)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert d.of(s) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))


def test_other_files_are_refused(tmp_path):
    with open(tokenizer(BYTES)) as f:
        data = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": data["model"] | {"ignore_merges": True}}, {"added_tokens": [{"content": "<x>", "lstrip": True}]}):
        with pytest.raises(ValueError, match="the vocabulary"):
            check_settings(data | change)
    with pytest.raises(ValueError, match="the vocabulary"):
        counts_for(tokenizer("word_bpe_49k.json"))
    with open(tokenizer(PIECES), "rb") as f:
        model = f.read()
    varint = lambda field, value: bytes([field << 3, value])
    for part, settings in ((2, varint(3, 1)), (3, varint(3, 0)), (3, varint(4, 1)), (3, varint(5, 0)), (3, b"\x12\x01x"), (1, b"\x0a\x01q" + varint(3, 4))):
        path = tmp_path / "odd.model"
        path.write_bytes(model + bytes([part << 3 | 2, len(settings)]) + settings)  # a later field overrides an earlier one
        with pytest.raises(ValueError, match="the model"):
            check_model(str(path))
    check_model(tokenizer(PIECES))


def test_longest_matches():
    m = model_for(tokenizer(PIECES))
    for s in strings(300, 8):
        s = "".join(c for c in s if c in m.chars)[:80]
        for k in range(len(s)):
            want = max(j for j in range(1, len(s) - k + 1) if s[k : k + j] in m.id)
            assert next(v for e, v in m.automaton.iter(s[::-1]) if e == len(s) - 1 - k)[1] == want


def test_decoding_of_any_ids():
    import sentencepiece

    lib, m = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES)), model_for(tokenizer(PIECES))
    r = random.Random(5)
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), 13, 259]) for _ in range(r.randint(0, 9))]
        assert m.decode(ids) == lib.decode(ids), ids


@pytest.mark.parametrize("op", ["count", "digest"])
def test_hard_documents(spark, op):
    df = hard.frame(spark)
    rows = [(i, t or "") for i, t, *_ in hard.documents()]
    key = lambda x: (x[0] is None, x)
    if op == "count":
        c = counts_for(tokenizer(BYTES))
        got = [tuple(r) for r in count_tokens(df, tokenizer(BYTES), limit=50).collect()]
        want = [(i, len(t.encode()), c.of(t), c.of(t) > 50) for i, t in rows]
        assert count_tokens(hard.empty(spark), tokenizer(BYTES)).count() == 0
    else:
        d = Digests(model_for(tokenizer(PIECES)))
        got = [tuple(r) for r in encoding_digests(df, tokenizer(PIECES)).collect()]
        want = [(i, *d.of(t)) for i, t in rows]
        assert encoding_digests(hard.empty(spark), tokenizer(PIECES)).count() == 0
    assert sorted(got, key=key) == sorted(want, key=key)


def test_round_trip(spark):
    ids = encode_texts(hard.frame(spark), tokenizer(PIECES))
    back = decode_ids(ids, tokenizer(PIECES))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, *_ in hard.documents())
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.text for r in decode_ids(odd, tokenizer(PIECES)).collect()} == {""}
