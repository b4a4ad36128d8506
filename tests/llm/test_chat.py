import hashlib
import itertools
import random

from tests.llm import hard
from textloom.llm import chat as T

HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\\\|", "<", "|", "<|", "", "a\nb", "\\", "<<||>>", "日本 <|im_start|>"]


def plain_fold(events):
    """A straightforward state machine over the sorted log."""
    state = {}
    for _, event, message, role, text in sorted(events, key=lambda e: e[0]):
        if event == "regenerate":
            state = {m: v for m, v in state.items() if m < message}
        elif event == "edit":
            state[message] = [role, text or ""]
        elif event in ("message", "delta"):
            if message in state:
                state[message][1] += text or ""
            else:
                state[message] = [role, text or ""]
    return [(m, r or "", t) for m, (r, t) in sorted(state.items())]


def logs(n=60, seed=1):
    r = random.Random(seed)
    for c in range(n):
        yield c, [(s, r.choice(["message", "delta", "delta", "edit", "regenerate"]), r.randint(0, 4), "assistant" if r.random() < 0.5 else "user", r.choice([*HARD, "word ", None])) for s in range(r.randint(1, 25))]


def test_fold_against_a_state_machine(spark):
    want, rows = {}, []
    for c, events in logs():
        roles = {}
        events = [(s, e, m, roles.setdefault(m, role), t) for s, e, m, role, t in events]  # one role a message
        rows += [(c, *e) for e in events]
        want[c] = plain_fold(events)
    df = spark.createDataFrame(rows, "conv_id long, seq long, event string, message long, role string, text string").repartition(5)
    got = {}
    for r in T.fold_events(df).collect():
        got.setdefault(r.conv_id, []).append((r.message, r.role, r.text))
    assert {c: sorted(v) for c, v in got.items()} == {c: v for c, v in want.items() if v}


def test_read_back(spark):
    r = random.Random(2)
    turns = [(c, t, r.choice(["user", "assistant", "system", None, "odd%0A\n<|role"]), r.choice([*HARD, None, "x" * 5000])) for c in [*range(40), None] for t in r.sample(range(20), r.randint(1, 9))]
    turns += [(3, 50, "user", "tie b"), (3, 50, "user", "tie a"), (3, 50, "user", "tie a")]
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], "conv_id long, turn long, role string, text string, seq int, message int").repartition(4)
    got = {x.conv_id: x for x in T.chat_digests(T.format_chats(T.turns_as_events(df))).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1], t[2] is not None, t[2] or "", t[3] is not None, t[3] or ""))
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        loss = "".join(text or "" for _, _, role, text in own if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), sha(said), len(loss), sha(loss))
    assert len(got) == len({t[0] for t in turns})
    assert T.chat_digests(T.format_chats(T.turns_as_events(df.limit(0)))).count() == 0


def test_one_shuffle(spark):
    """Folding, rendering and reading back all work on a conversation's rows where the first shuffle has put them."""
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    plan = T.chat_digests(T.format_chats(T.turns_as_events(df)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_hard_documents_and_a_long_conversation(spark):
    """Odd documents as turns: clashing columns, nulls, long texts, repeated rows; and many turns of one conversation."""
    rows = hard.frame(spark).selectExpr("doc_id % 3 AS conv_id", "doc_id AS turn", "if(doc_id % 2 = 0, 'user', 'assistant') AS role", "text", "fp", "`row`", "stats AS part", "key AS b")
    rows = rows.unionByName(spark.range(6000).selectExpr("77L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('<|', id, repeat(' é', 20)) AS text"), allowMissingColumns=True)
    got = {r.conv_id: r for r in T.chat_digests(T.format_chats(T.turns_as_events(rows))).collect()}
    for c, want in itertools.groupby(sorted(((r.conv_id is not None, r.conv_id, r.turn is not None, r.turn, r.role is not None, r.role or "", r.text is not None, r.text or "") for r in rows.collect()), key=lambda r: tuple(x or 0 if i in (1, 3) else x for i, x in enumerate(r))), key=lambda r: r[1]):
        want = list(want)
        loss = "".join(r[7] for r in want if r[5] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256) == (len(want), sha("".join(f"{r[5]}\n{r[7]}\n" for r in want)), sha(loss)), c
    assert got[77].n_turns == 6000


def test_spans_mark_the_loss_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "日 <|x"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    f = T.format_chats(T.turns_as_events(df)).first()
    assert [f.formatted[s.start : s.start + s.length] for s in f.loss_spans] == ["日 <\\|x", ""]
    assert f.formatted.count("<|im_start|>") == 3 == f.formatted.count("<|im_end|>")
    assert "Python" not in T.format_chats(T.turns_as_events(df))._jdf.queryExecution().toString()
