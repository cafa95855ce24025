import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from lodeglass.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_escape_is_reversible():
    rng = random.Random(3)
    for _ in range(2000):
        s = "".join(rng.choice("<|\\ab\nim_start>") for _ in range(rng.randrange(14)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        r = "".join(rng.choice("<|\\n\nab") for _ in range(5))
        assert list(chat.parse(chat.render(r, s)[0] + chat.render("user", r)[0])) == [(r, s), ("user", r)]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as part", "'z' as segment")


def want(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ODD = ["\n\nfoo", "<|im_sep|>", " <|endoftext|> ", "foo\n\n", "<|im_end|><|im_start|>assistant ok", None, "", "  two\n\n spaces ", "é😀 <\\| <|", "\n", "x" * 300, "<", "|im_end|>"]


@pytest.mark.parametrize("chars", [50, 100_000])
def test_digests_read_back(spark, chars):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "a\nb"]), rng.choice(ODD)) for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "assistant", f"turn {t}") for t in range(400)] + [(7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 1, "assistant", "lost"), (8, None, "assistant", "no turn")]
    rng.shuffle(rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(chat.format_conversations(table(spark, rows), PATH, chars), PATH).collect()}
    assert got == want(rows)


def test_masks_follow_tokens(spark):
    rows = [(1, 0, "user", "hi there"), (1, 1, "assistant", " \n 日本 ok.")]
    r = chat.format_conversations(table(spark, rows), PATH).first()
    t = chat.chat_tokenizer(PATH)
    ids, loss = np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.loss, np.uint8)
    assert t.decode(ids, skip_special_tokens=False) == r.text and len(ids) == len(loss)
    assert "ok." in t.decode([i for i, m in zip(ids, loss) if m]) and "hi" not in t.decode([i for i, m in zip(ids, loss) if m])
    assert [r.text[s.first : s.after] for s in r.loss_spans] == [" \n 日本 ok."]


def test_no_token_reaches_over_a_texts_edges(spark):
    texts = ["\n\nfoo", "foo\n\n", " ", "\n", "é", "<|im_sep|>x", "日" * 50]
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)]
    r, known = chat.format_conversations(table(spark, rows), PATH).first(), chat.token_bytes(chat.chat_tokenizer(PATH))
    assert list(chat.masked_texts(np.frombuffer(r.ids, "<u4"), np.frombuffer(r.loss, np.uint8), known)) == texts
    assert [chat.unescape(r.text[s.first : s.after]) for s in r.loss_spans] == texts


def test_digests_read_the_mask(spark):
    segments = chat.format_conversations(table(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "there")]), PATH)
    changed = segments.selectExpr("conv_id", "part", "segment", "text", "ids", "unhex(replace(hex(loss), '01', '00')) as loss")
    assert [r.loss_chars for r in chat.conversation_digests(changed, PATH).collect()] == [0]


def test_a_very_long_turn(spark):
    rows = [(1, 0, "assistant", "word <| " * 60_000), (1, 1, "assistant", "end")]
    got = chat.conversation_digests(chat.format_conversations(table(spark, rows), PATH), PATH).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == want(rows)[1]


def test_cutting_between_turns_leaves_the_tokens(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f" part {t}\n\n") for t in range(30)]
    ids = lambda n: np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(chat.format_conversations(table(spark, rows), PATH, n).collect(), key=lambda r: (r.part, r.segment))]).tolist()
    assert ids(20) == ids(10**9)


def test_no_conversations(spark):
    assert chat.conversation_digests(chat.format_conversations(table(spark, []), PATH), PATH).collect() == []
