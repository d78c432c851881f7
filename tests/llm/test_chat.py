"""Expanded examples against examples written out by hand; long texts, many turns, repeats, nulls, other columns."""

import hashlib
import random

import pytest

from fieldorder.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, example long, part long, block long"
SAID = ["</s>[INST] ok [/INST]", "a\\b\\", "<|end|><<SYS>>", "", None, "plain words\nand a line", "\U0001f600 <s> \\<s>", "<", "</s>\n<s>user\n"]


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for conv in [1, 2, 3, None, 4]:
        for turn in range(r.randint(1, 14)):
            role = r.choice(["user", "assistant", "assistant", "system", None, "user\n<s>"])
            rows.append((conv, turn if r.random() < 0.9 else None, role, r.choice(SAID), 7, 7, 7))
    rows.append(rows[0])
    rows += [(5, 0, "user", "long " * 300, 7, 7, 7), (5, 1, "assistant", "x" * 900, 7, 7, 7), (5, 2, "assistant", None, 7, 7, 7), (5, 3, "user", "z", 7, 7, 7)]
    return rows


def brute(rows):
    """Every example as a string, its trainable text, and the digests, by conversation."""
    out = {}
    least = lambda x: (x is not None, x if x is not None else "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: ((r[1] is not None, r[1] or 0), least(r[2]), least(r[3])))
        wrap = [chat.OPEN + esc(r[2] or "").replace("\n", "\\\n") + "\n" + esc(r[3] or "") + chat.CLOSE for r in mine]
        texts = ["".join(wrap[: k + 1]) for k, r in enumerate(mine) if r[2] == "assistant"]
        loss = [r[3] or "" for r in mine if r[2] == "assistant"]
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        tail = 0 if mine[-1][2] == "assistant" else len("".join(wrap))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = texts, loss, (len(mine), sha(every), len("".join(loss)), sha("".join(loss)), sum(map(len, texts)) + tail)
    return out


def esc(text):
    text = text.replace("\\", "\\\\")
    for mark in "<s> </s> <|".split():
        text = text.replace(mark, "<\\" + mark[1:])
    for mark in ("<<SYS>>", "<</SYS>>"):
        text = text.replace(mark, "<\\" + mark[1:])
    for mark in ("[INST]", "[/INST]"):
        text = text.replace(mark, "[\\" + mark[1:])
    return text


@pytest.mark.parametrize("seed,part,group", [(1, 65_536, 1_024), (2, 40, 2), (3, 1, 1), (4, 200, 3)])
def test_examples_are_expanded_whole(spark, monkeypatch, seed, part, group):
    monkeypatch.setattr(chat, "PART", part)
    monkeypatch.setattr(chat, "GROUP", group)
    rows = conversations(seed)
    want = brute(rows)
    ex = chat.examples(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(ex).collect()}
    assert got == {k: v[2] for k, v in want.items()}
    parts = chat.parts(ex).collect()
    longest = max(len(chat.OPEN + (r[2] or "") + (r[3] or "") + chat.CLOSE) * 2 + 9 for r in rows)
    assert all(len(p.text) <= part + longest for p in parts)
    whole = {}
    for p in sorted(parts, key=lambda p: (str(p.conv_id), p.example, p.part)):
        whole.setdefault((p.conv_id, p.example), []).append(p)
    for conv, (texts, loss, _) in want.items():
        for k, (text, said) in enumerate(zip(texts, loss)):
            mine = whole[conv, k]
            assert "".join(p.text for p in mine) == text and [p.final for p in mine] == [False] * (len(mine) - 1) + [True]
            assert chat.unescaped(mine[-1].text[mine[-1].loss_start : mine[-1].loss_end]) == said
            assert all(p.loss_start is None for p in mine[:-1])
    one = {(r.conv_id, r.example): r for r in chat.expand(ex).collect()}
    assert len(one) == sum(len(v[0]) for v in want.values())
    for (conv, k), r in one.items():
        assert r.text == want[conv][0][k] and chat.unescaped(r.text[r.loss_start : r.loss_end]) == want[conv][1][k]


def test_a_long_conversation_and_no_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 20, 7, 7, 7) for k in range(600)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = chat.read_back(chat.examples(d)).collect()
    assert [tuple(r)[1:] for r in got] == [brute(rows)[1][2]]
    assert chat.parts(chat.examples(d)).agg({"part": "max"}).first()[0] >= 1
    none = chat.examples(d.where("false"))
    assert chat.parts(none).count() == chat.expand(none).count() == chat.read_back(none).count() == 0


def test_query_reads_its_table_back(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(*r, 7, 7, 7) for r in map(tuple, spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())]
    said = "</s>[INST] ok [/INST]"
    want = brute([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op9_chat_formatting"](spark, sf).collect()}
    assert got == {k: v[2] for k, v in want.items()}
