import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from numera.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = [*chat.CONTROLS, "<", "\\", "[", "</s", "<\\s>", "[\\\\INST]", " ", "\n", "é", "é", "﻿", "😀", "\x00", "ok", "<<s>", "<|<|end|>"]


def expected(rows, learnt=("assistant",)):
    """Digests by conversation, one row after the other."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        role, text = role or "", text or ""
        n, a, b, c = out.get(conv, (0, "", "", 0))
        written = sum(len(x) + len(re.findall(chat.CONTROL_PATTERN, x)) for x in (role, text))
        out[conv] = (n + 1, a + f"{role}\n{text}\n", b + (text if role in learnt else ""), c + written + sum(map(len, chat.MARKS)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {k: (n, sha(a), len(b), sha(b), c) for k, (n, a, b, c) in out.items()}


def digested(df):
    return {r[0]: tuple(r[1:]) for r in chat.digests(chat.read_back(chat.format_turns(df))).collect()}


def hostile(seed, n=300):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, -7, 0, 1, 2]), t, rnd.choice(["user", "assistant", "system", None, "</s>", "a\nb"]), "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 5, 40])))) for t in range(n)]
    return rows + [(3, None, "assistant", None), (3, 5, "assistant", ""), (3, -900, "assistant", "x" * 200_000 + " " * 100_000)]


def test_escapes_are_undone_and_leave_no_control_string(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for t, e, back in df.select("t", "e", chat.unescaped(F.col("e"))).collect():
        assert back == t
        assert not any(c in e for c in chat.CONTROLS)


def test_hostile_conversations(spark):
    rows = hostile(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as start", "'x' as ids", "2 as loss", "3 as n_tokens")
    assert digested(df) == expected(rows)


def test_formatted_rows(spark):
    rows = hostile(3, 700)
    formatted = chat.format_turns(spark.createDataFrame(rows, SCHEMA)).cache()
    template, got = chat.Template(chat.default_path()), {}
    for r in formatted.orderBy("conv_id", "start").collect():
        ids, loss = got.setdefault(r["conv_id"], ([], []))
        # starts are the tokens before, blocks of turns and the null conversation included
        assert r["start"] == len(ids) and r["n_tokens"] == len(r["ids"]) == len(r["loss"])
        ids += r["ids"]
        loss += r["loss"]
    written = {r[0]: r[1] for r in chat.written_out(formatted).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "formatted"))), lambda x: x["formatted"]), "")).collect()}
    for conv, (ids, loss) in got.items():
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        assert [i for i in ids if i >= template.turn] == [template.turn, template.text, template.end] * len(own)
        assert sum(loss) == sum(len(template.encode([chat_escape(r[3] or "")])[0]) for r in own if r[2] == "assistant")
        want = "".join(f"<|turn|>{chat_escape(r[2] or '')}<|text|>{chat_escape(r[3] or '')}<|end|>" for r in own)
        assert written[conv] == want
    # whole conversations in one row read back like their turns
    whole = spark.createDataFrame([(c, 0, i, x) for c, (i, x) in got.items()], "conv_id long, start long, ids array<int>, loss array<tinyint>")
    assert {r[0]: tuple(r[1:]) for r in chat.digests(chat.read_back(whole)).collect()} == expected(rows)


def chat_escape(text):
    return re.sub(chat.CONTROL_PATTERN, lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def test_rows_of_one_turn_and_repeated_rows_are_kept(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (None, None, None, None)]
    turns = chat.read_back(chat.format_turns(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert [tuple(r) for r in turns.where("conv_id = 1").orderBy("start").select("role", "text").collect()] == [("user", "a"), ("user", "a"), ("user", "b")]
    assert {r[0]: r[1] for r in chat.digests(turns).collect()} == {1: 3, None: 2}


def test_learnt_roles_and_broken_ids(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "tool", "r"), (1, 2, "assistant", "a")]
    formatted = chat.format_turns(spark.createDataFrame(rows, SCHEMA), learnt=("user", "tool"))
    assert [r[0] for r in chat.read_back(formatted).orderBy("start").select("loss_text").collect()] == ["q", "r", ""]
    with pytest.raises(ValueError):
        chat.format_turns(formatted, learnt=("</s>",))
    with pytest.raises(Exception, match="out of order"):
        chat.read_back(formatted.withColumn("ids", F.reverse("ids"))).collect()


def test_empty_table(spark):
    assert digested(spark.createDataFrame([], SCHEMA)) == {}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in registry.op11_chat(spark, sf).collect()}
    assert got == expected(rows + chat.PROBE)
    assert got[-7][0] == 2 and got[-7][2] == len("</s>[INST] ok [/INST]")
