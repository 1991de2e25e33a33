import hashlib

from pyspark.sql import functions as F

from lattice.llm import chat


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_layouts_become_the_same_turns(spark):
    rows = [
        (1, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}),
        (2, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}),
        (3, {"prompt": "hi", "completion": "yo"}),
        (4, {"instruction": "hi", "output": "yo"}),
        (5, {"question": "hi", "answer": "yo"}),
        (6, {"prompt": "hi", "response": "yo"}),
        (7, {"instruction": "hi", "input": "there", "output": "yo", "system": "be"}),
        (8, {"prompt": "alone"}),
        (9, {}),
        (10, {"messages": []}),
        (11, {"messages": [{"role": None, "content": "x"}, {"role": "assistant", "content": None}]}),
        (12, {"prompt": "", "completion": ""}),
    ]
    schema = "id int, source string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, prompt string, completion string, response string, instruction string, input string, output string, system string, question string, answer string"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple({"id": i, "source": "s", **r}.get(n) for n in names) for i, r in rows], schema)
    got = {r.id: r for r in chat.format_chats(df).collect()}
    said = chat.START + "user\nhi" + chat.END + "\n" + chat.START + "assistant\nyo" + chat.END + "\n"
    assert [got[i].layout for i in range(1, 13)] == ["messages", "conversations", "completion", "instruction", "question", "response", "instruction", None, None, None, "messages", "completion"]
    assert all(got[i].formatted == said for i in range(1, 7))
    assert [(t.role, t.text) for t in got[7].turns] == [("system", "be"), ("user", "hi\n\nthere"), ("assistant", "yo")]
    assert got[8].formatted is None and got[9].turns is None and got[10].loss_mask is None
    assert [(t.role, t.text) for t in got[11].turns] == [("", "x"), ("assistant", "")]
    assert got[1].schema_fingerprint != got[2].schema_fingerprint and got[3].schema_fingerprint == got[12].schema_fingerprint
    masked = "".join(got[1].formatted[sum(x.n for x in got[1].loss_mask[:k]) :][: m.n] for k, m in enumerate(got[1].loss_mask) if m.loss)
    assert masked == "yo" and sum(m.n for m in got[1].loss_mask) == len(said)
    assert chat.format_chats(df.select("id", "source")).where("layout IS NOT NULL").count() == 0


def test_round_trip_of_hostile_texts(spark, prose):
    texts = [chat.TRAP, "%3C|%0A%25<|", "<<|<|im_start|>", "", None, "a\n\nb\n", "%", "|im_end|>", "<", "😀\x00é ", prose(3000, 1), chat.END + "\n" + chat.START]
    roles = ["user", "assistant", "sys\ntem", "<|im_end|>", None, "assistant "]
    rows = [(c, t, roles[(c + t) % 6], texts[(c * 5 + t) % 12]) for c in range(24) for t in range(c % 9 + 1)]
    rows += [(50, 3, "user", "b"), (50, 3, "user", "a"), (50, 3, "user", "a"), (50, 1, "assistant", "z"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("layout", F.lit("x")).withColumn("messages", F.lit("x"))
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(chat.conversation_records(df))).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{x}\n" for _, a, x in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_query_against_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 1, "assistant", "<|x%"), (1, 0, "user", None), (2, 0, "us\ner", "é😀")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duckdb.sql(chat.SQL)
    got = chat.op8_chat_formatting(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert [r.layout for r in got if r.conv_id == -1] == ["completion"]


def test_records_that_fit_several_layouts(spark):
    turns = "array<struct<role:string,content:string>>"
    rows = [
        (1, [("user", "q"), ("assistant", "a")], "be kind", None, None, None),
        (2, [("user", "q"), ("assistant", "a")], None, "a prompt", None, None),
        (3, [("user", "q")], "sys", "p", "c", "r"),
        (4, None, "sys", "p", "c", "r"),
        (5, None, None, "p", None, "r"),
        (6, [(None, "said by none")], None, None, None, None),
        (7, [], None, "p", "c", None),
        (8, None, "alone", None, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, messages {turns}, system string, prompt string, completion string, response string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    said = {i: [(t.role, t.text) for t in r.turns] if r.turns is not None else None for i, r in got.items()}
    assert said == {
        1: [("system", "be kind"), ("user", "q"), ("assistant", "a")], 2: [("user", "q"), ("assistant", "a")], 3: [("system", "sys"), ("user", "q")],
        4: [("system", "sys"), ("user", "p"), ("assistant", "c")], 5: [("user", "p"), ("assistant", "r")], 6: [("", "said by none")], 7: [("user", "p"), ("assistant", "c")], 8: None,
    }
    assert [got[i].layout for i in range(1, 9)] == ["messages"] * 3 + ["completion", "response", "messages", "completion", None]
    for i, r in got.items():
        assert r.turns is None or [(t.role, t.text) for t in r.read_turns] == said[i]
