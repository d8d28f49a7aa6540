import random

from pyspark.sql import functions as F

from tracewell.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows, schema=SCHEMA):
    done = chat.format_conversations(spark.createDataFrame(rows, schema))
    return {r.conv_id: r for r in done.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("answers")).collect()}


def test_round_trip_of_random_turns(spark):
    rnd = random.Random(8)
    parts = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<", "|", "\\", "\n", "é🙂", "%0A", "text ", "<\\|", "assistant\n"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "a<|%\n", ""]), "".join(rnd.choices(parts, k=rnd.randint(0, 8)))) for c in range(60) for t in range(rnd.randint(1, 9))]
    got = back(spark, rows)
    for c in range(60):
        turns = [(r, x) for k, _, r, x in rows if k == c]
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].answers == "".join(x for r, x in turns if r == "assistant")


def test_adjacent_turns_of_a_role_are_one_block(spark):
    got = back(spark, [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c")])[1]
    assert got.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [got.formatted[s.start : s.end] for s in got.loss] == ["c"]


def test_long_conversations_and_runs(spark):
    rows = [(1, t, "assistant" if t % 700 < 400 else "user", f"t{t}<|im_sep|>é") for t in range(3000)]
    got = back(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [(r, x) for _, _, r, x in rows]
    assert got.answers == "".join(x for _, _, r, x in rows if r == "assistant")


def test_odd_rows(spark):
    rows = [(1, None, None, None, 3), (1, 5, "assistant", "x", 4), (1, 5, "assistant", "x", 4), (1, 5, "assistant", "w", 4), (None, 1, "user", "n", 0), (2, 1, "assistant", "y" * 300_000, 0)]
    got = back(spark, rows, f"{SCHEMA}, loss long")
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("assistant", "w"), ("assistant", "x"), ("assistant", "x")]
    assert got[1].answers == "wxx" and got[None].answers == "" and got[2].answers == "y" * 300_000
    assert back(spark, []) == {}


def test_plan_is_native(spark):
    df = chat.format_conversations(spark.range(3).selectExpr("id % 2 as conv_id", "id as turn", "'user' as role", "'t' as text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Scan ExistingRDD"))
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
