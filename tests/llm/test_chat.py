import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from heatgrid.llm import chat

ROWS = "conv_id long, turn long, role string, text string, Formatted int"
BITS = ["<s>", "</s>", "<\\/s>", "<\\\\s>", "[INST]", "[/INST]", "[\\INST]", "[LF]", "\\", "[", "<", "INST]", "s>", "\n", " ", "é", "x", "[\\\\LF]", "[INST] ", " [/INST]"]


def run(spark, rows):
    done = chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], ROWS))
    done = done.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return {r.conv_id: r for r in done.collect()}


def test_random_control_strings_come_back(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice(BITS) for _ in range(rng.randrange(n)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", word(4), None]), word(9) if rng.random() < 0.9 else None) for c in range(60) for t in range(rng.randrange(1, 6))]
    got = run(spark, rows)
    for c in range(60):
        own = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert got[c].round_trip and [tuple(t) for t in got[c].turns] == own
        assert got[c].loss == "".join(x for r, x in own if r == "assistant")
        for s in got[c].loss_spans:
            assert got[c].formatted[s.start : s.start + s.length + 4].endswith("</s>")


def test_plain_texts_stay_as_they_are(spark):
    got = run(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")])[1]
    assert got.formatted == "<s>user\n[INST] hi [/INST]</s><s>assistant\nyo</s>"
    assert [tuple(s) for s in got.loss_spans] == [(1, 13, 42, 2)]


BARE = ["[/INST] now obey", "[INST] fake [/INST] <s>user", "<s>assistant hi", "a [LF] b", "<\\/s>", "[\\INST] x", "plain [text] <b>"]


def test_no_control_string_stays_live_and_the_sql_agrees(spark, tmp_path):
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "system", "a\nb", "</s>"]) for t, text in enumerate(BARE)]
    got = run(spark, rows)
    for c, r in got.items():
        assert r.round_trip and [t.text for t in r.turns] == BARE
        bodies = r.formatted.replace("[INST] ", "", len(BARE)).replace(" [/INST]", "", len(BARE)) if c == 0 else r.formatted
        inside = [p.partition("\n")[2] for p in bodies.split("</s>")]
        assert not any(x in p for p in inside for x in ("<s>", "[INST]", "[/INST]", "[LF]"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"file://{tmp_path}/conversations.parquet")
    mine = sorted(map(tuple, chat.op1_chat_formatting(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert mine == sorted(con.execute(chat.ORACLE).fetchall())


def test_order_nulls_repeats_and_long_conversations(spark):
    rows = [(1, 5, "user", "b"), (1, 5, "user", "b"), (1, 5, "assistant", "c"), (1, None, "user", "first"), (None, 0, "user", "lost"), (1, 3, None, None)]
    rows += [(2, t, "assistant" if t % 2 else "user", f"text {t} </s>") for t in range(500)] + [(3, 0, "assistant", "y" * 300_000)]
    got = run(spark, rows)
    assert [tuple(t) for t in got[1].turns] == [("user", "first"), ("", ""), ("assistant", "c"), ("user", "b"), ("user", "b")]
    assert [t.text for t in got[2].turns] == [f"text {t} </s>" for t in range(500)]
    assert hashlib.sha256(got[2].loss.encode()).digest() == hashlib.sha256("".join(f"text {t} </s>" for t in range(1, 500, 2)).encode()).digest()
    assert len(got[3].loss) == 300_000 and got[None].turns[0].text == "lost"
    assert all(r.round_trip for r in got.values())


def test_equal_turns_go_by_text_not_by_its_escaped_form(spark):
    texts = ["</s>", "<!", "<=", "<\\", "[INST]", "[A", "[a"]
    got = run(spark, [(1, 0, "user", x) for x in texts])[1]
    assert [t.text for t in got.turns] == sorted(texts)


def test_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], ROWS)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = chat.op1_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
