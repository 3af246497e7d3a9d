import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm.chat import chat_digest, format_chats, read_chats

SCHEMA = "conv_id long, turn long, role string, text string"


def want(rows):
    convs = {}
    for c, n, role, text in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1)).withColumn("conv", F.lit("clash"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_digest(format_chats(df)).collect()}
    assert got == want(rows)


ROWS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "user", "b"), (2, 0, "user", "a"), (2, 2, "assistant", ""), (2, 3, "assistant", None), (2, 4, None, "x\\y\\\\<\\/s>"), (3, 0, "tool</s>", "[PART][PART]"),
    (None, 0, "user", "no id"), (4, None, "assistant", "no turn"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"), (5, 0, "", ""), (6, 0, "user", "<"), (6, 1, "user", "/s>"), (6, 2, "assistant", "[/INST"), (6, 3, "assistant", "]\n\r\n  end"),
]


def test_round_trip(spark):
    check(spark, ROWS)
    assert chat_digest(format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_adjacent_turns_of_a_role_share_a_block(spark):
    got = format_chats(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], SCHEMA)).first().formatted
    assert got == "<s>user[INST]a[PART]b</s><s>assistant[/INST]c</s>"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="<>/s[]INSTPARx\\ \n|é", max_size=20)), min_size=1, max_size=40))
def test_any_texts(spark, rows):
    check(spark, rows)


def test_read_gives_turns(spark):
    df = format_chats(spark.createDataFrame(ROWS[:2], SCHEMA)).select(F.explode(read_chats(F.col("formatted"))).alias("t"))
    assert [(r.t.role, r.t.text, r.t.loss) for r in df.collect()] == [("user", ROWS[0][3], False), ("assistant", ROWS[1][3], True)]
