import hashlib

import duckdb
from pyspark.sql import functions as F

from lattica.llm import chat, queries

COLUMNS = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def want(rows):
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((k is not None, k or 0, r or "", t or ""))
    out = {}
    for c, ts in by.items():
        ts = [(r, t) for *_, r, t in sorted(ts)]
        loss = "".join(t for r, t in ts if r == "assistant")
        out[c] = (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss))
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.examples(df)).collect()}


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\s \\l </s> <s>\\</s>"), (1, 2, "user", "x</s"), (2, 0, "assistant", None), (3, 0, None, "é😀 <"), (3, 0, None, "é😀 <"), (4, None, "assistant", ""),
            (4, 1, "[/INST]</s>", "[INST]"), (None, 1, "assistant", "n" * 200_000), (5, 0, "system", ""), (6, 1, "assistant", "b"), (6, 1, "assistant", "a"), (7, 0, "assistant", "\\"), (7, 1, "assistant", "[[INST]<</s>>")]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("example", F.lit(1))
    assert digests(df) == want(rows)
    one = {r.example: r for r in chat.examples(df).filter("conv_id = 1").collect()}
    assert [one[k].n_turns for k in sorted(one)] == [2, 3] and one[1].loss_start is None
    assert one[0].text[one[0].loss_start - 1 :][: one[0].loss_length] == "a\\ss \\sl \\l/s> \\ls>\\s\\l/s>"
    assert chat.examples(df.filter("false")).count() == 0


def test_query_and_its_sql(spark, data):
    own = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own += [(-7, 0, "user", queries.PLANTED_TEXT), (-7, 1, "assistant", queries.PLANTED_TEXT)]
    found = queries.op6_chat_formatting(spark, data).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == want(own)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{data}/conversations.parquet'")
    assert sorted(db.execute(queries.OP6_SQL).fetchall()) == sorted(tuple(r) for r in found)


def test_the_plan_is_native(spark, data):
    plan = queries.op6_chat_formatting(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
