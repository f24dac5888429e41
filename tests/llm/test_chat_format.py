import hashlib

import duckdb
from pyspark.sql import functions as F

from skein.llm.chat_format import PROBE, SQL, digests, format_chats, read_turns, with_probe


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip_and_merging(spark):
    rows = [(1, 2, "assistant", "b <more/> & &lt; </turn>\n"), (1, 1, "user", "a\nb"), (1, 3, "assistant", "c"), (1, 4, "us>er", ""), (1, 4, "us>er", None), (2, None, None, "x"), (None, 1, "user", "n")]
    out = format_chats(table(spark, rows))
    one = out.filter("conv_id = 1").first().formatted
    assert one.count("<turn assistant>") == 1 and one.count("<more/>") == 2
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", read_turns(F.col("formatted")).alias("turns")).collect()}
    assert turns[1] == [("user", "a\nb"), ("assistant", "b <more/> & &lt; </turn>\n"), ("assistant", "c"), ("us>er", ""), ("us>er", "")]
    assert turns[2] == [("", "x")] and turns[None] == [("user", "n")]


def test_digests_equal_sql(spark, sf):
    got = digests(format_chats(with_probe(spark.read.parquet(f"{sf}/conversations.parquet")))).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(SQL).df().sort_values("conv_id").reset_index(drop=True)[list(got.columns)]
    assert got.astype(str).equals(want.astype(str))
    probe = got[got.conv_id == -7].iloc[0]
    assert probe.n_turns == 2 and probe.loss_sha256 == hashlib.sha256(PROBE.encode()).hexdigest() and probe.loss_chars == len(PROBE)


def test_plan_is_native_and_empty_table(spark):
    out = digests(format_chats(table(spark, [])))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
