from pyspark.sql import functions as F

from lodestone.operators import chat
from lodestone.streaming import conversations as turns
from lodestone.streaming import requirements as arriving

MESSAGE = "conv_id long, turn long, role string, text string"


def test_two_batches_give_the_histories_of_one(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", " " if (c, t) == (2, 3) else f" turn {t} of {c}") for c in (1, 2, 3) for t in range(10 if c < 3 else 1)]
    rows.append((4, None, "user", "no turn"))
    early = lambda r: (r[1] or 0) < (5 if r[0] == 1 else 3)
    for k, part in enumerate(([r for r in rows if early(r)], [r for r in rows if not early(r)])):
        spark.createDataFrame(part, MESSAGE).repartition(2).write.parquet(str(tmp_path / f"in{k}"))
    import shutil

    (tmp_path / "feed").mkdir()
    for k in range(2):  # two runs over one checkpoint: the state outlives the first
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "feed" / f"{k}-{f.name}")
        stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "feed"))
        turns.questions(stream, last=3, idle_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination(100)
    got = {(r.conv_id, r.turn): (r.question, r.history) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for c, t, role, text in rows:
        if role == "user" and t is not None:
            past = [r for r in rows if r[0] == c and r[1] < t][-3:]
            want[c, t] = (text, "\n".join(f"{'Ассистент' if r[2] == 'assistant' else 'Пользователь'}: {r[3].strip()}" for r in past if r[3].strip()))
    assert got == want


def test_answers_become_turns(spark):
    messages = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], MESSAGE)
    asked = spark.createDataFrame([(7, 1, "c"), (8, 2, "d"), (9, 1, "e"), (10, 2, "f")], "query_id long, conv_id long, text string")
    said = spark.createDataFrame([(7, "C"), (8, "D"), (9, None)], "query_id long, answer string")
    got = sorted(map(tuple, chat.appended(messages, asked, said).collect()))
    assert got == [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "C"), (2, 0, "user", "d"), (2, 1, "assistant", "D")]


def test_an_idle_conversation_is_forgotten(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(1, k, "user", f"m{k}")], MESSAGE).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    import shutil
    import time

    (tmp_path / "feed").mkdir()
    shutil.copytree(tmp_path / "in0", tmp_path / "feed" / "0")
    stream = spark.readStream.schema(MESSAGE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "feed"))
    q = turns.questions(stream, idle_ms=500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        gone = lambda: (p := q.lastProgress) and p["stateOperators"] and p["stateOperators"][0]["numRowsTotal"] == 0 and p["batchId"] > 0
        while not gone() and time.time() < end:
            time.sleep(0.5)
        assert gone()
    finally:
        q.stop()


def test_late_events_are_left_out(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    seen = {}

    def keep(batch, number):
        seen.update({(str(r.start), r.event_type): (r.n, r.value) for r in batch.collect()})

    for k, rows in enumerate(([("2024-01-01 12:30:00", "a", 1.0)], [("2024-01-01 15:00:00", "a", 2.0)], [("2024-01-01 12:40:00", "a", 4.0), ("2024-01-01 15:10:00", "a", 8.0)])):
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        rates = arriving.event_rates(spark.readStream.schema(schema).parquet(str(tmp_path / "feed")))
        rates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination(60)
    assert seen == {("2024-01-01 12:00:00", "a"): (1, 1.0), ("2024-01-01 15:00:00", "a"): (2, 10.0)}


def test_a_stream_reads_a_kept_index(spark, tmp_path):
    from lodestone.operators import ranking

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, text string")
    spark.createDataFrame([(7, "alpha"), (8, "beta")], "query_id long, text string").coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema("query_id long, text string").parquet(str(tmp_path / "feed"))
    arriving.match(stream, None, str(tmp_path / "out"), str(tmp_path / "progress"), index=ranking.postings_of(docs)).awaitTermination(60)
    got = sorted((r.query_id, r.doc_id, r["rank"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.query_id, r.doc_id, r["rank"]) for r in ranking.bm25(docs, spark.read.parquet(str(tmp_path / "feed"))).collect())
