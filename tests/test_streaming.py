from __future__ import annotations

from panelmill.streaming import transitions as st


def test_stateful_transitions_and_windows(spark, sf, tmp_path):
    spark.createDataFrame([(1, 1, "U"), (1, 2, "R"), (2, 5, "P"), (1, 4, "P"), (2, 6, "P")], "id long, t long, s string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t long, s string").parquet(str(tmp_path / "in"))
    q = st.transitions(stream, "id", "t", "s").writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("moves").collect())) == [(1, 1, "U", "R"), (2, 5, "P", "P")]

    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "ev"))
    q = st.windowed_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev")), "ts", "event_type").writeStream.format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c2")).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.table("daily").collect()) == batch.count()


def test_state_across_batches_and_rows_without_a_time(spark, tmp_path):
    schema = "id long, t long, s string"
    batches = [[(1, 1, "U"), (1, 2, "R"), (2, 9, "P"), (None, 1, "U"), (1, None, "X")], [(1, 3, "P"), (1, 3, "U"), (2, 11, "P"), (1, 2, "late")], [(1, 4, None), (1, 5, "R")]]
    q = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if q is None:
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            q = st.transitions(stream, "id", "t", "s").writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    got = sorted(((r.person, r.t, r.state, r.next) for r in spark.table("steps").collect()), key=str)
    assert got == sorted([(1, 1, "U", "R"), (1, 2, "late", "U"), (1, 3, "U", None), (1, 4, None, "R")], key=str)


def test_idle_people_are_forgotten(spark, tmp_path):
    """With a wait of nothing to speak of, the second batch meets no state; with a long one it would (see above)."""
    import time

    schema = "id long, t long, s string"
    spark.createDataFrame([(1, 1, "U"), (1, 2, "R")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = st.transitions(stream, "id", "t", "s", idle="1 second").writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()

    def wait(done):
        for _ in range(120):
            if done():
                return True
            time.sleep(0.5)
        return False

    # a wait that ends runs batches without input, so there is never "nothing left to do"
    assert wait(lambda: spark.table("idle").count() == 1)
    held = lambda: q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] else 1
    assert wait(lambda: held() == 0)
    spark.createDataFrame([(1, 3, "P"), (1, 4, "P")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert wait(lambda: spark.table("idle").count() >= 2)
    q.stop()
    assert sorted(map(tuple, spark.table("idle").collect())) == [(1, 1, "U", "R"), (1, 3, "P", "P")]
