"""Statistics of sessions over a stream, with resets and a restart, against the same over a table."""

import random

from codelode.streaming import session_statistics as stats


def test_stretches_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rng = random.Random(6)
    folder, checkpoint, out = tmp_path / "in", str(tmp_path / "checkpoint"), str(tmp_path / "out")
    folder.mkdir()
    rows, seq = [], 0

    def batch(n, resets=()):
        nonlocal seq
        made = []
        for _ in range(n):
            seq += 1
            session = rng.choice(["a", "a", "a", "b", None])
            made.append((session, seq, "result", rng.choice([True, False, None]), rng.choice([0, 2, None]), rng.randrange(3), rng.randrange(900)))
        for session in resets:
            seq += 1
            made.append((session, seq, "reset", None, None, None, None))
        rng.shuffle(made)
        spark.createDataFrame(made, stats.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        rows.extend(made)

    def run():
        """All that is new, in a query that begins from the checkpoint."""
        stream = spark.readStream.schema(stats.EVENTS).parquet(str(folder))
        q = stats.running(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).start()
        q.processAllAvailable()
        q.stop()

    def check():
        # of each session and stretch the row with the most files is the last one that the stream gave
        last = {}
        for r in spark.read.parquet(out).collect():
            key = (r["session"], r["stretch"])
            last[key] = max(last.get(key, tuple(r)), tuple(r), key=lambda x: x[2])
        want = {(r["session"], r["stretch"]): tuple(r[c] for c in [f.split()[0] for f in stats.STATISTICS.split(", ")]) for r in stats.statistics(spark.createDataFrame(rows, stats.EVENTS)).collect()}
        assert last == want
        return want

    batch(40)
    run()
    check()
    batch(30, ["a"])
    run()
    batch(0, ["b", "b"])
    run()
    batch(25, [None])
    batch(10)
    run()
    got = check()
    assert {k[1] for k in got if k[0] == "a"} == {0, 1} and {k[1] for k in got if k[0] == "b"} == {0, 1, 2} and got["b", 1][2] == 0
