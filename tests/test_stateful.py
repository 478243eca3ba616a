import datetime as dt

from pyspark.sql import functions as F

from evalscale.streaming import stateful

ROW = "k string, ord long, ts timestamp, is_correct boolean"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def put(spark, folder, *rows):
    spark.createDataFrame([(k, o, at(h), c) for k, o, h, c in rows], ROW).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(folder)


def test_the_newest_row_of_each_key_over_restarts(spark, tmp_path):
    stateful.with_state_store(spark)
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"

    def run(out):
        stateful.run_through(stateful.keep_newest(stream(spark, folder), ["k"], ["ts", "ord"]), f"{tmp_path}/{out}", state, "update")
        kept = {r.k: r.ord for r in stateful.kept_values(spark, state).select("key.k", "value.max.ord").collect()}
        return kept, sorted((r.k, r.ord) for r in spark.read.parquet(f"{tmp_path}/{out}").collect())

    put(spark, folder, ("a", 1, 1, True), ("a", 2, 3, True), ("b", 3, 2, True))
    put(spark, folder, ("a", 9, 2, False), ("c", 4, 1, True))
    kept, changes = run("one")
    assert kept == {"a": 2, "b": 3, "c": 4}
    put(spark, folder, ("b", 5, 9, False))
    kept, changes = run("two")
    assert kept == {"a": 2, "b": 5, "c": 4} and changes == [("b", 5)]  # what came before was not handled again


def test_a_key_is_forgotten_after_its_time(spark, tmp_path):
    stateful.with_state_store(spark)
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    put(spark, folder, ("a", 1, 1, True), ("b", 2, 2, True))
    put(spark, folder, ("b", 3, 20, True), ("b", 4, 20, False))
    put(spark, folder, ("c", 5, 30, True))
    put(spark, folder, ("d", 6, 31, True))
    found = stateful.keep_newest_for(stream(spark, folder), ["k"], "ord", 15 * 3_600_000, "1 hour")
    stateful.run_through(found, f"{tmp_path}/out", state, "update")
    kept = {r.k: (r.ord, r.is_correct) for r in stateful.kept_values(spark, state, "newest").select("key.k", "value.*").collect()}
    assert kept == {"b": (4, False), "c": (5, True), "d": (6, True)}
    assert sorted(r.ord for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 4, 5, 6]


def test_running_accuracy_waits_for_early_rows_and_drops_late_ones(spark, tmp_path):
    stateful.with_state_store(spark)
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    put(spark, folder, ("a", 3, 3, True), ("a", 1, 1, False), ("b", 1, 2, True))
    put(spark, folder, ("a", 2, 2, True), ("a", 4, 6, None))
    put(spark, folder, ("a", 9, 0, True), ("a", 5, 6, True))  # the first one is later than two hours behind 6
    put(spark, folder, ("z", 0, 50, True))
    put(spark, folder, ("z", 0, 60, True))
    found = stateful.running_in_order(stream(spark, folder), ["k"], "2 hours")
    stateful.run_through(found, f"{tmp_path}/out", state, "append")
    got = [(r.k, r.ord, r.correct, r.scored) for r in spark.read.parquet(f"{tmp_path}/out").where(F.col("k") != "z").orderBy("k", "scored").collect()]
    assert got == [("a", 1, 0, 1), ("a", 2, 1, 2), ("a", 3, 2, 3), ("a", 4, 2, 4), ("a", 5, 3, 5), ("b", 1, 1, 1)]


def test_a_key_in_several_slots_has_its_newest_row_and_no_python_runs(spark, tmp_path):
    stateful.with_state_store(spark)
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    put(spark, folder, ("a", 1, 40, True), ("b", 2, 1, True))
    put(spark, folder, ("a", 3, 10, False), ("b", 4, 39, None))  # the row of a is older, in another slot
    found = stateful.keep_newest_for(stream(spark, folder), ["k"], "ord", 48 * 3_600_000, "1 hour")
    assert "InPandas" not in found._jdf.queryExecution().logical().toString()
    stateful.run_through(found, f"{tmp_path}/out", state, "update")
    kept = {r.k: (r.ord, r.is_correct) for r in stateful.kept_values(spark, state, "newest").select("key.k", "value.*").collect()}
    assert kept == {"a": (1, True), "b": (4, None)}
    assert sorted(r.ord for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 4]


def test_running_counts_go_on_over_restarts_and_ties(spark, tmp_path):
    stateful.with_state_store(spark)
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"

    def run():
        found = stateful.running_in_order(stream(spark, folder), ["k"], "1 hour")
        assert "InPandas" not in found.rows._jdf.queryExecution().logical().toString()
        stateful.run_through(found, f"{tmp_path}/out", state, "append")
        return sorted(((r.k or "", r.ord, r.correct, r.scored) for r in spark.read.parquet(f"{tmp_path}/out").where("k is null or k <> 'z'").collect()), key=lambda r: (r[0], r[3]))

    put(spark, folder, ("a", 2, 1, True), ("a", 1, 1, False), ("a", 2, 1, False), (None, 7, 2, True))
    put(spark, folder, ("z", 0, 10, True))
    first = [("", 7, 1, 1), ("a", 1, 0, 1), ("a", 2, 0, 2), ("a", 2, 1, 3)]
    assert run() == first
    put(spark, folder, ("a", 3, 12, True), (None, 8, 12, False))
    put(spark, folder, ("z", 0, 20, True))
    assert run() == [first[0], ("", 8, 1, 2), *first[1:], ("a", 3, 2, 4)]
