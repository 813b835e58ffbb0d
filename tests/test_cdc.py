"""Change application: properties against a plain dictionary, tables, restarts of the streaming apply."""

import pytest
from oracle import SMALL
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartlake.functions.expressions import cdc_timestamp
from cartlake.operators import cdc
from cartlake.sources import tables
from cartlake.sources.commerce import Commerce
from cartlake.sources.tables import conform, copy_verified, high_water, read_frozen, require_columns, set_high_water
from cartlake.plans.cdc_queries import order_envelopes
from cartlake.streaming import buckets
from cartlake.streaming.buckets import BucketedState
from cartlake.streaming.changes import read_cdc_stream, stream_apply, stream_rows, write_cdc_stream

CHANGE = "id long, v string, _op string, _ts_ms long"
changes = st.lists(st.tuples(st.integers(1, 4), st.sampled_from("abc"), st.sampled_from("rud"), st.integers(0, 9)), min_size=1, max_size=12)


def state_of(rows):
    """The newest change of each key; deletes leave nothing."""
    newest = {}
    for key, value, op, ts in rows:
        if key not in newest or (ts, op, value) > newest[key]:
            newest[key] = (ts, op, value)
    return {k: v for k, (_, op, v) in newest.items() if op != "d"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(first=changes, second=changes)
def test_apply_equals_replay(spark, first, second):
    # Distinct times for a key, so that the order of changes is defined.
    log = {(k, ts): (k, v, op, ts) for k, v, op, ts in [(k, v, o, t * 2) for k, v, o, t in first] + [(k, v, o, t * 2 + 1) for k, v, o, t in second]}
    old, new = ([r for (_, ts), r in log.items() if ts % 2 == side] for side in (0, 1))
    state = cdc.bootstrap_current_state(spark.createDataFrame(old, CHANGE), ["id"])
    applied = cdc.apply_changes(state, spark.createDataFrame(new, CHANGE), ["id"])
    again = cdc.apply_changes(applied, spark.createDataFrame(new, CHANGE), ["id"])
    wanted = state_of(log.values())
    for found in (applied, again):
        assert {r.id: r.v for r in cdc.live(found).collect()} == wanted


def test_timestamps(spark):
    cases = [("1785248638116", 1785248638116), ("1970-01-01T00:00:01.234Z", 1234), (" 1234 ", 1234), ("-1", -1), ("0", 0), (None, None), ("abc", None), ("", None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", F.unix_millis(cdc_timestamp("t")).alias("ms")).collect()
    assert {r.i: r.ms for r in rows} == {i: ms for i, (_, ms) in enumerate(cases)}


def order_rows(raw):
    return stream_rows(raw, "orders", cdc.ORDER_CHANGE).drop("_ingested_at", "_source_table")


def batch_answer(raw):
    return cdc.bootstrap_current_state(order_rows(raw), ["order_id"], tombstones=False)


def test_streaming_apply_equals_batch_and_survives_restart(spark, tmp_path):
    raw = order_envelopes(Commerce(spark, SMALL).orders)
    source, state = f"{tmp_path}/in", BucketedState(spark, f"{tmp_path}/state", ("order_id",), 8)
    for part in raw.randomSplit([1.0, 1.0], seed=3):
        part.repartition(2).write.mode("append").text(source)
        stream_apply(order_rows(read_cdc_stream(spark, path=source, files_per_trigger=1)), state, f"{tmp_path}/checkpoint", name="orders_apply").awaitTermination()
    batch = batch_answer(raw)
    assert sorted(map(tuple, cdc.live(state.read()).select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def files_below(folder):
    return {str(f): f.stat().st_size for f in folder.rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    """Files of buckets without a changed key stay as they are; what is written follows the changed buckets."""
    state = BucketedState(spark, f"{tmp_path}/s", ("id",), 16)
    rows = spark.range(4000).selectExpr("id", "cast(id as string) as v", "'c' as _op", "1L as _ts_ms")
    assert state.apply(rows, source="x", batch_id=0)
    before = files_below(tmp_path / "s" / "state")
    assert state.apply(rows.where("id = 7").withColumns({"v": F.lit("new"), "_ts_ms": F.lit(2).cast("long")}), source="x", batch_id=1)
    after = files_below(tmp_path / "s" / "state")
    new = sum(n for f, n in after.items() if f not in before)
    assert len(set(before) - set(after)) == 1 and 0 < new < sum(before.values()) / 8
    assert state.read().where("v = 'new'").count() == 1 and state.read().count() == 4000
    assert not state.apply(rows.where("id = 8").withColumn("v", F.lit("again")), source="x", batch_id=1)  # a batch counts once
    assert not (tmp_path / "s" / "pending" / "x-1").exists() and not state.applied("x", 0) and state.applied("x", 1)


def test_a_stop_between_pending_and_state_loses_nothing(spark, tmp_path, monkeypatch):
    """The old buckets are gone and the new ones are not there yet: the batch starts again from what it had written aside."""
    state = BucketedState(spark, f"{tmp_path}/s", ("id",), 4)
    rows = spark.range(100).selectExpr("id", "cast(id as string) as v", "'c' as _op", "1L as _ts_ms")
    state.apply(rows, source="x", batch_id=0)

    def broken(df, path, *by):
        import shutil

        shutil.rmtree(tmp_path / "s" / "state" / "_bucket=1")
        raise OSError("stopped")

    changes = rows.where("id < 50").withColumns({"v": F.lit("b"), "_ts_ms": F.lit(2).cast("long")})
    with monkeypatch.context() as patch:
        patch.setattr(buckets, "replace_partitions", broken)
        with pytest.raises(OSError):
            state.apply(changes, source="x", batch_id=1)
    assert state.apply(changes, source="x", batch_id=1)
    assert {r.id: r.v for r in state.read().collect()} == {i: "b" if i < 50 else str(i) for i in range(100)}


def test_change_files_roll_by_bytes_and_hold_each_row_once(spark, tmp_path):
    """No file over the limit, also where rows become wider; a batch that was stopped after writing is written once more in its place."""
    source, sink = f"{tmp_path}/in", tmp_path / "out"
    wide = F.expr("array_join(transform(sequence(1, 1 + cast(id % 40 as int)), i -> uuid()), '')")
    spark.range(0, 3000).select(F.concat("id", F.lit(" "), wide)).repartition(2).write.text(source)
    for at in range(2):
        stream = read_cdc_stream(spark, path=source, bytes_per_trigger=1 << 20)
        write_cdc_stream(stream, str(sink), f"{tmp_path}/checkpoint", name="roll", file_bytes=200_000).awaitTermination()
        if at == 0:
            spark.range(3000, 4000).select(F.concat("id", F.lit(" "), wide, wide, wide)).repartition(1).write.mode("append").text(source)
    sizes = files_below(sink)
    assert len(sizes) > 4 and max(sizes.values()) <= 200_000
    last = max(int(d.name[6:]) for d in sink.iterdir() if d.name.startswith("batch="))
    (tmp_path / "checkpoint" / "commits" / str(last)).unlink()  # as if it had stopped before the commit
    for crc in (tmp_path / "checkpoint" / "commits").glob(f".{last}.crc"):
        crc.unlink()
    write_cdc_stream(read_cdc_stream(spark, path=source, bytes_per_trigger=1 << 20), str(sink), f"{tmp_path}/checkpoint", name="roll", file_bytes=200_000).awaitTermination()
    ids = spark.read.parquet(str(sink)).selectExpr("cast(split(value, ' ')[0] as int) as id")
    assert ids.count() == 4000 and ids.distinct().count() == 4000


def test_partitions_marks_and_copies(spark, tmp_path):
    tables.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "x int, run_id string"), f"{tmp_path}/h", "run_id")
    whole = tables.record_run(spark.createDataFrame([(3, "b")], "x int, run_id string"), f"{tmp_path}/h")
    assert sorted(map(tuple, whole.collect())) == [(1, "a"), (3, "b")]
    assert copy_verified(spark, f"{tmp_path}/h", f"{tmp_path}/copy") == 2 and spark.read.parquet(f"{tmp_path}/copy").count() == 2
    marks = f"{tmp_path}/marks"
    assert high_water(spark, marks, "orders") == 0
    for value in (9, 5):
        set_high_water(spark, marks, "orders", value)
    set_high_water(spark, marks, "payments", 2)
    assert high_water(spark, marks, "orders") == 9 and high_water(spark, marks, "payments") == 2
    assert read_frozen(spark, f"{tmp_path}/copy").count() == 2
    assert tables.migrate_all(spark, {"h": (f"{tmp_path}/h", f"{tmp_path}/moved")}) == {"h": 2}
    with pytest.raises(RuntimeError, match="gone"):
        tables.migrate_all(spark, {"h": (f"{tmp_path}/h", f"{tmp_path}/moved"), "gone": (f"{tmp_path}/none", f"{tmp_path}/m2")})
    tables.export_single_file(whole, f"{tmp_path}/one", rows=2)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    for wrong in ({"rows": 3}, {"most": 1}):
        with pytest.raises(ValueError):
            tables.export_single_file(whole, f"{tmp_path}/one", **wrong)


def test_conform_and_requirements(spark):
    made = conform(spark.range(1), {"id": "string", "x": "double", "y": "int"}, {"y": 7})
    assert made.dtypes == [("id", "string"), ("x", "double"), ("y", "int")] and made.first().y == 7
    with pytest.raises(ValueError):
        require_columns(made, ["z"])
    made.createOrReplaceTempView("made")
    assert tables.require_table(spark, "made").count() == 1 and tables.require_non_empty(made) is made
    with pytest.raises(ValueError):
        tables.require_table(spark, "not_made")
    with pytest.raises(ValueError):
        tables.require_non_empty(made.limit(0))


def test_columns_that_changes_lack_keep_their_values(spark):
    state = cdc.bootstrap_current_state(spark.createDataFrame([(1, "a", 5, "c", 1), (2, "b", 6, "c", 1)], "id int, v string, n int, _op string, _ts_ms long"), ["id"])
    found = cdc.live(cdc.apply_changes(state, spark.createDataFrame([(1, "z", "u", 2), (3, "y", "c", 2)], "id int, v string, _op string, _ts_ms long"), ["id"]))
    assert {r.id: (r.v, r.n) for r in found.collect()} == {1: ("z", 5), 2: ("b", 6), 3: ("y", None)}
    with pytest.raises(ValueError):
        cdc.align_columns(state, spark.createDataFrame([(1,)], "v int"), ["id"])


def test_apply_all_isolates_failures_and_moves_marks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "c", 5), (2, "b", "c", 7), (1, "c", "u", 9)], "id long, v string, _op string, _ts_ms long").withColumn("_ingested_at", F.current_timestamp())
    broken = rows.withColumn("v", F.expr("cast(raise_error('broken') as string)"))

    def store(name, state):
        state.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    done, marks, failed = cdc.apply_all({}, {"good": rows, "bad": broken}, {"good": "id", "bad": "id"}, {"bad": 3}, store)
    assert sorted((r.id, r.v) for r in done["good"].collect()) == [(1, "c"), (2, "b")]
    assert marks == {"good": 9, "bad": 3} and set(failed) == {"bad"} and "broken" in failed["bad"]


def test_missing_optional_source_is_skipped_and_others_raise(spark, tmp_path):
    target = f"{tmp_path}/target"
    assert tables.copy_verified(spark, f"{tmp_path}/nowhere", target, required=False) is None
    with pytest.raises(Exception, match="nowhere"):
        tables.copy_verified(spark, f"{tmp_path}/nowhere", target)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        tables.copy_verified(spark, f"{tmp_path}/odd", target, required=False)
