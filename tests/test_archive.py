import uuid
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from terrace.operators.archive import (
    Deployment, archive_definition, archive_table, diff_backup_history, fetch_last_deployments,
    latest_per_asset, list_archive, read_headers, register_table_functions, restore_into,
    restore_table,
)
from terrace.operators.diff import diff_summary, snapshot_diff
from terrace.operators.lineage import Run, with_lineage
from terrace.sources.tables import read_previous, replace_table
from terrace.sources.versions import versions


def at(day, **kw):
    return Deployment("p", "dev", "ann", archived_at=datetime(2024, 1, day), **kw)


def odd_rows(spark):
    df = spark.createDataFrame(
        [
            (1, 2**40, Decimal("1.10"), date(2024, 1, 1), datetime(2024, 1, 1, 1, 2, 3, 456789), float("nan"), b"\x00\xff", [1, None], {"k": "v"}, "a \"q\" 'x'\n"),
            (2, None, None, None, None, None, None, None, None, None),
            (3, -1, Decimal("-99999999.99"), date(1999, 12, 31), datetime(1999, 1, 1), float("-inf"), b"", [], {}, ""),
        ],
        "id int, big bigint, money decimal(10,2), day date, ts timestamp, x double, raw binary, list array<int>, "
        "tags map<string,string>, note string",
    )
    df = df.withColumn("local", F.col("ts").cast("timestamp_ntz")).withColumn("wide", F.col("money").cast("decimal(38,18)"))
    return with_lineage(df, "m", ["s"], run=Run("abc", as_of=datetime(2024, 1, 1)), origin={"type": "seed"})


def test_round_trip_is_exact(spark, tmp_path):
    df = odd_rows(spark)
    archive_table(df, str(tmp_path), "odd", at(1))
    back = restore_table(spark, str(tmp_path), "odd")
    assert back.schema.simpleString() == df.schema.simpleString()
    texts = [d.select(F.to_json(F.struct("*"))).orderBy("id").collect() for d in (df, back)]
    assert texts[0] == texts[1]
    plain = [c for c in df.columns if c not in ("tags", "_lineage")]
    assert back.select(plain).exceptAll(df.select(plain)).count() == 0
    assert df.select(plain).exceptAll(back.select(plain)).count() == 0


def test_versions_of_an_archive(spark, tmp_path):
    path = str(tmp_path)
    archive_table(spark.range(3), path, "t", at(1))
    archive_table(spark.range(5), path, "t", at(2))
    archive_table(spark.range(0), path, "none", at(2))
    assert restore_table(spark, path, "t").count() == 5
    assert restore_table(spark, path, "t", datetime(2024, 1, 1)).count() == 3
    assert restore_table(spark, path, "none").count() == 0
    with pytest.raises(ValueError, match="no archive"):
        restore_table(spark, path, "t", datetime(2023, 1, 1))
    headers = read_headers(spark, path)
    assert sorted((r["asset_name"], r["row_count"]) for r in headers.collect()) == [("none", 0), ("t", 3), ("t", 5)]


def test_restore_into_another_schema_and_reads_one_partition(spark, tmp_path):
    path = str(tmp_path)
    archive_table(spark.range(3), path, "t", at(1))
    archive_table(spark.range(9), path, "u", at(1))
    from pyspark.sql import types as T

    target = T.StructType.fromDDL("id string, extra int")
    back = restore_table(spark, path, "t", schema=target)
    assert sorted(back.collect()) == [("0", None), ("1", None), ("2", None)]
    plan = plan_of(restore_table(spark, path, "t"))
    assert "InMemoryFileIndex(1 paths)" in plan and "Exchange" not in plan
    assert all("/asset_name=t/archive_id=" in f for f in restore_table(spark, path, "t").inputFiles())


def test_restore_refuses_what_it_cannot_read(spark, tmp_path):
    from pyspark.sql import types as T

    path, whole = str(tmp_path), T.StructType.fromDDL("n int")
    archive_table(spark.createDataFrame([("5",)], "n string"), path, "good", at(1))
    archive_table(spark.createDataFrame([("5",), ("abc",)], "n string"), path, "bad", at(1))
    assert restore_table(spark, path, "good", schema=whole).collect() == [(5,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        restore_table(spark, path, "bad", schema=whole).collect()


def test_listing(spark, tmp_path):
    path = str(tmp_path)
    archive_table(spark.range(3), path, "t", at(1, git_sha="s1"))
    archive_definition(spark, path, "f.sql", "function", "it's", at(2, git_branch="main"))
    listed = list_archive(read_headers(spark, path)).collect()
    assert [r["asset_name"] for r in listed] == ["f.sql", "t"]
    assert listed[0]["row_count"] is None and "snapshot_data" not in listed[0]
    assert list_archive(read_headers(spark, path), "t").count() == 1


HEADERS = "archive_id string, asset_name string, asset_type string, environment string, performed_by string, archived_at timestamp, git_sha string, git_branch string, row_count bigint"


def headers(spark, *rows):
    return spark.createDataFrame(
        [
            (i, name, "table", "dev", "ann", datetime(2024, 1, day, tzinfo=timezone.utc), sha, branch, count)
            for i, name, day, sha, branch, count in rows
        ],
        HEADERS,
    )


def test_archive_diff(spark):
    h = headers(
        spark,
        ("1", "gone", 1, "a", "main", 1), ("2", "same", 1, "a", "main", 5), ("3", "more", 1, "a", "main", 5),
        ("4", "null", 1, "a", "main", None), ("5", "more", 2, "a", "main", 6),
        ("6", "same", 3, "b", "dev", 5), ("7", "more", 3, "b", "dev", 7), ("8", "null", 3, "b", "dev", 2),
        ("9", "new", 3, None, "dev", 1), ("10", "other", 3, "c", "x", 1),
    )
    found = {r["asset_name"]: r for r in diff_backup_history(h, "a", "dev").collect()}
    assert {n: r["change_type"] for n, r in found.items()} == {"gone": "REMOVED", "more": "CHANGED", "new": "ADDED"}
    more = found["more"]
    assert (more["ref_a_row_count"], more["ref_b_row_count"]) == (6, 7)
    assert (more["ref_a_value"], more["ref_b_value"], found["new"]["ref_b_value"]) == ("a", "b", "dev")
    # a branch that covers both sides compares the newest archive with itself
    assert diff_backup_history(h, "main", "main").count() == 0


def test_table_functions_agree_with_the_functions(spark):
    h = headers(
        spark,
        ("1", "gone", 1, "a", "main", 1), ("2", "same", 1, "a", "main", 5), ("3", "null", 1, "a", "main", None),
        ("4", "more", 2, "a", "main", 6), ("5", "same", 3, "b", "dev", 5), ("6", "more", 3, "b", "dev", 7),
        ("7", "null", 3, "b", "dev", 2), ("8", "new", 3, None, "dev", 1), ("9", "other", 3, "c", "x", 1),
    )
    register_table_functions(h)
    for a, b in (("a", "dev"), ("dev", "a"), ("main", "main"), ("nothing", "a")):
        ours = diff_backup_history(h, a, b)
        sql = spark.sql(f"SELECT * FROM diff_backup_history('{a}', '{b}')")
        assert sql.columns == ours.columns and sorted(map(str, sql.collect())) == sorted(map(str, ours.collect()))
    for n in (0, 2, 50):
        ours, sql = fetch_last_deployments(h, n), spark.sql(f"SELECT * FROM fetch_last_deployments({n})")
        assert sql.columns == ours.columns and sorted(map(str, sql.collect())) == sorted(map(str, ours.collect()))


def test_ties_on_time_are_settled(spark):
    h = headers(spark, ("2", "t", 1, "a", "m", 20), ("1", "t", 1, "a", "m", 10))
    assert latest_per_asset(h).first()["row_count"] == 20
    assert latest_per_asset(h.orderBy("archive_id")).first()["row_count"] == 20
    assert "Window" not in plan_of(latest_per_asset(h))


def test_deployments(spark):
    h = headers(
        spark,
        ("1", "b", 1, "s1", "m", 1), ("2", "a", 1, "s1", "m", 2), ("3", "a", 2, "s1", "m", None),
        ("4", "c", 3, "s2", "m", 4), ("5", "d", 4, "s3", "m", 5),
    )
    rows = fetch_last_deployments(h, 2).orderBy("deployment_id").collect()
    assert [(r["deployment_id"], r["git_sha"]) for r in rows] == [(1, "s3"), (2, "s2")]
    oldest = fetch_last_deployments(h, 9).where("git_sha = 's1'").first()
    assert (oldest["asset_count"], oldest["total_rows"], oldest["assets"]) == (3, 3, "a, b")


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a", 1.0, None), (2, "b", 2.0, "x"), (3, "c", 3.0, "y"), (4, None, None, None)], "id int, s string, d double, n string")
    new = spark.createDataFrame([(2, "b", 2.0, "x"), (3, "C", 3.5, "y"), (4, None, None, "z"), (5, "e", 5.0, None)], "id int, s string, d double, n string")
    found = {r["id"]: (r["status"], r["changed_columns"]) for r in snapshot_diff(old, new, ["id"]).collect()}
    assert found == {
        1: ("removed", []), 2: ("unchanged", []), 3: ("modified", ["s", "d"]), 4: ("modified", ["n"]), 5: ("added", []),
    }
    assert snapshot_diff(old, new, ["id"], keep_unchanged=False).count() == 4
    assert dict(diff_summary(snapshot_diff(old, new, ["id"])).collect()) == {"added": 1, "removed": 1, "modified": 2, "unchanged": 1}


def test_snapshot_diff_of_repeated_keys_and_nested_values(spark):
    def rows(*values):
        return spark.createDataFrame([(1, *v) for v in values], "k int, a string, b int")

    assert snapshot_diff(rows(("x", 1), ("y", 2)), rows(("y", 2), ("x", 1)), ["k"]).first()["status"] == "unchanged"
    swapped = snapshot_diff(rows(("x", 1), ("y", 2)), rows(("x", 2), ("y", 1)), ["k"]).first()
    assert swapped["status"] == "modified"
    fewer = snapshot_diff(rows(("x", 1), ("x", 1)), rows(("x", 1)), ["k"]).first()
    assert fewer["status"] == "modified"
    nested = spark.createDataFrame([(1, {"a": "1", "b": "2"}, [1])], "k int, m map<string,string>, l array<int>")
    same = spark.createDataFrame([(1, {"b": "2", "a": "1"}, [1])], "k int, m map<string,string>, l array<int>")
    assert snapshot_diff(nested, same, ["k"]).first()["status"] == "unchanged"
    other = same.withColumn("l", F.array(F.lit(2)))
    assert snapshot_diff(nested, other, ["k"]).first()["changed_columns"] == ["l"]
    wider = same.withColumn("extra", F.lit(1))
    assert snapshot_diff(nested, wider, ["k"]).first()["changed_columns"] == ["extra"]


def test_snapshot_diff_has_one_shuffle_and_no_join(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = plan_of(snapshot_diff(orders, orders, ["o_orderkey"]))
    assert plan.count("Exchange") == 1 and "Join" not in plan and "partial_sum" in plan


def test_snapshot_diff_against_brute_force(spark):
    import random

    rng = random.Random(3)
    def draw():
        return {k: (rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for k in range(200) if rng.random() < 0.8}

    old, new = draw(), draw()
    frames = [spark.createDataFrame([(k, *v) for k, v in d.items()], "k int, s string, n int") for d in (old, new)]
    expected = {}
    for k in {*old, *new}:
        if k not in new:
            expected[k] = ("removed", [])
        elif k not in old:
            expected[k] = ("added", [])
        else:
            changed = [c for c, a, b in zip("sn", old[k], new[k]) if a != b]
            expected[k] = ("modified" if changed else "unchanged", changed)
    found = {r["k"]: (r["status"], r["changed_columns"]) for r in snapshot_diff(*frames, ["k"]).collect()}
    assert found == expected


def test_snapshot_diff_of_nulls_inside_of_values(spark):
    def rows(values):
        return spark.sql(f"select 1 as k, {values}")

    same = "map(1, map('a', 1, 'b', 2)) as m, array(1, null) as a, named_struct('x', 5, 'y', cast(null as int)) as s"
    order = "map(1, map('b', 2, 'a', 1)) as m, array(1, null) as a, named_struct('x', 5, 'y', cast(null as int)) as s"
    other = "map(1, map('a', 1, 'b', 2)) as m, array(1) as a, named_struct('x', cast(null as int), 'y', 5) as s"
    assert snapshot_diff(rows(same), rows(order), ["k"]).first()["status"] == "unchanged"
    assert snapshot_diff(rows(same), rows(other), ["k"]).first()["changed_columns"] == ["a", "s"]


def test_snapshot_diff_of_retyped_columns(spark):
    old = spark.sql("select 1 as k, 7 as n, cast(1.5 as decimal(10,2)) as d")
    new = spark.sql("select 1 as k, 7L as n, cast(1.5 as decimal(12,4)) as d")
    assert snapshot_diff(old, new, ["k"]).first()["status"] == "unchanged"
    assert snapshot_diff(old, new.withColumn("n", F.lit(8)), ["k"]).first()["changed_columns"] == ["n"]


@pytest.fixture
def database(spark):
    name = f"t_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_restore_into_a_table(spark, tmp_path, database):
    path, table = str(tmp_path), f"{database}.items"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, `odd name` string")
    archive_table(rows, path, "shop/items = 1", at(1))
    archive_table(rows.limit(0), path, "shop/items = 1", at(2))
    replace_table(spark.range(7), table)
    assert restore_into(spark, path, "shop/items = 1", table, archived_at=at(1).archived_at) == 2
    assert sorted(spark.table(table).collect()) == [(1, "a"), (2, None)]
    assert read_previous(spark, table).count() == 7
    assert restore_into(spark, path, "shop/items = 1", table) == 0  # the latest one is empty
    assert spark.table(table).columns == ["id", "odd name"] and spark.table(table).count() == 0


def test_a_restore_that_lacks_rows_is_refused(spark, tmp_path, database):
    path, table = str(tmp_path), f"{database}.items"
    archive_table(spark.range(0, 10, 1, 2), path, "items", at(1))
    replace_table(spark.range(3), table)
    next((tmp_path / "rows").rglob("part-*.parquet")).unlink()
    with pytest.raises(ValueError, match="has 5 rows, its header says 10"):
        restore_into(spark, path, "items", table)
    assert spark.table(table).count() == 3 and len(versions(spark, table)) == 1


def test_headers_of_one_asset_are_found_without_the_others(spark, tmp_path):
    path = str(tmp_path)
    for name in ("t", "u", "a/b c"):
        archive_table(spark.range(2), path, name, at(1))
    chosen = list_archive(read_headers(spark, path), "a/b c")
    assert [r["asset_name"] for r in chosen.collect()] == ["a/b c"]
    assert "PartitionFilters: [isnotnull(asset_name" in plan_of(chosen)
