from datetime import date
from decimal import Decimal

import pytest
from plans import plan_of
from fixtures import BED_COLUMNS, CROPS, YIELD
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.casts import lenient_cast
from terrace.functions.udfs import STANDARD_UDFS, clean_text, parameters, register_udf, register_udfs
from terrace.operators.contracts import (
    apply_udf, bad_rows, conform, contract_schema, managed_frame, require_valid, transform, typed_frame,
    with_errors,
)
from terrace.operators.joins import equal_columns, heavy_keys, join_sources, join_type, spread
from terrace.plans.model import build_model
from terrace.sizing import fits_broadcast, input_bytes, measured_bytes
from terrace.types import spark_type


def ids(df, column="customer_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_yield_of_the_seeds(models):
    rows = models["bed_yield"].collect()
    assert {r["bed_id"]: (r["times"], r["earned"], r["best"], r["last_picked"], r["grade"]) for r in rows} == YIELD
    assert {r["crop"]: (r["beds"], r["total"]) for r in models["crop_yield"].collect()} == CROPS


def test_column_order_follows_the_model(models):
    assert models["bed_yield"].columns[-3:] == ["last_picked", "grade", "_lineage"]


def test_udf_wins_over_expr_and_expr_over_source(spark):
    register_udf(spark, "twice", {"params": ["x: int"], "returns": "int", "body": "x * 2"})
    t = spark.createDataFrame([(1, 5)], "a int, b int")
    spec = {
        "source": "t",
        "columns": {
            "u": {"udf": "twice(a)", "expr": "a + 100", "type": "string", "cast": False},
            "e": {"expr": "a + b", "type": "string"},
            "c": {"source_column": "b", "type": "string", "cast": True},
            "r": {"source_column": "b"},
        },
    }
    row = build_model("m", spec, {"t": t}, lineage_mode=None)
    assert row.dtypes == [("u", "int"), ("e", "int"), ("c", "string"), ("r", "int")]
    assert row.first() == (2, 6, "5", 5)


def test_expressions_see_the_raw_column_not_the_cast_one(spark):
    t = spark.createDataFrame([(2, 1.256)], "quantity int, unit_price double")
    spec = {
        "source": "t",
        "columns": {
            "unit_price": {"type": "decimal(10,2)", "cast": True},
            "line_total": {"expr": "quantity * unit_price"},
        },
    }
    assert build_model("m", spec, {"t": t}, lineage_mode=None).first() == (Decimal("1.26"), 2.512)


def test_bad_value_is_an_error_or_null(spark):
    t = spark.createDataFrame([("x",), ("7",)], "a string")
    strict = {"source": "t", "columns": {"a": {"type": "int", "cast": True}}}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        build_model("m", strict, {"t": t}, lineage_mode=None).collect()
    lenient = {"source": "t", "columns": {"a": {"type": "int", "cast": True, "on_bad": "null"}}}
    assert build_model("m", lenient, {"t": t}, lineage_mode=None).collect() == [(None,), (7,)]


@pytest.mark.parametrize(
    "source, target, values",
    [
        ("string", "int", ["1", " 2 ", "+3", "-4", "1.5", "x", "", "99999999999", None, "--1", "\t5\n", "1e3"]),
        ("string", "boolean", ["true", " T ", "no", "0", "2", "maybe", None, "", "yes\t"]),
        ("string", "decimal(5,2)", ["1.239", "999.994", "999.995", "1000", "x", None, "1e2"]),
        ("double", "decimal(5,2)", [1.005, 999.994, 999.995, 999.999, 1000.0, -1e300, float("nan"), float("inf"), None]),
        ("double", "tinyint", [127.9, 128.0, -128.9, -129.0, float("nan"), None, 1e300]),
        ("double", "bigint", [9.2e18, 9.3e18, -9.3e18, float("inf")]),
        ("bigint", "int", [2**31 - 1, 2**31, -(2**31), -(2**31) - 1, None]),
        ("bigint", "decimal(5,2)", [999, 1000, -999, -1000]),
        ("decimal(20,3)", "decimal(5,2)", [Decimal("999.994"), Decimal("999.995"), Decimal("-1000"), None]),
        ("decimal(20,3)", "smallint", [Decimal("32767.9"), Decimal("32768"), Decimal("40000")]),
        ("date", "string", [date(2024, 1, 1), None]),
    ],
)
def test_lenient_cast_agrees_with_try_cast(spark, source, target, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {source}")
    kind = df.schema[0].dataType
    both = df.select(
        lenient_cast(F.col("v"), kind, spark_type(target)).alias("ours"),
        F.col("v").try_cast(spark_type(target)).alias("sparks"),
    )
    assert both.where("not (ours <=> sparks)").count() == 0


def test_types():
    assert spark_type("bigint") == T.LongType()
    assert spark_type("Decimal(18, 4)") == T.DecimalType(18, 4)
    assert spark_type("numeric(7)") == T.DecimalType(7, 0)
    assert spark_type("varchar(10)") == T.StringType()
    assert spark_type("array<int>") == T.ArrayType(T.IntegerType())
    with pytest.raises(ValueError):
        spark_type("blob9")


def test_three_sources_with_one_condition_each(spark):
    a = spark.createDataFrame([(1, "a")], "id int, x string")
    b = spark.createDataFrame([(1, 10), (1, 11)], "a_id int, k int")
    c = spark.createDataFrame([(10, "t")], "k int, y string")
    spec = {
        "sources": {"a": "a", "b": "b", "c": "c"},
        "join": ["a.id = b.a_id", "b.k = c.k"],
        "join_type": ["inner join", "left join"],
        "columns": {"x": {"from": "a"}, "k": {"from": "b"}, "y": {"from": "c"}},
    }
    built = build_model("m", spec, {"a": a, "b": b, "c": c}, lineage_mode=None)
    assert sorted(built.collect()) == [("a", 10, "t"), ("a", 11, None)]


def test_join_types():
    assert join_type("LEFT OUTER JOIN") == "left"
    assert join_type("left_anti") == "left_anti"
    with pytest.raises(ValueError):
        join_type("natural join")
    with pytest.raises(ValueError):
        join_sources({"a": None, "b": None}, "")


def test_broadcast_only_below_the_limit(models, spark, seeds):
    assert "BroadcastHashJoin" in plan_of(models["bed_yield"])
    left = spark.range(10**7).withColumnRenamed("id", "a")
    right = spark.range(10**7).withColumnRenamed("id", "b")
    joined = join_sources({"l": left, "r": right}, "l.a = r.b", broadcast="r", broadcast_limit=1000)
    assert "BroadcastHashJoin" not in plan_of(joined)
    assert "BroadcastHashJoin" in plan_of(join_sources({"l": left, "r": right}, "l.a = r.b", broadcast="r", broadcast_limit=10**9))


def test_small_files_may_hold_too_much_for_a_broadcast(spark, tmp_path):
    """The rows are measured: 100 copies of a long text take little room in a file, and so does what is exploded."""
    spark.range(100).select("id", F.repeat(F.lit("long text "), 10_000).alias("t")).coalesce(1).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert input_bytes(t) < 200_000 and measured_bytes(t, 10**9) > 10**7
    assert not fits_broadcast(t, 5 * 10**6) and fits_broadcast(t, 10**8) and fits_broadcast(t.select("id"), 10**6)
    joined = join_sources({"l": spark.range(10).toDF("k"), "r": t}, "l.k = r.id", broadcast="r", broadcast_limit=5 * 10**6)
    assert "ResolvedHint (strategy=broadcast)" not in joined._jdf.queryExecution().analyzed().toString()
    grown = t.select(F.explode(F.sequence(F.lit(0), F.lit(10**6))).alias("k"))
    assert not fits_broadcast(grown, 10**6) and measured_bytes(grown, 10**6) < 3 * 10**6
    nested = spark.range(5).select(F.array(F.repeat(F.lit("x"), 1000)).alias("a"), F.lit(None).cast("decimal(10,2)").alias("d"))
    assert 5000 < measured_bytes(nested, 10**6) < 6000


HOWS = ("inner", "left", "right", "full", "left_semi", "left_anti")


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("hot", ["l", "r"])
@pytest.mark.parametrize("condition", ["l.k = r.k2", "r.k2 = l.k and l.v = r.w", "l.k = r.k2 AND l.v < r.w % 9", "l.k = r.k2 AND false"])
def test_salted_join_gives_the_plain_result(spark, how, hot, condition):
    # a third of all rows on one key, identical copies, missing keys, keys on one side only
    left = spark.range(90).selectExpr("if(id % 3 = 0, 0, nullif(id % 40, 5)) k", "nullif(id % 7, 3) v")
    right = spark.range(60).selectExpr("if(id % 3 = 0, 0, nullif(id % 30 + 20, 31)) k2", "id % 11 w")
    sources = {"l": left, "r": right}
    plain = join_sources(sources, condition, how)
    salted = join_sources(sources, condition, how, salt={hot: 5}, broadcast_limit=0)
    names = [F.col(n) for n in plain.columns]
    assert sorted(map(str, salted.select(names).collect())) == sorted(map(str, plain.select(names).collect()))
    assert salted.where("l.k is null or l.v >= 0").count() == plain.where("l.k is null or l.v >= 0").count()


def test_heavy_keys_and_their_rows(spark, tmp_path):
    """Only hot keys are spread, and equal rows of a file get different salts."""
    df = spark.range(40_000).selectExpr("if(id % 3 = 0, -1, if(id % 5 = 0, null, id)) k", "cast(id % 2 as string) s")
    assert heavy_keys(df, ["k"], 8) == [df.where("k = -1").select(F.xxhash64("k")).first()[0]]
    assert len(heavy_keys(df, ["s"], 8)) == 2 and heavy_keys(df.where("k > 0"), ["k"], 8) == [] and heavy_keys(df.limit(0), ["k"], 8) == []
    spark.range(1000).selectExpr("7 as k").coalesce(1).write.parquet(f"{tmp_path}/t")
    same = spark.read.parquet(f"{tmp_path}/t")
    salts = spread(same.select("k").where("k > 0"), 8).groupBy("__salt").count().collect()
    assert len(salts) == 8 and min(r["count"] for r in salts) > 60
    counted = {"source": "t", "sources": {"t": "t", "o": "o"}, "join": "t.k = o.k", "salt": {"t": 8}, "group_by": [], "columns": {"n": {"expr": "count(*)"}}}
    built = build_model("m", counted, {"t": same, "o": spark.range(20).selectExpr("cast(id as int) as k")}, lineage_mode=None, broadcast_limit=0)
    assert built.first()[0] == 1000
    unsalted = join_sources({"l": df.where("k > 0"), "r": df}, "l.k = r.k", salt={"l": 8}, broadcast_limit=0)
    assert "__salt" not in unsalted.columns


@pytest.mark.parametrize("kind", ["inner", "right"])
@pytest.mark.parametrize("condition", ["r.k2 = h.k3", "r.k2 = h.k3 and h.x % 2 = l.v % 2"])
def test_a_later_source_can_be_hot(spark, kind, condition):
    left = spark.range(40).selectExpr("id k", "id % 5 v")
    right = spark.range(30).selectExpr("id k2", "id w")
    hot = spark.range(300).selectExpr("if(id % 3 = 0, 7, id % 50) k3", "id x")
    sources = {"l": left, "r": right, "h": hot}
    names = ["k", "v", "k2", "w", "k3", "x"]
    plain = join_sources(sources, ["l.k = r.k2", condition], ["inner", kind]).select(names)
    salted = join_sources(sources, ["l.k = r.k2", condition], ["inner", kind], salt={"h": 4}, broadcast_limit=0).select(names)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_salted_joins_are_shuffle_joins(spark):
    left, right = spark.range(90).selectExpr("if(id % 3 = 0, 1, id) k"), spark.range(60).selectExpr("if(id % 3 = 0, 1, id) k2")
    for how in HOWS:
        for hot in "lr":
            salted = join_sources({"l": left, "r": right}, "l.k = r.k2", how, salt={hot: 5}, broadcast_limit=0)
            assert "NestedLoop" not in plan_of(salted)
            # existence needs no copies when distinct keys answer it
            assert "SortMergeJoin" in plan_of(salted) or (how in ("left_semi", "left_anti") and hot == "r")
    small = join_sources({"l": left, "r": right}, "l.k = r.k2", "inner", salt={"l": 5}, broadcast_limit=10**6)
    assert "BroadcastHashJoin" in plan_of(small) and "__salt" not in small.columns


def test_plain_equalities():
    assert equal_columns("l.a = r.b AND r.c=l.d", ["l", "r"]) == [("a", "b"), ("d", "c")]
    for other in ("l.a = r.b OR l.c = r.d", "l.a > r.b", "l.a = l.b", "l.a = r.b + 1", "f(l.a) = r.b", "l.a = x.b"):
        assert equal_columns(other, ["l", "r"]) is None


def test_what_cannot_be_salted(spark):
    t = spark.range(3)
    for how, salt in (("left", {"s": 4}), ("inner", {"nope": 4}), ("inner", {"l": 4, "r": 4})):
        with pytest.raises(ValueError):
            join_sources({"l": t, "r": t, "s": t}, ["l.id = r.id", "r.id = s.id"], how, salt=salt)


def test_salted_model_reads_only_named_columns(spark):
    tables = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("lineitem", "orders")}
    spec = {
        "sources": {"l": "lineitem", "o": "orders"},
        "join": "l.l_orderkey = o.o_orderkey",
        "salt": {"l": 4},
        "columns": {"q": {"from": "l", "source_column": "l_quantity"}},
    }
    plan = plan_of(build_model("m", spec, tables, lineage_mode=None, broadcast_limit=0))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_scan_prunes_columns_and_pushes_filters(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    spec = {
        "source": "t", "where": "l_quantity > 49", "group_by": ["l_returnflag"],
        "columns": {"l_returnflag": None, "n": {"expr": "count(*)"}},
    }
    plan = plan_of(build_model("m", spec, {"t": t}).drop("_lineage"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
    assert "GreaterThan(l_quantity,49.0)" in plan


def test_parameter_forms():
    spec = {"params": [{"name": "a", "type": "int"}, "b: double", "c"]}
    assert parameters(spec) == [("a", "int"), ("b", "double"), ("c", "string")]


def test_python_functions(spark):
    register_udfs(spark, STANDARD_UDFS)
    register_udf(
        spark, "shout",
        {"language": "python", "params": ["s"], "handler": "run", "body": "def run(s):\n    return s and s.upper()"},
    )
    df = spark.createDataFrame([("  A@B.C \t", 1.0, 4.0), (None, None, 2.0)], "e string, a double, b double")
    rows = df.selectExpr("clean_email(e)", "average_score(a, b)", "shout(e)").collect()
    assert rows == [("a@b.c", 2.5, "  A@B.C \t"), (None, None, None)]
    assert df.select(clean_text("e")).collect() == [("a@b.c",), (None,)]
    with pytest.raises(ValueError):
        register_udf(spark, "f", {"language": "java", "body": ""})


def test_sql_function_is_inlined(models):
    plan = plan_of(models["bed_yield"].drop("_lineage"))
    assert "CASE WHEN" in plan and "loyalty_tier" not in plan


def test_contract_schema():
    schema = contract_schema({"id": {"type": "bigint", "required": True}, "d": "decimal(7,3)", "s": None}, lineage=True)
    assert schema["id"].dataType == T.LongType() and not schema["id"].nullable
    assert schema["d"].dataType == T.DecimalType(7, 3) and schema["s"].dataType == T.StringType()
    assert schema["_lineage"].dataType.names[-2:] == ["origin", "columns"]


def test_row_validation(spark):
    raw = spark.createDataFrame(
        [("1", "2.50", "a"), (None, "x", "b"), ("9999999999", None, None), ("3", "1.999", None)],
        "id string, price string, note string",
    )
    contract = {"id": {"type": "int", "required": True}, "price": "decimal(5,2)", "note": "string"}
    errors = [r["_errors"] for r in with_errors(raw, contract).collect()]
    assert errors == [
        [], ["id: required value is missing", "price: not a decimal(5,2)"], ["id: not a int"], [],
    ]
    assert bad_rows(raw, contract).count() == 2
    with pytest.raises(ValueError, match="2 invalid rows in 'm'"):
        require_valid(raw, contract, "m")
    good = require_valid(raw.where("note = 'a'"), contract, "m")
    assert conform(good, contract).collect() == [(1, Decimal("2.50"), "a")]
    missing = with_errors(raw.drop("id"), contract).select("_errors").first()[0]
    assert missing[0] == "id: missing column"


def test_many_bad_rows_are_counted_not_listed(spark):
    bad = spark.range(1000).selectExpr("cast(null as int) id")
    with pytest.raises(ValueError, match="and 990 more"):
        require_valid(bad, {"id": {"type": "int", "required": True}}, "m")


def test_contracted_transform_and_udf(spark):
    t = typed_frame(spark, BED_COLUMNS, [(1, "leek", None, "NORA", None, Decimal("1.50"), None)])
    assert apply_udf(t, BED_COLUMNS, "keeper", F.lower).first()["keeper"] == "nora"
    with pytest.raises(ValueError, match="not in the contract"):
        apply_udf(t, BED_COLUMNS, "nope", F.lower)
    with pytest.raises(ValueError, match="the contract says"):
        apply_udf(t, BED_COLUMNS, "area", lambda c: c.cast("string"))
    with pytest.raises(ValueError, match="lacks required"):
        transform(t, BED_COLUMNS, lambda df: df.drop("bed_id"))
    assert managed_frame(spark, BED_COLUMNS, lineage=True).count() == 0


def test_grouping_by_outputs_and_aggregates_named_like_their_input(spark):
    t = spark.createDataFrame([("x", 1), ("x", 2), ("y", 5)], "raw_key string, total int")
    spec = {
        "source": "t",
        "group_by": ["key"],
        "columns": {"key": {"source_column": "raw_key"}, "total": {"expr": "sum(total)"}, "half": {"expr": "sum(total) / 2"}},
    }
    rows = {r["key"]: r for r in build_model("m", spec, {"t": t}, all_columns=True).collect()}
    assert (rows["x"]["total"], rows["y"]["half"]) == (3, 2.5)
    inputs = {c["name"]: c["inputs"] for c in rows["x"]["_lineage"]["columns"]}
    assert inputs == {"key": {"raw_key": "x"}, "total": {"total": "3"}, "half": {"half": "1.5"}}
