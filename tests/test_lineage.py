import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrace.operators.lineage import (
    LINEAGE_DDL, Run, column_entries, data_challenge, operation, referenced_columns, upgrade_lineage,
    with_lineage,
)
from terrace.functions.udfs import STANDARD_UDFS, register_udfs
from terrace.operators.provenance import (
    lineage_edges, provenance_registry, read_registry, store_models, trace_column, trace_recorded,
)
from terrace.plans.model import build_model, build_models
from pyspark.sql import types as T


def entries(df, **where):
    row = df.select("_lineage").first()[0]
    return {c["name"]: c for c in row["columns"] or []}


def test_struct_shape(models):
    stored = models["bed_yield"].schema["_lineage"].dataType
    canonical = T.DataType.fromDDL(LINEAGE_DDL)
    assert stored.simpleString() == canonical.simpleString()


def test_header_fields(spark):
    run = Run("abc", "2024-01-01", "dedicated", datetime(2024, 1, 2))
    origin = {"type": "seed", "path": "a.csv", "format": "csv"}
    spec = {"source": "t", "version": "v3", "schema": "gold", "origin": origin, "columns": {"id": None}}
    line = build_model("m", spec, {"t": spark.range(1)}, run).first()["_lineage"]
    assert line[:9] == ("4", "m", "t", "abc", "2024-01-01", "dedicated", "gold.m", "v3", "full")
    assert line["origin"] == ("seed", "a.csv", "", "csv", datetime(2024, 1, 2))
    assert line["columns"] is None  # nothing but passed-through columns
    with pytest.raises(ValueError):
        build_model("m", {**spec, "origin": {"type": "fax"}}, {"t": spark.range(1)})
    with pytest.raises(ValueError):
        build_model("m", spec, {"t": spark.range(1)}, lineage_mode="verbose")


def test_inputs_are_source_values(spark):
    t = spark.createDataFrame([(2, "49.999")], "quantity int, price string")
    spec = {
        "source": "t",
        "columns": {
            "unit_price": {"source_column": "price", "type": "decimal(10,2)", "cast": True},
            "price": {"type": "double", "cast": True},
            "line_total": {"expr": "quantity * price"},
        },
    }
    found = entries(build_model("m", spec, {"t": t}))
    # renamed and cast: the source column is named, with its raw value
    assert found["unit_price"]["inputs"] == {"price": "49.999"}
    assert found["unit_price"]["expression"] == "cast(price as decimal(10,2))"
    assert found["price"]["inputs"] == {"price": "49.999"}
    assert found["line_total"]["inputs"] == {"quantity": "2", "price": "49.999"}
    light = entries(build_model("m", spec, {"t": t}, lineage_mode="lightweight"))
    assert light["line_total"]["inputs"] == {"quantity": "quantity", "price": "price"}


def test_aggregates_record_their_result(models):
    found = entries(models["bed_yield"].where("bed_id = 4"))
    assert found["earned"]["inputs"] == {"earned": "128.22000"}
    assert found["grade"]["inputs"] == {"earned": "128.22000"} and found["grade"]["op"] == "SQL_UDF"


def test_operation_labels():
    languages = {"a": "sql", "b": "python", "c": "pandas"}
    expected = {
        "SQL_UDF": {"udf": "a(x)"}, "PYTHON_UDF": {"udf": "b(x)"}, "PANDAS_UDF": {"udf": "c(x)"},
        "EXTERNAL_UDF": {"udf": "d(x)"}, "AGGREGATION": {"expr": " SUM(x)"}, "CASE": {"expr": "case when 1=1 then 1 end"},
        "EXPRESSION": {"expr": "x + sum(y)"}, "CAST": {"type": "int", "cast": True}, "PASSTHROUGH": "int",
    }
    assert {operation(spec, languages): spec for spec in expected.values()} == expected


def test_references():
    known = ["a", "b", "c", "date", "addr"]
    assert referenced_columns("f(coalesce(a, b), c)", known) == ["a", "b", "c"]
    assert referenced_columns("case when a = 'b' then C else date(b) end", known) == ["a", "c", "b"]
    assert referenced_columns("o.a * p.b + addr.city", known) == ["o.a", "p.b", "addr"]
    assert referenced_columns("concat('it''s a', b)", known) == ["b"]


def test_nested_udf_arguments_and_quotes(spark):
    t = spark.createDataFrame([(None, 2, "x")], "a int, b int, s string")
    spec = {
        "source": "t",
        "columns": {
            "u": {"udf": "greatest(coalesce(a, b), 1)"},
            "q": {"expr": "case when s = 'x' then 'it''s gold' else 'b' end"},
        },
    }
    df = build_model("m", spec, {"t": t})
    found = entries(df)
    assert found["u"]["inputs"] == {"a": None, "b": "2"}
    assert found["q"]["expression"] == "case when s = 'x' then 'it''s gold' else 'b' end"
    assert df.first()["q"] == "it's gold"


def test_explicit_inputs_win():
    spec = {"x": {"expr": "a + b", "inputs": ["b"]}}
    assert column_entries(spec, ["a", "b"])[0].inputs == {"b": "b"}


def test_same_run_gives_same_rows(models, seeds):
    from fixtures import SPECS

    run = Run("abc", "2024", as_of=datetime(2024, 1, 1))
    spec = {**SPECS["pickings"], "origin": {"type": "seed"}}
    first = build_model("pickings", spec, seeds, run)
    again = build_model("pickings", spec, seeds, run)
    assert first.orderBy("harvest_id").collect() == again.orderBy("harvest_id").collect()


def test_data_challenge(models):
    found = data_challenge(models["bed_yield"], "bed_yield", "earned", "bed_id = 4")
    assert found.columns == [
        "challenged_model", "challenged_column", "_lineage_model", "_lineage_sources", "_lineage_git_commit",
        "_lineage_deployed_at", "_lineage_compute_type", "_lineage_contract_id", "_lineage_version",
        "_lineage_schema_version", "challenged_value",
    ]
    row = found.first()
    assert row["challenged_value"] == EARNED_4 and row["_lineage_sources"] == "tended, pickings"


from decimal import Decimal  # noqa: E402

EARNED_4 = Decimal("128.22")


def test_upgrade_of_old_and_current_rows(spark):
    old = spark.range(1).select(
        F.struct(
            F.lit("3").alias("schema_version"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("sources"),
            F.array(F.struct(F.lit("x").alias("name"), F.lit("a+1").alias("expression"), F.lit("EXPRESSION").alias("op"))).alias("columns"),
        ).alias("_lineage")
    )
    line = upgrade_lineage(old).first()["_lineage"]
    assert line["schema_version"] == "4" and line["sources"] == "" and line["git_commit"] == "unknown"
    assert line["lineage_mode"] == "full" and line["origin"] is None
    assert line["columns"][0] == ("x", "a+1", "EXPRESSION", None)

    run = Run("abc", as_of=datetime(2024, 1, 1))
    current = with_lineage(spark.range(1), "m", ["a", "b"], run=run, origin={"type": "api"}, mode="lightweight")
    mixed = current.unionByName(
        current.withColumn("_lineage", F.col("_lineage").withField("schema_version", F.lit("3")).withField("git_commit", F.lit(None)))
    )
    kept, upgraded = [r["_lineage"] for r in upgrade_lineage(mixed).collect()]
    assert kept == current.first()["_lineage"]
    assert upgraded["git_commit"] == "unknown" and upgraded["origin"]["type"] == "api"
    assert upgraded["lineage_mode"] == "lightweight" and upgraded["schema_version"] == "4"


@pytest.fixture(scope="module")
def stored(spark, seeds, models):
    from fixtures import SPECS

    built = build_models(SPECS, seeds, udf_languages={"loyalty_tier": "sql"}, all_columns=True)
    return built


def test_edges_and_trace(stored):
    edges = lineage_edges(stored)
    trace = {
        (r["target_model"], r["target_column"], r["source_model"], r["source_column"], r["depth"])
        for r in trace_column(edges, "bed_yield", "grade").collect()
    }
    assert trace == {
        ("bed_yield", "grade", "bed_yield", "earned", 1),
        ("bed_yield", "earned", "pickings", "proceeds", 2),
        ("pickings", "proceeds", "raw_harvests", "kilos", 3),
        ("pickings", "proceeds", "raw_harvests", "price_per_kilo", 3),
    }
    assert trace_column(edges, "bed_yield", "nothing").count() == 0


def test_registry(stored):
    rows = provenance_registry({"pickings": stored["pickings"]}).collect()
    assert {r["git_commit"] for r in rows} == {"unknown"}
    assert ("proceeds", "raw_harvests", "kilos") in {
        (r["target_column"], r["source_model"], r["source_column"]) for r in rows
    }


def test_lineage_is_recorded_when_models_are_stored(spark, seeds, tmp_path):
    from fixtures import SPECS

    database, registry = f"t_{uuid.uuid4().hex}", f"{tmp_path}/registry"
    spark.sql(f"CREATE DATABASE {database}")
    languages = register_udfs(spark, STANDARD_UDFS)

    def store(key, specs, commit):
        run = Run(commit, as_of=datetime(2025, 1, 1))
        return store_models(specs, seeds, registry, key, run, database, languages)

    assert store("one", SPECS, "c1") == {"beds": 6, "pickings": 9, "tended": 6, "bed_yield": 6, "crop_yield": 4}
    for _ in range(2):  # a repeated run replaces its own entries
        store("two", {n: SPECS[n] for n in ("beds", "pickings")}, "c2")
    entries = read_registry(spark, registry)
    assert {(r["_run"], r["git_commit"]): r["count"] for r in entries.groupBy("_run", "git_commit").count().collect()} == {
        ("one", "c1"): 28, ("two", "c2"): 14,
    }
    found = trace_recorded(read_registry(spark, registry, "one"), "crop_yield", "total").collect()
    assert {(r["target_model"], r["target_column"], r["source_model"], r["source_column"], r["model_rows"], r["depth"]) for r in found} == {
        ("crop_yield", "total", "bed_yield", "earned", 4, 1),
        ("bed_yield", "earned", "pickings", "proceeds", 6, 2),
        ("pickings", "proceeds", "raw_harvests", "kilos", 9, 3),
        ("pickings", "proceeds", "raw_harvests", "price_per_kilo", 9, 3),
    }
    assert spark.table(f"{database}.bed_yield").count() == 6
    # a column that passes through has one source, though both have one of its name
    passed = entries.where("_run = 'one' AND target_model = 'bed_yield' AND target_column = 'bed_id'").collect()
    assert [(r["source_model"], r["source_column"]) for r in passed] == [("tended", "bed_id")]
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_diamond_is_traced_once(spark):
    t = spark.createDataFrame([(1,)], "a int")
    specs = {
        "m1": {"source": "t", "columns": {"b": {"expr": "a + 1"}, "c": {"expr": "a + 2"}}},
        "m2": {"source": "m1", "columns": {"d": {"expr": "b * c"}}},
    }
    built = build_models(specs, {"t": t})
    found = trace_column(lineage_edges(built), "m2", "d").collect()
    assert sorted((r["source_model"], r["source_column"], r["depth"]) for r in found) == [
        ("m1", "b", 1), ("m1", "c", 1), ("t", "a", 2), ("t", "a", 2),
    ]
