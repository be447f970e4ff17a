import uuid
from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from terrace.operators.domains import (
    build_domain_model, domain_instance, instance_name, split_by_rule, union_domains,
)
from terrace.operators.evolve import LostValues, describe, evolve, evolve_stored, evolve_tables, retype_losses
from terrace.plans.model import build_model, build_models
from terrace.session import checkpoint, checkpoint_root, scratch_path
from terrace.sources.tables import (
    create_managed_table, create_view, materialise, migrate_lineage, previous_name, quarantine_name, read_files,
    read_previous, read_table, replace_table, run_sql, write_table,
)
from terrace.sources.versions import current_version, versions, write_version

DOMAINS = ["eu", "us"]


@pytest.fixture(scope="module")
def tables(spark):
    def customers(*rows):
        return spark.createDataFrame(list(rows), "id int, country string")

    return {
        "customers_eu": customers((1, "UK"), (2, "DE")),
        "customers_us": customers((1, "US")),
        "orders_eu": spark.createDataFrame([(1, 10), (1, 20), (2, 30)], "customer_id int, total int"),
        "orders_us": spark.createDataFrame([(1, 99)], "customer_id int, total int"),
        "countries": spark.createDataFrame([("UK", "Kingdom"), ("DE", "Germany"), ("US", "States")], "code string, name string"),
    }


def domain_sources(prefix, alias=None):
    return {d: ({alias: f"{prefix}_{d}"} if alias else f"{prefix}_{d}") for d in DOMAINS}


def build(name, spec, tables):
    return build_domain_model(name, spec, tables, DOMAINS)


def staged(tables):
    customers = build("customers", {"source": "customers_eu", "domain_sources": domain_sources("customers"), "columns": {"id": None, "country": None}}, tables)
    orders = build("orders", {"source": "orders_eu", "domain_sources": domain_sources("orders"), "columns": {"customer_id": None, "total": None}}, tables)
    return {**tables, "customers": customers, "orders": orders}


JOINED = {
    "sources": {"c": "customers", "o": "orders", "n": "countries"},
    "join": ["c.id = o.customer_id", "c.country = n.code"],
    "group_by": ["c.id", "n.name"],
    "columns": {"id": {"from": "c"}, "country": {"from": "n", "source_column": "name"}, "total": {"expr": "sum(o.total)"}},
}


def test_one_plan_for_all_domains(tables):
    built = build("summary", JOINED, staged(tables))
    rows = sorted((r["domain"], r["id"], r["country"], r["total"]) for r in built.collect())
    # customer 1 exists in both domains: orders only join inside a domain, countries are shared
    assert rows == [("eu", 1, "Kingdom", 30), ("eu", 2, "Germany", 30), ("us", 1, "States", 99)]
    assert {r["_lineage"]["model"] for r in built.collect()} == {"summary_eu", "summary_us"}
    assert domain_instance(built, "us").count() == 1 and instance_name("summary", "us") == "summary_us"


KINDS = ["inner", "left", "right", "full", "left semi", "left anti"]


def by_domain(spec, frames, domains):
    """The rows of every domain built by itself."""
    rows = []
    for domain in domains:
        own = {n: domain_instance(df, domain) if "domain" in df.columns else df for n, df in frames.items()}
        rows += [(domain, *r) for r in build_model("m", spec, own, lineage_mode=None).collect()]
    return Counter(rows)


@pytest.fixture(scope="module")
def sides(spark):
    """Two tables, each shared and by domain; keys missing on either side, in one domain, and repeated ones."""
    def table(rows, kind):
        shared = spark.createDataFrame([r[:2] for r in rows], f"{kind}_key int, {kind}_value int")
        return shared, spark.createDataFrame([r for r in rows], f"{kind}_key int, {kind}_value int, domain string")

    left = table([(1, 10, "eu"), (1, 11, "us"), (2, 12, "eu"), (2, 12, "eu"), (3, 13, "us"), (None, 14, "eu"), (9, 15, "us")], "l")
    right = table([(1, 20, "us"), (2, 21, "us"), (3, 22, "us"), (3, 23, "eu"), (7, 24, "eu"), (None, 25, "us")], "r")
    third = table([(1, 30, "us"), (2, 31, "eu"), (8, 32, "eu")], "t")
    return {"l": left, "r": right, "t": third}


@pytest.mark.parametrize("tagged", [(1, 1), (1, 0), (0, 1)])
@pytest.mark.parametrize("kind", KINDS)
def test_domains_of_every_join(sides, kind, tagged):
    """The one plan gives what building each domain by itself gives; a domain without rows included."""
    frames = {n: sides[n][t] for n, t in zip("lr", tagged)}
    names = ["l_key", "l_value"] + ([] if kind in KINDS[4:] else ["r_key", "r_value"])
    spec = {"sources": {"l": "l", "r": "r"}, "join": "l.l_key = r.r_key", "join_type": kind, "columns": {n: None for n in names}}
    domains = ["eu", "us", "none"]
    built = build_domain_model("m", spec, frames, domains, lineage_mode=None)
    assert built.columns == ["domain", *names]
    assert Counter(map(tuple, built.collect())) == by_domain(spec, frames, domains)
    totals = {**spec, "group_by": [], "columns": {"n": {"expr": "count(*)"}, "s": {"expr": "sum(l_value)"}}}
    built = build_domain_model("m", totals, frames, domains, lineage_mode=None)
    assert Counter(map(tuple, built.collect())) == by_domain(totals, frames, domains)


@pytest.mark.parametrize("kinds", [("left", "full"), ("full", "full"), ("right", "left"), ("full", "right"), ("left", "left anti")])
@pytest.mark.parametrize("tagged", [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1), (0, 0, 0)])
def test_domains_of_three_sources(sides, kinds, tagged):
    frames = {n: sides[n][t] for n, t in zip("lrt", tagged)}
    names = ["l_value", "r_value"] + ([] if "anti" in kinds[1] else ["t_value"])
    spec = {"sources": {n: n for n in "lrt"}, "join": ["l.l_key = r.r_key", "coalesce(l.l_key, r.r_key) = t.t_key"], "join_type": list(kinds), "columns": {n: None for n in names}}
    domains = ["eu", "us"]
    built = build_domain_model("m", spec, frames, domains, lineage_mode=None)
    assert Counter(map(tuple, built.collect())) == by_domain(spec, frames, domains)


def test_totals_of_an_empty_domain_name_their_instance(sides):
    spec = {"source": "l", "group_by": [], "columns": {"n": {"expr": "count(*)"}}}
    built = build_domain_model("m", spec, {"l": sides["l"][1]}, ["eu", "none"])
    assert sorted((r["domain"], r["n"], r["_lineage"]["model"]) for r in built.collect()) == [("eu", 4, "m_eu"), ("none", 0, "m_none")]


def test_join_sources_may_differ_per_domain(tables):
    spec = {**JOINED, "sources": {"c": "customers", "o": "orders_eu", "n": "countries"}, "domain_sources": domain_sources("orders", "o")}
    built = build("summary", spec, staged(tables))
    assert sorted((r["domain"], r["id"], r["total"]) for r in built.collect()) == [("eu", 1, 30), ("eu", 2, 30), ("us", 1, 99)]


def test_opting_out_and_shared_sources(tables):
    spec = {"source": "countries", "columns": {"code": None}}
    assert build("c", {**spec, "domain": False}, tables).columns == ["code", "_lineage"]
    every = build("c", spec, tables)
    assert sorted((r["domain"], r["code"]) for r in every.collect()) == [
        (d, c) for d in DOMAINS for c in ("DE", "UK", "US")
    ]


def test_union_and_split(spark, tables, tmp_path):
    stacked = union_domains({d: tables[f"customers_{d}"] for d in DOMAINS})
    assert stacked.groupBy("domain").count().count() == 2
    split = split_by_rule(tables["countries"], {"eu": "code IN ('UK', 'DE')", "us": "code = 'US'"})
    assert {r["code"]: r["domain"] for r in split.collect()} == {"UK": "eu", "DE": "eu", "US": "us"}
    partly = split_by_rule(tables["countries"], {"eu": "code = 'UK'"}, default="rest")
    assert partly.where("domain = 'rest'").count() == 2
    path = str(tmp_path / "split")
    write_table(split, path, partition_by=["domain"])
    plan = plan_of(domain_instance(read_table(spark, path), "us"))
    assert "PartitionFilters: [isnotnull(domain" in plan


CHANGE = {
    "add_columns": {"tier": {"expr": "case when total > 15 then 'it''s gold' else 'b' end"}, "note": {"type": "date"}},
    "remove_columns": ["customer_id", "missing"],
    "rename_columns": {"total": "amount", "missing": "x"},
    "change_type": {"amount": {"from": "int", "to": "decimal(10,2)", "cast": True}},
}


def test_evolve(tables):
    evolved = evolve(tables["orders_eu"], [CHANGE])
    assert evolved.dtypes == [("amount", "decimal(10,2)"), ("tier", "string"), ("note", "date")]
    assert sorted(evolved.collect())[0] == (Decimal("10.00"), "b", None)
    assert describe(tables["orders_eu"], [CHANGE]) == [
        "add column 'tier' string", "add column 'note' date", "remove column 'customer_id'",
        "rename 'total' to 'amount'", "retype 'amount': int to decimal(10,2)",
    ]
    with pytest.raises(ValueError, match="unknown table"):
        evolve_tables(tables, [{"model": "nope"}])
    changed = evolve_tables(tables, [{"model": "orders_us", **CHANGE}])
    assert changed["orders_us"].columns == ["amount", "tier", "note"] and changed["orders_eu"] is tables["orders_eu"]


def test_retyping_counts_what_it_would_lose(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    change = {"change_type": {"a": {"to": "int"}}}
    assert retype_losses(df, change).collect() == [("a", 1)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        evolve(df, [change]).collect()
    lenient = {"change_type": {"a": {"to": "int", "on_bad": "null"}}}
    assert sorted(evolve(df, [lenient]).collect(), key=str) == [(1,), (None,), (None,)]


@pytest.fixture
def table(spark):
    database = f"t_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    yield f"{database}.customers"
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_replacing_keeps_the_version_before(spark, table):
    replace_table(spark.range(5), table)
    replace_table(spark.table(table).where("id > 1"), table)  # reads what it replaces
    assert spark.table(table).count() == 3 and read_previous(spark, table).count() == 5
    replace_table(spark.table(table).where("id > 3"), table)
    assert spark.table(table).count() == 1 and read_previous(spark, table).count() == 3
    write_table(spark.table(table).union(spark.table(table)), table)
    assert read_table(spark, table).count() == 2 and spark.table(previous_name(table)).count() == 3


def test_a_failed_replacement_leaves_the_table(spark, table):
    replace_table(spark.range(5), table)
    with pytest.raises(Exception):
        replace_table(spark.range(5).selectExpr("cast('x' || id as int) id"), table)
    assert spark.table(table).count() == 5
    replace_table(spark.range(2), table)
    assert spark.table(table).count() == 2


def stored(spark, table):
    database = table.split(".")[0]
    return {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database}").where("NOT isTemporary").collect()}


def test_a_version_that_was_not_published_is_never_read(spark, table):
    replace_table(spark.range(5), table)
    write_version(spark.range(9), table)  # and the run ends here
    assert spark.table(table).count() == 5 and len(stored(spark, table)) == 3
    replace_table(spark.range(2), table)
    assert spark.table(table).count() == 2 and read_previous(spark, table).count() == 5
    assert stored(spark, table) == {"customers", "customers_v_previous"} | {v.split(".")[1].lower() for v in versions(spark, table)}
    assert len(versions(spark, table)) == 2


def test_readers_always_find_a_whole_version(spark, table):
    """One thread replaces the table, another reads it all the time; data stay where they were written."""
    import threading

    replace_table(spark.range(10), table)
    counts, errors, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                counts.append(spark.table(table).count())
            except Exception as error:
                errors.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(11, 19):
        replace_table(spark.range(n), table)
    done.set()
    reader.join()
    assert not errors and set(counts) <= set(range(10, 19)) and len(counts) > 3
    files = spark.table(table).inputFiles()
    replace_table(spark.range(3), table)
    assert read_previous(spark, table).inputFiles() == files


def test_a_plain_table_is_taken_over(spark, table):
    spark.range(4).write.saveAsTable(table)
    assert current_version(spark, table) is None
    replace_table(spark.table(table).where("id > 0"), table)
    assert spark.table(table).count() == 3 and read_previous(spark, table).count() == 4
    write_table(spark.range(2), table, mode="append")
    assert spark.table(table).count() == 5


LOSSY = [
    {"rename_columns": {"a": "b"}, "add_columns": {"note": "string"}},
    {"change_type": {"b": {"to": "int"}, "c": {"to": "tinyint"}}},
]


def test_stored_tables_evolve_if_nothing_is_lost(spark, table):
    rows = spark.createDataFrame([("1", 5), ("2", 300), ("x", 7), (None, None)], "a string, c int")
    replace_table(rows, table)
    with pytest.raises(LostValues) as refused:
        evolve_stored(spark, table, LOSSY)
    assert refused.value.counts == {"b": 1, "c": 1}
    assert spark.table(table).columns == ["a", "c"] and len(versions(spark, table)) == 1
    assert evolve_stored(spark, table, LOSSY, allow_losses=True) == {"b": 1, "c": 1}
    assert sorted(map(tuple, spark.table(table).collect()), key=str) == [(1, 5, None), (2, None, None), (None, 7, None), (None, None, None)]
    assert read_previous(spark, table).columns == ["a", "c"]
    assert evolve_stored(spark, table, [{"change_type": {"b": {"to": "bigint"}}}, {"remove_columns": ["c"]}]) == {"b": 0}
    assert dict(spark.table(table).dtypes) == {"b": "bigint", "note": "string"}
    assert evolve_stored(spark, table, [{"rename_columns": {"b": "id"}}]) == {}


def test_managed_table_is_never_emptied(spark, table):
    create_managed_table(spark, table, {"id": "bigint", "name": "string"}, lineage=True)
    assert spark.table(table).columns == ["id", "name", "_lineage"] and spark.table(table).count() == 0
    write_table(spark.table(table).limit(0).union(spark.sql("SELECT 1L, 'a', cast(null as " + spark.table(table).schema["_lineage"].dataType.simpleString() + ")")), table, mode="append")
    create_managed_table(spark, table, {"id": "bigint"})
    assert spark.table(table).count() == 1


def test_lineage_of_a_stored_table_is_migrated_once(spark, table):
    old = spark.range(3).withColumn("_lineage", F.struct(F.lit("3").alias("schema_version"), F.lit("m").alias("model")))
    replace_table(old, table)
    assert migrate_lineage(spark, table) and not migrate_lineage(spark, table)
    rows = spark.table(table).collect()
    assert len(rows) == 3 and {(r["_lineage"]["schema_version"], r["_lineage"]["model"]) for r in rows} == {("4", "m")}
    stale = spark.table(table).withColumn("_lineage", F.col("_lineage").withField("schema_version", F.lit("3")))
    replace_table(stale, table)
    assert migrate_lineage(spark, table) and read_previous(spark, table).count() == 3


def test_a_stored_model_leaves_its_quarantine_beside_it(spark, table, models):
    from fixtures import SPECS

    spec = {**SPECS["beds"], "quarantine": SPECS["tended"]["quarantine"], "materialized": "table"}
    stored = materialise(models["beds"], table, spec)
    assert stored.count() == 6
    assert sorted(r[0] for r in spark.table(quarantine_name(table)).select("bed_id").collect()) == [2, 3]


def test_managed_models(spark, tables):
    specs = {"log": {"managed_by": "python", "columns": {"id": "bigint"}}, "m": {"source": "log", "columns": {"id": None}}}
    assert build_models(specs, tables)["m"].count() == 0
    assert build_models(specs, {"log": spark.range(3)})["m"].count() == 3


def test_rebalanced_writes(spark, tmp_path):
    df = spark.range(0, 1000, 1, 8).withColumn("d", F.col("id") % 3)
    write_table(df, f"{tmp_path}/many", partition_by=["d"])
    write_table(df, f"{tmp_path}/few", partition_by=["d"], rebalance=True)
    files = {n: len(read_table(spark, f"{tmp_path}/{n}").inputFiles()) for n in ("many", "few")}
    assert files["many"] == 24 and files["few"] == 3
    assert read_table(spark, f"{tmp_path}/few").count() == 1000


def test_write_modes_on_paths(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_table(spark.range(3), path)
    write_table(spark.range(2), path, mode="append")
    assert read_table(spark, path).count() == 5
    write_table(spark.range(1), path)
    assert read_table(spark, path).count() == 1
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_table(spark.range(1), path, mode="errorifexists")


def test_views_and_tables_of_models(spark, table):
    df = spark.range(3)
    assert materialise(df, "a_view", {}).count() == 3 and spark.catalog.tableExists("a_view")
    assert materialise(df, table, {"materialized": "table"}).count() == 3
    assert create_view(df.limit(1), "a_view").count() == 1


def test_files_and_sql(spark, tmp_path, seeds):
    spark.range(3).write.option("sep", ";").csv(f"{tmp_path}/c")
    assert read_files(spark, f"{tmp_path}/c", "csv", {"id": "int"}, sep=";").agg(F.sum("id")).first()[0] == 3
    with pytest.raises(ValueError):
        read_files(spark, f"{tmp_path}/c", "xml")
    found = run_sql(spark, "SELECT * FROM {t} WHERE crop = {c}", t=seeds["raw_beds"], c="it's")
    assert found.count() == 0
    assert seeds["raw_beds"].where("bed_id = 2").first()["keeper"] is None
    assert seeds["raw_harvests"].where("harvest_id = 501").first()["picked"] == date(2025, 6, 14)


def test_seed_with_a_bad_value_fails(spark, tmp_path):
    from terrace.sources.tables import read_seed

    (tmp_path / "s.csv").write_text("id\n1\nx\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read_seed(spark, str(tmp_path / "s.csv"), {"id": "int"}).collect()


def test_checkpoints_go_to_the_shared_folder(spark):
    root = checkpoint_root(spark)
    assert scratch_path(spark, "x").startswith(root)
    cut = checkpoint(spark.range(3).withColumn("x", F.lit(1)))
    assert cut.count() == 3 and "RDDScan" in plan_of(cut) or "ExistingRDD" in plan_of(cut)
