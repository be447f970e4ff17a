"""The library applied to the sample star schema: one function per registered query.

Every function takes a session and the folder of the parquet tables and returns a DataFrame over the
whole tables. Dates and decimals are handed out as text and doubles, so any client reads them alike.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.udfs import STANDARD_UDFS, clean_text, content_hash, register_udfs
from terrace.operators import archive as ar
from terrace.operators import evolve as ev
from terrace.operators.checks import check_model, dimension_summary, run_checks
from terrace.operators.contracts import apply_udf, bad_rows, transform, typed_frame
from terrace.operators.diff import diff_summary, snapshot_diff
from terrace.operators.domains import build_domain_model, split_by_rule
from terrace.operators.lineage import Run, data_challenge, upgrade_lineage
from terrace.operators.provenance import lineage_edges, read_registry, store_models, trace_recorded
from terrace.operators.quarantine import split
from terrace.operators.reconcile import append_log, read_log, reconcile_counts, reconcile_totals
from terrace.plans.model import build_model, build_models
from terrace.session import configure, scratch_path
from terrace.sources.ingest import (
    Feed, append_with_lineage, ingest_all, ingest_feed, read_ingested, read_rejected,
)
from terrace.sources.sync import incremental_sync, read_synced
from terrace.sources.tables import (
    create_managed_table, materialise, migrate_lineage, quarantine_name, read_files, read_previous,
    read_seed, read_table, replace_table, run_sql, write_table,
)
from terrace.streaming.ingest import stream_feed

RUN = Run(git_commit="abc1234", deployed_at="2024-01-31 00:00:00", as_of=datetime(2001, 8, 5))
MONEY = "decimal(18,2)"
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")

#: What was billed for each ticket beside what its lines come to, and how that adds up for solvent accounts.
SPECS = {
    "accounts": {
        "source": "customer",
        "origin": {"type": "external_table", "path": "customer", "format": "parquet"},
        "columns": {
            "account_id": {"source_column": "c_custkey", "type": "bigint", "required": True, "unique": True},
            "nation_id": {"source_column": "c_nationkey", "type": "int"},
            "segment": {"source_column": "c_mktsegment"},
            "balance": {"source_column": "c_acctbal", "type": MONEY, "cast": True},
        },
    },
    "tickets": {
        "source": "orders",
        "columns": {
            "ticket_id": {"source_column": "o_orderkey", "type": "bigint", "required": True, "unique": True},
            "account_id": {"source_column": "o_custkey", "type": "bigint", "required": True},
            "state": {"source_column": "o_orderstatus", "accepted_values": ["O", "F"]},
            "priority": {"source_column": "o_orderpriority"},
            "billed": {"source_column": "o_totalprice", "type": MONEY, "cast": True},
            "placed_on": {"source_column": "o_orderdate", "type": "date", "cast": True},
            "urgency": {"expr": "cast(left(o_orderpriority, 1) as int)"},
        },
    },
    "ticket_lines": {
        "source": "lineitem",
        "columns": {
            "ticket_id": {"source_column": "l_orderkey", "type": "bigint"},
            "line_no": {"source_column": "l_linenumber", "type": "int"},
            "flag": {"source_column": "l_returnflag"},
            "units": {"source_column": "l_quantity", "type": MONEY, "cast": True},
            "list_price": {"source_column": "l_extendedprice", "type": MONEY, "cast": True},
            "rebate": {"source_column": "l_discount", "type": "decimal(4,2)", "cast": True},
            "net": {"expr": "list_price * (1 - rebate)", "type": "decimal(18,4)", "cast": True},
        },
    },
    "line_totals": {
        "source": "ticket_lines",
        "group_by": ["ticket_id"],
        "columns": {
            "ticket_id": None,
            "lines": {"expr": "count(*)"},
            "largest": {"expr": "max(units)"},
            "lines_net": {"expr": "sum(net)"},
        },
    },
    "ticket_gaps": {
        "sources": {"t": "tickets", "l": "line_totals"},
        "join": "t.ticket_id = l.ticket_id",
        "join_type": "left",
        "columns": {
            "ticket_id": {"from": "t"},
            "account_id": {"from": "t"},
            "billed": {"from": "t"},
            "lines": {"expr": "coalesce(l.lines, 0)"},
            "gap": {"expr": "t.billed - coalesce(l.lines_net, 0)"},
            "kind": {"expr": "case when l.lines is null then 'empty' when t.billed < l.lines_net then 'under' else 'over' end"},
        },
    },
    "solvent": {
        "source": "accounts",
        "materialized": "table",
        "version": "v2",
        "quarantine": "balance < 0",
        "columns": {"account_id": {"type": "bigint", "required": True}, "nation_id": None, "segment": None, "balance": None},
    },
    "account_gaps": {
        "sources": {"a": "solvent", "g": "ticket_gaps"},
        "join": "a.account_id = g.account_id",
        "broadcast": "a",
        "materialized": "table",
        "group_by": ["a.account_id", "a.segment"],
        "columns": {
            "account_id": {"from": "a"},
            "segment": {"from": "a"},
            "tickets": {"expr": "count(g.ticket_id)"},
            "total_gap": {"expr": "sum(g.gap)"},
            "widest": {"expr": "max(g.gap)"},
            "grade": {"udf": "loyalty_tier(total_gap / 1000)"},
        },
    },
}

#: The accounts with their holders' names, which the stored models do without.
NAMED_ACCOUNTS = {
    **SPECS["accounts"],
    "columns": {"account_id": None, "account_name": {"source_column": "c_name", "type": "string"}, **SPECS["accounts"]["columns"]},
}


def _load(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    configure(spark)
    return {name: spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet") for name in names}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _load(spark, sf, name)[name]


def _models(spark: SparkSession, sf: str, *names: str, **options) -> dict[str, DataFrame]:
    tables = _load(spark, sf, "customer", "orders", "lineitem")
    languages = register_udfs(spark, {"loyalty_tier": STANDARD_UDFS["loyalty_tier"]})
    built = build_models(
        {n: s for n, s in SPECS.items() if not names or n in names}, tables,
        run=RUN, udf_languages=languages, **options,
    )
    return built


def _portable(df: DataFrame) -> DataFrame:
    """Without ``_lineage``, with text dates, double decimals and zone-free timestamps."""
    out = []
    for field in df.schema:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if field.name == "_lineage":
            continue
        if kind == "decimal" or field.name.endswith("row_count") and field.nullable:
            column = column.cast("double")  # clients disagree on integers that can be missing
        elif kind == "date":
            column = column.cast("string")
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        out.append(column.alias(field.name))
    return df.select(*out)


# --- projection ---------------------------------------------------------------------------------


def _named_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return build_model("accounts", NAMED_ACCOUNTS, _load(spark, sf, "customer"), RUN)


def stage_customers(spark: SparkSession, sf: str) -> DataFrame:
    return _portable(_named_accounts(spark, sf))


def stage_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _portable(_models(spark, sf, "tickets")["tickets"])


def stage_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _portable(_models(spark, sf, "ticket_lines")["ticket_lines"])


def contract_transform(spark: SparkSession, sf: str) -> DataFrame:
    columns = {"n_nationkey": {"type": "int", "required": True}, "n_name": {"type": "string", "required": True}}
    nation = apply_udf(_table(spark, sf, "nation"), columns, "n_name", F.lower)
    supplier = _table(spark, sf, "supplier")
    wanted = {**columns, "suppliers": {"type": "bigint", "required": True}}

    def count_suppliers(df: DataFrame) -> DataFrame:
        counts = supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
        return df.join(counts, df["n_nationkey"] == counts["s_nationkey"]).drop("s_nationkey", "n_regionkey")

    return transform(nation, wanted, count_suppliers)


# --- filters ------------------------------------------------------------------------------------


def _split_customers(spark: SparkSession, sf: str, keep_bad: bool) -> tuple[DataFrame, DataFrame]:
    staged = _named_accounts(spark, sf)
    return split(staged, SPECS["solvent"]["quarantine"], "solvent", RUN, keep_bad)


def quarantine_customers(spark: SparkSession, sf: str) -> DataFrame:
    return _portable(_split_customers(spark, sf, True)[1])


def clean_customers(spark: SparkSession, sf: str) -> DataFrame:
    return _portable(_split_customers(spark, sf, False)[0])


def typed_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by a small table of reference rows that a contract types: what each priority promises."""
    contract = {"priority": {"type": "string", "required": True}, "days": {"type": "int", "required": True}, "fee": "decimal(6,2)"}
    rows = [("1-URGENT", 1, Decimal("25.50")), ("2-HIGH", 3, Decimal("12.00")), ("3-MEDIUM", 7, None), ("5-LOW", 30, Decimal("0.75"))]
    promises = typed_frame(spark, contract, rows)
    spec = {
        "sources": {"o": "orders", "p": "promises"},
        "join": "o.o_orderpriority = p.priority",
        "join_type": "left",
        "broadcast": "p",
        "group_by": ["o.o_orderpriority"],
        "columns": {
            "priority": {"from": "o", "source_column": "o_orderpriority"},
            "orders": {"expr": "count(*)"},
            "days": {"expr": "coalesce(max(p.days), -1)"},
            "fees": {"expr": "coalesce(sum(p.fee), 0)"},
        },
    }
    tables = {**_load(spark, sf, "orders"), "promises": promises}
    return _portable(build_model("promised", spec, tables, RUN))


def quarantine_null_rule(spark: SparkSession, sf: str) -> DataFrame:
    """A rule that is NULL for some rows: they are neither caught nor lost."""
    documents = _table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    known = documents.withColumn("size", F.expr("nullif(n_chars, 0) / nullif(length(source) - 4, 0)"))
    clean, bad = split(known, "size > 1000", "documents", RUN, keep_bad=False)
    sides = clean.select(F.lit("clean").alias("side"), "n_chars").unionByName(
        bad.select(F.lit("quarantined").alias("side"), "n_chars")
    )
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


# --- joins --------------------------------------------------------------------------------------


def enrich_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets with what their lines come to; tickets without lines stay."""
    names = ("tickets", "ticket_lines", "line_totals", "ticket_gaps")
    return _portable(_models(spark, sf, *names)["ticket_gaps"])


def nway_join(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "sources": {"o": "orders", "c": "customer", "n": "nation", "r": "region"},
        "join": ["o.o_custkey = c.c_custkey", "c.c_nationkey = n.n_nationkey", "n.n_regionkey = r.r_regionkey"],
        "broadcast": ["n", "r"],
        "columns": {
            "order_id": {"from": "o", "source_column": "o_orderkey"},
            "customer": {"from": "c", "source_column": "c_name"},
            "nation": {"from": "n", "source_column": "n_name"},
            "region": {"from": "r", "source_column": "r_name"},
        },
    }
    tables = _load(spark, sf, "orders", "customer", "nation", "region")
    return _portable(build_model("order_places", spec, tables, RUN))


LARGE_ORDERS = {
    "sources": {"c": "customer", "o": "orders"},
    "join": "c.c_custkey = o.o_custkey AND o.o_totalprice > 40 * c.c_acctbal",
    "join_type": "left join",
    "columns": {
        "customer_id": {"from": "c", "source_column": "c_custkey"},
        "order_id": {"expr": "coalesce(o.o_orderkey, -1)"},
    },
}


def left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Outer join on a condition that is not only an equality."""
    tables = _load(spark, sf, "customer", "orders")
    return _portable(build_model("large_orders", LARGE_ORDERS, tables, RUN))


def salted_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same where few customers may have most orders."""
    tables = _load(spark, sf, "customer", "orders")
    spec = {**LARGE_ORDERS, "salt": {"o": 4}}
    return _portable(build_model("large_orders", spec, tables, RUN, broadcast_limit=0))


def right_join(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        **LARGE_ORDERS,
        "sources": {"o": "orders", "c": "customer"},
        "join_type": "right outer join",
    }
    return _portable(build_model("large_orders", spec, _load(spark, sf, "customer", "orders"), RUN))


PARTNERS = {
    "sources": {"c": "customer", "s": "supplier"},
    "join": "c.c_custkey = s.s_suppkey AND c.c_nationkey % 5 = s.s_nationkey % 5",
    "join_type": "full join",
    "columns": {
        "customer": {"expr": "coalesce(c.c_name, 'none')"},
        "supplier": {"expr": "coalesce(s.s_name, 'none')"},
    },
}


def full_join(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers of the same number and region, and those without a counterpart."""
    return _portable(build_model("partners", PARTNERS, _load(spark, sf, "customer", "supplier"), RUN))


def salted_full_join(spark: SparkSession, sf: str) -> DataFrame:
    tables = _load(spark, sf, "customer", "supplier")
    spec = {**PARTNERS, "salt": {"c": 4}}
    return _portable(build_model("partners", spec, tables, RUN, broadcast_limit=0))


def _existence(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    spec = {
        "sources": {"c": "customer", "o": "orders"},
        "join": "c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'",
        "join_type": kind,
        "columns": {"customer_id": {"from": "c", "source_column": "c_custkey"}},
    }
    return _portable(build_model("customers", spec, _load(spark, sf, "customer", "orders"), RUN))


def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return _existence(spark, sf, "left semi join")


def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return _existence(spark, sf, "left anti join")


def salted_join(spark: SparkSession, sf: str) -> DataFrame:
    """A shuffle join spread over 8 tasks per key, as if orders were too large to broadcast."""
    spec = {
        "sources": {"l": "lineitem", "o": "orders"},
        "join": "l.l_orderkey = o.o_orderkey",
        "salt": {"l": 8},
        "group_by": ["o.o_orderpriority"],
        "columns": {
            "priority": {"from": "o", "source_column": "o_orderpriority"},
            "lines": {"expr": "count(*)"},
            "revenue": {"expr": f"sum(cast(l.l_extendedprice as {MONEY}))"},
        },
    }
    tables = _load(spark, sf, "lineitem", "orders")
    return _portable(build_model("priority_revenue", spec, tables, RUN, broadcast_limit=0))


# --- aggregation --------------------------------------------------------------------------------


def customer_summary(spark: SparkSession, sf: str, **options) -> DataFrame:
    """One row for each account: its tickets and what they were billed too much, graded by a SQL function."""
    return _portable(_models(spark, sf, **options)["account_gaps"])


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "source": "lineitem",
        "where": "l_shipdate <= timestamp_ntz '2000-09-02 00:00:00'",
        "group_by": ["l_returnflag", "l_linestatus"],
        "columns": {
            "l_returnflag": None,
            "l_linestatus": None,
            "lines": {"expr": "count(*)"},
            "sum_qty": {"expr": f"sum(cast(l_quantity as {MONEY}))"},
            "avg_qty": {"expr": "avg(l_quantity)"},
            "min_price": {"expr": "min(l_extendedprice)"},
            "max_price": {"expr": "max(l_extendedprice)"},
            "volume": {"expr": "case when count(*) > 1000 then 'large' else 'small' end"},
            "revenue": {
                "expr": f"sum(cast(l_extendedprice as {MONEY}) * (1 - cast(l_discount as decimal(4,2))))"
            },
        },
    }
    return _portable(build_model("pricing_summary", spec, _load(spark, sf, "lineitem"), RUN))


def orders_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Grouping by the name of a computed output."""
    spec = {
        "source": "orders",
        "group_by": ["order_year", "o_orderstatus"],
        "columns": {
            "order_year": {"expr": "year(o_orderdate)"},
            "o_orderstatus": None,
            "orders": {"expr": "count(*)"},
            "revenue": {"expr": f"sum(cast(o_totalprice as {MONEY}))"},
            "customers": {"expr": "count(distinct o_custkey)"},
        },
    }
    return _portable(build_model("orders_by_year", spec, _load(spark, sf, "orders"), RUN))


def global_totals(spark: SparkSession, sf: str) -> DataFrame:
    spec = {
        "source": "lineitem",
        "group_by": [],
        "columns": {
            "lines": {"expr": "count(*)"},
            "last_ship": {"expr": "max(l_shipdate)"},
            "quantity": {"expr": f"sum(cast(l_quantity as {MONEY}))"},
        },
    }
    return _portable(build_model("totals", spec, _load(spark, sf, "lineitem"), RUN))


# --- functions ----------------------------------------------------------------------------------


def pandas_score(spark: SparkSession, sf: str) -> DataFrame:
    parts = _table(spark, sf, "part")
    languages = register_udfs(spark, {"average_score": STANDARD_UDFS["average_score"]})
    spec = {
        "source": "part",
        "columns": {
            "p_partkey": None,
            "score": {"udf": "average_score(p_size, nullif(p_retailprice, 900))"},
        },
    }
    return _portable(build_model("part_score", spec, {"part": parts}, RUN, languages))


def python_clean_email(spark: SparkSession, sf: str) -> DataFrame:
    languages = register_udfs(spark, {"clean_email": STANDARD_UDFS["clean_email"]})
    spec = {
        "source": "customer",
        "columns": {
            "c_custkey": None,
            "email": {"udf": "clean_email(concat('  ', c_name, '@', c_mktsegment, '.com '))"},
        },
    }
    return _portable(build_model("customer_email", spec, _load(spark, sf, "customer"), RUN, languages))


def clean_document_text(spark: SparkSession, sf: str) -> DataFrame:
    documents = _table(spark, sf, "documents")
    return documents.select("doc_id", F.md5(clean_text("text")).alias("clean_md5"))


def customer_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "customer").select(
        "c_custkey", content_hash("c_custkey", "c_name", "c_mktsegment").alias("content_hash")
    )


# --- lineage ------------------------------------------------------------------------------------


def lineage_flat(spark: SparkSession, sf: str, mode: str = "full") -> DataFrame:
    staged = _models(spark, sf, "tickets", lineage_mode=mode)["tickets"]
    fields = ("schema_version", "model", "sources", "git_commit", "contract_id", "version", "lineage_mode")
    entries = F.col("_lineage.columns")
    return staged.select(
        "ticket_id",
        *[F.col(f"_lineage.{f}").alias(f) for f in fields],
        F.size(entries).cast("long").alias("derived_columns"),
        entries[0]["op"].alias("first_op"),
        entries[0]["expression"].alias("first_expression"),
        entries[0]["inputs"]["o_totalprice"].alias("first_input"),
        entries[2]["op"].alias("last_op"),
    )


def lineage_lightweight(spark: SparkSession, sf: str) -> DataFrame:
    return lineage_flat(spark, sf, "lightweight")


def lineage_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per model, output column and operation, over all columns of all models."""
    models = _models(spark, sf, all_columns=True, lineage_mode="lightweight")
    every = reduce(DataFrame.unionByName, [models[n].select("_lineage") for n in SPECS])
    entries = every.select(F.col("_lineage.model").alias("model"), F.explode("_lineage.columns").alias("entry"))
    return entries.groupBy("model", F.col("entry.name").alias("name"), F.col("entry.op").alias("op")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def origin_stamp(spark: SparkSession, sf: str) -> DataFrame:
    staged = _models(spark, sf, "accounts")["accounts"]
    return staged.select(
        "account_id",
        F.col("_lineage.origin.type").alias("origin_type"),
        F.col("_lineage.origin.path").alias("origin_path"),
        F.col("_lineage.origin.loaded_at").cast("timestamp_ntz").alias("loaded_at"),
    )


def challenge_summary(spark: SparkSession, sf: str) -> DataFrame:
    models = _models(spark, sf)
    found = data_challenge(models["account_gaps"], "account_gaps", "total_gap", "grade = 'GOLD'")
    return _portable(found)


def lineage_upgrade(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that carry version-3 structs, brought to the current shape."""
    orders = _table(spark, sf, "orders")
    old = F.struct(
        F.lit("3").alias("schema_version"),
        F.lit("old_orders").alias("model"),
        F.when(F.col("o_orderstatus") == "O", F.lit("orders")).alias("sources"),
        F.array(
            F.struct(
                F.lit("total").alias("name"), F.lit("o_totalprice").alias("expression"),
                F.lit("CAST").alias("op"),
            )
        ).alias("columns"),
    )
    upgraded = upgrade_lineage(orders.select("o_orderkey", old.alias("_lineage")))
    fields = ("schema_version", "model", "sources", "git_commit", "compute_type", "version", "lineage_mode")
    return upgraded.select(
        "o_orderkey",
        *[F.col(f"_lineage.{f}").alias(f) for f in fields],
        F.col("_lineage.columns")[0]["op"].alias("first_op"),
        F.col("_lineage.origin").isNull().alias("no_origin"),
    )


def lineage_edge_table(spark: SparkSession, sf: str) -> DataFrame:
    """The edges that the rows of all models carry."""
    models = _models(spark, sf, all_columns=True, lineage_mode="lightweight")
    return lineage_edges({n: models[n] for n in SPECS}).drop("expression")


def _recorded(spark: SparkSession, sf: str, registry: str, run_key: str, specs: dict, run: Run = RUN) -> dict[str, int]:
    """All models of ``specs`` built, stored and entered in the registry."""
    tables = _load(spark, sf, "customer", "orders", "lineitem")
    languages = register_udfs(spark, {"loyalty_tier": STANDARD_UDFS["loyalty_tier"]})
    return store_models(specs, tables, registry, run_key, run, _database(spark), languages, lineage_mode=None)


def column_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Where an account's grade comes from, as it was recorded when the models were stored."""
    registry = scratch_path(spark, "registry")
    _recorded(spark, sf, registry, "first", SPECS)
    return trace_recorded(read_registry(spark, registry, "first"), "account_gaps", "grade").drop("expression")


def column_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Every input of every column of all models, with the run that recorded it and the rows of the model."""
    registry = scratch_path(spark, "registry")
    _recorded(spark, sf, registry, "first", SPECS)
    columns = ("target_model", "target_column", "source_model", "source_column", "model_rows", "git_commit", "deployed_at")
    return read_registry(spark, registry).select(*columns).distinct()


def registry_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The registry after two runs, the second of which was repeated: it has another definition of the gap and
    fewer models."""
    registry = scratch_path(spark, "registry")
    _recorded(spark, sf, registry, "first", SPECS)
    names = ("tickets", "ticket_lines", "line_totals", "ticket_gaps")
    changed = {n: SPECS[n] for n in names}
    gap = {"expr": "t.billed - coalesce(l.largest, 0)"}
    changed["ticket_gaps"] = {**SPECS["ticket_gaps"], "columns": {**SPECS["ticket_gaps"]["columns"], "gap": gap}}
    later = Run(git_commit="def5678", deployed_at="2024-02-29 00:00:00", as_of=RUN.as_of)
    for _ in range(2):
        _recorded(spark, sf, registry, "second", changed, later)
    entries = read_registry(spark, registry).where("target_model = 'ticket_gaps'")
    columns = ("_run", "target_column", "op", "source_model", "source_column", "model_rows", "git_commit")
    return entries.select(*columns)


# --- quality ------------------------------------------------------------------------------------


ORDER_CHECKS = [
    {"name": "total_range", "type": "range", "column": "billed", "min": 2000, "max": 499000, "severity": "error"},
    {"name": "unbounded", "type": "range", "column": "billed"},
    {"name": "fresh_7_days", "type": "recency", "column": "placed_on", "max_age": "7 days"},
    {"name": "fresh_24_hours", "type": "recency", "column": "placed_on"},
    {"name": "has_rows", "type": "row_count", "min": 1, "severity": "error"},
    {"name": "has_many_rows", "type": "row_count", "min": 1000000000},
    {"name": "priority_format", "type": "regex", "column": "priority", "pattern": "^[1-3]-"},
    {"name": "unique_customer", "type": "unique", "column": "account_id"},
    {
        "name": "customer_exists", "type": "relationships", "column": "account_id",
        "to": "solvent", "field": "account_id", "severity": "error",
    },
    {"name": "many_accounts", "type": "cardinality", "column": "account_id", "min": 10, "severity": "error"},
    {"name": "few_priorities", "type": "cardinality", "column": "priority", "max": 4},
    {"name": "numbered_by_date", "type": "monotonic", "column": "placed_on", "order_by": "ticket_id"},
    {
        "name": "late_open_orders", "type": "custom_sql",
        "sql": "SELECT count(*) FROM {tickets} WHERE state = 'O' AND year(placed_on) < 1996",
    },
]


def check_results(spark: SparkSession, sf: str) -> DataFrame:
    tickets = _models(spark, sf, "tickets", lineage_mode=None)["tickets"]
    solvent, _ = _split_customers(spark, sf, False)
    spec = {**SPECS["tickets"], "checks": ORDER_CHECKS}
    return check_model(tickets, "tickets", spec, {"solvent": solvent}, RUN)


def check_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return dimension_summary(check_results(spark, sf))


def lineitem_checks(spark: SparkSession, sf: str) -> DataFrame:
    checks = [
        {"type": "range", "name": "quantity_range", "column": "l_quantity", "min": 1, "max": 49},
        {"type": "range", "name": "discount_range", "column": "l_discount", "max": 0.09},
        {"type": "accepted_values", "name": "flags", "column": "l_returnflag", "values": ["A", "N"]},
        {"type": "not_null", "name": "part_present", "column": "l_partkey"},
        {"type": "regex", "name": "status_shape", "column": "l_linestatus", "pattern": "F"},
        {"type": "unique", "name": "order_unique", "column": "l_orderkey"},
        {
            "type": "relationships", "name": "order_exists", "column": "l_orderkey",
            "to": "orders", "field": "o_orderkey",
        },
    ]
    tables = _load(spark, sf, "lineitem", "orders")
    return run_checks(tables["lineitem"], "lineitem", checks, tables, RUN)


def reconcile_clean_customers(spark: SparkSession, sf: str) -> DataFrame:
    clean, _ = _split_customers(spark, sf, False)
    staged = _models(spark, sf, "accounts")["accounts"]
    rows = [
        reconcile_counts(staged, clean, "lost", "accounts", "solvent", run=RUN),
        reconcile_counts(staged, staged, "same", "accounts", "accounts", run=RUN),
        reconcile_counts(clean, staged, "gained", "solvent", "accounts", run=RUN),
        reconcile_counts(clean, staged, "gained_abs", "solvent", "accounts", symmetric=True, run=RUN),
    ]
    return _portable(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))


def reconcile_revenue(spark: SparkSession, sf: str) -> DataFrame:
    models = _models(spark, sf)
    same = reconcile_totals(
        models["account_gaps"], "sum(total_gap)", models["ticket_gaps"], "sum(gap)", "gap_match", "0.0001",
    )
    other = reconcile_totals(
        models["account_gaps"], "cast(count(*) as decimal(38,2))",
        models["tickets"], "cast(count(*) as decimal(38,2))", "row_match", 1,
    )
    return _portable(same).unionByName(_portable(other))


def reconcile_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log after three runs, one of them repeated: all orders, those of one status, and their line items."""
    path = scratch_path(spark, "reconcile_log")
    tables = _load(spark, sf, "orders", "lineitem")
    orders = tables["orders"]
    for run_key, status in (("monday", "O"), ("tuesday", "F"), ("tuesday", "O"), ("wednesday", "P")):
        part = orders.where(F.col("o_orderstatus") == status)
        lines = tables["lineitem"].join(part, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        rows = reconcile_counts(orders, part, f"orders_{status}", "orders", "part", run=RUN).unionByName(
            reconcile_counts(lines, part, f"lines_{status}", "lines", "part", symmetric=True, run=RUN)
        )
        append_log(rows, path, run_key)
    return _portable(read_log(spark, path))


def invalid_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = _table(spark, sf, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    contract = {
        "o_orderkey": {"type": "bigint", "required": True},
        "o_totalprice": {"type": "decimal(7,2)", "required": True},
        "o_orderpriority": {"type": "string", "required": True},
    }
    found = bad_rows(orders, contract)
    return found.select("o_orderkey", F.concat_ws("; ", "_errors").alias("errors"))


# --- domains ------------------------------------------------------------------------------------

DOMAIN_SPEC = {
    "sources": {"c": "customer_region", "o": "orders", "n": "nation"},
    "join": ["c.c_custkey = o.o_custkey", "c.c_nationkey = n.n_nationkey"],
    "broadcast": "n",
    "group_by": ["n.n_name"],
    "columns": {
        "nation": {"from": "n", "source_column": "n_name"},
        "orders": {"expr": "count(*)"},
        "revenue": {"expr": f"sum(cast(o.o_totalprice as {MONEY}))"},
    },
}


def _customer_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers split by the region of their nation, nation key modulo 5 in this schema."""
    rules = {region: f"c_nationkey % 5 = {i}" for i, region in enumerate(REGIONS)}
    return split_by_rule(_table(spark, sf, "customer"), rules)


def domain_split(spark: SparkSession, sf: str) -> DataFrame:
    """Written once, partitioned by domain, and read back."""
    path = scratch_path(spark, "domains")
    write_table(_customer_regions(spark, sf), path, partition_by=["domain"], rebalance=True)
    stored = read_table(spark, path)
    return _portable(
        stored.groupBy("domain").agg(
            F.count(F.lit(1)).alias("customers"), F.sum(F.col("c_acctbal").cast(MONEY)).alias("balance")
        )
    )


def domain_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Domain customers joined with shared orders and nations: one plan for all regions."""
    tables = {"customer_region": _customer_regions(spark, sf), **_load(spark, sf, "orders", "nation")}
    built = build_domain_model("nation_revenue", DOMAIN_SPEC, tables, REGIONS, run=RUN)
    return _portable(built.withColumn("instance", F.col("_lineage.model")))


PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unset": "4-NOT SPECIFIED", "low": "5-LOW"}


def domain_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Each domain with its own source, joined with the table of the same domain."""
    orders = _table(spark, sf, "orders")
    tables = {f"orders_{d}": orders.where(F.col("o_orderpriority") == p) for d, p in PRIORITIES.items()}
    limits = orders.groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("top"))
    tables["limits"] = split_by_rule(limits, {d: f"o_orderpriority = '{p}'" for d, p in PRIORITIES.items()})
    spec = {
        "sources": {"o": "orders_urgent", "m": "limits"},
        "join": "o.o_totalprice > m.top * 0.99",
        "domain_sources": {d: {"o": f"orders_{d}"} for d in PRIORITIES},
        "columns": {"order_id": {"from": "o", "source_column": "o_orderkey"}, "top": {"from": "m"}},
    }
    return _portable(build_domain_model("near_top", spec, tables, list(PRIORITIES), run=RUN))


def domain_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Shared nations kept for every region, also for one without suppliers at all."""
    rules = {region: f"s_nationkey % 5 = {i}" for i, region in enumerate(REGIONS)}
    tables = {"supplier_region": split_by_rule(_table(spark, sf, "supplier"), rules), **_load(spark, sf, "nation")}
    spec = {
        "sources": {"n": "nation", "s": "supplier_region"},
        "join": "n.n_nationkey = s.s_nationkey",
        "join_type": "left",
        "group_by": ["n.n_name"],
        "columns": {
            "nation": {"from": "n", "source_column": "n_name"},
            "suppliers": {"expr": "count(s.s_suppkey)"},
            "balance": {"expr": f"coalesce(sum(cast(s.s_acctbal as {MONEY})), 0)"},
        },
    }
    built = build_domain_model("nation_suppliers", spec, tables, [*REGIONS, "ANTARCTICA"], run=RUN)
    return _portable(built.withColumn("instance", F.col("_lineage.model")))


def domain_full_join(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers of a region side by side; the regions of the two sides come from different keys."""
    rules = {region: f"s_suppkey % 5 = {i}" for i, region in enumerate(REGIONS)}
    tables = {"customer_region": _customer_regions(spark, sf), "supplier_group": split_by_rule(_table(spark, sf, "supplier"), rules)}
    spec = {
        "sources": {"c": "customer_region", "s": "supplier_group"},
        "join": "c.c_custkey = s.s_suppkey",
        "join_type": "full",
        "columns": {
            "customer": {"expr": "coalesce(c.c_name, 'none')"},
            "supplier": {"expr": "coalesce(s.s_name, 'none')"},
        },
    }
    return _portable(build_domain_model("counterparts", spec, tables, REGIONS, run=RUN))


def domain_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """For each order priority, the customers that have no such order."""
    rules = {d: f"o_orderpriority = '{p}'" for d, p in PRIORITIES.items()}
    tables = {"order_priority": split_by_rule(_table(spark, sf, "orders"), rules), **_load(spark, sf, "customer")}
    spec = {
        "sources": {"c": "customer", "o": "order_priority"},
        "join": "c.c_custkey = o.o_custkey",
        "join_type": "left anti",
        "columns": {"customer_id": {"from": "c", "source_column": "c_custkey"}},
    }
    return _portable(build_domain_model("without_orders", spec, tables, list(PRIORITIES), run=RUN))


def domain_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of every region, one of which has no customers."""
    tables = {"customer_region": _customer_regions(spark, sf), **_load(spark, sf, "orders")}
    spec = {
        "sources": {"c": "customer_region", "o": "orders"},
        "join": "c.c_custkey = o.o_custkey",
        "join_type": "left",
        "group_by": [],
        "columns": {
            "rows": {"expr": "count(*)"},
            "orders": {"expr": "count(o.o_orderkey)"},
            "revenue": {"expr": f"coalesce(sum(cast(o.o_totalprice as {MONEY})), 0)"},
        },
    }
    built = build_domain_model("region_totals", spec, tables, [*REGIONS, "ANTARCTICA"], run=RUN)
    return _portable(built.withColumn("instance", F.col("_lineage.model")))


def domain_replicated(spark: SparkSession, sf: str) -> DataFrame:
    """A model over a shared table only: every domain gets all its rows."""
    spec = {"source": "region", "columns": {"r_regionkey": None, "r_name": None}}
    counted = build_domain_model("regions", spec, _load(spark, sf, "region"), ["eu", "us", "apac"], run=RUN)
    return _portable(counted)


def sync_events(spark: SparkSession, sf: str) -> DataFrame:
    """Two incremental runs and a third without new rows; the target holds every event once."""
    events = _table(spark, sf, "events")
    path = scratch_path(spark, "sync")
    early = events.where("ts < timestamp_ntz '2024-01-16 00:00:00'")
    loaded = [
        incremental_sync(source, f"{path}/events", f"{path}/log", "ts", ["event_type"], RUN)
        for source in (early, events, events)
    ]
    stored = read_synced(spark, f"{path}/events", f"{path}/log")
    return _portable(
        stored.groupBy("event_type", "_batch").agg(
            F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast(MONEY)).alias("value")
        )
    ).withColumn("third_run", F.lit(loaded[2]).cast("long"))


# --- sources and sinks --------------------------------------------------------------------------

EVENT_COLUMNS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "props": "string",
}


def _land_events(spark: SparkSession, sf: str, volumes: str) -> None:
    """Events as CSV landing files, one per task of the scan."""
    events = _table(spark, sf, "events").select(*EVENT_COLUMNS)
    full_time = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    events.write.option("header", True).option("timestampNTZFormat", full_time).csv(f"{volumes}/landing")


def _ingest_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            (1, "volume", "event_feed", "raw_events", "landing", r"^part-.*\.csv$", "csv", True, ",", True),
            (2, "volume", "unused_feed", "raw_unused", "landing", ".*", "csv", True, ",", False),
            (3, "api", "api_feed", "raw_api", "landing", ".*", "csv", True, ",", True),
        ],
        "config_id int, ingest_type string, source_name string, target_model string, volume_name string, "
        "file_regex string, file_format string, has_header boolean, delimiter string, active boolean",
    )


def _ingested(spark: SparkSession, sf: str) -> tuple[str, dict[int, int]]:
    path = scratch_path(spark, "ingest")
    _land_events(spark, sf, f"{path}/volumes")
    config = _ingest_config(spark)
    contracts = {"raw_events": EVENT_COLUMNS}
    ingest_all(spark, config, f"{path}/volumes", f"{path}/tables", contracts, domain="eu", run=RUN)
    again = ingest_all(spark, config, f"{path}/volumes", f"{path}/tables", contracts, domain="eu", run=RUN)
    return f"{path}/tables", again


def ingest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest totals after two runs; the second one finds nothing new."""
    tables, again = _ingested(spark, sf)
    manifest = read_table(spark, f"{tables}/file_manifest")
    return manifest.groupBy("model_name", "domain", "file_format", "status").agg(
        F.sum("row_count").alias("row_count"),
        (F.countDistinct("file_path") - F.count(F.lit(1))).alias("repeated_files"),
        F.lit(sum(again.values())).cast("long").alias("second_run_files"),
    )


def ingest_rows(spark: SparkSession, sf: str) -> DataFrame:
    tables, _ = _ingested(spark, sf)
    return read_ingested(spark, tables, "raw_events").select(
        *EVENT_COLUMNS,
        F.col("_lineage.schema_version").alias("schema_version"),
        F.col("_lineage.model").alias("model"),
        F.col("_lineage.source_type").alias("source_type"),
    )


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The same feed as a file stream that runs until all files are loaded, twice."""
    path = scratch_path(spark, "stream")
    _land_events(spark, sf, f"{path}/volumes")
    feed = Feed(1, "raw_events", "landing", r"^part-.*\.csv$")
    for _ in range(2):
        stream_feed(
            spark, feed, f"{path}/volumes", f"{path}/tables", EVENT_COLUMNS, f"{path}/progress", run=RUN
        ).awaitTermination()
    rows = read_ingested(spark, f"{path}/tables", "raw_events")
    manifest = read_table(spark, f"{path}/tables/file_manifest")
    loaded = rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast(MONEY)).alias("value")
    )
    manifested = manifest.agg(F.sum("row_count").alias("events")).select(
        F.lit("manifest").alias("event_type"), "events", F.lit(0).cast("decimal(28,2)").alias("value")
    )
    return _portable(loaded.unionByName(manifested))


def ingest_batch_then_stream(spark: SparkSession, sf: str) -> DataFrame:
    """One feed loaded by a run, by streams of two checkpoints in turn and by a run again, as files arrive."""
    path = scratch_path(spark, "mixed")
    events = _table(spark, sf, "events").select(*EVENT_COLUMNS)
    feed = Feed(1, "raw_events", "landing", r"^part-.*\.csv$")
    for part, loader in enumerate(("run", "first", "second", "first", "run")):
        rows = events.where(F.pmod("event_id", F.lit(5)) == part)
        rows = rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        rows.write.mode("append").option("header", True).csv(f"{path}/volumes/landing")
        if loader == "run":
            ingest_feed(spark, feed, f"{path}/volumes", f"{path}/tables", EVENT_COLUMNS, run=RUN)
        else:
            stream_feed(
                spark, feed, f"{path}/volumes", f"{path}/tables", EVENT_COLUMNS, f"{path}/{loader}", run=RUN
            ).awaitTermination()
    stored = read_ingested(spark, f"{path}/tables", "raw_events")
    kind = F.when(F.col("_batch").startswith("run-"), "run").otherwise("stream")
    return _portable(
        stored.groupBy("event_type", kind.alias("loader")).agg(
            F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast(MONEY)).alias("value")
        )
    )


def ingest_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Orders landed as CSV, some with prices too large for the contract or without a priority, in one batch and
    in a stream: good rows and what is wrong with the others."""
    path = scratch_path(spark, "rejects")
    orders = _table(spark, sf, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    contract = {
        "o_orderkey": {"type": "bigint", "required": True},
        "o_totalprice": {"type": "decimal(7,2)", "required": True},
        "o_orderpriority": {"type": "string", "required": True},
    }
    orders.select(*contract).write.option("header", True).csv(f"{path}/volumes/landing")
    names = {"batch": f"{path}/batch", "stream": f"{path}/stream"}
    feed = Feed(1, "raw_orders", "landing", r"^part-.*\.csv$")
    ingest_feed(spark, feed, f"{path}/volumes", names["batch"], contract, run=RUN)
    stream_feed(spark, feed, f"{path}/volumes", names["stream"], contract, f"{path}/progress", run=RUN).awaitTermination()
    counts = []
    for name, tables in names.items():
        good = read_ingested(spark, tables, "raw_orders").select(F.col("o_orderkey").alias("key"), F.lit("good").alias("problem"))
        bad = read_rejected(spark, tables, "raw_orders").select(
            F.get_json_object("_raw", "$.o_orderkey").cast("long").alias("key"), F.explode("_errors").alias("problem")
        )
        every = good.unionByName(bad).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"), F.sum("key").alias("keys"))
        counts.append(every.withColumn("form", F.lit(name)))
    return counts[0].unionByName(counts[1])


def ingest_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Customers landed as one file for each group of nations, with checksums of contents in ranges of 64 KB."""
    path = scratch_path(spark, "checksums")
    customers = _table(spark, sf, "customer").select("c_custkey", "c_name", (F.col("c_nationkey") % 5).cast("int").alias("part"))
    lines = customers.repartitionById(5, "part").sortWithinPartitions("c_custkey")
    lines.select("c_custkey", "c_name").write.option("header", True).csv(f"{path}/volumes/landing")
    contract = {"c_custkey": {"type": "bigint", "required": True}, "c_name": "string"}
    feed = Feed(1, "raw_customers", "landing", r"^part-.*\.csv$")
    ingest_feed(spark, feed, f"{path}/volumes", f"{path}/tables", contract, run=RUN, checksum="content", range_bytes=1 << 16)
    manifest = read_table(spark, f"{path}/tables/file_manifest")
    return manifest.select("checksum", "row_count", "file_size_bytes", "rejected_count")


def seed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as headered CSV, read with declared columns."""
    path = scratch_path(spark, "seed")
    _table(spark, sf, "supplier").write.option("header", True).csv(path)
    columns = {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": MONEY}
    return _portable(read_seed(spark, path, columns))


def landing_formats(spark: SparkSession, sf: str) -> DataFrame:
    """The same labels read back from each landing format."""
    path = scratch_path(spark, "formats")
    labels = _table(spark, sf, "labels")
    columns = {"doc_id": "bigint", "quality": "int", "toxic": "int"}
    counts = None
    for file_format in ("csv", "json", "parquet"):
        labels.write.format(file_format).save(f"{path}/{file_format}")
        rows = read_files(spark, f"{path}/{file_format}", file_format, columns)
        one = rows.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_id").alias("ids"))
        one = one.withColumn("file_format", F.lit(file_format))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def sql_source(spark: SparkSession, sf: str) -> DataFrame:
    return run_sql(
        spark,
        "SELECT o_orderstatus, count(*) AS orders FROM {orders} WHERE o_totalprice > {least} "
        "GROUP BY o_orderstatus",
        orders=_table(spark, sf, "orders"),
        least=250000.0,
    )


def _database(spark: SparkSession) -> str:
    name = f"terrace_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'db')}'")
    return name


def prior_version(spark: SparkSession, sf: str) -> DataFrame:
    """A table replaced by a plan that reads it; the version before stays readable."""
    table = f"{_database(spark)}.customers"
    replace_table(_table(spark, sf, "customer"), table)
    replace_table(spark.table(table).where("c_acctbal >= 0"), table)
    sides = spark.table(table).withColumn("side", F.lit("current")).unionByName(
        read_previous(spark, table).withColumn("side", F.lit("previous"))
    )
    return _portable(
        sides.groupBy("side").agg(
            F.count(F.lit(1)).alias("customers"), F.sum(F.col("c_acctbal").cast(MONEY)).alias("balance")
        )
    )


def stored_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model stored as a table with its quarantine beside it, twice; the second time on fewer rows."""
    staged = _models(spark, sf, "accounts")["accounts"]
    spec = SPECS["solvent"]
    name = f"{_database(spark)}.solvent"
    for rows in (staged, staged.where("nation_id < 20")):
        materialise(build_model("solvent", spec, {"accounts": rows}, RUN), name, spec, RUN)
    sides = {
        "model": spark.table(name),
        "previous": read_previous(spark, name),
        "quarantine": spark.table(quarantine_name(name)),
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("customers"), F.sum("balance").alias("balance")).withColumn(
            "side", F.lit(side)
        )
        for side, df in sides.items()
    ]
    return _portable(counts[0].unionByName(counts[1]).unionByName(counts[2]))


def migrated_table(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table whose rows carry an old lineage struct, rewritten once and only once."""
    table = f"{_database(spark)}.orders"
    old = F.struct(F.lit("3").alias("schema_version"), F.lit("old_orders").alias("model"))
    orders = _table(spark, sf, "orders")
    replace_table(orders.select("o_orderkey", "o_orderstatus", old.alias("_lineage")), table)
    rewritten = [migrate_lineage(spark, table) for _ in range(2)]
    return spark.table(table).groupBy(
        "o_orderstatus",
        F.col("_lineage.schema_version").alias("schema_version"),
        F.col("_lineage.compute_type").alias("compute_type"),
    ).agg(F.count(F.lit(1)).alias("orders"), F.lit(sum(rewritten)).cast("long").alias("rewrites"))


def evolve_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Stored orders: a change that would lose values is refused and counted, one that loses none is published."""
    table = f"{_database(spark)}.orders"
    replace_table(_table(spark, sf, "orders"), table)
    try:
        ev.evolve_stored(spark, table, [{"change_type": {"o_totalprice": {"to": "decimal(7,2)"}, "o_orderpriority": {"to": "int"}}}])
        refused = {}
    except ev.LostValues as error:
        refused = error.counts
    kept = spark.table(table).columns
    ev.evolve_stored(spark, table, CHANGES)
    current = spark.table(table).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("o_totalprice").alias("total"),
        F.count_if(F.col("size_class") == "gold").alias("gold"),
        F.concat_ws(",", F.lit(list(spark.table(table).columns))).alias("columns"),
    )
    previous = read_previous(spark, table).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("o_totalprice").cast(MONEY)).alias("total"),
        F.lit(0).cast("long").alias("gold"),
        F.concat_ws(",", F.lit(kept)).alias("columns"),
    )
    both = current.withColumn("side", F.lit("current")).unionByName(previous.withColumn("side", F.lit("previous")))
    losses = {n: F.lit(refused.get(c, 0)).cast("long") for n, c in (("lost_totals", "o_totalprice"), ("lost_priorities", "o_orderpriority"))}
    return _portable(both.withColumns(losses))


def view_models(spark: SparkSession, sf: str) -> DataFrame:
    """A model kept as a view, and one kept as a table that reads it; bad balances become NULL."""
    spec = {
        "source": "customer",
        "materialized": "view",
        "columns": {
            "customer_id": {"source_column": "c_custkey"},
            "nation_id": {"source_column": "c_nationkey"},
            "small_balance": {"source_column": "c_acctbal", "type": "decimal(5,2)", "cast": True, "on_bad": "null"},
        },
    }
    name = f"small_balances_{uuid.uuid4().hex}"
    built = build_model("small_balances", spec, {"customer": _table(spark, sf, "customer")}, RUN, lineage_mode=None)
    materialise(built, name, spec, RUN)
    return _portable(
        spark.table(name).groupBy("nation_id").agg(
            F.count(F.lit(1)).alias("customers"), F.count("small_balance").alias("small"), F.sum("small_balance").alias("balance")
        )
    )


def managed_appends(spark: SparkSession, sf: str) -> DataFrame:
    """An empty typed table, created twice without losing rows, filled by appends."""
    columns = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}
    table = f"{_database(spark)}.nations"
    nation = _table(spark, sf, "nation")
    create_managed_table(spark, table, columns)
    write_table(nation, table, mode="append")
    create_managed_table(spark, table, columns)
    write_table(nation, table, mode="append")
    return spark.table(table)


def lineage_appends(spark: SparkSession, sf: str) -> DataFrame:
    """Two validated appends to a raw table, counted by the source each row names."""
    path = scratch_path(spark, "raw")
    columns = {"doc_id": {"type": "bigint", "required": True}, "quality": "int", "toxic": "int"}
    labels = _table(spark, sf, "labels")
    for quality in (0, 1):
        part = labels.where(F.col("quality") == quality)
        append_with_lineage(part, path, "raw_labels", f"/landing/{quality}", "api", columns=columns, run=RUN)
    return read_table(spark, path).groupBy(
        F.col("_lineage.source_path").alias("source_path"), F.col("_lineage.source_type").alias("source_type")
    ).agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_id").alias("ids"))


# --- archive ------------------------------------------------------------------------------------


def archive_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Events through JSON and back, microseconds included."""
    path = scratch_path(spark, "archive")
    deployment = ar.Deployment("shop", "dev", "ann", "sha1", "main", "job", datetime(2024, 2, 1))
    ar.archive_table(_table(spark, sf, "events"), path, "events", deployment)
    return ar.restore_table(spark, path, "events")


def restore_into_table(spark: SparkSession, sf: str) -> DataFrame:
    """An older archive of events becomes the next version of their table; the version before stays."""
    path, table = scratch_path(spark, "archive"), f"{_database(spark)}.events"
    events = _table(spark, sf, "events")
    for day, rows in ((1, events), (2, events.where("event_type = 'click'"))):
        ar.archive_table(rows, path, "events", ar.Deployment("shop", "dev", "ann", "sha", "main", "job", datetime(2024, 2, day)))
    replace_table(events.where("event_type <> 'click'"), table)
    restored = ar.restore_into(spark, path, "events", table, archived_at=datetime(2024, 2, 1))
    sides = spark.table(table).withColumn("side", F.lit("restored")).unionByName(
        read_previous(spark, table).withColumn("side", F.lit("previous"))
    )
    return _portable(
        sides.groupBy("side", "event_type").agg(
            F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast(MONEY)).alias("value"), F.max("ts").alias("last_event")
        )
    ).withColumn("restored_rows", F.lit(restored).cast("long"))


def archive_of_one(spark: SparkSession, sf: str) -> DataFrame:
    """The archives of one table among others, newest first."""
    path = scratch_path(spark, "archive")
    for day, name in enumerate(("nation", "orders", "supplier", "orders"), start=1):
        rows = _table(spark, sf, name)
        rows = rows.where("o_orderstatus = 'F'") if day == 4 else rows
        ar.archive_table(rows, path, name, ar.Deployment("shop", "dev", "ann", "sha", "main", "job", datetime(2024, 2, day)))
    listed = ar.list_archive(ar.read_headers(spark, path), "orders")
    return _portable(listed.select("asset_name", "archived_at", "performed_by", "row_count"))


def archive_listing(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    tables = _load(spark, sf, "nation", "supplier", "events")
    for hour, (name, df) in enumerate(tables.items()):
        deployment = ar.Deployment("shop", "dev", "ann", "sha1", "main", "job", datetime(2024, 2, 1, hour))
        ar.archive_table(df, path, name, deployment)
    ar.archive_definition(
        spark, path, "functions/loyalty_tier.sql", "function", "it's text",
        ar.Deployment("shop", "dev", "ann", "sha1", "main", "job", datetime(2024, 2, 1, 9)),
    )
    return _portable(ar.list_archive(ar.read_headers(spark, path)))


def _event_headers(spark: SparkSession, sf: str, asset: str) -> DataFrame:
    """Archive headers made from events: one archived asset per event."""
    return _table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("archive_id"),
        F.expr(asset).alias("asset_name"),
        F.lit("table").alias("asset_type"),
        F.lit("shop").alias("project"),
        F.lit("dev").alias("environment"),
        F.col("ts").cast("timestamp").alias("archived_at"),
        F.concat(F.lit("team"), F.col("user_id") % 3).alias("performed_by"),
        F.date_format("ts", "yyyyMMdd").alias("git_sha"),
        F.col("event_type").alias("git_branch"),
        F.lit("job").alias("dab_name"),
        F.expr("nullif(cast(floor(value) as bigint), 0)").alias("row_count"),
    )


def archive_diff(spark: SparkSession, sf: str) -> DataFrame:
    headers = _event_headers(spark, sf, "concat('user_', user_id)")
    return _portable(ar.diff_backup_history(headers, "20240110", "purchase"))


def archive_functions_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the SQL table function."""
    ar.register_table_functions(_event_headers(spark, sf, "concat('user_', user_id)"), "user_headers")
    return _portable(spark.sql("SELECT * FROM diff_backup_history('20240110', 'purchase')"))


def archive_functions_history(spark: SparkSession, sf: str) -> DataFrame:
    ar.register_table_functions(_event_headers(spark, sf, "concat('tbl_', user_id % 7)"), "table_headers")
    return _portable(spark.sql("SELECT * FROM fetch_last_deployments(25)"))


def latest_archives(spark: SparkSession, sf: str) -> DataFrame:
    headers = _event_headers(spark, sf, "concat('user_', user_id)")
    latest = ar.latest_per_asset(headers)
    return _portable(latest.select("asset_name", "archived_at", "archive_id", "git_branch", "row_count"))


def deploy_history(spark: SparkSession, sf: str) -> DataFrame:
    headers = _event_headers(spark, sf, "concat('tbl_', user_id % 7)")
    return _portable(ar.fetch_last_deployments(headers, 25))


# --- comparison and evolution -------------------------------------------------------------------


def _perturbed(orders: DataFrame) -> DataFrame:
    """Some orders gone, some new, some with another price or status."""
    kept = orders.where("o_orderkey % 50 <> 7").select(
        "o_orderkey",
        "o_custkey",
        F.expr("CASE WHEN o_orderkey % 100 = 3 THEN 'X' ELSE o_orderstatus END").alias("o_orderstatus"),
        F.expr("CASE WHEN o_orderkey % 60 = 3 THEN o_totalprice + 1 ELSE o_totalprice END").alias("o_totalprice"),
        "o_orderdate",
        F.expr("CASE WHEN o_orderkey % 70 = 9 THEN NULL ELSE o_orderpriority END").alias("o_orderpriority"),
    )
    added = orders.where("o_orderkey % 40 = 1").withColumn("o_orderkey", -F.col("o_orderkey"))
    return kept.unionByName(added)


def order_diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = _table(spark, sf, "orders")
    diff = snapshot_diff(orders, _perturbed(orders), ["o_orderkey"])
    return diff.select("o_orderkey", "status", F.concat_ws(",", "changed_columns").alias("changed_columns"))


def order_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    orders = _table(spark, sf, "orders")
    return diff_summary(snapshot_diff(orders, _perturbed(orders), ["o_orderkey"]))


CHANGES = [
    {
        "add_columns": {
            "size_class": {"expr": "case when o_totalprice > 300000 then 'gold' else 'it''s bronze' end"},
            "note": {"type": "string"},
        },
        "remove_columns": ["o_orderpriority", "not_there"],
        "rename_columns": {"o_custkey": "customer_id"},
        "change_type": {"o_totalprice": {"from": "double", "to": "decimal(18,2)", "cast": True}},
    },
    {"rename_columns": {"o_orderkey": "order_id"}, "change_type": {"customer_id": {"to": "string"}}},
]


def evolve_orders(spark: SparkSession, sf: str) -> DataFrame:
    evolved = ev.evolve(_table(spark, sf, "orders"), CHANGES)
    return _portable(evolved).withColumn("note", F.coalesce("note", F.lit("none")))


def evolve_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What the changes would do to the orders, and to how many rows, before anything is written."""
    orders = _table(spark, sf, "orders")
    lines = spark.createDataFrame([(line,) for line in ev.describe(orders, CHANGES)], "change string")
    return lines.withColumn("rows", F.lit(orders.count()).cast("long"))


def retype_losses(spark: SparkSession, sf: str) -> DataFrame:
    change = {
        "change_type": {
            "o_totalprice": {"to": "decimal(7,2)"},
            "o_custkey": {"to": "tinyint"},
            "o_orderpriority": {"to": "int"},
        }
    }
    return ev.retype_losses(_table(spark, sf, "orders"), change)
