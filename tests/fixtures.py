"""A market garden: beds and what was picked from them, with results worked out by hand."""

from datetime import date
from decimal import Decimal

BED_COLUMNS = {
    "bed_id": {"type": "int", "required": True, "unique": True},
    "crop": "string",
    "glass": "boolean",
    "keeper": "string",
    "sown": "date",
    "area": "decimal(6,2)",
    "ph": "decimal(4,2)",
}
HARVEST_COLUMNS = {
    "harvest_id": {"type": "int", "required": True, "unique": True},
    "bed_id": {"type": "int", "required": True},
    "picked": "date",
    "crates": "int",
    "kilos": "decimal(8,3)",
    "price_per_kilo": "decimal(6,2)",
}

# bed 2 has no keeper, the soil of bed 3 is too sour, and nothing was picked from bed 5
BEDS_CSV = """bed_id,crop,glass,keeper,sown,area,ph
1,tomato,true,Nora,2025-02-03,12.50,6.40
2,leek,false,,2025-03-11,30.00,6.90
3,kale,false,Otto,2025-03-28,18.25,5.10
4,tomato,true,Nora,2025-02-20,9.75,6.10
5,chard,false,Ines,2025-04-02,14.00,7.20
6,leek,false,Otto,2025-03-15,22.40,6.60
"""
# the last one names a bed that is not there
HARVESTS_CSV = """harvest_id,bed_id,picked,crates,kilos,price_per_kilo
501,1,2025-06-14,3,21.500,3.20
502,1,2025-06-21,4,26.250,3.10
503,3,2025-06-30,6,11.000,2.75
504,4,2025-07-02,2,9.800,3.20
505,4,2025-07-09,5,33.400,2.90
506,6,2025-09-18,8,52.000,1.85
507,6,2025-09-25,9,61.500,1.80
508,2,2025-09-20,1,4.200,1.90
509,9,2025-07-01,1,2.000,5.00
"""

SPECS = {
    "beds": {
        "source": "raw_beds",
        "columns": {
            "bed_id": None,
            "crop": None,
            "keeper": None,
            "sown": {"type": "date", "cast": True},
            "area": {"type": "decimal(6,2)", "cast": True},
            "ph": {"type": "decimal(4,2)", "cast": True},
        },
    },
    "pickings": {
        "source": "raw_harvests",
        "columns": {
            "harvest_id": None,
            "bed_id": None,
            "kilos": {"type": "decimal(8,3)", "cast": True},
            "proceeds": {"expr": "kilos * price_per_kilo"},
            "kilos_per_crate": {"expr": "round(kilos / crates, 3)"},
            "picked": {"type": "date", "cast": True},
        },
    },
    "tended": {
        "source": "beds",
        "materialized": "table",
        "version": "v2",
        "quarantine": "keeper IS NULL OR ph < 5.5",
        "columns": {"bed_id": None, "crop": None, "keeper": None, "area": None, "ph": None},
    },
    "bed_yield": {
        "sources": {"b": "tended", "p": "pickings"},
        "join": "b.bed_id = p.bed_id",
        "join_type": "left",
        "broadcast": "p",
        "group_by": ["b.bed_id", "b.crop"],
        "columns": {
            "bed_id": {"from": "b"},
            "crop": {"from": "b"},
            "times": {"expr": "count(p.harvest_id)"},
            "earned": {"expr": "sum(p.proceeds)"},
            "best": {"expr": "max(p.kilos)"},
            "last_picked": {"expr": "max(p.picked)"},
            "grade": {"udf": "loyalty_tier(earned * 5)"},
        },
    },
    "crop_yield": {
        "source": "bed_yield",
        "group_by": ["crop"],
        "columns": {"crop": None, "beds": {"expr": "count(*)"}, "total": {"expr": "coalesce(sum(earned), 0)"}},
    },
}

# bed_id: times, earned, best, last_picked, grade
YIELD = {
    1: (2, Decimal("150.175"), Decimal("26.25"), date(2025, 6, 21), "SILVER"),
    2: (1, Decimal("7.98"), Decimal("4.2"), date(2025, 9, 20), "BRONZE"),
    3: (1, Decimal("30.25"), Decimal("11"), date(2025, 6, 30), "BRONZE"),
    4: (2, Decimal("128.22"), Decimal("33.4"), date(2025, 7, 9), "SILVER"),
    5: (0, None, None, None, "BRONZE"),
    6: (2, Decimal("206.9"), Decimal("61.5"), date(2025, 9, 25), "GOLD"),
}
# crop: beds, total
CROPS = {"tomato": (2, Decimal("278.395")), "leek": (2, Decimal("214.88")), "kale": (1, Decimal("30.25")), "chard": (1, Decimal("0"))}
