import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terrace.session import configure  # noqa: E402


def make_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrace-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="terrace-warehouse-"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture(scope="session")
def seeds(spark, tmp_path_factory):
    """The two seed tables, read through the seed scan."""
    from fixtures import BED_COLUMNS, BEDS_CSV, HARVEST_COLUMNS, HARVESTS_CSV

    from terrace.sources.tables import read_seed

    folder = tmp_path_factory.mktemp("seeds")
    (folder / "beds.csv").write_text(BEDS_CSV)
    (folder / "harvests.csv").write_text(HARVESTS_CSV)
    return {
        "raw_beds": read_seed(spark, str(folder / "beds.csv"), BED_COLUMNS),
        "raw_harvests": read_seed(spark, str(folder / "harvests.csv"), HARVEST_COLUMNS),
    }


@pytest.fixture(scope="session")
def models(spark, seeds):
    from fixtures import SPECS

    from terrace.functions.udfs import STANDARD_UDFS, register_udfs
    from terrace.plans.model import build_models

    languages = register_udfs(spark, STANDARD_UDFS)
    return build_models(SPECS, seeds, udf_languages=languages)
