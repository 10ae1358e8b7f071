import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

_ADAPTIVE = False


def pytest_addoption(parser):
    parser.addoption("--adaptive", action="store_true", help="run with adaptive execution, as clusters do by default")


def pytest_configure(config):
    global _ADAPTIVE
    _ADAPTIVE = config.getoption("--adaptive", False)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        # tiny tables: compiling plans and re-planning cost far more than running them
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN").config("spark.sql.adaptive.enabled", str(_ADAPTIVE).lower()).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _made(name):
    @pytest.fixture(scope="session", name=name)
    def make(spark):
        from tests import brute

        return getattr(brute, name)(spark)

    return make


weave, lone, ragged, bushy = map(_made, ("weave", "lone", "ragged", "bushy"))
