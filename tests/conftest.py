import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import build_session

    work = tmp_path_factory.mktemp("work")
    session = build_session(
        "quern-tests", "local[8]",
        spark__sql__shuffle__partitions=8, spark__driver__memory="8g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=str(work / "shared"),
        spark__sql__warehouse__dir=str(work / "warehouse"), spark__sql__maxMetadataStringLength=2000,
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


@pytest.fixture
def plan():
    return plan_of
