from __future__ import annotations

import pytest

from plumbline.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    rows = [
        (0, "Alice", 25.0, "50000", "2021-01-01"),
        (1, "Bob", 300.0, "60000", "2021-06-15"),
        (2, None, 22.0, "55000", None),
        (3, "Dave", None, "70000", "2022-03-01"),
        (4, "Alice", 25.0, "50000", "2021-01-01"),
    ]
    return spark.createDataFrame(
        rows, "row_id bigint, Name string, Age double, Salary string, `Join Date` string"
    )


def column(df, name, order="row_id"):
    """The values of a column in row order."""
    return [r[name] for r in df.orderBy(order).collect()]


def same_rows(a, b):
    """Equal as bags of rows; for small tables."""
    names = sorted(a.columns)
    if names != sorted(b.columns):
        return False
    left, right = (sorted(map(str, df.select(*names).collect())) for df in (a, b))
    return left == right
