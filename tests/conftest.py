import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    # A handful of rows: compiling the plan costs far more than running it. The
    # registered queries are tested with compiled plans.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Text (or a list of lines) to LINES rows of one source."""

    def make(text, source="/var/log/app.log"):
        rows = text.split("\n") if isinstance(text, str) else text
        return spark.createDataFrame(
            [(source, i, line) for i, line in enumerate(rows, start=1)], "source string, line_no bigint, line string"
        )

    return make


@pytest.fixture
def one(spark):
    """Value of a column expression over a single row of literals."""

    def evaluate(expression):
        return spark.range(1).select(expression.alias("v")).first()["v"]

    return evaluate
