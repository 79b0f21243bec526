import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from broadsheet.schemas import ARTICLE, EXCLUSION  # noqa: E402
from broadsheet.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def articles(spark):
    """Build an article frame from dicts; absent fields are null, the flag false."""

    def build(*rows):
        full = [
            tuple(row.get(f.name, False if f.name == "manual_review" else None) for f in ARTICLE)
            for row in rows
        ]
        return spark.createDataFrame(full, ARTICLE)

    return build


@pytest.fixture(scope="session")
def exclusions(spark):
    def build(*urls):
        return spark.createDataFrame([(u, "", "") for u in urls], EXCLUSION)

    return build


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples of the named columns."""

    def take(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)

    return take


@pytest.fixture(scope="session")
def plan():
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text
