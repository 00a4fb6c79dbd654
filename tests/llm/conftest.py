import pytest

from tests.llm.cases import CLASHES, COLUMNS, ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in ROWS], COLUMNS + "".join(f", `{c}` string" for c in CLASHES))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
