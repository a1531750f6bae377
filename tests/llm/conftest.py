import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark):
    import helpers

    return helpers.odd_columns(spark.createDataFrame(helpers.corpus(), helpers.DOCS).repartition(5)).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    import helpers

    return spark.createDataFrame([], helpers.DOCS)
