import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from conftest_llm import CLASHING, ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return rows.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
