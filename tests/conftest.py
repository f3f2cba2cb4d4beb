import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleaner.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors(spark):
    """(n, d, seed) -> ids, matrix, DataFrame of random vectors over several partitions."""

    def make(n, d=5, seed=0, ids=None, copies=0, partitions=4):
        x = np.random.default_rng(seed).normal(size=(n, d))
        if copies:
            x[:copies] = x[0]
        names = list(range(n)) if ids is None else ids
        kind = "bigint" if isinstance(names[0], int) else "string"
        rows = [(i, v.tolist()) for i, v in zip(names, x)]
        df = spark.createDataFrame(rows, f"item_id {kind}, vec array<double>").repartition(partitions)
        return names, x, df

    return make
