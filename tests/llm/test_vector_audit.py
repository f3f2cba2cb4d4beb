"""The audit that decides whether vectors are searched again."""

import numpy as np
import pytest

from gleaner.llm import vector_dedup


@pytest.mark.parametrize("step", [100, 7])
def test_a_large_group_does_not_hide_lost_links_of_ordinary_vectors(spark, step):
    # 60 nearly equal vectors and 20 pairs; ids are all divisible by 100, or mostly not.
    x = np.eye(32)[[0] * 60 + [k for i in range(20) for k in (i + 1, i + 1)]]
    x[:, 31] = np.linspace(0.01, 0.1, len(x))
    ids = [step * (i + 1) + (step == 7 and (i + 1) * step % 100 == 0) for i in range(len(x))]
    classes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "node long, vec array<double>, n long")
    whole = [59] * 60 + [1] * 40
    lost = whole[:80] + [0] * 20

    def audit(counts):
        return vector_dedup.audit(classes, spark.createDataFrame(list(zip(ids, counts)), "a long, links long"), 0.9)

    assert audit(whole) == 1.0
    assert sum(lost) / sum(whole) > 0.99 and audit(lost) < 0.7
    assert audit([c + 1 for c in whole]) < 0.99
