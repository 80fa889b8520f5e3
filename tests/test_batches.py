"""Searches by batches of any size."""

import numpy as np
import pytest

from loomquery.operators import retrieval
from loomquery.plans import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("block", [7, 4096])
def test_cosine_blocks_equal_brute_force(spark, block):
    x = np.random.default_rng(5).normal(size=(60, 4))
    x[10:20] = x[9]  # ties
    x[30] = 0
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(99, None)], "vec_id long, embedding array<double>")
    queries = frame.filter("vec_id < 25").selectExpr("vec_id AS query_id", "embedding AS q")
    got = {}
    for r in retrieval.cosine_top_k(frame, queries, 5, block=block).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    unit = np.delete(x, 30, 0)
    ids = np.delete(np.arange(60), 30)
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    for i in range(25):
        score = np.round(unit @ unit[list(ids).index(i)], 9)
        assert [got[i][n] for n in range(1, 6)] == ids[np.lexsort((ids, -score))[:5]].tolist()


def test_every_hundredth_vector_is_asked(spark):
    found = catalog.QUERIES["vector_topk_cosine_batch"](spark, DATA)
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    assert found.select("query_id").distinct().count() == rows > 3 and found.count() == 10 * rows
