import os

import oracle
import pytest
from pointloom.llm import multi_index, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    oracle.compare(spark, oracle.connect(), queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_line_crf", "op2_html_text", "op3_packing", "op4_knn_quality", "op8_langid"])
def test_runs(spark, name):
    assert queries.queries()[name](spark, oracle.DATA).count() > 0


def test_recall_on_a_larger_table(spark):
    """The index at work (below its least number of candidates it is exact)."""
    import numpy as np

    path = oracle.DATA.replace("sf0.001", "sf0.1")
    if not os.path.isdir(path):
        pytest.skip("the larger tables are absent")
    vectors = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    x = np.stack(vectors.embedding).astype(float)
    ids = vectors.vec_id.to_numpy()
    got = multi_index.search(spark.read.parquet(f"{path}/embeddings.parquet")).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-s, kind="stable")[:20]])) / 20)
    assert np.mean(hits) >= 0.9
