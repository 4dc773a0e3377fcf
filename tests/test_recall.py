"""Recall of the registered approximate searches on the given embeddings."""

import os

import pytest

from loomstone.operators import vector
from loomstone.plans import vector_queries as q
from loomstone.plans.tables import vectors

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no given tables")
@pytest.mark.parametrize("name", ["vector_ivf", "vector_product_codes", "vector_rotated_codes"])
def test_registered_recall(spark, name):
    v = vectors(spark, DATA)
    exact = {(r["qid"], r["id"]) for r in vector.batch_topk(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 10).collect()}
    got = {(r["qid"], r["id"]) for r in q.QUERIES[name][0](spark, DATA).collect()}
    print(name, len(exact & got) / len(exact))
    assert len(exact & got) >= 0.9 * len(exact)
