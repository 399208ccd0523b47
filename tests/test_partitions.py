"""Results don't depend on how the data are cut into partitions."""

import os

import pytest

from sheaf.plans.core import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", ["registry_reconcile", "registry_first_seen", "insert_absent", "align_exact_scores", "fusion_verdict", "first_runs", "bootstrap_ci", "p5_found"])
def test_same_at_any_number(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(repr, QUERIES[name](spark, FOLDER).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and got[0]
