"""The jobs' registered queries beside their SQL, on the smallest tables."""

import os

import parity
import pytest

from jobs.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, name):
    before = dict(spark.sparkContext.getConf().getAll()), {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.execution.arrow.maxBytesPerBatch")}
    assert parity.compare(spark, parity.connect(SF), name, QUERIES[name], ORACLES[name], SF) == ""
    assert before[1] == {k: spark.conf.get(k, None) for k in before[1]}
