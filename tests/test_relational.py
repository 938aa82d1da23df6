"""Relational forms against brute force, and the plans of those whose cost depends on them."""

import os
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from marlstone import catalog
from marlstone.operators import relational as R

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("every", [False, True])
def test_levels_of_values(spark, every):
    rows = [(f, s, v) for i in range(60) for f, s, v in [("ab"[i % 2] if i % 7 else None, "xyz"[i % 3], i * i % 11 if i % 5 else None)]]
    df = spark.createDataFrame(rows, "f string, s string, v int")
    got = R.levels_of_values(df, ["f", "s"], "v", [F.sum("n").alias("n"), F.count("v").alias("values"), R.distinct_about(F.col("v")).alias("about")], every)
    want = {}
    for k in range(3):
        for kept in combinations((0, 1), k) if every else [tuple(range(k))]:
            level = sum(2 - i for i in (0, 1) if i not in kept)
            for r in rows:
                want.setdefault((*(r[i] if i in kept else None for i in (0, 1)), level), []).append(r[2])
    assert {(r["f"], r["s"], r["level"]): (r["n"], r["values"], r["about"]) for r in got.collect()} == {k: (len(v), *[len(set(v) - {None})] * 2) for k, v in want.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_group_levels_keeps_no_sketch_for_each_value(spark):
    plan = catalog.QUERIES["group_levels"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    keys = [re.search(r"keys=\[([^\]]*)\]", line)[1] for line in plan.splitlines() if "approx_count_distinct" in line and "keys=" in line]
    assert keys and not any("l_partkey" in k for k in keys)
