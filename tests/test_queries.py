"""Every registered query next to its oracle, and what its plan must not hold."""

import glob
import os
import re

import duckdb
import pytest

from __spark_entry__ import entry
from workload import oracles, queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracles()
FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups")

# Queries whose last plan reads text or filters runs of characters in Arrow batches.
ARROW = {"j04_lexicon_through_a_filter", "s01_json_array_in_splits"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == canonical(result.fetchall(), columns)
    found = FORBIDDEN.findall(df._jdf.queryExecution().executedPlan().toString())
    assert not [f for f in found if name not in ARROW or not f.endswith("InPandas")]


@pytest.fixture(scope="module")
def postings(spark):
    return QUERIES["l04_analyse_job"].__globals__["raw_postings"](spark, SF).count()


# Fits have no SQL; what must hold of their results is checked here, and the fits themselves in test_fused.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, postings, name):
    rows = QUERIES[name](spark, SF).collect()
    if name == "c01_dispatch_by_types":
        assert [r["method_name"] for r in rows] == ["K-Means", "K-Modes", "K-Prototypes"]
        assert all(0 <= r["silhouette_score"] <= 1 and r["n_clusters"] in (2, 3) for r in rows)
    elif name == "c02_sweep_mixed":
        assert sorted(r["k"] for r in rows) == list(range(2, 13)) and {r["method_name"] for r in rows} == {"K-Prototypes"}
        assert all(r["converged"] and -1 <= r["silhouette_score"] <= 1 for r in rows)
        costs = [r["cost"] for r in sorted(rows, key=lambda r: r["k"])]
        assert costs[-1] < costs[0] / 2
    elif name == "c03_kmeans_sizes":
        assert 2 <= len(rows) <= 12 and all(r["n"] > 0 for r in rows) and sum(r["n"] for r in rows) <= postings
    elif name == "c14_pinned_sweep":
        assert [r["cluster"] for r in sorted(rows, key=lambda r: r["cluster"])] == list(range(16)) and sum(r["n"] for r in rows) <= postings
    elif name == "l04_analyse_job":
        assert sorted(r["id"] for r in rows) == list(range(1, len(rows) + 1)) and 2 <= len(rows) <= 12
        assert 0 < sum(r["vacancies_count"] for r in rows) <= postings
    else:
        pytest.fail(f"{name} has neither an oracle nor a check")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 5
