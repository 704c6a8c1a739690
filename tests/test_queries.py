"""Every registered query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import pytest

from evidra.plans import catalogue
from tests.held import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf_dir)) == sql_rows(catalogue.SQL[name], sf_dir)


def test_all_queries_but_the_greedy_ones_have_sql():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"minimal_set", "discovered"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["supplier_rank_weighted", "overlapping_dependencies", "requirement_coverage", "license_identify"])
def test_plans_stay_in_the_jvm_without_products(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan


def test_families_cover_all_parts(spark, sf_dir):
    got = catalogue.QUERIES["family_components"](spark, sf_dir).collect()
    assert sum(r["members"] for r in got) == spark.read.parquet(f"{sf_dir}/part.parquet").count()
