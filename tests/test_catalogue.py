"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from factloom.plans import catalogue

from .compare import connection, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_twin(spark, con, name):
    found = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    wanted = con.execute(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_order_of_partitions_does_not_matter(spark):
    first = rows(catalogue.flagship(spark, FOLDER).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(catalogue.flagship(spark, FOLDER).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLES) <= set(__spark_entry__.oracle_sql())
