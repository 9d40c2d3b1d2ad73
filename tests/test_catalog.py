import parity
import pytest

from codemap_spark.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
#: Queries about a path that only the larger tables have.
LARGER = {name: "/root/testdata/sf0.01" for name in ("cochanged_files", "file_recent_commits")}


@pytest.fixture(scope="module")
def duck():
    return parity.connection(SF)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    # empty on both sides is a difference too
    sf_dir = LARGER.get(name, SF)
    assert parity.difference(spark, duck if sf_dir == SF else parity.connection(sf_dir), catalog.QUERIES[name], oracles.ORACLE_SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracles.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(oracles.APART))
def test_same_rows_as_sql_apart(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert parity.difference(spark, parity.connection(sf_dir), catalog.QUERIES[name], oracles.APART[name], sf_dir) == ""
