"""Every core query against its SQL twin on the smallest data."""

import pytest

from tests.conftest import DATA, canonical
from verbatrix.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    theirs = duck.execute(catalog.ORACLE[name]).df()
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, duck, name):
    assert catalog.QUERIES[name](spark, f"{DATA}/sf0.001").columns


def test_entry_has_rows(spark, duck):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
