"""Queries with an SQL twin against it; all others run and keep their columns."""

import pytest

from tests.conftest import DATA, canonical
from verbatrix.llm.oracle import ORACLE
from verbatrix.llm.queries import QUERIES

COLUMNS = {
    "p1_found": ["line_no", "page_id"], "p2_found": ["candidate_id", "unitid"], "p3_found": ["field", "id_a", "id_b"], "p5_found": ["line_no", "page_id"], "p6_found": ["page_id"],
    "p7_found": ["end_char", "field", "rec_id", "start_char"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "text_class"],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    assert canonical(ours) == canonical(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert sorted(df.columns) == COLUMNS[name]
    assert df.count() == df.distinct().count()
