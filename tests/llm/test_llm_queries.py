import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import parity  # noqa: E402

from strandloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    parity.compare(spark, queries.QUERIES[name], queries.SQL[name])


COLUMNS = {
    "p2_found": ["request_id", "ref_base", "alt_base", "x_prev1", "x_next1"], "p3_found": ["row_a", "row_b"], "p4_found": ["survivor_row", "mapq_row", "dp_row"],
    "p7_found": ["row_a", "row_b"], "p8_found": ["doc_id"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_found(spark, name):
    assert queries.QUERIES[name](spark, parity.FOLDER).columns == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - set(COLUMNS)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, parity.FOLDER).count() > 0
