import parity
import pytest

from strandloom import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, name):
    parity.compare(spark, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - {"convergence_bundle", "evaluation_table", "vae_published_size"}))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, parity.FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6 * 16 * 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
