import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(NAMES) > 60
