import pytest

from palimpsest import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, same, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        same(df, catalog.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert catalog.flagship(spark, SF).count() > 0
