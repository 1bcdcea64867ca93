import pytest

from loomwork.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], FOLDER) == ""
