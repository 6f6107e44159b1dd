"""The queries agree with their SQL on the smallest data set."""

import pytest
from oracle import connect, differences, types

from hearthmap.llm.queries import QUERIES
from hearthmap.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con, df = connect(SF), QUERIES[name](spark, SF)
    assert differences(df, con, ORACLE[name]) == ""
    assert types(df, con, ORACLE[name]) == {}
