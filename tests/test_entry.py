"""What the driver reads."""

import __spark_entry__


def test_every_retail_query_has_a_twin():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    alone = {n for n in found if n not in sql and not n.startswith("op") and n != "pipeline"}
    assert alone == {"churn_scores"} and {*sql} <= {*found}


def test_entry(spark):
    assert "avg_7d" in __spark_entry__.entry(spark).columns
