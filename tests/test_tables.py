"""The table function: columns follow its table, and several offers of a text come in order."""

import pytest
from pyspark.errors import PySparkException

from oremill.functions import tables


def test_price_offers(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, "$20 per month or $120 per year", "x"), (2, None, "y"), (3, "no price", "z"), (4, "free tier, $9/mo", None)], "k int, t string, extra string")
    made = spark.sql("SELECT * FROM price_offers(TABLE({rows}), 't')", rows=rows)
    assert made.columns == ["k", "extra", "place", "amount_monthly", "raw"]
    assert sorted(tuple(r) for r in made.filter("k < 4").collect()) == [(1, "x", 1, 20.0, "$20"), (1, "x", 2, 10.0, "$120")]
    assert [(r.place, r.amount_monthly, r.raw) for r in made.filter("k = 4").orderBy("place").collect()] == [(1, 9.0, "$9"), (2, 0.0, "free")]
    assert spark.sql("SELECT * FROM price_offers(TABLE({rows}), 't')", rows=rows.limit(0)).count() == 0


def test_refusals(spark):
    tables.register(spark)
    rows = spark.createDataFrame([("$1/mo", "r")], "t string, raw string")
    for call in ("price_offers(TABLE({rows}), 'nowhere')", "price_offers(TABLE({rows}), 't')", "price_offers('t', 't')"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM {call}", rows=rows).collect()
