"""Table functions for SQL: `spark.udtf.register` makes them known by name, and their columns follow the table they are given."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .pricing import offers


class PriceOffers:
    """`price_offers(TABLE(rows), 'text')`: every offer of each row's text, in order.

    The result has the table's other columns, then place (from 1), amount_monthly and raw.  Rows without an offer, null and
    empty texts among them, give none.  Rows are taken where they lie: the function asks for no exchange.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, T.StructType):
            raise ValueError("price_offers takes a table: price_offers(TABLE(rows), 'text')")
        fields = {f.name: f for f in rows.dataType.fields}
        if not text.isConstantExpression or text.value not in fields:
            raise ValueError(f"price_offers needs the name of a column with texts, one of {', '.join(fields)}")
        made = T.StructType([f for name, f in fields.items() if name != text.value])
        clash = {"place", "amount_monthly", "raw"} & set(made.names)
        if clash:
            raise ValueError(f"the table has columns that price_offers makes: {', '.join(sorted(clash))}")
        return AnalyzeResult(schema=made.add("place", T.IntegerType()).add("amount_monthly", T.DoubleType()).add("raw", T.StringType()))

    def eval(self, rows: Row, text: str) -> Iterator[tuple]:
        kept = [value for name, value in rows.asDict().items() if name != text]
        for place, offer in enumerate(offers(rows[text]), 1):
            yield (*kept, place, offer["amount_monthly"], offer["raw"])


def register(spark: SparkSession) -> None:
    spark.udtf.register("price_offers", udtf(PriceOffers, useArrow=False))
