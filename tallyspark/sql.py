"""The functions of this library for use in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import labels, numbers, periods, stats, texts


class ParseCells:
    """Table function: the printed figures of an array of texts, with their position."""

    def eval(self, raw: list) -> Iterator[tuple]:
        for k, text in enumerate(raw or []):
            value, unit, flags = numbers.read_number(text)
            yield k, text, value, unit, flags


def register(spark: SparkSession) -> None:
    """``parse_number``, ``parse_period``, ``normalize_label``, ``dataset_label``, ``nfkc``, ``error_upper95``, ``join_letters``,
    ``restore_digits``, and the table function ``parse_cells``."""

    @F.pandas_udf(periods.PERIOD)
    def parse_period(headers: pd.Series) -> pd.DataFrame:
        rows = [periods.read_period(t) or (None,) * 6 for t in headers]
        return pd.DataFrame(rows, columns=[f.name for f in periods.PERIOD.fields]).astype({"months": "Int32", "restated": object, "audited": object})

    for name, function in (("parse_number", numbers.parse_number), ("parse_period", parse_period), ("normalize_label", labels.normalize_label), ("dataset_label", labels.dataset_label), ("nfkc", labels.nfkc), ("error_upper95", stats.error_upper95), ("join_letters", texts.joined_letters), ("restore_digits", texts.restored_digits)):
        spark.udf.register(name, function)
    cells = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("raw_text", T.StringType()), *numbers.NUMBER.fields])
    spark.udtf.register("parse_cells", F.udtf(ParseCells, returnType=cells))
