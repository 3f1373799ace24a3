"""Small literal facts."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatsheet import schema


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


def facts(spark, rows, **defaults):
    """A result fact from dicts; entry ids are given in order unless set."""
    fields = {f.name: f for f in schema.RESULTS.fields}
    kinds = dict.fromkeys(("entry_id", "competitor_id"), T.LongType())
    struct = T.StructType(
        [T.StructField(n, kinds.get(n, f.dataType), True) for n, f in fields.items()]
    )
    data = []
    for i, row in enumerate(rows):
        full = {"entry_id": i, **defaults, **row}
        if isinstance(full.get("date"), str):
            full["date"] = day(full["date"])
        unknown = set(full) - set(fields)
        assert not unknown, unknown
        data.append(tuple(_real(full.get(n), f.dataType) for n, f in fields.items()))
    return spark.createDataFrame(data, struct)


def _real(value, kind):
    return float(value) if isinstance(kind, T.DoubleType) and isinstance(value, int) else value


def column(spark, kind, values):
    struct = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)])
    return spark.createDataFrame(list(enumerate(values)), struct)


def evaluate(spark, kind, values, function):
    frame = column(spark, kind, values)
    rows = frame.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


def listed(df, *columns, order="entry_id"):
    return [tuple(r[c] for c in columns) for r in df.orderBy(order).collect()]
