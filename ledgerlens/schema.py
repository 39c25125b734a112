"""The event model: schemas, kinds and tag values."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the event format: kinds, and the first value of the z tag for each.
DEV_FEE, ORDER, INFO, DISPUTE = 8383, 38383, 38385, 38386
SUBTYPE = {DEV_FEE: "dev-fee-payment", ORDER: "order", INFO: "info", DISPUTE: "dispute"}
# Order and dispute statuses.
SUCCESS = "success"
RESOLVED = ("settled", "seller-refunded", "released")
ACTIVE = ("initiated", "in-progress")

DAY = 86_400
MAX_U64 = (1 << 64) - 1

#: Raw events as they are published.  Tags are ordered lists whose names may repeat.
EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("tags", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("relay", T.StringType()),
    ]
)
#: Events with what proves them: their id and signature cover the content as well.
RAW = T.StructType([*EVENT.fields, T.StructField("content", T.StringType()), T.StructField("sig", T.StringType())])
#: Typed events: tags extracted once, so that later filters reach the Parquet scan.
TYPED = T.StructType(
    [
        *[f for f in EVENT.fields if f.name != "tags"],
        *[T.StructField(c, T.StringType()) for c in ("z", "y", "d", "s", "f", "bond_enabled")],
        T.StructField("amt", T.DecimalType(20, 0)),
        T.StructField("premium", T.LongType()),
        T.StructField("pm", T.ArrayType(T.StringType())),
    ]
)
