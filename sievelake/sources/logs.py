"""Log records as one row per logged field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.schemas import PLACE_COLUMNS


def log_fields(
    logs: DataFrame, fields: str = "fields", values: str | None = None, body_sourced: str = "body_sourced", keep=()
) -> DataFrame:
    """(place..., body_sourced, field, field_value) rows. Narrow: an explode, no shuffle.

    `values` holds the field texts in the same order; without it they are null.
    Records without a body mark count as not taken from a request body.
    """
    carried = [c for c in (*PLACE_COLUMNS, *keep) if c in logs.columns]
    body = F.col(body_sourced) if body_sourced in logs.columns else F.lit(False)
    if values is None:
        row = [F.explode(fields).alias("field")]
    else:
        row = [F.inline(F.arrays_zip(F.col(fields).alias("field"), F.col(values).alias("field_value")))]
    out = logs.select(*carried, body.alias("body_sourced"), *row)
    return out if values else out.withColumn("field_value", F.lit(None).cast("string"))
