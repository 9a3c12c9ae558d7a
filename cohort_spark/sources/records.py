"""Typed records from loose input, with a failure ledger instead of dropped rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.core import finite, require_columns

# Header tags by stored type; every other tag is text (fixed values).
INTEGER_TAGS = (
    "InstanceNumber",
    "Rows",
    "Columns",
    "BitsAllocated",
    "BitsStored",
    "PixelRepresentation",
)
FLOAT_TAGS = (
    "SliceThickness",
    "SpacingBetweenSlices",
    "MagneticFieldStrength",
    "EchoTime",
    "RepetitionTime",
    "RescaleSlope",
    "RescaleIntercept",
    "PixelPaddingValue",
)


def tag_kind(tag: str) -> str:
    """Stored type of a header tag: integer, float or text."""
    return "integer" if tag in INTEGER_TAGS else "float" if tag in FLOAT_TAGS else "text"


def _as_kind(df: DataFrame, column: str, kind: str) -> Column:
    source = df.schema[column].dataType
    value = F.col(column)
    if kind in {"integer", "float"}:
        number = finite(value.try_cast("double"))
        return number.try_cast("bigint") if kind == "integer" else number
    if isinstance(source, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if isinstance(source, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(source, (T.DoubleType, T.FloatType)):
        return finite(value).cast("string")
    return value.cast("string")


def normalize_records(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Cast columns to ``integer``, ``float`` or ``text``: one projection.

    What is no finite number becomes null, integers are cut toward zero, nested values become JSON
    and bytes become hexadecimal text.
    """
    require_columns(df, spec)
    return df.withColumns({c: _as_kind(df, c, kind) for c, kind in spec.items()})


def parse_json(df: DataFrame, body: str, schema: T.StructType) -> DataFrame:
    """Parse JSON bodies; adds ``record``, ``error_type`` and ``error`` and keeps every row."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(
        F.col(body), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    staged = df.withColumn("_parsed", parsed)
    broken = F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull()
    return staged.select(
        *df.columns,
        F.when(
            ~broken, F.struct(*[F.col(f"_parsed.`{f.name}`").alias(f.name) for f in schema.fields])
        ).alias("record"),
        F.when(broken, "MalformedRecord").alias("error_type"),
        F.when(broken, F.concat(F.lit("malformed record: "), F.coalesce(body, F.lit("null")))).alias("error"),
    )


def parse_with(
    df: DataFrame, body: str, parse: Callable[[object], Mapping[str, object]], schema: T.StructType
) -> DataFrame:
    """Parse bodies with a user's function, one Arrow batch at a time; an exception becomes a ledger row."""
    fields = [f.name for f in schema.fields]
    out = T.StructType(
        [
            *df.schema.fields,
            T.StructField("record", schema),
            T.StructField("error_type", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records, kinds, errors = [], [], []
            for value in batch[body]:
                try:
                    parsed = parse(value)
                    records.append({f: parsed.get(f) for f in fields})
                    kinds.append(None)
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - recorded, not raised
                    records.append(None)
                    kinds.append(type(error).__name__)
                    errors.append(str(error))
            yield batch.assign(record=records, error_type=kinds, error=errors)

    return df.mapInPandas(run, out)


def good_records(parsed: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Rows that parsed, with the record's fields as columns."""
    return parsed.where(F.col("error_type").isNull()).select(*keep, "record.*")


def failed_records(parsed: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The failure ledger: what failed and why."""
    return parsed.where(F.col("error_type").isNotNull()).select(*keep, "error_type", "error")


def ingest_counts(parsed: DataFrame) -> DataFrame:
    """Discovered, readable and failed records."""
    return parsed.agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("error_type").isNull()).alias("readable"),
        F.count_if(F.col("error_type").isNotNull()).alias("failed"),
    )
