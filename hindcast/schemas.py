"""Declared schemas of all tables, and alignment of a DataFrame to one of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEATH = "MEDS_DEATH"


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    required: bool = True
    nullable: bool = False


@dataclass(frozen=True)
class TableSchema:
    """Columns in declared order; further columns are kept after them."""

    name: str
    fields: tuple[Field, ...]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def struct(self, optional: bool = True) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type, True) for f in self.fields if optional or f.required])

    def empty(self, spark: SparkSession, optional: bool = True) -> DataFrame:
        """A typed table without rows."""
        return spark.createDataFrame([], self.struct(optional))


_IDS = (Field("subject_id", T.LongType()), Field("prediction_time", T.TimestampNTZType()))
_QUERY = (Field("query", T.StringType()), Field("duration_days", T.FloatType()))

EVENT_LOG = TableSchema("event log", (Field("subject_id", T.LongType()), Field("time", T.TimestampNTZType(), nullable=True), Field("code", T.StringType()), Field("numeric_value", T.DoubleType(), required=False, nullable=True)))
INDEX = TableSchema("index", (*_IDS, *_QUERY))
TASK_QUERY = TableSchema("task query", (*_IDS, Field("boolean_value", T.BooleanType(), required=False, nullable=True), *_QUERY))
PREDICTION = TableSchema("prediction", (*_IDS, Field("boolean_value", T.BooleanType(), nullable=True), *_QUERY, Field("censor_prob", T.FloatType()), Field("occurs_prob", T.FloatType())))
CONTEXT = TableSchema("context", (Field("subject_id", T.LongType()), Field("shard", T.StringType()), Field("prediction_time_index", T.LongType())))
METRICS = TableSchema(
    "metrics",
    (
        *_QUERY,
        *(Field(n, T.LongType()) for n in ("n_rows", "n_occurs_labeled", "n_positive")),
        *(Field(n, T.DoubleType(), nullable=True) for n in ("occurs_auroc", "censor_auroc", "prevalence")),
    ),
)


class SchemaError(ValueError):
    """A table lacks a required column."""


def align(df: DataFrame, schema: TableSchema, check_nulls: bool = True) -> DataFrame:
    """Columns in declared order and type, further ones last; a missing required column raises at once,
    a null in a non-nullable column when the row is read."""
    missing = [f.name for f in schema.fields if f.required and f.name not in df.columns]
    if missing:
        raise SchemaError(f"{schema.name} table lacks columns {missing}; it has {df.columns}")
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        column = F.col(f"`{f.name}`").cast(f.type)
        if check_nulls and not f.nullable:
            column = F.when(column.isNull(), F.raise_error(F.lit(f"null in {schema.name} column {f.name}")).cast(f.type)).otherwise(column)
        out.append(column.alias(f.name))
    return df.select(*out, *(F.col(f"`{c}`") for c in df.columns if c not in schema.columns))
