"""Tables of a data folder, and small tables of the driver's own."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from loamstack.session import ship


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of ``folder``; only the named columns reach the scan."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def local(spark: SparkSession, rows: Iterable[tuple], schema: str | StructType) -> DataFrame:
    """A few rows as a relation of the plan itself, which needs no tasks; rows from a list would be read by a job."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    columns = list(zip(*rows)) or [()] * len(kind.fields)
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow), kind)
