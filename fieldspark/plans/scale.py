"""Helpers that keep plans safe when one key holds a large share of the rows.

* ``spooled`` writes an intermediate to a Parquet table in the checkpoint folder, so
  it is computed once and keeps its values if an executor is lost.
* ``release`` deletes such tables once nothing reads them any more.
* ``durable`` is the same for a table that may be asked for again; it remembers its size.
* ``attach`` joins per-key facts back onto the rows. It measures the fact table
  and broadcasts it only within a byte budget; beyond that it is an ordinary
  shuffle join whose oversized partitions adaptive execution may split.
* ``ship`` sends this package to the executors, for Python tasks of a session that was
  started in another folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 * 1024 * 1024
# Attribute under which a durable DataFrame keeps what is known about it.
_MARK = "_fieldspark_durable"
# And under which a spooled one keeps the path of its table.
_PATH = "_fieldspark_path"
_shipped: set[str] = set()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is made only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Compute a table once and keep it in the checkpoint folder; one that is durable already is returned as it is.

    Its size is measured by the job that writes it.
    """
    if getattr(df, _MARK, None) is not None:
        return df
    watch = Observation()
    kept = spooled(df.observe(watch, _total_bytes(df).alias("bytes")))
    setattr(kept, _MARK, {"bytes": watch.get["bytes"]})
    return kept


def spooled(df: DataFrame) -> DataFrame:
    """Write a large intermediate as Parquet in the checkpoint folder and read it back."""
    path = f"{checkpoint_folder(df.sparkSession)}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(kept, _PATH, path)
    return kept


def release(*tables: DataFrame) -> None:
    """Delete tables that ``spooled`` has written. No DataFrame that is still to be computed may read them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(getattr(table, _PATH))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "fieldspark_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)


def _width(field: T.StructField) -> Column | int:
    """Bytes of one value: measured for text and arrays, else the type's nominal width."""
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 8
    return 8


def _total_bytes(df: DataFrame) -> Column:
    row = sum((_width(f) for f in df.schema.fields), F.lit(0)).cast("long")
    return F.coalesce(F.sum(row), F.lit(0).cast("long"))


def measured_bytes(df: DataFrame) -> int:
    """Size of a materialised small table, measured over its rows; measured once per table."""
    facts = getattr(df, _MARK, {})
    if "bytes" not in facts:
        facts["bytes"] = df.agg(_total_bytes(df)).first()[0]
    return facts["bytes"]


def attach(
    df: DataFrame,
    facts: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join per-key ``facts`` onto ``df`` without shuffling ``df`` when the facts are small."""
    table = durable(facts)
    if measured_bytes(table) <= budget:
        table = F.broadcast(table)
    return df.join(table, list(on), how)
