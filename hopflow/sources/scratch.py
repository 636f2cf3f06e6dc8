"""Tables and files that a job makes on the way, in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Files that a folder of a table has which is cut by a column.
SLICES = 8


#: The folder of each application.
_bases: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder where that is unset, in local sessions only. What
    an application has written there is removed when its Python process ends."""
    app = spark.sparkContext.applicationId
    if app not in _bases:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="hopflow-graph-")
        _bases[app] = f"{base.rstrip('/')}/graph-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _bases[app])
    return f"{_bases[app]}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; the folder is then left to the cluster's cleaner
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path, schema = folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@dataclass
class Folders:
    """A table with a folder for each value of a column."""

    spark: SparkSession
    path: str
    column: str
    schema: StructType
    values: set

    def of(self, value) -> DataFrame:
        """The rows with this value, without the column: their folder is all that is read."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.column}={value}")


def written_by(df: DataFrame, name: str, column: str, spread: str) -> Folders:
    """df as a Parquet table with a folder for each value of a whole-number column that is not null; a value's rows are
    dealt over SLICES files by a hash of the column `spread`."""
    path = folder(df.sparkSession, name)
    df.repartition(column, F.pmod(F.xxhash64(spread), F.lit(SLICES))).write.partitionBy(column).parquet(path)
    schema = StructType([f for f in df.schema.fields if f.name != column])
    values = {r[0] for r in df.sparkSession.read.schema(df.schema).parquet(path).select(column).distinct().collect()} if _any(df.sparkSession, path) else set()
    return Folders(df.sparkSession, path, column, schema, values)


def _any(spark: SparkSession, path: str) -> bool:
    """Whether a folder has data; a table without rows has no folder for a value."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(f.isDirectory() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))
