"""Tables written to the shared folder, so that later steps don't depend on executors that may be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a temporary one is made and set, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lakeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of a row group of large rows. Spark's reader takes up to 4,096 rows at once, but none beyond a row group.
LARGE = 8 << 20


def written(df: DataFrame, codec: str = "zstd", large: bool = False) -> DataFrame:
    """df, written as Parquet into the shared folder and read again: cuts the lineage and is computed once. large: rows may have a MB each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeloom-{uuid.uuid4().hex}"
    groups = {"parquet.block.size": LARGE, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1} if large else {}
    df.write.options(compression=codec, **groups).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._lakeloom_path = path
    return found


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in tables:
        if df is not None:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(df._lakeloom_path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
