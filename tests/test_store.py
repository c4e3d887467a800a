"""Tables in the shared folder."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lakeloom.store import LARGE, dropped, written


def test_large_rows_lie_in_small_row_groups(spark):
    rows = spark.range(0, 60, 1, 1).select("id", F.expr("array_join(transform(sequence(1, 16000), x -> uuid()), '')").alias("text"))
    kept = written(rows, large=True)
    files = glob.glob(f"{kept._lakeloom_path.removeprefix('file:')}/*.parquet")
    groups = [m.row_group(i) for m in (pq.ParquetFile(f).metadata for f in files) for i in range(m.num_row_groups)]
    assert len(groups) > 2 and max(g.total_byte_size for g in groups) < 2 * LARGE
    assert kept.count() == 60
    dropped(kept)
