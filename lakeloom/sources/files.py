"""Sources and sinks: cell tables, their samples, record files, array files, CSV, databases and measurement logs."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.blocks import read_varint, varint
from ..operators.order import CELL_ORDER, random_sample, stored_factor

# cell tables


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes cells sorted by text over ranges of texts, so repeated texts are run-length coded and a text's file can be found by
    its least and greatest value."""
    cells.repartitionByRange(*CELL_ORDER).sortWithinPartitions(*CELL_ORDER).write.mode(mode).parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_sample(cells: DataFrame, path: str, factor: float, seed: int = 7) -> str:
    """Writes a sample beside a cell table as path-factor and returns that name; refuses to overwrite one."""
    if not 0 < factor < 1:
        raise ValueError("a sample's factor lies between 0 and 1")
    name = f"{path}-{factor:g}"
    random_sample(cells, factor, seed).write.mode("errorifexists").parquet(name)
    return name


def stored_samples(spark: SparkSession, path: str) -> DataFrame:
    """(name, factor) of a cell table and its samples: exactly path or path-<number>. Lists through the path's own file system."""
    jvm, folder = spark.sparkContext._jvm, path.rstrip("/").rpartition("/")
    root = jvm.org.apache.hadoop.fs.Path(folder[0] or ".")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = [(f"{folder[0]}/{s.getPath().getName()}",) for s in found]
    df = spark.createDataFrame(names, "name string")
    base = path.rstrip("/")
    return df.where((F.col("name") == base) | F.col("name").rlike("^" + "".join("\\" + c if not c.isalnum() else c for c in base) + r"-[0-9]*\.?[0-9]+$")).select("name", stored_factor(F.col("name")).alias("factor"))


def read_sampled(spark: SparkSession, path: str, factor: float, seed: int = 7) -> DataFrame:
    """Cells of a table with the wanted factor: from the least stored sample that is not less, sampled further by the rest."""
    best = stored_samples(spark, path).where(F.col("factor") >= factor).orderBy("factor").first()
    if best is None:
        raise ValueError(f"no table or sample at {path}")
    return random_sample(spark.read.parquet(best.name), min(1.0, factor / best.factor), seed)


# databases


def database_options(env: dict[str, str] | None = None, host: str = "localhost") -> dict[str, str]:
    """JDBC options from DATABASE_USER, DATABASE_PASSWORD and DATABASE_DB."""
    env = dict(os.environ) if env is None else env
    missing = [k for k in ("DATABASE_USER", "DATABASE_PASSWORD", "DATABASE_DB") if k not in env]
    if missing:
        raise KeyError(f"{', '.join(missing)} not set")
    return {"url": f"jdbc:postgresql://{host}/{env['DATABASE_DB']}", "user": env["DATABASE_USER"], "password": env["DATABASE_PASSWORD"]}


def read_database(spark: SparkSession, name: str, options: dict[str, str], parts: int = 16, ordered: bool = False) -> DataFrame:
    """Cells of a database table, sorted by text if wanted. Ranges of tableid between the table's own least and greatest are read at once, with
    filters and columns pushed to the database; needs a JDBC driver on the class path."""
    if not name.replace("_", "").isalnum():
        raise ValueError("not a table's name")
    reader = spark.read.format("jdbc").options(**options)
    ends = reader.option("query", f'SELECT min("tableid") AS lo, max("tableid") AS hi FROM {name}').load().first()
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
    if ends[0] is not None and ends[1] > ends[0]:
        reader = reader.option("partitionColumn", "tableid").option("lowerBound", ends[0]).option("upperBound", ends[1] + 1).option("numPartitions", min(parts, ends[1] - ends[0] + 1))
    cells = reader.load()
    cells = cells.toDF(*[c.lower() for c in cells.columns]).select(F.col("tokenized"), *[F.col(c).cast("long").alias(c) for c in CELL_ORDER[1:]])
    return cells.orderBy(*CELL_ORDER) if ordered else cells


def export_database(spark: SparkSession, name: str, path: str, options: dict[str, str], parts: int = 16, mode: str = "errorifexists") -> DataFrame:
    """Writes a database table as a cell table sorted by text, and reads that back. Sorted on the cluster, not in the database."""
    write_cells(read_database(spark, name, options, parts), path, mode)
    return read_cells(spark, path)


def source(spark: SparkSession, name: str, database: bool = False, factor: float = 1.0) -> DataFrame:
    """Cells by name from the database or from files, sampled if wanted."""
    return random_sample(read_database(spark, name, database_options()), factor) if database else read_sampled(spark, name, factor)


# record files: length, kind (0: same text as before, 1: text), text length and bytes, three ids; all numbers as varints


def encode_records(rows: list[tuple[str, int, int, int]]) -> bytes:
    """Cells as records; the text of a record that repeats the one before it is left out."""
    out, last = bytearray(), None
    for text, *ids in rows:
        body = bytes([0]) if text == last else b"\1" + varint(len(text.encode())) + text.encode()
        body += b"".join(map(varint, ids))
        out += varint(len(body)) + body
        last = text
    return bytes(out)


def decode_records(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    at, last = 0, ""
    while at < len(data):
        size, at = read_varint(data, at)
        end = at + size
        if end > len(data):
            raise ValueError("a record is cut off")
        kind, at = data[at], at + 1
        if kind == 1:
            n, at = read_varint(data, at)
            last, at = data[at : at + n].decode(), at + n
        elif kind:
            raise ValueError(f"unknown kind {kind}")
        ids = []
        for _ in range(3):
            x, at = read_varint(data, at)
            ids.append(x)
        if at != end:
            raise ValueError("a record has another length than it says")
        yield last, *ids


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Cells of record files; each file is read by one task, as a record's text may stand in an earlier one."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                yield pd.DataFrame(list(decode_records(bytes(content))), columns=["tokenized", "tableid", "colid", "rowid"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "tokenized string, tableid long, colid long, rowid long")


# array files: a 32-bit length and that many 32-bit values, again and again


def encode_arrays(arrays: list[list[int]]) -> bytes:
    return b"".join(np.array([len(a), *a], np.uint32).tobytes() for a in arrays)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, array_id, pos, v) of array files."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame.path, frame.content, strict=True):
                words, at, number = np.frombuffer(bytes(content), np.uint32), 0, 0
                while at < len(words):
                    n = int(words[at])
                    if at + 1 + n > len(words):
                        raise ValueError(f"{file}: array {number} is cut off")
                    yield pd.DataFrame({"file": file, "array_id": number, "pos": np.arange(n), "v": words[at + 1 : at + 1 + n].astype(np.int64)})
                    at, number = at + 1 + n, number + 1

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, array_id long, pos long, v long")


def write_by_length_class(arrays: DataFrame, path: str) -> None:
    """Arrays (array_id, a) in one folder for each bit width of their lengths."""
    sized = arrays.withColumn("lenbits", F.when(F.size("a") == 0, 0).otherwise(F.length(F.bin(F.size("a").cast("long")))))
    sized.write.partitionBy("lenbits").parquet(path)


# text files


def read_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Comma-separated strings, trimmed; lines that start with # and blank lines are left out."""
    return spark.read.csv(path, sep=",", comment="#", header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def csv_arrays(df: DataFrame, order: list[str]) -> DataFrame:
    """(row, codes): each row's values as frequency codes (0: most frequent of its column; ties: the greater value first)."""
    from pyspark.sql import Window

    out, columns = df, [c for c in df.columns if c not in order]
    for c in columns:
        counts = df.groupBy(c).count()
        codes = counts.select(F.col(c).alias(f"_{c}"), (F.row_number().over(Window.orderBy(F.desc("count"), F.desc(c))) - 1).cast("long").alias(f"_code_{c}"))
        out = out.join(codes, F.col(c).eqNullSafe(F.col(f"_{c}")), "left").drop(f"_{c}")
    return out.select(*order, F.array(*[f"_code_{c}" for c in columns]).alias("codes"))


MEASURES = ["cells", "bytes", "build_duration_nanosec", "build_duration_total_nanosec", "retr_duration_avg_nanosec", "algorithm", "table", "multi_proc", "label"]


def write_measures(df: DataFrame, path: str, header: bool = True) -> None:
    """Measurement records, separated by semicolons."""
    df.select(*MEASURES).write.mode("append").option("sep", ";").option("header", header).csv(path)


def write_histogram(histogram: DataFrame, path: str) -> None:
    """A histogram (at most 256 rows) as one semicolon-separated file."""
    histogram.coalesce(1).sortWithinPartitions(histogram.columns[0]).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
