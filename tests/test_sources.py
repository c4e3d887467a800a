import pytest
from pyspark.sql import functions as F

from lakeloom.operators import arrays, codec_sizes, dictionary, generators, index, layouts, order, profile
from lakeloom.operators.measure import measure
from lakeloom.sources import files, lake
from lakeloom.streaming import windows


def test_records_round_trip(spark, tmp_path):
    rows = [("", 123, 321, 2345678)] + [(f"text {i}", i, i, i) for i in range(1000) for _ in range(3)]
    data = files.encode_records(rows)
    assert list(files.decode_records(data)) == rows
    (tmp_path / "cells.bin").write_bytes(data)
    got = files.read_records(spark, str(tmp_path / "cells.bin")).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    with pytest.raises((ValueError, IndexError)):
        list(files.decode_records(data[:-1]))


def test_array_files(spark, tmp_path):
    held = [[1, 2, 3], [], [4_000_000_000], list(range(1000))]
    (tmp_path / "a.bin").write_bytes(files.encode_arrays(held))
    a = files.read_arrays(spark, str(tmp_path / "a.bin"))
    got = {r.array_id: r.a for r in arrays.as_arrays(a).collect()}
    assert got == {i: x for i, x in enumerate(held) if x}
    files.write_by_length_class(arrays.as_arrays(a), str(tmp_path / "classes"))
    assert {r.lenbits for r in spark.read.parquet(str(tmp_path / "classes")).collect()} == {2, 1, 10}


def test_samples(spark, tmp_path, sf_dir):
    cells, path = lake.cells(spark, sf_dir, ["customer"]), str(tmp_path / "lake")
    files.write_cells(cells, path)
    name = files.write_sample(files.read_cells(spark, path), path, 0.5)
    spark.range(3).write.parquet(path + "-x")
    spark.range(3).write.parquet(path + "2-0.9")
    assert name.endswith("lake-0.5")
    assert {r.factor for r in files.stored_samples(spark, path).collect()} == {1.0, 0.5}
    n, half = cells.count(), spark.read.parquet(name).count()
    assert 0.35 * n < half < 0.65 * n
    assert files.read_sampled(spark, path, 0.5).count() == half
    assert files.read_sampled(spark, path, 1.0).count() == n
    with pytest.raises(Exception, match="exist"):
        files.write_sample(cells, path, 0.5)
    for bad in (0, 1, 2):
        with pytest.raises(ValueError):
            files.write_sample(cells, path, bad)
    with pytest.raises(ValueError):
        order.random_sample(cells, 1e-6)


def test_database_options():
    env = {"DATABASE_USER": "u", "DATABASE_PASSWORD": "p", "DATABASE_DB": "d"}
    assert files.database_options(env)["url"].endswith("/d")
    with pytest.raises(KeyError):
        files.database_options({})


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("# no\na , b\n\nc,b\na,d\n")
    df = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, df.collect())) == [("a", "b"), ("a", "d"), ("c", "b")]
    coded = files.csv_arrays(df.withColumn("id", F.concat("_c0", "_c1")), ["id"])
    assert {r.id: r.codes for r in coded.collect()} == {"ab": [0, 0], "cb": [1, 0], "ad": [0, 1]}


def test_measure(spark, tmp_path, sf_dir):
    cells = lake.cells(spark, sf_dir, ["nation"])
    row = measure(cells, "incr+dedup+ns", "nation")
    files.write_measures(row, str(tmp_path / "log"))
    got = row.first()
    assert got.cells == cells.count() and got.bytes > 0 and got.algorithm == "incr+dedup+ns"
    with pytest.raises(ValueError):
        layouts.layout("nope")
    assert len(layouts.LAYOUTS) == 23
    files.write_histogram(profile.linear_histogram(cells, "rowid"), str(tmp_path / "h"))
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "h")).count() == 256


def test_front_coding_prefixes(spark):
    for words, want in ((["aaa", "aaa", "aaa"], 3), (["aaaaa", "aaabc", "aaaf"], 3), (["aaaaa", "aaaf", "b"], 0)):
        d = spark.createDataFrame([(w, i, 0) for i, w in enumerate(words)], "key string, pos long, block_id long")
        assert dictionary.front_sizes(d).first().prefix == want


def test_incremental_sizes(spark):
    d = spark.createDataFrame([("aal", 0, 0), ("aachen", 1, 0), ("aachiluah", 2, 0)], "key string, pos long, block_id long")
    got = dictionary.incremental_sizes(d).first()
    assert (got.shared, got.bytes) == (2 + 4, 4 + 6 + 7)


def test_letters(spark):
    letters = "abbcccddddfffff" + "g" * 42 + "tuuuuuvw"
    cells = spark.createDataFrame([(c, i, 0, 0) for i, c in enumerate(letters)], "tokenized string, tableid long, colid long, rowid long")
    keys = spark.createDataFrame([(c,) for c in "abcdftuvwz"], "key string")
    got = {r.key: (r.first_pos, r.last_pos) for r in index.text_positions(cells, keys).collect()}
    assert got == {"a": (0, 0), "b": (1, 2), "c": (3, 5), "d": (6, 9), "f": (10, 14), "t": (57, 57), "u": (58, 62), "v": (63, 63), "w": (64, 64)}


def test_generators(spark):
    u = [r.v for r in generators.uniform(spark, 500, 2000).orderBy("pos").collect()]
    assert len(set(u)) == 500 and u == sorted(u) and max(u) < 2000
    c = [r.v for r in generators.clustered(spark, 3000, 1 << 20).orderBy("pos").collect()]
    assert len(set(c)) == 3000 and c == sorted(c) and max(c) < 1 << 20
    z = generators.zipf(spark, 20_000, 1.0, 1000)
    counts = {r.v: r["count"] for r in z.groupBy("v").count().collect()}
    assert 1.6 < counts[0] / counts[1] < 2.4 and max(counts) < 1000
    assert generators.zipf(spark, 100, 1.0, 1000).collect() == z.where("pos < 100").collect()
    assert generators.masked(spark, 100, 5).agg({"v": "max"}).first()[0] < 32
    with pytest.raises(ValueError):
        generators.uniform(spark, 10, 5)


def test_small_arrays(spark):
    rows = [(n, i, 3 * i + 1) for n in (1, 3, 4, 5, 9) for i in range(n)]
    a = spark.createDataFrame(rows, "array_id long, pos long, v long")
    assert sorted(map(tuple, arrays.undo_delta_stride(arrays.delta_stride(a)).collect())) == sorted(rows)
    assert arrays.gaps(a).count() == sum(n - 1 for n in (1, 3, 4, 5, 9))
    assert arrays.unsorted_arrays(a).count() == 0
    assert codec_sizes.width_table(a).count() == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = lake.table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"))
    held = windows.drained(windows.counts(stream), "tumbling", str(tmp_path / "c1"))
    batch = windows.counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, batch.collect()))
    sliding = windows.drained(windows.counts(windows.read_events(spark, str(tmp_path / "in"), 3), slide="15 minutes"), "sliding", str(tmp_path / "c2"))
    assert sliding.agg({"n": "sum"}).first()[0] == 4 * events.count()
    sessions = windows.drained(windows.sessions(windows.read_events(spark, str(tmp_path / "in"), 3)), "sessions", str(tmp_path / "c3"))
    assert sessions.agg({"n": "sum"}).first()[0] == events.count()


def test_database(spark, tmp_path, sf_dir):
    """A database inside the JVM stands for the real one."""
    cells = lake.cells(spark, sf_dir, ["nation", "customer"])
    options = {"url": f"jdbc:derby:directory:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    cells.write.format("jdbc").options(**options).option("dbtable", "lake").option("createTableColumnTypes", "tokenized VARCHAR(200)").save()
    read = files.read_database(spark, "lake", options, parts=2)
    want = sorted(map(tuple, cells.collect()))
    assert read.rdd.getNumPartitions() == 2 and sorted(map(tuple, read.collect())) == want
    assert [tuple(r) for r in files.read_database(spark, "lake", options, ordered=True).collect()] == want
    out = files.export_database(spark, "lake", str(tmp_path / "out"), options)
    assert sorted(map(tuple, out.collect())) == want
    with pytest.raises(ValueError):
        files.read_database(spark, "lake; x", options)


def test_benchmark_arrays(spark):
    for mode, n, below in (("clustersparse", 1 << 12, 1 << 26), ("uniformsparseclassic", 1 << 9, 1 << 27)):
        rows = generators.benchmark_arrays(spark, mode, count=5).collect()
        assert len(rows) == 5 and all(len(r.a) == n and r.a == sorted(set(r.a)) and 0 <= r.a[0] and r.a[-1] < below for r in rows)
        assert sorted(rows) == sorted(generators.benchmark_arrays(spark, mode, count=5).collect())
    with pytest.raises(ValueError):
        generators.benchmark_arrays(spark, "vclusterdynamic")


def test_lookahead(spark):
    from lakeloom.functions.bits import lookahead_width

    held = [[1] * 40, [0, 3], [1 << 29], [1 << 30], [], [1, 1, 200], [1] * 10 + [2] * 30]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(held)], "i long, a array<long>").select("i", lookahead_width(F.col("a")).alias("w"))
    assert {r.i: r.w for r in got.collect()} == {0: 1, 1: 2, 2: 30, 3: None, 4: None, 5: 8, 6: 2}
