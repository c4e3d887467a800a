"""Registered queries over the lake and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codecs
from ..functions.bits import base_name, byte_width, ceil_div, lookahead_width, low_high, shared_prefix, split_any, varint_bytes, width, width_least_one
from ..operators import arrays, codec_sizes, dictionary, encoded, generators, index, layouts, order, profile
from ..ranges import numbered, numbered_within
from ..session import ship
from ..sources import lake
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CELLS = f"cells AS ({lake.cells_sql()})"
TOKENS = f"tokens AS ({lake.TOKENS_SQL})"
#: Probe keys: some that are in the lake and some that are not.
PROBES = ["1", "ASIA", "BUILDING", "7", "nowhere", "0.00", "O", "zzzz", "", "Customer#000000001", "42"]
PROBES_SQL = "probes AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PROBES) + ") v(key))"
#: Arrays of the codec queries. sorted: order keys by customer; mixed: quantities with rare large values.
SORTED_SQL = "a AS (SELECT CAST(o_custkey % 32 AS BIGINT) AS array_id, CAST(row_number() OVER (PARTITION BY o_custkey % 32 ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, CAST(o_orderkey AS BIGINT) AS v FROM orders)"
_MIXED_ORDER = ", ".join(lake.ORDER_OF["lineitem"])
_MIXED_V = "CASE WHEN (l_orderkey * 7 + l_partkey) % 29 = 0 THEN CAST(l_partkey AS BIGINT) * 64 + l_orderkey WHEN l_orderkey % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END"
MIXED_SQL = f"a AS (SELECT CAST(l_suppkey % 16 AS BIGINT) AS array_id, CAST(row_number() OVER (PARTITION BY l_suppkey % 16 ORDER BY {_MIXED_ORDER}) - 1 AS BIGINT) AS pos, {_MIXED_V} AS v FROM lineitem)"
WIDTH = "CAST(CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END AS BIGINT)"
VB = "(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END)"
BW = "(CASE WHEN {0} < 256 THEN 1 WHEN {0} < 65536 THEN 2 WHEN {0} < 16777216 THEN 3 ELSE 4 END)"
KEYS16 = "k AS (SELECT key, CAST(pos AS BIGINT) AS pos, CAST(pos // {0} AS BIGINT) AS block_id FROM (SELECT tokenized AS key, row_number() OVER (ORDER BY tokenized) - 1 AS pos FROM (SELECT DISTINCT tokenized FROM {1})))"


def register(name: str, sql: str | None) -> Callable:
    """Registers a query, with its SQL unless SQL can't express it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_tables: ContextVar[list[str]] = ContextVar("tables", default=lake.DEFAULT)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return lake.cells(spark, d, _tables.get())


def _wide(spark: SparkSession, d: str) -> list[lake.Wide]:
    """The tables of the cells, for what numbers and packs their rows itself."""
    return lake.wide(spark, d, _tables.get(), number=False)


def _over_all(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the lake's cells over every table instead of the default ones."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        kept = _tables.set(lake.TABLES)
        try:
            return f(spark, d)
        finally:
            _tables.reset(kept)

    return run


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return lake.token_cells(lake.table(spark, d, "documents"))


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PROBES], "key string")


def _sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = lake.table(spark, d, "orders").selectExpr("o_custkey % 32 AS array_id", "o_orderkey AS v")
    return numbered_within(rows, "array_id", ["v"], "pos").select("array_id", "pos", "v")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    order_ = lake.ORDER_OF["lineitem"]
    rows = lake.table(spark, d, "lineitem").selectExpr("l_suppkey % 16 AS array_id", f"{_MIXED_V} AS v", *order_)
    return numbered_within(rows, "array_id", order_, "pos").select("array_id", "pos", "v")


# cells

register("lake_cells", lake.cells_sql())(_cells)
register("lake_token_cells", lake.TOKENS_SQL)(_tokens)
register("lake_cells_numbered", lake.cells_sql(["lineitem"]))(lambda s, d: lake.cells(s, d, ["lineitem"]))
register("lake_entry_count", f"WITH {CELLS} SELECT tableid, count(*) AS cells FROM cells GROUP BY tableid")(lambda s, d: index.entry_counts(_cells(s, d)))
register("cells_repeat_flags", f"WITH {CELLS}, f AS (SELECT tableid, tokenized = lag(tokenized) OVER (PARTITION BY tableid ORDER BY tokenized, colid, rowid) AS again FROM cells) SELECT tableid, count(*) AS rows, count(*) FILTER (again) AS repeated FROM f GROUP BY tableid")(lambda s, d: order.repeat_flags(_cells(s, d)))
register("cells_triples", f"WITH {CELLS} SELECT * FROM cells")(lambda s, d: index.triples(_cells(s, d)))
register("cells_dump", f"WITH {CELLS} SELECT '''' || tokenized || ''': [' || tableid || ', ' || colid || ', ' || rowid || ']' AS line FROM cells")(lambda s, d: _cells(s, d).select(F.format_string("'%s': [%d, %d, %d]", "tokenized", "tableid", "colid", "rowid").alias("line")))

# index and lookups

register("idx_dedup", f"WITH {CELLS}, s AS (SELECT tokenized, count(*) AS n, min({{'tableid': tableid, 'colid': colid, 'rowid': rowid}}) AS lo, max({{'tableid': tableid, 'colid': colid, 'rowid': rowid}}) AS hi FROM cells GROUP BY tokenized) SELECT tokenized, n, lo.tableid AS min_tableid, lo.colid AS min_colid, lo.rowid AS min_rowid, hi.tableid AS max_tableid, hi.colid AS max_colid, hi.rowid AS max_rowid FROM s")(lambda s, d: index.summary(_cells(s, d)))
register("idx_dedup_tokens", f"WITH {TOKENS} SELECT tokenized, count(*) AS n, min(rowid) AS first_doc, max(rowid) AS last_doc FROM tokens GROUP BY tokenized")(lambda s, d: _tokens(s, d).groupBy("tokenized").agg(F.count("*").alias("n"), F.min("rowid").alias("first_doc"), F.max("rowid").alias("last_doc")))
register("idx_dedup_flat_ints", f"WITH {CELLS} SELECT tokenized, count(*) * 3 AS n_ints, CAST(sum(tableid + colid + rowid) AS BIGINT) AS total FROM cells GROUP BY tokenized")(lambda s, d: index.flat_ints(_cells(s, d)))
register("idx_pieces", f"WITH {CELLS} SELECT tokenized, tableid, colid, CAST(rowid // 65536 AS BIGINT) AS piece, count(*) AS n FROM cells GROUP BY ALL")(lambda s, d: index.pieces(_cells(s, d)).select("tokenized", "tableid", "colid", "piece", F.size("locs").cast("long").alias("n")))
register("idx_flat_lists", f"WITH {CELLS} SELECT tokenized, tableid, colid, CAST(rowid // 65536 AS BIGINT) AS piece, string_agg(tableid || ' ' || colid || ' ' || rowid, ' ' ORDER BY rowid) AS ints FROM cells GROUP BY ALL")(lambda s, d: index.flat_lists(_cells(s, d)).select("tokenized", "tableid", "colid", "piece", F.array_join("ints", " ").alias("ints")))
register("idx_ordered", f"WITH {CELLS} SELECT tokenized, tableid, colid, CAST(rowid // 65536 AS BIGINT) AS piece, count(*) AS n, min(rowid) AS first_rowid FROM cells GROUP BY ALL")(lambda s, d: index.ordered_pieces(_cells(s, d)).select("tokenized", "tableid", "colid", "piece", F.size("locs").cast("long").alias("n"), F.col("locs")[0]["rowid"].alias("first_rowid")))
register("idx_explode_roundtrip", f"WITH {CELLS} SELECT * FROM cells")(lambda s, d: index.exploded(index.pieces(_cells(s, d))))
register("lookup_single", f"WITH {CELLS} SELECT * FROM cells WHERE tokenized = 'ASIA'")(lambda s, d: index.lookup(_cells(s, d), "ASIA"))
register("lookup_batch", f"WITH {CELLS}, {PROBES_SQL} SELECT key, tableid, colid, rowid FROM probes JOIN cells ON key = tokenized")(lambda s, d: index.lookup_batch(_cells(s, d), _probes(s)))
register("lookup_missing", f"WITH {CELLS}, {PROBES_SQL} SELECT key FROM probes WHERE key NOT IN (SELECT tokenized FROM cells)")(lambda s, d: index.missing(_cells(s, d), _probes(s)))
register("lookup_positions", f"WITH {CELLS}, {PROBES_SQL}, p AS (SELECT tokenized, row_number() OVER (ORDER BY tokenized, tableid, colid, rowid) - 1 AS pos FROM cells) SELECT key, min(pos) AS first_pos, max(pos) AS last_pos FROM probes JOIN p ON key = tokenized GROUP BY key")(lambda s, d: index.text_positions(_cells(s, d), _probes(s)))
register("count_occurrences", f"WITH {CELLS}, {PROBES_SQL} SELECT key, count(tokenized) AS n FROM probes LEFT JOIN cells ON key = tokenized GROUP BY key")(lambda s, d: index.occurrences(_cells(s, d), _probes(s)))
register("keys_sample_positions", f"WITH {CELLS}, k AS (SELECT tokenized AS key, row_number() OVER (ORDER BY tokenized) - 1 AS pos, count(*) OVER () AS m FROM (SELECT DISTINCT tokenized FROM cells)) SELECT draw, CAST(pos AS BIGINT) AS pos, key FROM range(10000) r(draw) JOIN k ON pos = draw * 7919 % m")(lambda s, d: index.keys_at(_cells(s, d), 10_000, 7919))
register("keys_sample_random", None)(lambda s, d: index.sampled_keys(_cells(s, d)))

# profiles

register("profile_info", f"WITH {CELLS} SELECT count(*) AS rows, count(DISTINCT tokenized) AS distinct_values, round(count(*)::DOUBLE / count(DISTINCT tokenized), 6) AS mean_cardinality, round(sum(octet_length(encode(tokenized)))::DOUBLE / count(*), 6) AS mean_text_bytes, round(sum(tableid)::DOUBLE / count(*), 6) AS mean_tableid, round(sum(colid)::DOUBLE / count(*), 6) AS mean_colid, round(sum(rowid)::DOUBLE / count(*), 6) AS mean_rowid FROM cells")(lambda s, d: profile.info(_cells(s, d)))
for _short, _col in (("rows", "rowid"), ("cols", "colid"), ("tables", "tableid")):
    register(f"hist_linear_{_short}", f"WITH {CELLS}, h AS (SELECT least({_col} // 16, 255) AS bin, count(*) AS n FROM cells GROUP BY 1) SELECT b AS bin, coalesce(n, 0) AS n FROM range(256) r(b) LEFT JOIN h ON bin = b")(lambda s, d, c=_col: profile.linear_histogram(_cells(s, d), c))
    register(f"hist_bitwidth_{_short}", f"WITH {CELLS}, h AS (SELECT CASE WHEN {_col} <= 1 THEN 1 ELSE length(bin({_col})) END AS w, count(*) AS n FROM cells GROUP BY 1) SELECT b AS width, coalesce(n, 0) AS n FROM range(1, 65) r(b) LEFT JOIN h ON w = b")(lambda s, d, c=_col: profile.width_histogram(_cells(s, d), c))
_CARDS = {"lineitem": lake.COLUMNS_OF["lineitem"]}
_CARDS_SQL = "c AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS col_idx, '{c}' AS name, count(DISTINCT {c}) AS card FROM lineitem" for i, c in enumerate(_CARDS["lineitem"])) + ")"
_cards = lambda s, d: profile.cardinalities(lake.table(s, d, "lineitem"), _CARDS["lineitem"])
register("column_cardinality_order", f"WITH {_CARDS_SQL} SELECT col_idx, name, card, row_number() OVER (ORDER BY card, col_idx) AS rank_up, row_number() OVER (ORDER BY card DESC, col_idx DESC) AS rank_down FROM c")(lambda s, d: _cards(s, d).selectExpr("col_idx", "name", "card", "CAST(row_number() OVER (ORDER BY card, col_idx) AS BIGINT) AS rank_up", "CAST(row_number() OVER (ORDER BY card DESC, col_idx DESC) AS BIGINT) AS rank_down"))
register("columns_below_topk", f"WITH {_CARDS_SQL} SELECT * FROM c WHERE card < greatest(5, (SELECT card FROM c ORDER BY card DESC LIMIT 1 OFFSET 2))")(lambda s, d: profile.below_top(_cards(s, d), 3, 5))
register("total_attribute_values", f"WITH {_CARDS_SQL} SELECT CAST(sum(card) AS BIGINT) AS total_values FROM c")(lambda s, d: profile.total_values(_cards(s, d)))
_VALUES_SQL = "u AS (SELECT 'type' AS col, p_type AS v FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part)"
_values = lambda s, d: lake.table(s, d, "part").selectExpr("stack(3, 'type', p_type, 'brand', p_brand, 'size', CAST(p_size AS STRING)) AS (col, v)")
register("csv_freq_codes", f"WITH {_VALUES_SQL} SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, v DESC) - 1 AS code FROM u GROUP BY col, v")(lambda s, d: profile.frequency_codes(_values(s, d), "col", "v"))
register("csv_domain_codes", f"WITH {_VALUES_SQL} SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS code FROM (SELECT DISTINCT col, v FROM u)")(lambda s, d: profile.domain_codes(_values(s, d), "col", "v"))

# order, samples

register("sort_order_rank", f"WITH {CELLS} SELECT *, row_number() OVER (ORDER BY tokenized, tableid, colid, rowid) - 1 AS rank FROM cells")(lambda s, d: numbered(_cells(s, d), order.CELL_ORDER, "rank"))
register("sort_stop_after", f"WITH {CELLS} SELECT * FROM cells ORDER BY tokenized, tableid, colid, rowid LIMIT 1000")(lambda s, d: order.first_rows(_cells(s, d), order.CELL_ORDER, 1000))
_UNSORTED = "v AS (SELECT c_custkey - 1 AS pos, c_mktsegment AS cur, lag(c_mktsegment) OVER (ORDER BY c_custkey) AS prev FROM customer)"
_customers = lambda s, d: lake.table(s, d, "customer").selectExpr("c_custkey - 1 AS pos", "c_mktsegment AS v")
register("check_sorted_violations", f"WITH {_UNSORTED} SELECT pos, prev, cur FROM v WHERE prev > cur")(lambda s, d: order.violations(_customers(s, d), "pos", "v", 100))
register("check_sorted_first", f"WITH {_UNSORTED} SELECT pos, prev, cur FROM v WHERE prev > cur ORDER BY pos LIMIT 1")(lambda s, d: order.first_violation(_customers(s, d), "pos", "v"))
register("sample_hash_10pct", f"WITH {CELLS} SELECT * FROM cells WHERE (tableid * 31 + colid * 17 + rowid * 7919) % 10000 < 1000")(lambda s, d: order.hash_sample(_cells(s, d), 0.1))
register("sample_random", None)(lambda s, d: order.random_sample(_cells(s, d), 0.1))
_STORED = ["lake", "lake-0.5", "lake-0.1", "lake-0.01"]
register("sample_pick_best", "SELECT w::DOUBLE AS wanted, min(f)::DOUBLE AS stored, round(w::DOUBLE / min(f)::DOUBLE, 9) AS remaining FROM (VALUES (0.7), (0.3), (0.1), (0.05), (0.002)) x(w) JOIN (VALUES (1.0), (0.5), (0.1), (0.01)) y(f) ON f >= w GROUP BY w")(lambda s, d: order.pick_sample(s.createDataFrame([(n,) for n in _STORED], "name string").select(order.stored_factor(F.col("name")).alias("factor")), s.createDataFrame([(x,) for x in (0.7, 0.3, 0.1, 0.05, 0.002)], "wanted double")))
register("shuffle_in_blocks", f"WITH {SORTED_SQL} SELECT * FROM a")(lambda s, d: order.shuffle_in_blocks(_sorted(s, d), "pos", 16, by=("array_id",)))

# scalars

register("scalar_widths", f"SELECT DISTINCT v, {WIDTH.format('v')} AS w0, CAST(CASE WHEN v <= 1 THEN 1 ELSE length(bin(v)) END AS BIGINT) AS w1, CAST({VB.format('v')} AS BIGINT) AS vb, CAST({BW.format('v')} AS BIGINT) AS bw, (v + 6) // 7 AS up, v & 15 AS low, v >> 4 AS high FROM (SELECT CAST(l_orderkey * l_partkey AS BIGINT) AS v FROM lineitem)")(lambda s, d: lake.table(s, d, "lineitem").selectExpr("l_orderkey * l_partkey AS v").distinct().select("v", width(F.col("v")).alias("w0"), width_least_one(F.col("v")).alias("w1"), varint_bytes(F.col("v")).alias("vb"), byte_width(F.col("v")).alias("bw"), ceil_div(F.col("v"), 7).alias("up"), low_high(F.col("v"), 4)[0].alias("low"), low_high(F.col("v"), 4)[1].alias("high")))
register("scalar_text", "SELECT p_partkey, list_extract(string_split(replace(p_name, ' ', '/'), '/'), -1) AS base, len([x FOR x IN regexp_split_to_array(p_type, '[ #]') IF x <> '']) AS parts FROM part")(lambda s, d: lake.table(s, d, "part").select("p_partkey", base_name(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("base"), F.size(split_any(F.col("p_type"), " #")).cast("long").alias("parts")))

# dictionaries

_dict = lambda s, d, b=16: dictionary.blocks(_cells(s, d).select(F.col("tokenized").alias("key")).distinct(), b)
_K16, _K8 = KEYS16.format(16, "cells"), KEYS16.format(8, "cells")
_LCP = "CAST(coalesce(list_max([i FOR i IN range(0, least(length({0}), length({1})) + 1) IF left({0}, i) = left({1}, i)]), 0) // 2 AS BIGINT)"
def _key_at(spark: SparkSession, held: DataFrame) -> DataFrame:
    return dictionary.key_at(held, spark.range(held.count()).select(F.col("id").alias("pos")))


register("dict_blocks", f"WITH {CELLS}, {_K16} SELECT block_id, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM k GROUP BY block_id")(lambda s, d: dictionary.block_heads(_dict(s, d)))
register("dict_front_bytes", f"WITH {CELLS}, {_K8}, p AS (SELECT block_id, min(hex(encode(key))) AS x, max(hex(encode(key))) AS y FROM k GROUP BY block_id), q AS (SELECT block_id, {_LCP.format('x', 'y')} AS prefix FROM p) SELECT block_id, prefix, CAST({VB.format('prefix')} + prefix + sum({VB.format('(octet_length(encode(key)) - prefix)')} + octet_length(encode(key)) - prefix) AS BIGINT) AS bytes FROM k JOIN q USING (block_id) GROUP BY block_id, prefix")(lambda s, d: dictionary.front_sizes(_dict(s, d, 8)))
register("dict_incr_bytes", f"WITH {CELLS}, {_K16}, p AS (SELECT block_id, octet_length(encode(key)) AS n, hex(encode(key)) AS x, lag(hex(encode(key))) OVER (PARTITION BY block_id ORDER BY pos) AS y FROM k), q AS (SELECT block_id, n, y IS NULL AS first, CASE WHEN y IS NULL THEN 0 ELSE {_LCP.format('x', 'y')} END AS lcp FROM p) SELECT block_id, CAST(sum(lcp) AS BIGINT) AS shared, CAST(sum(CASE WHEN first THEN {VB.format('n')} + n ELSE {VB.format('lcp')} + {VB.format('(n - lcp)')} + n - lcp END) AS BIGINT) AS bytes FROM q GROUP BY block_id")(lambda s, d: dictionary.incremental_sizes(_dict(s, d)))
register("dict_lookup_block", f"WITH {CELLS}, {_K16}, {PROBES_SQL} SELECT key, block_id, pos FROM probes JOIN k USING (key)")(lambda s, d: dictionary.find(_dict(s, d), _probes(s)))
register("dict_key_at", f"WITH {CELLS}, {_K16} SELECT pos, key FROM k")(lambda s, d: _key_at(s, _dict(s, d)))
register("dict_value_at", f"WITH {CELLS}, {_K16} SELECT pos, key, CAST(length(key) AS BIGINT) AS value FROM k")(lambda s, d: dictionary.with_values(_dict(s, d), _cells(s, d).select(F.col("tokenized").alias("key")).distinct().withColumn("value", F.length("key").cast("long"))))
register("shared_prefixes", "WITH w AS (SELECT n_name AS a, lag(n_name) OVER (ORDER BY n_name) AS b FROM nation), h AS (SELECT a, b, hex(encode(a)) AS x, hex(encode(b)) AS y FROM w WHERE b IS NOT NULL) SELECT a, b, " + _LCP.format("x", "y") + " AS n FROM h")(lambda s, d: lake.table(s, d, "nation").selectExpr("n_name AS a", "lag(n_name) OVER (ORDER BY n_name) AS b").where("b IS NOT NULL").select("a", "b", shared_prefix(F.col("a"), F.col("b")).alias("n")))

# posting and layout sizes

_POST = f"{CELLS}, s AS (SELECT tokenized, count(*) AS n, sum({' + '.join(VB.format(c) for c in index.LOCATION)}) AS vb, sum({' + '.join(BW.format(c) for c in index.LOCATION)}) AS bw FROM cells GROUP BY tokenized), p AS (SELECT tokenized, n, CAST(vb AS BIGINT) AS vbyte, CAST(bw + (3 * n + 3) // 4 AS BIGINT) AS gve, CAST(4 * ((4 + bw + (3 * n + 3) // 4 + 3) // 4) AS BIGINT) AS stream FROM s)"
for _name in ("vbyte", "gve", "stream"):
    register(f"posting_{_name}_bytes", f"WITH {_POST} SELECT tokenized, n, {_name} AS bytes FROM p")(lambda s, d, c=_name: codec_sizes.posting_bytes(_cells(s, d)).select("tokenized", "n", F.col(c).cast("long").alias("bytes")))
register("posting_split_bytes", f"WITH {CELLS}, x AS (SELECT tokenized, colid, rowid, tableid - coalesce(lag(tableid) OVER (PARTITION BY tokenized ORDER BY tableid, colid, rowid), 0) AS tableid FROM cells), y AS (SELECT tokenized, count(*) AS n, sum({BW.format('tableid')}) AS t, sum({BW.format('colid')}) AS c, sum({BW.format('rowid')}) AS r FROM x GROUP BY tokenized) SELECT run, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b + (n + 3) // 4) AS BIGINT) AS bytes FROM (SELECT 'tableid' AS run, n, t AS b FROM y UNION ALL SELECT 'colid', n, c FROM y UNION ALL SELECT 'rowid', n, r FROM y) GROUP BY run")(lambda s, d: codec_sizes.split_bytes(_cells(s, d)))
register("arena_offsets", f"WITH {_POST} SELECT tokenized, CAST(sum(gve) OVER (ORDER BY tokenized) - gve AS BIGINT) AS start, gve AS length FROM p")(lambda s, d: layouts.arena_offsets(_cells(s, d)))


def _layout_sql() -> str:
    """Sizes of every layout without short keys and pfor, written out: payloads of pieces (once) and of cells (each), then keys."""
    gw = lambda n, w: f"(4 * ((4 + ({n} + 3) // 4 + {w} + 3) // 4))"
    framed = lambda x: f"({VB.format(x)} + {x})"
    sums = f"max({BW.format('tableid')}) AS t, sum({BW.format('colid')}) AS c, sum({BW.format('rowid')}) AS r, sum({VB.format('colid')} + {VB.format('rowid')}) AS v"
    payload = f"{VB.format('(3 * n)')} AS head, 12 * n AS plain, {gw('(3 * n)', '(n * t + c + r)')} AS gve, {framed(gw('n', '(t + n - 1)'))} + {framed(gw('(2 * n)', '(c + r)'))} AS gve_split, {framed('v')} + {framed(gw('n', '(n * t)'))} AS vbyte"
    total = "count(*) AS payloads, sum(head + plain) AS plain, sum(head + gve) AS gve, sum(head + gve_split) AS gve_split, sum(head + vbyte) AS vbyte"
    front = lambda k: f"SELECT sum(b) FROM (SELECT {VB.format('prefix')} + prefix + sum({VB.format('(octet_length(encode(key)) - prefix)')} + octet_length(encode(key)) - prefix) AS b FROM {k} JOIN (SELECT block_id, CASE WHEN x = y THEN length(x) // 2 ELSE {_LCP.format('x', 'y')} END AS prefix FROM (SELECT block_id, min(hex(encode(key))) AS x, max(hex(encode(key))) AS y FROM {k} GROUP BY block_id)) USING (block_id) GROUP BY block_id, prefix)"
    incr = lambda k: f"SELECT sum(CASE WHEN first THEN {framed('n')} ELSE {VB.format('lcp')} + {framed('(n - lcp)')} END) FROM (SELECT n, y IS NULL AS first, CASE WHEN y IS NULL THEN 0 WHEN x = y THEN n ELSE {_LCP.format('x', 'y')} END AS lcp FROM (SELECT octet_length(encode(key)) AS n, hex(encode(key)) AS x, lag(hex(encode(key))) OVER (PARTITION BY block_id ORDER BY pos) AS y FROM {k}))"
    each = lambda n: f"(SELECT tokenized AS key, pos, pos // {n} AS block_id FROM (SELECT tokenized, row_number() OVER (ORDER BY tokenized) - 1 AS pos FROM cells))"
    once = each("{}").replace("FROM cells", "FROM (SELECT DISTINCT tokenized FROM cells)").format
    parts = [
        CELLS,
        f"once8 AS {once(8)}, once16 AS {once(16)}, each8 AS {each(8)}",
        f"p AS (SELECT count(*) AS n, {sums} FROM cells GROUP BY tokenized, tableid, colid, rowid // {index.PIECE}), q AS (SELECT 1 AS n, {sums} FROM cells GROUP BY tokenized, tableid, colid, rowid)",
        f"po AS (SELECT {total} FROM (SELECT {payload} FROM p)), pe AS (SELECT {total} FROM (SELECT {payload} FROM q))",
        "size AS (SELECT count(*) AS cells, count(DISTINCT tokenized) AS keys, sum(octet_length(encode(tokenized))) AS plain_each, (SELECT sum(octet_length(encode(key))) FROM once8) AS plain_once FROM cells)",
        f"coded AS (SELECT ({front('once8')}) AS front_once, ({front('each8')}) AS front_each, ({incr('once16')}) AS incr_once, ({incr('each8')}) AS incr_each)",
    ]
    rows = []
    #: name, keys, block, postings: as the layouts are defined, not read from the table of layouts
    for names, keys, block, posting, end in (
        ("baseline baselinex", "plain", 1, "plain", "each"), ("ns ns_arena", "plain", 1, "gve", "each"), ("frontcoding", "front", 8, "plain", "each"), ("incr", "incr", 8, "plain", "each"),
        ("dedup_hash dedup_btree", "plain", 1, "plain", "once"), ("ns+dedup", "plain", 1, "gve", "once"), ("frontcoding+dedup", "front", 8, "plain", "once"), ("incr+dedup", "incr", 16, "plain", "once"),
        ("incr+dedup+ns incr_adv+dedup+ns", "incr", 16, "gve", "once"), ("incr_adv+dedup+ns_adv", "incr", 16, "gve_split", "once"), ("vbyte+ns+dedup vbyte+arena+ns+dedup", "plain", 1, "vbyte", "once"), ("vbyte+ns+incr+dedup", "incr", 16, "vbyte", "once"),
    ):
        n = "keys" if end == "once" else "cells"
        rows += [f"SELECT '{x}' AS layout, cells, {n} AS keys, CAST(({n} + {block - 1}) // {block} AS BIGINT) AS blocks, p{end[0]}.payloads AS payloads, CAST({keys}_{end} AS BIGINT) AS key_bytes, CAST(p{end[0]}.{posting} AS BIGINT) AS posting_bytes FROM size, coded, po, pe" for x in names.split()]
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(rows)


register("layout_summary", _layout_sql())(lambda s, d: layouts.modelled_sizes(_wide(s, d)))
register("layout_bytes", _layout_sql())(lambda s, d: encoded.real_sizes(_cells(s, d), layouts.MODELLED))
register("layout_bytes_learned", None)(lambda s, d: encoded.real_sizes(_cells(s, d), [n for n in layouts.LAYOUTS if n not in layouts.MODELLED]))

for _n in layouts.LAYOUTS:
    register(f"layout_roundtrip_{_n}", f"WITH {CELLS} SELECT * FROM cells")(lambda s, d, n=_n: encoded.round_trip_tables(_wide(s, d), n))
for _n, _layout in (("lookup_encoded", "pfor_split+dedup"), ("lookup_in_arena", "ns_arena"), ("lookup_by_short_key", "smaz+ns+dedup"), ("lookup_in_front_blocks", "frontcoding"), ("lookup_in_incremental_blocks", "incr_adv+dedup+ns_adv")):
    register(_n, f"WITH {CELLS}, {PROBES_SQL} SELECT tokenized, tableid, colid, rowid FROM cells WHERE tokenized IN (SELECT key FROM probes)")(lambda s, d, x=_layout: encoded.lookup(encoded.build(_wide(s, d), x), _probes(s)))

# arrays

register("delta", f"WITH {SORTED_SQL} SELECT array_id, pos, v - coalesce(lag(v) OVER (PARTITION BY array_id ORDER BY pos), 0) AS v FROM a")(lambda s, d: arrays.delta(_sorted(s, d)))
register("delta_simd4", f"WITH {SORTED_SQL} SELECT array_id, pos, v - coalesce(lag(v, 4) OVER (PARTITION BY array_id ORDER BY pos), 0) AS v FROM a")(lambda s, d: arrays.delta_stride(_sorted(s, d)))
register("delta_inverse", f"WITH {SORTED_SQL} SELECT * FROM a")(lambda s, d: arrays.undo_delta(arrays.delta(_sorted(s, d))))
register("delta_simd4_inverse", f"WITH {SORTED_SQL} SELECT * FROM a")(lambda s, d: arrays.undo_delta_stride(arrays.delta_stride(_sorted(s, d))))
_GAPS = f"{SORTED_SQL}, g AS (SELECT array_id, v - lag(v) OVER (PARTITION BY array_id ORDER BY pos) - 1 AS v FROM a), h AS (SELECT v FROM g WHERE v IS NOT NULL)"
register("gap_width_hist", f"WITH {_GAPS} SELECT {WIDTH.format('v')} AS width, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM h), 9) AS share FROM h GROUP BY 1")(lambda s, d: profile.shares(arrays.gaps(_sorted(s, d)), width(F.col("v"))))
register("array_length_hist", f"WITH {SORTED_SQL}, l AS (SELECT array_id, count(*) AS v FROM a GROUP BY array_id) SELECT {WIDTH.format('v')} AS width, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM l), 9) AS share FROM l GROUP BY 1")(lambda s, d: profile.shares(arrays.lengths(_sorted(s, d)), width(F.col("n"))))
register("entropy_bits", f"WITH {MIXED_SQL}, c AS (SELECT v, count(*)::DOUBLE AS c FROM a GROUP BY v), t AS (SELECT sum(c) AS t FROM c) SELECT CAST(sum(c) AS BIGINT) AS n, round(-sum(c / t * log2(c / t)), 6) AS shannon, round(sum(c / t * {WIDTH.format('v')}), 6) AS databits FROM c, t")(lambda s, d: profile.entropy(_mixed(s, d), "v"))
register("value_width_hist", f"WITH {MIXED_SQL} SELECT {WIDTH.format('v')} AS width, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM a), 9) AS share FROM a GROUP BY 1")(lambda s, d: profile.shares(_mixed(s, d), width(F.col("v"))))
for _n, _delta, _least in (("entropy_tool", True, 2), ("entropy_tool_nodelta", False, 500)):
    register(_n, f"WITH {SORTED_SQL}, k AS (SELECT *, count(*) OVER (PARTITION BY array_id) AS n FROM a), d AS (SELECT array_id, {'v - coalesce(lag(v) OVER (PARTITION BY array_id ORDER BY pos), 0)' if _delta else 'v'} AS v FROM k WHERE n >= {_least}), c AS (SELECT v, count(*)::DOUBLE AS c FROM d GROUP BY v), t AS (SELECT sum(c) AS t FROM c) SELECT (SELECT count(DISTINCT array_id) FROM d) AS arrays, CAST(sum(c) AS BIGINT) AS n, round(-sum(c / t * log2(c / t)), 6) AS shannon, round(sum(c / t * {WIDTH.format('v')}), 6) AS databits FROM c, t")(lambda s, d, x=_delta, n=_least: profile.entropy_of_arrays(_sorted(s, d), x, n))
register("lookahead_widths", f"WITH {MIXED_SQL}, l AS (SELECT array_id, pos // 32 AS blk, list(v ORDER BY pos) AS x FROM a GROUP BY 1, 2) SELECT array_id, blk, CAST(list_min([w FOR w IN range(1, 31) IF list_max(x[1:greatest(1, 32 // w)]) < (1 << w)]) AS BIGINT) AS width FROM l")(lambda s, d: _mixed(s, d).groupBy("array_id", F.floor(F.col("pos") / 32).cast("long").alias("blk")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x")).select("array_id", "blk", lookahead_width(F.transform("x", lambda y: y.v)).alias("width")))
register("benchmark_arrays", f"WITH {SORTED_SQL}, l AS (SELECT array_id, count(*) AS n FROM a GROUP BY array_id HAVING count(*) BETWEEN 10 AND 100000 ORDER BY array_id LIMIT 9) SELECT array_id, pos // 64 AS piece, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM a JOIN l USING (array_id) GROUP BY 1, 2")(lambda s, d: arrays.as_pieces(arrays.selected(_sorted(s, d), 10, 100_000, 9), 64).select("array_id", "piece", F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda x, y: x + y).alias("total")))
register("block_max_bits", f"WITH {MIXED_SQL}, b AS (SELECT array_id * 1000000 + pos // 128 AS block, bit_or(v) AS o FROM a GROUP BY 1) SELECT block, {WIDTH.format('o')} AS bits FROM b")(lambda s, d: profile.max_bits(_mixed(s, d).selectExpr("array_id * 1000000 + CAST(pos DIV 128 AS BIGINT) AS block", "v"), "block", "v"))
register("unsorted_arrays", f"WITH {MIXED_SQL}, x AS (SELECT array_id, v < lag(v) OVER (PARTITION BY array_id ORDER BY pos) AS down FROM a) SELECT DISTINCT array_id FROM x WHERE down")(lambda s, d: arrays.unsorted_arrays(_mixed(s, d)))
_PIECES = 100
register("split_long_arrays", f"WITH {SORTED_SQL}, x AS (SELECT array_id, pos // {_PIECES} AS piece, v FROM a) SELECT array_id, piece, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM x GROUP BY array_id, piece")(lambda s, d: arrays.as_pieces(_sorted(s, d), _PIECES).select("array_id", "piece", F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda x, y: x + y).alias("total")))
register("length_classes", f"WITH {TOKENS}, l AS (SELECT rowid, count(*) AS v FROM tokens GROUP BY rowid) SELECT {WIDTH.format('v')} AS class, count(*) AS n FROM l GROUP BY 1")(lambda s, d: _tokens(s, d).groupBy("rowid").count().groupBy(width(F.col("count")).alias("class")).agg(F.count("*").alias("n")))
register("arrays_by_length", f"WITH {SORTED_SQL} SELECT array_id, count(*) AS n FROM a GROUP BY array_id HAVING count(*) BETWEEN 100 AND 600")(lambda s, d: arrays.lengths(arrays.selected(_sorted(s, d), 100, 600)))

# codec sizes and choices

_TABLE = f"{MIXED_SQL}, w AS (SELECT array_id, pos // 128 AS blk, {WIDTH.format('v')} AS w FROM a), m AS (SELECT array_id, blk, max(w) AS maxb, count(*) AS size FROM w GROUP BY ALL HAVING count(*) = 128), f AS (SELECT array_id, blk, w, count(*) AS n FROM w GROUP BY ALL), e AS (SELECT m.array_id, m.blk, b, maxb, size, coalesce(CAST(sum(coalesce(n, 0)) OVER (PARTITION BY m.array_id, m.blk ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS e FROM m CROSS JOIN range(0, 33) r(b) LEFT JOIN f ON f.array_id = m.array_id AND f.blk = m.blk AND f.w = b)"
_widths = lambda s, d: codec_sizes.width_table(_mixed(s, d))


def _choice(cost: str) -> str:
    return f"WITH {_TABLE}, c AS (SELECT array_id, blk, b, e, maxb, CASE WHEN b = maxb THEN b * 128 ELSE {cost} END AS cost FROM e WHERE b <= maxb) SELECT array_id, blk, b, e, maxb, cost FROM c QUALIFY row_number() OVER (PARTITION BY array_id, blk ORDER BY cost, b DESC) = 1"


register("codec_fastpfor_choice", _choice("8 * e + e * (maxb - b) + b * 128 + 8 - CASE WHEN maxb - b = 1 THEN e ELSE 0 END"))(lambda s, d: codec_sizes.fastpfor_choice(_widths(s, d)))
register("codec_fastpfor_simd_choice", _choice("8 * e + e * (maxb - b) + b * 128 + 8"))(lambda s, d: codec_sizes.fastpfor_choice(_widths(s, d), scalar=False))
register("codec_simplepfor_choice", _choice("8 * e + e * (maxb - b) + b * 128"))(lambda s, d: codec_sizes.simplepfor_choice(_widths(s, d)))
register("codec_newpfor_choice", f"WITH {_TABLE}, c AS (SELECT array_id, blk, maxb, min({{'b': b, 'e': e}}) FILTER ((b < 14 OR b IN (16, 20)) AND 10 * e <= 128 AND maxb <= 28 + b) AS x FROM e GROUP BY ALL) SELECT array_id, blk, coalesce(x.b, 32) AS b, coalesce(x.e, 0) AS e, maxb FROM c")(lambda s, d: codec_sizes.newpfor_choice(_widths(s, d)))
register("codec_pfor_cost", f"WITH {_TABLE}, s AS (SELECT array_id, b, sum(e)::DOUBLE AS e, sum(e)::DOUBLE / sum(size)::DOUBLE AS r FROM e GROUP BY ALL), c AS (SELECT array_id, b, round(b + 32 * CASE WHEN e > 0 THEN greatest(r, (r * 128 - 1) / (r * pow(2.0, b))) ELSE r END, 9) AS cost FROM s) SELECT array_id, b, cost FROM c QUALIFY row_number() OVER (PARTITION BY array_id ORDER BY cost, b) = 1")(lambda s, d: codec_sizes.pfor_cost(_widths(s, d)))
for _n, _m in (("codec_binarypack_words", 8), ("codec_binarypack16_words", 16), ("codec_bp128_words", 32)):
    register(_n, f"WITH {MIXED_SQL}, w AS (SELECT array_id, pos // {4 * _m} AS blk, pos % {4 * _m} // {_m} AS m, max({WIDTH.format('v')}) AS b, count(*) AS n FROM a GROUP BY 1, 2, 3) SELECT array_id, blk, CAST(1 + sum(({_m} * b + 31) // 32) AS BIGINT) AS words FROM w GROUP BY array_id, blk HAVING sum(n) = {4 * _m}")(lambda s, d, m=_m: codec_sizes.binary_packing(_mixed(s, d), m))
register("codec_simdbp_words", f"WITH {MIXED_SQL}, w AS (SELECT array_id, pos // 128 AS blk, max({WIDTH.format('v')}) AS b FROM a GROUP BY 1, 2 HAVING count(*) = 128) SELECT array_id, CAST(1 + 4 * ((count(*) + 15) // 16) + sum(4 * b) AS BIGINT) AS words FROM w GROUP BY array_id")(lambda s, d: codec_sizes.simd_packing(_mixed(s, d)))
_SUMS = f"{MIXED_SQL}, s AS (SELECT array_id, count(*) AS n, CAST(sum({VB.format('v')}) AS BIGINT) AS vb, CAST(sum({BW.format('v')}) AS BIGINT) AS bw FROM a GROUP BY array_id, pos // 65536), x AS (SELECT 'copy' AS codec, array_id, n, n AS words FROM s" + "".join(f" UNION ALL SELECT '{c}', array_id, n, (vb + 3) // 4 FROM s" for c in ("varint", "vbyte", "maskedvbyte")) + "".join(f" UNION ALL SELECT '{c}', array_id, n, (4 + (n + 3) // 4 + bw + 3) // 4 FROM s" for c in ("streamvbyte", "varintgb")) + ")"
_SUMMED = f"WITH {_SUMS} SELECT codec, count(DISTINCT array_id) AS arrays, CAST(sum(n) AS BIGINT) AS n, CAST(sum(words) AS BIGINT) AS words, round(sum(words)::DOUBLE * 32 / sum(n)::DOUBLE, 6) AS bits_per_int FROM x GROUP BY codec"
register("codec_summary", _SUMMED)(lambda s, d: codec_sizes.array_words(_mixed(s, d)))
_trips = lambda s, d, names=None: codecs.summary(codecs.round_trip(arrays.as_pieces(_mixed(s, d)), names))
register("codec_summary_real", _SUMMED)(lambda s, d: _trips(s, d, ["copy", "varint", "vbyte", "maskedvbyte", "streamvbyte", "varintgb"]).drop("mismatches"))
for _n in codecs.CODECS:
    register(f"codec_roundtrip_{_n}", f"WITH {MIXED_SQL} SELECT '{_n}' AS codec, count(DISTINCT array_id) AS arrays, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM a")(lambda s, d, n=_n: _trips(s, d, [n]).select("codec", "arrays", "n", "mismatches"))

_DELTA = ["varint", "fastbinarypacking32", "simdfastpfor128", "vsencoding", "snappy"]
_DELTA_SQL = f"c AS (SELECT unnest({_DELTA}) AS codec)"
register("codec_roundtrip_delta", f"WITH {SORTED_SQL}, {_DELTA_SQL} SELECT codec, count(DISTINCT array_id) AS arrays, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM a, c GROUP BY codec")(lambda s, d: codecs.summary(codecs.round_trip(arrays.as_pieces(_sorted(s, d)), _DELTA, delta=True)).select("codec", "arrays", "n", "mismatches"))
register("codec_delta_refused", f"WITH {MIXED_SQL}, x AS (SELECT array_id, pos // 65536 AS piece, v < lag(v) OVER (PARTITION BY array_id, pos // 65536 ORDER BY pos) AS down FROM a) SELECT array_id, piece, count(*) AS n FROM x GROUP BY array_id, piece HAVING bool_or(coalesce(down, false))")(lambda s, d: codecs.round_trip(arrays.as_pieces(_mixed(s, d)), ["copy"], delta=True).where("words IS NULL").select("array_id", "piece", "n"))

# generators: compared by shape in tests

register("gen_uniform", None)(lambda s, d: generators.uniform(s, 4096, 1 << 17))
register("gen_clustered", None)(lambda s, d: ship(s) or generators.clustered(s, 4096, 1 << 20))
register("gen_benchmark", None)(lambda s, d: ship(s) or generators.benchmark_arrays(s, "clustersparse", count=256))
register("gen_zipf", None)(lambda s, d: ship(s) or generators.zipf(s, 10_000, 1.0, 1 << 12))

# extensions

register("ext_column_overlap", f"WITH {CELLS}, k AS (SELECT DISTINCT tokenized, tableid, colid FROM cells) SELECT a.tableid AS tableid_a, a.colid AS colid_a, b.tableid AS tableid_b, b.colid AS colid_b, count(*) AS shared FROM k a JOIN k b USING (tokenized) WHERE (a.tableid, a.colid) < (b.tableid, b.colid) GROUP BY ALL")(lambda s, d: _overlap(_cells(s, d)))
register("ext_profile_cube", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda s, d: lake.table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity")))
register("ext_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(lambda s, d: windows.counts(lake.table(s, d, "events")))
register("ext_event_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM y GROUP BY user_id, k")(lambda s, d: windows.sessions(lake.table(s, d, "events")))

# the queries of the lake's cells over all of its tables. No SQL: the engines print the floats of a vector in different ways

OVER_ALL = ["lake_cells", "keys_sample_random", "sample_random", *[n for n, sql in ORACLES.items() if CELLS in sql]]
for _n in OVER_ALL:
    register(f"{_n}_all", None)(_over_all(QUERIES[_n]))


def _overlap(cells: DataFrame) -> DataFrame:
    """(tableid_a, colid_a, tableid_b, colid_b, shared): distinct texts that two columns share; candidates for joins.

    A text contributes the pairs of the columns that hold it, at most as many as the lake has columns, squared.
    """
    held = cells.groupBy("tokenized").agg(F.array_sort(F.collect_set(F.struct("tableid", "colid"))).alias("cols")).where(F.size("cols") > 1)
    first = held.select("cols", F.explode("cols").alias("a"))
    pairs = first.select("a", F.explode("cols").alias("b")).where("a < b")
    return pairs.groupBy(F.col("a.tableid").alias("tableid_a"), F.col("a.colid").alias("colid_a"), F.col("b.tableid").alias("tableid_b"), F.col("b.colid").alias("colid_b")).agg(F.count("*").alias("shared"))
