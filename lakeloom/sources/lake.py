"""The lake: tables flattened to one row per cell (tokenized, tableid, colid, rowid)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..ranges import numbered
from ..session import ship

#: Tables of the lake by tableid, with the key that is unique and integer (None: rows are numbered by ORDER_OF).
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
KEY_OF = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}
ORDER_OF = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "conversations": ["conv_id", "turn"]}
COLUMNS_OF = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
#: Tables with texts of any length.
LONG = {"documents", "embeddings", "pages", "benchmark", "conversations"}
DOUBLES = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
INTEGERS = {"byte", "short", "integer", "long"}
#: The tables of the registered queries that have SQL: those that flatten without a shuffle. Queries named ..._all take TABLES.
DEFAULT = ["region", "nation", "customer", "supplier", "part", "orders"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the lake. Queries start here, so the package goes to the workers too."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(name: str) -> Column:
    """A column as text: doubles with two decimals, all else as it prints."""
    return (F.col(name).cast("decimal(18,2)") if name in DOUBLES else F.col(name)).cast("string")


def forms(name: str, kind: str) -> list[tuple[str, Column]]:
    """A column of a Spark type in forms that are cheap to hand to Python, each with its kind there: long, cents, stamp or text. A cell is in one form,
    and as text it is as_text(): cents only where they divide to the very double, stamps only with years of four digits."""
    x = F.col(name)
    if name in DOUBLES:
        if kind != "double":
            return [("text", as_text(name))]
        cents = F.rint(x * 100)
        own, way = (F.abs(x) < 1e13) & (cents / 100 == x), ("cents", cents.cast("long"))
    elif kind in INTEGERS:
        return [("long", x.cast("long"))]
    elif kind in ("timestamp", "timestamp_ntz"):
        local = x.cast("timestamp_ntz")
        own, way = local.between(*[F.lit(day).cast("timestamp_ntz") for day in ("1000-01-01", "9999-12-31")]), ("stamp", local)
    else:
        return [("text", as_text(name))]
    return [(way[0], F.when(own, way[1])), ("text", F.when(~own, as_text(name)))]


def flatten(df: DataFrame, tableid: int, columns: list[str], rowid: Column) -> DataFrame:
    """One row for each cell that is not null."""
    cells = df.select(rowid.cast("long").alias("rowid"), F.posexplode(F.array(*[as_text(c) for c in columns])).alias("colid", "tokenized"))
    return cells.where("tokenized is not null").select("tokenized", F.lit(tableid).cast("long").alias("tableid"), F.col("colid").cast("long").alias("colid"), "rowid")


@dataclass(frozen=True)
class Wide:
    """A table of the lake, rows as they are; rowid: a column or an expression. order: the rows have no rowid yet, it is their number by these columns."""

    name: str
    rows: DataFrame
    rowid: Column
    order: tuple[str, ...] = ()

    @property
    def tableid(self) -> int:
        return TABLES.index(self.name)

    @property
    def cells(self) -> DataFrame:
        return flatten(self.rows, self.tableid, COLUMNS_OF[self.name], self.rowid)

    @property
    def forms(self) -> list[tuple[int, str, Column]]:
        """All columns in their forms: the column's place, the kind, the form."""
        kinds = {f.name: f.dataType.typeName() for f in self.rows.schema}
        return [(i, kind, x) for i, c in enumerate(COLUMNS_OF[self.name]) for kind, x in forms(c, kinds[c])]

    @property
    def typed(self) -> tuple[DataFrame, list[tuple[int, str]]]:
        """(rowid, f0, f1, ...): all columns in their forms, and of each form the column's place and its kind."""
        found = self.forms
        rows = self.rows.select(self.rowid.cast("long").alias("rowid"), *[x.alias(f"f{i}") for i, (_, _, x) in enumerate(found)])
        return rows, [(i, kind) for i, kind, _ in found]


def wide(spark: SparkSession, sf_dir: str, tables: list[str] = DEFAULT, number: bool = True) -> list[Wide]:
    """Several tables with their rowids. Tables with an integer key take it; others are numbered, where number is not set by who reads them."""
    found = []
    for name in tables:
        df = table(spark, sf_dir, name)
        if name in KEY_OF:
            found.append(Wide(name, df, F.col(KEY_OF[name])))
        elif not number and {df.schema[c].dataType.typeName() for c in ORDER_OF[name][:2]} <= INTEGERS:
            found.append(Wide(name, df, F.lit(0), tuple(ORDER_OF[name])))
        else:
            found.append(Wide(name, numbered(df, ORDER_OF[name], "rowid"), F.col("rowid")))
    return found


def cells_of(tables: list[Wide]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.cells for t in tables])


def cells(spark: SparkSession, sf_dir: str, tables: list[str] = DEFAULT) -> DataFrame:
    """The cells of several tables."""
    return cells_of(wide(spark, sf_dir, tables))


def token_cells(docs: DataFrame) -> DataFrame:
    """One row for each blank-separated word of each document: colid is the word's place, rowid the document."""
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("rowid"), F.posexplode(F.split("text", " ")).alias("colid", "tokenized")).select("tokenized", F.lit(TABLES.index("documents")).cast("long").alias("tableid"), F.col("colid").cast("long").alias("colid"), "rowid")


# the same as DuckDB SQL


def cells_sql(tables: list[str] = DEFAULT) -> str:
    parts = []
    for name in tables:
        source, key = name, KEY_OF.get(name)
        if key is None:
            source, key = f"(SELECT *, row_number() OVER (ORDER BY {', '.join(ORDER_OF[name])}) - 1 AS _row FROM {name})", "_row"
        for i, c in enumerate(COLUMNS_OF[name]):
            text = f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" if c in DOUBLES else f"CAST({c} AS VARCHAR)"
            parts.append(f"SELECT {text} AS tokenized, CAST({TABLES.index(name)} AS BIGINT) AS tableid, CAST({i} AS BIGINT) AS colid, CAST({key} AS BIGINT) AS rowid FROM {source} WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


TOKENS_SQL = f"SELECT tokenized, CAST({TABLES.index('documents')} AS BIGINT) AS tableid, CAST(place - 1 AS BIGINT) AS colid, CAST(doc_id AS BIGINT) AS rowid FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS tokenized, generate_subscripts(string_split(text, ' '), 1) AS place FROM documents WHERE text IS NOT NULL)"
