"""Queries over the star-schema tables: each writes XML from rows, shreds it, and returns a relation.

The XML is made with Spark's own functions (sources.xmlgen) and lives only in
the plan.  SQL gives for each query what the relation must be.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .errors import ShredError, recovered
from .operators.shred import Shredder, relinked, shred_files, shred_text
from .plans.mapping import Field, FieldBuilder, Mapping, Options, Table
from .shared import new_path
from .sources.datasource import register
from .sources.xmlgen import element, escaped, leaf, nested, number
from .streaming.stream import read_stream, shred_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(base: str, **types: str) -> list[Field]:
    """Fields below a path: name="Type" or name="Type?" (nullable) or name="Type:sub/path"."""
    made = []
    for name, kind in types.items():
        kind, _, sub = kind.partition(":")
        made.append(Field(name, f"{base}/{sub or name}", kind.rstrip("?"), kind.endswith("?")))
    return made


def documents(rows: DataFrame, key: Column, order: list[str], row: Column, root: str = "data") -> DataFrame:
    """A document for each value of key: <root> around the fragments of its rows; columns doc, content."""
    return nested(rows.withColumn("doc", key), ["doc"], order, row, "_x").select("doc", element(root, c("_x")).alias("content"))


def single(rows: DataFrame, content: Column, *keys: str) -> DataFrame:
    """A document for each row."""
    return rows.select(*keys, content.alias("content"))


def flat(*made: Field, path: str = "/data", name: str = "rows", levels=(), options: Options | None = None) -> Shredder:
    return Shredder(Mapping([Table(name, path, levels, made)], options or Options()))


def plain(df: DataFrame, **names: str) -> DataFrame:
    """Columns under plain names: plain(df, order_no="<order>")."""
    return df.select(*[c(f"`{old}`").alias(new) for new, old in names.items()])


# -- sources and flat rows ----------------------------------------------------


@query("SELECT r_regionkey, r_name FROM region")
def scan_flat_region(spark, sf_dir):
    docs = documents(load(spark, sf_dir, "region"), F.lit(0), ["r_regionkey"], element("row", leaf("r_regionkey", c("r_regionkey")), leaf("r_name", c("r_name"))))
    return flat(*fields("/data/row", r_regionkey="Int32", r_name="Utf8")).table(docs, "rows")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_flat_nation(spark, sf_dir):
    docs = documents(load(spark, sf_dir, "nation"), c("n_regionkey"), ["n_nationkey"], element("row", *[leaf(x, c(x)) for x in ("n_nationkey", "n_name", "n_regionkey")]))
    return flat(*fields("/data/row", n_nationkey="Int32", n_name="Utf8", n_regionkey="Int32")).table(docs, "rows")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def attrs_customer(spark, sf_dir):
    names = {"c_custkey": "Int64", "c_name": "Utf8", "c_nationkey": "Int32", "c_acctbal": "Float64", "c_mktsegment": "Utf8"}
    docs = documents(load(spark, sf_dir, "customer"), c("c_custkey") % 64, ["c_custkey"], element("c", attributes={n: c(n) for n in names}))
    return flat(*[Field(n, f"/data/c/@{n}", t) for n, t in names.items()]).table(docs, "rows")


# -- nesting and levels -------------------------------------------------------

def _item() -> Column:
    return element("item", number("part", c("l_partkey")), number("qty", c("l_quantity")))


_ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def orders_with_items(spark, sf_dir, extra: Column | None = None) -> DataFrame:
    """One document a customer: <customer><orders><order id=".."><total/><items>..</items></order>..."""
    items = nested(load(spark, sf_dir, "lineitem"), ["l_orderkey"], _ITEM_ORDER, _item(), "items")
    rows = load(spark, sf_dir, "orders").join(items, c("o_orderkey") == c("l_orderkey"), "left")
    order = element("order", number("total", c("o_totalprice")), element("items", F.coalesce("items", F.lit(""))), *([extra] if extra is not None else []), attributes={"id": c("o_orderkey")})
    return nested(rows, ["o_custkey"], ["o_orderkey"], order, "_x").select(c("o_custkey").alias("custkey"), element("customer", element("orders", c("_x"))).alias("content"))


_ORDER = "/customer/orders/order"
ORDERS = Table("orders", "/customer/orders", ["order"], [Field("o_orderkey", f"{_ORDER}/@id", "Int64"), Field("o_totalprice", f"{_ORDER}/total", "Float64")])
ITEMS = Table("items", f"{_ORDER}/items", ["order", "item"], [Field("l_partkey", f"{_ORDER}/items/item/part", "Int64"), Field("l_quantity", f"{_ORDER}/items/item/qty", "Float64")])

_SQL_ITEMS = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS order_no FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS item_no FROM lineitem)
"""


@query(_SQL_ITEMS + "SELECT o_custkey AS custkey, order_no, item_no, l_partkey, l_quantity FROM o JOIN i ON o_orderkey = l_orderkey")
def nested_orders_items(spark, sf_dir):
    items = Shredder(Mapping([ORDERS, ITEMS])).table(orders_with_items(spark, sf_dir), "items", keys=["custkey"])
    return plain(items, custkey="custkey", order_no="<order>", item_no="<item>", l_partkey="l_partkey", l_quantity="l_quantity")


@query(_SQL_ITEMS + "SELECT o_custkey AS custkey, o_orderkey, o_totalprice, order_no, item_no, l_partkey, l_quantity FROM o JOIN i ON o_orderkey = l_orderkey")
def join_back_on_level(spark, sf_dir):
    docs = orders_with_items(spark, sf_dir)
    made = Shredder(Mapping([ORDERS, ITEMS])).tables(docs, keys=["custkey"], once=True)
    both = relinked(made["items"], made["orders"], ["order"], ["custkey"])
    return plain(both, custkey="custkey", o_orderkey="o_orderkey", o_totalprice="o_totalprice", order_no="<order>", item_no="<item>", l_partkey="l_partkey", l_quantity="l_quantity")


@query(_SQL_ITEMS + "SELECT o_custkey AS custkey, order_no, l_partkey, l_quantity FROM o JOIN i ON o_orderkey = l_orderkey")
def levels_prefix_only(spark, sf_dir):
    shorter = Table("items", ITEMS.xml_path, ["order"], ITEMS.fields)
    items = Shredder(Mapping([ORDERS, shorter])).table(orders_with_items(spark, sf_dir), "items", keys=["custkey"])
    return plain(items, custkey="custkey", order_no="<order>", l_partkey="l_partkey", l_quantity="l_quantity")


@query(_SQL_ITEMS + "SELECT o_custkey AS custkey, order_no, item_no, l_partkey FROM o JOIN i ON o_orderkey = l_orderkey")
def index_only_parent(spark, sf_dir):
    parent = Table("orders", "/customer/orders", ["order"], [])
    engine = Shredder(Mapping([parent, ITEMS]))
    assert engine.names == ["items"]  # a table without columns is counted, not returned
    items = engine.table(orders_with_items(spark, sf_dir), "items", keys=["custkey"])
    return plain(items, custkey="custkey", order_no="<order>", item_no="<item>", l_partkey="l_partkey")


@query(
    _SQL_ITEMS
    + """SELECT 'item' AS kind, o_custkey AS custkey, order_no, item_no AS no, CAST(l_partkey AS VARCHAR) AS said FROM o JOIN i ON o_orderkey = l_orderkey
UNION ALL SELECT 'note', o_custkey, order_no, 0, o_orderstatus FROM o UNION ALL SELECT 'note', o_custkey, order_no, 1, o_orderpriority FROM o"""
)
def sibling_tables_shared_parent(spark, sf_dir):
    notes = element("notes", leaf("note", c("o_orderstatus")), leaf("note", c("o_orderpriority")))
    table = Table("notes", f"{_ORDER}/notes", ["order", "note"], [Field("said", f"{_ORDER}/notes/note", "Utf8")])
    made = Shredder(Mapping([ORDERS, ITEMS, table])).tables(orders_with_items(spark, sf_dir, notes), keys=["custkey"], once=True)
    items = made["items"].select(F.lit("item").alias("kind"), "custkey", c("`<order>`").alias("order_no"), c("`<item>`").alias("no"), c("l_partkey").cast("string").alias("said"))
    return items.unionByName(made["notes"].select(F.lit("note").alias("kind"), "custkey", c("`<order>`").alias("order_no"), c("`<note>`").alias("no"), "said"))


@query("""
SELECT dense_rank() OVER (ORDER BY r_regionkey) - 1 AS region_no, nation_no, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS supplier_no, s_suppkey, s_name
FROM region JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS nation_no FROM nation) ON n_regionkey = r_regionkey
JOIN supplier ON s_nationkey = n_nationkey
""")
def three_level_region_nation_supplier(spark, sf_dir):
    suppliers = nested(load(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_suppkey"], element("supplier", leaf("key", c("s_suppkey")), leaf("name", c("s_name"))), "sx")
    nations = load(spark, sf_dir, "nation").join(suppliers, c("n_nationkey") == c("s_nationkey"), "left")
    nations = nested(nations, ["n_regionkey"], ["n_nationkey"], element("nation", F.coalesce("sx", F.lit(""))), "nx")
    # Regions without a nation still count; every region here has some.
    regions = load(spark, sf_dir, "region").join(nations, c("n_regionkey") == c("r_regionkey"), "left")
    docs = documents(regions, F.lit(0), ["r_regionkey"], element("region", F.coalesce("nx", F.lit(""))), "world")
    base = "/world/region/nation"
    mapping = Mapping([Table("regions", "/world", ["region"], []), Table("nations", "/world/region", ["region", "nation"], []), Table("suppliers", base, ["region", "nation", "supplier"], [Field("s_suppkey", f"{base}/supplier/key", "Int64"), Field("s_name", f"{base}/supplier/name", "Utf8")])])
    found = Shredder(mapping).table(docs, "suppliers")
    return plain(found, region_no="<region>", nation_no="<nation>", supplier_no="<supplier>", s_suppkey="s_suppkey", s_name="s_name")


@query("""
WITH cu AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS customer_no FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS nation_no FROM nation)
SELECT n_regionkey AS doc, CAST(0 AS BIGINT) AS region_no, nation_no, customer_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS order_no, o_orderkey
FROM orders JOIN cu ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey
""")
def four_level_nesting(spark, sf_dir):
    orders = nested(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], number("order", c("o_orderkey")), "ox")
    customers = load(spark, sf_dir, "customer").join(orders, c("c_custkey") == c("o_custkey"), "left")
    customers = nested(customers, ["c_nationkey"], ["c_custkey"], element("customer", F.coalesce("ox", F.lit(""))), "cx")
    nations = load(spark, sf_dir, "nation").join(customers, c("n_nationkey") == c("c_nationkey"), "left")
    nations = nested(nations, ["n_regionkey"], ["n_nationkey"], element("nation", F.coalesce("cx", F.lit(""))), "nx")
    docs = nations.select(c("n_regionkey").alias("doc"), element("world", element("region", c("nx"))).alias("content"))
    at = ["/world", "/world/region", "/world/region/nation", "/world/region/nation/customer"]
    levels = ["region", "nation", "customer", "order"]
    tables = [Table(f"t{i}", p, levels[: i + 1], []) for i, p in enumerate(at[:3])] + [Table("orders", at[3], levels, [Field("o_orderkey", f"{at[3]}/order", "Int64")])]
    found = Shredder(Mapping(tables)).table(docs, "orders", keys=["doc"])
    return plain(found, doc="doc", o_orderkey="o_orderkey", **{f"{x}_no": f"<{x}>" for x in levels})


@query("SELECT n_nationkey AS doc, n_name AS title, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def root_header_table(spark, sf_dir):
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "supplier"), c("n_nationkey") == c("s_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("k"))
    docs = single(n, element("report", element("header", leaf("title", c("n_name")), leaf("count", c("k")))), "n_nationkey")
    found = flat(Field("title", "/report/header/title", "Utf8"), Field("suppliers", "/report/header/count", "Int64"), path="/").table(docs, "rows", keys=["n_nationkey"])
    return plain(found, doc="n_nationkey", title="title", suppliers="suppliers")


@query("SELECT n_nationkey AS doc, n_name AS name, CAST(NULL AS VARCHAR) AS region FROM nation UNION ALL SELECT n_nationkey, CAST(NULL AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation")
def row_per_known_child(spark, sf_dir):
    docs = single(load(spark, sf_dir, "nation"), element("root", element("meta", leaf("name", c("n_name")), leaf("region", c("n_regionkey")))), "n_nationkey")
    engine = flat(Field("name", "/root/meta/name", "Utf8", True), Field("region", "/root/meta/region", "Int32", True), path="/root/meta")
    return plain(engine.table(docs, "rows", keys=["n_nationkey"]), doc="n_nationkey", name="name", region="region").withColumn("region", c("region").cast("string"))


@query("SELECT s_suppkey, s_name FROM supplier")
def unknown_siblings_ignored(spark, sf_dir):
    row = F.concat(F.lit("<skip><key>9</key></skip>"), element("row", F.lit("<extra/>"), leaf("key", c("s_suppkey")), F.lit("<x><name>no</name></x>"), leaf("name", c("s_name"))), F.lit("<skip/>"))
    docs = documents(load(spark, sf_dir, "supplier"), c("s_nationkey"), ["s_suppkey"], row)
    return flat(*fields("/data/row", s_suppkey="Int64:key", s_name="Utf8:name")).table(docs, "rows")


@query("SELECT s_suppkey, s_name FROM supplier WHERE false")
def empty_table(spark, sf_dir):
    docs = single(load(spark, sf_dir, "supplier"), element("other", leaf("key", c("s_suppkey"))))
    return flat(*fields("/data/row", s_suppkey="Int64:key", s_name="Utf8:name")).table(docs, "rows")


# -- types, transforms, missing values ---------------------------------------


def _typed(spark, sf_dir, **columns: tuple[str, Column]) -> DataFrame:
    """A document of leaves for each event; columns name=(type, value)."""
    docs = single(load(spark, sf_dir, "events"), element("data", element("row", *[(leaf if t in ("Utf8", "Boolean") else number)(n, v) for n, (t, v) in columns.items()])), "event_id")
    return flat(*fields("/data/row", **{n: t for n, (t, _) in columns.items()})).table(docs, "rows", keys=["event_id"])


@query("SELECT event_id, event_id % 256 - 128 AS i8, event_id % 65536 - 32768 AS i16, user_id - 2147483648 AS i32, event_id * 1000003 - 9000000000 AS i64 FROM events")
def types_signed(spark, sf_dir):
    made = _typed(spark, sf_dir, i8=("Int8", c("event_id") % 256 - 128), i16=("Int16", c("event_id") % 65536 - 32768), i32=("Int32", c("user_id") - 2147483648), i64=("Int64", c("event_id") * 1000003 - 9000000000))
    return made.select("event_id", *[c(x).cast("long").alias(x) for x in ("i8", "i16", "i32", "i64")])


@query("SELECT event_id, event_id % 256 AS u8, event_id % 65536 AS u16, 4294967295 - event_id AS u32, CAST(18446744073709551615 - CAST(event_id AS HUGEINT) AS VARCHAR) AS u64 FROM events")
def types_unsigned(spark, sf_dir):
    made = _typed(spark, sf_dir, u8=("UInt8", c("event_id") % 256), u16=("UInt16", c("event_id") % 65536), u32=("UInt32", F.lit(4294967295) - c("event_id")), u64=("UInt64", F.lit("18446744073709551615").cast("decimal(20,0)") - c("event_id").cast("decimal(20,0)")))
    return made.select("event_id", *[c(x).cast("long").alias(x) for x in ("u8", "u16", "u32")], c("u64").cast("decimal(20,0)").cast("string").alias("u64"))


@query("SELECT event_id, CAST(CAST(value AS REAL) AS DOUBLE) AS f32, value AS f64, value * 1e200 AS big FROM events")
def types_float(spark, sf_dir):
    made = _typed(spark, sf_dir, f32=("Float32", c("value").cast("float")), f64=("Float64", c("value")), big=("Float64", c("value") * 1e200))
    return made.select("event_id", c("f32").cast("double").alias("f32"), "f64", "big")


_WORDS = ("true", "YES", "y", "T", "on", "1", "False", "no", "N", "f", "OFF", "0")


@query("SELECT event_id, user_id % 12 < 6 AS flag FROM events")
def types_bool_vocab(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (c("user_id") % 12 + 1).cast("int"))
    return _typed(spark, sf_dir, flag=("Boolean", F.concat(F.lit(" \n"), word, F.lit("\t"))))


def _scaled(spark, sf_dir, kind: str) -> DataFrame:
    docs = documents(load(spark, sf_dir, "lineitem"), c("l_orderkey"), _ITEM_ORDER, element("row", number("q", c("l_quantity")), number("p", c("l_extendedprice"))))
    return flat(Field("q", "/data/row/q", kind, scale=0.1, offset=10.0), Field("p", "/data/row/p", kind, offset=-0.5)).table(docs, "rows", keys=["doc"])


@query("SELECT l_orderkey AS doc, l_quantity * CAST(0.1 AS DOUBLE) + CAST(10 AS DOUBLE) AS q, l_extendedprice + CAST(-0.5 AS DOUBLE) AS p FROM lineitem")
def scale_offset_f64(spark, sf_dir):
    return _scaled(spark, sf_dir, "Float64")


@query("SELECT l_orderkey AS doc, CAST(CAST(l_quantity AS REAL) * CAST(0.1 AS REAL) + CAST(10 AS REAL) AS DOUBLE) AS q, CAST(CAST(l_extendedprice AS REAL) + CAST(-0.5 AS REAL) AS DOUBLE) AS p FROM lineitem")
def scale_offset_f32(spark, sf_dir):
    return _scaled(spark, sf_dir, "Float32").select("doc", *[c(x).cast("double").alias(x) for x in "qp"])


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS n, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN event_type END AS s FROM events")
def nulls_nullable(spark, sf_dir):
    n = F.when(c("user_id") % 3 == 0, F.lit("<n>  </n><s/>")).when(c("user_id") % 3 == 1, F.concat(leaf("n", c("user_id")), leaf("s", c("event_type")))).otherwise(F.concat(leaf("n", c("user_id")), F.lit("<s></s>")))
    docs = single(load(spark, sf_dir, "events"), element("data", element("row", n)), "event_id")
    return flat(*fields("/data/row", n="Int64?", s="Utf8?")).table(docs, "rows", keys=["event_id"]).withColumn("n", c("n").cast("string"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '' ELSE event_type END AS s, CASE WHEN user_id % 2 = 0 THEN '' ELSE 'a' END AS a FROM events")
def missing_utf8_empty(spark, sf_dir):
    row = F.when(c("user_id") % 2 == 0, F.lit('<row a=""/>')).otherwise(element("row", leaf("s", c("event_type")), attributes={"a": F.lit("a")}))
    docs = single(load(spark, sf_dir, "events"), element("data", row), "event_id")
    return flat(Field("s", "/data/row/s"), Field("a", "/data/row/@a", "Utf8", True)).table(docs, "rows", keys=["event_id"])


@query("SELECT event_id, user_id AS n, value AS x FROM events")
def whitespace_numeric(spark, sf_dir):
    space = F.lit(" \t\r\n")
    return _typed(spark, sf_dir, n=("Int64", F.concat(space, F.lit("+"), c("user_id").cast("string"), space)), x=("Float64", F.concat(space, c("value").cast("string"), space)))


@query("SELECT event_id, event_type AS s, ' ' || event_type || ' ' AS raw FROM events")
def trim_text(spark, sf_dir):
    docs = single(load(spark, sf_dir, "events"), element("data", element("row", F.lit("<s>\n  "), escaped(c("event_type")), F.lit(" \t</s>"))), "event_id")
    made = [flat(Field("s", "/data/row/s"), options=Options(trim_text=t)).table(docs, "rows", keys=["event_id"]) for t in (True, False)]
    return made[0].join(made[1].select("event_id", F.concat(F.lit(" "), F.btrim("s", F.lit("\n \t")), F.lit(" ")).alias("raw")), "event_id")


# -- text: references, CDATA, attributes, mixed content ------------------------


def _texts(spark, sf_dir, inside: Column) -> DataFrame:
    docs = single(load(spark, sf_dir, "documents").where(c("text").isNotNull()), element("d", element("row", F.lit("<t>"), inside, F.lit("</t>"))), "doc_id")
    return flat(Field("text", "/d/row/t"), path="/d").table(docs, "rows", keys=["doc_id"])


_SQL_TEXTS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"


@query(_SQL_TEXTS)
def entities_documents(spark, sf_dir):
    return _texts(spark, sf_dir, escaped(c("text")))


@query(_SQL_TEXTS)
def cdata_documents(spark, sf_dir):
    """CDATA between comments; a section's end in the text is split over two sections."""
    inner = F.replace("text", F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return _texts(spark, sf_dir, F.concat(F.lit("<!-- <t> --><![CDATA["), inner, F.lit("]]><?go on?>")))


@query("SELECT doc_id, replace(replace(text, 'a', chr(228)), 'e', chr(128512)) AS text FROM documents WHERE text IS NOT NULL")
def char_refs(spark, sf_dir):
    return _texts(spark, sf_dir, F.replace(F.replace(escaped(F.replace(F.replace("text", F.lit("a"), F.lit("\x01")), F.lit("e"), F.lit("\x02"))), F.lit("\x01"), F.lit("&#228;")), F.lit("\x02"), F.lit("&#x1F600;")))


@query("SELECT doc_id, replace(replace(replace(text, chr(13) || chr(10), ' '), chr(9), ' '), chr(10), ' ') || chr(10) AS text FROM documents WHERE text IS NOT NULL")
def attr_normalization(spark, sf_dir):
    docs = single(load(spark, sf_dir, "documents").where(c("text").isNotNull()), F.concat(F.lit("<d><row t='"), F.replace(escaped(c("text")), F.lit("'"), F.lit("&apos;")), F.lit("&#10;'/></d>")), "doc_id")
    return flat(Field("text", "/d/row/@t"), path="/d").table(docs, "rows", keys=["doc_id"])


@query("SELECT n_nationkey AS doc, 'Before ' || n_name || ' After' AS s FROM nation")
def mixed_content(spark, sf_dir):
    docs = single(load(spark, sf_dir, "nation"), F.concat(F.lit("<data><row><s>Before <b>inner</b>"), escaped(c("n_name")), F.lit("<i/> After</s></row></data>")), c("n_nationkey").alias("doc"))
    return flat(Field("s", "/data/row/s")).table(docs, "rows", keys=["doc"])


@query("SELECT n_nationkey AS doc, n_name AS s, n_regionkey AS r FROM nation")
def namespaces_stripped(spark, sf_dir):
    docs = single(load(spark, sf_dir, "nation"), F.concat(F.lit('<x:data xmlns:x="urn:x"><y:row z:r="'), c("n_regionkey").cast("string"), F.lit('"><s>'), escaped(c("n_name")), F.lit("</s></y:row></x:data>")), c("n_nationkey").alias("doc"))
    return flat(Field("s", "/data/row/s"), Field("r", "/data/row/@r", "Int32")).table(docs, "rows", keys=["doc"])


@query("SELECT n_nationkey AS doc, n_name AS s, CAST(NULL AS VARCHAR) AS t FROM nation")
def namespaces_qualified(spark, sf_dir):
    docs = single(load(spark, sf_dir, "nation"), F.concat(F.lit("<a:data><a:row><a:s>"), escaped(c("n_name")), F.lit("</a:s><b:s>no</b:s><s>no</s></a:row></a:data>")), c("n_nationkey").alias("doc"))
    made = flat(Field("s", "/a:data/a:row/a:s"), Field("t", "/a:data/a:row/c:s", "Utf8", True), path="/a:data", options=Options(strip_namespaces=False)).table(docs, "rows", keys=["doc"])
    return made


@query("SELECT n_nationkey AS doc, CAST(n_nationkey AS VARCHAR) || CAST(n_regionkey AS VARCHAR) AS a FROM nation")
def dup_attr_concat(spark, sf_dir):
    docs = single(load(spark, sf_dir, "nation"), F.concat(F.lit('<data><row a="'), c("n_nationkey").cast("string"), F.lit('" a="'), c("n_regionkey").cast("string"), F.lit('"/></data>')), c("n_nationkey").alias("doc"))
    return flat(Field("a", "/data/row/@a"), options=Options(validate_attributes=False)).table(docs, "rows", keys=["doc"])


# -- stopping, many documents, wide rows, errors --------------------------------


@query("SELECT n_nationkey AS doc, n_name AS title FROM nation")
def stop_at_header(spark, sf_dir):
    content = F.concat(F.lit("<report><header>"), leaf("title", c("n_name")), F.lit("</header><body><row><v>1</v></row></wrong>"))
    docs = single(load(spark, sf_dir, "nation"), content, c("n_nationkey").alias("doc"))
    mapping = Mapping([Table("head", "/report", [], [Field("title", "/report/header/title")]), Table("body", "/report/body", [], [Field("v", "/report/body/row/v", "Int32")])], Options(stop_at_paths=["/report/header"]))
    made = Shredder(mapping).tables(docs, keys=["doc"])
    return made["head"].unionByName(made["body"].select("doc", c("v").cast("string").alias("title")))


@query("""
WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS raw FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') AS title FROM t
""")
def pages_title_stop(spark, sf_dir):
    """Titles of all pages, which are XML up to there but for a & that begins no reference: that one is escaped."""
    title = "/html/head/meta/title"
    html = F.regexp_replace("html", "&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")
    engine = flat(Field("title", title), path="/html/head/meta", options=Options(stop_at_paths=[title]))
    return engine.table(load(spark, sf_dir, "pages").withColumn("html", html), "rows", content="html", keys=["page_id"])


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS item_no, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def reparse_many_docs(spark, sf_dir):
    items = nested(load(spark, sf_dir, "lineitem"), ["l_orderkey"], _ITEM_ORDER, _item(), "items")
    docs = load(spark, sf_dir, "orders").join(items, c("o_orderkey") == c("l_orderkey")).select("o_orderkey", element("items", c("items")).alias("content"))
    found = flat(Field("l_partkey", "/items/item/part", "Int64"), Field("l_quantity", "/items/item/qty", "Float64"), path="/items", levels=["item"]).table(docs, "rows", keys=["o_orderkey"])
    return plain(found, o_orderkey="o_orderkey", item_no="<item>", l_partkey="l_partkey", l_quantity="l_quantity")


@query("SELECT event_id, " + ", ".join(f"event_id * 24 + {i} AS field_{i:02d}" for i in range(24)) + " FROM events")
def wide_fanout_24(spark, sf_dir):
    return _typed(spark, sf_dir, **{f"field_{i:02d}": ("Int64", c("event_id") * 24 + i) for i in range(24)})


def _faulty(name: str, **options) -> Callable[[], Mapping]:
    return lambda: Mapping([Table(**({"name": "t", "xml_path": "/a", "levels": [], "fields": []} | o)) for o in options["tables"]])


_INVALID = {
    "empty table name": [{"name": ""}],
    "duplicate table name": [{}, {"xml_path": "/b"}],
    "empty table path": [{"xml_path": ""}],
    "duplicate table path": [{}, {"name": "u", "xml_path": "a/"}],
    "empty field name": [{"fields": [Field("", "/a/b")]}],
    "duplicate field name": [{"fields": [Field("f", "/a/b"), Field("f", "/a/c")]}],
    "empty field path": [{"fields": [Field("f", "")]}],
    "field path not under table": [{"fields": [Field("f", "/ab/c")]}],
    "scale": [{"fields": [Field("f", "/a/b", "Int32", scale=1.0, offset=1.0)]}],
    "offset": [{"fields": [Field("f", "/a/b", "Utf8", offset=1.0)]}],
}


@query("""SELECT * FROM (VALUES
('empty table name', 'InvalidMapping', 'empty table name'),
('duplicate table name', 'InvalidMapping', 'duplicate table name'),
('empty table path', 'InvalidMapping', 'empty table path'),
('duplicate table path', 'InvalidMapping', 'duplicate table path'),
('empty field name', 'InvalidMapping', 'empty field name'),
('duplicate field name', 'InvalidMapping', 'duplicate field name'),
('empty field path', 'InvalidMapping', 'empty field path'),
('field path not under table', 'InvalidMapping', 'field path not under table'),
('scale', 'UnsupportedTransform', 'scale'),
('offset', 'UnsupportedTransform', 'offset')) AS v(what, error, issue)""")
def validation_errors(spark, sf_dir):
    rows = []
    for what, tables in _INVALID.items():
        try:
            Shredder(_faulty(what, tables=tables)())
            rows.append((what, "none", ""))
        except ShredError as e:
            rows.append((what, type(e).__name__, e.facts.get("issue") or e.facts.get("transform")))
    return spark.createDataFrame(rows, "what string, error string, issue string")


_BROKEN = {
    "not a number": "<d><r><n>3x</n></r></d>",
    "fraction": "<d><r><n>1.5</n></r></d>",
    "too large": "<d><r><n>2147483648</n></r></d>",
    "not a boolean": "<d><r><n>1</n><b>maybe</b></r></d>",
    "missing": "<d><r/></d>",
    "twice": "<d><r><n>1</n><n>2</n></r></d>",
    "entity": "<d><r><n>&nbsp;</n></r></d>",
    "reference": "<d><r><n>&#xZZ;</n></r></d>",
    "closing tag": "<d><r><n>1</m></r></d>",
    "attribute twice": '<d><r a="1" a="2"><n>1</n></r></d>',
    "fine": "<d><r><n> 42 </n><b>on</b></r></d>",
}


@query("""SELECT * FROM (VALUES
('not a number', 'ValueFault', 'number'), ('fraction', 'ValueFault', 'number'), ('too large', 'ValueFault', 'number'),
('not a boolean', 'ValueFault', 'boolean'), ('missing', 'MissingValue', 'missing'), ('twice', 'ValueFault', 'duplicate value'),
('entity', 'ValueFault', 'unresolved entity'), ('reference', 'SyntaxFault', ''), ('closing tag', 'SyntaxFault', ''),
('attribute twice', 'SyntaxFault', ''), ('fine', 'none', '')) AS v(what, error, kind)""")
def parse_errors(spark, sf_dir):
    engine = flat(Field("n", "/d/r/n", "Int32"), Field("b", "/d/r/b", "Boolean", True), Field("a", "/d/r/@a", "Utf8", True), path="/d")
    rows = []
    for what, document in _BROKEN.items():
        try:
            engine.check(spark.createDataFrame([(document,)], "content string"))
            rows.append((what, "none", ""))
        except Exception as e:  # noqa: BLE001
            found = recovered(e)
            rows.append((what, type(found).__name__, getattr(found, "facts", {}).get("kind", "")))
    return spark.createDataFrame(rows, "what string, error string, kind string")


# -- mappings in YAML, files, one pass for all tables ----------------------------


_YAML = """
tables:
  - name: suppliers
    xml_path: /data
    levels: [supplier]
    fields:
      - {name: s_suppkey, xml_path: /data/row/@key, data_type: Int64}
      - {name: s_name, xml_path: /data/row/name, data_type: Utf8}
      - {name: s_acctbal, xml_path: /data/row/balance, data_type: Float64, nullable: true, scale: 2.0, offset: 1.0}
"""


def supplier_documents(spark, sf_dir) -> DataFrame:
    """<data><row key=".."><name/><balance/></row>...</data> for each nation that has suppliers."""
    row = element("row", leaf("name", c("s_name")), leaf("balance", c("s_acctbal")), attributes={"key": c("s_suppkey")})
    return documents(load(spark, sf_dir, "supplier"), c("s_nationkey"), ["s_suppkey"], row)


def as_files(docs: DataFrame, name: str) -> str:
    """A folder below spark.checkpoint.dir with a file for each document; doc=<number>/ tells which."""
    path = new_path(docs.sparkSession, name)
    docs.select("doc", "content").write.partitionBy("doc").option("lineSep", "\n").text(path)
    return path


_SQL_SUPPLIERS = "SELECT s_nationkey AS doc, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS supplier_no, s_suppkey, s_name, s_acctbal * CAST(2 AS DOUBLE) + CAST(1 AS DOUBLE) AS s_acctbal FROM supplier"


def _suppliers(made: DataFrame) -> DataFrame:
    return plain(made, doc="doc", supplier_no="<supplier>", s_suppkey="s_suppkey", s_name="s_name", s_acctbal="s_acctbal")


@query(_SQL_SUPPLIERS)
def yaml_mapping_file(spark, sf_dir):
    """A mapping is read from YAML, written to a file, read again, and used."""
    with tempfile.TemporaryDirectory() as folder:  # the driver alone reads mappings
        Mapping.from_yaml_text(_YAML).to_yaml_file(Path(folder) / "mapping.yaml")
        mapping = Mapping.from_yaml_file(Path(folder) / "mapping.yaml")
    assert mapping == Mapping.from_yaml_text(mapping.to_yaml_text())
    return _suppliers(Shredder(mapping).table(supplier_documents(spark, sf_dir), "suppliers", keys=["doc"]))


@query(_SQL_SUPPLIERS)
def fluent_mapping(spark, sf_dir):
    """The same mapping by the field builder."""
    balance = FieldBuilder("s_acctbal", "/data/row/balance", "Float64").nullable().scaled(2).shifted(1).build()
    table = Table("suppliers", "/data", ["supplier"], [FieldBuilder("s_suppkey", "/data/row/@key", "Int64").build(), FieldBuilder("s_name", "/data/row/name").build(), balance])
    assert Mapping([table]) == Mapping.from_yaml_text(_YAML)
    return _suppliers(Shredder(Mapping([table])).table(supplier_documents(spark, sf_dir), "suppliers", keys=["doc"]))


@query(_SQL_SUPPLIERS)
def files_binary(spark, sf_dir):
    """Documents are files, read whole as bytes; the path says which."""
    path = as_files(supplier_documents(spark, sf_dir), "files")
    made = shred_files(spark, f"{path}/*/*.txt", _YAML)["suppliers"]
    return _suppliers(made.withColumn("doc", F.regexp_extract("path", "doc=([0-9]+)/", 1).cast("int")))


@query("SELECT s_suppkey, s_name, s_acctbal * CAST(2 AS DOUBLE) + CAST(1 AS DOUBLE) AS s_acctbal FROM supplier")
def files_data_source(spark, sf_dir):
    """The same files through the data source of this package."""
    path = as_files(supplier_documents(spark, sf_dir), "source")
    register(spark)
    made = spark.read.format("arborel_xml").option("mapping", _YAML).option("extension", ".txt").load(path)
    return made.select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_regionkey = 1")
def document_in_memory(spark, sf_dir):
    """One document as a string of the driver."""
    rows = load(spark, sf_dir, "nation").where("n_regionkey = 1")
    docs = documents(rows, c("n_regionkey"), ["n_nationkey"], element("row", *[leaf(x, c(x)) for x in ("n_nationkey", "n_name")]))
    xml = docs.first()["content"]  # of one region's nations
    made = shred_text(spark, xml, Mapping([Table("rows", "/data", [], fields("/data/row", n_nationkey="Int32", n_name="Utf8"))]))
    return made["rows"].withColumn("n_regionkey", F.lit(1).cast("long"))


@query(_SQL_ITEMS + """SELECT 'order' AS kind, o_custkey AS custkey, order_no, CAST(0 AS BIGINT) AS item_no, o_orderkey AS key, o_totalprice AS amount FROM o
UNION ALL SELECT 'item', o_custkey, order_no, item_no, l_partkey, l_quantity FROM o JOIN i ON o_orderkey = l_orderkey""")
def one_pass_all_tables(spark, sf_dir):
    """Documents are parsed once; raw rows of all tables are kept, and typed tables read over them."""
    engine = Shredder(Mapping([ORDERS, ITEMS]))
    path = new_path(spark, "raw")
    engine.write_raw(orders_with_items(spark, sf_dir), path, keys=["custkey"])
    made = engine.stored(spark, path, keys=["custkey"])
    orders = made["orders"].select(F.lit("order").alias("kind"), "custkey", c("`<order>`").alias("order_no"), F.lit(0).cast("long").alias("item_no"), c("o_orderkey").alias("key"), c("o_totalprice").alias("amount"))
    return orders.unionByName(made["items"].select(F.lit("item").alias("kind"), "custkey", c("`<order>`").alias("order_no"), c("`<item>`").alias("item_no"), c("l_partkey").alias("key"), c("l_quantity").alias("amount")))


# -- what Spark adds on top ---------------------------------------------------


@query(_SQL_ITEMS + "SELECT o_custkey AS custkey, count(*) AS n_items, sum(l_quantity) AS qty, max(order_no) + 1 AS n_orders FROM o JOIN i ON o_orderkey = l_orderkey GROUP BY 1")
def agg_over_shredded(spark, sf_dir):
    items = nested_orders_items(spark, sf_dir)
    return items.groupBy("custkey").agg(F.count("*").alias("n_items"), F.sum("l_quantity").alias("qty"), (F.max("order_no") + 1).alias("n_orders"))


@query(_SQL_ITEMS + "SELECT custkey, order_no, item_no, l_quantity FROM (SELECT o_custkey AS custkey, order_no, item_no, l_quantity, row_number() OVER (PARTITION BY o_custkey ORDER BY l_quantity DESC, order_no, item_no) AS k FROM o JOIN i ON o_orderkey = l_orderkey) WHERE k <= 3")
def window_over_shredded(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("custkey").orderBy(F.desc("l_quantity"), "order_no", "item_no")
    return nested_orders_items(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 3").select("custkey", "order_no", "item_no", "l_quantity")


@query("SELECT n_nationkey, n_name FROM nation")
def stream_shred(spark, sf_dir):
    """Documents arrive as files; a stream shreds each once and writes its rows to Parquet."""
    docs = documents(load(spark, sf_dir, "nation"), c("n_regionkey"), ["n_nationkey"], element("row", leaf("n_nationkey", c("n_nationkey")), leaf("n_name", c("n_name"))))
    arriving, out = as_files(docs, "arriving"), new_path(spark, "stream")
    engine = flat(*fields("/data/row", n_nationkey="Int32", n_name="Utf8"))
    made = shred_stream(read_stream(spark, f"{arriving}/*", files_per_trigger=2), engine, "rows")
    started = made.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{out}-state").start(out)
    started.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


__all__ = ["QUERIES", "SQL"]
