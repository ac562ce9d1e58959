"""Registered queries of the lineage engine and their SQL, over fixtures and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import keys as k
from tracelake.operators import checks, lineage as ln
from tracelake.sources import kinds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


HOP = "path string, ord int, target_table string, target_column string, target_datatype string, target_size string, source_table string, source_column string, source_datatype string, source_size string, transformation_type string, transformation_logic string, source_role string"


def _hops(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _fk(df: DataFrame, owner: str, key: str, target: str, fk: str, source: str) -> DataFrame:
    """A foreign key as extraction rows that already know their owner."""
    s = lambda x: F.lit(x)
    n = F.lit(None).cast("string")
    frm, to = source.lower(), owner.lower()
    return df.select(
        s(owner).alias("table_key"), s(owner).alias("sheet"), s(f"/data/Archive/{to}.xlsx").alias("path"), s(frm).alias("from_stage"), s(to).alias("to_stage"), F.lit(0).alias("ord"), s(target).alias("target_table"),
        F.col(key).cast("string").alias("target_column"), s("bigint").alias("target_datatype"), n.alias("target_size"), s(source).alias("source_table"), F.col(fk).cast("string").alias("source_column"),
        s("bigint").alias("source_datatype"), n.alias("source_size"), s("1-1").alias("transformation_type"), s("direct").alias("transformation_logic"), n.alias("source_role"),
    )


def _fk_edges(spark, d) -> DataFrame:
    return ln.edges(
        _hops(
            _fk(_t(spark, d, "orders"), "ORDERS", "o_orderkey", "ORDERS", "o_custkey", "CUSTOMER"),
            _fk(_t(spark, d, "customer"), "CUSTOMER", "c_custkey", "CUSTOMER", "c_nationkey", "NATION"),
            _fk(_t(spark, d, "nation"), "NATION", "n_nationkey", "NATION", "n_regionkey", "REGION"),
        )
    )


def _names(lineage: str = "lineage"):
    return F.array_join(F.transform(lineage, lambda e: F.concat_ws(".", F.upper(e["stage"]), e["column"])), ">")


def fk_records(spark, d) -> DataFrame:
    item = _fk(_t(spark, d, "lineitem"), "LINEITEM", "l_linenumber", "LINEITEM", "l_orderkey", "ORDERS")
    return ln.walk(item, _fk_edges(spark, d))


@query("""
SELECT 'REGION.' || n_regionkey || '>NATION.' || n_nationkey || '>CUSTOMER.' || c_custkey || '>ORDERS.' || o_orderkey || '>LINEITEM.' || l_linenumber AS chain, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def lineage_fk_walk(spark, d):
    return fk_records(spark, d).select(_names().alias("chain")).groupBy("chain").agg(F.count("*").alias("n"))


_CHAIN = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"""
WITH own AS (SELECT *, l_orderkey || '-' || l_linenumber AS k FROM lineitem),
walked AS (
  SELECT 'ORDERS' AS src, k, 'REGION.' || n_regionkey || '>NATION.' || n_nationkey || '>CUSTOMER.' || c_custkey || '>ORDERS.' || o_orderkey || '>LINEITEM.' || k AS chain FROM {_CHAIN.replace("lineitem", "own")}
  UNION ALL SELECT 'PART', k, 'PART.' || l_partkey || '>LINEITEM.' || k FROM own UNION ALL SELECT 'SUPPLIER', k, 'SUPPLIER.' || l_suppkey || '>LINEITEM.' || k FROM own)
SELECT src AS source_table, count(*) AS records, count(DISTINCT k) AS fields, count(DISTINCT chain) AS chains, min(chain) AS first, max(chain) AS last FROM walked GROUP BY 1
""")
def lineage_fan_in(spark, d):
    """Three sources a field: every row is a record of its own, walked as far as its source is owned."""
    item = _t(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rows = _hops(*[_fk(item, "LINEITEM", "k", "LINEITEM", c, s) for c, s in (("l_orderkey", "ORDERS"), ("l_partkey", "PART"), ("l_suppkey", "SUPPLIER"))])
    walked = ln.walk(rows, _fk_edges(spark, d)).select("source_table", F.col("target_column").alias("k"), _names().alias("chain"))
    # a chain ends with its own field, and keys hold no ">": a chain belongs to one field, so chains are counted field by field, and one sort serves all
    field = ["source_table", "k"]
    fields = ln.spread(walked, *field).groupBy(*field).agg(F.count("*").alias("n"), F.count_distinct("chain").alias("m"), F.min("chain").alias("first"), F.max("chain").alias("last"))
    return fields.groupBy("source_table").agg(F.sum("n").alias("records"), F.count("*").alias("fields"), F.sum("m").alias("chains"), F.min("first").alias("first"), F.max("last").alias("last"))


def _event_steps(spark, d) -> DataFrame:
    e = _t(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    name = lambda c: F.concat_ws("_", F.lit("E"), F.col("user_id"), c)
    rows = _fk(e.withColumns({"own": name(F.col("r")), "before": name(F.col("r") - 1)}), "EVENT", "own", "EVENT", "before", "EVENT")
    return rows.withColumn("ord", F.lit(0))


@query("""
WITH RECURSIVE e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT u, r, r AS here, 0 AS owned FROM e UNION ALL SELECT w.u, w.r, e.r, owned + 1 FROM w JOIN e ON e.u = w.u AND e.r = w.here - 1 WHERE owned < 7)
SELECT entries, count(*) AS n FROM (SELECT u, r, max(owned) + 2 AS entries FROM w GROUP BY u, r) GROUP BY 1
""")
def lineage_depth_guard(spark, d):
    rows = _event_steps(spark, d)
    return ln.walk(rows, ln.edges(rows)).select(F.size("lineage").alias("entries")).groupBy("entries").agg(F.count("*").alias("n"))


def _fixture_hop(spark, rows) -> DataFrame:
    """rows: (owner, from_stage, to_stage, ord, target_column, source_table, source_column)."""
    df = spark.createDataFrame(rows, "sheet string, from_stage string, to_stage string, ord int, target_column string, source_table string, source_column string")
    n = F.lit(None).cast("string")
    extra = {c: n for c in ("target_datatype", "target_size", "source_datatype", "source_size", "transformation_type", "transformation_logic", "source_role")}
    return df.withColumns({"table_key": k.normalize("sheet"), "path": F.concat(F.lit("/a/Archive/"), "sheet", F.lit(".xlsx")), "target_table": F.col("sheet"), **extra})


def _chain():
    return F.array_join(F.transform("lineage", lambda e: F.concat(e["stage"], F.lit(":"), e["table"], F.lit("."), e["column"])), " > ")


CYCLE = [("A", "s0", "s1", 0, "x", "B", "x"), ("B", "s0", "s1", 0, "x", "A", "x"), ("S", "s0", "s1", 0, "e", "S", "E"), *[(f"D{i}", "s0", "s1", 0, "x", f"D{i + 1}", "x") for i in range(13)]]


@query("""
WITH RECURSIVE e(t, f) AS (VALUES ('A', 'B'), ('B', 'A'), ('S', 'S') UNION ALL SELECT 'D' || i, 'D' || (i + 1) FROM range(13) r(i)),
w AS (SELECT t, f AS here, [t] AS seen, 0 AS owned FROM e
  UNION ALL SELECT w.t, e.f, list_append(seen, w.here), owned + 1 FROM w JOIN e ON e.t = w.here WHERE owned < 7 AND NOT list_contains(seen, w.here)),
last AS (SELECT t, arg_max(here, owned) AS origin, arg_max(seen, owned) AS seen FROM w GROUP BY t)
SELECT t AS sheet, array_to_string(list_reverse(list_append(seen, origin)), '>') AS tables, len(seen) + 1 AS entries FROM last
""")
def lineage_cycle_guard(spark, d):
    rows = _fixture_hop(spark, CYCLE)
    return ln.walk(rows, ln.edges(rows)).select("sheet", F.array_join(F.transform("lineage", lambda e: e["table"]), ">").alias("tables"), F.size("lineage").alias("entries"))


T_HOP = [
    ("T", "s1", "s2", 0, " a ", "m", "x"), ("T", "s1", "s2", 1, "A", "M ", "y"), ("T", "s1", "s2", 2, "b", "NOPE", "z"), ("T", "s1", "s2", 3, "c", None, None), ("T", "s1", "s2", 4, None, "M", "x"),
    ("T", "s1", "s2", 5, "d", "M", "missing"), ("T", "s1", "s2", 6, "e", "T", "E"), ("M", "s0", "s1", 0, "X", "SRC", "p"), ("M", "s0", "s1", 1, "x", "SRC", "q"), ("M", "s0", "s1", 2, "Y", "SRC", "r"),
]


@query("""
WITH h(own, frm, to_, ord, c, st, sc) AS (VALUES ('T','s1','s2',0,' a ','m','x'),('T','s1','s2',1,'A','M ','y'),('T','s1','s2',2,'b','NOPE','z'),('T','s1','s2',3,'c',NULL,NULL),('T','s1','s2',4,NULL,'M','x'),('T','s1','s2',5,'d','M','missing'),
  ('T','s1','s2',6,'e','T','E'),('M','s0','s1',0,'X','SRC','p'),('M','s0','s1',1,'x','SRC','q'),('M','s0','s1',2,'Y','SRC','r')),
e AS (SELECT own, upper(trim(c)) AS k, arg_min({'frm': frm, 'to': to_, 'st': st, 'sc': sc}, ord) AS r FROM h WHERE trim(c) <> '' GROUP BY 1, 2),
t AS (SELECT h.*, e.r AS up FROM h LEFT JOIN e ON e.own = upper(trim(h.st)) AND e.k = upper(trim(h.sc)) AND NOT (e.own = 'T' AND e.k = upper(trim(h.c))) WHERE h.own = 'T' AND c <> '')
SELECT ord, CASE WHEN up IS NOT NULL THEN up.frm || ':' || up.st || '.' || up.sc || ' > ' || up.to || ':M.' || sc || ' > ' WHEN sc <> '' THEN frm || ':' || st || '.' || sc || ' > ' ELSE '' END || to_ || ':T.' || c AS chain FROM t
""")
def origin_fallback(spark, d):
    rows = _fixture_hop(spark, T_HOP)
    return ln.walk(rows.where("sheet = 'T'"), ln.edges(rows)).select("ord", _chain().alias("chain"))


@query("""
WITH f(seq, dir, stem, sheet) AS (VALUES (1,'H1','STG_CARD','STG_TXN'),(2,'H1','STG_TXN','STG_TXN'),(3,'H1','STG_TXN_V2','STG_TXN'),(4,'H2','FOO v2','FOO'),(5,'H2','BAR','FOO'),(6,'H9','X','x')),
h(o, dir, a, b) AS (VALUES (0,'H1','s0','s1'),(1,'H2','s1','s2')),
g AS (SELECT *, upper(sheet) AS t, upper(stem) = upper(sheet) OR starts_with(upper(stem), upper(sheet) || '_V') AS auth FROM f)
SELECT t AS table_key, seq, coalesce(h.a, 's0') AS from_stage, coalesce(h.b, 's3') AS to_stage, auth AS authoritative FROM (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY auth DESC, CASE WHEN auth THEN -seq ELSE seq END) AS r FROM g) g LEFT JOIN h ON g.dir = h.dir WHERE r = 1
""")
def catalog_precedence(spark, d):
    files = [(1, "H1", "STG_CARD", "STG_TXN"), (2, "H1", "STG_TXN", "STG_TXN"), (3, "H1", "STG_TXN_V2", "STG_TXN"), (4, "H2", "FOO v2", "FOO"), (5, "H2", "BAR", "FOO"), (6, "H9", "X", "x")]
    df = spark.createDataFrame([(s, a, str(s), b, c, c) for s, a, b, c in files], "seq int, stage_dir string, path string, stem string, table string, sheet string")
    hops = spark.createDataFrame([(0, "H1", "s0", "s1"), (1, "H2", "s1", "s2")], "hop_ord int, dir string, from_stage string, to_stage string")
    return ln.catalog(df, hops, ["s0", "s1", "s2", "s3"]).select("table_key", F.col("path").cast("int").alias("seq"), "from_stage", "to_stage", "authoritative")


@query("""
SELECT c_custkey, upper(trim(' ' || c_name || ' ')) AS table_key, upper(trim(c_mktsegment)) AS column_key, upper(trim(c_name)) || '.' || upper(trim(c_mktsegment)) AS shown FROM customer
""")
def field_key_norm(spark, d):
    c = _t(spark, d, "customer")
    t, s = k.normalize(F.concat(F.lit(" "), "c_name", F.lit("\t "))), k.normalize("c_mktsegment")
    return c.select("c_custkey", t.alias("table_key"), s.alias("column_key"), k.format_key(t, s).alias("shown"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def first_wins_dedup(spark, d):
    order = ["l_partkey", "l_suppkey", "l_linenumber"]
    return checks.first_of(_t(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", *order)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins_dedup(spark, d):
    return checks.first_of(_t(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def _owners(spark, d) -> DataFrame:
    """Nations as workbooks: one folder for each region, of which R4 is the last hop's."""
    n = _t(spark, d, "nation")
    name = F.concat(F.lit("DWH_N"), "n_nationkey")
    files = n.select(F.col("n_nationkey").alias("seq"), F.concat(F.lit("R"), "n_regionkey").alias("stage_dir"), F.concat(F.lit("/a/Archive/"), name, F.lit(".xlsx")).alias("path"), name.alias("stem"), name.alias("table"), name.alias("sheet"))
    hops = spark.createDataFrame([(i, f"R{i}", f"s{i}", f"s{i + 1}") for i in range(5)], "hop_ord int, dir string, from_stage string, to_stage string")
    return ln.catalog(files, hops, [f"s{i}" for i in range(6)])


@query("""
SELECT 'DWH_N' || n_nationkey AS table_key, 's' || n_regionkey AS from_stage, count(c_custkey) AS fields, count(*) AS records FROM nation JOIN
(SELECT c_custkey, c_nationkey, 0 AS sheet FROM customer UNION ALL SELECT c_custkey, c_nationkey, 0 FROM customer WHERE c_custkey % 3 = 0) c ON n_nationkey = c_nationkey GROUP BY 1, 2
""")
def target_expansion(spark, d):
    """Rows of a table's own sheet, all of them; a second sheet of the same workbook stays out."""
    c = _t(spark, d, "customer").select(F.concat(F.lit("DWH_N"), "c_nationkey").alias("sheet"), F.col("c_custkey").cast("string").alias("target_column"), "c_custkey")
    rows = c.unionByName(c.where("c_custkey % 3 = 0")).unionByName(c.withColumn("sheet", F.lit("Notes")).where("c_custkey % 5 = 0"))
    n = F.regexp_extract("sheet", r"\d+", 0)
    rows = rows.join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").withColumn("path", F.concat(F.lit("/a/Archive/DWH_N"), F.coalesce(F.nullif(n, F.lit("")), F.col("c_nationkey").cast("string")), F.lit(".xlsx")))
    return ln.hop_rows(_owners(spark, d), rows).groupBy("table_key", "from_stage").agg(F.count("target_column").alias("fields"), F.count("*").alias("records"))


@query("""
SELECT 'DWH_N' || n_nationkey AS table_key, true AS known, 'default' AS asked FROM nation WHERE n_regionkey = 4
UNION ALL SELECT x.t, n.n_nationkey IS NOT NULL, 'named' FROM (VALUES ('DWH_N3'), ('DWH_N7'), ('NOWHERE')) x(t) LEFT JOIN nation n ON x.t = 'DWH_N' || n.n_nationkey
""")
def target_selection(spark, d):
    o = _owners(spark, d)
    own = ln.wanted(o, "R4").withColumn("asked", F.lit("default"))
    return own.unionByName(ln.wanted(o, "R4", [" dwh_n3", "DWH_N7", "DWH_N7", "nowhere"]).withColumn("asked", F.lit("named")))


@query("""
SELECT 'N' || n_nationkey AS sheet, n_nationkey % 2 = 0 AS stripped FROM nation WHERE n_regionkey = 4 AND n_nationkey % 2 = 0
UNION ALL SELECT 'DWH_N' || n_nationkey, false FROM nation WHERE n_regionkey = 4 AND n_nationkey % 2 = 1
""")
def final_sheet_pruning(spark, d):
    """Of all sheets only those that a target names, with or without its prefix."""
    sheets = _t(spark, d, "nation").select(F.when(F.expr("n_nationkey % 2 = 0"), F.concat(F.lit("N"), "n_nationkey")).otherwise(F.concat(F.lit("DWH_N"), "n_nationkey")).alias("sheet"))
    kept = sheets.join(ln.final_names(ln.wanted(_owners(spark, d), "R4"), ["dwh_"]), k.normalize("sheet") == F.col("table_key"), "left_semi")
    return kept.select("sheet", (~F.startswith("sheet", F.lit("DWH_"))).alias("stripped"))


@query("""
SELECT doc_id, CASE WHEN l.quality IS NULL THEN 1 ELSE 2 END AS entries, CASE WHEN l.quality IS NOT NULL THEN 'cloud' ELSE 'dwh' END AS stage, CASE WHEN l.quality IS NOT NULL THEN 'DOC' ELSE 'dwh_doc' END AS "table",
CASE WHEN l.quality IS NOT NULL THEN '/f/DOC.xlsx' ELSE '/a/docs.xlsx' END AS path, 'n' || l.quality AS "constraint", 'q' || l.quality AS description
FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
""")
def record_with_final(spark, d):
    labels = _t(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    text = lambda x: F.concat(F.lit(x), "q")
    none = F.lit(None).cast("string")
    cloud = labels.select(F.lit("/f/DOC.xlsx").alias("path"), F.lit(0).alias("sheet_ord"), F.lit(0).alias("ord"), F.lit("DOC").alias("sheet_key"), F.lit("DOC").alias("table"), F.col("doc_id").cast("string").alias("column"), none.alias("datatype"), none.alias("size"), text("n").alias("nullable"), text("q").alias("description"))
    own = ln.entry(F.lit("dwh"), F.lit("dwh_doc"), F.col("target_column"), path=F.lit("/a/docs.xlsx"))
    records = _t(spark, d, "documents").select("doc_id", F.lit("dwh_doc").alias("sheet"), F.col("doc_id").cast("string").alias("target_column")).withColumn("lineage", F.array(own))
    last = F.try_element_at(F.col("lineage"), F.lit(-1))
    return ln.with_cloud(records, ln.cloud_index(cloud), "cloud", ["DWH_"]).select("doc_id", F.size("lineage").alias("entries"), last["stage"].alias("stage"), last["table"].alias("table"), last["offline_path"].alias("path"), last["constraint"].alias("constraint"), "description")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE 'q' || quality END AS detail FROM documents LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def cloud_lookup_fallback(spark, d):
    labels = _t(spark, d, "labels").select(F.lit(0).alias("sheet_ord"), F.lit(0).alias("ord"), F.lit("DOC").alias("sheet_key"), F.lit(None).cast("string").alias("table"), F.col("doc_id").cast("string").alias("column"), F.concat(F.lit("q"), "quality").alias("description"))
    fields = _t(spark, d, "documents").select("doc_id", F.lit("dwh_doc").alias("table"), F.col("doc_id").cast("string").alias("column"))
    return ln.cloud_lookup(fields, ln.cloud_index(labels), ["DWH_"]).select("doc_id", F.col("detail.description").alias("detail"))


VIEWS = [("V1", "a", "V2", "b"), ("V2", "b", "V3", "c"), ("V2", "b", "BASE", "q"), ("V3", "c", "BASE", "p"), ("V4", "s", "V4", "s"), ("V5", "f", None, None), ("V6", "g", "V5", "f"), ("V7", "h", "BASE", "k"), *[(f"W{i}", "x", f"W{i + 1}", "x") for i in range(7)]]


def _views(spark) -> DataFrame:
    rows = [(i, v, c, None, t, s, None, None, "expr" if s is None else "direct") for i, (v, c, t, s) in enumerate(VIEWS)]
    df = spark.createDataFrame(rows, "ord int, target_table string, target_column string, source_schema string, source_table string, source_column string, source_alias string, source_role string, transformation_logic string")
    return ln.view_records(df.withColumn("path", F.lit("/a/Archive/v.sql")))


@query("""
SELECT * FROM (VALUES (0,'BASE.p','V2.B -> V3.C'),(1,'BASE.p','V3.C'),(2,NULL,NULL),(3,NULL,NULL),(4,'V4.s','V4.S'),(5,NULL,NULL),(6,'V5.f','V5.F'),(7,NULL,NULL),
(8,'W6.x','W1.X -> W2.X -> W3.X -> W4.X -> W5.X'),(9,'W7.x','W2.X -> W3.X -> W4.X -> W5.X -> W6.X'),(10,'W7.x','W3.X -> W4.X -> W5.X -> W6.X'),(11,'W7.x','W4.X -> W5.X -> W6.X'),(12,'W7.x','W5.X -> W6.X'),(13,'W7.x','W6.X'),(14,NULL,NULL)) t(ord, ultimate, via)
""")
def view_chain(spark, d):
    r = F.col("resolved_source")
    return ln.chain_views(_views(spark)).select("ord", F.when(r.isNotNull(), k.format_key(r["table"], r["column"])).alias("ultimate"), F.array_join(r["via"], " -> ").alias("via"))


@query("""
SELECT ord, CASE WHEN s IS NULL AND t IS NULL THEN 1 ELSE 2 END AS entries, v || '.' || c AS view_field, coalesce(t || '.', '') || coalesce(s, '') AS source_field, 'value' AS role FROM (VALUES
(0,'V1','a','V2','b'),(1,'V2','b','V3','c'),(2,'V2','b','BASE','q'),(3,'V3','c','BASE','p'),(4,'V4','s','V4','s'),(5,'V5','f',NULL,NULL),(6,'V6','g','V5','f'),(7,'V7','h','BASE','k'),
(8,'W0','x','W1','x'),(9,'W1','x','W2','x'),(10,'W2','x','W3','x'),(11,'W3','x','W4','x'),(12,'W4','x','W5','x'),(13,'W5','x','W6','x'),(14,'W6','x','W7','x')) t(ord, v, c, t, s)
""")
def view_records(spark, d):
    last = F.try_element_at(F.col("lineage"), F.lit(-1))
    src = F.get(last["sources"], F.lit(0))
    return _views(spark).select("ord", F.size("lineage").alias("entries"), k.format_key(last["table"], last["column"]).alias("view_field"), F.concat(F.coalesce(F.concat(src["table"], F.lit(".")), F.lit("")), F.coalesce(src["column"], F.lit(""))).alias("source_field"), src["role"].alias("role"))


@query("SELECT 'LINEITEM' AS table, l_linenumber::VARCHAR AS column, count(*) AS n FROM lineitem GROUP BY 2")
def target_key_counts(spark, d):
    key = ln.target_key("lineitem")
    return fk_records(spark, d).groupBy(key.alias("key")).agg(F.count("*").alias("n")).select("key.table", "key.column", "n")


def _doc_records(spark, d) -> DataFrame:
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select("doc_id", "lang").join(labels, "doc_id", "left")
    own = ln.entry(F.lit("dwh"), F.col("lang"), F.col("doc_id").cast("string"), F.lit("text"), None, None, F.array(ln.source(F.lit("SRC"), F.col("lang"), None, F.when(F.col("lang") == "en", F.lit("direct")))))
    cloud = ln.entry(F.lit("cloud"), F.col("lang"), F.col("doc_id").cast("string"))
    lineage = F.when(F.col("quality").isNotNull(), F.array(own, cloud)).otherwise(F.array(own))
    return rows.select(F.col("doc_id").alias("rec_id"), lineage.alias("lineage"), F.when(F.col("quality") == 1, F.lit("good")).alias("description"))


_RATIO = "{n} || '/' || {t} || ' (' || round_even(({n})::DOUBLE / {t} * 100.0::DOUBLE, 0)::BIGINT || '%)'"


@query(f"""
WITH r AS (SELECT doc_id, lang, quality FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
c AS (SELECT count(*) AS t, count(quality) AS q, count(*) FILTER (WHERE quality = 1) AS g, count(*) FILTER (WHERE lang = 'en') AS e FROM r)
SELECT t AS records, t AS distinct_target_fields, 0 AS n_to_1_target_fields, {_RATIO.format(n="q", t="t")} AS complete_chains, {_RATIO.format(n="g", t="t")} AS with_description, {_RATIO.format(n="e", t="t")} AS with_transformation_logic,
{_RATIO.format(n="t", t="t")} AS stage_dwh, {_RATIO.format(n="q", t="t")} AS stage_cloud, {_RATIO.format(n="t", t="t")} AS datatype_dwh, NULL::VARCHAR AS datatype_cloud FROM c
""")
def coverage_summary(spark, d):
    return ln.coverage(_doc_records(spark, d), ["dwh", "cloud"])


@query("""
WITH loose AS (SELECT 'dwh: ' || upper(lang) || '.' || doc_id AS x, upper(lang) AS a, doc_id::VARCHAR AS b FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT (SELECT count(*) FROM documents) AS chains, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS complete_chains, (SELECT count(*) FROM loose) AS unmatched_tails_count,
(SELECT string_agg(x, '; ' ORDER BY a, b) FROM (SELECT * FROM loose ORDER BY a, b LIMIT 5)) AS unmatched_tails_examples, 0 AS unmatched_heads_count, '' AS unmatched_heads_examples
""")
def chain_diagnostics(spark, d):
    return ln.diagnostics(_doc_records(spark, d), ["dwh", "cloud"])


@query("SELECT * FROM (VALUES ('source', 1), ('staging', 2), ('dwh', 3), ('cloud', 4)) t(stage, place)")
def stage_order(spark, d):
    chains = [(0, ["dwh"]), (1, ["source", "staging", "dwh"]), (2, ["dwh", "cloud"])]
    df = spark.createDataFrame(chains, "rec_id int, s array<string>").select("rec_id", F.transform("s", lambda s: F.struct(s.alias("stage"))).alias("lineage"))
    return ln.stages_in(df)


@query("""
SELECT *, CASE WHEN expected <> fields_covered THEN 'expected ' || expected || ' fields, got ' || fields_covered || ' from ' || records_emitted || ' records' END AS error FROM (
  SELECT o_custkey, count(DISTINCT upper(trim(o_orderpriority))) AS fields_covered, count(*) AS records_emitted, CASE WHEN o_custkey % 2 = 0 THEN 4 END AS expected FROM orders GROUP BY o_custkey)
""")
def completeness_check(spark, d):
    rows = _t(spark, d, "orders").withColumn("expected", F.when(F.expr("o_custkey % 2 = 0"), F.lit(4)))
    return checks.completeness(rows, ["o_custkey"], "o_orderpriority", "expected")


@query("""
SELECT doc_id, count(*) FILTER (WHERE ok) AS verified, count(*) AS checked, 0::BIGINT AS nulls, coalesce(string_agg('table: ' || item, '|' ORDER BY 'table: ' || item) FILTER (WHERE NOT ok), '') AS missing FROM (
  SELECT d.doc_id, b.text AS item, contains(d.text, b.text) AS ok FROM documents d JOIN benchmark b ON b.item_id % 8 = d.doc_id % 8 WHERE d.doc_id % 4 <> 0
  UNION ALL SELECT d.doc_id, b.text, b.text = '' FROM documents d JOIN benchmark b ON b.item_id % 8 = d.doc_id % 8 WHERE d.doc_id % 4 = 0) GROUP BY doc_id
""")
def fidelity_benchmark(spark, d):
    """Benchmark passages as values of a document's records; every fourth document has no text to find them in."""
    docs, b = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    rows = docs.select("doc_id", F.expr("doc_id % 8").alias("slot")).join(b.select(F.expr("item_id % 8").alias("slot"), F.col("text").alias("table")), "slot").drop("slot")
    got = checks.fidelity(rows, docs.where("doc_id % 4 <> 0").select("doc_id", "text"), ["table"], "doc_id")
    return got.withColumn("missing", F.array_join("missing", "|"))


@query("""
SELECT doc_id, sum(CASE WHEN contains(text, lang) THEN 1 ELSE 0 END + CASE WHEN contains(text, source) THEN 1 ELSE 0 END)::BIGINT AS verified, 2 * count(*) AS checked, 0::BIGINT AS nulls FROM documents GROUP BY 1
""")
def fidelity_check(spark, d):
    docs = _t(spark, d, "documents")
    return checks.fidelity(docs.select("doc_id", "lang", "source"), docs.select("doc_id", "text"), ["lang", "source"], "doc_id").drop("missing")


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing k' ELSE '' END AS errors FROM events")
def shape_check(spark, d):
    rows = _t(spark, d, "events").withColumn("raw", F.col("props"))
    return rows.select("event_id", F.array_join(checks.shape_errors(["k"], []), "; ").alias("errors"))


@query("SELECT (count(*) - count(quality)) * 2 AS nulls FROM documents LEFT JOIN labels USING (doc_id)")
def null_count(spark, d):
    return checks.null_count(_t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left"))


HEADS = [
    (0, ["Target Table Name", "STG_A"], False), (1, ["Target Column", "Target Datatype", "Target Size", "Source Table", "Source Column"], True), (2, ["source field", "target x", "a", "b"], False),
    (3, ["x", None, "y", "z"], False), (4, ["Source Field", "Đích", " TARGET ", "Nguồn"], True),
]


@query("SELECT * FROM (VALUES (0, false), (1, true), (2, false), (3, false), (4, true)) t(ord, is_header)")
def header_row_detect(spark, d):
    df = spark.createDataFrame([h[:2] for h in HEADS], "ord int, cells array<string>")
    return df.select("ord", k.header_row("cells", [list(g) for g in kinds.anchors("hop_spec")]).alias("is_header"))


SQLS = [
    'CREATE VIEW "A B" ("X","Y Z") AS SELECT 1', "create or replace view v (x, y) as select 1", "select 1", 'VIEW "S"."V" ("A") AS\nselect 1', 'create view my-view ("P" , "Q")\n as select ")" as x', 'VIEW w ("a" /* (one) */, "b") AS SELECT 2', "view x.y() as  ", 'VIEW "no end" ("a" AS select',
]
_VIEW = r"VIEW\s+(\"(?:[^\"]+)\"|\S+)\s*\((.*?)\)\s*AS\s".replace("\\\"", '"')
_TEXTS = ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(SQLS))


@query(f"""
WITH t(ord, text) AS (VALUES {_TEXTS}), m AS (SELECT ord, regexp_extract(text, '{_VIEW}', 1, 'si') AS name, regexp_extract_all(regexp_extract(text, '{_VIEW}', 2, 'si'), '"([^"]+)"', 1) AS cols FROM t)
SELECT ord, nullif(trim(name, '"'), '') AS view_name, array_to_string(cols, '|') AS columns, nullif(len(cols), 0) AS expected FROM m
""")
def declared_view_columns(spark, d):
    df = spark.createDataFrame(list(enumerate(SQLS)), "ord int, text string")
    cols = k.view_columns("text")
    return df.select("ord", k.view_name("text").alias("view_name"), F.array_join(cols, "|").alias("columns"), F.nullif(F.size(cols), F.lit(0)).alias("expected"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty file' WHEN NOT contains(lower(text), 'select') THEN 'no select' END AS error FROM documents")
def input_check(spark, d):
    return _t(spark, d, "documents").select("doc_id", checks.sql_input_error("text").alias("error"))


def _scored(spark, d) -> DataFrame:
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("/a/"), "c_name").alias("dwh_path"), F.col("c_mktsegment").alias("description"), F.col("c_name").alias("dwh_table"))
    made = c.where("key % 10 <> 0").withColumns({"description": F.when(F.expr("key % 3 = 0"), F.lower("description")).otherwise(F.col("description")), "dwh_path": F.when(F.expr("key % 7 = 0"), F.concat("dwh_path", F.lit("x"))).otherwise(F.regexp_replace("dwh_path", "/a/", "/b/")), "dwh_table": F.when(F.expr("key % 4 = 0"), F.concat(F.lit("/x/"), "dwh_table")).otherwise(F.col("dwh_table"))})
    return checks.matched(c, made, ["key"])


SCORED = ["dwh_table", "dwh_path", "description"]
_SCORE = """
WITH m AS (SELECT c_custkey AS key, c_name AS name, '/a/' || c_name AS p, c_mktsegment AS s FROM customer WHERE c_custkey % 10 <> 0),
c AS (SELECT key, 0 AS place, 'dwh_table' AS "column", name AS a, CASE WHEN key % 4 = 0 THEN '/x/' || name ELSE name END AS b FROM m
  UNION ALL SELECT key, 1, 'dwh_path', p, CASE WHEN key % 7 = 0 THEN p || 'x' ELSE '/b/' || name END FROM m UNION ALL SELECT key, 2, 'description', s, CASE WHEN key % 3 = 0 THEN lower(s) ELSE s END FROM m),
k AS (SELECT *, a = b OR (ends_with("column", '_path') AND split_part(a, '/', -1) = split_part(b, '/', -1)) OR ("column" = 'description' AND left(a, 40) = left(b, 40)) AS ok FROM c),
x AS (SELECT "column", count(*) FILTER (WHERE ok) AS agree, count(*) AS compared FROM k GROUP BY 1)
"""


@query(_SCORE + 'SELECT * FROM x UNION ALL SELECT \'(all)\', sum(agree)::BIGINT, sum(compared)::BIGINT FROM x')
def score_by_column(spark, d):
    return checks.score(_scored(spark, d), SCORED, ["key"])


@query(_SCORE + "SELECT sum(agree)::BIGINT AS agree, sum(compared)::BIGINT AS compared, (SELECT count(*) FROM customer) AS manual_rows, (SELECT count(*) FROM m) AS matched_rows FROM x")
def score_overall(spark, d):
    both = _scored(spark, d)
    rows = both.agg(F.count("m").alias("manual_rows"), F.count_if(F.col("m").isNotNull() & F.col("p").isNotNull()).alias("matched_rows"))
    total = checks.score(both, SCORED, ["key"]).where("column = '(all)'").select("agree", "compared")
    return total.crossJoin(rows)  # one row each


@query(_SCORE + 'SELECT key, "column", left(a, 8) AS manual, left(b, 8) AS program FROM (SELECT * FROM k WHERE NOT ok ORDER BY key, place LIMIT 40)')
def score_mismatches(spark, d):
    return checks.mismatches(_scored(spark, d), SCORED, ["key"], shown=8)


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey % 10 = 0 ORDER BY 1 LIMIT 10")
def score_unmatched_first(spark, d):
    return checks.unmatched(_scored(spark, d), ["key"])


_VIEWS_A = [(1, "s", "BASE", "C", "Value", "/x/v.sql", "COALESCE( (SELECT  x , y) )", "V"), (2, "", "T", "c", "join", "", "a + b", "W"), (3, None, "u", "d", None, "a/b", "f(x)", "w")]
_VIEWS_B = [(1, "S", "base", "c", "value", "/y/v.sql", "coalesce((select x,y))", "v"), (2, None, "U", "C", "value", None, "a - b", "W"), (3, "", "U", "D", None, "c/b", "F( x )", "W")]
_VIEW_SCORED = ["source_schema", "source_table", "source_column", "role", "path", "transformation", "view_name"]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


@query(rf"""
WITH n(key, source_schema, source_table, source_column, role, path, transformation, view_name) AS (VALUES {_values(_VIEWS_A)}), p(key, source_schema, source_table, source_column, role, path, transformation, view_name) AS (VALUES {_values(_VIEWS_B)}),
c AS (SELECT m.col AS "column", trim(coalesce(m.v, '')) AS a, trim(coalesce(q.v, '')) AS b FROM (FROM n UNPIVOT INCLUDE NULLS (v FOR col IN (source_schema, source_table, source_column, role, path, transformation, view_name))) m JOIN (FROM p UNPIVOT INCLUDE NULLS (v FOR col IN (source_schema, source_table, source_column, role, path, transformation, view_name))) q ON m.key = q.key AND m.col = q.col),
k AS (SELECT *, a = b OR ("column" IN ('source_schema', 'source_table', 'source_column', 'role') AND upper(a) = upper(b)) OR ("column" = 'path' AND split_part(a, '/', -1) = split_part(b, '/', -1))
  OR ("column" = 'transformation' AND regexp_replace(regexp_replace(lower(a), '\s+', ' ', 'g'), '\s*([(),])\s*', '\1', 'g') = regexp_replace(regexp_replace(lower(b), '\s+', ' ', 'g'), '\s*([(),])\s*', '\1', 'g')) AS ok FROM c WHERE a <> '' OR b <> '')
SELECT coalesce("column", '(all)') AS "column", count(*) FILTER (WHERE ok) AS agree, count(*) AS compared FROM k GROUP BY ROLLUP("column")
""")
def score_views(spark, d):
    names = "key int, " + ", ".join(f"{c} string" for c in _VIEW_SCORED)
    a, b = spark.createDataFrame(_VIEWS_A, names), spark.createDataFrame(_VIEWS_B, names)
    return checks.score(checks.matched(a, b, ["key"]), _VIEW_SCORED, ["key"], checks.equal_views)


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey % 10 = 0")
def score_unmatched(spark, d):
    return _scored(spark, d).where("p is null").select("key")


@query(r"SELECT doc_id, md5(regexp_replace(lower(regexp_replace(trim(text), '\s+', ' ', 'g')), '\s*([(),])\s*', '\1', 'g')) AS squashed FROM documents")
def squash_expression(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(k.squash("text")).alias("squashed"))


@query("SELECT page_id, split_part(url, '/', -1) AS base FROM pages")
def path_basename(spark, d):
    return _t(spark, d, "pages").select("page_id", k.basename("url").alias("base"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Archive/' || page_id ELSE url END AS short FROM pages")
def short_path(spark, d):
    p = F.when(F.expr("page_id % 2 = 0"), F.concat(F.lit("/home/u/Archive/"), "page_id")).otherwise(F.col("url"))
    return _t(spark, d, "pages").select("page_id", k.short_path(p).alias("short"))


@query("SELECT a.source, count(*) AS n, count(*) FILTER (WHERE a.text = b.text OR left(a.text, 40) = left(b.text, 40)) AS equal FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 GROUP BY 1")
def prefix_equal(spark, d):
    """Neighbouring documents compared as descriptions are."""
    docs = _t(spark, d, "documents")
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count_if(checks.equal_archive(F.lit("description"), F.col("text"), F.col("other"))).alias("equal"))


@query("SELECT * FROM (VALUES (0, 'DWH_BCD'), (1, ''), (2, 'SRC_X1Y, STG_B_C')) t(ord, dependencies)")
def dependency_tokens(spark, d):
    rows = [(0, "join STG_ABC and dwh_bcd, SRC_xy; STG_ABC", "STG_ABC"), (1, None, None), (2, "stg_b_c.x = src_x1y.y", None)]
    return spark.createDataFrame(rows, "ord int, logic string, own string").select("ord", k.dependency_tokens("logic", "own").alias("dependencies"))


_WIDE = ", ".join(
    f"'{s.upper()}' AS {s}_table, {c}::VARCHAR AS {s}_column, 'Archive/{p}.xlsx' AS {s}_path, 'bigint' AS {s}_datatype, NULL::VARCHAR AS {s}_size"
    for s, c, p in (("region", "n_regionkey", "nation"), ("nation", "n_nationkey", "nation"), ("customer", "c_custkey", "customer"), ("orders", "o_orderkey", "orders"), ("lineitem", "l_linenumber", "lineitem"))
)


@query(f"""
SELECT {_WIDE}, NULL::VARCHAR AS part_table, NULL::VARCHAR AS part_column, NULL::VARCHAR AS part_path, NULL::VARCHAR AS part_datatype, NULL::VARCHAR AS part_size,
CASE WHEN l_linenumber = 1 THEN 'first' END AS description, '1-1' AS type, 'direct' AS rule, NULL::VARCHAR AS dependencies, count(*) AS n FROM {_CHAIN} GROUP BY ALL
""")
def wide_row_pivot(spark, d):
    """All columns, with a stage that no record has."""
    records = fk_records(spark, d).withColumn("description", F.when(F.col("target_column") == "1", F.lit("first")))
    wide = records.select(*ln.wide_row(["region", "nation", "customer", "orders", "lineitem", "part"]))
    return ln.spread(wide, "lineitem_column", "orders_column", times=4).groupBy(*wide.columns).agg(F.count("*").alias("n"))


@query(f"""
SELECT 'ORDERS' AS orders_table, o_orderkey::VARCHAR AS orders_column, '/data/Archive/orders.xlsx' AS orders_path, 'bigint' AS orders_datatype, '' AS orders_size, '' AS part_table, '' AS part_column, '' AS part_path, '' AS part_datatype, '' AS part_size, '' AS description, 'direct' AS logic, count(*) AS n FROM {_CHAIN} GROUP BY ALL
""")
def flat_row(spark, d):
    """The cells that a record is scored by."""
    flat = fk_records(spark, d).withColumn("description", F.lit(None).cast("string")).select(*ln.flat_row(["orders", "part"]))
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("n"))


@query("""
SELECT ord, NULL::VARCHAR AS source_schema, t AS source_table, s AS source_column, v AS view_name, c AS view_column, 'value' AS role, CASE WHEN s IS NULL THEN 'expr' ELSE 'direct' END AS transformation, 'v.sql' AS path, NULL::VARCHAR AS alias FROM (VALUES
(0,'V1','a','V2','b'),(1,'V2','b','V3','c'),(2,'V2','b','BASE','q'),(3,'V3','c','BASE','p'),(4,'V4','s','V4','s'),(5,'V5','f',NULL,NULL),(6,'V6','g','V5','f'),(7,'V7','h','BASE','k'),
(8,'W0','x','W1','x'),(9,'W1','x','W2','x'),(10,'W2','x','W3','x'),(11,'W3','x','W4','x'),(12,'W4','x','W5','x'),(13,'W5','x','W6','x'),(14,'W6','x','W7','x')) t(ord, v, c, t, s)
""")
def view_wide_row(spark, d):
    return ln.chain_views(_views(spark)).select("ord", *ln.view_wide_row()).drop("ultimate", "via")


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn FROM conversations),
w AS (SELECT conv_id, turn, turn - 1 AS here, 0 AS n FROM t UNION ALL SELECT w.conv_id, w.turn, here - 1, n + 1 FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.here WHERE n < 5)
SELECT conv_id, turn, CASE WHEN max(n) > 0 THEN min(here) END AS origin, max(n) AS hops FROM w GROUP BY 1, 2
""")
def view_chain_turns(spark, d):
    """Turns as views that read the turn before; the turn before the first is no view."""
    c = _t(spark, d, "conversations")
    name = lambda x: F.concat(F.lit("V"), "conv_id", F.lit("_"), x)
    none = F.lit(None).cast("string")
    rows = c.select("conv_id", "turn", F.lit(0).alias("ord"), name(F.col("turn")).alias("target_table"), F.lit("x").alias("target_column"), none.alias("source_schema"), name(F.col("turn") - 1).alias("source_table"), F.lit("x").alias("source_column"), none.alias("source_alias"), none.alias("source_role"), none.alias("transformation_logic"), F.lit("/v.sql").alias("path"))
    r = F.col("resolved_source")
    return ln.chain_views(ln.view_records(rows)).select("conv_id", "turn", F.regexp_extract(r["table"], r"_(-?\d+)$", 1).cast("long").alias("origin"), F.coalesce(F.size(r["via"]), F.lit(0)).alias("hops"))


@query("""
SELECT path, sum(CASE WHEN ord > head THEN 1 END)::BIGINT AS expected FROM (SELECT user_id::VARCHAR AS path, r AS ord, min(CASE WHEN event_type = 'click' THEN r END) OVER (PARTITION BY user_id) AS head FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events)) GROUP BY 1
""")
def expected_rows(spark, d):
    """Rows below the first header of each sheet; a click event stands for a header row."""
    e = _t(spark, d, "events").withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    head = F.array(F.lit("Target Field"), F.lit("x"), F.lit("Source"), F.lit("y"))
    cells = e.select(F.col("user_id").cast("string").alias("path"), F.lit("s").alias("sheet"), "ord", F.when(F.col("event_type") == "click", head).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).alias("cells"))
    got = checks.expected_rows(cells, kinds.anchors("hop_spec")).select("path", "expected")
    return got.withColumn("expected", F.when(F.col("expected") > 0, F.col("expected")))


@query("SELECT doc_id, 'view_sql|' || substr(sha256(text), 1, 16) || '|None' AS content_key FROM documents")
def content_key(spark, d):
    return _t(spark, d, "documents").select("doc_id", k.content_key(F.lit("view_sql"), "text", F.lit(None).cast("string")).alias("content_key"))


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source IN ('src0', 'src1'))")
def cache_misses(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "source", k.content_key(F.lit("view_sql"), "text", F.lit(None).cast("string")).alias("content_key"))
    return checks.misses(rows, rows.where("source in ('src0', 'src1')")).select("doc_id")


@query("""
SELECT source, count(*) AS files, count(*) FILTER (WHERE NOT cached) AS converted, count(*) FILTER (WHERE NOT contains(lower(text), 'select')) AS failed, count(*) FILTER (WHERE NOT contains(lower(text), 'select')) AS problems
FROM (SELECT *, doc_id % 3 = 0 AS cached FROM documents) GROUP BY 1
""")
def report_rollup(spark, d):
    error = checks.sql_input_error("text")
    rows = _t(spark, d, "documents").select("source", F.expr("doc_id % 3 = 0").alias("cached"), F.when(error.isNull(), F.lit("[]")).alias("records"), F.when(error.isNotNull(), F.array(error)).alias("errors"))
    return checks.roll_up(rows, ["source"])


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles, count(*) FILTER (WHERE turn % 4 = 0) AS lost FROM conversations GROUP BY 1)
SELECT conv_id::VARCHAR AS path, roles || '/' || CASE WHEN conv_id % 2 = 0 THEN '2' ELSE 'unknown' END AS fields_covered, n AS records_emitted, n || '/' || n AS schema_clean_records, (2 * n - lost) || '/' || 2 * n AS fidelity_verified, 4 * n AS output_null_count,
lost + CASE WHEN conv_id % 2 = 0 AND roles <> 2 THEN 1 ELSE 0 END AS problems FROM (SELECT conv_id, n, lost, CASE WHEN conv_id % 2 = 0 THEN roles ELSE n END AS roles FROM c)
""")
def validation_roll_up(spark, d):
    """Conversations as view scripts: a turn is a record whose table, every fourth time, is not in the script."""
    c = _t(spark, d, "conversations")
    none = F.lit(None).cast("string")
    table = F.when(F.expr("turn % 4 = 0"), F.lit("absent")).otherwise(F.concat(F.lit("t"), "turn"))
    record = F.to_json(F.struct(table.alias("target_table"), F.col("role").alias("target_column"), none.alias("source_schema"), none.alias("source_table"), none.alias("source_column"), none.alias("source_alias"), F.lit("value").alias("source_role"), F.lit("direct").alias("transformation_logic")), {"ignoreNullFields": "false"})
    files = c.withColumns({"r": record, "t": F.concat(F.lit("t"), "turn", F.lit(" "), "role")}).groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("records"), F.array_join(F.collect_list("t"), ";").alias("text"))
    files = files.select(F.col("conv_id").cast("string").alias("path"), F.lit("view_sql").alias("kind"), "records", "text", F.when(F.expr("conv_id % 2 = 0"), F.lit(2)).cast("long").alias("expected"))
    return checks.validated(files).select("path", "metrics.*", F.size("errors").alias("problems"))


@query("""
WITH a AS (SELECT c_custkey AS key FROM customer), b AS (SELECT o_custkey AS key FROM orders)
SELECT 'both' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'bag', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
""")
def set_ops(spark, d):
    return checks.set_counts(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").select("o_custkey"))
