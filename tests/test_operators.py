"""Branches that the registered queries don't reach."""

from pyspark.sql import functions as F

from tracelake.functions import keys as k
from tracelake.operators import checks, lineage as ln


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_keys(spark):
    assert one(spark, k.normalize(F.lit("  ab\t"))) == "AB"
    assert one(spark, k.squash(F.lit("COALESCE( (SELECT  x , y) )"))) == "coalesce((select x,y))"
    assert one(spark, k.short_path(F.lit("/home/u/Archive/H1/T.xlsx"))) == "Archive/H1/T.xlsx"
    assert one(spark, k.ratio(F.lit(1), F.lit(8))) == "1/8 (12%)"
    assert one(spark, k.ratio(F.lit(23), F.lit(40))) == "23/40 (57%)"
    assert one(spark, k.key_of(F.lit(None).cast("string"), F.lit("a"))) != one(spark, k.key_of(F.lit(""), F.lit("a")))
    assert one(spark, k.strip_prefix(F.lit("dwh_p"), "DWH_")) == "p"


def test_cloud_lookup(spark):
    rows = [(0, 0, "TXN", None, "ID", "d1"), (0, 1, "DWH_TXN", None, "ID", "d2"), (0, 2, "DWH_TXN", None, "ID", "d3"), (0, 3, "P", None, "ID", "d4")]
    index = ln.cloud_index(spark.createDataFrame(rows, "sheet_ord int, ord int, sheet_key string, table string, column string, description string"))
    fields = spark.createDataFrame([("DWH_TXN", "id"), ("DWH_P", "id"), ("dwh_p", "id"), ("OTHER", "id")], "table string, column string")
    got = {r.table: r.detail and r.detail.description for r in ln.cloud_lookup(fields, index, ["DWH_"]).collect()}
    assert got == {"DWH_TXN": "d2", "DWH_P": "d4", "dwh_p": "d4", "OTHER": None}


def test_completeness(spark):
    df = spark.createDataFrame([(1, "A"), (1, " a"), (1, "B"), (2, None)], "f int, target_column string")
    got = {r.f: (r.fields_covered, r.records_emitted) for r in checks.completeness(df, ["f"]).collect()}
    assert got == {1: (2, 3), 2: (1, 1)}


def test_tail_and_null_safe_match(spark):
    own = ln.source(F.lit("STG_ABC"), F.lit("c"), F.lit("1-1"), F.lit("join STG_ABC and dwh_bcd"))
    rec = spark.range(1).select(F.lit("d").alias("description"), F.array(ln.entry(F.lit("dwh"), F.lit("T"), F.lit("c"), sources=F.array(own))).alias("lineage"))
    assert tuple(rec.select(ln.tail().alias("t")).first().t) == ("d", "1-1", "join STG_ABC and dwh_bcd", "DWH_BCD")
    a = spark.createDataFrame([(None, 1), ("x", 2)], "key string, v int")
    both = checks.matched(a, a, ["key"])
    assert both.where("m is not null and p is not null").count() == 2


def test_walk_deals_rows_out(spark):
    """Fields of few origins, and rows without a source, don't meet in one task."""
    n = F.lit(None).cast("string")
    extra = {c: n for c in ("target_datatype", "target_size", "source_datatype", "source_size", "transformation_type", "transformation_logic", "source_role")}
    rows = [("O", f"o{i}", "C", f"c{i % 40}") for i in range(400)] + [("C", f"c{i}", "R", "r") for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "sheet string, target_column string, source_table string, source_column string").withColumns({"table_key": F.col("sheet"), "path": F.lit("/a"), "from_stage": F.lit("s0"), "to_stage": F.lit("s1"), "ord": F.lit(0), **extra})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = ln.edges(frame(rows))
        up = ln.paths(step).select(F.spark_partition_id().alias("task"), F.size("path").alias("n"), "p_table").collect()
        assert sorted({(r.p_table, r.n) for r in up}) == [("C", 1), ("O", 2)] and len(up) == 440
        assert len({r.task for r in up if r.p_table == "O"}) > 1
        targets = frame([("T", f"t{i}", None, None) for i in range(100)] + [("T", "x", "O", "o1")])
        got = ln.walk(targets, step).select(F.spark_partition_id().alias("task"), F.transform("lineage", lambda e: e["column"]).alias("c")).collect()
        assert len(got) == 101 and ["r", "c1", "o1", "x"] in [r.c for r in got]
        assert len({r.task for r in got if len(r.c) == 1}) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
