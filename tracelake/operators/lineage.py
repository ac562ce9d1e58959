"""Catalog precedence, the backward walk, final-stage lookup and view chaining.

Order is data here ("the first match wins"), so every extraction row carries
``ord``; nothing relies on the order that Spark happens to return rows in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import keys as k

#: Cells that a record has for each of its stages, in order.
FIELDS = ["table", "column", "path", "datatype", "size"]
#: A walk follows this many owned fields upstream; a view chain this many views.
WALK_STEPS, VIEW_STEPS = 7, 5

SOURCE = "struct<schema:string,table:string,column:string,alias:string,transformation_type:string,transformation_logic:string,role:string>"
ENTRY = f"struct<stage:string,schema:string,table:string,column:string,datatype:string,size:string,constraint:string,doc_link:string,offline_path:string,sources:array<{SOURCE}>>"


def _null() -> Column:
    return F.lit(None).cast("string")


def source(table, column, type_=None, logic=None, role=None, schema=None, alias=None) -> Column:
    pick = lambda x: _null() if x is None else x
    return F.struct(pick(schema), pick(table), pick(column), pick(alias), pick(type_), pick(logic), k.role(pick(role))).cast(SOURCE)


def entry(stage, table, column, datatype=None, size=None, path=None, sources=None, schema=None, constraint=None) -> Column:
    pick = lambda x: _null() if x is None else x
    own = F.array().cast(f"array<{SOURCE}>") if sources is None else sources
    return F.struct(pick(stage), pick(schema), pick(table), pick(column), pick(datatype), pick(size), pick(constraint), _null(), pick(path), own).cast(ENTRY)


def catalog(files: DataFrame, hops: DataFrame, stages: list[str]) -> DataFrame:
    """One file a table. files: (seq, stage_dir, path, stem, table, sheet), seq of any type with an order; hops: (hop_ord, dir, from_stage, to_stage).

    The last authoritative file wins (its name is the table's, or that and ``_V...``), otherwise the first one.
    A folder that no hop names maps from the first stage to the last.
    """
    table, stem = k.normalize("table"), k.normalize("stem")
    sure = (stem == table) | F.startswith(stem, F.concat(table, F.lit("_V")))
    first = hops.groupBy("dir").agg(F.min(F.struct("hop_ord", "from_stage", "to_stage")).alias("hop"))
    rows = files.withColumn("table_key", table).withColumn("authoritative", sure).where("table_key <> ''")
    row = F.struct(*rows.columns)
    last = F.max_by(row, F.when(F.col("authoritative"), F.col("seq")))
    rows = rows.groupBy("table_key").agg(F.coalesce(last, F.min_by(row, "seq")).alias("r")).select("r.*")
    rows = rows.join(first, rows.stage_dir == first.dir, "left")
    return rows.select("table_key", "path", "sheet", "stage_dir", F.coalesce("hop.from_stage", F.lit(stages[0])).alias("from_stage"), F.coalesce("hop.to_stage", F.lit(stages[-1])).alias("to_stage"), "authoritative")


def hop_rows(owners: DataFrame, hop: DataFrame) -> DataFrame:
    """Extraction rows with their owner; all rows of a field stay. owners: a catalog; hop rows have (path, sheet, ord, HOP columns)."""
    return owners.join(hop, ["path", "sheet"])


def wanted(owners: DataFrame, last_dir: str, names: list[str] | None = None) -> DataFrame:
    """(table_key, known) of the tables to build: the named ones, or else those of the last hop's folder; known: the catalog has it."""
    if not names:
        return owners.where(F.col("stage_dir") == last_dir).select("table_key", F.lit(True).alias("known"))
    asked = owners.sparkSession.createDataFrame([(n,) for n in names], "n string").select(k.normalize("n").alias("table_key")).distinct()
    return asked.join(owners.select("table_key", F.lit(True).alias("known")), "table_key", "left").select("table_key", F.coalesce("known", F.lit(False)).alias("known"))


def final_names(targets: DataFrame, prefixes: list[str]) -> DataFrame:
    """(table_key) under which the final stage may file the targets: with each prefix, and without it."""
    own = F.array(F.col("table_key"), *[k.strip_prefix("table_key", p) for p in prefixes])
    return targets.select(F.explode(own).alias("table_key")).where("table_key is not null").distinct()


def spread(rows: DataFrame, *by: str, times: int = 1) -> DataFrame:
    """Rows dealt by columns over ``times`` the set number of shuffle partitions.

    A number that is asked for stays. Otherwise Spark merges partitions by their
    compressed bytes, and rows of alike paths are many times larger in memory.
    """
    return rows.repartition(times * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def edges(owned: DataFrame) -> DataFrame:
    """The first row of each owned field: what a walk steps over. Unique keys, so that no left join fans out."""
    rows = spread(owned.withColumn("column_key", k.normalize("target_column")).where("column_key <> ''"), "column_key", "table_key")
    first = Window.partitionBy("column_key", "table_key").orderBy("ord")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def _source_of(e) -> Column:
    return F.array(source(e("source_table"), e("source_column"), e("transformation_type"), e("transformation_logic"), e("source_role")))


_LINK = ("to_stage", "from_stage", "name", "path", "target_datatype", "target_size", "source_table", "source_column", "source_datatype", "source_size", "transformation_type", "transformation_logic", "source_role")


def _next(own: Column) -> list[Column]:
    """(n_column, n_table): the stated source's key. What can be no field has no table, so it meets nothing, and is dealt out by ``own``."""
    t, c = k.normalize("source_table"), k.normalize("source_column")
    is_key = t.isNotNull() & F.coalesce(c != "", F.lit(False))
    return [F.when(is_key, c).otherwise(own).alias("n_column"), F.when(is_key, t).alias("n_table")]


def paths(step: DataFrame, steps: int = WALK_STEPS) -> DataFrame:
    """(p_table, p_column, path): the fields upstream of each owned field, itself first, cut after ``steps`` or before a field comes again.

    step: unique edges. Only fields that others state as their source are joined with
    themselves; their paths double (what lies 1, 2, 4 ... fields up is appended), so 7
    steps take three joins over those, and every field then takes the path of its source.
    A field whose source is not owned is not looked up again, so that fields of few
    origins don't meet at those.
    """
    link = F.struct(k.key_of("table_key", "column_key").alias("key"), *[F.col(c) for c in _LINK])
    key, own = ["p_column", "p_table"], F.xxhash64("p_column", "p_table").cast("string")
    rows = step.withColumn("name", k.strip("sheet"))
    rows = rows.select(F.col("column_key").alias("p_column"), F.col("table_key").alias("p_table"), F.array(link).alias("path"), *_next(F.xxhash64("column_key", "table_key").cast("string")))
    asked = step.select(k.normalize("source_column").alias("p_column"), k.normalize("source_table").alias("p_table")).distinct()
    inner = rows.join(asked, key, "left_semi")
    owned = inner.select(F.col("p_column").alias("n_column"), F.col("p_table").alias("n_table"), F.lit(True).alias("owned"))
    inner = spread(inner, "n_column", "n_table").join(owned, ["n_column", "n_table"], "left")
    inner = inner.select(*key, "path", F.when(F.col("owned"), F.col("n_column")).otherwise(own).alias("n_column"), F.when(F.col("owned"), F.col("n_table")).alias("n_table"))

    def stepped(rows: DataFrame) -> DataFrame:
        on = inner.select(F.col("p_column").alias("n_column"), F.col("p_table").alias("n_table"), F.col("path").alias("more"), F.col("n_column").alias("m_column"), F.col("n_table").alias("m_table"))
        go = F.col("m_table").isNotNull()
        got = F.when(F.col("more").isNotNull(), F.concat("path", "more")).otherwise(F.col("path"))
        rows = spread(rows, "n_column", "n_table").join(on, ["n_column", "n_table"], "left")
        return rows.select(*key, got.alias("path"), F.when(go, F.col("m_column")).otherwise(own).alias("n_column"), F.when(go, F.col("m_table")).alias("n_table"))

    have = 1
    while have < steps - 1:
        inner, have = stepped(inner), 2 * have
    rows = stepped(rows) if steps > 1 else rows
    # up to the first field that came before
    keys = F.transform("path", lambda e: e["key"])
    again = lambda i: F.array_contains(F.slice("keys", 1, i), F.get("keys", i))
    at = F.array_min(F.filter(F.sequence(F.lit(0), F.size("keys") - 1), again))
    at = F.when(F.size(F.array_distinct("keys")) < F.size("keys"), at).otherwise(F.size("keys"))
    rows = rows.withColumn("keys", keys).withColumn("n", F.least(at, F.lit(steps)).cast("int"))
    return rows.select(*key, F.slice("path", 1, F.col("n")).alias("path"))


def walk(targets: DataFrame, step: DataFrame, steps: int = WALK_STEPS) -> DataFrame:
    """Lineage records of owned target rows, origin first: adds ``lineage`` array<ENTRY>.

    Every row takes the path of the field that it states as its source, in one left
    join on unique fields, so targets keep their number. The path ends where the row's
    own field comes up; what is still pointed at there is the origin.
    """
    up = paths(step, steps).withColumnRenamed("path", "_up")
    rows = targets.where(k.stated("target_column"))
    own = F.xxhash64("path", "ord", "target_column").cast("string")
    rows = spread(rows.select("*", *_next(own)), "n_column", "n_table")
    none = F.array().cast(f"array<{ENTRY}>")
    rows = rows.join(up, (F.col("n_column") == F.col("p_column")) & (F.col("n_table") == F.col("p_table")), "left")
    met = F.array_position(F.transform("_up", lambda e: e["key"]), k.key_of("sheet", "target_column")).cast("int")
    rows = rows.withColumn("_up", F.when(met > 0, F.slice("_up", 1, met - 1)).otherwise(F.col("_up")))
    last = F.get("_up", F.size("_up") - 1)
    still = lambda c, own=None: F.when(F.coalesce(F.size("_up"), F.lit(0)) > 0, last[c]).otherwise(F.col(own or c))
    origin = entry(still("from_stage"), still("source_table"), still("source_column"), still("source_datatype"), still("source_size"), still("path"))
    # a field is spelled as the row below it spells it
    named = lambda i: F.when(i == 0, F.col("source_column")).otherwise(F.get("_up", i - 1)["source_column"])
    chain = F.reverse(F.transform("_up", lambda e, i: entry(e["to_stage"], e["name"], named(i), e["target_datatype"], e["target_size"], e["path"], _source_of(lambda c: e[c]))))
    own = entry(F.col("to_stage"), k.strip("sheet"), F.col("target_column"), F.col("target_datatype"), F.col("target_size"), F.col("path"), _source_of(F.col))
    lineage = F.concat(F.when(k.stated(still("source_column")), F.array(origin)).otherwise(none), F.coalesce(chain, none), F.array(own))
    return rows.withColumn("lineage", lineage).drop("_up", "p_table", "p_column", "n_table", "n_column")


def cloud_index(cloud: DataFrame) -> DataFrame:
    """The first final-stage row of each field. cloud: (path, sheet_ord, ord, sheet_key, table, column, ...)."""
    rows = cloud.withColumns({"table_key": k.normalize(F.coalesce(F.nullif(F.col("table"), F.lit("")), F.col("sheet_key"))), "column_key": k.normalize("column")}).where("column_key <> ''")
    first = Window.partitionBy("table_key", "column_key").orderBy("sheet_ord", "ord")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "sheet_ord", "ord", "sheet_key")


def cloud_lookup(fields: DataFrame, index: DataFrame, prefixes: list[str]) -> DataFrame:
    """Adds ``detail``: the index row under the full name, or under the name without each prefix in turn. fields: (table, column, ...)."""
    detail = index.select("table_key", "column_key", F.struct(*index.columns).alias("detail"))
    out, found = fields, []
    for i, name in enumerate([F.col("table"), *(k.strip_prefix("table", p) for p in prefixes)]):
        d = detail.select(F.col("table_key").alias(f"t{i}"), F.col("column_key").alias(f"c{i}"), F.col("detail").alias(f"d{i}"))
        out = out.join(d, (F.col(f"t{i}") == k.normalize(name)) & (F.col(f"c{i}") == k.normalize("column")), "left").drop(f"t{i}", f"c{i}")
        found.append(f"d{i}")
    return out.withColumn("detail", F.coalesce(*found)).drop(*found)


def with_cloud(records: DataFrame, index: DataFrame, stage: str, prefixes: list[str]) -> DataFrame:
    """Appends the final-stage entry where the index knows the target."""
    rows = cloud_lookup(records.withColumns({"table": F.col("sheet"), "column": F.col("target_column")}), index, prefixes)
    last = entry(F.lit(stage), F.col("detail.table"), F.col("detail.column"), F.col("detail.datatype"), F.col("detail.size"), F.col("detail.path"), constraint=F.col("detail.nullable"))
    lineage = F.when(F.col("detail").isNotNull(), F.concat("lineage", F.array(last))).otherwise(F.col("lineage"))
    return rows.withColumns({"lineage": lineage, "description": F.col("detail.description")}).drop("detail", "table", "column")


def view_records(view: DataFrame) -> DataFrame:
    """Two-entry records of view rows (path, ord, target_table, target_column, source_*, transformation_logic)."""
    has = k.stated("source_column") | k.stated("source_table")
    first = entry(F.lit("source"), F.col("source_table"), F.col("source_column"), schema=F.col("source_schema"))
    own = F.array(source(F.col("source_table"), F.col("source_column"), None, F.col("transformation_logic"), F.col("source_role"), F.col("source_schema"), F.col("source_alias")))
    last = entry(F.lit("view"), F.col("target_table"), F.col("target_column"), path=F.col("path"), sources=own)
    none = F.array().cast(f"array<{ENTRY}>")
    return view.where(k.stated("target_column")).withColumn("lineage", F.concat(F.when(has, F.array(first)).otherwise(none), F.array(last)))


def chain_views(records: DataFrame, steps: int = VIEW_STEPS) -> DataFrame:
    """Adds ``resolved_source`` (schema, table, column, via) where a view's source is itself a view's field."""
    view = F.get(F.filter("lineage", lambda x: x["stage"] == "view"), F.lit(0))
    head = F.get("lineage", F.lit(0))
    rows = records.withColumns({"_v": view, "_h": F.when(head["stage"] == "source", head)})
    first = Window.partitionBy("p_table", "p_column").orderBy("path", "ord")
    made = rows.select(k.normalize("_v.table").alias("p_table"), k.normalize("_v.column").alias("p_column"), "path", "ord", F.col("_h.table").alias("n_table"), F.col("_h.column").alias("n_column"), F.col("_h").isNotNull().alias("n_has"))
    made = made.where("p_column <> ''").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "path", "ord")
    none = F.array().cast("array<string>")
    state = rows.withColumns({"_t": F.col("_h.table"), "_c": F.col("_h.column"), "_via": none, "_seen": none, "_go": F.col("_h").isNotNull()})
    names = state.columns
    for _ in range(steps):
        here = k.key_of("_t", "_c")
        on = F.col("_go") & k.normalize("_t").eqNullSafe(F.col("p_table")) & (k.normalize("_c") == F.col("p_column")) & ~F.array_contains("_seen", here)
        hit = F.col("p_column").isNotNull()
        step = hit & F.col("n_has")
        new = {
            "_via": F.when(hit, F.concat("_via", F.array(k.format_key(k.normalize("_t"), k.normalize("_c"))))).otherwise(F.col("_via")).alias("_via"),
            "_seen": F.when(hit, F.concat("_seen", F.array(here))).otherwise(F.col("_seen")).alias("_seen"),
            "_t": F.when(step, F.col("n_table")).otherwise(F.col("_t")).alias("_t"),
            "_c": F.when(step, F.col("n_column")).otherwise(F.col("_c")).alias("_c"),
            "_go": (F.col("_go") & F.coalesce(step, F.lit(False))).alias("_go"),
        }
        state = state.join(made, on, "left").select(*[new.get(n, F.col(n)) for n in names])
    resolved = F.struct(_null().alias("schema"), F.col("_t").alias("table"), F.col("_c").alias("column"), F.col("_via").alias("via"))
    return state.withColumn("resolved_source", F.when(F.size("_via") > 0, resolved)).drop("_v", "_h", "_t", "_c", "_via", "_seen", "_go")


def target_key(warehouse: str = "dwh", copy: str = "cloud", lineage: str = "lineage") -> Column:
    """struct<table, column> of a record's own field, in raw spelling."""
    own = F.try_element_at(F.filter(lineage, lambda e: e["stage"] == warehouse), F.lit(-1))
    last = F.try_element_at(F.col(lineage), F.lit(-1))
    pick = F.coalesce(own, F.when(last["stage"] != copy, last))
    return F.when(pick.isNotNull(), F.struct(pick["table"].alias("table"), pick["column"].alias("column")))


def _at_stage(stage: str):
    return lambda e: e["stage"] == stage


def _last(stage: str, lineage: str) -> Column:
    return F.try_element_at(F.filter(lineage, _at_stage(stage)), F.lit(-1))


def wide_row(stages: list[str], lineage: str = "lineage", description: str = "description") -> list[Column]:
    """Five columns a stage, of its last entry, and four of the whole record; null where there is nothing."""
    out = []
    for s in stages:
        e = _last(s, lineage)
        out += [e["table"].alias(f"{s}_table"), e["column"].alias(f"{s}_column"), k.short_path(e["offline_path"]).alias(f"{s}_path"), e["datatype"].alias(f"{s}_datatype"), e["size"].alias(f"{s}_size")]
    t = tail(lineage, description)
    return out + [t[c].alias(c) for c in ("description", "type", "rule", "dependencies")]


def flat_row(stages: list[str], lineage: str = "lineage", description: str = "description") -> list[Column]:
    """The cells that a record is scored by: five a stage, the description and the last stated logic; '' where there is nothing."""
    out = []
    for s in stages:
        e = _last(s, lineage)
        out += [k.clean(e["offline_path" if f == "path" else f]).alias(f"{s}_{f}") for f in FIELDS]
    logic = F.flatten(F.transform(lineage, lambda e: F.transform(e["sources"], lambda x: x["transformation_logic"])))
    stated = F.filter(logic, lambda x: F.coalesce(k.strip(x) != "", F.lit(False)))
    return [*out, k.clean(description).alias("description"), k.clean(F.try_element_at(stated, F.lit(-1))).alias("logic")]


def tail(lineage: str = "lineage", description: str = "description") -> Column:
    """struct<description, type, rule, dependencies> of a record; the last three of the last entry with sources."""
    last = F.try_element_at(F.filter(lineage, lambda e: F.size(e["sources"]) > 0), F.lit(-1))
    own = F.get(last["sources"], F.lit(0))
    logic, deps = own["transformation_logic"], k.dependency_tokens(own["transformation_logic"], own["table"])
    return F.struct(F.col(description).alias("description"), own["transformation_type"].alias("type"), F.nullif(logic, F.lit("")).alias("rule"), F.nullif(deps, F.lit("")).alias("dependencies"))


def view_wide_row(lineage: str = "lineage", resolved: str = "resolved_source") -> list[Column]:
    """The eleven columns of a view record, null where there is nothing."""
    view = _last("view", lineage)
    own = F.get(view["sources"], F.lit(0))
    r = F.col(resolved)
    named = {"source_schema": own["schema"], "source_table": own["table"], "source_column": own["column"], "view_name": view["table"], "view_column": view["column"], "role": own["role"], "transformation": own["transformation_logic"]}
    named["path"] = F.nullif(k.basename(F.rtrim(view["offline_path"], F.lit("/"))), F.lit(""))
    named["alias"] = own["alias"]
    named["ultimate"] = F.when(k.stated(r["column"]), k.format_key(r["table"], r["column"]))
    named["via"] = F.nullif(F.array_join(r["via"], " -> "), F.lit(""))
    return [c.alias(n) for n, c in named.items()]


def stages_in(records: DataFrame) -> DataFrame:
    """(stage, place): stages by first appearance, longest chains first. records: (rec_id, lineage)."""
    rows = records.select("rec_id", F.size("lineage").alias("n"), F.posexplode("lineage").alias("pos", "e"))
    first = rows.groupBy(F.col("e.stage").alias("stage")).agg(F.min(F.struct(-F.col("n"), "rec_id", "pos")).alias("at"))
    return first.select("stage", F.row_number().over(Window.orderBy("at")).alias("place"))  # a row a stage


def coverage(records: DataFrame, stages: list[str]) -> DataFrame:
    """One row of counts and rendered ratios over lineage records (lineage, description).

    A null stands for what a report leaves out: all but ``records`` if there are
    none, and the datatypes of a stage whose last entries state none.
    """
    has = lambda s: F.exists("lineage", lambda e: e["stage"] == s)
    logic = F.exists("lineage", lambda e: F.exists(e["sources"], lambda x: k.stated(x["transformation_logic"])))
    full = F.lit(True)
    for s in stages:
        full = full & has(s)
    typed = {f"datatype_{s}": k.stated(_last(s, "lineage")["datatype"]) for s in stages}
    parts = {"complete_chains": full, "with_description": k.stated("description"), "with_transformation_logic": logic} | {f"stage_{s}": has(s) for s in stages} | typed
    per_key = records.groupBy(target_key().alias("key")).agg(F.count("*").alias("n"), *[F.count_if(v).alias(n) for n, v in parts.items()])
    some = lambda c: F.when(F.sum("n") > 0, c)
    known = F.col("key").isNotNull()
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), some(F.count_if(known)).alias("distinct_target_fields"), some(F.count_if(known & (F.col("n") > 1))).alias("n_to_1_target_fields"), *[F.sum(n).alias(n) for n in parts])
    shown = [F.when((F.col(n) > 0) if n in typed else F.lit(True), k.ratio(F.col(n), F.col("records"))).alias(n) for n in parts]
    return total.select("records", "distinct_target_fields", "n_to_1_target_fields", *shown)


def diagnostics(records: DataFrame, stages: list[str], shown: int = 5) -> DataFrame:
    """One row: chains, end-to-end chains, and the distinct loose ends with their first examples."""
    tail_, head = F.try_element_at(F.col("lineage"), F.lit(-1)), F.get("lineage", F.lit(0))
    rows = records.select(tail_.alias("t"), head.alias("h"))
    whole = (F.col("h.stage") == stages[0]) & (F.col("t.stage") == stages[-1])
    base = rows.agg(F.count("*").alias("chains"), F.count_if(whole).alias("complete_chains"))

    def loose(e: str, bad: Column, name: str) -> DataFrame:
        own = rows.where(bad & k.is_field(f"{e}.column")).select(F.col(f"{e}.stage").alias("s"), k.normalize(f"{e}.table").alias("t"), k.normalize(f"{e}.column").alias("c")).distinct()
        order = F.row_number().over(Window.orderBy("s", F.coalesce("t", F.lit("")), "c"))
        text = F.concat(F.col("s"), F.lit(": "), k.format_key("t", "c"))
        few = own.orderBy("s", F.coalesce("t", F.lit("")), "c").limit(shown).withColumn("r", order)
        first = few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("x")))), lambda x: x["x"]), "; ").alias(f"{name}_examples"))
        return own.agg(F.count("*").alias(f"{name}_count")).crossJoin(first)  # one row each

    tails = loose("t", F.col("t.stage") != stages[-1], "unmatched_tails")
    heads = loose("h", (F.col("h.stage") != stages[0]) & (F.size("h.sources") == 0), "unmatched_heads")
    return base.crossJoin(tails).crossJoin(heads)  # one row each
