"""Validation of extracted records, and scoring against a truth table."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import keys as k
from tracelake.sources import kinds

#: The identifier keys whose spelling is verified, and how many mismatches, unmatched rows and examples a score shows.
VERBATIM = ["table", "column", "source_schema", "target_table", "target_column", "source_table", "source_column"]
MISMATCHES, UNMATCHED = 40, 10


def input_errors(rows: Column, widest: Column) -> Column:
    """Why a sheet of so many rows cannot be read, or null."""
    return F.when(rows == 0, F.lit("empty sheet")).when(widest < 3, F.concat(F.lit("only "), widest.cast("string"), F.lit(" column(s), a mapping needs 3")))


def sql_input_error(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.coalesce(k.strip(text), F.lit("")) == "", F.lit("empty file")).when(~F.contains(F.lower(text), F.lit("select")), F.lit("no select"))


def expected_rows(cells: DataFrame, anchors: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(path, sheet, expected): rows below the first header row; null where no row is one. cells: (path, sheet, ord, cells)."""
    header = F.when(k.header_row("cells", [list(g) for g in anchors]), F.col("ord"))
    rows = cells.where("ord is not null").withColumn("head", header)
    first = rows.groupBy("path", "sheet").agg(F.min("head").alias("head"))
    below = rows.select("path", "sheet", "ord").join(first, ["path", "sheet"]).groupBy("path", "sheet")
    return below.agg(F.when(F.first("head").isNotNull(), F.count_if(F.col("ord") > F.col("head"))).alias("expected"))


def shape_errors(required: list[str], not_null: list[str], roles: str | None = None, raw: str = "raw", texts: bool = False) -> Column:
    """Errors of a record held as a JSON object in a column: missing, surplus, null and misfit keys; texts: other values than strings are errors too."""
    have, held = F.json_object_keys(raw), F.try_parse_json(raw)
    value = lambda c: F.get_json_object(raw, f"$.{c}")
    bad = [F.when(~F.array_contains(have, c), F.lit(f"missing {c}")) for c in required]
    bad += [F.when(F.array_contains(have, c) & value(c).isNull(), F.lit(f"null {c}")) for c in not_null]
    if texts:
        kind = lambda c: F.schema_of_variant(F.try_variant_get(held, f"$.{c}", "variant"))
        bad += [F.when(~kind(c).isin("STRING", "VOID"), F.concat(F.lit(f"{c} is no string but "), kind(c))) for c in required]
    surplus = F.array_except(have, F.array(*map(F.lit, required)))
    extra = F.when(F.size(surplus) > 0, F.concat(F.lit("surplus "), F.array_join(F.array_sort(surplus), ",")))
    if roles:
        bad.append(F.when(value(roles).isNotNull() & ~value(roles).isin(*kinds.ROLES), F.lit(f"role {roles}")))
    whole = F.when(have.isNull(), F.array(F.lit("not an object")))
    return F.coalesce(whole, F.array_compact(F.array(*bad, extra)))


def completeness(records: DataFrame, by: list[str], target: str = "target_column", expected: str | None = None) -> DataFrame:
    """(by..., fields_covered, records_emitted): distinct normalised targets, or all records where none is named.

    With ``expected``, a column of the records, also that number and an error where
    it is known and differs.
    """
    named = F.when(k.stated(target), k.normalize(target))
    rows = records.groupBy(*by).agg(F.count_distinct(named).alias("d"), F.count("*").alias("records_emitted"), *([F.max(expected).alias("expected")] if expected else []))
    covered = F.when(F.col("d") == 0, F.col("records_emitted")).otherwise(F.col("d"))
    if not expected:
        return rows.select(*by, covered.alias("fields_covered"), "records_emitted")
    text = F.concat(F.lit("expected "), F.col("expected").cast("string"), F.lit(" fields, got "), covered.cast("string"), F.lit(" from "), F.col("records_emitted").cast("string"), F.lit(" records"))
    return rows.select(*by, covered.alias("fields_covered"), "records_emitted", "expected", F.when(F.col("expected") != covered, text).alias("error"))


def fidelity(records: DataFrame, texts: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, verified, checked, nulls, missing): values that their own file's text holds verbatim. texts: (by, text).

    Nulls count over every column of the records but ``by``. A record whose file has
    no text is checked against the empty one. missing: ``column: value`` of what was
    not found, sorted.
    """
    rest = [c for c in records.columns if c != by]
    rows = records.join(texts, by, "left").withColumn("text", F.coalesce("text", F.lit("")))
    nulls = sum((F.col(c).isNull().cast("long") for c in rest), F.lit(0).cast("long"))
    each = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    stated = F.filter(each, lambda x: x["v"].isNotNull())
    lost = F.filter(stated, lambda x: ~F.contains("text", x["v"]))
    one = rows.select(by, F.size(stated).cast("long").alias("n"), F.size(lost).cast("long").alias("bad"), nulls.alias("nulls"), F.transform(lost, lambda x: F.concat(x["c"], F.lit(": "), x["v"])).alias("lost"))
    out = one.groupBy(by).agg(F.sum(F.col("n") - F.col("bad")).alias("verified"), F.sum("n").alias("checked"), F.sum("nulls").alias("nulls"), F.array_sort(F.flatten(F.collect_list("lost"))).alias("missing"))
    return out


_WALKED = "struct<checked:long,missing:array<string>,nulls:long>"


def _walk(records: str | None, text: str | None) -> dict:
    found = {"checked": 0, "missing": [], "nulls": 0}

    def into(node, at: str) -> None:
        pairs = node.items() if isinstance(node, dict) else enumerate(node)
        for key, v in pairs:
            here = f"{at}.{key}" if isinstance(node, dict) else f"{at}[{key}]"
            if isinstance(v, dict | list):
                into(v, here)
            elif isinstance(node, dict) and v is None:
                found["nulls"] += 1
            elif isinstance(node, dict) and key in VERBATIM and isinstance(v, str):
                found["checked"] += 1
                if v not in (text or ""):
                    found["missing"].append(f"{here}: '{v}' is not in the source")

    have = json.loads(records) if records else []
    for i, r in enumerate(have if isinstance(have, list) else []):
        if isinstance(r, dict):
            into(r, f"record {i}")
    return found


def nested_fidelity(records: Column | str, text: Column | str) -> Column:
    """The same for a JSON array of records of any depth: struct<checked, missing, nulls>, by an Arrow function as depths are open."""

    @F.pandas_udf(_WALKED)
    def walked(records: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_walk(r, t) for r, t in zip(records, text, strict=True)], columns=["checked", "missing", "nulls"])

    return walked(records, text)


def validated(files: DataFrame) -> DataFrame:
    """Adds errors and metrics to files (kind, records, text, expected, ...): shape first, then completeness, then fidelity.

    records: a JSON array. metrics: struct of five, as a report shows them.
    """
    own = F.col("records")
    raw = F.from_json(own, "array<string>")
    shape = F.lit(None).cast("array<array<string>>")
    for kind in kinds.KINDS.values():
        errors = F.transform(raw, _shape_of(kind))
        shape = F.when(F.col("kind") == kind.name, errors).otherwise(shape)
    rows = files.withColumns({"_raw": raw, "_shape": shape})
    named = F.array_distinct(F.filter(F.transform("_raw", lambda r: F.get_json_object(r, "$.target_column")), lambda c: k.stated(c)))
    folded = F.array_distinct(F.transform(named, lambda c: k.normalize(c)))
    count = F.coalesce(F.size("_raw"), F.lit(0))
    covered = F.when(F.col("expected").isNull() | (F.size(folded) == 0), count).otherwise(F.size(folded))
    dirty = F.size(F.filter("_shape", lambda e: F.size(e) > 0))
    rows = rows.withColumns({"_n": count, "_covered": covered, "_dirty": F.coalesce(dirty, F.lit(0)), "_fid": nested_fidelity("records", "text")})
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    short = F.when(F.col("_covered") != F.col("expected"), F.array(text("expected ", F.col("expected"), " target fields, got ", F.col("_covered"), " from ", F.col("_n"), " records")))
    numbered = F.flatten(F.transform("_shape", lambda e, i: F.transform(e, lambda x: F.concat(F.lit("record "), i.cast("string"), F.lit(": "), x))))
    none = F.array().cast("array<string>")
    errors = F.concat(F.coalesce(numbered, none), F.coalesce(short, none), F.col("_fid.missing"))
    found = F.col("_fid.checked") - F.size("_fid.missing")
    metrics = F.struct(
        text(F.col("_covered"), "/", F.coalesce(F.col("expected").cast("string"), F.lit("unknown"))).alias("fields_covered"), F.col("_n").alias("records_emitted"), text(F.col("_n") - F.col("_dirty"), "/", F.col("_n")).alias("schema_clean_records"),
        text(found, "/", F.col("_fid.checked")).alias("fidelity_verified"), F.col("_fid.nulls").alias("output_null_count"),
    )
    return rows.withColumns({"errors": errors, "metrics": metrics}).drop("_raw", "_shape", "_n", "_covered", "_dirty", "_fid")


def _shape_of(kind: kinds.Kind):
    roles = next(iter(kind.enums), None)
    return lambda raw: shape_errors(list(kind.fields), sorted(kind.never_null), roles, raw=raw, texts=True)


def null_count(rows: DataFrame) -> DataFrame:
    per = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    total = F.lit(0).cast("long")
    for c in rows.columns:
        total = total + F.col(c)
    return per.select(total.alias("nulls"))


def equal_archive(column: Column, a: Column, b: Column) -> Column:
    """Loose equality of a truth cell and a produced one: paths by their file, prose by its first 40 characters."""
    return (a == b) | (F.endswith(column, F.lit("_path")) & (k.basename(a) == k.basename(b))) | (column.isin("description", "logic") & (F.substring(a, 1, 40) == F.substring(b, 1, 40)))


def equal_views(column: Column, a: Column, b: Column) -> Column:
    """Loose equality of view cells: identifiers in any case, paths by their file, expressions by their tokens."""
    caseless = ["source_schema", "source_table", "source_column", "role"]
    return (a == b) | (column.isin(*caseless) & (F.upper(a) == F.upper(b))) | ((column == "path") & (k.basename(a) == k.basename(b))) | ((column == "transformation") & (k.squash(a) == k.squash(b)))


def matched(manual: DataFrame, produced: DataFrame, key: list[str]) -> DataFrame:
    """Full outer match on null-safe keys: (key..., m struct, p struct), a null struct where a side lacks the key."""
    m = manual.select(*[F.col(c).alias(f"m_{c}") for c in key], F.struct(*manual.columns).alias("m"))
    p = produced.select(*[F.col(c).alias(f"p_{c}") for c in key], F.struct(*produced.columns).alias("p"))
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"m_{c}").eqNullSafe(F.col(f"p_{c}"))
    return m.join(p, on, "full_outer").select(*[F.coalesce(f"m_{c}", f"p_{c}").alias(c) for c in key], "m", "p")


def cells(both: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Compared cells (key..., column, a, b) of matched rows; cells blank on both sides don't count."""
    pick = lambda s, c: F.coalesce(k.strip(F.col(s)[c].cast("string")), F.lit(""))
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), pick("m", c).alias("a"), pick("p", c).alias("b")) for i, c in enumerate(columns)])
    rows = both.where("m is not null and p is not null").select(*key, F.explode(each).alias("x")).select(*key, "x.*")
    return rows.where("a <> '' or b <> ''")


def score(both: DataFrame, columns: list[str], key: list[str], equal=equal_archive) -> DataFrame:
    """(column, agree, compared), and one row for all columns together, in one pass."""
    rows = cells(both, columns, key).withColumn("ok", equal(F.col("column"), F.col("a"), F.col("b")))
    out = rows.rollup("column").agg(F.count_if("ok").alias("agree"), F.count("*").alias("compared"))
    return out.withColumn("column", F.coalesce("column", F.lit("(all)")))


def mismatches(both: DataFrame, columns: list[str], key: list[str], equal=equal_archive, most: int = MISMATCHES, shown: int = 60) -> DataFrame:
    """(key..., column, manual, program) of the first cells that differ, by key and then column; values cut to ``shown``."""
    rows = cells(both, columns, key).where(~equal(F.col("column"), F.col("a"), F.col("b")))
    return rows.orderBy(*key, "place").limit(most).select(*key, "column", k.excerpt("a", shown).alias("manual"), k.excerpt("b", shown).alias("program"))


def unmatched(both: DataFrame, key: list[str], most: int = UNMATCHED) -> DataFrame:
    """(key...) of the first truth rows that nothing was produced for, by key."""
    return both.where("p is null").select(*key).orderBy(*key).limit(most)


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(op, n) of two one-column sets of keys: both, only the first, any, and all rows of either."""
    (x,), (y,) = a.columns, b.columns
    per = a.select(F.col(x).alias("key"), F.lit(1).alias("m"), F.lit(0).alias("p")).unionByName(b.select(F.col(y).alias("key"), F.lit(0).alias("m"), F.lit(1).alias("p"))).groupBy("key").agg(F.sum("m").alias("m"), F.sum("p").alias("p"))
    one = per.agg(F.count_if(F.expr("m > 0 and p > 0")).alias("both"), F.count_if(F.expr("m > 0 and p = 0")).alias("only"), F.count("*").alias("any"), F.coalesce(F.sum(F.col("m") + F.col("p")), F.lit(0)).alias("bag"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("op"), F.col(c).alias("n")) for c in ("both", "only", "any", "bag")])).alias("x")).select("x.*")


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by the order; with descending orders, the last."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def roll_up(reports: DataFrame, by: list[str]) -> DataFrame:
    """(by..., files, converted, failed, problems) over reports (errors array<string>, cached boolean, records): converted are those not cached, failed or not."""
    problems = F.coalesce(F.size("errors"), F.lit(0))
    return reports.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(~F.col("cached")).alias("converted"), F.count_if(F.col("records").isNull()).alias("failed"), F.sum(problems).cast("long").alias("problems"))


def misses(manual: DataFrame, store: DataFrame, key: str = "content_key") -> DataFrame:
    """Inputs whose content the store hasn't got yet."""
    return manual.join(store.select(key).distinct(), key, "left_anti")
