"""Line dedup within one edit, with DataFrame functions alone.

Lines are the parts between line feeds, compared without the white space around
them. A line goes if an earlier one (smaller id, or earlier in the same text) is
equal or, for lines of ``near_chars`` code points and more, at most one edit away.

Deletion neighbourhood: two lines are one edit apart just if they agree after one
deletion at the same place, or one of them equals a deletion of the other. Equal
lines are one entry. All deletions of a long line would cost the square of its
length, and nearly no line has a neighbour, so two lossless filters come first:

* neighbours agree in their first or their last half (cut down to whole classes of
  lengths), so lines whose halves are all unique are out;
* lines are cut in segments; an edit falls in one, and what lies before and after
  it agrees. Only a segment whose surroundings another line shares has its
  deletions emitted, as hashes of surroundings, place and rest.

Equal deletions are met by grouping, never as pairs: everything in a group is
compared with the group's earliest line, whose edit distance is then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_an_id, stored, table, texts_of

SEGMENT = 64
#: What is trimmed off lines.
SPACES = " \t\n\x0b\x0c\r"


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, pos, line) of lines that are long enough to be compared."""
    line = F.btrim("col", F.lit(SPACES))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)))
    return rows.select("doc_id", "pos", line.alias("line")).where(F.length("line") >= min_chars)


def _names(line: str) -> tuple[Column, Column]:
    """Two hashes, 96 bits, that stand for a line."""
    return F.xxhash64(line).alias("h"), F.hash(line, F.length(line)).alias("g")


def _half_keys() -> Column:
    """Keys of a line's start and end; one-edit neighbours share one.

    The start and the end of a line of 8b to 8b + 7 code points have 4b, half of it
    or a little less. A line of 8b may have a neighbour of 8b - 1, so it has the
    keys of that class too. Lines under 8 code points have no halves to tell them
    apart: b is 0, they share one key, and all of them go on.
    """

    def ends(b: Column) -> Column:
        start, end = F.substring("line", F.lit(1), 4 * b), F.substring("line", F.length("line") - 4 * b + 1, 4 * b)
        return F.array(F.xxhash64(F.lit("p"), b, start), F.xxhash64(F.lit("s"), b, end))

    b = F.floor(F.length("line") / 8).cast("int")
    return F.when(F.length("line") % 8 == 0, F.concat(ends(b), ends(b - 1))).otherwise(ends(b))


def _segments() -> Column:
    """Structs (short, n, j, before, mid, after) of a line in both roles; n: the shorter length of the pair."""

    def role(short: int) -> Column:
        n = F.length("line") - short

        def segment(j: Column) -> Column:
            rest = F.greatest(n - SEGMENT * (j + 1), F.lit(0))
            mid = F.substring("line", SEGMENT * j + 1, F.length("line") - SEGMENT * j - rest)
            place = F.xxhash64(n, j, F.substring("line", F.lit(1), SEGMENT * j), F.substring("line", F.length("line") - rest + 1, rest))
            return F.struct(F.lit(short == 0).alias("short"), place.alias("place"), mid.alias("mid"))

        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / SEGMENT), F.lit(0)).cast("int")), segment)

    return F.concat(role(0), role(1))


def _variants() -> Column:
    """Structs (key, kind): 's' a deletion at its place, 'a' the shorter line itself, 'b' a longer line's deletion."""

    def without(i: Column) -> Column:
        return F.concat(F.substring("mid", F.lit(1), i - 1), F.substring("mid", i + 1, F.length("mid")))

    places = F.sequence(F.lit(1), F.greatest(F.length("mid"), F.lit(1)))
    same = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit("s"), F.col("place"), i, without(i)).alias("key"), F.lit("s").alias("kind")))
    plain = F.array(F.struct(F.xxhash64(F.lit("i"), F.col("place"), F.col("mid")).alias("key"), F.lit("a").alias("kind")))
    longer = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit("i"), F.col("place"), without(i)).alias("key"), F.lit("b").alias("kind")))
    return F.when(F.col("short"), F.concat(same, plain)).otherwise(F.array_distinct(longer))


def near_lines(distinct: DataFrame) -> DataFrame:
    """(h, g) of lines that have an earlier neighbour. distinct: (h, g, first struct<doc_id, pos>, line), lines unique."""
    parts = distinct.select("h", "g", "first", F.explode(_segments()).alias("s")).select("h", "g", "first", "s.*")
    parts = stored(parts, "line-segments")
    busy = parts.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place")
    deletions = parts.join(busy, "place", "left_semi").select("h", "g", "first", F.explode(_variants()).alias("v")).select("h", "g", "first", "v.key", "v.kind")
    deletions = stored(deletions, "line-deletions")
    twice = deletions.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    deletions = stored(deletions.join(twice, "key", "left_semi"), "line-met")
    # the earliest line of each kind in a group: of 's' all are neighbours; an 'a' and each 'b' are
    lead = deletions.groupBy("key", "kind").agg(F.min("first").alias("lead"))
    against = F.when(F.col("kind") == "s", F.lit("s")).when(F.col("kind") == "a", F.lit("b")).otherwise(F.lit("a"))
    met = deletions.withColumn("kind", against).join(lead, ["key", "kind"]).where(F.col("lead") < F.col("first"))
    met = met.select("h", "g", "first", "lead").distinct()
    met = met.join(distinct.select("first", "line"), "first").join(distinct.select(F.col("first").alias("lead"), F.col("line").alias("other")), "lead")
    return met.where(F.levenshtein("line", "other", 1) >= 0).select("h", "g").distinct()


def line_dedup(docs: DataFrame, min_chars: int = 1, near_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept) of every document; kept: its other lines, joined as they were.

    Null texts are empty, and an empty text has one empty line. Lines shorter than
    ``min_chars`` code points always stay, those shorter than ``near_chars`` go only
    if an earlier one is equal; as it stands blank lines alone are exempt. What counts as earlier is judged on the
    input, so a line goes even if the neighbour before it goes too. Rows with a null
    id are left out; of rows that share an id the one with the smallest text counts.
    """
    if near_chars < 1:
        raise ValueError("near_chars must be at least 1")
    rows = one_an_id(texts_of(docs, id_col, text_col))
    lines = lines_of(rows, min_chars)
    keys = F.when(F.length("line") >= near_chars, _half_keys())
    every = stored(lines.select("doc_id", "pos", *_names("line"), keys.alias("keys")), "line-places")
    first = stored(every.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")), "line-names")
    # a line's first place stands for it; the texts of lines that share a half are fetched
    halves = first.select("first.doc_id", "first.pos", F.explode("keys").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    picked = stored(halves.join(shared, "half", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("at")), "line-picks")
    line = F.btrim(F.get("parts", F.col("pos")), F.lit(SPACES))
    texts = rows.join(picked, "doc_id").select("doc_id", F.split("text", "\n", -1).alias("parts"), F.explode("at").alias("pos")).select(F.struct("doc_id", "pos").alias("first"), line.alias("line"))
    near = near_lines(stored(texts.select(*_names("line"), "first", "line"), "line-texts")).withColumn("near", F.lit(True))
    judged = first.join(near, ["h", "g"], "left").where("n > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    judged = stored(judged, "line-judged")
    place = F.struct("doc_id", "pos")
    gone = every.select("doc_id", "pos", "h", "g").join(judged, ["h", "g"]).where(F.col("near") | (F.col("first") < place))
    gone = stored(gone.groupBy("doc_id").agg(F.collect_list("pos").alias("gone")), "lines-gone")
    parts = F.split("text", "\n", -1)
    # merged at every size: the list grows with the corpus, so small inputs are to do what large ones must
    out = rows.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "text", parts.alias("parts"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n"))
    return out.select("doc_id", F.size("parts").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), kept.alias("kept"))


def query(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs),
every AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM parts),
lines AS (
  SELECT doc_id, pos, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM every),
firsts AS (SELECT line, length(line) AS n, min({'d': doc_id, 'p': pos}) AS first FROM lines WHERE length(line) >= 1 GROUP BY line),
long AS (SELECT * FROM firsts),
cand AS (
  SELECT a.line AS l, b.line AS r, a.first AS lf, b.first AS rf FROM long a JOIN long b
    ON b.n = a.n AND a.line < b.line AND left(a.line, (a.n // 2)::INT) = left(b.line, (a.n // 2)::INT)
  UNION SELECT a.line, b.line, a.first, b.first FROM long a JOIN long b
    ON b.n = a.n AND a.line < b.line AND right(a.line, (a.n - a.n // 2)::INT) = right(b.line, (a.n - a.n // 2)::INT)
  UNION SELECT a.line, b.line, a.first, b.first FROM long a JOIN long b
    ON b.n = a.n + 1 AND left(a.line, (a.n // 2)::INT) = left(b.line, (a.n // 2)::INT)
  UNION SELECT a.line, b.line, a.first, b.first FROM long a JOIN long b
    ON b.n = a.n + 1 AND right(a.line, (a.n - a.n // 2)::INT) = right(b.line, (a.n - a.n // 2)::INT)),
pairs AS (
  SELECT * FROM cand WHERE len(list_filter(range(1, length(r) + 1), lambda i:
    CASE WHEN length(l) = length(r) THEN left(l, (i - 1)::INT) = left(r, (i - 1)::INT) AND substring(l, (i + 1)::INT) = substring(r, (i + 1)::INT)
    ELSE l = left(r, (i - 1)::INT) || substring(r, (i + 1)::INT) END)) > 0),
near AS (SELECT CASE WHEN lf < rf THEN r ELSE l END AS line FROM pairs),
marked AS (
  SELECT e.doc_id, e.pos, e.raw, coalesce(f.line IS NOT NULL AND ({'d': e.doc_id, 'p': e.pos} > f.first OR f.line IN (SELECT line FROM near)), false) AS gone
  FROM lines e LEFT JOIN firsts f ON e.line = f.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
