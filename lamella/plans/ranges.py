"""Row intervals, selections and validity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import encodings, intervals
from ..session import scratch
from ..sources import scan
from ..sources.pageindex import page_headers, page_index
from ..sources.sink import Parts, WriteOptions, write_parts
from .registry import query, table

PAGE = 300
FILE = "least(o_orderkey // 5000, 2)"

PAGES_SQL = f"""WITH r AS (SELECT {FILE} AS file, row_number() OVER (PARTITION BY {FILE} ORDER BY o_orderkey) - 1 AS row, o_orderkey, o_totalprice FROM orders),
 p AS (SELECT CAST(file AS INTEGER) AS file, CAST(row // {PAGE} AS INTEGER) AS page, min(row) AS start, count(*) AS length, max(o_totalprice) AS top FROM r GROUP BY 1, 2)"""
#: Rows of a file on disk, whole pages. The three files of the SQL are tables of such files, since the last has nearly all rows.
PART = 500 * PAGE


def three_files(spark, sf) -> Parts:
    """Orders in three files by key, with pages of 300 rows."""
    part = F.least(F.expr("o_orderkey div 5000"), F.lit(2)).cast("int")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return write_parts(rows, scratch(spark, "orders in files"), part, "o_orderkey", PART, WriteOptions(page_rows=PAGE, dictionary=False))


def with_part(found, parts: Parts, path: str = "path"):
    """Adds file and before, the rows of the file in the parts before a row's own."""
    # The part's number is a column of its own, so that a path is cut once a row.
    numbered = found.withColumn("_part", parts.part(F.col(path)))
    return numbered.withColumn("file", parts.table(F.col("_part"))).withColumn("before", parts.before(F.col("_part"))).drop("_part")


#: The number of a page in its file, from that in its part.
IN_FILE = f"CAST(page + before div {PAGE} AS INT) AS page"


def with_lengths(spark, sf):
    """The pages of the price by the files' own indexes: file, page, start, length, top."""
    parts = three_files(spark, sf)
    found = with_part(page_index(spark, parts.path, ["o_totalprice"]), parts)
    found = intervals.page_row_intervals(found, F.col("num_rows"), ["path", "row_group"])
    return found.select("path", "row_group", "file", F.expr(IN_FILE), (F.col("before") + F.col("start")).alias("start"), "length", F.col("max_value").cast("double").alias("top"))


@query(PAGES_SQL + " SELECT file, page, start, length FROM p")
def page_row_intervals(spark, sf):
    return with_lengths(spark, sf).select("file", "page", "start", "length")


@query(PAGES_SQL + " SELECT file, start, length FROM p WHERE top > (SELECT quantile_cont(top, 0.5) FROM p)")
def rows_from_pages(spark, sf):
    found = with_lengths(spark, sf)
    middle = found.agg(F.percentile("top", 0.5)).first()[0]
    return found.where(F.col("top") > middle).select("file", "start", "length")


@query(PAGES_SQL + " SELECT o_orderkey, o_totalprice FROM r JOIN p ON r.file = p.file AND r.row // 300 = p.page WHERE top > 400000")
def prune_pages_minmax(spark, sf):
    """The rows of the pages whose bounds can hold a price over 400000; other pages are not read."""
    return scan.page_pruned(spark, three_files(spark, sf).path, "o_totalprice", F.col("max_value").cast("double") > 400000)


@query(PAGES_SQL + " SELECT file, page, length AS num_values FROM p WHERE length >= 300")
def prune_pages_header(spark, sf):
    """Pages by what their headers in the file say: the number of values."""
    parts = three_files(spark, sf)
    found = page_headers(spark, parts.path, ["o_totalprice"])
    return with_part(found.where("page_type LIKE 'DATA%' AND num_values >= 300"), parts).select("file", F.expr(IN_FILE), "num_values")


ASKED_SQL = ", q AS (SELECT k * 450 + 20 AS a, 130 AS n FROM range(0, 7) AS t(k))"


def asked(spark):
    return spark.range(0, 7).select((F.col("id") * 450 + 20).alias("start"), F.lit(130).cast("long").alias("length"))


@query(PAGES_SQL + ASKED_SQL + " SELECT file, page, greatest(start, a) AS shared_start, least(start + length, a + n) - greatest(start, a) AS shared_length FROM p JOIN q ON start < a + n AND a < start + length")
def interval_overlap(spark, sf):
    right = asked(spark).withColumnsRenamed({"start": "r_start", "length": "r_length"})
    return intervals.overlaps(with_lengths(spark, sf), right, PAGE).select("file", "page", "shared_start", "shared_length")


@query(PAGES_SQL + ASKED_SQL + """ SELECT file, page, coalesce(string_agg(CAST(greatest(start, a) - start AS VARCHAR) || '+' || CAST(least(start + length, a + n) - greatest(start, a) AS VARCHAR), ' ' ORDER BY a) FILTER (a IS NOT NULL), '') AS selected
FROM p LEFT JOIN q ON start < a + n AND a < start + length GROUP BY file, page""")
def select_pages(spark, sf):
    rows = intervals.select_pages(asked(spark), with_lengths(spark, sf), PAGE, ["path", "row_group"])
    shown = F.concat_ws(" ", F.transform("selected", lambda x: F.concat_ws("+", x["start"].cast("string"), x["length"].cast("string"))))
    return rows.select("file", "page", shown.alias("selected"))


@query(PAGES_SQL + ASKED_SQL + " SELECT o_orderkey FROM r WHERE EXISTS (SELECT 1 FROM q WHERE row >= a AND row < a + n)")
def slice_filter(spark, sf):
    """Rows by their number in their file, of each of three files."""
    parts = three_files(spark, sf)
    rows = with_part(scan.with_rows(spark, parts.path), parts, "file_path")
    return intervals.rows_in(rows, F.col("before") + F.col("row_index"), asked(spark), PAGE).select("o_orderkey")


@query(PAGES_SQL + ASKED_SQL + " SELECT o_orderkey, o_totalprice FROM r WHERE EXISTS (SELECT 1 FROM q WHERE row >= a AND row < a + n)")
def read_row_ranges(spark, sf):
    """The same rows by reading only the pages that hold them."""
    parts = three_files(spark, sf)
    return scan.row_ranges(spark, parts.path, asked(spark), before=parts.before(parts.part(F.col("path"))))


VALID_SQL = "WITH v AS (SELECT event_id // 1000 AS page, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS place, value > 30 AS valid FROM events)"


def validity(spark, sf):
    return encodings.paged(table(spark, sf, "events").select("event_id", (F.col("value") > 30).alias("valid")), "event_id")


@query(VALID_SQL + ", f AS (SELECT *, CASE WHEN place = 0 OR valid <> lag(valid) OVER (PARTITION BY page ORDER BY place) THEN 1 ELSE 0 END AS fresh FROM v), g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY place) AS run FROM f) SELECT page, min(place) AS start, any_value(valid) AS value, count(*) AS length FROM g GROUP BY page, run")
def validity_runs(spark, sf):
    return encodings.run_lengths(validity(spark, sf), "valid").select("page", "start", "value", "length")


GAPS_SQL = ", q AS (SELECT 100 + 250 * k AS a, 120 AS n FROM range(0, 3) AS t(k)), m AS (SELECT v.*, q.a FROM v LEFT JOIN q ON place >= a AND place < a + n), f AS (SELECT *, CASE WHEN place = 0 OR a IS DISTINCT FROM lag(a) OVER (PARTITION BY page ORDER BY place) THEN 1 ELSE 0 END AS fresh FROM m), g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY place) AS run FROM f)"


@query(VALID_SQL + GAPS_SQL + " SELECT page, min(place) AS start, count(*) AS length, bool_and(a IS NOT NULL) AS selected, count(*) FILTER (valid) AS set_bits FROM g GROUP BY page, run")
def filtered_validity(spark, sf):
    """Stretches inside and outside three row intervals of each page, with their set bits."""
    some = spark.range(0, 3).select((F.col("id") * 250 + 100).alias("start"), F.lit(120).cast("long").alias("length"))
    return intervals.filtered_runs(validity(spark, sf), F.col("valid"), some, 500)


@query("SELECT event_id, CASE WHEN value > 30 THEN 1 ELSE 0 END AS def FROM events")
def def_levels_flat(spark, sf):
    from ..operators.nested import definition_level

    optional = F.when(F.col("value") > 30, F.col("value"))
    return table(spark, sf, "events").select("event_id", definition_level(optional).alias("def"))


@query("SELECT event_id, CASE WHEN value > 30 THEN value END AS value FROM events")
def optional_values(spark, sf):
    """Levels and the dense values put together: the n-th set level takes the n-th value."""
    rows = validity(spark, sf).withColumn("rank", F.sum(F.col("valid").cast("long")).over(Window.partitionBy("page").orderBy("place")))
    dense = encodings.paged(table(spark, sf, "events").select("event_id", "value").where("value > 30"), "event_id").select("page", (F.col("place") + 1).alias("rank"), "value")
    found = rows.join(dense, ["page", "rank"], "left")
    return found.select("event_id", F.when(F.col("valid"), F.col("value")).alias("value"))


@query("SELECT event_id, event_id % 7 = 0 AS struct_is_null, event_id % 7 = 0 OR event_id % 3 = 0 AS field_is_null FROM events")
def struct_validity(spark, sf):
    inner = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    s = F.when(F.col("event_id") % 7 != 0, F.struct(inner.alias("f1"), F.col("value").alias("f2")))
    rows = table(spark, sf, "events").select("event_id", s.alias("s"))
    return rows.select("event_id", F.col("s").isNull().alias("struct_is_null"), F.col("s.f1").isNull().alias("field_is_null"))
