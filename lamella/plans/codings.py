"""Encodings re-expressed as relational operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import encodings, nested
from .registry import query, table


def events(spark, sf, *columns):
    return encodings.paged(table(spark, sf, "events").select("event_id", *columns), "event_id")


EVENTS_SQL = "WITH v AS (SELECT *, event_id // 1000 AS page, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS place FROM events)"


@query(EVENTS_SQL + ", f AS (SELECT *, CASE WHEN place = 0 OR event_type <> lag(event_type) OVER (PARTITION BY page ORDER BY place) THEN 1 ELSE 0 END AS fresh FROM v), g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY place) AS r FROM f) SELECT page, min(place) AS start, any_value(event_type) AS value, count(*) AS length FROM g GROUP BY page, r")
def rle_runs(spark, sf):
    return encodings.run_lengths(events(spark, sf, "event_type"), "event_type").drop("run")


@query(EVENTS_SQL + " SELECT page, place, event_type AS value FROM v")
def rle_expand(spark, sf):
    return encodings.expand_runs(encodings.run_lengths(events(spark, sf, "event_type"), "event_type"))


@query(EVENTS_SQL + " SELECT page, place // 8 AS byte, CAST(sum(CAST(value > 50 AS INTEGER) << CAST(place % 8 AS INTEGER)) AS BIGINT) AS bits FROM v GROUP BY 1, 2")
def bool_bitmap(spark, sf):
    return encodings.bitmap(events(spark, sf, "value"), F.col("value") > 50)


@query(EVENTS_SQL + " SELECT page, place, user_id % 1024 AS value FROM v")
def bitpack_roundtrip(spark, sf):
    rows = events(spark, sf, (F.col("user_id") % 1024).alias("small"))
    return encodings.unpack_bits(encodings.pack_bits(rows, "small", 10), 10)


@query(EVENTS_SQL + " SELECT page, place // 6 AS word, CAST(sum((user_id % 1024) << CAST(10 * (place % 6) AS INTEGER)) AS BIGINT) AS packed, CAST(count(*) AS INTEGER) AS n FROM v GROUP BY 1, 2")
def bitpack_words(spark, sf):
    """The packed words themselves."""
    return encodings.pack_bits(events(spark, sf, (F.col("user_id") % 1024).alias("small")), "small", 10)


@query(EVENTS_SQL + " SELECT page, ((count(*) + 7) // 8) * 2 + 1 AS header FROM v GROUP BY page")
def rle_header(spark, sf):
    return events(spark, sf).groupBy("page").agg(F.count(F.lit(1)).alias("n")).select("page", bits.rle_header(F.col("n")).alias("header"))


ORDERS_SQL = "WITH v AS (SELECT o_custkey AS x, o_orderkey // 1000 AS page, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS place FROM orders)"


def orders(spark, sf):
    return encodings.paged(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("x")), "o_orderkey")


@query(ORDERS_SQL + ", d AS (SELECT page, place, x - lag(x) OVER (PARTITION BY page ORDER BY place) AS delta FROM v) SELECT page, (place - 1) // 128 AS block, min(delta) AS min_delta, CAST(CASE WHEN max(delta) = min(delta) THEN 0 ELSE length(bin(max(delta) - min(delta))) END AS INTEGER) AS bit_width, count(*) AS n FROM d WHERE place > 0 GROUP BY 1, 2")
def delta_encode_blocks(spark, sf):
    return encodings.delta_blocks(orders(spark, sf), "x")


ENDS = (0, 2**63 - 1, -(2**63), 5, -(2**63), 2**63 - 1, 2**63 - 1, -1)
ENDS_SQL = f"WITH v AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x})' for i, x in enumerate(ENDS))}) AS t(place, x)), d AS (SELECT place, CAST(x AS HUGEINT) AS x, CAST(x AS HUGEINT) - lag(CAST(x AS HUGEINT)) OVER (ORDER BY place) AS d FROM v)"


@query(ENDS_SQL + " SELECT CAST(place AS BIGINT) AS place, CAST(x AS BIGINT) AS value, CAST(CASE WHEN d > 9223372036854775807 THEN d - 18446744073709551616 WHEN d < -9223372036854775808 THEN d + 18446744073709551616 ELSE d END AS BIGINT) AS delta, CAST(x AS BIGINT) AS back FROM d")
def delta_wraps(spark, sf):
    """Differences between the ends of 64 bits, and the values back from them."""
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(ENDS)], "page long, place long, x long")
    coded = encodings.deltas(rows, "x")
    back = encodings.delta_decode(coded.select("page", "place", F.when(F.col("place") == 0, F.col("value")).alias("first_value"), "delta"))
    return coded.join(back.withColumnRenamed("value", "back"), ["page", "place"]).drop("page")


@query(ORDERS_SQL + " SELECT page, place, x AS value FROM v")
def delta_decode(spark, sf):
    coded = encodings.deltas(orders(spark, sf), "x").select("page", "place", F.when(F.col("place") == 0, F.col("value")).alias("first_value"), "delta")
    return encodings.delta_decode(coded)


@query(ORDERS_SQL + ", d AS (SELECT page, place, x - lag(x) OVER (PARTITION BY page ORDER BY place) AS d FROM v) SELECT page, place, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z, d FROM d WHERE place > 0")
def zigzag(spark, sf):
    rows = encodings.deltas(orders(spark, sf), "x").where("place > 0").withColumn("z", bits.zigzag(F.col("delta")))
    return rows.select("page", "place", "z", bits.unzigzag(F.col("z")).alias("d"))


@query("SELECT o_orderkey, CAST(greatest(1, ceil(CASE WHEN k = 0 THEN 0 ELSE length(bin(k)) END / 7.0)) AS INTEGER) AS n FROM (SELECT o_orderkey, o_orderkey * o_custkey AS k FROM orders)")
def uleb_len(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", bits.uleb128_length(F.col("o_orderkey") * F.col("o_custkey")).alias("n"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE length(bin(o_orderkey % 40)) END AS INTEGER) AS width FROM orders")
def level_bit_width(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", bits.bit_width(F.col("o_orderkey") % 40).alias("width"))


@query("SELECT o_orderkey, x AS back, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS bytes FROM (SELECT o_orderkey, o_custkey * 65537 AS x, lpad(hex(o_custkey * 65537), 16, '0') AS h FROM orders)")
def plain_le_int(spark, sf):
    digits = bits.little_endian_hex(F.col("x"), 8)
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 65537).alias("x")).withColumn("bytes", digits)
    return rows.select("o_orderkey", bits.from_little_endian_hex(F.col("bytes"), 8).alias("back"), "bytes")


@query("SELECT p_brand, CAST(sum(4 + strlen(p_name)) AS BIGINT) AS size FROM part GROUP BY 1")
def plain_binary_size(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.sum(4 + F.octet_length("p_name")).cast("long").alias("size"))


PARTS_SQL = "WITH v AS (SELECT p_partkey // 1000 AS page, row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) - 1 AS place, p_name, p_type FROM part)"


def parts(spark, sf, *columns):
    return encodings.paged(table(spark, sf, "part").select("p_partkey", *columns), "p_partkey")


@query(PARTS_SQL + " SELECT page, CAST(sum(strlen(p_name)) AS BIGINT) AS bytes, md5(string_agg(p_name, '' ORDER BY place)) AS digest, min(strlen(p_name)) AS shortest, max(strlen(p_name)) AS longest FROM v GROUP BY page")
def dlba_lengths(spark, sf):
    """Lengths, and the bytes of a page's strings one after another."""
    rows = parts(spark, sf, "p_name").groupBy("page").agg(F.sort_array(F.collect_list(F.struct("place", "p_name"))).alias("x"), F.sum(F.octet_length("p_name")).cast("long").alias("bytes"), F.min(F.octet_length("p_name")).cast("long").alias("shortest"), F.max(F.octet_length("p_name")).cast("long").alias("longest"))
    return rows.select("page", "bytes", F.md5(F.array_join(F.transform("x", lambda s: s["p_name"]), "").cast("binary")).alias("digest"), "shortest", "longest")


@query(PARTS_SQL + ", w AS (SELECT *, coalesce(lag(p_name) OVER (PARTITION BY page ORDER BY place), '') AS b FROM v), k AS (SELECT *, list_max(list_filter(range(0, least(length(p_name), length(b)) + 1), lambda i: p_name[1:i] = b[1:i])) AS n FROM w) SELECT page, place, CAST(n AS INTEGER) AS prefix, substr(p_name, CAST(n AS INTEGER) + 1) AS suffix FROM k")
def dba_prefix(spark, sf):
    return encodings.front_coded(parts(spark, sf, "p_name"), "p_name").withColumn("suffix", F.col("suffix").cast("string"))


@query(PARTS_SQL + " SELECT page, place, CAST(dense_rank() OVER (PARTITION BY page ORDER BY p_type) - 1 AS INTEGER) AS idx FROM v")
def dict_encode(spark, sf):
    return encodings.dictionary_encode(parts(spark, sf, "p_type"), "p_type")


@query(PARTS_SQL + " SELECT page, place, p_type AS value FROM v")
def dict_roundtrip(spark, sf):
    rows = parts(spark, sf, "p_type")
    return encodings.dictionary_decode(encodings.dictionary_encode(rows, "p_type"), encodings.dictionary(rows, "p_type"))


LIST_SQL = "WITH e AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN [] ELSE list_transform(embedding[1:4], lambda x: CASE WHEN x < 0 THEN NULL ELSE round(CAST(x AS DOUBLE), 4) END) END AS v FROM embeddings)"


def lists(spark, sf):
    """Lists that are null, empty, or hold nulls."""
    short = F.transform(F.slice("embedding", 1, 4), lambda x: F.when(x >= 0, F.round(x.cast("double"), 4)))
    v = F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 0, F.array().cast("array<double>")).otherwise(short)
    return table(spark, sf, "embeddings").select("vec_id", v.alias("v"))


@query(LIST_SQL + """ SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i > 1 THEN 1 ELSE 0 END AS rep, CASE WHEN v[i] IS NULL THEN 2 ELSE 3 END AS def, v[i] AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM e WHERE len(v) > 0)
UNION ALL SELECT vec_id, 0, 0, CASE WHEN v IS NULL THEN 0 ELSE 1 END, NULL FROM e WHERE v IS NULL OR len(v) = 0""")
def list_levels(spark, sf):
    return nested.list_levels(lists(spark, sf), "vec_id", "v")


@query(LIST_SQL + " SELECT vec_id, v IS NULL AS is_null, len(v) AS n, list_sum(v) AS total, len(list_filter(v, lambda x: x IS NULL)) AS nulls FROM e")
def list_assemble(spark, sf):
    back = nested.list_assemble(nested.list_levels(lists(spark, sf), "vec_id", "v"), "vec_id")
    some = F.filter("list", lambda x: x.isNotNull())
    total = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x))
    known = F.col("list").isNotNull()
    return back.select("vec_id", F.col("list").isNull().alias("is_null"), F.when(known, F.size("list").cast("long")).alias("n"), total.alias("total"), F.when(known, F.size(F.filter("list", lambda x: x.isNull())).cast("long")).alias("nulls"))
