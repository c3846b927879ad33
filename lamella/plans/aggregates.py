"""Statistics, comparison order, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..functions.hashing import xxh64_bytes, xxh64_number
from ..operators import bloom, nested, schema
from ..errors import OutOfSpec
from ..operators.statistics import boundary_order, column_statistics
from ..session import scratch
from ..sources.pageindex import filters
from ..sources.sink import WriteOptions, write
from .registry import query, table


@query("SELECT o_orderstatus, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value, count(*) - count(o_totalprice) AS null_count, count(*) AS num_values FROM orders GROUP BY 1")
def stats_primitive(spark, sf):
    return column_statistics(table(spark, sf, "orders"), "o_totalprice", [F.col("o_orderstatus")])


@query("SELECT p_brand, min(p_name) AS min_value, max(p_name) AS max_value, count(*) - count(p_name) AS null_count, count(*) AS num_values FROM part GROUP BY 1")
def stats_binary(spark, sf):
    return column_statistics(table(spark, sf, "part"), "p_name", [F.col("p_brand")])


@query("SELECT min(v) AS min_value, max(v) AS max_value, CAST(0 AS BIGINT) AS null_count, count(*) AS num_values FROM (SELECT substr(md5(p_name), 1, 16) AS v FROM part)")
def stats_fixed_binary(spark, sf):
    """Of eight-byte values; bounds are shown in hex."""
    fixed = F.unhex(F.substring(F.md5(F.col("p_name").cast("binary")), 1, 16))
    shown = [F.lower(F.hex(c)).alias(c) for c in ("min_value", "max_value")]
    return column_statistics(table(spark, sf, "part"), fixed).select(*shown, "null_count", "num_values")


@query("SELECT event_type, min(value > 50) AS min_value, max(value > 50) AS max_value, count(*) - count(value) AS null_count, count(*) AS num_values FROM events GROUP BY 1")
def stats_boolean(spark, sf):
    return column_statistics(table(spark, sf, "events"), F.col("value") > 50, [F.col("event_type")])


@query("""WITH p AS (SELECT event_id // 500 AS page, min(event_id) AS a, max(event_id) AS b, min(user_id) AS c, max(user_id) AS d FROM events GROUP BY 1),
 s AS (SELECT a >= lag(a) OVER w AND b >= lag(b) OVER w AS k, c >= lag(c) OVER w AND d >= lag(d) OVER w AS up, c <= lag(c) OVER w AND d <= lag(d) OVER w AS down FROM p WINDOW w AS (ORDER BY page))
SELECT 'event_id' AS column_name, CASE WHEN bool_and(coalesce(k, true)) THEN 'ASCENDING' ELSE 'UNORDERED' END AS boundary_order FROM s
UNION ALL SELECT 'user_id', CASE WHEN bool_and(coalesce(up, true)) THEN 'ASCENDING' WHEN bool_and(coalesce(down, true)) THEN 'DESCENDING' ELSE 'UNORDERED' END FROM s""")
def page_boundary_order(spark, sf):
    page = F.floor(F.col("event_id") / 500).alias("page")
    out = None
    for name in ("event_id", "user_id"):
        rows = boundary_order(column_statistics(table(spark, sf, "events"), name, [page]).withColumn("column_name", F.lit(name)), "page", ["column_name"])
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT count(*) AS num_rows, CAST(sum(greatest(coalesce(len(embedding), 1), 1)) AS BIGINT) AS num_values FROM embeddings")
def nested_value_count(spark, sf):
    return nested.value_counts(table(spark, sf, "embeddings"), "embedding")


@query("SELECT p_partkey, p_name < p_type AS before, p_name = substr(p_name, 1, 3) AS same, p_name > substr(p_name, 1, 3) AS longer_is_larger FROM part")
def binary_order(spark, sf):
    """Bytes compare one by one, and a prefix comes before what it begins."""
    a, b, start = F.col("p_name").cast("binary"), F.col("p_type").cast("binary"), F.substring("p_name", 1, 3).cast("binary")
    return table(spark, sf, "part").select("p_partkey", (a < b).alias("before"), (a == start).alias("same"), (a > start).alias("longer_is_larger"))


@query("SELECT event_type, count(*) AS n, min(v) AS least, isnan(max(v)) AS nan_is_largest FROM (SELECT event_type, CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM events) GROUP BY 1")
def float_order(spark, sf):
    """NaN is larger than any number."""
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.isnan(F.max(v)).alias("nan_is_largest"))


@query("SELECT o_orderkey, (2440588 + (epoch_us(o_orderdate) // 86400000000) - 2440588) * 86400000000000 + (epoch_us(o_orderdate) % 86400000000) * 1000 AS ns FROM orders")
def int96_to_ns(spark, sf):
    """Timestamps split into a Julian day and nanoseconds, and put together again."""
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    day, nanos = F.floor(micros / 86_400_000_000) + bits.UNIX_EPOCH_JULIAN_DAY, F.pmod(micros, F.lit(86_400_000_000)) * 1000
    return table(spark, sf, "orders").select("o_orderkey", bits.int96_to_nanos(day, nanos).alias("ns"))


@query("SELECT CAST(n AS INTEGER) AS size, CAST(floor((8 * n - 1) * log10(2)) AS INTEGER) AS digits FROM range(1, 33) AS r(n)")
def decimal_precision(spark, sf):
    return spark.range(1, 33).select(F.col("id").cast("int").alias("size"), bits.decimal_precision(F.col("id")).alias("digits"))


@query("SELECT * FROM (VALUES ('BOOLEAN', 'UNSIGNED'), ('INT32', 'SIGNED'), ('INT64', 'SIGNED'), ('INT96', 'UNDEFINED'), ('FLOAT', 'SIGNED'), ('DOUBLE', 'SIGNED'), ('BYTE_ARRAY', 'UNSIGNED'), ('FIXED_LEN_BYTE_ARRAY', 'UNSIGNED')) AS t(physical, sort_order)")
def sort_order_map(spark, sf):
    return spark.createDataFrame([(p, schema.sort_order(p)) for p in schema.PHYSICAL], "physical string, sort_order string")


#: Primes of xxh64 (fixed values of that hash).
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WRAP = "18446744073709551616::UHUGEINT"


def _rotated(x: str, bits: int) -> str:
    return f"(({x} * {2**bits}::UHUGEINT) % {WRAP} + {x} // {2 ** (64 - bits)}::UHUGEINT)"


def hashed_sql(source: str, lanes: list[str], rest: list[str], size: int, name: str) -> str:
    """CTEs that add h, the xxh64 of a value of `size` < 32 bytes, to a source: eight-byte lanes and single bytes as numbers."""
    steps, at = [], source

    def step(columns: str) -> None:
        nonlocal at
        steps.append(f"{name}{len(steps)} AS (SELECT * EXCLUDE (k, h), {columns} FROM {at})" if steps else f"{name}0 AS (SELECT *, {columns} FROM {at})")
        at = f"{name}{len(steps) - 1}"

    step(f"0::UHUGEINT AS k, {P5 + size}::UHUGEINT AS h")
    for lane in lanes:
        step(f"({lane})::UHUGEINT * {P2}::UHUGEINT % {WRAP} AS k, h")
        step(f"{_rotated('k', 31)} * {P1}::UHUGEINT % {WRAP} AS k, h")
        step(f"k, xor(h, k) AS h")
        step(f"k, ({_rotated('h', 27)} * {P1}::UHUGEINT % {WRAP} + {P4}::UHUGEINT) % {WRAP} AS h")
    for byte in rest:
        step(f"k, xor(h, ({byte})::UHUGEINT * {P5}::UHUGEINT % {WRAP}) AS h")
        step(f"k, {_rotated('h', 11)} * {P1}::UHUGEINT % {WRAP} AS h")
    for bits, prime in ((33, P2), (29, P3)):
        step(f"k, xor(h, h // {2**bits}::UHUGEINT) * {prime}::UHUGEINT % {WRAP} AS h")
    step(f"k, xor(h, h // {2**32}::UHUGEINT) AS h")
    return ", ".join(steps) + f", {name} AS (SELECT * EXCLUDE (k, h), h FROM {at})"


def _number(text: str, start: int, size: int) -> str:
    """Bytes of a text as a little-endian number."""
    digits = " || ".join(f"substr(hex({text}), {2 * (start + i) + 1}, 2)" for i in reversed(range(size)))
    return f"('0x' || {digits})::UBIGINT"


KEYS = hashed_sql("customer", ["c_custkey"], [], 8, "keyed")
NAMES = hashed_sql("customer", [_number("c_name", 0, 8), _number("c_name", 8, 8)], [_number("c_name", 16, 1), _number("c_name", 17, 1)], 18, "named")
SIGNED = "CAST(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END AS BIGINT)"


def words_sql(source: str, blocks: int, name: str) -> str:
    """CTEs of the (block, word, bit) that each h of a source sets, and of the filter's words."""
    salts = ", ".join(f"({i}, {x}::UHUGEINT)" for i, x in enumerate(bloom.SALTS))
    block, bit = f"CAST((h // 4294967296::UHUGEINT) * {blocks}::UHUGEINT // 4294967296::UHUGEINT AS BIGINT)", "CAST((h % 4294967296::UHUGEINT) * salt % 4294967296::UHUGEINT // 134217728::UHUGEINT AS INTEGER)"
    return f"{name}_bits AS (SELECT s.*, {block} AS block, word, 1::BIGINT << {bit} AS bit FROM {source} AS s, (VALUES {salts}) AS t(word, salt)), {name} AS (SELECT block, word, bit_or(bit) AS bits FROM {name}_bits GROUP BY 1, 2)"


@query(f"WITH {KEYS}, {NAMES} SELECT c_custkey, (SELECT {SIGNED} FROM keyed AS k WHERE k.c_custkey = c.c_custkey) AS h_key, (SELECT {SIGNED} FROM named AS n WHERE n.c_custkey = c.c_custkey) AS h_name FROM customer AS c")
def bloom_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", xxh64_number(F.col("c_custkey"), 8).alias("h_key"), xxh64_bytes(F.col("c_name")).alias("h_name"))


@query(f"WITH {NAMES}, {words_sql('named', 64, 'w')} SELECT block, word, bits FROM w")
def bloom_build(spark, sf):
    """The words of a filter over customer names."""
    return bloom.build(table(spark, sf, "customer").select(xxh64_bytes(F.col("c_name")).alias("h")), "h", 64)


BLOCKS = 64


@query(
    f"WITH {KEYS}, inside AS (SELECT * FROM keyed WHERE c_custkey % 2 = 0), {words_sql('inside', BLOCKS, 'w')}, {words_sql('keyed', BLOCKS, 'a')} "
    "SELECT c_custkey, bool_and(coalesce(bits & bit, 0) <> 0) AS maybe FROM a_bits LEFT JOIN w USING (block, word) GROUP BY 1"
)
def bloom_probe(spark, sf):
    """Keys, half of them absent, asked of the filter that a written file holds."""
    path = scratch(spark, "filtered")
    write(table(spark, sf, "customer").where("c_custkey % 2 = 0").coalesce(1), path, WriteOptions(bloom={"c_custkey": 1000}))
    found = filters(spark, path, ["c_custkey"])
    blocks = {r["blocks"] for r in found.select("blocks").collect()}
    if blocks != {BLOCKS}:
        raise OutOfSpec(f"the writer made filters of {blocks} blocks")
    asked = table(spark, sf, "customer").select("c_custkey", xxh64_number(F.col("c_custkey"), 8).alias("h"))
    return bloom.probe(asked, "h", bloom.words(found), BLOCKS).select("c_custkey", "maybe")


MESSAGE = """message orders { REQUIRED INT64 id = 1; OPTIONAL BYTE_ARRAY name (STRING); OPTIONAL INT32 day (DATE);
 REQUIRED FIXED_LEN_BYTE_ARRAY(16) price (DECIMAL(38,18));
 OPTIONAL group tags (LIST) { REPEATED group list { OPTIONAL BINARY element (UTF8); } }
 OPTIONAL group point { REQUIRED DOUBLE x; OPTIONAL INT64 at (TIMESTAMP(MICROS,true)); } }"""


@query("""SELECT * FROM (VALUES ('id', 'INT64', 0, 0), ('name', 'BYTE_ARRAY', 1, 0), ('day', 'INT32', 1, 0), ('price', 'FIXED_LEN_BYTE_ARRAY', 0, 0),
 ('tags.list.element', 'BYTE_ARRAY', 3, 1), ('point.x', 'DOUBLE', 1, 0), ('point.at', 'INT64', 2, 0)) AS t(path, physical, max_def, max_rep)""")
def schema_leaves(spark, sf):
    rows = [(x.path, x.node.physical, x.max_def, x.max_rep) for x in schema.leaves(schema.parse(MESSAGE))]
    return spark.createDataFrame(rows, "path string, physical string, max_def int, max_rep int")


@query("""SELECT * FROM (VALUES ('id', 'bigint', false), ('name', 'string', true), ('day', 'date', true), ('price', 'decimal(38,18)', false),
 ('tags', 'array<string>', true), ('point', 'struct<x:double,at:timestamp>', true)) AS t(name, type, nullable)""")
def schema_from_message(spark, sf):
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in schema.to_spark(schema.parse(MESSAGE)).fields]
    return spark.createDataFrame(rows, "name string, type string, nullable boolean")


@query("SELECT * FROM (VALUES ('date on INT64', false), ('decimal of 9 digits on INT32', true), ('decimal of 10 digits on INT32', false), ('uuid of 16 bytes', true), ('string on INT32', false)) AS t(what, valid)")
def schema_validate(spark, sf):
    cases = {"date on INT64": "INT64 a (DATE)", "decimal of 9 digits on INT32": "INT32 a (DECIMAL(9,2))", "decimal of 10 digits on INT32": "INT32 a (DECIMAL(10,2))", "uuid of 16 bytes": "FIXED_LEN_BYTE_ARRAY(16) a (UUID)", "string on INT32": "INT32 a (STRING)"}

    def valid(text):
        try:
            schema.parse(f"message m {{ REQUIRED {text}; }}")
        except OutOfSpec:
            return False
        return True

    return spark.createDataFrame([(k, valid(v)) for k, v in cases.items()], "what string, valid boolean")


@query("SELECT * FROM (VALUES ('part', true), ('other repetition', false), ('other type', false), ('absent', false)) AS t(what, contained)")
def schema_contains(spark, sf):
    whole = schema.parse(MESSAGE)
    cases = {"part": "REQUIRED INT64 id = 1; OPTIONAL group point { REQUIRED DOUBLE x; }", "other repetition": "OPTIONAL INT64 id = 1;", "other type": "REQUIRED INT32 id = 1;", "absent": "REQUIRED INT64 nothing;"}
    rows = [(k, schema.contains(whole, schema.parse(f"message orders {{ {v} }}"))) for k, v in cases.items()]
    return spark.createDataFrame(rows, "what string, contained boolean")
