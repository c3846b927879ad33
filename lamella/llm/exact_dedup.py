"""Exact deduplication by a tree of merged digest runs, in DataFrame operations only.

Every input partition is a run of digests. A run is a set of arrays, each of which holds the run's
digests of one range in ascending order. In each round FAN_IN neighbouring runs (run numbers that
agree but for their last digit, as in a binomial tree) exchange ranges: the arrays of a range meet and
are merged, which sorting ascending stretches amounts to, and equal neighbours become one entry with
the best identifier and a count. A longer run has more ranges, so an array has about RANGE entries in
every round; after the last round one run is left. Entries are equal only if the digest, the byte
length and a second hash all agree, so each level keeps verified identifiers. A hot text is one entry
a run from the first level on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_facts, without_dropped, written

FAN_IN = 8
#: Entries of a run that one array holds, on average.
RANGE = 2048
KEY = ["_digest", "_bytes", "_check"]


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _digest (SHA-256), _bytes, _check, _run, _row for every row; null texts count as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id).alias("doc_id"),
        F.unhex(F.sha2(value.cast("binary"), 256)).alias("_digest"),
        F.octet_length(value).alias("_bytes"),
        F.xxhash64(value).alias("_check"),
        F.spark_partition_id().alias("_run"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _range(digest: Column, entries: int) -> Column:
    """Which range of a run of so many entries a digest falls in: its first bits."""
    bits = min(40, max(0, (entries // RANGE).bit_length()))
    return F.call_function("shiftright", F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long"), F.lit(48 - bits))


def _folded(entries: Column, last: bool) -> Column:
    """Entries in ascending order with those of one text made one: the last or first, and the sum of counts."""

    def same(a: Column, b: Column) -> Column:
        return (a["_digest"] == b["_digest"]) & (a["_bytes"] == b["_bytes"]) & (a["_check"] == b["_check"])

    starts = F.filter(F.sequence(F.lit(0), F.size(entries) - 1), lambda i: (i == 0) | ~same(F.get(entries, i - 1), F.get(entries, i)))

    def one(start: Column, end: Column) -> Column:
        best = F.get(entries, F.coalesce(end, F.size(entries)) - 1 if last else start)
        group = F.slice(entries, start + 1, F.coalesce(end, F.size(entries)) - start)
        total = F.aggregate(group, F.lit(0).cast("long"), lambda n, x: n + x["group_size"])
        return F.struct(*[best[c].alias(c) for c in (*KEY, "_best")], total.alias("group_size"))

    ends = F.slice(starts, F.lit(2), F.size(entries))
    return F.zip_with(starts, ends, one)


def tree_merge(runs: DataFrame, keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """(_digest, _bytes, _check, _best, group_size): the digest runs merged in rounds.

    keep: "max" or "min", the identifier that stays; null identifiers stay only in groups without
    another. Rows that repeat an identifier are told apart by _row. An empty table gives no rows.
    """
    last = keep == "max"
    best = F.max if last else F.min
    rank = F.struct(F.col("doc_id").isNotNull().alias("known") if last else F.col("doc_id").isNull().alias("known"), "doc_id", "_row")
    found = runs.agg(F.max("_run").alias("last"), F.count(F.lit(1)).alias("n")).first()
    width, total = (found["last"] or 0) + 1, found["n"]
    level = runs.groupBy("_run", *KEY).agg(best(rank).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    while width > 1:
        width = -(-width // fan_in)
        met = level.withColumn("_run", F.expr(f"_run div {fan_in}")).withColumn("_range", _range(F.col("_digest"), total // width))
        arrays = met.groupBy("_run", "_range").agg(F.collect_list(F.struct(*KEY, "_best", "group_size")).alias("entries"))
        merged = arrays.withColumn("entries", F.array_sort("entries")).withColumn("entries", _folded(F.col("entries"), last))
        level = merged.select("_run", F.explode("entries").alias("x")).select("_run", "x.*")
    return level.drop("_run")


def exact_dedup(docs: DataFrame, keep: str = "max", id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Exactly one row of each group of equal texts is kept. Empty and null texts form one group. Other
    columns are left out; the id may be of any type with an order. An empty table gives no rows.
    """
    rows = written(digests(docs, id, text), "digests")
    merged = written(tree_merge(rows, keep), "merged")
    return join_facts(rows, merged, KEY, "group_size", rows.count()).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "max", id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one row of each group of equal texts, with all their columns."""
    decided = written(exact_dedup(docs, keep, id, text).select("doc_id", F.col("text_sha256").alias("key"), "kept"), "decided")
    return without_dropped(docs, decided, id, text, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
