"""Near-duplicates by weighted MinHash over TF-IDF shingles.

1. Shingles of five words; a text's weight of a shingle is its count there times an inverse document
   frequency. Frequencies are counted over all documents into a sketch of fixed size.
2. Improved consistent weighted sampling: two texts agree on a sample with a probability equal to
   their weighted Jaccard similarity. Samples are cut into bands; equal bands share a bucket.
3. Each bucket's members are verified against the bucket's leader by exact weighted Jaccard
   similarity; verified links give classes (connected components).
4. Where a bucket's other members still are of several classes, every pair of different classes is
   verified, most similar first, by an inverted index of the shingles within blocks of members. The
   largest class of a bucket is never compared with itself: its members are dealt once to each block
   of the others, so one outlier in a bucket of a million near copies costs a million comparisons.
5. Buckets whose others are many (more than OTHERS) are first divided by shingles: a pair of that
   similarity has a shingle in common among the rarest of each, so only members that share such a
   shingle meet (prefix filtering, which is exact).

Equal texts are one text throughout. Every two texts that share a bucket and reach the threshold are
linked, directly or through others. Which texts share a bucket is left to chance: were samples
independent, a pair of similarity 0.8 would share none with a probability of 0.18 %, one of 0.85 with
0.008 % and one of 0.9 with one in two million.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, claim, join_facts, release, slices, strings, without_dropped, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
HASHES = BANDS * ROWS
#: Cells of the document-frequency sketch: other shingles add about 1 / 160 of the documents to a cell.
CELLS = 1 << 16
#: Weights fall with the logarithm of the document frequency from 1 (in one of RARE documents or
#: fewer, what the sketch can tell apart) to LEAST_WEIGHT (in all documents).
RARE, LEAST_WEIGHT = 128.0, 0.7
#: Members of a bucket that meet at once on either side, and the bytes of their texts, roughly.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Members besides the largest class from which a bucket is divided by shingles.
OTHERS = 4 * BLOCK
#: Texts whose signatures a task remembers having given.
GIVEN = 1 << 17
DRAWS = 1 << 16
MASK48 = np.uint64((1 << 48) - 1)

#: Characters whose words are hashed at once.
CHARACTERS = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _in_words() -> np.ndarray:
    """Whether a character is a letter, digit or underscore, by its number."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


def _word_hashes(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(where words begin, their 64-bit hashes), stretch by stretch; a stretch ends between words.

    A word's hash is the sum of its mixed characters, each times a power of an odd number by its place.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table, at = _in_words(), 0
    while at < len(chars):
        end = min(at + CHARACTERS, len(chars))
        while end < len(chars) and table[chars[end - 1]] and table[chars[end]]:
            end += 1
        inside = table[chars[at:end]]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            first = np.cumsum(sizes) - sizes
            with np.errstate(over="ignore"):
                value = chars[at:end][inside].astype(np.uint64) * ODD
                value ^= value >> np.uint64(31)
                power = np.cumprod(np.full(int(sizes.max()), np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)
                value *= power[np.arange(len(value)) - np.repeat(first, sizes)]
                yield starts + at, np.add.reduceat(value, first)
        at = end


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle hash, count), sorted, of fewer than 65,536 texts.

    Words are runs of letters, digits and underscores in lower case. A text of one to four words has
    one shingle of all of them; one without words has none.
    """
    lower = [x.lower() for x in texts]
    found = list(_word_hashes("\n".join(lower)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins, words = (np.concatenate(x) for x in zip(*found))
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in lower), np.int64, len(lower)))
    sizes = np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(lower))
    filled = np.where((sizes > 0) & (sizes < WORDS), WORDS, sizes)
    total = int(filled.sum())
    h = np.zeros(total, np.uint64)
    h[np.arange(len(words)) + np.repeat(np.cumsum(filled - sizes) - (filled - sizes), sizes)] = words
    sizes = filled
    with np.errstate(over="ignore"):
        s = np.zeros(total - WORDS + 1, np.uint64)
        for i in range(WORDS):
            s = (s ^ h[i : total - WORDS + 1 + i]) * ODD
            s ^= s >> np.uint64(29)
    owner = np.repeat(np.arange(len(lower)), sizes)
    inside = owner[: len(s)] == owner[WORDS - 1 :]
    keys = (owner[: len(s)][inside].astype(np.uint64) << np.uint64(48)) | (s[inside] >> np.uint64(16))
    keys, counts = np.unique(keys, return_counts=True)
    return (keys >> np.uint64(48)).astype(np.int64), keys & MASK48, counts


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Documents by cell of the sketch, over all documents; as many numbers at any size of input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices(batch):
                _, h, _ = shingles(strings(part, text))
                cells += np.bincount((h >> np.uint64(32)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(cells)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(cells[some], pa.int64())], ["cell", "n"])

    rows = docs.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CELLS, np.int64)
    table = rows.toArrow()
    out[table["cell"].to_numpy()] = table["n"].to_numpy()
    return out


def inverse_frequencies(cells: np.ndarray, documents: int) -> np.ndarray:
    """Weights by cell from LEAST_WEIGHT to 1.

    The floor keeps a text's own words from outweighing those of a group that holds much of the
    corpus: its near copies stay alike although their common shingles are frequent.
    """
    idf = np.log(max(documents, 1) / np.maximum(cells, 1)) / np.log(RARE)
    return (LEAST_WEIGHT + (1 - LEAST_WEIGHT) * np.clip(idf, 0.0, 1.0)).astype(np.float32)


class Sampler:
    """Consistent weighted samples. Gamma and uniform draws come from tables indexed by a hash of the shingle."""

    def __init__(self, seed: int = 20_11):
        rng = np.random.default_rng(seed)
        r = rng.gamma(2.0, 1.0, DRAWS)
        self.r, self.inverse = r.astype(np.float32), (1 / r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, DRAWS)).astype(np.float32)
        self.beta = rng.random(DRAWS).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, h: np.ndarray, log_weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, HASHES) samples; starts: where each text's shingles begin."""
        out = np.empty((len(starts), HASHES), np.uint32)
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for j, odd in enumerate(self.odd):
                at = ((h * odd) >> np.uint64(48)).astype(np.int64)
                r, beta = self.r[at], self.beta[at]
                t = np.floor(log_weight * self.inverse[at] + beta)
                rank = self.log_c[at] - r * (t - beta + np.float32(1)) + np.float32(200)
                name = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
                key = (np.maximum(rank, np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32)) | name
                out[:, j] = np.minimum.reduceat(key, starts).astype(np.uint32)
        return out


def signatures(docs: DataFrame, idf: np.ndarray, text: str = "text") -> DataFrame:
    """(key, bands) for texts with words; docs has key and the text. A task leaves out repeated keys that it remembers."""

    def make():
        sampler = Sampler()
        given: set[bytes] = set()

        def each(batch):
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            fresh = [i for i, k in enumerate(keys) if not (k in given or given.add(k))]
            if len(given) > GIVEN:
                given.clear()
            texts = strings(batch, text)
            owner, h, counts = shingles([texts[i] for i in fresh])
            if not len(owner):
                return None
            rows, starts = np.unique(owner, return_index=True)
            weight = np.log(counts * idf[(h >> np.uint64(32)).astype(np.int64)]).astype(np.float32)
            out = sampler(h, weight, starts)
            bands = np.empty((len(rows), BANDS), np.int64)
            for b in range(BANDS):
                part = np.ascontiguousarray(out[:, b * ROWS : (b + 1) * ROWS])
                bands[:, b] = [np.int64(xxhash.xxh64_intdigest(x.tobytes(), b) - (1 << 63)) for x in part]
            return pa.record_batch([pa.array([keys[fresh[i]] for i in rows], pa.binary()), pa.array(list(bands), pa.list_(pa.int64()))], ["key", "bands"])

        return each

    return arrow_map(docs.select("key", text), make, "key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact weighted Jaccard similarity reaches the threshold."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "ta", "b", "tb")

    def make():
        def weighted(texts):
            owner, h, counts = shingles(texts)
            return owner, (owner.astype(np.uint64) << np.uint64(48)) | h, counts * idf[(h >> np.uint64(32)).astype(np.int64)].astype(np.float64)

        def each(batch):
            n = batch.num_rows
            oa, ka, wa = weighted(strings(batch, "ta"))
            ob, kb, wb = weighted(strings(batch, "tb"))
            _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            shared = np.bincount(oa[ia], np.minimum(wa[ia], wb[ib]), n)
            whole = np.bincount(oa, wa, n) + np.bincount(ob, wb, n) - shared
            similarity = shared / np.maximum(whole, 1e-12)
            kept = np.flatnonzero(similarity >= threshold - 1e-9)
            out = batch.select(["a", "b"]).take(pa.array(kept))
            return pa.record_batch([*out.columns, pa.array(similarity[kept])], ["a", "b", "similarity"])

        return each

    return arrow_map(both, make, "a binary, b binary, similarity double")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(key, label) for each end of a link: label is the least key of its connected component.

    Rounds of taking the least label of the neighbours and then the label of that label; the number
    of rounds grows with the logarithm of the longest chain.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = written(edges.union(edges.select("y", "x")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("key")).agg(F.min("y").alias("y")).select("key", F.least("key", "y").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("key").alias("y"), "label"), "y").groupBy(F.col("x").alias("key")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        stepped = written(stepped, "labels")
        jump = stepped.select(F.col("key").alias("label"), F.col("label").alias("further"))
        fresh = written(stepped.join(jump, "label", "left").select("key", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = fresh.select("key", "label")
        if fresh.where(F.col("was") != F.col("label")).isEmpty():
            return labels


def _shared_weights(owner: np.ndarray, h: np.ndarray, counts: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, n) weights that every two texts share: sums of the smaller weight of each common shingle.

    A shingle that a text has c times is c columns of the same weight, which makes the smaller count
    a count of common columns. Columns of many texts are multiplied as matrices, others pair by pair.
    """
    out = np.zeros((n, n))
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner, h, weight = (np.repeat(x, counts) for x in (owner, h, weight))
    order = np.lexsort((owner, level, h))
    owner, h, level, weight = owner[order], h[order], level[order], weight[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (level[1:] != level[:-1])))
    size = np.diff(np.append(first, len(h)))
    for k in np.unique(size[size > 1]):
        starts = first[size == k]
        if k <= 24:
            texts, w = owner[starts[:, None] + np.arange(k)], weight[starts]
            i, j = np.triu_indices(k, 1)
            for at in range(0, len(starts), 8192):
                cells = (texts[at : at + 8192][:, i] * n + texts[at : at + 8192][:, j]).ravel()
                out += np.bincount(cells, np.repeat(w[at : at + 8192], len(i)), n * n).reshape(n, n)
        else:
            for at in range(0, len(starts), 2048):
                some = starts[at : at + 2048]
                has = np.zeros((n, len(some)))
                has[owner[some[:, None] + np.arange(k)], np.arange(len(some))[:, None]] = 1
                out += np.triu((has * weight[some]) @ has.T, 1)
    return out + out.T


def _links_within(members: list[dict], idf: np.ndarray, threshold: float) -> Iterator[tuple[bytes, bytes]]:
    """Verified links that join classes among a meeting's members; those dealt as `largest` are not compared with one another."""
    members.sort(key=lambda x: x["key"])
    labels = [x["label"] for x in members]
    number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    parent = list(range(len(number)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    label = np.array([number[x] for x in labels])
    side = np.array([x["side"] for x in members])
    owner, h, counts = shingles([x["text"] for x in members])
    weight = idf[(h >> np.uint64(32)).astype(np.int64)].astype(np.float64)
    total = np.bincount(owner, weight * counts, len(members))
    shared = _shared_weights(owner, h, counts, weight, len(members))
    whole = total[:, None] + total[None, :] - shared
    met = (label[:, None] != label[None, :]) & ((side[:, None] != side[None, :]) | (side == 0)[:, None])
    i, j = np.nonzero(np.triu(met & (shared >= (threshold - 1e-9) * np.maximum(whole, 1e-12)), 1))
    for at in np.argsort(-(shared[i, j] / whole[i, j]), kind="stable"):
        a, b = root(label[i[at]]), root(label[j[at]])
        if a != b:
            parent[b] = a
            yield members[i[at]]["key"], members[j[at]]["key"]


def _dealt(named: DataFrame) -> DataFrame:
    """(place, a, b, side, key, label) of the members (place, key, label, bytes) of places with several classes.

    A place's largest class and its others are cut into blocks. Every block of the others meets every
    block of the largest class (sides 1 and 2), itself (side 0 and 0), and every later one of the others (1 and 2).
    """
    classes = named.groupBy("place", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    sizes = classes.groupBy("place").agg(F.max(F.struct("n", "label", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > top.n")

    def blocks(n: Column, size: Column) -> Column:
        return F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))).cast("int")

    tops, others = blocks(F.col("top.n"), F.col("top.bytes")), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))
    sizes = sizes.select("place", F.col("top.label").alias("top"), tops.alias("tops"), others.alias("others"))
    members = named.join(sizes, "place")
    largest = F.col("label") == F.col("top")
    block = F.pmod(F.xxhash64("key"), F.when(largest, F.col("tops")).otherwise(F.col("others"))).cast("int")
    members = members.withColumn("block", block)

    def meeting(a: Column, b: Column, side: int) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))

    def every(end: Column, make) -> Column:
        none = F.array().cast("array<int>")
        return F.transform(F.when(end > 0, F.sequence(F.lit(0), end - 1)).otherwise(none), make)

    me, minus = F.col("block"), lambda x: -1 - x
    as_top = every(F.col("others"), lambda x: meeting(x, minus(me), 2))
    with_top = every(F.col("tops"), lambda x: meeting(me, minus(x), 1))
    before = every(me, lambda x: meeting(x, me, 2))
    after = F.filter(every(F.col("others"), lambda x: meeting(me, x, 1)), lambda x: x["b"] > me)
    alone = F.array(meeting(me, me, 0))
    met = F.when(largest, as_top).otherwise(F.concat(with_top, before, after, alone))
    return members.withColumn("m", F.explode(met)).select("place", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.side").alias("side"), "key", "label")


def _met(dealt: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) of all meetings; a task reads its meetings as a stream, one at a time."""
    rows = dealt.join(texts.select("key", "text"), "key").repartition("place", "a", "b").sortWithinPartitions("place", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)

        def each():
            for batch in batches:
                for part in slices(batch):
                    yield from part.to_pylist()

        for _, some in groupby(each(), key=lambda x: (x["place"], x["a"], x["b"])):
            links = list(_links_within(list(some), idf, threshold))
            if links:
                a, b = zip(*links)
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _divided(named: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(place, key, label, bytes): the members of buckets once for each of their rarest shingles.

    Shingles are in order of the number of members that have them in the bucket. A member keeps the
    first ones, until those that are left weigh less than the threshold's share of its weight: two
    members that reach the threshold have one of these in common.
    """

    def make():
        def each(batch):
            rows = batch.select(["place", "key", "label", "bytes"])
            owner, h, counts = shingles(strings(batch, "text"))
            if not len(owner):
                return None
            weight = counts * idf[(h >> np.uint64(32)).astype(np.int64)].astype(np.float64)
            some = rows.take(pa.array(owner))
            return pa.record_batch([*some.columns, pa.array(h.astype(np.int64)), pa.array(weight)], ["place", "key", "label", "bytes", "shingle", "weight"])

        return each

    rows = named.join(texts.select("key", "text"), "key").select("place", "key", "label", "bytes", "text")
    cells = written(arrow_map(rows, make, "place long, key binary, label binary, bytes long, shingle long, weight double"), "cells")
    found = written(cells.groupBy("place", "shingle").agg(F.count(F.lit(1)).alias("n")), "found")
    ranked = join_facts(cells, found, ["place", "shingle"], "n", cells.count())
    rarest = Window.partitionBy("place", "key").orderBy("n", "shingle")
    left = F.sum("weight").over(Window.partitionBy("place", "key")) * F.lit(1 - threshold + 1e-6)
    before = F.coalesce(F.sum("weight").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = ranked.withColumn("_before", before).withColumn("_left", left).where("_before <= _left AND n > 1")
    return first.select(F.xxhash64("place", "shingle").alias("place"), "key", "label", "bytes").distinct()


def _search(buckets: DataFrame, texts: DataFrame, labels: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) that join all classes which similar members of a bucket (bucket, key) are in."""
    sized = buckets.join(labels, "key", "left").join(texts.select("key", F.octet_length("text").cast("long").alias("bytes")), "key")
    named = written(sized.select(F.col("bucket").alias("place"), "key", F.coalesce("label", "key").alias("label"), "bytes"), "named")
    classes = named.groupBy("place", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = classes.groupBy("place").agg(F.max("n").alias("top"), F.sum("n").alias("n")).where("n > top")
    mixed = written(mixed.select("place", (F.col("n") - F.col("top") > OTHERS).alias("many")), "mixed")
    found = _met(_dealt(named.join(mixed.where("not many"), "place").drop("many")), texts, idf, threshold)
    many = mixed.where("many").select("place")
    if many.isEmpty():
        return found
    return found.union(_met(_dealt(written(_divided(named.join(many, "place"), texts, idf, threshold), "divided")), texts, idf, threshold))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, group_id, group_size, kept, key.

    group_id is the least doc_id of the class, group_size its rows, kept marks its one row that
    stays (that doc_id's); key identifies the text. Equal texts are always one class, and so are
    empty and null texts. A text without words is like its equals only. Other columns are left out.
    """
    spark = docs.sparkSession
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    source = docs.select(F.col(id).alias("doc_id"), key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = written(source.select("doc_id", "key", F.monotonically_increasing_id().alias("row")), "rows")
    idf = inverse_frequencies(document_frequencies(source), rows.count())
    signed = written(signatures(source, idf).dropDuplicates(["key"]), "signatures")
    release(spark)

    buckets = signed.select("key", F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(buckets.join(leaders, "bucket").where("key != leader"), "buckets")
    pairs = written(shared.select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    chosen = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))).alias("one")).join(wanted, "key").select("key", F.col("one.doc_id").alias("_one"))
    # Equal texts are many rows of one key: the join also takes the id, which spreads them.
    same = [source["key"] == chosen["key"], F.coalesce(source["doc_id"], F.lit(0)) == F.coalesce(chosen["_one"], F.lit(0)), source["doc_id"].eqNullSafe(chosen["_one"])]
    texts = written(source.join(chosen, same, "left_semi").select("key", "text").dropDuplicates(["key"]), "texts")
    release(spark)

    links = written(verified(pairs, texts, idf, threshold), "links")
    labels = components(links)
    # Leaders have met all members of their buckets, so only the others are searched, and three make two of those.
    found = written(_search(shared.where("n > 2").select("bucket", "key"), texts, labels, idf, threshold), "links")
    if not found.isEmpty():
        labels = components(links.select("a", "b").union(found))
    release(spark)

    classed = rows.join(labels, "key", "left").select("doc_id", "key", "row", F.coalesce("label", "key").alias("label"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    classed = written(classed, "classed")
    groups = written(classed.groupBy("label").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    return join_facts(classed, groups, ["label"], "group_size", classed.count()).select("doc_id", F.col("first.doc_id").alias("group_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "key")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one row of each class, with all their columns."""
    decided = written(near_classes(docs, threshold, id, text).select("doc_id", "key", "kept"), "decided")
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return without_dropped(docs, decided, id, text, key)
