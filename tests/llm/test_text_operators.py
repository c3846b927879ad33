import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import binary_ids, exact_dedup, media, mixing, near_dedup, packing, quality, sharding, token_counts, toxicity
from lamella.llm.common import encoder, scratch_path, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, label string, _p double, _id long, row int, rep int, shard int, piece string, length string"
EDGES = [None, "", " ", "a", "a b", "x" * 5000, "été naïve", "中文 text ​", "tab\tnew\n\nline   spaces", "\x00\x01", "same text here now ok", "same text here now ok"]


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those used inside."""
    rows = [(i if ids is None else ids[i], x, "en", None, None, "k", None, "l", 0.5, 4, 1, 2, 3, None, None) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentences(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(900)]
    return [" ".join(rng.choices(vocabulary, k=words)) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    enc = encoder(path)
    odd = ["a   b\n\n c", "it's 'tis   ", "\n x \n  y", "x　y é́ ſ İ", "ab'll don't%%%'s", " \ta\t b", "<|endoftext|> z", "½ ²3a", "x\x85y\xa0z\xad", "ŒUVRE ß ẞ"]
    rng = random.Random(3)
    odd += ["".join(rng.choices("ab '\n\t.,!1é\xa0S²", k=40)) for _ in range(300)]
    for text in [x or "" for x in EDGES] + odd:
        assert enc.ids(text).tolist() == enc.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_knows_added_tokens(path):
    from tokenizers import Tokenizer

    fresh, enc = Tokenizer.from_file(path), encoder(path)
    added = [x.content for x in fresh.get_added_tokens_decoder().values()]
    assert added
    for token in added:
        for text in (f"a {token} b", token, f"{token}{token}x", token.upper(), f"é\n{token}", f"中 {token} z", token[:-1], f"a  {token}'s 12"):
            assert enc.ids(text).tolist() == fresh.encode(text, add_special_tokens=False).ids, text
    assert fresh.token_to_id(added[0]) in enc.ids(f"a {added[0]} b")
    rng = random.Random(5)
    for text in ["".join(rng.choices("ab '\n.,1é<|>", k=40)) for _ in range(300)]:
        assert enc.ids(text).tolist() == fresh.encode(text, add_special_tokens=False).ids, text


def test_token_counts(spark):
    texts = EDGES + sentences(1, 30) + ["hot"] * 50
    got = [r.asDict() for r in token_counts.token_counts(table(spark, texts), BYTE).collect()]
    lengths = [len(encoder(BYTE).ids(x or "")) for x in texts]
    assert {r["n_tokens"]: r["n_docs"] for r in got} == Counter(lengths)
    for r in got:
        limit = r["n_tokens"]
        assert r["tokens_cut"] == sum(min(n, limit) for n in lengths)
        assert (r["docs_from"], r["tokens_from"]) == (sum(n >= limit for n in lengths), sum(n for n in lengths if n >= limit))
        assert (r["docs_to"], r["tokens_to"]) == (sum(n <= limit for n in lengths), sum(n for n in lengths if n <= limit))
    totals = token_counts.token_counts(table(spark, texts), BYTE)
    for r in token_counts.totals_at(totals, [0, 1, 7, 10**6]).collect():
        assert r.tokens_cut == sum(min(n, r.context_limit) for n in lengths)
    assert token_counts.token_counts(table(spark, []), BYTE).count() == 0


def packed_well(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_plan_is_tight_and_whole():
    rng = random.Random(5)
    for capacity, n in ((10, 200), (100, 3000), (4096, 5000), (7, 1), (100, 0)):
        lengths = [rng.randint(1, capacity) for _ in range(n)]
        histogram = Counter(lengths)
        runs = packing.plan(histogram, capacity)
        rows, seen = [], Counter()
        for length, rank, count, first, per, offset in runs.tolist():
            assert seen[length] == rank
            seen[length] += count
            rows += [{"sequence_id": first + r // per, "offset": offset + r % per * length, "length": length} for r in range(count)]
        assert seen == histogram
        used = packed_well(rows, capacity)
        bound = max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))
        assert used <= 1.05 * bound + 3


def test_pack_documents(spark):
    long_text = " ".join(sentences(2, 200))
    texts = EDGES + sentences(3, 80) + [long_text]
    rows = [r.asDict() for r in packing.pack_documents(table(spark, texts), WORD, 256).collect()]
    packed_well(rows, 256)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = np.append(encoder(WORD).ids(text or "").astype("<u4"), np.uint32(1)).astype("<u4")
        pieces = sorted(by_doc.pop(i), key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 256))
        for r in pieces:
            part = ids[r["start"] : r["start"] + 256]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    assert not by_doc
    assert packing.pack_documents(table(spark, []), WORD).count() == 0


def test_pack_keeps_odd_lengths(spark):
    items = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (2, 0, None), (3, 0, 0), (4, 0, 99), (5, 0, -1), (None, 0, 3)], "doc_id long, piece int, length int")
    rows = [r.asDict() for r in packing.pack(items, 10).collect()]
    assert len(rows) == 7
    assert {r["doc_id"] for r in rows if r["sequence_id"] is None} == {2, 3, 5}
    alone = next(r for r in rows if r["doc_id"] == 4)
    assert [r["doc_id"] for r in rows if r["sequence_id"] == alone["sequence_id"]] == [4]


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, keep):
    texts = EDGES + ["hot"] * 40 + sentences(4, 5) * 3
    ids = [7 * i % 101 for i in range(len(texts))]
    rows = exact_dedup.exact_dedup(table(spark, texts, ids).repartition(9), keep).collect()
    groups = {}
    for i, x in zip(ids, texts):
        groups.setdefault(x or "", []).append(i)
    best = max if keep == "max" else min
    want = sorted((i, best(v), len(v), i == best(v), hashlib.sha256(x.encode()).hexdigest()) for x, v in groups.items() for i in v)
    assert sorted(tuple(r) for r in rows) == want
    left = exact_dedup.drop_copies(table(spark, texts, ids), keep)
    assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in left.collect()) == sorted(best(v) for v in groups.values())


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    docs = table(spark, ["a", "a", "a", "b", None, "", "c"], [5, 5, None, None, None, 3, 2])
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in rows) == 4
    left = exact_dedup.drop_copies(docs).collect()
    assert sorted((r.doc_id or -1, r.text) for r in left) == [(-1, "b"), (2, "c"), (3, ""), (5, "a")]
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_tree_rounds_agree_with_one_merge(spark):
    docs = table(spark, [f"t{i % 23}" for i in range(300)]).repartition(50)
    runs = exact_dedup.digests(docs).cache()
    narrow = {(r._digest, r._best.doc_id, r.group_size) for r in exact_dedup.tree_merge(runs, fan_in=2).collect()}
    wide = {(r._digest, r._best.doc_id, r.group_size) for r in exact_dedup.tree_merge(runs, fan_in=64).collect()}
    assert narrow == wide and len(narrow) == 23


@pytest.mark.parametrize("keep", ["max", "min"])
def test_runs_stay_sorted_in_small_ranges(spark, monkeypatch, keep):
    monkeypatch.setattr(exact_dedup, "RANGE", 4)
    texts = [f"t{i % 211}" for i in range(900)] + ["hot"] * 300
    docs = table(spark, texts).repartition(13)
    runs = exact_dedup.digests(docs).cache()
    got = exact_dedup.tree_merge(runs, keep, fan_in=3)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("array_sort") >= 3
    ids = {}
    for i, x in enumerate(texts):
        ids.setdefault(hashlib.sha256(x.encode()).digest(), []).append(i)
    pick = max if keep == "max" else min
    assert {(bytes(r._digest), r._best.doc_id, r.group_size) for r in got.collect()} == {(k, pick(v), len(v)) for k, v in ids.items()}


def shingle_set(text):
    words = re.findall(r"\w+", text.lower())
    if 0 < len(words) < 5:
        words += [""] * (5 - len(words))
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_copies(seed):
    rng = random.Random(seed)
    texts = sentences(seed, 40, 120)
    for base in range(0, 40, 4):
        words = texts[base].split()
        for _ in range(rng.randint(1, 6)):
            changed = words[:]
            for _ in range(rng.randint(1, 4)):
                changed[rng.randrange(len(words))] = "changed" + str(rng.random())
            texts.append(" ".join(changed))
    shared = " ".join(sentences(99, 1, 60))
    return texts + [f"{x} {shared}" for x in sentences(seed + 1, 60, 60)] + texts[:8]


def test_near_classes_equal_brute_force(spark):
    texts = EDGES + near_copies(6)
    rows = near_dedup.near_classes(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    sets = [shingle_set(x or "") for x in texts]
    idf = near_dedup.inverse_frequencies(near_dedup.document_frequencies(table(spark, texts)), len(texts))
    cells = [near_dedup.shingles([x or ""])[1:] for x in texts]
    weights = [dict(zip(h.tolist(), (c * idf[(h >> np.uint64(32)).astype(int)].astype(float)).tolist())) for h, c in cells]
    assert [len(s) for s in sets] == [len(w) for w in weights]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = sum(min(w, weights[j][k]) for k, w in weights[i].items() if k in weights[j])
            whole = sum(weights[i].values()) + sum(weights[j].values()) - shared
            if (texts[i] or "") == (texts[j] or "") or (whole and shared / whole >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r.doc_id: r.group_id for r in rows} == {i: root(i) for i in range(len(texts))}
    sizes = Counter(r.group_id for r in rows)
    assert all(r.group_size == sizes[r.group_id] and r.kept == (r.doc_id == r.group_id) for r in rows)
    left = near_dedup.drop_near_copies(table(spark, texts))
    assert sorted(r.doc_id for r in left.collect()) == sorted(sizes)


def variants(seed, n, words=200, step=11):
    """A text and others that differ from it in more and more words."""
    rng = random.Random(seed)
    base = sentences(seed, 1, words)[0].split()
    out = []
    for i in range(n):
        changed = base[:]
        for j in range(i):
            changed[(step * j) % words] = f"new{i}x{rng.random()}"
        out.append(" ".join(changed))
    return out


@pytest.mark.parametrize("block,others", [(512, 2048), (2, 2048), (2, 0), (512, 0)])
def test_search_joins_classes_that_leaders_miss(spark, monkeypatch, block, others):
    """All pairs of different classes in a bucket, whether whole, in blocks, or divided by shingles."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "OTHERS", others)
    texts = variants(15, 9) + sentences(16, 2, 200) + variants(17, 4)
    n = len(texts)
    keys = [bytes([i]) * 16 for i in range(n)]
    idf = np.ones(near_dedup.CELLS, np.float32)
    sets = [set(shingle_set(x)) for x in texts]
    alike = {(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    # Two buckets that hold all but one text each: chance plays no part here.
    shared = {i: {b for b in (1, 2) if (i, b) not in ((3, 1), (5, 2))} for i in range(n)}
    buckets = spark.createDataFrame([(b, keys[i]) for i in range(n) for b in shared[i]], "bucket long, key binary")
    labels = spark.createDataFrame([(keys[4], keys[3])], "key binary, label binary")
    texts_df = spark.createDataFrame(list(zip(keys, texts)), "key binary, text string")

    def classes(pairs):
        parent = list(range(n))
        for a, b in pairs:
            old, new = parent[a], parent[b]
            parent = [new if p == old else p for p in parent]
        return {frozenset(i for i in range(n) if parent[i] == p) for p in parent}

    got = [(r.a[0], r.b[0]) for r in near_dedup._search(buckets, texts_df, labels, idf, 0.8).collect()]
    assert set(got) and all((max(p), min(p)) in alike for p in got)
    assert classes(got + [(3, 4)]) == classes([(i, j) for i, j in alike if shared[i] & shared[j]] + [(3, 4)])


def test_one_outlier_in_a_large_bucket_deals_each_member_once(spark):
    n = 20_000
    named = spark.range(n).selectExpr("1L as place", "unhex(md5(cast(id as string))) as key", "case when id < 3 then unhex(md5(concat('o', id))) else X'00' end as label", "10L as bytes")
    dealt = near_dedup._dealt(named).cache()
    blocks = -(-(n - 3) // near_dedup.BLOCK)
    assert dealt.count() == (n - 3) + 3 * (blocks + 1)
    meetings = dealt.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels")).collect()
    assert len(meetings) == blocks + 1 and max(r.n for r in meetings) < 1.4 * near_dedup.BLOCK
    alone = spark.range(5000).selectExpr("1L as place", "unhex(md5(cast(id as string))) as key", "X'00' as label", "10L as bytes")
    assert near_dedup._dealt(alone).count() == 0


@pytest.mark.parametrize("size", [1, 2 << 20])
def test_every_two_others_meet_once(spark, monkeypatch, size):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rows = [(1, bytes([i]) * 4, bytes([0 if i < 20 else i]), size) for i in range(60)]
    dealt = near_dedup._dealt(spark.createDataFrame(rows, "place long, key binary, label binary, bytes long")).collect()
    assert len({(r.a, r.b) for r in dealt}) > (30 if size == 1 else 300)
    meetings = {}
    for r in dealt:
        meetings.setdefault((r.a, r.b), []).append((r.side, r.key[0]))
    met = Counter()
    for some in meetings.values():
        for x in range(len(some)):
            for y in range(x):
                if some[x][0] != some[y][0] or some[x][0] == 0:
                    met[tuple(sorted((some[x][1], some[y][1])))] += 1
    assert met == Counter((i, j) for i in range(60) for j in range(i + 1, 60) if j >= 20)


def test_shared_weights_equal_brute_force():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(40)] + variants(3, 30)
    idf = np.random.default_rng(5).uniform(0.6, 1, near_dedup.CELLS).astype(np.float32)
    owner, h, counts = near_dedup.shingles(texts)
    weight = idf[(h >> np.uint64(32)).astype(int)].astype(float)
    got = near_dedup._shared_weights(owner, h, counts, weight, len(texts))
    bags = [{} for _ in texts]
    for o, k, c, w in zip(owner, h.tolist(), counts, weight):
        bags[o][k] = c * w
    for i in range(len(texts)):
        for j in range(i):
            assert abs(got[i, j] - sum(min(v, bags[j].get(k, 0)) for k, v in bags[i].items())) < 1e-6


def test_frequent_shingles_weigh_less():
    counts = np.array([1, 10, 100, 500, 1000])
    idf = near_dedup.inverse_frequencies(counts, 1000)
    assert idf[0] == 1 and (np.diff(idf[1:]) < 0).all() and abs(idf[-1] - near_dedup.LEAST_WEIGHT) < 1e-6


def test_near_classes_of_empty_and_null_tables(spark):
    assert near_dedup.near_classes(table(spark, [])).count() == 0
    rows = near_dedup.near_classes(table(spark, [None, "", "", "!!"], [None, 2, 1, 4])).collect()
    assert sorted((r.group_id, r.group_size) for r in rows) == [(1, 3), (1, 3), (1, 3), (4, 1)]


def test_samples_agree_as_often_as_weighted_similarity():
    sampler = near_dedup.Sampler()
    rng = np.random.default_rng(1)
    agree, truth = [], []
    for _ in range(60):
        h = np.sort(rng.integers(0, 1 << 48, 300, dtype=np.uint64))
        wa, wb = rng.integers(1, 4, 300).astype(float), rng.integers(1, 4, 300).astype(float)
        a, b = sampler(h, np.log(wa).astype(np.float32), np.array([0]))[0], sampler(h, np.log(wb).astype(np.float32), np.array([0]))[0]
        agree.append((a == b).mean())
        truth.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(agree) - np.mean(truth)) < 0.03


def test_media_round_trip(spark):
    base = sentences(7, 30, 900)
    edited = [x[:3000] + " inserted " + x[3000:] for x in base[:15]]
    texts = EDGES + base + edited + base[:5] + ["line of text\n" * 3000]
    rows = {r.doc_id: r for r in media.media(table(spark, texts), scratch_path(spark, "media")).collect()}
    assert len(rows) == len(texts)
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert 20 + 20 * r.n_chunks <= r.media_bytes <= len(full) + 20 + 20 * r.n_chunks
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows.values()}) == len({x or "" for x in texts})


def test_media_store_holds_shared_chunks_once(spark):
    base = sentences(8, 6, 9000)
    texts = base + [x[:4000] + "?" + x[4000:] for x in base]
    path = scratch_path(spark, "media")
    media.store(table(spark, texts), path)
    forms = [bytes(r.form) for r in spark.read.parquet(path).collect()]
    assert sum(map(len, forms)) < 0.75 * sum(len(x) for x in texts)
    read = media.read(spark, path).collect()
    assert sorted((r.media_bytes, r.media_sha256) for r in read) == sorted((len(f), hashlib.sha256(f).hexdigest()) for f in forms)
    again = scratch_path(spark, "media")
    media.store(table(spark, texts[::-1]), again)
    assert sorted(forms) == sorted(bytes(r.form) for r in spark.read.parquet(again).collect())
    assert media.media(table(spark, []), scratch_path(spark, "media")).count() == 0


def test_media_of_repeated_rows_and_null_ids(spark):
    rows = media.media(table(spark, ["a", "a", None, "b"], [1, 1, None, None]), scratch_path(spark, "media")).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in rows) == [(-1, 0), (-1, 1), (1, 1), (1, 1)]


def test_cuts_follow_content():
    rng = random.Random(1)
    data = bytes(rng.choices(range(256), k=60_000))
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST
    moved = media.cuts(b"some bytes in front" + data)
    assert len({e - 19 for e in moved} & set(ends)) >= 0.7 * len(ends)
    assert media.cuts(b"\xff" * 576) == [576]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, u in ((1, 0), (5, 5), (1000, 100_000), (3000, 10), (700, 2**33)):
        values = np.sort(rng.integers(0, u + 1, n))
        coded = binary_ids.EliasFano.from_bytes(binary_ids.EliasFano.of(values, u).to_bytes())
        assert coded.all().tolist() == values.tolist()
        assert [coded.select(i) for i in range(0, n, 7)] == values[::7].tolist()
        asked = rng.integers(0, n, 50)
        assert coded.select(asked).tolist() == values[asked].tolist()
        with pytest.raises(IndexError):
            coded.select(n)
        assert 8 * (len(coded.low) + len(coded.high)) <= n * (3 + np.log2(max(1, u / n))) + 64


def test_binary_ids(spark):
    texts = EDGES + sentences(9, 60)
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    path = scratch_path(spark, "ids")
    docs = table(spark, [texts[i] for i in order], [i * 3 for i in order]).repartition(5)
    binary_ids.write_ids(docs, path, BYTE)
    rows = {r.doc_id: r for r in binary_ids.read_ids(spark, path).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = np.append(encoder(BYTE).ids(x or "").astype("<u4"), np.uint32(0)).astype("<u4")
        r = rows[i * 3]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = scratch_path(spark, "ids")
    binary_ids.write_ids(table(spark, []), empty, BYTE)
    assert binary_ids.read_ids(spark, empty).count() == 0


def test_binary_ids_segments_end_at_their_limits():
    rows = [(i, b"\x01\x00" * (i % 5)) for i in range(10_000)]
    segments = list(binary_ids._segments(iter(rows), 2))
    assert max(len(s[0]) for s in segments) <= binary_ids.SEGMENT_DOCS
    assert [k for s in segments for k in s[0]] == list(range(10_000))


def labelled(spark, flags, name):
    return spark.createDataFrame([(i, None if f is None else int(f), None if f is None else int(f)) for i, f in enumerate(flags)], "doc_id long, quality int, toxic int")


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(len(score))
    pos = ranks[np.array(label) == 1]
    return (pos.sum() - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (len(score) - len(pos)))


def test_toxicity_learns_and_restores(spark):
    texts, flags = sentences(10, 600, 40), []
    rng = random.Random(4)
    for i in range(600):
        flags.append(i % 4 == 0)
        if flags[-1]:
            words = texts[i].split()
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["villain", "scoundrel", "blockhead"])
            texts[i] = " ".join(words)
    model = toxicity.fit(table(spark, texts), labelled(spark, flags, "toxic"))
    ready = model.ready()
    for altered in ("v1lla1n", "v i l l a i n", "villllain", "sc0undre1", "b.l.o.c.k.h.e.a.d", "8lockhead"):
        assert ready.score(f"{texts[1]} {altered} {texts[2]}") >= 0.5, altered
    got = toxicity.score(table(spark, texts + [None, ""]), model).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == int(flags[r.doc_id]) for r in out) >= 0.97 * len(out)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    left = toxicity.without_toxic(table(spark, texts), model)
    assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r.doc_id for r in left.select("doc_id").collect()} == {r.doc_id for r in got if r.predicted == 0 and r.doc_id < 600}


def test_toxicity_counts_different_words_of_a_beginning():
    words = ["grumbler", "grumbled", "grumbles", "calm"]
    found = toxicity.graded(f for w in words for f in toxicity.features_of(w))
    assert {"calm", "^cal", "grumbler", "^grumble", "^gru", "^gru#2", "^gru#3"} <= found
    assert "^cal#2" not in found and "grumbler#2" not in found and toxicity.graded([]) == set()
    model = toxicity.Model({}, {"^grum#2": 5.0, "calm": -1.0}, -3.0).ready()
    assert model.found("Grumbled, grumbles; grumbles") == {"^grum#2"} and model.found("grumbles grumbles calm") == {"calm"}
    assert model.score("grumbled grumbles") > 0.5 > model.score("grumbles grumbles")


def test_logistic_fit_is_at_the_least_loss():
    rng = np.random.default_rng(3)
    x = (rng.random((400, 12)) < 0.2).astype(np.float32)
    y = ((x[:, 0] + x[:, 1] > 0) | (rng.random(400) < 0.05)).astype(float)
    for l2 in (0.1, 1.0):
        w, b = toxicity._fit_logistic(x, y, l2)
        p = 1 / (1 + np.exp(-(x @ w + b)))
        assert np.abs(x.T @ (p - y) + l2 * w).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    # A word that only labelled rows of class 1 have is enough by itself, whatever else is learned.
    w, b = toxicity._fit_logistic(np.eye(4)[[0] * 90 + [1] * 900 + [2] * 5 + [3] * 5], np.repeat([1.0, 0.0, 1.0], [90, 905, 5]))
    assert w[0] + b > 0 > w[1] + b


def test_character_model_counts_all_documents(spark):
    texts = sentences(20, 60, 20)
    texts += ["Zyzzyvas 中文字 œuvre", None, "zyzzyvas"] * 4
    flags = [i % 2 == 0 for i in range(60)]
    model = toxicity.fit(table(spark, texts), labelled(spark, flags, "toxic"))
    words = Counter(w for x in texts for w in toxicity.WORD.findall((x or "").lower()))
    assert toxicity.corpus_trigrams(table(spark, texts)) == dict(toxicity.trigrams(words))
    assert model.counts["zzy"] == model.counts["yva"] == 8 and model.counts["^??"] == 4
    assert model.ready().channel.restore("zyzzyv4s") == "zyzzyvas"


def test_spans_of_any_length_are_decoded():
    words = ["blockhead", "nobody", "reads", "these", "spelled", "phrases", "aloud"]
    channel = toxicity.Channel(dict(toxicity.trigrams(dict.fromkeys(words, 1000))))
    for word in words:
        assert channel.restore(word[0] + word[1] * 5000 + word[2:]) == word
    assert channel.restore(" ".join("8l0ckh3ad" * 8)).replace(" ", "") == "blockhead" * 8
    assert channel.restore("b.l.o.c.k.h.e.a.d" + "." * 300_000 + "d").startswith("blockhead")
    assert max(map(len, channel.memo), default=0) <= toxicity.MEMO_SPAN


def test_signs_and_spacing_anywhere_are_decoded():
    words = ["idiot", "shit", "ass", "asshole", "moron", "fat", "nobody", "great"]
    channel = toxicity.Channel(dict(toxicity.trigrams(dict.fromkeys(words, 1000))))
    for altered, word in {
        '"1diot"': '"idiot"', "(1diot)": "(idiot)", "555hit": "shit", "a$$": "ass", "asshol3": "asshole",
        "m  o  r  o  n": "moron", "m\no\nr\no\nn": "moron", "m/o/r/o/n": "moron", "f a t": "fat", '"m o r o n",': '"moron",',
        "idiot!!!": "idiot!!!", "great!": "great!",
    }.items():
        assert channel.restore(altered) == word, altered
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choices('ab1$!. -/\n_"', k=rng.randint(1, 9)))
        assert toxicity.QUICK.search(text) or not toxicity.SUSPECT.search(text), text


def test_classifiers_without_labels(spark):
    none = labelled(spark, [], "toxic")
    assert [r.predicted for r in toxicity.score(table(spark, ["a"]), toxicity.fit(table(spark, ["a"]), none)).collect()] == [0]
    assert [r.score for r in quality.score(table(spark, ["a"]), quality.fit(table(spark, ["a"]), none)).collect()] == [0.5]
    assert quality.score(table(spark, []), quality.fit(table(spark, []), none)).count() == 0


def test_quality_learns(spark):
    texts, flags = sentences(11, 500, 50), []
    for i in range(500):
        flags.append(i % 3 != 0)
        if not flags[-1]:
            texts[i] = [texts[i].upper(), " | ".join(texts[i].split()), " ".join(w for w in texts[i].split()[:8] for _ in range(6))][i // 3 % 3]
    model = quality.fit(table(spark, texts), labelled(spark, flags, "quality"))
    got = quality.score(table(spark, texts + [None]), model).collect()
    out = [r for r in got if r.held_out and r.doc_id < 500]
    assert auc([r.score for r in out], [int(flags[r.doc_id]) for r in out]) >= 0.95
    assert len(got) == 501 and all(0 <= r.score <= 1 for r in got)


def test_sharding_splits_only_what_is_too_large(spark):
    texts = EDGES + sentences(12, 300, 20)
    rows = sharding.assign(table(spark, texts), 2000).collect()
    assert len(rows) == len(texts)
    sizes, docs = Counter(), Counter()
    for r in rows:
        bits = format(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16), "060b")
        assert r.depth == 0 or bits.startswith(r.shard)
        sizes[r.shard] += r.n_bytes
        docs[r.shard] += 1
    for r in rows:
        assert (r.shard_bytes, r.shard_docs) == (sizes[r.shard], docs[r.shard])
        assert r.shard_bytes <= 2000 or (r.shard_docs == 1 and r.oversized)
        if r.depth:
            assert sum(v for k, v in sizes.items() if k.startswith(r.shard[:-1])) > 2000
    assert sharding.assign(table(spark, []), 10).count() == 0


def test_sharding_of_one_hash(spark):
    docs = table(spark, ["x" * 100] * 30, [9] * 30)
    rows = sharding.assign(docs, 1000).collect()
    assert len(rows) == 30
    assert max(Counter(r.shard for r in rows).values()) <= 10


def test_mixing_meets_targets(spark):
    texts, flags = sentences(13, 400, 50), []
    for i in range(400):
        flags.append(i % 4 != 0)
        if not flags[-1]:
            texts[i] = texts[i].upper()
    docs, marks = table(spark, texts + [None, ""]), labelled(spark, flags, "quality")
    weights = {"high": 0.5, "low": 0.5}
    model = mixing.fit_classifier(docs, marks, mixing.by_quality(), list(weights))
    rows = mixing.scored(model, docs)
    mixing.fit_rates(model, rows, weights)
    got = [r.asDict() for r in mixing.rates(model, rows).collect()]
    assert len(got) == 402 and min(r["rate"] for r in got) >= 0
    total = sum(r["tokens"] for r in got)
    for d in weights:
        assert abs(sum(r["tokens"] * r["rate"] * r[f"p_{d}"] for r in got) - total / 2) < 0.01 * total
    grown = mixing.fit_rates(model, rows, weights, least_rate=1.0, grow=True)
    out = mixing.realised(grown, rows)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.collect())
    assert set(copies) == set(range(402))
    blank = mixing.scored(model, table(spark, []))
    assert mixing.rates(mixing.fit_rates(model, blank, weights), blank).count() == 0


def test_mixing_equals_brute_force(spark):
    """Posteriors by hand from the fitted tables; rates by the same steps in numpy; copies by draws."""
    rng = random.Random(2)
    texts = [x.replace(" ", rng.choice([" ", "\n", "\t ", ", "])) for x in sentences(21, 120, 20)] + EDGES
    for i in range(0, 120, 3):
        texts[i] = texts[i] + " cheap! cheap,\tCHEAP\noffer"
    marks = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    docs = table(spark, texts)
    weights = {"high": 0.7, "low": 0.3}
    model = mixing.fit_classifier(docs, marks, mixing.by_quality(), list(weights))
    assert "cheap" in model.words["low"]
    rows = mixing.scored(model, docs)
    mixing.fit_rates(model, rows, weights)
    got = {r.doc_id: r for r in mixing.rates(model, rows).collect()}

    def features(x):
        words = re.split(r"[^a-z0-9à-öø-ÿ\u4e00-\u9fff]+", x.lower())
        level = lambda share: min(7, math.floor(math.log2(1 + share * 128)))
        n = max(len(x), 1)
        out = {"signs": level(sum(c in mixing.SIGNS for c in x) / n), "wide": level((len(x.encode()) - len(x)) / n), "distinct": min(7, len(set(words)) * 8 // len(words))}
        return out | {f"words_{d}": min(7, len(set(words) & set(some))) for d, some in model.words.items() if some}

    p, tokens = np.zeros((len(texts), 2)), np.zeros(len(texts))
    for i, x in enumerate(x or "" for x in texts):
        s = np.array([model.prior[d] + sum(model.table[k][d][b] for k, b in features(x).items()) for d in range(2)])
        p[i], tokens[i] = np.exp(s - s.max()) / np.exp(s - s.max()).sum(), len(re.findall(r"[^ \t\n\x0b\f\r]+", x))
        assert got[i].tokens == tokens[i] and np.allclose([got[i].p_high, got[i].p_low], p[i], atol=1e-9), x
    rate = np.maximum(0, 1 + p @ np.array(model.move))
    assert np.allclose([got[i].rate for i in range(len(texts))], rate)
    reached = (tokens * rate) @ p
    assert got[0].converged and np.allclose(reached, np.array([0.7, 0.3]) * tokens.sum(), atol=mixing.TOLERANCE * tokens.sum())
    copies = Counter(r.doc_id for r in mixing.realised(model, rows).select("doc_id").collect())
    assert all(copies[i] in (math.floor(r), math.floor(r) + 1) for i, r in enumerate(rate))


def test_mixing_says_when_targets_are_not_met(spark):
    docs, marks = table(spark, sentences(22, 60, 20)), labelled(spark, [i % 2 for i in range(60)], "quality")
    model = mixing.fit_classifier(docs, marks, mixing.by_quality(), ["high", "low"])
    rows = mixing.scored(model, docs)
    mixing.fit_rates(model, rows, {"high": 0.999, "low": 0.001}, steps=0)
    assert {r.converged for r in mixing.rates(model, rows).collect()} == {False}
    draws = [r[0] for r in mixing.scored(model, table(spark, sentences(23, 20), [None] * 20)).select("_draw").collect()]
    assert len(set(draws)) == 20


def brute_viterbi(channel, span):
    """The cheapest way to read a span, over all ways."""
    t, edge = toxicity, toxicity.EDGE
    masks = {i for m in t.MASKS.finditer(span) for i in range(*m.span())}

    def ways(at, state, before):
        if at == len(span):
            yield (0.0 if state == edge * 2 else channel.cost(state, edge)), ""
            return
        char = span[at]
        closed = 0.0 if state == edge * 2 else channel.cost(state, edge)
        steps = []
        if char in t.SIGNS:
            for letter in t.SIGNS[char]:
                steps.append((state[1] + letter, t.SIGN + channel.cost(state, letter), letter))
                if char == before and state[1] == letter:
                    steps.append((state, t.REPEAT, ""))
            steps.append((edge * 2, (t.REPEAT if char == before and state == edge * 2 else t.SELF) + closed, char))
        elif char.isalpha():
            steps.append((state[1] + char, channel.cost(state, char), char))
            if char == before and state[1] == char:
                steps.append((state, t.REPEAT, ""))
        else:
            if at in masks:
                steps += [(state[1] + x, t.MASK + channel.cost(state, x), x) for x in channel.follow.get(state, "")]
            steps += [(state, t.GAP, ""), (edge * 2, t.GAP + closed, char)]
        for state2, cost, text in steps:
            for rest, tail in ways(at + 1, state2, char):
                yield cost + rest, text + tail

    return min(ways(0, edge * 2, ""))


def test_viterbi_equals_brute_force():
    channel = toxicity.Channel(dict(toxicity.trigrams({w: 50 + 9 * i for i, w in enumerate(["idiot", "shit", "ass", "fool", "toad", "sit", "all"])})))
    rng = random.Random(9)
    for span in ["1d1ot", "sh*t", "a$$", "f00l", "s.h.i.t", "tooooad", "a**", "5 1 7", "!!!"] + ["".join(rng.choices("aist15$!*. o", k=rng.randint(1, 6))) for _ in range(150)]:
        cost, _ = brute_viterbi(channel, span)
        restored = channel._decode(span)
        ways = {text for c, text in [brute_viterbi(channel, span)] if abs(c - cost) < 1e-9}
        assert restored in ways or abs(_cost_of(channel, span, restored) - cost) < 1e-9, span


def _cost_of(channel, span, text):
    """The least cost among ways that end in a text."""
    kept = toxicity.EDGE
    best = math.inf
    stack = [(0, kept * 2, "", 0.0, "")]
    masks = {i for m in toxicity.MASKS.finditer(span) for i in range(*m.span())}
    while stack:
        at, state, before, cost, out = stack.pop()
        if not text.startswith(out) or cost >= best:
            continue
        closed = 0.0 if state == kept * 2 else channel.cost(state, kept)
        if at == len(span):
            best = min(best, cost + closed) if out == text else best
            continue
        char = span[at]
        letters = toxicity.SIGNS.get(char, "") if char in toxicity.SIGNS else char if char.isalpha() else channel.follow.get(state, "") if at in masks else ""
        fee = toxicity.SIGN if char in toxicity.SIGNS else 0.0 if char.isalpha() else toxicity.MASK
        for letter in letters:
            stack.append((at + 1, state[1] + letter, char, cost + fee + channel.cost(state, letter), out + letter))
        if (char in toxicity.SIGNS or char.isalpha()) and char == before and state[1] in (toxicity.SIGNS.get(char, "") or char):
            stack.append((at + 1, state, char, cost + toxicity.REPEAT, out))
        if char in toxicity.SIGNS:
            stack.append((at + 1, kept * 2, char, cost + (toxicity.REPEAT if char == before and state == kept * 2 else toxicity.SELF) + closed, out + char))
        elif not char.isalpha():
            stack += [(at + 1, state, char, cost + toxicity.GAP, out), (at + 1, kept * 2, char, cost + toxicity.GAP + closed, out + char)]
    return best


def test_masked_letters_are_restored():
    words = ["fuck", "shit", "bitch", "asshole", "good", "fast", "nobody"]
    channel = toxicity.Channel(dict(toxicity.trigrams(dict.fromkeys(words, 1000))))
    for altered, word in {"f*ck": "fuck", "f**k": "fuck", "sh*t": "shit", "b***h": "bitch", "a**hole": "asshole", "f*" + "*" * 3000 + "k": "fk"}.items():
        assert channel.restore(altered) == word, altered


def test_toxicity_of_edge_texts_and_repeated_rows(spark):
    texts = [f"villain {x}" if i % 3 == 0 else x for i, x in enumerate(sentences(24, 90, 20))]
    model = toxicity.fit(table(spark, texts), labelled(spark, [i % 3 == 0 for i in range(90)], "toxic"))
    odd = EDGES + [" ".join(sentences(25, 4000, 50)) + " v1llain", "villain"] * 2
    got = toxicity.score(table(spark, odd, [None] * 3 + [7] * (len(odd) - 3)), model).collect()
    by_text = {}
    for r, x in zip(sorted(got, key=lambda r: r.score), sorted(model.ready().score(x or "") for x in odd)):
        assert abs(r.score - x) < 1e-12 and r.predicted == int(x >= 0.5)
        by_text.setdefault(x, r.score)
    assert len(got) == len(odd)
    # A score by hand: the sum of the weights of the words and beginnings that the restored text holds.
    words = set(re.findall(r"[a-z]{2,}", "some v1llain here".replace("1", "i")))
    hand = model.bias + sum(model.weights.get(f, 0) for f in {f for w in words for f in toxicity.features_of(w)})
    assert abs(model.ready().score("some v1llain here") - 1 / (1 + math.exp(-hand))) < 1e-9


def test_quality_of_edge_texts(spark):
    texts = [x.upper() if i % 2 else x for i, x in enumerate(sentences(26, 200, 30))]
    model = quality.fit(table(spark, texts), labelled(spark, [i % 2 == 0 for i in range(200)], "quality"))
    odd = EDGES + ["word " * 200_000, "!" * 100_000] * 2
    got = quality.score(table(spark, odd, [None] * 3 + [7] * (len(odd) - 3)), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    vectors, net = model
    hand = []
    for x in odd:
        b = [int(v) for v in quality.bucket_rows([x or ""])[0]]
        row = np.zeros(quality.DIMS + 4)
        if b:
            row[: quality.DIMS] = np.mean([vectors[v] for v in b[:5000]] if len(set(b)) == 1 else [vectors[v] for v in b], axis=0)
            row[quality.DIMS] = np.linalg.norm(row[: quality.DIMS])
            row[quality.DIMS + 1], row[quality.DIMS + 2] = (sum(b[i] == b[i - k] for i in range(k, len(b))) / len(b) for k in (1, 2))
        row[-1] = np.log1p(len(b))
        hidden = np.tanh((row - net.mean) / net.scale @ net.w1 + net.b1)
        hand.append(1 / (1 + np.exp(-(hidden @ net.w2 + net.b2) / net.temperature)))
    assert np.allclose(sorted(r.score for r in got), sorted(hand), atol=2e-3)


def test_word_vectors_equal_brute_force(spark):
    texts = sentences(27, 12, 15) + EDGES
    sums = np.zeros((quality.BUCKETS, quality.DIMS))
    for x in texts:
        b = quality.bucket_rows([x or ""])[0].tolist()
        for i in range(len(b) - 1):
            for word, other in ((b[i], b[i + 1]), (b[i + 1], b[i])):
                for place, sign in zip(quality.PLACES[other], quality.PLUS[other]):
                    sums[word, place] += sign
    want = quality.INDEX + sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(table(spark, texts)), want, atol=1e-6)


def test_shard_folders(spark):
    docs = table(spark, sentences(14, 40, 20))
    path = scratch_path(spark, "shards")
    name = sharding.write_shards(docs, path, 2000)
    assert name == "shard_"
    back = spark.read.parquet(path)
    folders = {r[0] for r in sharding.assign(docs, 2000).select("shard").distinct().collect()}
    assert back.count() == 40 and len(folders) > 1
    assert {r[0] for r in back.select(name).distinct().collect()} == {"h" + x for x in folders}


def test_shards_below_the_top_of_the_directory(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOP_BITS", 2)
    test_sharding_splits_only_what_is_too_large(spark)
    test_sharding_of_one_hash(spark)


def test_shard_edges_are_counted_in_two_steps(spark):
    for edges in ([], [5], [1, 3, 4, 9, 12, 13, 20], list(range(0, 700, 7))):
        rows = spark.range(-3, 720).selectExpr("id", "id as x").union(spark.sql("select null, null")).select("id", binary_ids._number(F.col("x"), edges).alias("n"))
        assert all(r.n == sum(e <= r.id for e in edges if r.id is not None) for r in rows.collect())


def test_shards_of_a_hot_key_keep_the_limit(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS_A_BLOCK", 2)
    texts = [x[: 90 + i] for i, x in enumerate(sentences(15, 60, 60))] + ["y" * 1500, None] + sentences(16, 20, 10)
    ids = [9] * 40 + [None] * 22 + list(range(100, 120))
    docs = table(spark, texts, ids)
    path = scratch_path(spark, "hot")
    name = sharding.write_shards(docs, path, 1000)
    back = spark.read.parquet(path).selectExpr("doc_id", "text", "input_file_name() as file").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(zip(ids, texts))
    folders = {}
    for r in back:
        folders.setdefault(r.file.split(f"/{name}=")[1].split("/")[0], []).append(len((r.text or "").encode()))
    assert all(sum(x) <= 1000 or len(x) == 1 for x in folders.values()), folders


def test_word_hashes_follow_words_whatever_the_stretches(monkeypatch):
    text = " ".join(sentences(28, 1, 400)) + " ß_9 中文 été " + "y" * 700 + "\n\n;x"
    whole = [np.concatenate(x) for x in zip(*near_dedup._word_hashes(text))]
    spans = [(m.start(), m.group()) for m in re.finditer(r"\w+", text)]
    assert whole[0].tolist() == [a for a, _ in spans]
    of = {}
    for (_, word), h in zip(spans, whole[1].tolist()):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)
    monkeypatch.setattr(near_dedup, "CHARACTERS", 7)
    parts = [np.concatenate(x) for x in zip(*near_dedup._word_hashes(text))]
    assert all((a == b).all() for a, b in zip(whole, parts))
