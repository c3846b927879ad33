"""The registered queries and the pipeline, over a whole small folder."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lamella.llm import mixing, near_dedup, queries, toxicity
from lamella.llm.common import documents, labels, scratch_path, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    return dict(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_token_queries(spark, texts):
    byte, word = (Tokenizer.from_file(tokenizer_path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = {i: [*byte.encode(x, add_special_tokens=False).ids, 0] for i, x in texts.items()}
    histogram = Counter(len(x) - 1 for x in ids.values())
    assert {r.n_tokens: r.n_docs for r in queries.op1_token_counts(spark, SF).collect()} == histogram
    start, rows = 0, {r.doc_id: r for r in queries.op6_binary_ids(spark, SF).collect()}
    for i in sorted(ids):
        r = rows.pop(i)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])
    assert not rows
    packed, places = queries.op2_best_fit_packing(spark, SF).collect(), {}
    for r in packed:
        whole = [*word.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        part = whole[r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.length == min(4096, len(whole) - r.start) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():
        ends = [0, *[a + n for a, n in sorted(some)]]
        assert [a for a, _ in sorted(some)] == ends[:-1] and ends[-1] <= 4096
    assert len({(r.doc_id, r.piece) for r in packed}) == len(packed) and {r.doc_id for r in packed} == set(texts)
    assert len(places) <= 1.02 * (sum(r.length for r in packed) / 4096) + 2


def test_media_query(spark, texts):
    rows = queries.op5_media_chunks(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    for r in rows:
        raw = texts[r.doc_id].encode()
        data = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))


@pytest.mark.parametrize("name,label", [("op7_toxicity", "toxic"), ("op8_quality", "quality")])
def test_scores(spark, texts, name, label):
    rows = queries.QUERIES[name](spark, SF).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{SF}/labels.parquet'").fetchall())
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.3)) for r in rows)
    known = [(r.predicted, truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert sum(a == b for a, b in known) >= 0.9 * len(known)


def test_mixing_and_near_queries(spark, texts):
    rows = queries.op3_source_mixing(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts)) and min(r.rate for r in rows) >= 0
    total = sum(r.tokens for r in rows)
    missed = max(abs(sum(r.tokens * r.rate * r[f"p_{domain}"] for r in rows) - share * total) for domain, share in queries.WEIGHTS.items())
    assert {r.converged for r in rows} == {missed <= mixing.TOLERANCE * total * 1.0001}
    groups = queries.op4_near_dedup(spark, SF).collect()
    assert Counter(r.doc_id for r in groups) == Counter(list(texts))
    assert all(r.kept == (r.doc_id == r.group_id) for r in groups)


def test_pipeline_stage_by_stage(spark, texts):
    """Each stage against plain Python over what the stage before it kept."""
    assert [x for x, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs, kept = documents(spark, SF), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    model = toxicity.fit(documents(spark, SF), labels(spark, SF)).ready()
    clean = {i for i, x in texts.items() if model.score(x) < 0.5}
    assert {r.doc_id for r in kept["toxicity"]} == clean and len(clean) < len(texts)
    last = {}
    for i in clean:
        last[texts[i]] = max(i, last.get(texts[i], i))
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(last.values())
    left = sorted(last.values())
    bags = {i: dict(zip(*(x.tolist() for x in near_dedup.shingles([texts[i]])[1:]))) for i in left}
    idf = near_dedup.inverse_frequencies(near_dedup.document_frequencies(spark.createDataFrame([(i, texts[i]) for i in left], "doc_id long, text string")), len(left))
    parent = {i: i for i in left}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(left):
        for j in left[:n]:
            common = bags[i].keys() & bags[j].keys()
            weigh = lambda bag, keys: sum(bag[k] * float(idf[k >> 32]) for k in keys)
            shared = sum(min(bags[i][k], bags[j][k]) * float(idf[k >> 32]) for k in common)
            if shared and shared >= 0.8 * (weigh(bags[i], bags[i]) + weigh(bags[j], bags[j]) - shared):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted({root(i) for i in left})
    copies = Counter(r.doc_id for r in kept["mixing"])
    assert set(copies) == {r.doc_id for r in kept["near_dedup"]} and min(copies.values()) >= 1
    pieces = Counter(r.doc_id for r in kept["packing"] if r.piece == 0)
    assert pieces == copies
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == len(kept["packing"]) and mixing.STEPS >= 20
