"""Recall and accuracy on the test tables: near-duplicates, passages, neighbours and languages against brute force."""

import os

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, langid, minhash, substring
from ledgerloom.llm.common import shingle_hashes, word_hashes

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{DATA}/documents.parquet")
    return t["doc_id"].to_pylist(), pc.utf8_lower(pc.fill_null(t["text"], "")).combine_chunks()


def test_near_duplicates(spark, docs):
    ids, texts = docs
    h, c, at = minhash.weighted_shingles(texts)
    bags = [(h[at[i] : at[i + 1]], c[at[i] : at[i + 1]]) for i in range(len(ids))]
    pairs = []
    for start in range(0, len(ids), 250):
        part = h[at[start] : at[min(start + 250, len(ids))]], c[at[start] : at[min(start + 250, len(ids))]], at[start : start + 251] - at[start]
        bound, _ = minhash.alike(part, (h, c, at))
        i, j = np.nonzero(bound >= 0.8)
        pairs += [(a + start, b) for a, b in zip(i.tolist(), j.tolist()) if a + start < b and minhash.probability_jaccard(bags[a + start], bags[b]) >= 0.8]
    got = {r["doc_id"]: r["cluster_id"] for r in minhash.clusters(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    hit = sum(got[ids[a]] == got[ids[b]] for a, b in pairs)
    print(f"near-duplicates: {hit} of {len(pairs)} pairs")
    assert len(pairs) > 50 and hit >= 0.99 * len(pairs)


def test_exact_passages(spark, docs):
    """Words in a run of 50 or more that an earlier document has, word for word."""
    ids, texts = docs
    tokens, begins = shingle_hashes(*word_hashes(texts)[:2], 50)
    whole = np.diff(word_hashes(texts)[1]) >= 50
    first, wanted = {}, {}
    for d in range(len(ids)):
        if whole[d]:
            for k, t in enumerate(tokens[begins[d] : begins[d + 1]].tolist()):
                if first.setdefault(t, d) != d:
                    wanted.setdefault(ids[d], set()).update(range(k, k + 50))
    covered = {}
    for r in substring.passages(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    words, hit = sum(map(len, wanted.values())), sum(len(w & covered.get(d, set())) for d, w in wanted.items())
    print(f"exact passages: {hit} of {words} words in {len(wanted)} documents")
    assert words > 1000 and hit >= 0.99 * words


def test_neighbours(spark):
    t = pq.read_table(f"{DATA}/embeddings.parquet")
    ids, vectors = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_pylist()).astype(float)
    got = {}
    for r in ann.search(spark.read.parquet(f"{DATA}/embeddings.parquet")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for q in range(len(ids)):
        if ids[q] % 100 == 0:
            d = ((vectors - vectors[q]) ** 2).sum(1)
            best = [ids[i] for i in np.lexsort((ids, d)) if i != q][:10]
            hit, total = hit + len(got[ids[q]] & set(best)), total + 10
    print(f"neighbours: {hit} of {total}")
    assert total and hit >= 0.9 * total


def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs, P.path("piece_bpe_32k.model")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und' AND lang IS NOT NULL")
    right, total = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    print(f"languages: {right} of {total} held out")
    assert total > 100 and right >= 0.97 * total


def test_every_near_passage_of_a_small_table(spark):
    """All pairs of documents are aligned here; what the windows miss counts."""
    import random

    rng = random.Random(33)
    words = [f"w{i}" for i in range(4000)]
    pool = [[rng.choice(words) for _ in range(rng.randint(55, 90))] for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(words) for _ in range(rng.randint(0, 60))] + [w if rng.random() > 0.02 else rng.choice(words) for w in rng.choice(pool)]
        texts.append(" ".join(parts + [rng.choice(words) for _ in range(rng.randint(0, 60))]))
    tokens = [shingle_hashes(*word_hashes(pa.array([t]))[:2], 5)[0] for t in texts]
    wanted: dict[int, set] = {}
    for b in range(len(texts)):
        for a in range(b):
            for p in substring.align(tokens[a], tokens[b], np.zeros(0, np.int64)) if len(tokens[a]) and len(tokens[b]) else ():
                wanted.setdefault(b, set()).update(range(p[0], p[1]))
    covered: dict[int, set] = {}
    for r in substring.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    total, hit = sum(map(len, wanted.values())), sum(len(w & covered.get(d, set())) for d, w in wanted.items())
    print(f"near passages: {hit} of {total} words in {len(wanted)} documents")
    assert total > 3000 and hit >= 0.95 * total
