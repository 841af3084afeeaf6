"""Near-duplicates and repeated passages against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import minhash, substring
from ledgerloom.llm.common import connected_components, shingle_hashes, word_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in "ka lo mi nu pe ra so tu vi wo".split() for b in "ba de fi go hu ja ke li mo nu".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, n):
    words = t.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def weights(t):
    w = (t or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def jaccard(x, y):
    """Probability Jaccard, written out."""
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[k] / x[d], y[k] / y[d]) for k in keys) for d in x if d in y)


def components(texts):
    bags = [weights(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and label[i] != label[j] and jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_clusters_are_brute_force(spark):
    rng = random.Random(1)
    texts = [text(rng, rng.randint(3, 120)) for _ in range(60)]
    texts += [edited(rng, rng.choice(texts[:40]), rng.randint(0, 4)) for _ in range(60)]
    source = text(rng, 150)
    texts += [source, *(edited(rng, source, 2) for _ in range(40)), source.upper(), "  ".join(source.split())]  # a large group of near copies
    texts += [None, "", " \n ", "one two", "one two", "x " * 300, "x " * 400, "y " * 20_000]
    got = {r["doc_id"]: (r["class_id"], r["cluster_id"]) for r in minhash.clusters(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i][1] for i in range(len(texts))] == components(texts)
    assert got[120][0] == got[161][0] == got[162][0] == 120
    kept = {r["doc_id"] for r in minhash.keep_one(frame(spark, texts)).collect()}
    assert kept == {i for i, c in enumerate(components(texts)) if i == c}


def test_pairs_of_a_large_group_that_share_a_band_are_linked(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)  # so that groups of this size are large ones
    monkeypatch.setattr(minhash, "BLOCK", 20_000)  # so that they take several blocks
    rng = random.Random(11)
    base = text(rng, 200)
    texts = []
    for _ in range(200):
        texts.append(edited(rng, base, 7))
        texts.append(edited(rng, texts[-1], 4))
    df = frame(spark, texts)
    bands = {r["doc_id"]: set(enumerate(r["bands"])) for r in minhash._classes(df.select("doc_id", "text"), minhash.BANDS * minhash.BAND_ROWS).collect()}
    h, c, at = minhash.weighted_shingles(pa.array(texts))
    bags = [(h[at[i] : at[i + 1]], c[at[i] : at[i + 1]]) for i in range(len(texts))]
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if bands[i] & bands[j] and minhash.probability_jaccard(bags[i], bags[j]) >= 0.8]
    cluster = {r["doc_id"]: r["cluster_id"] for r in minhash.clusters(df).collect()}
    assert len(alike) >= 50 and not [p for p in alike if cluster[p[0]] != cluster[p[1]]]


def test_near_dedup_of_odd_tables(spark):
    assert minhash.clusters(frame(spark, [])).count() == 0 and minhash.keep_one(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", 1), (None, "a b c d e f", 2), (3, None, 3)], "doc_id bigint, text string, cluster_id int")
    assert sorted(r["cluster_id"] for r in minhash.keep_one(df).collect()) == [1, 2, 3]


def test_near_dedup_of_repeated_ids(spark):
    rng = random.Random(12)
    a, b, c = (text(rng, 80) for _ in range(3))
    rows = [(1, a, 0), (2, a.upper(), 1), (2, b, 2), (3, c, 3), (3, c, 4), (4, edited(rng, c, 1), 5), (5, edited(rng, b, 1), 6), (None, a, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node int")
    assert sorted(r["node"] for r in minhash.keep_one(df).collect()) == [0, 2, 3, 4, 7]
    got = sorted((r["doc_id"], r["class_id"], r["cluster_id"]) for r in minhash.clusters(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 3, 3), (3, 3, 3), (4, 4, 3), (5, 5, 2)]


def test_similarities_of_blocks_bound_the_exact_ones(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rng = random.Random(13)
    base = text(rng, 60)
    sides = [[edited(rng, base, rng.randint(0, 9)) + " ba ba ba ba ba" * rng.choice([0, 0, 1, 2]) for _ in range(20)] + ["", text(rng, 9)] for _ in range(2)]
    x, y = (minhash.weighted_shingles(pa.array(s)) for s in sides)
    bound, exact = minhash.alike(x, y)
    for i, p in enumerate(sides[0]):
        for j, q in enumerate(sides[1]):
            true = jaccard(weights(p) or {}, weights(q) or {})
            assert bound[i, j] >= true - 1e-9 and (not exact[i, j] or bound[i, j] == pytest.approx(true))
    assert exact.any() and not exact.all()


@pytest.mark.parametrize("seed", range(3))
def test_signatures_estimate_probability_jaccard(seed):
    rng = random.Random(seed)
    a = text(rng, 200)
    b = edited(rng, a, 8) + " " + " ".join(["again and again and again"] * 5)
    column = pa.array([a, b, ""])
    signature = minhash.probminhash(*minhash.weighted_shingles(column), 4096)
    true = jaccard(weights(a), weights(b))
    assert (signature[0] == signature[1]).mean() == pytest.approx(true, abs=0.04)
    h, c, at = minhash.weighted_shingles(column)
    assert minhash.probability_jaccard((h[at[0] : at[1]], c[at[0] : at[1]]), (h[at[1] : at[2]], c[at[1] : at[2]])) == pytest.approx(true)
    assert (signature[2] == 0).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def windows_by_hand(values, least):
    out, todo = [], [(0, len(values))]
    while todo:
        a, b = todo.pop()
        if b - a >= least:
            c = a + int(np.argmin(values[a:b]))
            out.append((a, c, b - 1))
            todo += [(a, c), (c + 1, b)]
    return sorted(out)


def test_compact_windows():
    rng = np.random.default_rng(3)
    sizes = [0, 3, 200, 1, 57]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 1 << 63, begins[-1]).astype(np.uint64)
    got = sorted(zip(*(x.tolist() for x in substring.compact_windows(hashes, begins, 10))))
    want = []
    for a, b in zip(begins[:-1], begins[1:]):
        want += [(l + a, c + a, r + a) for l, c, r in windows_by_hand(hashes[a:b] >> np.uint64(24), 10)]
    assert got == sorted(want)
    same = substring.compact_windows(np.full(5000, 7, np.uint64), np.array([0, 5000]), 46)  # equal tokens do not make it deep
    assert len(same[0]) <= 2 * 5000 / 46 + 1


def spans(spark, texts):
    return [tuple(r) for r in substring.passages(frame(spark, texts)).collect()]


def test_passages(spark):
    rng = random.Random(4)
    passage = text(rng, 60)
    line = text(rng, 12)  # common, and too short to count
    texts = [" ".join([text(rng, rng.randint(0, 80)), line, passage if i % 3 == 0 else text(rng, 60), line, text(rng, rng.randint(0, 80))]) for i in range(60)]
    near = edited(rng, text(rng, 200), 0)
    texts += [near, edited(rng, near, 2), text(rng, 49), None, "", "x " * 3000, texts[1], passage.upper()]
    texts.append(texts[-4].replace("x", "z"))
    got = spans(spark, texts)
    covered = {b for b, *_ in got}
    assert {i for i in range(3, 60, 3)} <= covered and {61, 66, 67} <= covered
    assert not covered & {i for i in range(60) if i % 3} and not covered & {0, 60, 62, 63, 64, 65, 68}
    for b, s, e, a, rs, re_, j in got:
        x, y = (t.lower().split() for t in (texts[a], texts[b]))
        p, q = ({tuple(w[k : k + 5]) for k in range(i, k_ - 4)} for w, i, k_ in ((x, rs, re_), (y, s, e)))
        assert a < b and e - s >= 50 and j >= 0.8 and len(p & q) / len(p | q) >= 0.75


@pytest.mark.parametrize("n", [10, 40, 200])
def test_passages_of_near_copies(spark, n):
    rng = random.Random(n)
    passage = text(rng, 60).split()
    texts = [" ".join([text(rng, rng.randint(0, 40)), *(w if rng.random() > 0.03 else rng.choice(WORDS) for w in passage), text(rng, rng.randint(0, 40))]) for _ in range(n)]
    tokens = [shingle_hashes(*word_hashes(pa.array([t]))[:2], 5)[0] for t in texts]
    wanted = {b for b in range(n) if any(substring.align(tokens[a], tokens[b], np.zeros(0, np.int64)) for a in range(b))}
    covered = {b for b, *_ in spans(spark, texts)}
    assert len(wanted) >= n // 5 and len(wanted & covered) >= 0.95 * len(wanted) and not covered - wanted


@pytest.mark.parametrize("near,farthest", [(1, 1), (32, 1 << 14)])
def test_every_open_window_meets_its_whole_group(spark, monkeypatch, near, farthest):
    """One passage's variants, each of which only one other document has, far away in every order: none is left out."""
    monkeypatch.setattr(substring, "NEAR", near)
    monkeypatch.setattr(substring, "FARTHEST", farthest)
    monkeypatch.setattr(substring, "BLOCK", 16)
    rng = np.random.default_rng(6)
    n, least = 150, substring.LEAST_BITS
    bits = rng.random((n, substring.BITS)) < 0.06
    partner = [(int(i), int(i) + 75) for i in rng.permutation(75)]
    for a, b in partner:
        bits[b] = np.where(rng.random(substring.BITS) < 0.1, bits[b], bits[a])
    packed = np.packbits(bits, axis=1)
    rows = [(7, int(s), i, 0, 5, True, n, packed[i].tobytes()) for i, s in enumerate(rng.permutation(n))]
    windows = spark.createDataFrame(rows, substring._schema(substring.AROUND_C))
    none = spark.createDataFrame([], "doc_id bigint, v int, spans array<struct<start_word:bigint,end_word:bigint>>")
    shared = (bits[:, None] & bits[None]).sum(2)
    wanted = {(a, b) for a in range(n) for b in range(a + 1, n) if shared[a, b] >= least}
    assert set(partner) <= wanted
    before = {(r["a"], r["b"]) for r in substring.alike_around(windows).collect()}
    assert before < wanted  # what neighbours and doubled distances leave
    assert {(r["a"], r["b"]) for r in substring.all_alike(windows, none, False).collect()} == wanted
    assert {r["b"] for r in substring.all_alike(windows, none, True).collect()} == {b for _, b in wanted}


def test_passages_of_near_copies_do_not_hang_on_their_order(spark, monkeypatch):
    monkeypatch.setattr(substring, "NEAR", 1)
    monkeypatch.setattr(substring, "FARTHEST", 1)
    monkeypatch.setattr(substring, "BLOCK", 16)
    rng = random.Random(200)
    passage = text(rng, 60).split()
    texts = [" ".join([text(rng, rng.randint(0, 40)), *(w if rng.random() > 0.03 else rng.choice(WORDS) for w in passage), text(rng, rng.randint(0, 40))]) for _ in range(120)]
    tokens = [shingle_hashes(*word_hashes(pa.array([t]))[:2], 5)[0] for t in texts]
    wanted = {b for b in range(120) if any(substring.align(tokens[a], tokens[b], np.zeros(0, np.int64)) for a in range(b))}
    covered = {b for b, *_ in spans(spark, texts)}
    assert len(wanted) > 60 and len(wanted & covered) >= 0.99 * len(wanted) and not covered - wanted


def test_rows_follow_the_documents_not_their_pairs(spark):
    """Near copies of a passage: a few rows a document, however many copies there are, and every word told that any pair tells."""
    rng = random.Random(21)
    passage = text(rng, 70).split()
    texts = [" ".join([text(rng, 20), *(w if rng.random() > 0.02 else rng.choice(WORDS) for w in passage), text(rng, 20)]) for _ in range(90)]
    got = spans(spark, texts)
    tokens = [shingle_hashes(*word_hashes(pa.array([t]))[:2], 5)[0] for t in texts]
    wanted = {b for b in range(90) if any(substring.align(tokens[a], tokens[b], np.zeros(0, np.int64)) for a in range(b))}
    assert len(wanted - {b for b, *_ in got}) <= 0.02 * len(wanted) and len(got) <= 2 * len(wanted)
    inside = [(p, q) for p in got for q in got if p is not q and p[0] == q[0] and p[1] <= q[1] and q[2] <= p[2]]
    assert not inside


def test_pairs_left_out_hold_no_passage():
    rng = np.random.default_rng(22)
    reach = substring.PASSAGE - substring.WIDTH + substring.GAP + 1
    for _ in range(300):
        x = rng.integers(1, 1 << 62, 400).astype(np.uint64)
        y, i = [], 0
        while i < 400:  # edits, some with words added or left out
            n = int(rng.integers(1, 60))
            y += [*x[i : i + n], *rng.integers(1, 1 << 62, rng.integers(0, 9)).astype(np.uint64)]
            i += n + int(rng.integers(0, 9))
        y = np.array(y, np.uint64)
        cut = lambda t, c: np.pad(t, reach)[c : c + 2 * reach + 1] % np.uint64(0xFFFF)
        found = substring.align(x, y, np.zeros(0, np.int64))
        left = rng.random(len(y) + 4) < 0.02
        if any(left[p[0] : p[1]].any() for p in found):
            assert substring.may_cover(np.sort(x), y, left)
        both = [(int(np.flatnonzero(x == v)[0]), c) for c, v in enumerate(y) if v in x][::7]
        ok = substring.can_hold(np.array([cut(x, c).astype(np.uint16) for c, _ in both]), np.array([cut(y, c).astype(np.uint16) for _, c in both]), np.arange(len(both)), np.arange(len(both)), substring.PASSAGE, substring.SIMILARITY)
        for (cx, cy), good in zip(both, ok):
            assert good or not any(p[0] <= cy and cy + 5 <= p[1] and p[2] <= cx and cx + 5 <= p[3] for p in found)
    far = rng.integers(1, 1 << 16, (2, 2 * reach + 1)).astype(np.uint16)
    far[1, reach - 3 : reach + 36] = far[0, reach - 3 : reach + 36]  # a line too short for a passage
    assert not substring.can_hold(far[:1], far[1:], np.zeros(1, np.int64), np.zeros(1, np.int64), substring.PASSAGE, substring.SIMILARITY)[0]
    assert not substring.may_cover(np.arange(100, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64), np.ones(104, bool))


def near_copies(rng, n, length, edits):
    """Token rows of near copies of a text: some words replaced, put in or taken out; now and then a part comes twice."""
    rows = []
    base = rng.permutation(3000)[:length]
    for _ in range(n):
        d = base.copy()
        for _ in range(int(rng.integers(0, edits))):
            at, kind = int(rng.integers(0, len(d))), int(rng.integers(0, 3))
            if kind == 0:
                d[at : at + 5] = rng.integers(3000, 99999, len(d[at : at + 5]))
            else:
                d = np.insert(d, at, rng.integers(3000, 99999, int(rng.integers(1, 9)))) if kind == 1 else np.delete(d, slice(at, at + int(rng.integers(1, 15))))
        rows.append((np.concatenate([d[:50], d[100:180], d[20:60], d[180:]]) if rng.random() < 0.2 else d).astype(np.uint64))
    return rows


def test_many_rows_are_aligned_as_one_by_one():
    rng = np.random.default_rng(12)
    places, compared = np.full(1 << 14, -1, np.int32), 0
    for _ in range(8):
        rows = near_copies(rng, 12, 400, 25)
        ends = np.cumsum([len(r) for r in rows])
        for x in rows:
            of, runs, left_out = substring.align_many(x, np.concatenate(rows), ends, places)
            assert (places == -1).all()
            got = {}
            for j, *p in zip(*substring._chains(of, runs, substring.PASSAGE, substring.SIMILARITY)):
                got.setdefault(int(j), []).append(tuple(float(k) for k in p))
            for j in sorted(set(range(len(rows))) - set(left_out.tolist())):
                compared += 1
                assert sorted(got.get(j, [])) == sorted(tuple(float(k) for k in p) for p in substring.align(x, rows[j], np.zeros(0, np.int64)))
    assert compared > 400


def test_near_copies_meet_in_blocks_without_a_row_a_pair(spark, monkeypatch):
    monkeypatch.setattr(substring, "DOCUMENTS", 8)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in row.tolist()) for row in near_copies(rng, 40, 150, 12)]
    docs = substring._texts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    tokens = [shingle_hashes(*word_hashes(pa.array([t]))[:2], 5)[0] for t in texts]
    wanted = set()
    for b in range(40):
        for a in range(b):
            wanted |= {(b, w) for p in substring.align(tokens[a], tokens[b], np.zeros(0, np.int64)) for w in range(p[0], p[1])}
    found = substring.windows(docs).select("hash", "doc_id", "v", "c").withColumn("open", F.lit(True))
    none = spark.createDataFrame([], "doc_id bigint, v int, spans array<struct<start_word: bigint, end_word: bigint>>")
    got = substring._aligned_in_groups(found, docs, none, substring.PASSAGE, substring.SIMILARITY).collect()
    told = {(r["doc_id"], w) for r in got for w in range(r["start_word"], r["end_word"])}
    assert len(wanted) > 2000 and len(told & wanted) >= 0.99 * len(wanted) and len(told - wanted) <= 0.02 * len(wanted)
    assert len(got) < 39 * 40 / 2 / 2


def test_windows_of_a_group_are_met_in_rows_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(substring, "NEAR", 8)
    n = 200
    bits = np.tile(np.packbits(np.arange(substring.BITS) % 16 == 0), (n, 1))
    rows = [(7, 0, d, 0, 0, True, n, bits[d].tobytes()) for d in range(n)]
    windows = spark.createDataFrame(rows, substring._schema(substring.AROUND_C))
    none = spark.createDataFrame([], "doc_id bigint, v int, spans array<struct<start_word: bigint, end_word: bigint>>")
    met = substring._meet_all(windows, none, True, substring.PASSAGE, substring.SIMILARITY).collect()
    assert {r["b"] for r in met} == set(range(n)) and len(met) <= 2 * n


def test_ranges_of_windows():
    rng = np.random.default_rng(1)
    for _ in range(50):
        rows = [rng.integers(0, 4, 60) for _ in range(5)]
        borders = sorted(map(tuple, rng.integers(0, 4, (9, 5)).tolist()))
        got = substring._ranges(rows, [np.array(k) for k in zip(*borders)])
        assert got.tolist() == [sum(b <= r for b in borders) for r in zip(*(k.tolist() for k in rows))]


def test_remove_passages(spark):
    rng = random.Random(5)
    passage = "\n".join(text(rng, 20) for _ in range(3))
    rows = [(i, f"before é{i}\n{passage}\n{i}  after", i) for i in range(8)] + [(50, passage, 50), (51, None, 51), (None, passage, 52)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = {r["spans"]: r["text"] for r in substring.remove_passages(df).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"before é{i}\n{i}  after" for i in range(1, 8))
    assert 50 not in got and got[51] is None and got[52] == passage
    assert substring.remove_passages(df.limit(0)).count() == 0


def test_passages_of_repeated_ids(spark):
    rng = random.Random(15)
    p, q = text(rng, 60), text(rng, 60)
    rows = [(1, p + " end", 0), (1, text(rng, 70) + " " + q, 1), (1, "short", 2), (2, text(rng, 20) + " " + p, 3), (3, q, 4), (3, q, 5), (4, text(rng, 9), 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, v int")
    got = {r["v"]: r["text"] for r in substring.remove_passages(df).collect()}
    assert set(got) == {0, 1, 2, 3, 6} and all(got[k] == rows[k][1] for k in (0, 1, 2, 6)) and got[3].split() == rows[3][1].split()[:20]


def test_windows_meet_over_the_borders_of_ranges(spark):
    rng = random.Random(16)
    passage = text(rng, 70)
    texts = [" ".join([text(rng, 20), passage, text(rng, 20)]) for _ in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {b for b, *_ in spans(spark, texts)} == set(range(1, 60))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_places_of_very_long_texts():
    hashes = np.arange(1 << 8, dtype=np.uint64)[::-1].repeat(1 << 17)  # more tokens than 24 bits count
    l, c, r = substring.compact_windows(hashes << np.uint64(40), np.array([0, len(hashes)]), len(hashes) - 5)
    assert l[0] == 0 and r[0] == len(hashes) - 1 and c[0] >= len(hashes) - (1 << 17)


def test_enough_hashes_of_many_places():
    n = 700
    at = np.arange(n) * 100
    assert not substring.enough_hashes(np.arange(n), at, at + 9, at, at + 9)
    assert not substring.enough_hashes(np.zeros(n), at, at + 500, at, at + 500)
    assert substring.enough_hashes(np.arange(n), np.append(at[:-1], at[-2]), np.append(at[:-1], at[-2]) + 9, np.append(at[:-1], at[-2] + 5), np.append(at[:-1], at[-2]) + 9)


def test_word_and_shingle_hashes():
    column = pa.array(["a  bb\tccc", None, "", "w" * 200 + " x", "a bb ccc"])
    words, rows, starts, ends = word_hashes(column)
    assert rows.tolist() == [0, 3, 3, 3, 5, 8] and (words[:3] == words[5:]).all() and len(set(words.tolist())) == 5
    data = b"a  bb\tccc" + b"w" * 200 + b" xa bb ccc"
    assert [data[s:e] for s, e in zip(starts, ends)][:3] == [b"a", b"bb", b"ccc"]
    assert (word_hashes(column.slice(3))[0] == words[3:]).all()
    hashes, begins = shingle_hashes(words, rows, 2)
    assert begins.tolist() == [0, 2, 2, 2, 3, 5] and (hashes[:2] == hashes[3:]).all()
