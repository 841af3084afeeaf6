"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

Shingles are runs of five words (lower case, cut at white space) weighted by how
often a document has them. ProbMinHash draws for each shingle the arrivals of a
Poisson process whose rate is its weight; each arrival goes to a random register,
and a register keeps the shingle that arrives first. Two registers agree with
the probability Jaccard similarity of the weighted shingles. Shingles take turns,
and one whose next arrival is later than all registers' first ones has no more
to say and stops early.

Equal word sequences form a class first, so copies are never compared. Classes
with a band of registers in common are candidates. In a bucket of up to ``SMALL``
classes all pairs are candidates. In a larger one every class first meets the
bucket's hub, the class that has most company over all bands: that links a text
and its near copies in as many comparisons as there are copies. Candidates whose
signatures leave a chance are verified on their whole texts by the exact
probability Jaccard, 0.8 or more.

Where a large bucket then still holds several components, its classes outside the
largest of them meet all its classes of other components, in blocks of bounded size: a task
takes two blocks of texts, finds all similarities between them by a product of
matrices, and returns a spanning forest of the links it found, so rows do not grow
with the square of a group. No pair that shares a band is left out. Linked
components become clusters.

Rows: null, empty and blank texts have no shingles and stand alone; a text of
fewer than five words is one shingle. Rows without ``doc_id`` are not in the
result of ``clusters`` and stay in ``keep_one``. A ``doc_id`` that stands on several texts gives
a row for each of its rows, and ``keep_one`` tells them apart by their texts. Ties go to the
smaller id. Extra columns are ignored by ``clusters`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import among, connected_components, fresh, materialize, mix64, shingle_hashes, text_slices, word_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 5
SLACK = 0.15  # an estimate from 120 registers is that much too low for one pair in some 30,000 at the threshold
SMALL = 8  # up to here all pairs of a bucket are verified one by one; both ways give the same links
BLOCK = 40_000  # words of a block of texts, a text counting as ``TEXT`` words more
TEXT = 150
COLUMNS = 8192  # shingles in one product of matrices
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles row by row, their counts, first of each row plus the end)."""
    words, rows, _, _ = word_hashes(column)
    hashes, begins = shingle_hashes(words, rows, width)
    n = len(begins) - 1
    of = np.repeat(np.arange(n, dtype=np.uint32), np.diff(begins))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(of[order].astype(np.uint16) if n < 65536 else of[order], kind="stable")]
    h, d = hashes[order], of[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(h)))
    return h[at], counts, np.searchsorted(d[at], np.arange(n + 1))


def probminhash(shingles: np.ndarray, counts: np.ndarray, begins: np.ndarray, registers: int) -> np.ndarray:
    """Signature of every row: the shingle of the first arrival at each register (0 for a row without shingles)."""
    n = len(begins) - 1
    best = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    row = np.repeat(np.arange(n), np.diff(begins))
    live = np.arange(len(shingles))
    arrival = np.zeros(len(shingles))
    turn = 0
    while len(live):
        with np.errstate(over="ignore"):
            draw = mix64(shingles[live] + np.uint64(turn + 1) * GOLDEN)
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / counts[live]
        time = arrival[live] + gap
        arrival[live] = time
        with np.errstate(over="ignore"):
            cell = row[live] * registers + (mix64(draw ^ GOLDEN) % np.uint64(registers)).astype(np.int64)
        better = time < best[cell]
        c, t, s = cell[better], time[better], shingles[live][better]
        np.minimum.at(best, c, t)
        won = best[c] == t
        winner[c[won]] = s[won]
        latest = best.reshape(n, registers).max(1)
        live = live[time < latest[row[live]]]
        turn += 1
    return winner.reshape(n, registers)


def probability_jaccard(x: dict[int, int] | tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over shared d of 1 / sum over d' of max(x_d' / x_d, y_d' / y_d), for sorted distinct shingles with counts."""
    (hx, cx), (hy, cy) = x, y
    shared, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    a, b = cx[ix].astype(np.float64), cy[iy].astype(np.float64)
    only_x, only_y = float(cx.sum() - a.sum()), float(cy.sum() - b.sum())
    ratio, where, times = np.unique(a / b, return_inverse=True, return_counts=True)
    total = 0.0
    for k, r in enumerate(ratio):
        # max(x', y' r) over all d', scaled by 1 / x_d for each d of this ratio
        whole = only_x + only_y * r + np.maximum(a, b * r).sum()
        total += a[where == k].sum() / whole
    return float(total)


def _node(text: str = "text") -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col(text))


def _classes(docs: DataFrame, registers: int) -> DataFrame:
    """doc_id, node, key (of the word sequence, null without words), n_words, bands (a hash for every band), signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            column = batch.column("text")
            words, rows, _, _ = word_hashes(column)
            index = np.arange(len(words), dtype=np.uint64) - np.repeat(rows[:-1], np.diff(rows)).astype(np.uint64)
            with np.errstate(over="ignore"):
                mixed = mix64(words + (index + np.uint64(1)) * GOLDEN)
            some = np.diff(rows) > 0
            keys = np.zeros(len(column), np.uint64)
            keys[some] = np.add.reduceat(mixed, rows[:-1][some]) if some.any() else 0
            signature = probminhash(*weighted_shingles(column), registers)
            bands = np.zeros((len(column), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(BAND_ROWS):
                    bands = mix64(bands * GOLDEN + signature[:, i::BAND_ROWS] + np.arange(BANDS, dtype=np.uint64))
            flat = pa.array(bands.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * BANDS), flat)
            short = np.ascontiguousarray((signature & np.uint64(0xFFFF)).astype(np.uint16))
            signatures = pa.array([row.tobytes() for row in short], pa.binary())
            arrays = [batch.column("doc_id"), batch.column("node"), pa.array(keys.view(np.int64), mask=~some), pa.array(np.diff(rows)), lists, signatures]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "node", "key", "n_words", "bands", "signature"])

    named = docs.select(F.col("doc_id").cast("bigint"), _node().alias("node"), F.lower("text").alias("text"))
    return named.mapInArrow(run, "doc_id bigint, node bigint, key bigint, n_words bigint, bands array<bigint>, signature binary")


def _likely(pairs: DataFrame, least: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose signatures do not rule them out: a text need not be fetched for the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= similarity - SLACK))

    signature = least.select("node", "signature")
    with_b = pairs.join(signature.withColumnRenamed("signature", "sig_b").withColumnRenamed("node", "b"), "b")
    both = with_b.join(signature.withColumnRenamed("signature", "sig_a").withColumnRenamed("node", "a"), "a")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose whole texts are similar enough. The text of b travels; a's meets it, split where one a has many pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, tuple] = {}
        for batch in text_slices(batches, "text_b", 2_000_000):
            ids = batch.column("a").to_pylist()
            new = [i for i, a in enumerate(ids) if a not in memo and ids.index(a) == i]
            if len(memo) > 64:
                memo = {a: memo[a] for a in set(ids) if a in memo}
                new = [i for i, a in enumerate(ids) if a not in memo and ids.index(a) == i]
            if new:
                h, c, at = weighted_shingles(batch.column("text_a").take(pa.array(new)))
                for k, i in enumerate(new):
                    memo[ids[i]] = h[at[k] : at[k + 1]], c[at[k] : at[k + 1]]
            h, c, at = weighted_shingles(batch.column("text_b"))
            good = pa.array([probability_jaccard(memo[a], (h[at[i] : at[i + 1]], c[at[i] : at[i + 1]])) >= similarity for i, a in enumerate(ids)])
            yield batch.select(["a", "b"]).filter(good)

    text = among(texts, "node", pairs.select("a").union(pairs.select("b")).distinct())
    with_b = pairs.join(text.withColumnRenamed("text", "text_b").withColumnRenamed("node", "b"), "b")
    both = with_b.join(text.withColumnRenamed("text", "text_a").withColumnRenamed("node", "a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def alike(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(an upper bound of the probability Jaccard of every x with every y, whether it is the value itself).

    Each side is (shingles, counts, first of each row plus the end). With r = x_d / y_d the value is at
    most the sum of max(x_d, y_d) over shared d by the sum of max(x_d, y_d) over all d; both
    follow from sums over shared shingles, which are products of matrices. Where all counts are 1 the bound is the value.
    """
    (hx, cx, bx), (hy, cy, by) = x, y
    n, m = len(bx) - 1, len(by) - 1
    shared = np.intersect1d(np.unique(hx), np.unique(hy), assume_unique=True)
    parts = []
    for h, c, b in ((hx, cx, bx), (hy, cy, by)):
        at = np.searchsorted(shared, h)
        kept = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == h) if len(shared) else np.zeros(len(h), bool)
        row = np.repeat(np.arange(len(b) - 1), np.diff(b))
        order = np.argsort(at[kept], kind="stable")
        total = np.add.reduceat(np.append(c, 0), np.minimum(b[:-1], len(c))) * (np.diff(b) > 0)
        unit = np.maximum.reduceat(np.append(c, 0), np.minimum(b[:-1], len(c))) <= 1
        parts.append((at[kept][order], row[kept][order], c[kept][order], total.astype(np.float64), unit))
    both, of_x, of_y = (np.zeros((n, m)) for _ in range(3))
    for start in range(0, len(shared), COLUMNS):
        ones, counts = [], []
        for (at, row, c, _, _), size in zip(parts, (n, m)):
            s = slice(*np.searchsorted(at, (start, start + COLUMNS)))
            one, count = np.zeros((size, min(COLUMNS, len(shared) - start)), np.float32), None
            one[row[s], at[s] - start] = 1
            if (c[s] > 1).any():
                count = one.copy()
                count[row[s], at[s] - start] = c[s]
            ones.append(one)
            counts.append(one if count is None else count)
        product = ones[0] @ ones[1].T
        both += product
        of_x += product if counts[0] is ones[0] else counts[0] @ ones[1].T
        of_y += product if counts[1] is ones[1] else ones[0] @ counts[1].T
    whole = parts[0][3][:, None] + parts[1][3] - np.minimum(of_x, of_y)
    return (of_x + of_y - both) / np.maximum(whole, 1), parts[0][4][:, None] & parts[1][4]


def _forest(seekers: pa.Table, others: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links between texts of two blocks that join different components, as few as give all the joins."""
    x, y = (weighted_shingles(t.column("text").combine_chunks()) for t in (seekers, others))
    bound, exact = alike(x, y)
    cx, cy = (t.column("component").to_numpy() for t in (seekers, others))
    i, j = np.nonzero((bound >= similarity) & (cx[:, None] != cy))
    order = np.argsort(-bound[i, j], kind="stable")
    nodes = [t.column("node").to_pylist() for t in (seekers, others)]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    out = []
    for k, l in zip(i[order].tolist(), j[order].tolist()):
        a, b = find(int(cx[k])), find(int(cy[l]))
        if a == b:
            continue
        if not exact[k, l]:
            p, q = ((s[0][s[2][r] : s[2][r + 1]], s[1][s[2][r] : s[2][r + 1]]) for s, r in ((x, k), (y, l)))
            if probability_jaccard(p, q) < similarity:
                continue
        root[max(a, b)] = min(a, b)
        out.append((nodes[0][k], nodes[1][l]))
    return out


def _meet(large: DataFrame, component: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join components within the buckets of ``large`` (bucket, node, n_words)."""
    labelled = large.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled)
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(F.col("n_words") + TEXT).alias("words"))
    blocks = lambda words: F.ceil(words / F.lit(BLOCK))
    mixed = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("words").alias("all"), F.max_by("words", F.struct("n", "component")).alias("most")).where("parts > 1")
    mixed = mixed.select("bucket", "main", blocks(F.col("all")).alias("n_blocks"), blocks(F.col("all") - F.col("most")).alias("q_blocks"))
    rows = labelled.join(mixed, "bucket").select("bucket", "node", "component", (F.col("component") != F.col("main")).alias("seeks"), "n_blocks", "q_blocks")
    rows = materialize(rows)
    rows = rows.join(among(texts, "node", rows.select("node").distinct()), "node")
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    fields = ["node", "component", "text"]
    seekers = rows.where("seeks").select("bucket", block("q_blocks").alias("q"), every("n_blocks").alias("t"), F.lit(True).alias("seeks"), *fields)
    others = rows.select("bucket", every("q_blocks").alias("q"), block("n_blocks").alias("t"), F.lit(False).alias("seeks"), *fields)

    def compare(group: pa.Table) -> pa.Table:
        seeks = group.column("seeks")
        found = _forest(group.filter(seeks), group.filter(pc.invert(seeks)), similarity)
        return pa.table({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate("ab")})

    return seekers.union(others).groupBy("bucket", "q", "t").applyInArrow(compare, "a bigint, b bigint")


def _clustered(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, node, class_id, cluster_id, keeper (the node of the cluster's first row) for the rows with a doc_id."""
    named = docs.where(F.col("doc_id").isNotNull())
    signed = materialize(_classes(named, BANDS * BAND_ROWS))
    first = F.struct("doc_id", "node")
    worded = signed.where(F.col("key").isNotNull())
    least = worded.groupBy("key").agg(F.min(first).alias("f"), F.min_by(F.struct("n_words", "bands", "signature"), first).alias("s"))
    least = materialize(least.select("key", F.col("f.node").alias("node"), F.col("f.doc_id").alias("class"), "s.*"))
    texts = named.select(_node().alias("node"), F.lower("text").alias("text"))  # a class is named by its least row
    rows = least.select("node", "n_words", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "node", "n_words")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(rows.join(sizes, "bucket").withColumn("company", F.sum("n").over(Window.partitionBy("node"))))  # a node has a row a band
    small = members.where(F.col("n") <= SMALL)
    pairs = small.alias("x").join(small.alias("y"), "bucket").where("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = members.where(F.col("n") > SMALL).select("bucket", "node", "n_words", "company")
    hubs = large.groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    spokes = large.join(hubs, "bucket").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    candidates = materialize(pairs.union(spokes).distinct())
    links = materialize(_verify(materialize(_likely(candidates, least, similarity)), texts, similarity).distinct())
    component = connected_components(links)
    more = materialize(_meet(large.select("bucket", "node", "n_words"), component, texts, similarity))
    if not more.isEmpty():
        # Components, not classes, meet now: a link of two classes links their components.
        named_by = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        joined = more.join(named_by("a"), "a", "left").join(named_by("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        over = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("top"))
        alone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(component, "node", "left_anti").select("node", F.col("node").alias("component"))
        component = component.union(alone).join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    of = least.select("key", "node", "class").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = materialize(of)
    heads = of.groupBy("component").agg(F.min(F.struct("class", "node")).alias("head")).select("component", "head.*")
    heads = heads.select("component", F.col("class").alias("cluster"), F.col("node").alias("keeper"))
    classes = of.select("key", "class", "component").join(heads, "component").select("key", "class", "cluster", "keeper")
    found = worded.select("doc_id", "node", "key").join(classes, "key").select("doc_id", "node", F.col("class").alias("class_id"), F.col("cluster").alias("cluster_id"), "keeper")
    alone = signed.where(F.col("key").isNull()).select("doc_id", "node", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("cluster_id"), F.col("node").alias("keeper"))
    return found.union(alone)


def clusters(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least id of equal word sequences), cluster_id (least id of linked classes)."""
    return _clustered(docs, similarity).select("doc_id", "class_id", "cluster_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near-duplicates: of each cluster the first row (by id, then text) stays, with all its columns and its exact repeats."""
    name = fresh("node", docs)
    gone = _clustered(docs, similarity).where("node <> keeper").select(F.col("node").alias(name)).distinct()
    return docs.withColumn(name, _node()).join(gone, name, "left_anti").select(docs.columns)
