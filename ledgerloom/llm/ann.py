"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced k-means on a bounded sample of vectors
(``sample_rows``) and are ``max_lists`` at most, so they, and a neighbour graph
over them, fit in every task's memory. All vectors are then indexed: each goes
to its nearest centroid's list and, when it lies near a boundary, to further
lists whose centroids are hardly farther off. A query walks the graph to its
nearest centroids, drops those whose distance ratio to the nearest is too large,
and looks through the lists that are left; lists are taken until
``MIN_CANDIDATES`` primary vectors are in reach or the beam's end; a query
gets fewer than ``k`` neighbours only where the lists in its beam hold fewer. Distances of the final neighbours are computed on the original vectors
in double precision.

Lists are cut into blocks of bounded size and so are the queries of a list;
each pair of blocks is one group, whatever the skew.

Vectors that are null, zero, or hold null or non-finite components take no part,
and neither do those of another length than most (ties: the shorter). Equal
distances are ordered by the smaller id; rows that repeat an id each count once
a query and id, at the smallest distance. A table without usable vectors gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

SAMPLE_ROWS = 32_768
MAX_LISTS = 2048
NEIGHBOURS = 24  # graph edges of a centroid
BEAM = 96
COPIES = 4
COPY_RATIO = 1.12
PROBE_RATIO = 1.45
PROBES = 48
MIN_CANDIDATES = 256
BLOCK = 8192
QUERY_BLOCK = 1024


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def balanced_kmeans(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids; a list above its fair share is charged for it, which moves boundary vectors to emptier ones."""
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), lists, replace=False))].astype(np.float64)
    scale = float(np.median(((sample - sample.mean(0)) ** 2).sum(1))) or 1.0
    charge = np.zeros(lists)
    for _ in range(rounds):
        near = np.concatenate([np.argmin(squared(sample[i : i + 1024], centroids) + charge, axis=1) for i in range(0, len(sample), 1024)])
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        centroids[~full] = sample[rng.choice(len(sample), int((~full).sum()))]
        charge += 0.05 * scale * (counts / (len(sample) / lists) - 1).clip(-1, 1)
        charge -= charge.min()
    return centroids


class CentroidGraph:
    """Centroids, each with its nearest ones; searched best first from a few entries, all queries of a batch at once."""

    def __init__(self, centroids: np.ndarray, neighbours: int = NEIGHBOURS):
        n = len(centroids)
        self.centroids = centroids
        k = min(neighbours, n - 1)
        distances = squared(centroids, centroids)
        np.fill_diagonal(distances, np.inf)
        self.edges = np.argsort(distances, axis=1, kind="stable")[:, :k].astype(np.int32) if k else np.zeros((n, 0), np.int32)
        # Entries far apart from each other, so every region of the graph can be reached.
        entries, gap = [0], squared(centroids[:1], centroids)[0]
        while len(entries) < min(n, 16):
            entries.append(int(np.argmax(gap)))
            gap = np.minimum(gap, squared(centroids[entries[-1:]], centroids)[0])
        self.entries = np.array(entries, np.int32)

    def search(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), nearest first, as many as the beam or all there are."""
        n, b = len(self.centroids), len(vectors)
        width = min(beam, n)
        norms = (self.centroids**2).sum(1)
        own = (vectors**2).sum(1)
        seen = np.zeros((b, n), bool)
        ids = np.full((b, width), -1, np.int32)
        dist = np.full((b, width), np.inf)
        done = np.zeros((b, width), bool)
        rows = np.arange(b)

        def offer(at: np.ndarray, nodes: np.ndarray) -> None:
            nonlocal ids, dist, done
            fresh = ~seen[at[:, None], nodes]
            value = np.einsum("bd,bkd->bk", vectors[at], self.centroids[nodes])
            value = np.where(fresh, np.maximum(own[at, None] + norms[nodes] - 2 * value, 0), np.inf)
            seen[at[:, None], nodes] = True
            all_ids = np.concatenate([ids[at], nodes], 1)
            all_dist = np.concatenate([dist[at], value], 1)
            all_done = np.concatenate([done[at], np.zeros(nodes.shape, bool)], 1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            pick = np.arange(len(at))[:, None]
            ids[at], dist[at], done[at] = all_ids[pick, order], all_dist[pick, order], all_done[pick, order]

        offer(rows, np.broadcast_to(self.entries, (b, len(self.entries))))
        while self.edges.shape[1]:
            open_dist = np.where(done | (ids < 0) | np.isinf(dist), np.inf, dist)
            best = np.argmin(open_dist, axis=1)
            at = np.flatnonzero(np.isfinite(open_dist[rows, best]))
            if not len(at):
                break
            done[at, best[at]] = True
            offer(at, self.edges[ids[at, best[at]]])
        return ids, dist


def fit(vectors: DataFrame, total: int, sample_rows: int = SAMPLE_ROWS, max_lists: int = MAX_LISTS) -> CentroidGraph:
    lists = int(min(max_lists, max(1, round(0.75 * total**0.5))))
    share = min(1.0, 1.25 * sample_rows / total)
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()  # bounded by sample_rows
    if not len(rows):
        rows = vectors.limit(1).select("vec_id", "v").toPandas()
    sample = np.unique(np.stack(rows["v"].to_numpy()).astype(np.float64), axis=0)
    return CentroidGraph(balanced_kmeans(sample, min(lists, len(sample))))


def search(embeddings: DataFrame, query_step: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector whose id ``query_step`` divides, the nearest ``k`` others found."""
    spark = embeddings.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    valid = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    valid = valid.where(F.size("v") == sizes["d"])
    graph = spark.sparkContext.broadcast(fit(valid, sizes["count"]))  # at most MAX_LISTS centroids

    def assign(batches):
        g = graph.value
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                x = np.stack(part["v"].to_numpy())
                ids, dist = g.search(x, 32)
                ids, dist = ids[:, :COPIES], dist[:, :COPIES]
                keep = (ids >= 0) & (dist <= COPY_RATIO**2 * dist[:, :1] + 1e-18)
                for c in range(1, keep.shape[1]):  # a list that an earlier list of this vector stands in front of adds little
                    for e in range(c):
                        between = ((g.centroids[ids[:, c]] - g.centroids[ids[:, e]]) ** 2).sum(1)
                        keep[:, c] &= ~keep[:, e] | (between >= 0.25 * dist[:, c])
                r, c = np.nonzero(keep)
                yield pd.DataFrame({"list": ids[r, c], "copy": c.astype(np.int32), "vec_id": part["vec_id"].to_numpy()[r], "v": [x[i] for i in r]})

    postings = materialize(valid.mapInPandas(assign, "list int, copy int, vec_id bigint, v array<double>"))
    sizes = {r["list"]: (r["n"], r["primary"]) for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if(F.col("copy") == 0).alias("primary")).collect()}  # one row a list
    counts = spark.sparkContext.broadcast(sizes)

    def route(batches):
        g, lists = graph.value, counts.value
        primary = np.array([lists.get(i, (0, 0))[1] for i in range(len(g.centroids))])
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                x = np.stack(part["v"].to_numpy())
                ids, dist = g.search(x, max(BEAM, PROBES))
                inside = ids >= 0
                before = np.cumsum(np.where(inside, primary[ids], 0), axis=1) - np.where(inside, primary[ids], 0)
                near = (dist <= PROBE_RATIO**2 * dist[:, :1] + 1e-18) & (np.arange(ids.shape[1]) < PROBES)
                r, c = np.nonzero(inside & (near | (before < MIN_CANDIDATES)))
                yield pd.DataFrame({"list": ids[r, c], "query_id": part["vec_id"].to_numpy()[r], "q": [x[i] for i in r]})

    queries = valid.where(F.col("vec_id") % query_step == 0)
    probes = materialize(queries.mapInPandas(route, "list int, query_id bigint, q array<double>"))
    asked = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}  # one row a list
    n_blocks = {i: -(-n // BLOCK) for i, (n, _) in sizes.items()}
    q_blocks = {i: -(-n // QUERY_BLOCK) for i, n in asked.items()}
    blocks = spark.createDataFrame([(i, n_blocks[i], q_blocks.get(i, 0)) for i in n_blocks], "list int, p_blocks int, q_blocks int")
    blocks = F.broadcast(blocks)  # one row a list
    left = postings.join(blocks, "list").where("q_blocks > 0").withColumn("p", F.pmod(F.xxhash64("vec_id"), F.col("p_blocks")).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).select("list", "p", "s", "vec_id", "v")
    right = probes.join(blocks, "list").withColumn("s", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1))).select("list", "p", "s", "query_id", "q")

    def scan(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = np.stack(vectors["v"].to_numpy())
        ids = vectors["vec_id"].to_numpy()
        out = []
        for at in range(0, len(asked), 256):
            qs = np.stack(asked["q"].iloc[at : at + 256].to_numpy())
            near = squared(qs, v)
            for query, q, d in zip(asked["query_id"].iloc[at : at + 256].to_numpy(), qs, near):
                d = np.where(ids == query, np.inf, d)
                cut = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                pick = np.flatnonzero((d <= cut + 1e-9 * (1 + (q * q).sum())) & np.isfinite(d))
                exact = np.sqrt(((v[pick] - q) ** 2).sum(1))
                order = np.lexsort((ids[pick], exact))
                _, once = np.unique(ids[pick][order], return_index=True)
                order = order[np.sort(once)][:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[pick][order], "score": exact[order]}))
        return pd.concat(out)

    found = left.groupBy("list", "p", "s").cogroup(right.groupBy("list", "p", "s")).applyInPandas(scan, "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
