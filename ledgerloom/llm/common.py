"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import cut, work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def run_dir(spark: SparkSession, name: str) -> str:
    return work_dir(spark, name)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs a re-read and not the whole plan."""
    return cut(df)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of ``column`` (one row at least), so numpy's temporaries stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first word of each row plus the end, byte starts, byte ends) of the words of every text."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, np.zeros(len(offsets), np.int64), none, none
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = solid[cuts]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = cuts[cuts > 0] - 1
    last[inner] = solid[inner]
    ends = np.flatnonzero(last) + 1
    return data, np.searchsorted(starts, offsets).astype(np.int64), starts, ends


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As the first two of ``word_hashes``, by another hash, which takes eight bytes of a word at a time."""
    data, rows, starts, ends = _words(column)
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # those from each byte on
    codes, live, at, left = np.zeros(len(starts), np.uint64), slice(None), starts, ends - starts
    while len(at):
        part = eight[at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))
        with np.errstate(over="ignore"):
            codes[live] = mix64(codes[live] * np.uint64(0x9E3779B97F4A7C15) + part + left.astype(np.uint64))
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    return codes, rows


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every word of every text: (hashes, first word of each row plus the end, byte starts, byte ends).

    Words are runs of bytes other than ASCII white space; null counts as empty.
    Byte positions are offsets into the concatenated UTF-8 of the slice's own rows
    (row r begins at the sum of the lengths before it).
    """
    data, rows, starts, ends = _words(column)
    if not len(starts):
        return np.zeros(0, np.uint64), rows, starts, ends
    lengths = ends - starts
    hashes = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        # Bytes of all words, step by step: the words that are still that long.
        live = np.arange(len(starts))
        step = 0
        while len(live):
            hashes[live] = (hashes[live] ^ data[starts[live] + step]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
            step += 1
            live = live[lengths[live] > step]
            if step >= 64 and len(live):
                break
        for i in live.tolist():  # words of over 64 bytes: rare, hashed one by one
            hashes[i] = np.uint64(_long_word(data[starts[i] : ends[i]].tobytes()))
    return mix64(hashes), rows, starts, ends


def _long_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``width`` words within a row, first shingle of each row plus the end).

    A row of fewer words, but at least one, gives one shingle of all its words.
    """
    n_words = np.diff(rows)
    n_shingles = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(n_shingles)]).astype(np.int64)
    total = int(begins[-1])
    out = np.zeros(total, np.uint64)
    if not total:
        return out, begins
    position = np.arange(total) - np.repeat(begins[:-1], n_shingles) + np.repeat(rows[:-1], n_shingles)
    end = np.repeat(rows[1:], n_shingles)
    with np.errstate(over="ignore"):
        for i in range(width):
            at = position + i
            inside = at < end
            value = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(i + 1))
            out = out * np.uint64(0x9E3779B97F4A7C15) + value
    return mix64(out), begins


BLOOM_BITS = 1 << 26  # at most 8 MB, whatever the number of ids; past its use it lets everything through
BLOOM_HASHES = 4


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits) for i in range(BLOOM_HASHES)])


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose (bigint, non-null) column may be one of ``ids`` (one column), by a Bloom filter of bounded size.

    A reduction before a join, not a semi-join: a few other rows stay.
    """
    bits = 1 << 16
    n = ids.count()
    while bits < BLOOM_BITS and bits < 12 * n:
        bits <<= 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = _bloom_places(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(own, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(own[some].view(np.int64))], names=["word", "mask"])

    found = ids.mapInArrow(build, "word int, mask bigint").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()  # at most bits / 64 rows
    table_ = np.zeros(bits // 64, np.uint64)
    table_[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(table_)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bloom_places(batch.column(column).to_numpy(zero_copy_only=False), bits)
            hit = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(hit.reshape(BLOOM_HASHES, -1).all(0)))

    return rows.mapInArrow(keep, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes of an undirected edge list (a, b) with the least node each reaches: (node, component).

    Alternating large-star and small-star rounds, each an aggregation and an
    equi-join, until a round changes nothing. Only counts and checksums reach
    the driver. Nodes without an edge are not returned.
    """
    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b") if not large else e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = digest(now)
    while before[0]:
        now = materialize(star(star(now, True), False))
        after = digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
