"""Best-fit packing of token pieces into sequences, with exact complements first.

The plan is made on the histogram of piece lengths, which has at most
``capacity`` entries however many pieces there are. From the longest length
down, the gap is filled exactly where it can be: by one length, else by a pair,
else by a triple, found in an index of available lengths and consumed as often
as availability allows. A gap without exact complement takes the longest length
that fits (best fit) and is tried again. Each pattern of lengths is planned once
with its number of repeats.

Pieces then find their places without meeting each other: a piece's rank among
those of its length comes from counts by (length, salt) and a row number within
them, and the rank falls into one pattern's slots. A length has salts in proportion to
its share of the pieces, ``SALTS`` for all lengths together and one each; pieces
of full length are sequences of their own and need no rank.

Rows: a null text counts as empty; every document has at least its end token and
so at least one piece. Repeated documents are packed as often as they occur, and a null or
repeated ``doc_id`` is packed like any other. ``pieces_of`` ignores other columns;
``pack`` keeps those of its input but for sequence_id and offset, which it replaces.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, materialize, text_slices

CAPACITY = 4096
END_ID = 1
SALTS = 20_000
MAX_CACHED_STEMS = 1_000_000
STEMS_TOGETHER = 20_000
# Code points that Python's split takes for white space and the tokenizer does not; such texts are encoded whole.
SPLIT_DIFFERS = "\x1c\x1d\x1e\x1f"
# Words of letters below U+0250, without U+0130: lower case changes them letter by letter, and nothing in them is composed.
PLAIN = r"^[\x{0}-\x{12F}\x{131}-\x{24F}]*$"


class _Words:
    """Words to their ids as little-endian bytes. The tokenizer drops white space and never joins across it.

    Nor does it join a letter with the point or comma after it, and it lowers
    case: words are looked up by their lowered stems, so that only stems not met
    before are encoded, together for all texts of a slice.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.stems: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        self.stems = {}
        pa.default_memory_pool().release_unused()

    def learn(self, stems: list[str]) -> None:
        """Encode the stems as one text with spaces between them; the offsets say where each one's ids begin."""
        got = self.tokenizer.encode(" ".join(stems), add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        starts = np.cumsum([0, *(len(x) + 1 for x in stems)])
        cuts = np.searchsorted(np.fromiter((a for a, _ in got.offsets), np.int64, len(ids)), starts).tolist()
        data = ids.tobytes()
        for stem, a, b in zip(stems, cuts, cuts[1:]):
            self.stems[stem] = data[4 * a : 4 * b]

    def ids(self, words: pa.Array) -> list[bytes]:
        """The ids of each of the words, which are distinct."""
        plain = pc.match_substring_regex(words, PLAIN)
        lower = pc.if_else(plain, pc.utf8_lower(words), words)
        cut = pc.and_(plain, pc.match_substring_regex(lower, r"\p{L}[.,]$"))
        split = pc.dictionary_encode(pc.if_else(cut, pc.utf8_slice_codeunits(lower, 0, -1), lower))
        needed = split.dictionary.to_numpy(zero_copy_only=False).tolist()
        unknown = [x for x in (*needed, ".", ",") if x not in self.stems]
        if len(self.stems) + len(unknown) > MAX_CACHED_STEMS:
            self.stems = {}
            unknown = [*needed, ".", ","]
        for at in range(0, len(unknown), STEMS_TOGETHER):
            self.learn(unknown[at : at + STEMS_TOGETHER])
        own = list(map(self.stems.__getitem__, needed))
        ends = pc.if_else(cut, pc.if_else(pc.ends_with(lower, "."), 1, 2), 0)
        tails = [b"", self.stems["."], self.stems[","]]
        return [own[k] + tails[end] for k, end in zip(split.indices.to_numpy().tolist(), ends.to_numpy().tolist())]

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of every text (null: none)."""
        column = column.fill_null("")
        lists = pc.utf8_split_whitespace(column)
        words = pc.dictionary_encode(lists.flatten())
        table = self.ids(words.dictionary)
        codes = words.indices.to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(column, f"[{SPLIT_DIFFERS}]").to_pylist()
        stop = 0
        for i, n in enumerate(pc.list_value_length(lists).to_pylist()):
            start, stop = stop, stop + n
            yield self.whole(column[i].as_py()) if odd[i] else b"".join(map(table.__getitem__, codes[start:stop].tolist()))


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    return _Words(path)


def encode_words(text: str, path: str) -> bytes:
    """Ids of the text as little-endian unsigned 32-bit values."""
    return next(_words(path).texts(pa.array([text], pa.string())))


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with the end token; only longer ones are cut."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in text_slices(batches, "text"):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), _words(path).texts(batch.column("text"))):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=names)
        _words(path).forget()  # the worker lives on for other stages' tasks

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many such sequences)], longest first.

    The index of sums is three bitmaps over 0..capacity: the available lengths,
    the same mirrored (so that a shift lines up the complements to any gap), and
    the sums of pairs. The last is refreshed now and then; lengths only ever run
    out, so in between it holds too many sums and never too few, and what it
    proposes for a triple is confirmed on the other two.
    """
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    there = sum(1 << x for x in range(1, capacity + 1) if left[x])
    mirror = sum(1 << (capacity - x) for x in range(1, capacity + 1) if left[x])
    sums, mirrored_sums, stale = 0, 0, 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(length: int, n: int) -> None:
        nonlocal there, mirror, stale
        left[length] -= n
        if not left[length] and n:
            there &= ~(1 << length)
            mirror &= ~(1 << (capacity - length))
            stale += 1

    def index_pairs() -> None:
        nonlocal sums, mirrored_sums, stale
        sums, bits = 0, there
        while bits:
            low = bits & -bits
            sums |= there << (low.bit_length() - 1)
            bits ^= low
        sums &= (1 << (capacity + 1)) - 1
        mirrored_sums, stale = int(f"{sums:0{capacity + 1}b}"[::-1], 2), 0

    def pair(gap: int, least: int = 1) -> tuple[int, int] | None:
        both = there & (mirror >> (capacity - gap)) & ((1 << (gap // 2 + 1)) - 1)
        while both:
            a = both.bit_length() - 1
            if a < least:
                return None
            if a * 2 != gap or left[a] >= 2:
                return gap - a, a
            both ^= 1 << a
        return None

    def triple(gap: int) -> tuple[int, int, int] | None:
        if stale >= 32 or not sums:
            index_pairs()
        thirds = there & (mirrored_sums >> (capacity - gap)) & ((1 << (gap // 3 + 1)) - 1)
        while thirds:
            c = thirds.bit_length() - 1
            found = pair(gap - c, c)
            if found and all(left[x] >= (*found, c).count(x) for x in found):
                return (*found, c)
            thirds ^= 1 << c
        return None

    def exact(gap: int) -> tuple[int, ...] | None:
        if left[gap]:
            return (gap,)
        return pair(gap) or triple(gap)

    for length in range(capacity, 0, -1):
        while left[length]:
            pattern, gap = [length], capacity - length
            take(length, 1)
            while gap:
                filled = exact(gap)
                if filled is None:
                    fits = (there & ((1 << (gap + 1)) - 1)).bit_length() - 1
                    if fits < 1:
                        break
                    filled = (fits,)
                for x in filled:
                    take(x, 1)
                pattern += filled
                gap -= sum(filled)
            # The same pattern again, as often as all its lengths are there.
            needed = {x: pattern.count(x) for x in pattern}
            more = min(left[x] // n for x, n in needed.items())
            for x, n in needed.items():
                take(x, more * n)
            out.append((tuple(pattern), 1 + more))
    return out


class Slots:
    """For each length the ranks' slots: which pattern, and where in it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        self.by: dict[int, tuple[list[int], list[int], list[int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for lengths, n in patterns:
            offset = 0
            for length in lengths:
                begins, bases, offsets = self.by.setdefault(length, ([], [], []))
                begins.append(used.get(length, 0))
                bases.append(base)
                offsets.append(offset)
                used[length] = used.get(length, 0) + n
                offset += length
            base += n
        self.sequences = base

    def place(self, length: int, rank: int) -> tuple[int, int]:
        begins, bases, offsets = self.by[length]
        k = bisect_right(begins, rank) - 1
        return bases[k] + rank - begins[k], offsets[k]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset: sequences of at most ``capacity``, gapless from 0."""
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    salt, rn = fresh("salt", pieces), fresh("rn", pieces)
    pieces = materialize(pieces)
    totals = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    full = totals.pop(capacity, 0)
    share = max(sum(totals.values()) / SALTS, 1)
    salts = spark.createDataFrame([(length, math.ceil(n / share)) for length, n in totals.items()], f"length bigint, {salt} int")  # at most capacity rows
    salted = pieces.where(F.col("length") != capacity).join(F.broadcast(salts), "length").withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col(salt)).cast("int")).select(*pieces.columns, salt)
    counts = salted.groupBy("length", salt).count().collect()  # at most capacity + SALTS rows
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for length, s, n in sorted((r["length"], r[salt], r["count"]) for r in counts):
        before[length, s] = histogram.get(length, 0)
        histogram[length] = before[length, s] + n
    slots = Slots(plan(histogram, capacity))
    shared = spark.sparkContext.broadcast((slots, before))
    ranked = salted.withColumn(rn, F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece", "ids_crc32")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, before = shared.value
        for batch in batches:
            places = [slots.place(n, before[n, s] + r - 1) for n, s, r in zip(batch.column("length").to_pylist(), batch.column(salt).to_pylist(), batch.column(rn).to_pylist())]
            kept = [i for i, name in enumerate(batch.schema.names) if name not in (salt, rn)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    packed = ranked.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")
    if not full:
        return packed
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + slots.sequences).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.union(whole)
