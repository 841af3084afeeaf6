"""Passages that repeat across documents, found by compact windows.

The tokens of a text are its runs of five words (lower case, cut at white space).
For each of ``HASHES`` hash functions the Cartesian tree over the tokens' hashes
cuts the text into compact windows: a window (l, c, r) stands for all
subsequences from l..c to c..r, whose min-hash is the one at c. Windows shorter
than the least passage are not kept, so there are about 2n / t a function. The
tree is built level by level over all texts of a slice at once.

Windows are put in order of their hash, then of the words around c, then of the
document, over ranges of that order, so a passage that very many documents share is no one
task's. Each window meets the one before it of the same hash: a group of n gives n - 1
pairs, however large it is, and occurrences of one passage stand side by side. For a
pair of documents the collisions are joined by their intervals: a place where
``ENOUGH`` hash functions collide, or one whose surrounding words agree as well, is
a candidate. The two whole texts are then aligned and a passage is reported where
at least ``PASSAGE`` words have tokens of Jaccard similarity 0.8 or more.

That settles exact copies. A window whose c no reported passage covers, in a group of three or more, stays
open. The windows of such groups are given the tokens around c, as far as a least passage reaches, and meet all of their
group by bitmaps of these, which costs no text: groups of up to ``NEAR`` more than one whole, larger ones in blocks of
``BLOCK`` times ``BLOCK`` over the tasks. An open window stays if it shares as many bits as a passage needs with one that can
hold a passage with it, and those that share as many with it stay too; a pair of windows is no row. What stays is taken with
the texts, groups with the same first document together, as near copies meet in many groups, in blocks of about
``DOCUMENTS`` times ``DOCUMENTS`` documents: there every two documents of which the bitmaps share as many bits are aligned, all that stand with
one document at a time, so no window of its hash is left out.

Of the passages of a document those that lie in another one of it are not told, nor in the last step (the longest of some go first) those whose words
are all told already: each repeated word has one reference at least, and not one for every earlier copy.

A reported passage is always that of the document with the larger id, and refers
to an earlier one, so removing all reported passages leaves each first occurrence.

Rows: null, empty and short texts have no passages. Rows without ``doc_id`` take
no part. Rows that repeat an id and its text count as one document and do not match each
other; texts that share an id are told apart (in order of a hash of the text), and in ``passages``
an id then stands for any of them. Extra columns are ignored by ``passages`` and kept by
``remove_passages``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import among, fresh, materialize, mix64, shingle_hashes, text_slices, word_codes, word_hashes

WIDTH = 5
PASSAGE = 50  # words
SIMILARITY = 0.8
HASHES = 4
ENOUGH = 2
AROUND = 8  # tokens that agree on one side of c
NEAR = 32  # places before an open window that it is compared with
FARTHEST = 1 << 14  # the farthest of the doubled distances
BLOCK = 8192  # windows on a side of a block of a group whose open windows meet all
BITS = 1024  # of the bitmap of the tokens around a window's c
LEAST_BITS = 32  # that two bitmaps share around a passage; 46 tokens of similarity 0.8 share 41
GAP = 12  # tokens between two aligned stretches of a passage
SIEVE = 4096  # bits of the bitmap that tells which tokens around a c stand around another
BYTES = 8_000_000  # of the texts on a side of a block of documents, about
DOCUMENTS = 1024  # on a side of such a block, about
SOME = 2000  # documents whose windows tell the borders of ranges, about
SLOTS = 1 << 22  # of the table of the places of a text's tokens
RUNS = 1 << 18  # stretches of pairs of documents that are joined to passages at a time, about
PAIRS = 1 << 14  # pairs of windows whose tokens are compared at a time, about
SPREAD = 0x9E3779B1


def compact_windows(hashes: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least ``least`` tokens, r inclusive; rows are begins[i] to begins[i + 1].

    A value holds a hash's upper bits and, below them, its position scrambled by
    a bijection: the minimum gives its own place, and equal tokens take turns in
    no particular order, so repeats do not make the tree deep.
    """
    at = np.arange(len(hashes), dtype=np.uint64)
    bits = max(24, len(hashes).bit_length())
    low_bits, unspread = np.uint64((1 << bits) - 1), np.uint64(pow(SPREAD, -1, 1 << bits))
    with np.errstate(over="ignore"):
        values = (hashes & ~low_bits) | ((at * np.uint64(SPREAD)) & low_bits)
    start, stop = begins[:-1], begins[1:]
    out = []
    while True:
        long = stop - start >= least
        start, stop = start[long], stop[long]
        if not len(start):
            break
        cuts = np.stack([start, stop], 1).ravel()
        low = np.minimum.reduceat(values, cuts[:-1] if cuts[-1] == len(values) else cuts)[::2]
        with np.errstate(over="ignore"):
            c = (((low & low_bits) * unspread) & low_bits).astype(np.int64)
        out.append((start, c, stop - 1))
        order = np.argsort(np.concatenate([start, c + 1]), kind="stable")
        start, stop = np.concatenate([start, c + 1])[order], np.concatenate([c, stop])[order]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


#: A document is named by its id and, as ids may repeat, a hash of its text.
WINDOW = {"hash": pa.int64(), "around": pa.int32(), "doc_id": pa.int64(), "v": pa.int32(), "c": pa.int32(), "l": pa.int32(), "r": pa.int32()}
ORDER = ["hash", "around", "doc_id", "v", "c"]
#: Two windows that meet: x of the earlier document a, y of the later one b.
MET = {"hash": pa.int64(), "a": pa.int64(), "va": pa.int32(), "cx": pa.int32(), "lx": pa.int32(), "rx": pa.int32(), "b": pa.int64(), "vb": pa.int32(), "cy": pa.int32(), "ly": pa.int32(), "ry": pa.int32(), "same": pa.bool_(), "end": pa.int32()}
PAIR = ["a", "va", "b", "vb"]


def _schema(columns: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[t]}" for n, t in columns.items())


def _version(text: str = "text") -> Column:
    return F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int")


def _ranges(rows: list[np.ndarray], borders: list[np.ndarray]) -> np.ndarray:
    """The range of each row (columns ``ORDER``): how many of the borders, in order, do not stand after it."""
    low, high = (np.searchsorted(borders[0], rows[0], side) for side in ("left", "right"))
    for start in np.unique(low[low < high]) if len(rows) > 1 else ():  # rows with the first value of some borders
        own = np.flatnonzero((low == start) & (low < high))
        high[own] = start + _ranges([k[own] for k in rows[1:]], [k[start : high[own[0]]] for k in borders[1:]])
    return high


def windows(texts: DataFrame, passage: int = PASSAGE, borders: list[np.ndarray] | None = None) -> DataFrame:
    """The compact windows of ``texts`` (doc_id, v, text), with a hash of the words around c; with ``borders`` also their ``range``."""
    least = passage - WIDTH + 1
    schema = WINDOW if borders is None else WINDOW | {"range": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            hashes, begins = shingle_hashes(*word_codes(batch.column("text")), WIDTH)
            of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            parts = []
            for f in range(HASHES):
                with np.errstate(over="ignore"):
                    mixed = mix64(hashes ^ mix64(np.full(1, f + 1, np.uint64)))
                l, c, r = compact_windows(mixed, begins, least)
                if not len(c):
                    continue
                # Words from c on for even functions, up to c for odd ones; cut where the text ends.
                other = np.clip(c + (AROUND - 1 if f % 2 == 0 else 1 - AROUND), begins[of[c]], begins[of[c] + 1] - 1)
                with np.errstate(over="ignore"):
                    around = mix64(hashes[other] + np.uint64(f % 2)) >> np.uint64(48)
                row = of[c]
                parts.append((mixed[c].view(np.int64), around.astype(np.int32), row, *((p - begins[row]).astype(np.int32) for p in (c, l, r))))
            if parts:
                h, around, row, c, l, r = (np.concatenate(x) for x in zip(*parts))
                ids = [batch.column(n).take(pa.array(row)) for n in ("doc_id", "v")]
                arrays = [pa.array(h), pa.array(around), *ids, *map(pa.array, (c, l, r))]
                if borders is not None:
                    arrays.append(pa.array(_ranges([h, around, *(k.to_numpy() for k in ids), c], borders), pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, names=list(schema))

    return texts.select("doc_id", "v", "text").mapInArrow(run, _schema(schema))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, v, text of the documents that can have passages."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), _version().alias("v"), F.lower("text").alias("text"))


def _borders(docs: DataFrame, passage: int) -> list[np.ndarray]:
    """Borders (columns ``ORDER``) of ranges of like numbers of windows, by the windows of some documents.

    As ``repartitionByRange`` finds them, but without making the windows of all documents twice. They tell only where rows go.
    """
    parts, n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count()
    some = docs.sample(min(1.0, SOME / max(n, 1)), 7)
    rows = windows(_texts(some), passage).select(*ORDER).sample(min(1.0, 0.5 * parts / max(min(n, SOME), 1)), 7).toPandas()  # about 40 a range
    rows = rows.sort_values(ORDER).iloc[np.unique(np.linspace(0, len(rows), parts + 1).astype(int)[1:-1])] if len(rows) else rows
    return [rows[n].to_numpy(WINDOW[n].to_pandas_dtype()) for n in ORDER]


def _pair_up(w: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """The windows i and j of w, each pair's earlier document first; two windows of one document do not meet."""
    other = (w["doc_id"][i] != w["doc_id"][j]) | (w["v"][i] != w["v"][j])
    i, j = i[other], j[other]
    swap = (w["doc_id"][i] > w["doc_id"][j]) | ((w["doc_id"][i] == w["doc_id"][j]) & (w["v"][i] > w["v"][j]))
    x, y = np.where(swap, j, i), np.where(swap, i, j)
    sides = [w[n][k] for k in (x, y) for n in ("doc_id", "v", "c", "l", "r")]
    arrays = [w["hash"][i], *sides, w["around"][i] == w["around"][j], np.zeros(len(i), np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, MET.values())], names=list(MET))


def neighbours(texts: DataFrame, borders: list[np.ndarray], passage: int = PASSAGE) -> DataFrame:
    """The windows of ``texts`` that meet: next neighbours of one hash in the order of hash, words around c and document.

    The order is cut into ranges by ``borders``. At a border the last window of one range meets the
    first of the next: two rows a task go through the driver for that.
    """
    dealt = windows(texts, passage, borders).repartitionById(len(borders[0]) + 1, "range").drop("range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            w = {n: batch.column(n).to_numpy() for n in WINDOW}
            if last is not None:
                w = {n: np.concatenate([last[n], w[n]]) for n in WINDOW}
            first = first or {n: int(w[n][0]) for n in WINDOW}
            j = np.flatnonzero(w["hash"][1:] == w["hash"][:-1]) + 1
            yield _pair_up(w, j - 1, j)
            last = {n: w[n][-1:] for n in WINDOW}
        for side, row in ((1, first), (2, last)):  # a range's ends: x of a row, with the range's number as b and the words around c as vb
            if row:
                row = {n: int(np.ravel(x)[0]) for n, x in row.items()}
                values = [row["hash"], row["doc_id"], row["v"], row["c"], row["l"], row["r"], TaskContext.get().partitionId(), row["around"], 0, 0, 0, False, side]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, MET.values())], names=list(MET))

    met = materialize(dealt.sortWithinPartitions(*ORDER).mapInArrow(run, _schema(MET)))
    ends = sorted(met.where("end > 0").collect(), key=lambda r: (r["b"], r["end"]))  # two a range
    pairs = [(x, y) for x, y in zip(ends[1::2], ends[2::2]) if x["hash"] == y["hash"]]
    w = {n: np.array([r[c] for p in pairs for r in p], t.to_pandas_dtype()) for (n, t), c in zip(WINDOW.items(), ("hash", "vb", "a", "va", "cx", "lx", "rx"))}
    i = np.arange(0, 2 * len(pairs), 2)
    across = texts.sparkSession.createDataFrame(pa.Table.from_batches([_pair_up(w, i, i + 1)])).select(*MET)
    return met.where("end = 0").union(across)


def collisions(met: DataFrame) -> DataFrame:
    """a, va, b, vb, hits: for each two documents with places enough where hashes collide, those places."""
    # Two documents collide at most once a window, so a list is bounded by a text's length.
    grouped = met.groupBy(*PAIR).agg(F.collect_list(F.struct("hash", "cx", "lx", "rx", "cy", "ly", "ry", "same")).alias("hits"), F.max("same").alias("same"))
    return grouped.where((F.size("hits") >= ENOUGH) | F.col("same")).select(*PAIR, "hits")


#: A window of a group that has an open one: with a bitmap of the tokens around it, and that bitmap's min-hash for the order.
AROUND_C = {"hash": pa.int64(), "sketch": pa.int32(), "doc_id": pa.int64(), "v": pa.int32(), "c": pa.int32(), "open": pa.bool_(), "n": pa.int64(), "bits": pa.binary()}


def _spans(found: DataFrame) -> DataFrame:
    """doc_id, v, spans of the documents with passages."""
    return found.groupBy("doc_id", "v").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))


def _uncovered(windows_: DataFrame, spans: DataFrame) -> DataFrame:
    """``windows_`` with ``open``: whether no passage covers c."""
    covered = F.exists("spans", lambda s: (s["start_word"] <= F.col("c")) & (F.col("c") + WIDTH <= s["end_word"]))
    return windows_.join(spans, ["doc_id", "v"], "left").withColumn("open", ~F.coalesce(covered, F.lit(False))).drop("spans")


def open_groups(met: DataFrame, spans: DataFrame) -> DataFrame:
    """hash, doc_id, v, c, open, n: windows of hashes that three or more (n) share, and an open one in a document that is not the first."""
    side = lambda d, v, c: met.select("hash", F.col(d).alias("doc_id"), F.col(v).alias("v"), F.col(c).alias("c"))
    own = side("a", "va", "cx").union(side("b", "vb", "cy")).repartition("hash").distinct()
    marked = materialize(_uncovered(own.withColumn("n", F.count("*").over(Window.partitionBy("hash"))).where("n > 2"), spans))
    name = F.struct("doc_id", "v")
    groups = marked.groupBy("hash").agg(F.min(name).alias("first"), F.max(F.when(F.col("open"), name)).alias("last")).where("last > first").select("hash")
    return marked.join(groups, "hash").select("hash", "doc_id", "v", "c", "open", "n")


#: As ``AROUND_C``, with the tokens around c (16 bits each, 0 outside the text) in place of the bitmap, which follows from them.
AROUND_T = {n: t for n, t in AROUND_C.items() if n != "bits"} | {"tokens": pa.binary()}


def _short(tokens: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, 16-bit forms) of the tokens at the given places; 0 for the form of those not inside."""
    mixed = mix64(tokens[np.clip(at, 0, len(tokens) - 1)] ^ np.uint64(SPREAD))
    return mixed, np.where(inside, (mixed % np.uint64(0xFFFF)).astype(np.uint16) + np.uint16(1), np.uint16(0))


def surroundings(groups: DataFrame, texts: DataFrame, passage: int) -> DataFrame:
    """The windows of ``groups`` with the columns ``AROUND_T``."""
    reach = passage - WIDTH  # tokens before and after c that a least passage which holds it may have
    sight = reach + GAP + 1  # what is shared from c up to here and no gap beyond is more than a least passage
    listed = groups.groupBy("doc_id", "v").agg(F.collect_list(F.struct("hash", "c", "open", "n")).alias("w"))  # a text's own windows
    rows = among(texts, "doc_id", listed.select("doc_id").distinct()).dropDuplicates(["doc_id", "v"]).join(listed, ["doc_id", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1_000_000):
            tokens, begins = shingle_hashes(*word_codes(batch.column("text")), WIDTH)
            inner = batch.column("w").flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("w").offsets.to_numpy()))
            c, hash_ = inner.field("c").to_numpy(), inner.field("hash").to_numpy()
            for start in range(0, len(row), 4096):
                s = slice(start, start + 4096)
                at = begins[row[s], None] + c[s, None] + np.arange(-sight, sight + 1)
                inside = (at >= begins[row[s], None]) & (at < begins[row[s] + 1, None])
                mixed, near = _short(tokens, at, inside)
                least = np.where(inside, mixed, ~np.uint64(0))[:, sight - reach : sight + reach + 1].min(1)
                arrays = [pa.array(hash_[s]), pa.array((least >> np.uint64(33)).astype(np.int32)), *(batch.column(n).take(pa.array(row[s])) for n in ("doc_id", "v")), pa.array(c[s]), inner.field("open").slice(start, len(at)), inner.field("n").slice(start, len(at)), pa.array([b.tobytes() for b in near], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=list(AROUND_T))

    return rows.select("doc_id", "v", "w", "text").mapInArrow(run, _schema(AROUND_T))


def _bitmap(tokens: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits of each row of tokens, as 64-bit words."""
    flags = np.zeros((len(tokens), size), bool)
    row, column = np.nonzero(tokens)
    flags[row, tokens[row, column] % size] = True
    return np.packbits(flags, axis=1).view(np.uint64)


def _around(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
    """(bitmaps, tokens) of windows; those that come with their bitmap have no tokens."""
    name = "tokens" if "tokens" in t.schema.names else "bits"
    data = np.frombuffer(b"".join(t.column(name).to_pylist()), np.uint64 if name == "bits" else np.uint16).reshape(t.num_rows, -1)
    if name == "bits":
        return data, None
    parts = [_bitmap(data[i : i + 4096, GAP + 1 : -GAP - 1], BITS) for i in range(0, len(data), 4096)]
    return np.concatenate(parts) if parts else np.zeros((0, BITS // 64), np.uint64), data


def _sees(sieves: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens around a c and, row by row, the sieves of what is around another: (how many are shared around c without a gap of more than ``GAP``, whether those go on to the end of sight)."""
    bit = (tokens % SIEVE).astype(np.int32)
    shared = ((np.take_along_axis(sieves, bit >> 3, 1) >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool) & (tokens > 0)
    middle, count, on = shared.shape[1] // 2, np.zeros(len(shared), np.int64), np.zeros(len(shared), bool)
    for side in (shared[:, middle:], shared[:, middle::-1]):
        at = np.arange(side.shape[1], dtype=np.int16)
        last = np.maximum.accumulate(np.where(side, at, np.int16(0)), axis=1)
        ended = np.logical_or.accumulate(at - last > GAP, axis=1)
        count += (side & ~ended).sum(1)
        on |= ~ended[:, -1]
    return count - shared[:, middle], on


def _best_that_hold(x: np.ndarray, y: np.ndarray, shared: np.ndarray, ties: tuple, hold: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(of the pairs x and y the one of each y that shares most and can ``hold`` a passage, all of such y): places of pairs.

    Those that share most are asked first, and others only where that one cannot.
    """
    rank = np.lexsort((*ties, shared, y))
    last = np.append(y[rank][1:] != y[rank][:-1], True) if len(rank) else np.zeros(0, bool)
    top, rest = rank[last], rank[~last]
    top = top[hold(x[top], y[top])]
    rest = rest[~np.isin(y[rest], y[top])]
    rest = rest[hold(x[rest], y[rest])]
    top = np.append(top, rest[np.append(y[rest][1:] != y[rest][:-1], True)] if len(rest) else rest)
    return top, np.flatnonzero(np.isin(y, y[top]))


def can_hold(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, passage: int, similarity: float) -> np.ndarray:
    """Which pairs of tokens x[i] and y[j] around c may hold a passage with c.

    Stretches of a passage stand at most ``GAP`` tokens apart in both texts. So where what is shared around c ends
    within sight on both sides of both, a passage lies inside and must share as many tokens as a least one does.
    No pair is turned down that ``align`` would give a passage in which the one c meets the other.
    """
    tokens = passage - WIDTH + 1
    least = 2 * similarity * tokens / (1 + similarity)
    out = np.zeros(len(i), bool)
    for start in range(0, len(i), PAIRS):
        s = slice(start, start + PAIRS)
        own_x, of_x = np.unique(i[s], return_inverse=True)
        own_y, of_y = np.unique(j[s], return_inverse=True)
        count_y, on_y = _sees(_bitmap(x[own_x], SIEVE).view(np.uint8)[of_x], y[j[s]])
        count_x, on_x = _sees(_bitmap(y[own_y], SIEVE).view(np.uint8)[of_y], x[i[s]])
        out[s] = on_x | on_y | ((count_x >= least) & (count_y >= least))
    return out


#: Two documents, the earlier one first, and how far a window's c in the one is from that in the other.
ALIKE = {"a": pa.int64(), "va": pa.int32(), "b": pa.int64(), "vb": pa.int32(), "d": pa.int64()}
MEETING = ALIKE | {"cy": pa.int32(), "shared": pa.int32()}


def _best(pairs: DataFrame) -> DataFrame:
    """Of the pairs (columns ``MEETING``) of each place the one that shares most bits."""
    best = pairs.where("a IS NOT NULL").groupBy("b", "vb", "cy").agg(F.max(F.struct("shared", "a", "va", "d")).alias("x"))
    return best.select("x.a", "x.va", "b", "vb", "x.d")


def _meeting(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, shared: np.ndarray, met: np.ndarray | None = None) -> pa.RecordBatch:
    """The columns ``MEETING`` of the windows i of x and j of y, and of the windows ``met`` of x as places that some open window meets, without a document a."""
    (xd, xv, xc), (yd, yv, yc) = x, y
    values = [xd[i], xv[i], yd[j], yv[j], xc[i].astype(np.int64) - yc[j], yc[j], shared]
    arrays = [pa.array(k, t) for k, t in zip(values, MEETING.values())]
    if met is not None:
        places = {"b": xd[met], "vb": xv[met], "cy": xc[met]}
        more = [pa.array(places[n], t) if n in places else pa.nulls(len(met), t) for n, t in MEETING.items()]
        arrays = [pa.concat_arrays(k) for k in zip(arrays, more)]
    return pa.RecordBatch.from_arrays(arrays, names=list(MEETING))


def _diagonals(pairs: DataFrame, best: bool) -> DataFrame:
    """a, va, b, vb, diagonals of pairs (columns ``MEETING``)."""
    return (_best(pairs) if best else pairs).groupBy(*PAIR).agg(F.collect_set("d").alias("diagonals"))


def alike_around(windows_: DataFrame, best: bool = False, passage: int = PASSAGE, similarity: float = SIMILARITY) -> DataFrame:
    """a, va, b, vb, diagonals: documents of which the later one has an open window whose surroundings share ``LEAST_BITS`` with the other's.

    Pairs whose tokens cannot hold a passage are left out. With ``best``, only the pair that shares most bits for each place.
    In groups that do not meet whole an open window is compared with the ``NEAR`` before it, by their bitmaps' min-hashes, and
    those at doubled distances; ``_found`` takes such groups by ``_meet_all``.
    """
    return _diagonals(_meet_near(windows_, best, True, passage, similarity), best)


def _meet_near(windows_: DataFrame, best: bool, larger: bool, passage: int, similarity: float) -> DataFrame:
    """The pairs (columns ``MEETING``) of ``alike_around``, with ``best`` those of each batch and the places that meet one; without ``larger``, only groups that meet whole."""
    order = ["hash", "sketch", "doc_id", "v", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("hash", "doc_id", "v", "c")
        tail: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w = {n: batch.column(n).to_numpy() for n in names} | {"open": batch.column("open").to_numpy(zero_copy_only=False)}
            bits, tokens = _around(batch)
            w |= {"bits": bits} if tokens is None else {"bits": bits, "tokens": tokens}
            old = 0 if tail is None else len(tail["hash"])
            w = w if tail is None else {n: np.concatenate([tail[n], x]) for n, x in w.items()}
            n, apart = len(w["hash"]), 1
            found = []
            while apart <= min(FARTHEST, n - 1):
                j = np.arange(max(old, apart), n)
                j = j[w["hash"][j] == w["hash"][j - apart]]
                if not len(j):
                    break
                i = j - apart
                swap = (w["doc_id"][i] > w["doc_id"][j]) | ((w["doc_id"][i] == w["doc_id"][j]) & (w["v"][i] > w["v"][j]))
                x, y = np.where(swap, j, i), np.where(swap, i, j)
                good = w["open"][y] & ((w["doc_id"][x] != w["doc_id"][y]) | (w["v"][x] != w["v"][y]))
                x, y = x[good], y[good]
                shared = np.bitwise_count(w["bits"][x] & w["bits"][y]).sum(1).astype(np.int64)
                good = shared >= LEAST_BITS
                x, y, shared = x[good], y[good], shared[good]
                if tokens is not None and not best:
                    good = can_hold(w["tokens"], w["tokens"], x, y, passage, similarity)
                    x, y, shared = x[good], y[good], shared[good]
                found.append((x, y, shared))
                apart += 1 if apart < NEAR else apart
            if found:
                x, y, shared = (np.concatenate(k) for k in zip(*found))
                met = None
                if best:
                    hold = lambda i, j: np.ones(len(i), bool) if tokens is None else can_hold(w["tokens"], w["tokens"], i, j, passage, similarity)
                    top, all_ = _best_that_hold(x, y, shared, (w["c"][x], w["v"][x], w["doc_id"][x]), hold)
                    met, x, y, shared = np.unique(x[all_]), x[top], y[top], shared[top]
                side = tuple(w[n] for n in names[1:])
                yield _meeting(side, side, x, y, shared, met)
            keep = max(int(np.searchsorted(w["hash"], w["hash"][-1])), n - FARTHEST)
            tail = {n: x[keep:] for n, x in w.items()}

    # A group that meets whole is one task's; the borders of ranges cut only larger ones, which ``all_alike`` goes through again.
    pairs = windows_.where(F.col("n") <= NEAR + 1).repartition("hash").sortWithinPartitions(*order).mapInArrow(run, _schema(MEETING))
    if larger:
        pairs = pairs.union(windows_.where(F.col("n") > NEAR + 1).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _schema(MEETING)))
    return pairs


def _meets(xh: np.ndarray, yh: np.ndarray) -> Iterator[tuple[slice, int, int]]:
    """(some rows of y, first row of x of their hash, the row after the last) by two columns of hashes in order."""
    for h in np.intersect1d(xh, yh):
        first, most, start, stop = (int(np.searchsorted(k, h, side)) for k in (xh, yh) for side in ("left", "right"))
        for at in range(start, stop, 16):
            yield slice(at, min(at + 16, stop)), first, most


def _block_alike(x: pa.Table, y: pa.Table, best: bool, passage: int, similarity: float) -> pa.Table:
    """The pairs (columns ``MEETING``) of a window of x and an open one of y, of a later document, whose bitmaps share ``LEAST_BITS`` and whose tokens can hold a passage.

    With ``best``, one pair at most for each window of y, and the windows of x that one of y meets.
    """
    sides = []
    for t in (x, y):
        t = t.sort_by([(n, "ascending") for n in ("hash", "doc_id", "v", "c")])
        sides.append((t.column("hash").to_numpy(), tuple(t.column(n).to_numpy() for n in ("doc_id", "v", "c")), *_around(t)))
    (xh, xs, xbits, xtokens), (yh, ys, ybits, ytokens) = sides
    (xd, xv, _), (yd, yv, _) = xs, ys
    met = np.zeros(len(xd), bool)
    found, waiting, n = [], [], 0

    def settle() -> None:
        j, i, shared = (np.concatenate(k) for k in zip(*waiting))
        hold = lambda i, j: np.ones(len(i), bool) if xtokens is None else can_hold(xtokens, ytokens, i, j, passage, similarity)
        if best:  # a window of y has all its pairs here
            good, all_ = _best_that_hold(i, j, shared, (i,), hold)
            met[i[all_]] = True
        else:
            good = hold(i, j)
        found.append((j[good], i[good], shared[good]))

    for s, first, most in _meets(xh, yh):
        m = first + int(np.searchsorted(xd[first:most], yd[s][-1], side="right"))  # those after the last of y are later
        shared = np.bitwise_count(ybits[s, None] & xbits[None, first:m]).sum(2, dtype=np.uint16)
        j, i = np.nonzero(shared >= LEAST_BITS)
        shared = shared[j, i].astype(np.int64)
        j, i = j + s.start, i + first
        before = (xd[i] < yd[j]) | ((xd[i] == yd[j]) & (xv[i] < yv[j]))
        waiting.append((j[before], i[before], shared[before]))
        n += int(before.sum())
        if n >= PAIRS:
            settle()
            waiting, n = [], 0
    if waiting:
        settle()
    j, i, shared = (np.concatenate(k) for k in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pa.Table.from_batches([_meeting(xs, ys, i, j, shared, np.flatnonzero(met) if best else None)])


def all_alike(windows_: DataFrame, spans: DataFrame, best: bool, passage: int = PASSAGE, similarity: float = SIMILARITY) -> DataFrame:
    """As ``alike_around``, of every window that ``spans`` leave open with every other one of its hash, for groups that do not meet whole there.

    With ``best``, only the one that shares most bits for each place.
    """
    return _diagonals(_meet_all(windows_, spans, best, passage, similarity), best)


def _meet_all(windows_: DataFrame, spans: DataFrame, best: bool, passage: int, similarity: float) -> DataFrame:
    """The pairs (columns ``MEETING``) of ``all_alike``; with ``best`` a block gives one row a window of each side at most."""
    large = windows_.where(F.col("n") > NEAR + 1).withColumn("blocks", F.expr(f"n div {BLOCK} + 1")).withColumn("own", F.pmod(F.xxhash64("doc_id", "v", "c"), "blocks"))
    # Groups of one block share one with others.
    buckets = large.where("blocks = 1").count() // BLOCK + 1
    large = large.withColumn("bucket", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("hash"), F.lit(buckets))).otherwise(F.col("hash")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    columns = ["doc_id", "v", "c", "tokens" if "tokens" in windows_.columns else "bits"]
    y = materialize(_uncovered(large.drop("open"), spans).where("open").select("bucket", "hash", "blocks", "own", *columns))
    x = large.join(y.select("hash").distinct(), "hash", "left_semi").select("bucket", "hash", F.col("own").alias("bx"), every.alias("by"), *columns)
    y = y.select("bucket", "hash", every.alias("bx"), F.col("own").alias("by"), *columns)
    x, y = (t.select(*(F.col(n).alias(n) for n in t.columns)) for t in (x, y))  # names of their own, as both come from one table
    key = ["bucket", "bx", "by"]

    def blocks(x: pa.Table, y: pa.Table) -> pa.Table:
        return _block_alike(x, y, best, passage, similarity)

    return x.groupBy(*key).cogroup(y.groupBy(*key)).applyInArrow(blocks, _schema(MEETING))


def enough_hashes(hash_: np.ndarray, lx: np.ndarray, rx: np.ndarray, ly: np.ndarray, ry: np.ndarray) -> bool:
    """Whether there is a place in both texts where the windows of ``ENOUGH`` hashes overlap."""
    for start in range(0, len(hash_), 256):
        s = slice(start, start + 256)
        overlap = (lx[s, None] <= rx) & (lx <= rx[s, None]) & (ly[s, None] <= ry) & (ly <= ry[s, None])
        if ((overlap & (hash_[s, None] != hash_)).sum(1) + 1 >= ENOUGH).any():
            return True
    return False


def likely(pairs: DataFrame) -> DataFrame:
    """a, va, b, vb, diagonals of the pairs with a place where hashes enough collide or the words around agree, the most frequent diagonal first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            ends = hits.offsets.to_numpy()
            h, cx, lx, rx, cy, ly, ry = (hits.values.field(n).to_numpy() for n in ("hash", "cx", "lx", "rx", "cy", "ly", "ry"))
            same = hits.values.field("same").to_numpy(zero_copy_only=False)
            kept, lists = [], []
            for i in range(batch.num_rows):
                s = slice(ends[i], ends[i + 1])
                if same[s].any() or enough_hashes(h[s], lx[s], rx[s], ly[s], ry[s]):
                    diagonals, times = np.unique(cx[s].astype(np.int64) - cy[s], return_counts=True)
                    kept.append(i)
                    lists.append(diagonals[np.argsort(-times, kind="stable")])
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in PAIR), pa.array(lists, pa.list_(pa.int64()))], names=[*PAIR, "diagonals"])

    return pairs.mapInArrow(run, "a bigint, va int, b bigint, vb int, diagonals array<bigint>")


def _common(x: np.ndarray, i: int, y: np.ndarray, j: int) -> int:
    """How many tokens agree from x[i] and y[j] on."""
    most, n, step = min(len(x) - i, len(y) - j), 0, 32
    while n < most:
        m = min(step, most - n)
        differ = np.flatnonzero(x[i + n : i + n + m] != y[j + n : j + n + m])
        if len(differ):
            return n + int(differ[0])
        n, step = n + m, step * 4
    return most


def align(x: np.ndarray, y: np.ndarray, diagonals: np.ndarray, passage: int = PASSAGE, similarity: float = SIMILARITY, order: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Passages of y found in x: (start in y, end in y, start in x, end in x, similarity), in words, ends exclusive.

    A token of y is matched where the diagonal at hand goes on, else where it agrees
    longest: on a given diagonal or from its first place in x on. Stretches of one diagonal are joined over small gaps in
    both texts as long as the tokens of the whole stay similar enough. ``order`` is that of x, if it is known.
    """
    order = np.argsort(x, kind="stable") if order is None else order
    at = np.minimum(np.searchsorted(x[order], y), len(x) - 1)
    first = np.where(x[order[at]] == y, order[at], -1)
    match = first.copy()
    i = np.arange(len(y))
    for d in diagonals[::-1]:
        j = i + d
        inside = (j >= 0) & (j < len(x))
        hit = i[inside][x[j[inside]] == y[inside]]
        match[hit] = hit + d
    starts = np.flatnonzero(match >= 0)
    runs, at, before = [], 0, None
    while at < len(y):
        # Go on along the last diagonal where that is possible, so repeats inside x do not break a passage.
        if before is not None and 0 <= at + before < len(x) and x[at + before] == y[at]:
            d = before
        elif match[at] >= 0:
            d = max({int(match[at]) - at, int(first[at]) - at}, key=lambda d: (_common(x, at + d, y, at), -d))
        else:
            k = int(np.searchsorted(starts, at))
            if k == len(starts):
                break
            after = int(starts[k])
            if before is not None:  # the last diagonal may come back first
                stop = min(after, len(x) - before)
                back = np.flatnonzero(x[at + before : stop + before] == y[at:stop]) if 0 <= at + before < stop + before else starts[:0]
                after = at + int(back[0]) if len(back) else after
            at = after
            continue
        n = _common(x, at + d, y, at)
        runs.append((at, at + n, at + d, at + d + n))
        at, before = at + n, d
    need = passage - WIDTH + 1
    out = []

    def close(p: list) -> None:
        if p is not None and min(p[1] - p[0], p[3] - p[2]) >= need:
            out.append((p[0], p[1] + WIDTH - 1, p[2], p[3] + WIDTH - 1, p[4] / (p[1] - p[0] + p[3] - p[2] - p[4])))

    now: list | None = None
    for k, (ys, ye, xs, xe) in enumerate(runs):
        if now is not None and ys - now[1] <= GAP and 0 <= xs - now[3] <= GAP:
            shared = now[4] + ye - ys
            if shared / (ye - now[0] + xe - now[2] - shared) >= similarity:
                now = [now[0], ye, now[2], xe, shared]
                continue
        elif now is not None and ye - ys <= 2 and ye - ys < need and k + 1 < len(runs):
            continue  # a token or two that lie elsewhere do not end a passage
        close(now)
        now = [ys, ye, xs, xe, ye - ys]
    close(now)
    return out


def _chains(of: np.ndarray, runs: tuple[np.ndarray, ...], passage: int, similarity: float) -> tuple[np.ndarray, ...]:
    """(pair, start in y, end in y, start in x, end in x, similarity) of the passages of many pairs, as ``align`` joins its stretches.

    ``runs`` (start in y, end in y, start in x, in tokens) are those of the pairs ``of``, which is in order.
    """
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    count = np.diff(np.append(begins, len(of)))
    order = np.argsort(-count, kind="stable")
    begins, count, need, out = begins[order], count[order], passage - WIDTH + 1, []
    y0, y1, x0, x1, shared = (np.zeros(len(begins), np.int64) for _ in range(5))

    def close(k: np.ndarray) -> None:
        k = k[np.minimum(y1[k] - y0[k], x1[k] - x0[k]) >= need]
        out.append((of[begins[k]], y0[k], y1[k] + WIDTH - 1, x0[k], x1[k] + WIDTH - 1, shared[k] / (y1[k] - y0[k] + x1[k] - x0[k] - shared[k])))

    for step in range(count[0] if len(count) else 0):
        m = int(np.searchsorted(-count, -step, side="left"))  # the pairs with a stretch more
        ys, ye, xs = (r[begins[:m] + step] for r in runs)
        xe, more = xs + ye - ys, ye - ys
        near = (ys - y1[:m] <= GAP) & (xs >= x1[:m]) & (xs - x1[:m] <= GAP) & (step > 0)
        together = shared[:m] + more
        joined = near & (together / np.maximum(ye - y0[:m] + xe - x0[:m] - together, 1) >= similarity)
        passed = ~near & (more <= 2) & (more < need) & (step + 1 < count[:m]) & (step > 0)
        fresh_ = ~joined & ~passed
        if step:
            close(np.flatnonzero(fresh_))
        y0[:m], x0[:m] = np.where(fresh_, ys, y0[:m]), np.where(fresh_, xs, x0[:m])
        y1[:m], x1[:m] = np.where(passed, y1[:m], ye), np.where(passed, x1[:m], xe)
        shared[:m] = np.where(joined, together, np.where(passed, shared[:m], more))
    close(np.arange(len(begins)))
    return tuple(np.concatenate(k) for k in zip(*out))


def align_many(x: np.ndarray, y: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """(row, (start in y, end in y, start in x), rows left out): the stretches of ``align`` of x with each of many rows, whose tokens y end at ``ends``.

    ``places`` has -1 for each of a power of two of slots, into which tokens go by their lower bits; it is the same
    afterwards. A row is left out if it has a token of a slot that x has more than once: only where a token has
    more than one place diagonals matter.
    """
    at = np.arange(len(x), dtype=places.dtype)
    mask = x.dtype.type(len(places) - 1)
    x_slot, y_slot = x & mask, y & mask
    places[x_slot[::-1]] = at[::-1]
    again = x_slot[places[x_slot] != at]
    found = places[y_slot]
    found[x[found] != y] = -1
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    left_out = np.zeros(0, np.int64)
    if len(again):
        places[again] = -2
        left_out = np.unique(row[places[y_slot] == -2])
        if len(left_out):
            found[np.isin(row, left_out)] = -1
    places[x_slot] = -1
    diagonal = np.where(found >= 0, found - np.arange(len(y)), len(x))  # the last for tokens that x does not have
    new = np.append(True, (diagonal[1:] != diagonal[:-1]) | (row[1:] != row[:-1]))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(y))
    hit = found[start] >= 0
    start, stop = start[hit], stop[hit]
    of = row[start]
    base = np.append(0, ends)[of]
    return of, (start - base, stop - base, found[start].astype(np.int64)), left_out


def may_cover(ordered: np.ndarray, y: np.ndarray, left: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether a stretch of y, of whose tokens ``similarity`` or more are among the sorted tokens of x, has one of the words ``left``. A passage is such a stretch."""
    at = np.minimum(np.searchsorted(ordered, y), len(ordered) - 1)
    surplus = np.concatenate([[0], np.cumsum(np.where(ordered[at] == y, 1 - similarity, -similarity))])
    good = np.maximum.accumulate(surplus[:0:-1])[::-1] - np.minimum.accumulate(surplus[:-1]) >= -1e-6
    return bool((good & np.lib.stride_tricks.sliding_window_view(left, WIDTH).any(1)).any())


#: A passage of the document (doc_id, v) that the earlier document (ref_doc_id, ref_v) has.
FOUND = {"doc_id": pa.int64(), "v": pa.int32(), "start_word": pa.int64(), "end_word": pa.int64(), "ref_doc_id": pa.int64(), "ref_start_word": pa.int64(), "ref_end_word": pa.int64(), "similarity": pa.float64()}


def _found(docs: DataFrame, passage: int, similarity: float) -> DataFrame:
    texts = _texts(docs)
    met = neighbours(texts, _borders(docs, passage), passage)
    pairs = materialize(likely(collisions(met)))
    found = materialize(_aligned(pairs, texts, passage, similarity))
    around = materialize(surroundings(materialize(open_groups(met, _spans(found))), texts, passage))
    meeting = materialize(_meet_near(around, True, False, passage, similarity).union(_meet_all(around, _spans(found), True, passage, similarity)))
    places = meeting.select(F.col("b").alias("doc_id"), F.col("vb").alias("v"), F.col("cy").alias("c")).distinct()
    left = around.select("hash", "doc_id", "v", "c", "open").join(places, ["doc_id", "v", "c"], "left_semi")
    return _outermost(found.union(materialize(_aligned_in_groups(left, texts, _spans(found), passage, similarity))))


def _outermost(found: DataFrame) -> DataFrame:
    """The passages that do not lie in another one of their document; of those of one place that of the earliest document."""
    order = [F.col("start_word"), F.desc("end_word"), *(F.col(n) for n in FOUND if n.startswith("ref_")), F.desc("similarity")]
    before = Window.partitionBy("doc_id", "v").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # a document's own passages
    reached = fresh("reached", found)
    return found.withColumn(reached, F.max("end_word").over(before)).where(F.col(reached).isNull() | (F.col("end_word") > F.col(reached))).drop(reached)


def passages(docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, start_word, end_word, ref_doc_id, ref_start_word, ref_end_word, similarity (word positions, ends exclusive)."""
    return _found(docs, passage, similarity).drop("v")


def _aligned(pairs: DataFrame, texts: DataFrame, passage: int, similarity: float) -> DataFrame:
    """The passages (columns ``FOUND``) of pairs (a, va, b, vb, diagonals) of documents."""
    texts = among(texts, "doc_id", pairs.select("a").union(pairs.select("b")).distinct())
    side = lambda n: texts.select(F.col("doc_id").alias(n), F.col("v").alias(f"v{n}"), F.col("text").alias(f"text_{n}"))
    both = pairs.join(side("b"), ["b", "vb"]).join(side("a"), ["a", "va"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.full(SLOTS, -1, np.int32)
        for batch in text_slices(batches, "text_b", 1_000_000):
            x, x_at = shingle_hashes(*word_codes(batch.column("text_a")), WIDTH)
            y, y_at = shingle_hashes(*word_codes(batch.column("text_b")), WIDTH)
            parts, alone = [], []
            for i in range(batch.num_rows):
                own = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                of, runs, left_out = align_many(*own, np.array([len(own[1])]), places)
                parts.append((of + i, *runs))
                if len(left_out):
                    alone += [(i, *p) for p in align(*own, np.array(batch.column("diagonals")[i].as_py()), passage, similarity)]
            of, *runs = (np.concatenate(k) for k in zip(*parts))
            found = [np.append(k, more) for k, more in zip(_chains(of, runs, passage, similarity), zip(*alone))] if alone else _chains(of, runs, passage, similarity)
            at = pa.array(found[0].astype(np.int64))
            b, v, a = (batch.column(n).take(at) for n in ("b", "vb", "a"))
            columns = [b, v, *found[1:3], a, *found[3:]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, FOUND.values())], names=list(FOUND))

    return both.select("a", "b", "vb", "diagonals", "text_a", "text_b").mapInArrow(run, _schema(FOUND))


def _aligned_in_groups(windows_: DataFrame, texts: DataFrame, spans: DataFrame, passage: int, similarity: float) -> DataFrame:
    """The passages (columns ``FOUND``), with a word that ``spans`` leave uncovered, of each document with an open window and every earlier one with a window of its hash, if their bitmaps share ``LEAST_BITS``.

    Groups with the same first document are taken together, as near copies stand in many groups together; their documents meet in blocks. A pair is no row of its own.
    """
    marked = materialize(windows_)
    name = F.struct("doc_id", "v")
    groups = marked.groupBy("hash").agg(F.min(name).alias("first"), F.max(F.when(F.col("open"), name)).alias("last")).where("last > first").select("hash", F.col("first.doc_id").alias("key"))
    listed = materialize(marked.join(groups, "hash").groupBy("key", "doc_id", "v").agg(F.collect_list(F.struct("hash", "c", "open")).alias("w")))  # a text's own windows
    own = among(texts, "doc_id", listed.select("doc_id").distinct()).dropDuplicates(["doc_id", "v"]).join(spans, ["doc_id", "v"], "left")
    own = materialize(own.withColumn("size", F.octet_length("text")))
    sizes = listed.select("key", "doc_id", "v").join(own.select("doc_id", "v", "size"), ["doc_id", "v"]).groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sizes = materialize(sizes.withColumn("blocks", F.greatest(F.expr(f"n div {DOCUMENTS}"), F.expr(f"size div {BYTES}"))))
    # Keys of one block share one with others.
    small = sizes.where("blocks = 0").agg(F.sum("n"), F.sum("size")).first()
    buckets = max((small[0] or 0) * 2 // DOCUMENTS, (small[1] or 0) * 2 // BYTES) + 1
    keys = sizes.select("key", "blocks", F.when(F.col("blocks") == 0, F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(-1 - F.col("key")).alias("bucket"))
    dealt = listed.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("doc_id", "v"), F.col("blocks") + 1)).join(own, ["doc_id", "v"])
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks")))
    x = dealt.select("bucket", F.col("own").alias("bx"), every.alias("by"), "doc_id", "v", "w", "text")
    y = dealt.where(F.exists("w", lambda w: w["open"])).select("bucket", every.alias("bx"), F.col("own").alias("by"), "doc_id", "v", "w", "text", "spans")
    x, y = (t.select(*(F.col(n).alias(n) for n in t.columns)) for t in (x, y))  # names of their own, as both come from one table

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        found = _block_passages(x, y, passage, similarity) if x.num_rows and y.num_rows else [()] * len(FOUND)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(found, FOUND.values())], names=list(FOUND))

    key = ["bucket", "bx", "by"]
    return x.groupBy(*key).cogroup(y.groupBy(*key)).applyInArrow(run, _schema(FOUND))


def _side(t: pa.Table, passage: int, only_open: bool) -> tuple:
    """(doc_id, v, tokens, begins, (hash, row, c, bitmap) of the windows) of the documents of a block, in order; with ``only_open``, of open windows."""
    tokens, begins = shingle_hashes(*word_codes(t.column("text").combine_chunks()), WIDTH)
    lists = t.column("w").combine_chunks()
    inner = lists.flatten()
    row = np.repeat(np.arange(t.num_rows), np.asarray(lists.value_lengths()))
    keep = inner.field("open").to_numpy(zero_copy_only=False) if only_open else np.ones(len(inner), bool)
    hash_, row, c = inner.field("hash").to_numpy()[keep], row[keep], inner.field("c").to_numpy()[keep]
    order = np.lexsort((row, hash_))
    hash_, row, c = hash_[order], row[order], c[order]
    reach = passage - WIDTH
    bits = [np.zeros((0, BITS // 64), np.uint64)]
    for start in range(0, len(row), 4096):
        s = slice(start, start + 4096)
        at = begins[row[s], None] + c[s, None] + np.arange(-reach, reach + 1)
        bits.append(_bitmap(_short(tokens, at, (at >= begins[row[s], None]) & (at < begins[row[s] + 1, None]))[1], BITS))
    return t.column("doc_id").to_numpy(), t.column("v").to_numpy(), tokens, begins, (hash_, row, c, np.concatenate(bits))


def _block_passages(x: pa.Table, y: pa.Table, passage: int, similarity: float) -> list[list]:
    """The columns ``FOUND`` of a block of ``_aligned_in_groups``."""
    x, y = (t.sort_by([(n, "ascending") for n in ("doc_id", "v")]) for t in (x, y))
    (xd, xv, xt, xb, (xh, xr, xc, xbits)), (yd, yv, yt, yb, (yh, yr, yc, ybits)) = _side(x, passage, False), _side(y, passage, True)
    order = np.lexsort((np.append(xv, yv), np.append(xd, yd)))
    d, v = np.append(xd, yd)[order], np.append(xv, yv)[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(0, (d[1:] != d[:-1]) | (v[1:] != v[:-1])))
    x_rank, y_rank = rank[: len(xd)][xr], rank[len(xd) :][yr]

    meet = np.zeros((len(xd), len(yd)), bool)
    for s, first, most in _meets(xh, yh):
        m = first + int(np.searchsorted(x_rank[first:most], y_rank[s][-1]))  # those after the last of y are later
        j, i = np.nonzero(np.bitwise_count(ybits[s, None] & xbits[None, first:m]).sum(2, dtype=np.uint16) >= LEAST_BITS)
        before = x_rank[i + first] < y_rank[j + s.start]
        meet[xr[i[before] + first], yr[j[before] + s.start]] = True

    _, ids = np.unique(np.append(xt, yt), return_inverse=True)
    ids = ids.astype(np.int32)
    xi, yi = ids[: len(xt)], ids[len(xt) :]
    places = np.full(1 << len(ids).bit_length(), -1, np.int32)
    words = np.append(0, np.cumsum(np.diff(yb) + WIDTH - 1))  # of y's documents
    covered = np.zeros(words[-1], bool)
    for j, known in enumerate(y.column("spans").to_pylist()):
        for k in known or ():
            covered[words[j] + k["start_word"] : words[j] + k["end_word"]] = True
    (x_of, x_from), (y_of, y_from) = ((np.argsort(k, kind="stable"), np.append(0, np.cumsum(np.bincount(k, minlength=m)))) for k, m in ((xr, len(xd)), (yr, len(yd))))
    out: list[tuple] = []
    waiting, alone, n = [], [], 0

    def tell() -> None:
        """Of the passages of the pairs that wait, those with a word not told yet."""
        told = []
        if waiting:
            of, ys, ye, xs, i, j = (np.concatenate(k) for k in zip(*waiting))
            pair, *p = _chains(of, (ys, ye, xs), passage, similarity)
            at = np.searchsorted(of, pair)
            i, j = i[at], j[at]
            told = list(zip(i, j, *p))
        for i, j in alone:
            # Without a word left that a passage could have, the pair is not aligned.
            x_, y_ = xt[xb[i] : xb[i + 1]], yt[yb[j] : yb[j + 1]]
            own = np.argsort(x_, kind="stable")
            if may_cover(x_[own], y_, ~covered[words[j] : words[j + 1]], similarity):
                wx, wy = x_of[x_from[i] : x_from[i + 1]], y_of[y_from[j] : y_from[j + 1]]
                _, a, b = np.intersect1d(xh[wx], yh[wy], return_indices=True)
                told += [(i, j, *p) for p in align(x_, y_, np.unique(xc[wx[a]].astype(np.int64) - yc[wy[b]]), passage, similarity, own)]
        if told:
            i, j, ys, ye, xs, xe, alike = (np.array(k) for k in zip(*told))
            open_ = np.append(0, np.cumsum(~covered))
            order = np.lexsort((ys, j, i, ys - ye))  # the longest first, of those of one length that of the earliest document
            for k in order[open_[words[j[order]] + ye[order]] > open_[words[j[order]] + ys[order]]]:
                s = slice(words[j[k]] + ys[k], words[j[k]] + ye[k])
                if not covered[s].all():
                    covered[s] = True
                    out.append((yd[j[k]], yv[j[k]], ys[k], ye[k], xd[i[k]], xs[k], xe[k], alike[k]))
        waiting.clear()
        alone.clear()

    pairs = 0
    for i in np.flatnonzero(meet.any(1)):
        j = np.flatnonzero(meet[i])
        ends = np.cumsum(yb[j + 1] - yb[j])
        of, runs, left_out = align_many(xi[xb[i] : xb[i + 1]], np.concatenate([yi[yb[k] : yb[k + 1]] for k in j]), ends, places)
        waiting.append((of + pairs, *runs, np.full(len(of), i), j[of]))
        alone += [(i, k) for k in j[left_out]]
        pairs, n = pairs + len(j), n + len(of) + len(left_out)
        if n >= RUNS:
            tell()
            n = 0
    tell()
    return [list(k) for k in zip(*out)] if out else [[]] * len(FOUND)


def remove_passages(docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without passages that an earlier document has; one of which nothing is left goes. Columns stay."""
    name, v = fresh("spans", docs), fresh("v", docs)
    spans = _found(docs, passage, similarity).groupBy("doc_id", F.col("v").alias(v)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(name))
    spans = materialize(spans)
    # A document has at most one row of spans; the key is the id with the text's hash, null where either is.
    marked = docs.withColumn(v, F.when(F.col("text").isNotNull(), _version()))
    touched = marked.join(spans, ["doc_id", v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts = []
            for value, spans in zip(batch.column("text"), batch.column(name).to_pylist()):
                data = value.as_py().encode("utf-8")
                _, _, starts, ends = word_hashes(pa.array([data], pa.large_binary()))
                kept, at = [], 0
                for start, stop in sorted((s["start_word"], s["end_word"]) for s in spans):
                    # from the passage's first word up to the word after it
                    begin, end = int(starts[start]), int(starts[stop]) if stop < len(starts) else len(data)
                    if begin > at:
                        kept.append(data[at:begin])
                    at = max(at, end)
                kept.append(data[at:])
                texts.append(b"".join(kept).decode("utf-8"))
            arrays = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n in batch.schema.names if n != name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cut = touched.select(*docs.columns, name).mapInArrow(run, fields).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return marked.join(spans, ["doc_id", v], "left_anti").select(*docs.columns).union(cut)
