"""ISO base media containers: write a payload as samples, and read columns off a file without decoding its samples.

Reading walks the nested boxes, decodes the sample tables and gives, for the
first track, the codec, the duration, every sample's byte range and the merged
byte ranges of the keyframes. Sample bytes are touched only when asked for.

Rows: a null payload counts as empty (a text still gets its padding); bytes that
are not a readable container (damaged, of no tables, or of fragments) give null columns and the reason in
``error``; of several tracks the first is read. ``doc_id`` may be null or repeated; other columns of the texts are ignored.
Equal payloads give equal files: nothing in them depends on time or place.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 1024  # bytes of 8-bit samples in one access unit
KEY_EVERY = 8  # every so many access units a keyframe
PER_CHUNK = 4  # access units in a chunk
RATE = 8000
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf")


class ContainerError(ValueError):
    pass


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def write_media(payload: bytes) -> bytes:
    """The payload as one track of raw 8-bit samples: ftyp, moov with its sample tables, mdat."""
    n = -(-len(payload) // UNIT)
    sizes = np.full(n, UNIT, ">u4")
    if n and len(payload) % UNIT:
        sizes[-1] = len(payload) % UNIT
    chunks = np.arange(0, n, PER_CHUNK, dtype=np.int64) * UNIT
    runs = [(n, UNIT)] if n and int(sizes[-1]) == UNIT else ([(n - 1, UNIT)] if n > 1 else []) + ([(1, int(sizes[-1]))] if n else [])
    full, rest = divmod(n, PER_CHUNK)
    groups = ([(1, PER_CHUNK)] if full else []) + ([(full + 1, rest)] if rest else [])
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp41")

    def moov(base: int) -> bytes:
        wide = base + len(payload) > 0xFFFFFFFF
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">I", len(runs)), *(struct.pack(">II", *r) for r in runs)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(groups)), *(struct.pack(">III", *g, 1) for g in groups)),
            _full(b"stsz", struct.pack(">II", 0, n), sizes.tobytes()),
            _full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), (chunks + base).astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), stbl)
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0))
        hdlr = _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"samples\0")
        matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
        tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, struct.pack(">II", 0, 0))
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, len(payload), 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = b"" if len(payload) + 8 <= 0xFFFFFFFF else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    head = head or struct.pack(">I4s", len(payload) + 8, b"mdat")
    base = len(ftyp) + len(moov(0)) + len(head)
    return b"".join((ftyp, moov(base), head, payload))


@dataclass
class Track:
    codec: str
    handler: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keyframes: np.ndarray  # indexes of the sync samples

    def ranges(self, samples: np.ndarray) -> np.ndarray:
        """(offset, length) of the samples in file order, adjoining ones merged."""
        at = samples[np.argsort(self.offsets[samples], kind="stable")]
        starts, ends = self.offsets[at], self.offsets[at] + self.sizes[at]
        if not len(at):
            return np.zeros((0, 2), np.int64)
        first = np.flatnonzero(np.concatenate([[True], starts[1:] != ends[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        return np.stack([starts[first], ends[last] - starts[first]], 1)


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin of the body, end) of the boxes in a range; 64-bit sizes and "to the end" are understood."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ContainerError("box header is cut off")
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ContainerError(f"box {kind!r} leaves its parent")
        yield kind, body, stop
        start = stop


def read_track(data: bytes) -> Track:
    """The first track's tables; raises ContainerError for bytes that hold none."""
    found: dict[bytes, tuple[int, int]] = {}
    todo = [(0, len(data))]
    while todo:
        for kind, body, stop in boxes(data, *todo.pop()):
            if kind == b"trak" and kind in found:
                continue  # the first track only
            if kind in NESTED:
                todo.append((body, stop))
            found.setdefault(kind, (body, stop))
    for kind in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc"):
        if kind not in found:
            raise ContainerError(f"no {kind.decode()} box")

    def numbers(kind: bytes, skip: int, columns: int, width: str = ">u4") -> np.ndarray:
        body, stop = found[kind]
        count = struct.unpack_from(">I", data, body + skip - 4)[0]
        size = count * columns * int(width[-1])
        if body + skip + size > stop:
            raise ContainerError(f"table {kind.decode()} is cut off")
        return np.frombuffer(data, width, count * columns, body + skip).astype(np.int64).reshape(count, columns)

    body = found[b"mdhd"][0]
    long_form = data[body] == 1
    timescale, duration = struct.unpack_from(">IQ" if long_form else ">II", data, body + (20 if long_form else 12))
    handler = data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12].decode("latin-1")
    codec = data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16].decode("latin-1")
    if b"stsz" in found:
        same, count = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
        if same * count > len(data):
            raise ContainerError("samples leave the file")
        sizes = np.full(count, same, np.int64) if same else numbers(b"stsz", 12, 1)[:, 0]
    else:
        raise ContainerError("no stsz box")
    if b"co64" in found:
        chunks = numbers(b"co64", 8, 1, ">u8")[:, 0]
    elif b"stco" in found:
        chunks = numbers(b"stco", 8, 1)[:, 0]
    else:
        raise ContainerError("no chunk offsets")
    stsc = numbers(b"stsc", 8, 3)
    if len(chunks) and not len(stsc):
        raise ContainerError("no sample-to-chunk entries")
    spans = np.diff(np.concatenate([stsc[:, 0], [len(chunks) + 1]])) if len(stsc) else np.zeros(0, np.int64)
    if (spans < 0).any() or int(np.dot(spans, stsc[:, 1])) != len(sizes):
        raise ContainerError("sample tables disagree")
    in_chunk = np.repeat(stsc[:, 1], spans)
    chunk = np.repeat(np.arange(len(chunks)), in_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(in_chunk) - in_chunk
    offsets = chunks[chunk] + before - np.repeat(before[first[in_chunk > 0]], in_chunk[in_chunk > 0])
    keys = numbers(b"stss", 8, 1)[:, 0] - 1 if b"stss" in found else np.arange(len(sizes))
    stts = numbers(b"stts", 8, 2)
    if not duration:
        duration = int(np.dot(stts[:, 0], stts[:, 1]))
    if len(sizes) and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0):
        raise ContainerError("samples leave the file")
    if len(keys) and not 0 <= int(keys.min()) <= int(keys.max()) < len(sizes):
        raise ContainerError("a keyframe is no sample")
    return Track(codec, handler, timescale, duration, offsets, sizes, keys)


DESCRIBED = {"codec": pa.string(), "duration_s": pa.float64(), "n_samples": pa.int64(), "keyframes": pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))}


def _described(track: Track) -> tuple:
    """The columns ``DESCRIBED`` of a track."""
    keyframes = [{"offset": a, "length": n} for a, n in track.ranges(track.keyframes).tolist()]
    return track.codec, track.duration / track.timescale if track.timescale else None, len(track.sizes), keyframes


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """Add codec, duration_s, n_samples, keyframes (array of offset and length) and error; payloads are not decoded."""
    added = {"codec": "string", "duration_s": "double", "n_samples": "bigint", "keyframes": "array<struct<offset:bigint,length:bigint>>", "error": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(media):
                try:
                    rows.append((*_described(read_track(value.as_py() or b"")), None))
                except (ContainerError, struct.error) as e:
                    rows.append((None, None, None, None, str(e)))
            columns = list(zip(*rows)) if rows else [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (*DESCRIBED.values(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *added])

    kept = df.drop(*(c for c in added if c in df.columns))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, {', '.join(f'{k} {v}' for k, v in added.items())}")


def padded(text: Column) -> Column:
    """UTF-8 of the text (null: empty) with zero bytes up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return F.concat(raw, F.substring(F.lit(bytes(64)), F.lit(1), F.when((F.length(raw) % 64 == 0) & (F.length(raw) > 0), 0).otherwise(64 - F.length(raw) % 64).cast("int")))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media: each text's padded payload stored as a container."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [write_media(p.as_buffer().to_pybytes()) for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), padded(F.col("text")).alias("payload"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def digest_media(stored: DataFrame) -> DataFrame:
    """Read the stored bytes back through the sample tables: digests of payload and file, a feature of the track, and its columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                data = value.as_buffer().to_pybytes()
                track = read_track(data)
                payload = b"".join(data[a : a + n] for a, n in track.ranges(np.arange(len(track.sizes))).tolist())
                keys = track.ranges(track.keyframes)
                feature = f"{track.codec.strip()}/{track.handler}/{track.timescale} duration={track.duration} samples={len(track.sizes)} keyframes={len(track.keyframes)} key_bytes={int(keys[:, 1].sum())} mean={np.frombuffer(payload, np.uint8).mean():.6f}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, *_described(track)))
            columns = list(zip(*rows)) if rows else [()] * 10
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *DESCRIBED.values())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *DESCRIBED]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_bytes", *names])

    return stored.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_s double, n_samples bigint, keyframes array<struct<offset:bigint,length:bigint>>")
