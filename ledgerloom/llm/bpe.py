"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. After each byte the transducer keeps every *open* hypothesis: a place
where the encoding of the prefix may end, the trie node of the bytes read since,
and the tokens not yet emitted. A token boundary is valid when the new token may
stand beside the one before it, that is when merging their joined bytes gives
back exactly these two; for a merge table that rebuilds its own tokens this
local test makes the encoding of every prefix unique. Tokens that all open
hypotheses share are emitted, so output lags input by at most the longest token.
The sets of hypotheses are the transducer's states; they and their transitions
are made when first needed and kept in a bounded table.

Decoding walks the ids once and holds back only the bytes of a UTF-8 character
that is not yet complete.

Rows: a null text counts as empty and encodes to no tokens. Repeated rows and ids give
repeated results, a null id a null one; other columns of the input are ignored unless
asked for, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

MAX_STATES = 200_000
MAX_CACHED_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Compiled merges; ``encode`` maps the bytes of one pre-token to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._child: dict[int, int] = {}
        self._token = [-1]
        parents = set()
        for token, rank in ranks.items():
            node = 0
            for b in token:
                parents.add(node)
                key = node << 8 | b
                if (after := self._child.get(key)) is None:
                    after = self._child[key] = len(self._token)
                    self._token.append(-1)
                node = after
            self._token[node] = rank
        self._inner = parents
        self._beside: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self._ids, self._states, self._step = {start: 0}, [start], {}

    def _merged(self, data: bytes) -> list[int]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        if (known := self._beside.get((left, right))) is None:
            if len(self._beside) > 2_000_000:
                self._beside.clear()
            known = self._beside[left, right] = self._merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition of a state on a byte: (next state, tokens emitted)."""
        if len(self._states) > self.max_states:
            kept = self._states[state]
            self._reset()
            state = self._intern(kept)
        after, ended = [], None
        for node, last, pending in self._states[state]:
            node = self._child.get(node << 8 | byte)
            if node is None:
                continue
            token = self._token[node]
            if ended is None and token >= 0 and (last < 0 or self._compatible(last, token)):
                ended = (0, token, (*pending, token))
            if node in self._inner:
                after.append((node, last, pending))
        if ended is None:
            raise ValueError("the merge table does not rebuild its own tokens")
        after.append(ended)
        shared = min(len(h[2]) for h in after)
        for i in range(shared):
            if any(h[2][i] != ended[2][i] for h in after):
                shared = i
                break
        emitted = ended[2][:shared]
        reached = self._intern(tuple((node, last, pending[shared:]) for node, last, pending in after))
        self._step[state << 8 | byte] = out = (reached, emitted)
        return out

    def _intern(self, state: tuple) -> int:
        if (i := self._ids.get(state)) is None:
            i = self._ids[state] = len(self._states)
            self._states.append(state)
        return i

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        state, out = 0, []
        for byte in data:
            state, emitted = self._step.get(state << 8 | byte) or self._advance(state, byte)
            if emitted:
                out.extend(emitted)
        out.extend(self._states[state][-1][2])
        return out


def _utf8_states() -> tuple[dict[tuple[int, int], int], int]:
    """UTF-8 as a state machine over bytes: state 0 is between characters; the last state is an error."""
    step: dict[tuple[int, int], int] = {}
    ranges = {  # state: (first byte, last byte, next state), from the Unicode standard's table of well-formed sequences
        0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
        1: [(0x80, 0xBF, 0)],
        2: [(0x80, 0xBF, 1)],
        3: [(0x80, 0xBF, 2)],
        4: [(0xA0, 0xBF, 1)],
        5: [(0x80, 0x9F, 1)],
        6: [(0x90, 0xBF, 2)],
        7: [(0x80, 0x8F, 2)],
    }
    for state, rows in ranges.items():
        for low, high, after in rows:
            for b in range(low, high + 1):
                step[state, b] = after
    return step, 8


class StreamingDecoder:
    """Token ids to bytes; ``feed`` returns whole characters only and keeps an unfinished one for the next call."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self._vocabulary = bytes_of
        self._step, self._error = _utf8_states()
        size = max(bytes_of) + 1
        self._whole = _whole_tokens(bytes_of, size, self._run)
        self.reset()

    def reset(self) -> None:
        self._state, self._held, self.valid = 0, b"", True

    def _run(self, state: int, data: bytes) -> tuple[int, int]:
        """(state after the bytes, how many of them end the last whole character)."""
        done = 0
        for i, b in enumerate(data):
            state = self._step.get((state, b), self._error)
            if state == self._error:  # a byte that fits nothing stands for itself; go on from there
                self.valid, state, done = False, self._step.get((0, b), 0), i + 1 if (0, b) not in self._step or self._step[0, b] == 0 else i
            elif state == 0:
                done = i + 1
        return state, done

    def feed(self, ids: np.ndarray) -> bytes:
        data = self._held + b"".join(map(self._vocabulary.__getitem__, ids.tolist()))
        partial = np.flatnonzero(~self._whole[ids])
        if not len(partial) and self._state == 0:
            self._held = b""
            return data
        # A token of whole characters keeps state 0, so only the runs around partial tokens are walked.
        at = 0
        while at < len(ids):
            if self._state == 0:
                k = np.searchsorted(partial, at)
                if k == len(partial):
                    break
                at = int(partial[k])
            self._state = self._run(self._state, self._vocabulary[int(ids[at])])[0]
            at += 1
        if self._state == 0:
            self._held = b""
            return data
        keep = 1
        while keep < min(4, len(data)) and 0x80 <= data[-keep] < 0xC0:
            keep += 1
        self._held = data[-keep:]
        return data[:-keep]

    def flush(self) -> bytes:
        if self._held:
            self.valid = False
        out, self._held, self._state = self._held, b"", 0
        return out


def _whole_tokens(bytes_of: dict[int, bytes], size: int, run) -> np.ndarray:
    whole = np.zeros(size, bool)
    for i, token in bytes_of.items():
        try:
            token.decode("utf-8")
            whole[i] = True
        except UnicodeDecodeError:
            pass
    return whole


class _Pieces(dict):
    """Pre-token -> its ids as little-endian bytes, filled through the transducer.

    When full, its pieces become the older half and those used again come back.
    """

    def __init__(self, transducer: Transducer):
        super().__init__()
        self._transducer, self._older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        out = self._older.get(piece)
        if out is None:
            out = np.array(self._transducer.encode(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= MAX_CACHED_PIECES:
                self._older = dict(self)
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def _codec(ranks_path: str, pattern: str):
    transducer = Transducer(read_ranks(ranks_path))
    return _Pieces(transducer), StreamingDecoder(transducer.bytes_of), regex.compile(pattern)


def encode_text(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    pieces, _, split = _codec(ranks_path, pattern)
    return np.frombuffer(b"".join(map(pieces.__getitem__, split.findall(text))), "<u4")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Ids of every whole text: the kept columns and ``ids`` (array of long)."""
    keep = list(keep)
    schema = pa.schema([("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_text(t or "", ranks_path, pattern).astype(np.int64) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ids, schema.field("ids").type)], names=[*keep, "ids"])

    chosen = docs.select(*keep, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in keep)
    return chosen.mapInArrow(run, f"{fields}, ids array<bigint>")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 65_536) -> DataFrame:
    """Encode every text, stream the ids back through the decoder, and return digests of both.

    doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit values), decoded_sha256.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder, _ = _codec(ranks_path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column("text"):
                ids = encode_text(value.as_py() or "", ranks_path, pattern)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.data).hexdigest())
                decoder.reset()
                seen = hashlib.sha256()
                for at in range(0, len(ids), chunk):
                    seen.update(decoder.feed(ids[at : at + chunk]))
                seen.update(decoder.flush())
                of_bytes.append(seen.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
