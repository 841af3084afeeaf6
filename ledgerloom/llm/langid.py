"""Language identification by unigram piece models, marginalised over every segmentation.

A fixed public vocabulary gives the pieces; each language has a probability for
every piece. The score of a text under a language is the sum, over all ways to
cut the text into pieces, of the product of the pieces' probabilities, found by
the forward algorithm. A piece holds the word-start mark only at its start, so
every cut passes through each word's start and a text's sum is the product of
its words' sums; a slice of texts scores each distinct word once.

Fitting is expectation maximisation: the forward-backward pass gives each piece's
expected count in every (language, word), Spark sums them, and a few thousand
numbers a language come back. It learns from a sample of ``train_docs`` documents
a language at most, in expectation, chosen by a hash of the id: this bound is a
parameter. The counts behind it cover all documents. Characters outside the
vocabulary are spelled in byte pieces.

Rows: a null text, an empty one, or one without letters is ``und`` with score 0.
Equal posteriors go to the language that comes first by name. A null
language or id is never learned from; with nothing to learn from every
text is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices

TRAIN_DOCS = 400
ROUNDS = 2
SMOOTHING = 0.05
LONG_WORD = 32
SCALE = 1000.0
HASH = 0x9E3779B97F4A7C15
SLICE_BYTES = 4_000_000
MARK = "▁"
_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str | int, int], int]:
    """piece -> index, and the longest piece; pieces with the mark anywhere but at the start are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and MARK not in piece[1:]:
            pieces[piece] = len(pieces)
    for b in range(256):
        pieces[b] = len(pieces)  # byte pieces are keyed by their byte, so no text can spell one
    return pieces, max(len(p) for p in pieces if isinstance(p, str))


def arcs(word: str, pieces: dict[str, int], longest: int) -> list[list[tuple[int, tuple[int, ...]]]]:
    """For every end position of the marked word: (start, indexes of the piece or of the byte pieces) that end there."""
    text = MARK + word
    out: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(len(text) + 1)]
    for start in range(len(text)):
        for stop in range(start + 1, min(len(text), start + longest) + 1):
            if (i := pieces.get(text[start:stop])) is not None:
                out[stop].append((start, (i,)))
        if text[start] not in pieces:
            out[start + 1].append((start, tuple(pieces[b] for b in text[start].encode("utf-8"))))
    return out


def log_marginal(word: str, pieces: dict[str, int], longest: int, probs: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations of one word, for each language; scaled at every step, so no length underflows."""
    n = probs.shape[1]
    alpha, scales = [np.ones(n)], [np.zeros(n)]
    for ends in arcs(word, pieces, longest)[1:]:
        top = scales[-1]
        total = np.zeros(n)
        for start, ids in ends:
            total = total + np.exp(scales[start] - top + sum(np.log(probs[i]) for i in ids))
        alpha.append(np.ones(n))
        scales.append(top + np.log(np.maximum(total, 1e-300)))
    return scales[-1]


class Scorer:
    """The forward algorithm over many words at once.

    Every piece that starts at a position is found by a rolling hash of the
    vocabulary's prefixes; arcs of one length and one end position touch each
    word once, so a step is a gather, a product and a scatter over all words.
    A piece's probability is scaled by ``SCALE`` to the power of its length:
    all segmentations of a word share the factor, which is taken off at the end.
    Words that are long or need byte pieces go through ``log_marginal``.
    """

    def __init__(self, model: "LanguageModel"):
        self.pieces, self.longest = vocabulary(model.path)
        self.probs = model.probs
        prefixes: dict[int, int] = {}
        for piece, i in self.pieces.items():
            if isinstance(piece, int):
                continue
            h = 0
            for k, c in enumerate(piece):
                h = (h * HASH + ord(c) + 1) % (1 << 64)
                last = k == len(piece) - 1
                if last or h not in prefixes:
                    prefixes[h] = i if last else prefixes.get(h, -1)
        self.keys = np.array(sorted(prefixes), np.uint64)
        self.ids = np.array([prefixes[k] for k in self.keys.tolist()], np.int32)

    def score(self, words: list[str]) -> np.ndarray:
        """log of each word's sum (row) under each language (column)."""
        n, langs = len(words), self.probs.shape[1]
        lengths = np.fromiter(map(len, words), np.int64, n) + 1
        chars = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        starts = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(n), lengths)
        end = np.repeat(starts + lengths, lengths)
        slow = lengths > LONG_WORD
        steps = []
        live, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for length in range(1, self.longest + 1):
            inside = live + length <= end[live]
            live, h = live[inside], h[inside]
            if not len(live):
                break
            with np.errstate(over="ignore"):
                h = h * np.uint64(HASH) + chars[live + length - 1]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[at] == h
            if length == 1:
                alone = np.zeros(len(chars), bool)
                alone[live[known]] = self.ids[at[known]] >= 0
                slow[word[~alone]] = True
            live, h, at = live[known], h[known], at[known]
            piece = self.ids[at]
            arc = np.flatnonzero((piece >= 0) & ~slow[word[live]])
            begin = live[arc]
            stop = (begin + length - starts[word[begin]]).astype(np.uint8)
            order = np.argsort(stop, kind="stable")
            steps.append((length, begin[order], piece[arc][order], np.searchsorted(stop[order], np.arange(LONG_WORD + 2))))
        alpha = np.zeros((len(chars) + n, langs))  # a word has one place more than marks and letters
        alpha[starts + np.arange(n)] = 1.0
        scaled = {length: self.probs * SCALE**length for length, *_ in steps}
        for stop in range(1, LONG_WORD + 1):
            for length, begin, piece, cuts in steps:
                a, b = cuts[stop], cuts[stop + 1]
                if a < b:
                    place = begin[a:b] + word[begin[a:b]]
                    alpha[place + length] += alpha[place] * scaled[length][piece[a:b]]
        with np.errstate(divide="ignore"):
            out = np.log(alpha[starts + lengths + np.arange(n)]) - (lengths * math.log(SCALE))[:, None]
        for i in np.flatnonzero(slow):
            out[i] = log_marginal(words[i], self.pieces, self.longest, self.probs)
        return out


def expected_counts(word: str, pieces: dict[str, int], longest: int, prob: np.ndarray) -> dict[int, float]:
    """Expected uses of each piece in one word under one language, by forward and backward sums."""
    table = arcs(word, pieces, longest)
    n = len(table)
    alpha, beta = np.full(n, -np.inf), np.full(n, -np.inf)
    alpha[0] = beta[n - 1] = 0.0
    score = [[(start, ids, sum(math.log(prob[i]) for i in ids)) for start, ids in ends] for ends in table]
    for end in range(1, n):
        for start, _, s in score[end]:
            alpha[end] = np.logaddexp(alpha[end], alpha[start] + s)
    for end in range(n - 1, 0, -1):
        for start, _, s in score[end]:
            beta[start] = np.logaddexp(beta[start], beta[end] + s)
    out: dict[int, float] = {}
    for end in range(1, n):
        for start, ids, s in score[end]:
            weight = math.exp(alpha[start] + s + beta[end] - alpha[n - 1])
            for i in ids:
                out[i] = out.get(i, 0.0) + weight
    return out


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class LanguageModel:
    def __init__(self, languages: list[str], path: str, probs: np.ndarray):
        self.languages, self.path, self.probs = languages, path, probs  # probs: piece by language


def fit(docs: DataFrame, path: str, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Learn from the text and language of documents that are not held out."""
    pieces, longest = vocabulary(path)
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], path, np.zeros((len(pieces), 0)))
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, train_docs / counts[lang])))))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52)) < share[F.col("lang")])
    words = sample.select("lang", F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").groupBy("lang", "word").count().persist()
    probs = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    at = {lang: i for i, lang in enumerate(languages)}
    try:
        for _ in range(rounds):
            now = probs

            def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
                table = vocabulary(path)
                sums: dict[tuple[int, int], float] = {}
                for batch in batches:
                    for lang, word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                        k = at[lang]
                        for i, w in expected_counts(word, *table, now[:, k]).items():
                            sums[k, i] = sums.get((k, i), 0.0) + n * w
                yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in sums], pa.int32()), "i": pa.array([i for _, i in sums], pa.int32()), "w": pa.array(list(sums.values()), pa.float64())})

            rows = words.mapInArrow(expect, "k int, i int, w double").groupBy("k", "i").agg(F.sum("w").alias("w")).toPandas()  # at most pieces x languages
            probs = np.full((len(pieces), len(languages)), SMOOTHING)
            probs[rows["i"].to_numpy(), rows["k"].to_numpy()] += np.round(rows["w"].to_numpy(), 6)
            probs /= probs.sum(0)
    finally:
        words.unpersist()
    return LanguageModel(languages, path, probs)


def predict(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The input's columns and two more, which replace any of these names: the language of most posterior mass, and that mass."""
    kept = docs.drop(lang, score)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # pieces x languages numbers, whatever the size of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model.languages else None
        for batch in text_slices(batches, "text", SLICE_BYTES):
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            texts = batch.column("text").fill_null("")
            lists = pc.utf8_split_whitespace(texts)
            words = pc.dictionary_encode(lists.flatten())
            if scorer is not None and len(words):
                table = scorer.score(words.dictionary.to_pylist())
                codes = words.indices.to_numpy()
                ends = np.cumsum(pc.list_value_length(lists).to_numpy())
                for i, (text, stop) in enumerate(zip(texts, ends.tolist())):
                    start = int(ends[i - 1]) if i else 0
                    if start < stop and _LETTER.search(text.as_py()):
                        total = table[codes[start:stop]].sum(0)
                        weight = np.exp(total - total.max())
                        best = int(np.argmax(total))
                        names[i], scores[i] = model.languages[best], float(weight[best] / weight.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang, score])
        pa.default_memory_pool().release_unused()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{lang}` string, `{score}` double")


def identify(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return predict(docs.select("doc_id", "text"), fit(docs, path)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
