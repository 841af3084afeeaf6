import itertools
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid

PIECES = P.path("piece_bpe_32k.model")
EN = "the of and to in that is was for with his they this have from one had word but not what all were when".split()
FR = "le la les de des un une et est dans que qui pour pas sur au avec son plus par mais nous vous tout elle".split()


def rows(n=120):
    rng = random.Random(5)
    return [(i, " ".join(rng.choices(EN if i % 2 else FR, k=20)), "en" if i % 2 else "fr") for i in range(n)]


def brute(word, prob, pieces, longest):
    """Sum over every segmentation, written out."""
    text = langid.MARK + word
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[last:i])
                last = i
        parts.append(text[last:])
        p = 1.0
        for part in parts:
            if part in pieces:
                p *= prob[pieces[part]]
            elif len(part) == 1:
                p *= math.prod(prob[pieces[b]] for b in part.encode())
            else:
                p = 0.0
        total += p
    return math.log(total)


def test_forward_is_the_sum_over_segmentations():
    pieces, longest = langid.vocabulary(PIECES)
    probs = np.random.default_rng(1).random((len(pieces), 3))
    probs /= probs.sum(0)
    scorer = langid.Scorer(langid.LanguageModel(["a", "b", "c"], PIECES, probs))
    words = ["the", "word", "naïve", "a", "🤷x", "<0x41>", "▁a"]
    got = scorer.score(words)
    for word, row in zip(words, got):
        for k in range(3):
            want = brute(word, probs[:, k], pieces, longest)
            assert row[k] == pytest.approx(want, rel=1e-9) and langid.log_marginal(word, pieces, longest, probs)[k] == pytest.approx(want, rel=1e-9)


def test_expected_counts_cover_a_whole_long_word():
    pieces, longest = langid.vocabulary(PIECES)
    counts = langid.expected_counts("a" * 600 + "z" * 300, pieces, longest, np.full(len(pieces), 1 / len(pieces)))
    spelled = {i: p for p, i in pieces.items() if isinstance(p, str)}
    assert sum(n * spelled[i].count("z") for i, n in counts.items()) == pytest.approx(300)


def test_expected_counts_add_up():
    pieces, longest = langid.vocabulary(PIECES)
    prob = np.full(len(pieces), 1 / len(pieces))
    length = {i: len(p) if isinstance(p, str) else 1 for p, i in pieces.items()}
    counts = langid.expected_counts("nation", pieces, longest, prob)
    assert sum(n * length[i] for i, n in counts.items()) == pytest.approx(7)


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(900, None, "en"), (901, "", "fr"), (902, "123 !!", "en"), (903, "x" * 50_000, None), (904, "the of and " * 3000, None), (None, "le la les", "fr")]
    df = spark.createDataFrame(rows() + odd, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(df, PIECES).collect()}
    assert len(got) == 126
    for i, _, lang in rows():
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert any(got[i]["held_out"] for i in range(120))
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[904]["lang_pred"] == "en" and got[903]["lang_pred"] in ("en", "fr")


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert langid.identify(df, PIECES).collect()[0]["lang_pred"] == "und"
    assert langid.identify(df.limit(0), PIECES).count() == 0
