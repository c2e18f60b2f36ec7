"""Lattice scores: marginals against enumeration, expected counts, documents against plain Python, edge cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import lattice_score as op
from quire.llm.pieces import SPACE

PATH = op.default_model()
DOCS = "doc_id long, text string, words string, block string"


@pytest.fixture(scope="module")
def own():
    model = op.Lattice(PATH)
    return model.take(model.by_rank())


def segmentations(model, word):
    """(probability, ids) of every way to write a word."""
    if not word:
        yield 1.0, ()
        return
    firsts = [(word[:k], (model.pieces[word[:k]],)) for k in range(1, len(word) + 1) if word[:k] in model.pieces]
    if word[0] not in model.pieces:
        firsts.append((word[0], tuple(model.byte_ids[list(word[0].encode())])))
    for part, ids in firsts:
        for p, rest in segmentations(model, word[len(part) :]):
            yield math.exp(sum(model.scores[i] for i in ids)) * p, (*ids, *rest)


WORDS = ["the", "of", "é", "", "international", "漢字", "\U0001f9a0x", "aaaaaaaa", "1234", "ß-x", "the"]


def test_marginals_and_expected_counts(own):
    words = [SPACE + w for w in WORDS]
    expected, want = np.zeros(own.end + 1), np.zeros(own.end + 1)
    got = own.marginals(words, expected)
    for word, value in zip(words, got):
        ways = list(segmentations(own, word))
        assert math.isclose(value, math.log(sum(p for p, _ in ways)), rel_tol=1e-10)
        for p, ids in ways:
            np.add.at(want, list(ids), p / sum(q for q, _ in ways))
    assert np.allclose(expected, want)


def test_long_words_one_by_one(own):
    words = [SPACE + w for w in ("international" * 2, "éa漢" * 5, "x" * 31)]
    a, b = np.zeros(own.end + 1), np.zeros(own.end + 1)
    assert np.allclose(own.marginals(words, a), [own._long(w, b) for w in words]) and np.allclose(a, b)
    assert -2e6 < own.marginals([SPACE + "ab漢" * 50_000])[0] < -1e5


def test_probabilities_add_up_to_one_at_most(own):
    assert math.isclose(np.exp(own.scores[own.used]).sum(), 1.0)


def brute(rows, scores):
    """Every row's result from plain Python, but for the pieces' log-probabilities."""
    model = op.Lattice(PATH).take(scores)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            count.update(tokens(t))
            ends += 1
    n, v, escape = sum(count.values()) + ends, len(count) + (ends > 0), 1 + sum(c == 1 for c in count.values())
    for i, t in rows:
        own = tokens(t)
        base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        marginal = np.exp(model.marginals(op.marked(own)))
        p = [(count[w] + escape * m) / (n + escape) for w, m in zip(own, marginal)] + [(ends + escape * math.exp(scores[-1])) / (n + escape)]
        yield (i, held(i), len(own) + 1, sum(count[w] > 0 for w in own) + (ends > 0), n, round(sum(base(count[w]) for w in own) + base(ends), 6), round(sum(map(math.log10, p)), 6))


ROWS = [(0, "The cat sat on the mat"), (1, None), (2, ""), (3, " \t\n\x0b\x0c"), (4, "the THE thé"), (5, "word " * 3000), (6, "A b É"), (6, "A b É"), (None, "the dog"), (11, "unseen zebra " * 3), (12, "cat"), (17, "the"), (18, "x" * 3000)]


@pytest.mark.parametrize("block_bytes", [1, 60, op.BLOCK_BYTES])
def test_documents_against_plain_python(spark, monkeypatch, block_bytes):
    scores = {}
    fit = op.fit_pieces
    monkeypatch.setattr(op, "fit_pieces", lambda *a: scores.setdefault("own", fit(*a)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], DOCS).repartition(3)
    got = op.score_documents(docs, PATH, block_bytes=block_bytes).collect()
    assert any(r["held_out"] for r in got) and any(r["n_known"] < r["n_tokens"] for r in got)
    values = sorted((tuple(r)[:5] + (round(r["base_score"], 6), round(r["score"], 6)) for r in got), key=repr)
    for a, b in zip(values, sorted(brute(ROWS, scores["own"]), key=repr), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-5)


def test_expectation_maximisation_raises_the_likelihood(spark):
    words = spark.createDataFrame([(w.encode(),) for w in "there these other another mother brother thereof hereby".split()], "word binary")
    model = op.lattice(PATH)
    totals = [model.take(op.fit_pieces(words, PATH, n)).marginals(op.marked([r[0] for r in words.collect()])).sum() for n in (1, 2, 3)]
    assert totals[0] < totals[1] < totals[2]


def test_words_that_look_like_the_corpus_score_higher(spark):
    rows = [(i, r["text"]) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()) if r["text"]]
    held = [i for i in range(10**6, 10**6 + 99) if zlib.crc32(str(i).encode()) % 5 == 1]
    pairs = [("thentionather", "hqxzkwvjpyrtb"), ("ofthereandin", "qqzxvwkjyhfbp")]  # neither is a word of the corpus
    texts = [t for pair in pairs for t in pair]
    assert not any(t in r[1] for t in texts for r in rows)
    got = {r["doc_id"]: r for r in op.score_documents(spark.createDataFrame([*rows, *zip(held, texts)], "doc_id long, text string"), PATH).collect()}
    assert all(got[i]["n_known"] == 1 for i in held[: len(texts)])
    assert all(got[held[k]]["score"] > got[held[k + 1]]["score"] + 3 for k in (0, 2))
    assert len({got[i]["base_score"] for i in held[: len(texts)]}) == 1  # counts alone cannot tell


def test_no_training_rows_and_empty_table(spark):
    assert op.score_documents(spark.createDataFrame([], DOCS), PATH).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = op.score_documents(spark.createDataFrame([(held, "a b", "", "")], DOCS), PATH).collect()
    assert (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0.0) and row["score"] < -3
