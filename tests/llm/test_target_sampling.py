"""Importance resampling to a target: checksums, words, edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import target_sampling as op

DOCS = "doc_id long, text string, weight string, rank string"


@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_checksums_of_spans(data, spans):
    raw = np.frombuffer(data, np.uint8)
    spans = [(min(a, b, len(data)), min(max(a, b), len(data))) for a, b in spans]
    got = op.crc32_spans(raw, np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 63, 64, 65, 67, 68, 127, 128, 129, 5000, 3_000_001])
def test_checksums_of_long_spans(n):
    data = random.Random(n).randbytes(n + 7)
    got = op.crc32_spans(np.frombuffer(data, np.uint8), np.array([0, 3, 7]), np.array([n, n + 3, n + 7]))
    assert got.tolist() == [zlib.crc32(data[a : a + n]) for a in (0, 3, 7)]


def plain(texts: list[str]) -> list[list[bytes]]:
    out = []
    for text in texts:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())
        out.append([*w, *(a + b" " + b for a, b in zip(w, w[1:]))])
    return out


@given(st.lists(st.text(st.sampled_from("aZ09 é漢!\n_\x7f\x80"), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_features_of_texts(texts):
    parts = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    at, doc, counts = op.features(np.frombuffer(b"".join(parts), np.uint8), offsets)
    want = plain(texts)
    assert counts.tolist() == [(len(w) + 1) // 2 for w in want]
    for d, w in enumerate(want):
        assert sorted(at[doc == d].tolist()) == sorted(zlib.crc32(x) % op.BUCKETS for x in w)


def test_edges(spark):
    long_text = "word " * 60_000 + "漢" * 50_000
    rows = [(1, None), (2, ""), (3, " ,;"), (4, "a b c"), (5, long_text), (6, "same text " * 15), (6, "same text " * 15), (7, "same text " * 15), (None, "same text " * 15), (8, "other " * 19)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    target = spark.createDataFrame([("same text",), (None,)], "text string")
    got = op.resample(docs, target, percent=60).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["n_features"], by[i]["weight"], by[i]["rank"]) == (0, 0, None) for i in (1, 2, 3))
    assert by[5]["n_features"] == 2 * 60_001 - 1 and by[8]["rank"] is None and by[4]["rank"] is None
    drawn = sorted((r["rank"], r["score"]) for r in got if r["rank"])
    assert [r for r, _ in drawn] == [1, 2, 3]  # 60 % of the five rows with 20 words
    assert [s for _, s in drawn] == sorted((s for _, s in drawn), reverse=True)
    same = [r for r in got if r["doc_id"] == 6]
    assert same[0]["score"] == same[1]["score"] and same[0]["weight"] == by[7]["weight"]


def test_ties_without_ids(spark, monkeypatch):
    monkeypatch.setattr(op, "weigh", lambda docs, gain, longest: docs.selectExpr("doc_id", "30L AS n_words", "1L AS n_features", "-CAST(0 AS LONG) AS weight"))
    docs = spark.createDataFrame([(None, "x")] * 3, "doc_id long, text string")
    assert sorted(r["rank"] or 0 for r in op.resample(docs, docs, percent=70).collect()) == [0, 1, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a b " * 20, "", "")], DOCS)
    assert op.resample(none, none).count() == 0 and op.resample(none, some).count() == 0
    (row,) = op.resample(some, none, percent=100).collect()
    assert row["rank"] == 1 and row["n_features"] == 79
