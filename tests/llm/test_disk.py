"""What steps leave on the disk."""

from __future__ import annotations

from quire.lineage import checkpoint
from quire.llm import ngram_join, shared


def test_steps_leave_no_shuffle_files_and_no_tables(spark, monkeypatch):
    """A stored step deletes its shuffle; of the tables only the keys, which the result is read from, stay; turns change no result."""
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = held()
    counts = checkpoint(spark.range(1000).groupBy("id").count())
    assert held() == before and counts.count() == 1000
    words = [f"w{k}" for k in range(400)]
    texts = [(i, " ".join(words[i : i + 100])) for i in range(0, 60, 3)] + [(900 + i, " ".join(f"x{i}y{k}" for k in range(50))) for i in range(9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    found = []
    for turns in (1, 3):
        monkeypatch.setattr(ngram_join, "TURNS", turns)
        kept = set(shared.written())
        found.append(sorted(map(tuple, ngram_join.jaccard_components(docs).collect())))
        assert [p for p in shared.written() if p not in kept and "shingle-keys" not in p] == []
    assert found[0] == found[1] and {c for i, _, c in found[0] if i < 900} == {0} and all(i == c for i, _, c in found[0] if i >= 900)
