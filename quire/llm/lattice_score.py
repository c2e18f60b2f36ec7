"""Language-model scores by subword lattice likelihood.

A text is its words (A-Z in lower case), each after a word mark, and an end.
The pieces of an existing vocabulary span a lattice over each word; a
segmentation weighs the product of its pieces' probabilities, and the forward
recursion in log space adds up all of them.  No piece crosses a word's
beginning, so the lattice of a text is a chain and its log-probability the sum
over its words.

A word's arcs are the pieces and, for a word seen in the training texts, the
word itself, by its count: with N training tokens and E - 1 words seen once
(Good and Turing's estimate of what is new), P(w) = (count(w) + E * lattice(w))
/ (N + E).  The pieces' scores in the vocabulary file are ranks; as log-probabilities they
start by Zipf's law of the rank and are fitted to the distinct training words
by expectation-maximisation.  A character without a piece is its UTF-8 bytes.

Texts are counted by blocks: a block's distinct words are rows, the rest is a
sparse matrix of counts.  What a word is worth comes by a join on words, with a
row per block however often the word is in it, and goes back to the block.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.pieces import SPACE, Trie, default_model, processor
from quire.llm.shared import table

#: Bytes of text of a block, or one document.
BLOCK_BYTES = 32 << 20
#: Of FOLDS folds by the checksum of the id, this one is held out.
FOLDS, HELD_OUT = 5, 1
ROUNDS = 2
#: Characters of words that go through the lattice in arrays; longer ones go one by one.
BATCHED = 32
#: Characters of a batch of words.
BATCH_CHARS = 400_000
#: Every piece counts so much besides what is expected.
LEAST = 0.1
_NONE = float("-inf")

_lattices: dict[tuple, "Lattice"] = {}


class Lattice:
    """Pieces of a model file with log-probabilities by id, and what words weigh under all their segmentations."""

    def __init__(self, path: str):
        model = processor(path)
        self.end = model.get_piece_size()  # the end of a text is a piece of its own
        self.pieces: dict[str, int] = {}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(self.end):
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[model.id_to_piece(i)] = i
        self.used = np.unique([*self.pieces.values(), *self.byte_ids, self.end])
        self.ranks = np.array([max(0.0, -model.get_score(i)) for i in range(self.end)] + [0.0])
        self.longest = max(map(len, self.pieces))
        self.trie = Trie({p: (0.0, i) for p, i in self.pieces.items()})
        self.begins = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}

    def by_rank(self) -> np.ndarray:
        """Log-probabilities by Zipf's law of the vocabulary's ranks."""
        return self.normal(1 / (self.ranks + 10))

    def normal(self, weights: np.ndarray) -> np.ndarray:
        out = np.full(self.end + 1, _NONE)
        out[self.used] = np.log(weights[self.used]) - np.log(weights[self.used].sum())
        return out

    def take(self, scores: np.ndarray) -> Lattice:
        """This lattice with log-probabilities by id."""
        self.scores = scores
        self.trie.score = np.where(self.trie.ids >= 0, scores[self.trie.ids], _NONE)
        self.single: dict[int, tuple[float, np.ndarray]] = {}
        return self

    def as_bytes(self, char: int) -> tuple[float, np.ndarray]:
        """Log-probability and ids of a character written as bytes."""
        if char not in self.single:
            ids = self.byte_ids[np.frombuffer(chr(char).encode("utf-8", "surrogateescape"), np.uint8)]
            self.single[char] = (float(self.scores[ids].sum()), ids)
        return self.single[char]

    def _arcs(self, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, words, log-probabilities, ids) of the arcs of words of one length (rows of characters); an id below 0 is minus a character."""
        n, width = chars.shape
        for i in range(width):
            rows, node, bare = np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
            for j in range(i, min(width, i + self.longest)):
                node = self.trie.step(node, chars[rows, j])
                live = node >= 0
                rows, node = rows[live], node[live]
                if not len(rows):
                    break
                piece = self.trie.ids[node] >= 0
                if j == i:
                    bare[rows[piece]] = False
                if piece.any():
                    yield i, j + 1, rows[piece], self.trie.score[node[piece]], self.trie.ids[node[piece]]
            rest = np.flatnonzero(bare)
            if len(rest):
                few, at = np.unique(chars[rest, i], return_inverse=True)
                yield i, i + 1, rest, np.array([self.as_bytes(c)[0] for c in few.tolist()])[at], -chars[rest, i]

    def _ways(self, word: str, i: int) -> Iterator[tuple[int, float, int]]:
        """:meth:`_arcs` from one place of one word, for words of any length."""
        bare = True
        for j in range(i + 1, min(len(word), i + self.longest) + 1):
            part = word[i:j]
            if part not in self.begins:
                break
            if part in self.pieces:
                bare = bare and j > i + 1
                yield j, float(self.scores[self.pieces[part]]), self.pieces[part]
        if bare:
            yield i + 1, self.as_bytes(ord(word[i]))[0], -ord(word[i])

    def _batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, characters) of marked words of one length, some at a time."""
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes[sizes <= BATCHED]).tolist():
            own = np.flatnonzero(sizes == size)
            for k in range(0, len(own), max(1, BATCH_CHARS // size)):
                some = own[k : k + max(1, BATCH_CHARS // size)]
                yield some, np.frombuffer("".join([words[x] for x in some]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, size).astype(np.int64)

    def marginals(self, words: list[str], expected: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each marked word over all its segmentations; adds the pieces' expected counts to ``expected``."""
        out = np.zeros(len(words))
        for some, chars in self._batches(words):
            width = chars.shape[1]
            alpha = np.full((width + 1, len(some)), _NONE)
            alpha[0] = 0
            arcs = []
            for arc in self._arcs(chars):
                i, j, rows, score, _ = arc
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + score)
                if expected is not None:
                    arcs.append(arc)
            out[some] = alpha[width]
            beta = np.full(alpha.shape, _NONE)
            beta[width] = 0
            for i, j, rows, score, ids in reversed(arcs):
                share = score + beta[j, rows]
                beta[i, rows] = np.logaddexp(beta[i, rows], share)
                share = np.exp(alpha[i, rows] + share - alpha[width, rows])
                if ids[0] >= 0:
                    expected += np.bincount(ids, share, minlength=len(expected))
                else:
                    for char, much in zip(*(x.tolist() for x in _summed(-ids, share))):
                        np.add.at(expected, self.as_bytes(char)[1], much)
        for k in [k for k, w in enumerate(words) if len(w) > BATCHED]:
            out[k] = self._long(words[k], expected)
        return out

    def _long(self, word: str, expected: np.ndarray | None) -> float:
        n = len(word)
        alpha, beta = [0.0] + [_NONE] * n, [_NONE] * n + [0.0]
        for i in range(n):
            for j, score, _ in self._ways(word, i):
                alpha[j] = _add(alpha[j], alpha[i] + score)
        if expected is not None:
            for i in range(n - 1, -1, -1):
                for j, score, piece in self._ways(word, i):
                    beta[i] = _add(beta[i], score + beta[j])
                    share = math.exp(min(0.0, alpha[i] + score + beta[j] - alpha[n]))
                    if piece >= 0:
                        expected[piece] += share
                    else:
                        np.add.at(expected, self.as_bytes(-piece)[1], share)
        return alpha[n]


def _add(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high if low == _NONE else high + math.log1p(math.exp(low - high))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    few, at = np.unique(keys, return_inverse=True)
    return few, np.bincount(at, values)


def lattice(path: str) -> Lattice:
    """The file's lattice, made once per worker."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def marked(words: list[bytes]) -> list[str]:
    return [SPACE + w.decode("utf-8", "surrogateescape") for w in words]


#: Documents of a block.
_DOC = np.dtype([("id", "<i8"), ("no_id", "?"), ("held", "?"), ("tokens", "<i8"), ("words", "<i8")])
#: What goes along with single rows is packed: Arrow writers look through the empty lists of a batch again for each row.
_MATRIX = ["docs", "ats", "counts"]
_BLOCK = "block long, docs binary, ats binary, counts binary, ends long, words array<binary>, trained array<long>"
_BLOCK_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]


def count_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``docs`` (doc_id, held_out, text): documents, distinct words with their count in training texts, and the matrix of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 33, 0
        docs: list[tuple] = []
        index: dict[bytes, int] = {}
        ats, counts = array("I"), array("I")

        def closed() -> pa.RecordBatch:
            at, n, own = np.array(ats, np.int64), np.array(counts, np.int64), np.array(docs, _DOC)
            train = np.repeat(~own["held"], own["words"])
            trained = np.bincount(at[train], n[train], minlength=len(index)).astype(np.int64)
            values = (block, own.tobytes(), ats.tobytes(), counts.tobytes(), int((~own["held"]).sum()), list(index), trained)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK_TYPES)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                text = text.as_py()
                if docs and size + len(text) > block_bytes:
                    yield closed()
                    block, size, docs, index, ats, counts = block + 1, 0, [], {}, array("I"), array("I")
                found = text.lower().split()
                own = Counter(found)
                docs.append((doc_id or 0, doc_id is None, held, len(found) + 1, len(own)))
                ats.extend([index.setdefault(w, len(index)) for w in own])
                counts.extend(own.values())
                size += len(text)
        if docs:
            yield closed()

    return docs.mapInArrow(run, _BLOCK)


def fit_pieces(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log-probabilities of pieces by id, from the vocabulary's ranks and ``rounds`` of expectation-maximisation over ``words`` (one column, distinct)."""
    spark, own = words.sparkSession, lattice(path)
    scores = own.by_rank()
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(scores)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model = lattice(path).take(held.value)
            expected = np.zeros(model.end + 1)
            for batch in batches:
                model.marginals(marked(batch.column(0).to_pylist()), expected)
            seen = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(expected[seen])], names=["piece", "n"])

        rows = words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # one row per piece of the vocabulary
        weights = np.full(own.end + 1, LEAST)
        weights[rows["piece"]] += rows["n"]
        weights[own.end] += 1  # the end is one more distinct token
        scores = own.normal(weights)
    return scores


def _log10(count: np.ndarray, marginal: np.ndarray, tokens: int, escape: int) -> np.ndarray:
    """log10 of tokens' probabilities from their training counts and their lattices."""
    with np.errstate(divide="ignore"):
        return (np.logaddexp(np.log(count), math.log(escape) + marginal) - math.log(tokens + escape)) / math.log(10)


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    ``score`` is the log10 probability of the text under the lattice model,
    ``base_score`` that of its tokens one by one with half a count added; both
    learn from the rows that are not held out (by the checksum of the id; rows
    without an id have that of an empty text).  Null and empty texts are an end
    alone.  Repeated rows count as often as they come; other columns go; an
    empty table gives none, and a table without training rows scores by the
    vocabulary alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    blocks = table(count_blocks(rows.select("doc_id", held.alias("held_out"), "text"), block_bytes), "blocks")
    words = blocks.select(F.explode(F.arrays_zip("words", "trained")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.trained").alias("n"))
    words = table(words, "words")
    ends = blocks.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    n, v, once = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 1)).first()
    n, v, escape = n + ends, v + (ends > 0), once + 1
    model = spark.sparkContext.broadcast(fit_pieces(words.where("n > 0").select("word"), path, rounds))
    base = lambda count: np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
    last = np.array([float(ends)])
    end = (bool(ends), float(base(last)[0]), float(_log10(last, model.value[-1:], n, escape)[0]))

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path).take(model.value)
        for batch in batches:
            count = batch.column(1).to_numpy().astype(float)
            values = [count > 0, base(count), _log10(count, own.marginals(marked(batch.column(0).to_pylist())), n, escape)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, values)], names=["word", "known", "base", "log10"])

    values = words.mapInArrow(worth, "word binary, known boolean, base double, log10 double")
    asked = blocks.select("block", F.posexplode("words").alias("pos", "word")).join(values, "word").select("block", "pos", "known", "base", "log10")
    matrices = blocks.select("block", F.lit(-1).alias("pos"), *_MATRIX)
    stream = matrices.unionByName(asked, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "pos")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, parts = None, []

        def closed() -> pa.RecordBatch:
            docs, at, counts = (np.frombuffer(x, t) for x, t in zip(matrix, (_DOC, np.uint32, np.uint32)))
            known, low, score = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
            doc = np.repeat(np.arange(len(docs)), docs["words"])
            total = lambda x: np.bincount(doc, counts * x[at], minlength=len(docs))
            ids = pa.array(docs["id"], mask=docs["no_id"])
            out = [docs["held"], docs["tokens"], np.rint(total(known)).astype(np.int64) + end[0], np.full(len(docs), n), total(low) + end[1], total(score) + end[2]]
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], names=[c.split()[0] for c in _OUT.split(", ")])

        for batch in batches:
            pos = batch.column(1).to_numpy()
            heads = np.flatnonzero(pos < 0)
            for a, b in zip([0, *heads], [*heads, len(pos)]):
                if a < b and pos[a] < 0:
                    if matrix is not None:
                        yield closed()
                    matrix, parts = [batch.column(c)[a].as_py() for c in _MATRIX], []
                    a += 1
                if a < b:
                    parts.append([batch.column(c).slice(a, b - a).cast(pa.float64()).to_numpy() for c in ("known", "base", "log10")])
        if matrix is not None:
            yield closed()

    return stream.mapInArrow(add_up, _OUT)


def op13_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
