"""Best-fit packing of tokenised documents into sequences of fixed length.

Pieces are placed by bounded-space online best-fit: a fixed number of open bins
is kept in a bitset keyed by free space, a piece goes to the open bin with the
least space that is enough, and when too many bins are open the fullest one
closes.  Each packer is one Spark task that sees only lengths; its memory is
the bitset and the open bins.  The number of packers follows the total number
of tokens, so the loss by bins left open at the end keeps its share.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import documents, table

SEQUENCE = 2048
OPEN_BINS = 4096
#: Pieces of one packer that are looked at together, longest first.
LOOK_AHEAD = 16384
#: A column of the packer's number while rows are dealt out.
_PACKER = f"__packer_{uuid.uuid4().hex}"  # no column of a table has this name
TOKENS_PER_PACKER = 1 << 26
#: Distinct words kept with their ids during a task (about 200 MB).
CACHE_WORDS = 1_000_000
#: White space around a space, where a cut before that space could split a token.
_ODD = re.compile(r"\s \s|\s $")

# Fixed value: how this byte-level vocabulary cuts a text before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[tuple[str, bool], "_Encoder"] = {}


def _byte_symbols() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Encoder:
    """Ids of whole texts, little-endian, with the ids of words kept.

    Byte-level BPE never joins a word to the one before it: a space belongs to
    the word after it.  So a text is cut before single spaces and each distinct
    word is encoded once, by tiktoken over the vocabulary of the tokenizers
    file (ids are in merge order there, so the ids are the same, six times as
    fast).  Texts with irregular white space go to tokenizers whole.

    The string of a special token in a text is that token, as tokenizers has
    it; with ``plain_specials`` it is ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        #: Texts with one of these go to tokenizers whole.
        self.apart = () if plain_specials else tuple(sorted(special))
        symbols = _byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.plain = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        self.words: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Ids of words, each after a space, from one call on all of them joined."""
        loose = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]
        self.words.update(zip(loose, self.ids([f" {w}" for w in loose])))
        tight = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        if tight:
            ids = np.asarray(self.plain.encode_ordinary(" " + " ".join(tight)), dtype="<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in tight])
            cuts = np.concatenate([[0], np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1]).tolist()
            raw = ids.tobytes()
            self.words.update((w, raw[a * 4 : b * 4]) for w, a, b in zip(tight, cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = self.words
        out: list[bytes] = []
        cut = [None if _ODD.search(text) or any(s in text for s in self.apart) else text.split(" ") for text in texts]
        need = set().union(*[parts[1:] for parts in cut if parts]) - words.keys()
        if need:
            self.learn(list(need))
        heads = iter(self.ids([text if parts is None else parts[0] for text, parts in zip(texts, cut)]))
        for parts in cut:
            head = next(heads)
            out.append(head if parts is None or len(parts) == 1 else head + b"".join(map(words.__getitem__, parts[1:])))
        return out


def encoder(path: str, plain_specials: bool = False) -> _Encoder:
    key = path, plain_specials
    if key not in _encoders:
        _encoders[key] = _Encoder(path, plain_specials)
    return _encoders[key]


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 0, longest: int = SEQUENCE, plain_specials: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian uint32), one row per piece.

    Every document is its ids and then ``end_id``; null text is empty, so it is
    one piece of length 1.  Only longer ones are cut, into pieces of
    ``longest`` of which the first may be shorter.  ``plain_specials``: see
    :class:`_Encoder`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer, plain_specials), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    first = n if n <= longest else (n % longest or longest)
                    rows.append((doc_id, 0, 0, first, ids[: first * 4]))
                    rows.extend((doc_id, k, s, longest, ids[s * 4 : (s + longest) * 4]) for k, s in enumerate(range(first, n, longest), 1))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids"])
        own.words.clear()  # the worker goes on to other tasks, which may not need them

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class Packer:
    """Bounded-space online best-fit of one task."""

    def __init__(self, size: int, open_bins: int, first_sequence: int):
        self.size, self.most, self.next = size, open_bins, first_sequence
        self.bits, self.open = 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            sequence = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            space, sequence = self.size, self.next
            self.next += 1
        left = space - length
        if left:
            self.by_space[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.size - space

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        sequence = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return sequence


def pack(pieces: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, tokens_per_packer: int = TOKENS_PER_PACKER) -> DataFrame:
    """``pieces`` plus sequence_id and offset.  ``pieces`` needs a length of 1 to ``size``.

    ``pieces`` is read twice (once for its total), so it should be stored.
    Full pieces are sequences of their own.  Within a batch of arrivals longer
    pieces go first.  An empty table gives no rows.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // tokens_per_packer))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, held, rows = None, [], 0

        def placed() -> pd.DataFrame:
            frame = pd.concat(held).sort_values("length", ascending=False, kind="stable").drop(columns=_PACKER)
            places = [packer.place(n) for n in frame["length"].tolist()]
            frame["sequence_id"], frame["offset"] = np.array(places, dtype=np.int64).reshape(-1, 2).T
            return frame

        for frame in frames:
            if packer is None and len(frame):
                packer = Packer(size, open_bins, int(frame[_PACKER].iloc[0]) << 40)
            held.append(frame)
            rows += len(frame)
            if rows >= LOOK_AHEAD:
                yield placed()
                held, rows = [], 0
        if rows:
            yield placed()

    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    # Rows are dealt out evenly and sorted, so a task that runs again packs the same way.
    dealt = pieces.repartition(packers).sortWithinPartitions(*pieces.columns).withColumn(_PACKER, F.spark_partition_id())
    return dealt.mapInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    Repeated rows are separate documents.  Columns other than doc_id and text
    are ignored.
    """
    pieces = tokenise(docs, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(table(pieces, "pieces"))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary): the packed sequences, from the output of :func:`pack` over pieces with ids.

    An empty table gives no rows; repeated and null doc_ids do no harm, as
    pieces carry their places.
    """
    rows = placed.select("sequence_id", "offset", "ids")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # bounded: a sequence holds SEQUENCE pieces at most
    return rows.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
