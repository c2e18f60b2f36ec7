"""N-gram Jaccard join with signature trees.

Every text becomes the set of its distinct five-word shingles (64-bit hashes);
texts with equal sets are one from then on, so a group of copies is one text.
Two texts that link share prefix shingles: in an order that all texts use
(common shingles last, the rest by hash), the first 20 % and a tenth more of
each hold at least ``shared_at_least(n)`` shingles of the other.  Shingles with
one text and texts with fewer shared shingles are peeled off.  Texts connected
through what is left form a *family*; a link never leaves its family:

1. Within a family every text is compared with the least text it shares a
   prefix shingle with (a star, linear in the rows).  Most copies link here.
2. Only prefix shingles whose texts are still in different components go on.
   Their families are cut into blocks, ordered by size; for each pair of blocks
   one task builds two *signature trees* (nodes with OR-combined token bitmaps
   and size ranges) and walks both at once, leaving out node pairs whose
   largest possible overlap is too small, and compares what is left exactly.

No list of pairs is formed inside a group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.components import components, roots
from quire.llm.kernels import U64, shingle_sets, text_buffer
from quire.llm.shared import BROADCAST_IDS, ROW, arrow_rows, checkpoint, documents, drop_table, numbered, only, table

WORDS = 5
#: Two sets link when 100 * overlap >= PERCENT * union.
PERCENT = 80
#: Common shingles put last in the order are at most so many (8 bytes each, sent to every task).
COMMON_SHINGLES = 250_000
#: Rounds of :func:`peel`.
PEELINGS = 3
#: Prefix shingles, and then pairs of blocks, are dealt out in so many turns, one after the other, so that the disk holds the shuffle of one.
TURNS = 2
#: Texts looked at together when common shingles are counted.
_TASTE = 2000
BLOCK = 512
_FANOUT = 8
#: Bits of a signature for each shingle of the largest set of a block, and 64-bit words of a signature at most.
_BITS_PER_SHINGLE, _MOST_WORDS = 4, 512


def linked(overlap, a, b):
    """Whether sets of sizes a and b with that overlap link."""
    return 100 * overlap >= PERCENT * (a + b - overlap)


def at_least(n):
    """The overlap that a set of size n has with any set it links with."""
    return (PERCENT * n + 99) // 100


def shared_at_least(n):
    """How many prefix shingles a set of size n shares with any set it links with."""
    return (at_least(n) + 9) // 10


def prefix_length(n: int) -> int:
    return min(n, n - at_least(n) + (n + 9) // 10)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TASTE):
            part = batch.slice(at, _TASTE)
            yield part, shingle_sets(*text_buffer(part.column("text")), WORDS)


def common_shingles(texts: DataFrame, most: int = COMMON_SHINGLES) -> np.ndarray:
    """Sorted hashes of shingles that many texts have, at most ``most``.

    Which shingles are named only changes the work, not the result, so a
    shingle counts where it occurs three times among texts read together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _texts(batches):
            distinct = {s.tobytes(): s for s in sets}.values()
            values, counts = np.unique(np.concatenate([*distinct, np.zeros(0, U64)]), return_counts=True)
            often = counts >= 3
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["shingle", "n"])

    counts = checkpoint(texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").cast("long").alias("n")))
    by_count = counts.groupBy(F.least(F.col("n"), F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).toPandas()  # at most 100 000 rows
    total = by_count["count"].cumsum()
    least = by_count.loc[total <= most, "n"].min()
    if pd.isna(least):
        return np.zeros(0, U64)
    return np.sort(counts.where(F.col("n") >= int(least)).select("shingle").toPandas()["shingle"].to_numpy(dtype=np.int64).view(U64))


def _text_ids(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """128-bit hashes of sets as two columns; the first names the set in all later steps."""
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), seed) for s in sets), dtype=np.int64).reshape(-1, 2)


def named_sets(docs: DataFrame, hashed=_text_ids) -> tuple[DataFrame, int]:
    """(stored :func:`shingle_keys`, the seed of their names).

    A name is 64 bits of a 128-bit hash, so two sets may get one name.  The
    other 64 bits tell; then all sets are named again by another seed.
    """
    seed = 0
    while True:
        keys = table(shingle_keys(docs, seed, hashed), "shingle-keys")
        twice = keys.groupBy("text_id").agg(F.min("text_id_b").alias("a"), F.max("text_id_b").alias("b")).where("a != b")
        if twice.isEmpty():
            return keys, seed
        drop_table(keys)
        seed += 1


def shingle_keys(docs: DataFrame, seed: int = 0, hashed=_text_ids) -> DataFrame:
    """doc_id, n_shingles, text_id, text_id_b: size and 128-bit hash of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _texts(batches):
            keys = hashed(sets, seed)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["doc_id", "n_shingles", "text_id", "text_id_b"])

    return documents(docs).mapInArrow(run, "doc_id long, n_shingles long, text_id long, text_id_b long")


def prefix_rows(docs: DataFrame, common: np.ndarray, seed: int = 0, hashed=_text_ids, turn: int = 0, turns: int = 1) -> DataFrame:
    """shingle, text_id, place: one row per prefix shingle, copies read together only once.

    ``place`` holds the set's size and how many of its shingles come after.
    Of the shingles those of one turn, by their remainder.
    """
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held.value
        for _, sets in _texts(batches):
            sets = list({s.tobytes(): s for s in sets if len(s)}.values())
            heads = []
            for s in sets:
                p = prefix_length(len(s))
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                heads.append(s[:p].view(np.int64))
            counts = np.array([len(x) for x in heads], dtype=np.int64)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            ids, n = np.repeat(hashed(sets, seed)[:, 0], counts), np.repeat(np.array([len(s) for s in sets], dtype=np.int64), counts)
            shingles, place = np.concatenate([*heads, np.zeros(0, np.int64)]), (n << 32) | (n - 1 - at)
            now = shingles % turns == turn
            yield pa.RecordBatch.from_arrays([pa.array(x[now]) for x in (shingles, ids, place)], names=["shingle", "text_id", "place"])

    return documents(docs).mapInArrow(run, "shingle long, text_id long, place long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, text_id) those whose shingle several texts have, each once.

    Only the last row is kept between batches.
    """
    held = None  # shingle, text_id, place, whether it was sent
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(3)]
        if held:
            columns = [np.concatenate([[x], y]) for x, y in zip(held, columns)]
        shingle, text, _ = columns
        fresh = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])])
        columns = [x[fresh] for x in columns]
        shingle = columns[0]
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(shingle)]]))
        send = np.repeat(sizes, sizes) > 1
        sent = bool(held and held[3])
        if sent:
            send[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[send]) for x in columns], names=["shingle", "text_id", "place"])
        alone = sizes[-1] == 1
        held = (*(x[-1] for x in columns), not alone or (sent and len(shingle) == 1))


def shingle_blobs(docs: DataFrame, seed: int = 0, hashed=_text_ids) -> DataFrame:
    """text_id, set (binary: sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(hashed(sets, seed)[:, 0]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["text_id", "set"])

    return documents(docs).mapInArrow(run, "text_id long, set binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (u, v, set_u, set_v) the pairs that link."""
    for batch in batches:
        sets = [[np.frombuffer(x, dtype=U64) for x in batch.column(c).to_pylist()] for c in (2, 3)]
        good = [linked(_overlap(a, b), len(a), len(b)) for a, b in zip(*sets)]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def signature_words(largest: int) -> int:
    """64-bit words of a signature where the largest set has so many shingles: a power of two."""
    return min(_MOST_WORDS, 1 << max(0, (_BITS_PER_SHINGLE * largest - 1) >> 6).bit_length())


def signatures(sets: list[np.ndarray], words: int) -> np.ndarray:
    """Token bitmaps, one row of ``words`` 64-bit words per set."""
    out = np.zeros((len(sets), words), dtype=U64)
    for row, s in zip(out, sets):
        bit = s & U64(64 * words - 1)
        np.bitwise_or.at(row, (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out


class SignatureTree:
    """Levels of nodes over sets in the given order; level 0 are the sets.

    A node has the OR of its sets' bitmaps (any token of any of them), the AND
    (bits that all of them have) and the range of their sizes.
    """

    def __init__(self, sets: list[np.ndarray], words: int | None = None):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        bits = signatures(sets, words or signature_words(int(sizes.max())))
        self.sets = sets
        self.levels = [(bits, bits, sizes, sizes)]
        while len(self.levels[-1][2]) > 1:
            some, every, low, high = self.levels[-1]
            cut = np.arange(0, len(low), _FANOUT)
            self.levels.append((np.bitwise_or.reduceat(some, cut), np.bitwise_and.reduceat(every, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def children(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Children (at ``level``) of nodes, with the row of their parent."""
        down = (nodes[:, None] * _FANOUT + np.arange(_FANOUT)).ravel()
        row = np.repeat(np.arange(len(nodes)), _FANOUT)
        real = down < len(self.levels[level][2])
        return down[real], row[real]


def may_link(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets below nodes i and j can overlap enough to link.

    A bit that all sets of one node have and no set of the other has is a token
    without partner.  Given the largest overlap that leaves, the least sizes
    that could have it decide.
    """
    (some_a, every_a, low_a, high_a), (some_b, every_b, low_b, high_b) = a, b
    out = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        most_a = high_a[x] - np.bitwise_count(every_a[x] & ~some_b[y]).sum(axis=1).astype(np.int64)
        most_b = high_b[y] - np.bitwise_count(every_b[y] & ~some_a[x]).sum(axis=1).astype(np.int64)
        overlap = np.minimum(most_a, most_b)
        out[at : at + (1 << 14)] = (overlap > 0) & linked(overlap, np.maximum(low_a[x], overlap), np.maximum(low_b[y], overlap))
    return out


def tree_links(left: SignatureTree, right: SignatureTree, same: bool, component: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Linking pairs (i, j) found by walking both trees, enough to connect all that link.

    Pairs already connected, by ``component`` or by pairs found before, are
    not compared.
    """
    i = j = np.zeros(1, dtype=np.int64)
    a, b = len(left.levels) - 1, len(right.levels) - 1
    while a or b:
        if a and a >= b:
            a -= 1
            i, row = left.children(i, a)
            j = j[row]
        else:
            b -= 1
            j, row = right.children(j, b)
            i = i[row]
        keep = may_link(left.levels[a], right.levels[b], i, j)
        if same and a == b:
            keep &= i <= j
        i, j = i[keep], j[keep]
    differs = component[0][i] != component[1][j]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i[differs].tolist(), j[differs].tolist()):
        rx, ry = root(int(component[0][x])), root(int(component[1][y]))
        if rx != ry:
            p, q = left.sets[x], right.sets[y]
            if linked(_overlap(p, q), len(p), len(q)):
                parent[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
    return out


def _block_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of one pair; rows: side, text_id, component, set.

    Sets go by their least hashes, so that similar sets share nodes; bitmaps are
    as wide as the larger sets of both blocks need.
    """
    sides, words = [], signature_words(int(frame["n"].max()))
    for side in (0, 1):
        rows = frame[frame["side"] == side]
        sets = [np.frombuffer(x, dtype=U64) for x in rows["set"]]
        order = sorted(range(len(sets)), key=lambda k: sets[k][:4].tolist())
        sides.append((rows["text_id"].to_numpy()[order], rows["component"].to_numpy()[order], SignatureTree([sets[k] for k in order], words) if sets else None))
    same = sides[1][2] is None
    (ids, comp, tree), (ids_b, comp_b, tree_b) = sides[0], sides[0] if same else sides[1]
    found = tree_links(tree, tree_b, same, (comp, comp_b))
    return pd.DataFrame({"u": [ids[x] for x, _ in found], "v": [ids_b[y] for _, y in found]}, dtype="int64")


def peel(groups: DataFrame, rounds: int = PEELINGS) -> DataFrame:
    """Rows of texts that share enough prefix shingles to link with anything.

    Two texts that link share at least ``shared_at_least(n)`` prefix shingles,
    so a text with fewer shared ones goes, and then shingles that one text is
    left with.  Every round makes the table smaller; how many are run changes
    the work that is left, not the result.
    """
    last = None
    for _ in range(rounds):
        n = F.shiftrightunsigned(F.col("place"), 32)
        need = F.floor((F.floor((n * PERCENT + 99) / 100) + 9) / 10)
        enough = groups.groupBy("text_id", need.alias("need")).agg(F.count(F.lit(1)).alias("k")).where("k >= need").select("text_id")
        rest = groups.join(enough, "text_id", "left_semi")
        several = rest.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("shingle")
        groups = table(rest.join(several, "shingle", "left_semi"), "peeled")
        if last is not None:
            drop_table(last)
        last = groups
    return groups


def links(docs: DataFrame, keys: DataFrame, seed: int = 0, hashed=_text_ids) -> DataFrame:
    """u, v: pairs of text ids that link, enough to connect every two linking texts."""
    common, whole = common_shingles(documents(docs)), []
    for turn in range(TURNS):
        rows = prefix_rows(docs, common, seed, hashed, turn, TURNS)
        whole.append(table(rows.repartition("shingle").sortWithinPartitions("shingle", "text_id").mapInArrow(_groups, "shingle long, text_id long, place long"), "prefix-groups"))
    groups = peeled = peel(functools.reduce(DataFrame.unionByName, whole))
    for x in whole:
        drop_table(x)
    groups = groups.select("shingle", "text_id", F.shiftrightunsigned("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("room"))
    # One text's set per candidate; few enough of them are looked up by a broadcast, more by a shuffle.
    asked = checkpoint(groups.select("text_id").distinct().join(keys, "text_id").groupBy("text_id").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    small = asked.count() <= BROADCAST_IDS
    sets = table(shingle_blobs(documents(docs).join(F.broadcast(asked) if small else asked, "doc_id", "left_semi"), seed, hashed).dropDuplicates(["text_id"]), "prefix-sets")
    hub = groups.groupBy("shingle").agg(F.min("text_id").alias("u"))
    center = groups.join(hub, "shingle").where("text_id = u").select("shingle", "u", F.col("n").alias("n_u"), F.col("room").alias("room_u"))
    # Of the shingles that two texts share, the first leaves the most room for an overlap: it decides.
    most = F.least(F.col("room"), F.col("room_u")) + 1
    near = F.max(most * 100 >= (F.col("n") + F.col("n_u") - most) * PERCENT)
    stars = checkpoint(groups.join(center, "shingle").where("text_id != u").groupBy("u", F.col("text_id").alias("v")).agg(near.alias("near")).where("near").select("u", "v"))
    compared = stars.join(sets.select(F.col("text_id").alias("v"), F.col("set").alias("set_v")), "v").join(sets.select(F.col("text_id").alias("u"), F.col("set").alias("set_u")), "u")
    with arrow_rows(docs.sparkSession, 500):
        first = checkpoint(compared.select("u", "v", "set_u", "set_v").mapInArrow(_star_links, "u long, v long"))
    # What is left: prefix shingles whose texts are in more than one component.
    known = components(first).select(F.col("node").alias("text_id"), "component")
    member = groups.select("shingle", "text_id", "n").join(known, "text_id", "left").withColumn("component", F.coalesce("component", "text_id"))
    mixed = member.groupBy("shingle").agg(F.min("component").alias("hub"), F.max("component").alias("high")).where("hub < high").select("shingle", "hub")
    left = checkpoint(member.join(mixed, "shingle").select("text_id", "n", "component", "hub").distinct())
    drop_table(peeled)
    families = components(left.select("component", "hub")).select(F.col("node").alias("component"), F.col("component").alias("family"))
    members = left.select("text_id", "n", "component").distinct().join(families, "component", "left").withColumn("family", F.coalesce("family", "component"))
    return first.unionByName(_join_families(members, sets))


def _join_families(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside families (text_id, n, component, family), block against block; the table of sets is dropped.

    Blocks hold about ``BLOCK`` texts of similar size; blocks whose sizes are
    too far apart are not compared.
    """
    # Sorted over all tasks by family and size: a block is a stretch of one task's rows, whatever the size of a family.
    number = F.monotonically_increasing_id()
    place = F.shiftright(number, 33) * F.lit(1 << 33) + F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK)
    members = checkpoint(members.repartitionByRange("family", "n", "text_id").sortWithinPartitions("family", "n", "text_id").withColumn("block", place))
    blocks = members.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select("family", F.col("block").alias("block_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    pairs = blocks.join(other, "family").where((F.col("block") <= F.col("block_b")) & (F.col("high") * 100 >= F.col("low_b") * PERCENT)).select("family", "block", "block_b")
    with_set = table(members.join(sets, "text_id"), "family-sets")
    drop_table(sets)
    found = []
    for turn in range(TURNS):
        now = F.pmod(F.xxhash64("family", "block"), F.lit(TURNS)) == turn
        mine = pairs.where(now)
        side_a = mine.join(with_set.where(now), ["family", "block"]).select("family", "block", "block_b", F.lit(0).alias("side"), "text_id", "n", "component", "set")
        side_b = mine.where("block < block_b").join(with_set.withColumnRenamed("block", "block_b"), ["family", "block_b"]).select("family", "block", "block_b", F.lit(1).alias("side"), "text_id", "n", "component", "set")
        with arrow_rows(members.sparkSession, 2000):
            found.append(checkpoint(side_a.unionByName(side_b).groupBy("family", "block", "block_b").applyInPandas(_block_links, "u long, v long")))
    drop_table(with_set)
    return functools.reduce(DataFrame.unionByName, found)


def jaccard_components(docs: DataFrame, hashed=_text_ids) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per input row.

    Words are runs of other than ``[\\x20\\x09-\\x0D]``, A-Z folded.  Null texts
    and texts without words have no shingles and link with nothing, not even
    with each other; a text of fewer than five words is one shingle.  Rows with
    equal sets link.  Repeated rows share doc_id and component.  Rows with a
    null doc_id link with nothing and have a null component.  Other columns are
    ignored; an empty table gives no rows.
    """
    keys, seed = named_sets(docs, hashed)
    filled = keys.where("n_shingles > 0 AND doc_id IS NOT NULL")
    found = components(links(docs, filled.select("doc_id", "text_id"), seed, hashed)).withColumnRenamed("node", "text_id")
    classes = filled.groupBy("text_id").agg(F.min("doc_id").alias("doc_id")).join(found, "text_id", "left").select("text_id", "doc_id", F.coalesce("component", "text_id").alias("component"))
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labelled = classes.join(least, "component").select("text_id", "component_id")
    out = keys.join(labelled, "text_id", "left")
    named = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(named, "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id, a null doc_id last.

    Rows are told apart by a key of their own, so repeated rows, rows that
    share a doc_id and rows without one are near copies by their texts alone.
    """
    rows = numbered(docs)
    found = jaccard_components(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    first = found.join(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")), ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)).alias("first"))
    return only(rows, table(first.select(f"first.{ROW}"), "kept-rows"), ROW)[0].select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
