"""SentencePiece encoding with N-best segmentations, and decoding.

The encoding of a text is the model's own: the shipped model is BPE, whose
merges SentencePiece runs.  A BPE model's scores are merge ranks, which mean
nothing when added along a path, so segmentations are ranked by other scores:
the log-probability of each piece, counted (plus one) over the model's own
encoding of the whole table.

A text is a lattice of pieces.  Forward Viterbi gives the best score of every
prefix; these scores are an exact heuristic for a search from the end (A*), so
segmentations come out best first and the search touches little beyond them.

No piece crosses from a word into the next space, so the lattice of a text is a
chain of independent stretches.  Viterbi runs over all new stretches of a batch
at once, forward and backward, which tells for each the best score and how much
its second-best segmentation loses.  Only the N - 1 stretches of a text that
lose least can appear changed in its N best, so only those are searched, and
the N best of the text are put together from them, again best first.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import U64
from quire.llm.shared import documents

N_BEST = 3
#: Memory of words and stretches that a Python worker keeps (strings, ids, scores); it starts anew beyond that.
CACHE_BYTES = 250_000_000
#: Counted for each remembered word besides its characters and ids.
_ENTRY_BYTES = 260
#: Words and characters looked at together.
_WORDS, _CHARS = 300_000, 4_000_000
#: Words that the model encodes as one text.
_TOGETHER = 1024
#: Longest stretch of the batched Viterbi; longer ones are done one by one.
_BATCHED = 24
SPACE = "▁"
_RUNS = re.compile(r" +[^ ]*")
_NONE = float("-inf")

_models: dict[tuple, "PieceModel"] = {}
_processors: dict[str, object] = {}


def processor(path: str):
    """The model file's SentencePieceProcessor, loaded once per worker."""
    if path not in _processors:
        import sentencepiece

        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def cut(text: str) -> list[str]:
    """Words of a text, each with the spaces before it but for one."""
    if "  " not in text and text[:1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(f" {text}")]


class OwnEncoding:
    """The model's own ids, word by word where words are independent."""

    def __init__(self, path: str):
        model = self.processor = processor(path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        #: Whether a piece begins a word that has no other spaces.
        self.begins = np.array([p.startswith(SPACE) for p in pieces])
        #: The id of a space without a word, which the model does not make of an empty text.
        self.alone = model.piece_to_id(SPACE)
        #: Models with pieces across spaces take whole texts.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def whole(self, text: str) -> bytes:
        return np.array(self.processor.encode(text), dtype="<u4").tobytes()

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (see :func:`cut`) in one array, and how many each has; plain words go through the model together."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), _TOGETHER):
            some = words[at : at + _TOGETHER]
            text = " ".join(some)
            if "" in some or SPACE in text or text.count(" ") != len(some) - 1:
                got = [ids if w else [self.alone] for w, ids in zip(some, self.processor.encode(some, num_threads=1))]
                flat.append(np.fromiter(chain.from_iterable(got), np.uint32))
                sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            else:
                ids = np.array(self.processor.encode(text), dtype=np.uint32)
                flat.append(ids)
                sizes.append(np.diff(np.flatnonzero(self.begins[ids]), append=len(ids)))
        return np.concatenate(flat), np.concatenate(sizes)


class Places(dict):
    """A number for each new key, in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Ragged:
    """Arrays of numbers one after another."""

    def __init__(self, kind: type):
        self.flat, self.first, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays at ``places`` in one, and where each begins (and the last ends)."""
        n = self.sizes[places]
        edges = np.concatenate([[0], np.cumsum(n)])
        if edges[-1] == len(places) and (n == 1).all():
            return self.flat[self.first[places]], edges
        return self.flat[np.repeat(self.first[places] - edges[:-1], n) + np.arange(edges[-1])], edges


class Trie:
    """Pieces as a hashed table of (node, character) steps for arrays of states."""

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        nodes: dict[tuple[int, int], int] = {}
        score, ids = [_NONE], [-1]
        for piece, (s, i) in pieces.items():
            at = 0
            for c in map(ord, piece):
                to = nodes.get((at, c))
                if to is None:
                    to = nodes[at, c] = len(score)
                    score.append(_NONE)
                    ids.append(-1)
                at = to
            score[at], ids[at] = s, i
        self.score, self.ids = np.array(score), np.array(ids, dtype=np.int64)
        keys = np.array([(a << 21) | c for a, c in nodes], dtype=U64)
        values = np.fromiter(nodes.values(), np.int64, len(nodes))
        bits = max(8, int(len(nodes)).bit_length() + 2)
        self.shift, self.mask = U64(64 - bits), U64((1 << bits) - 1)
        self.keys, self.to = np.full(1 << bits, 2**64 - 1, dtype=U64), np.full(1 << bits, -1, dtype=np.int64)
        slot = self._slot(keys)
        #: The node after each first character.
        self.root = np.full(0x110001, -1, dtype=np.int64)
        top = keys < U64(1 << 21)
        self.root[keys[top].astype(np.int64)] = values[top]
        while len(keys):
            free = self.keys[slot] == U64(2**64 - 1)
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.to[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + U64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U64(0x9E3779B97F4A7C15)) >> self.shift

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after ``char``, -1 if no piece goes on like that."""
        keys = (node.astype(U64) << U64(21)) | char.astype(U64)
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.to[slot], -1)
        open_ = np.flatnonzero((got != keys) & (got != U64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + U64(1)) & self.mask
            got = self.keys[slot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (got != U64(2**64 - 1))]
        return out


class PieceModel:
    """Pieces of a model file with ``scores`` by id (else the file's), and a memory of words."""

    def __init__(self, path: str, n_best: int = N_BEST, scores: np.ndarray | None = None):
        self.own = OwnEncoding(path)
        model = self.processor = self.own.processor
        self.n_best = n_best
        self.scores: dict[str, tuple[float, int]] = {}
        self.text: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.text.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.scores[piece] = (model.get_score(i) if scores is None else float(scores[i]), i)
                self.text.append(piece.replace(SPACE, " ").encode())
        self.spelt = pa.array(self.text, pa.binary())
        self.unknown_id = model.unk_id()
        #: A character without a piece costs more than any piece and becomes bytes.
        self.unknown = min(s for s, _ in self.scores.values() if s > -1e8) - 10.0
        self.trie = Trie(self.scores)
        self.singles = np.zeros(0x110001, bool)
        self.singles[[ord(p) for p in self.scores if len(p) == 1]] = True
        #: Every beginning of a piece, with (score, ids) if it is one.
        self.begins: dict[str, tuple[float, tuple[int, ...]] | None] = {piece[:n]: None for piece in self.scores for n in range(1, len(piece))}
        self.begins.update((piece, (score, (i,))) for piece, (score, i) in self.scores.items())
        #: Pairs of characters that stand side by side in some piece: a text can be cut between all others.
        self.pairs = {piece[i : i + 2] for piece in self.scores for i in range(len(piece) - 1)}
        self.forget()

    def forget(self) -> None:
        """An empty memory."""
        self.words = Places()
        self.word_ids, self.parts = Ragged(np.uint32), Ragged(np.int64)
        #: Stretches of long words; a short word is a stretch of its own, kept without the space before it.
        self.stretches: dict[str, int] = {}
        self.segments: list[str] = []
        self.short, self.best, self.loss, self.paths = np.zeros(0, bool), np.zeros(0), np.zeros(0), Ragged(np.uint32)
        self.found: dict[int, tuple] = {}
        self.held = 0

    def lattice(self, segment: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """Best score of each prefix, and the edges (from, score, ids) into each place.

        ``segment`` has spaces as they are; a literal U+2581 has no piece.
        """
        n, step = len(segment), self.begins.get
        literal = SPACE in segment
        shown = segment.replace(" ", SPACE)
        best = [0.0] + [_NONE] * n
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            base = best[i]
            single = False
            for j in range(i + 1, n + 1):
                found = step(shown[i:j], 0)
                if not found:
                    if found is None:
                        continue
                    break
                if literal and SPACE in segment[i:j]:
                    continue
                if j == i + 1:
                    single = True
                into[j].append((i, *found))
                score = base + found[0]
                if score > best[j]:
                    best[j] = score
            if not single:
                into[i + 1].append((i, self.unknown, self._bytes_of(segment[i])))
                if base + self.unknown > best[i + 1]:
                    best[i + 1] = base + self.unknown
        return best, into

    def search(self, segment: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best segmentations (score, ids), best first; equal scores in the order of the search."""
        best, into = self.lattice(segment)
        push, pop = heapq.heappush, heapq.heappop
        heap: list = [(-best[-1], 0, len(segment), 0.0, ())]
        order, out = 0, []
        while heap:
            _, _, at, done, path = pop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((done, tuple(ids)))
                if len(out) == self.n_best:
                    break
                continue
            for start, score, ids in into[at]:
                order -= 1  # of equals the one found last goes on, so the search runs deep
                score += done
                push(heap, (-best[start] - score, order, start, score, (ids, path)))
        return out

    def _bytes_of(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids.get(b, self.unknown_id) for b in char.encode())

    def long_stretch(self, segment: str) -> tuple[float, float, list[int]]:
        """(best score, what the second best loses, ids of the best) of one stretch."""
        best, into = self.lattice(segment)
        losses, path, at = [], [], len(segment)
        while at:
            chosen = max(range(len(into[at])), key=lambda k: best[into[at][k][0]] + into[at][k][1])
            # a place that the best path passes: its other edges change that path
            losses += [best[at] - best[s] - x for k, (s, x, _) in enumerate(into[at]) if k != chosen]
            path.append(into[at][chosen][2])
            at = into[at][chosen][0]
        return best[-1], min(losses, default=float("inf")), [i for ids in reversed(path) for i in ids]

    def viterbi(self, stretches: list[str], short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best scores, what the second best lose, ids of the best in one array, how many each has) of stretches in the order of their lengths.

        None is over ``_BATCHED`` long.  ``short``: the space before each is left out.
        A second-best path leaves the best one somewhere and comes back to it,
        so it loses what the best other edge into a place of the best path loses.
        """
        count, begin = len(stretches), int(short)
        lengths = np.fromiter(map(len, stretches), np.int64, count) + begin
        width = int(lengths[-1])
        codes = np.full((width, count), 32, dtype=np.int64)
        if width > begin:
            codes[begin:] = np.array(stretches, dtype=f"<U{width - begin}").view("<u4").reshape(count, width - begin).T
        literal = codes == ord(SPACE)
        codes[codes == 32] = ord(SPACE)
        codes[literal] = 0x110000  # a U+2581 of the text itself: no piece has it
        trie = self.trie
        best, second = np.full((width + 1, count), _NONE), np.full((width + 1, count), _NONE)
        back, edge = np.zeros((width + 1, count), dtype=np.int64), np.zeros((width + 1, count), dtype=np.int64)
        best[0] = 0

        def enter(rows: np.ndarray, to: int, start: int, score: np.ndarray, ids: np.ndarray) -> None:
            now, old = best[start][rows] + score, best[to][rows]
            better = now > old
            second[to][rows] = np.maximum(second[to][rows], np.where(better, old, now))
            rows = rows[better]
            best[to][rows], back[to][rows], edge[to][rows] = now[better], start, ids[better]

        ends = np.searchsorted(lengths, np.arange(width), side="right")  # lengths[ends[i]:] > i
        for i in range(width):
            rows = np.arange(ends[i], count)
            alone = rows[~self.singles[codes[i][rows]]]
            if len(alone):
                enter(alone, i + 1, i, np.full(len(alone), self.unknown), -1 - codes[i][alone])
            node = trie.root[codes[i][rows]]
            for j in range(i, width):
                if j > i:
                    over = int(np.searchsorted(rows, ends[j]))
                    rows, node = rows[over:], node[over:]
                    node = trie.step(node, codes[j][rows])
                on = node >= 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                score = trie.score[node]
                piece = score > _NONE
                if piece.any():
                    enter(rows[piece], j + 1, i, score[piece], trie.ids[node[piece]])
        loss = np.full(count, np.inf)
        rows, at, passed = np.arange(count), lengths.copy(), []
        while len(rows):
            place = at[rows]
            loss[rows] = np.minimum(loss[rows], best[place, rows] - second[place, rows])
            passed.append((rows, edge[place, rows]))
            at[rows] = back[place, rows]
            rows = rows[at[rows] > 0]
        rows, ids = (np.concatenate(x) for x in zip(*reversed(passed)))
        order = np.argsort(rows, kind="stable")  # each path from its begin
        rows, ids = rows[order], ids[order]
        if (ids < 0).any():
            spelt = {c: self._bytes_of(chr(-1 - c) if c > -1 - 0x110000 else SPACE) for c in set(ids[ids < 0].tolist())}
            each = [spelt[i] if i < 0 else (i,) for i in ids.tolist()]
            rows, ids = np.repeat(rows, list(map(len, each))), np.fromiter(chain.from_iterable(each), np.int64)
        return best[lengths, np.arange(count)], loss, ids.astype(np.uint32), np.bincount(rows, minlength=count)

    def _learn_stretches(self, segments: list[str], short: bool) -> None:
        """Stretches in the order of their lengths."""
        at = 0
        while at < len(segments):
            some = segments[at : at + 20_000]
            if len(some[0]) + short > _BATCHED:
                best, loss, paths = zip(*map(self.long_stretch, some))
                found = np.array(best), np.array(loss), np.fromiter(chain.from_iterable(paths), np.uint32), np.fromiter(map(len, paths), np.int64, len(paths))
            else:
                some = [s for s in some if len(s) + short <= _BATCHED]
                found = self.viterbi(some, short)
            self.best, self.loss = np.concatenate([self.best, found[0]]), np.concatenate([self.loss, found[1]])
            self.paths.add(*found[2:])
            at += len(some)
        self.segments += segments
        self.short = np.concatenate([self.short, np.full(len(segments), short)])

    def _cut(self, segment: str) -> list[str]:
        """Stretches of a word between characters that no piece has side by side."""
        shown, pairs = segment.replace(" ", SPACE), self.pairs
        cuts = [0, *(i for i in range(1, len(shown)) if shown[i - 1 : i + 1] not in pairs), len(shown)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: list[str]) -> None:
        """Own ids and stretches of new words, which come by their length."""
        n_short = int(np.searchsorted(np.fromiter(map(len, words), np.int64, len(words)), _BATCHED))
        begin = len(self.segments)
        self._learn_stretches(words[:n_short], True)
        self.parts.add(np.arange(begin, begin + n_short), np.ones(n_short, np.int64))
        long = [self._cut(f" {w}") for w in words[n_short:]]
        if long:
            fresh = sorted({s for p in long for s in p} - self.stretches.keys(), key=lambda s: (len(s), s))
            self.stretches.update(zip(fresh, range(len(self.segments), len(self.segments) + len(fresh))))
            self._learn_stretches(fresh, False)
            self.parts.add(np.array([self.stretches[s] for p in long for s in p], dtype=np.int64), np.fromiter(map(len, long), np.int64, len(long)))
        ids, sizes = self.own.words(words)
        self.word_ids.add(ids, sizes)
        self.held += sum(map(len, words)) + 4 * len(ids) + _ENTRY_BYTES * (len(words) + sum(map(len, long)))

    def known(self, words: list[str]) -> np.ndarray:
        """Places of words in the memory."""
        before = len(self.words)
        places = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if len(self.words) > before:
            # New words are numbered by length, as they are learnt.
            new = list(islice(self.words, before, None))
            order = sorted(range(len(new)), key=list(map(len, new)).__getitem__)
            number = np.empty(before + len(new), np.int64)
            number[:before] = np.arange(before)
            number[before + np.array(order)] = np.arange(before, before + len(new))
            new = [new[k] for k in order]
            self.words.update(zip(new, range(before, before + len(new))))
            self.learn(new)
            places = number[places]
        return places

    def choices(self, stretch: int) -> tuple[tuple[float, bytes], ...]:
        """(loss, ids) of the N best of a stretch, by A*."""
        if stretch not in self.found:
            paths = self.search(" " * bool(self.short[stretch]) + self.segments[stretch])
            self.found[stretch] = tuple((paths[0][0] - s, np.array(ids, dtype="<u4").tobytes()) for s, ids in paths)
            self.held += 2 * _ENTRY_BYTES
        return self.found[stretch]

    def least(self, stretches: np.ndarray) -> list[int]:
        """Places of the N - 1 stretches whose second best lose least."""
        loss = self.loss[stretches]
        most = self.n_best - 1
        if len(loss) > most:
            near = np.argpartition(loss, most - 1)[:most] if most else np.zeros(0, np.int64)
        else:
            near = np.arange(len(loss))
        return [int(k) for k in near if loss[k] < np.inf]

    def combined(self, open_: list[tuple[float, ...]]) -> list[tuple[float, tuple[int, ...]]]:
        """N best (loss, choice of each part) of independent parts, given the losses of their choices."""
        heap = [(0.0, (0,) * len(open_))]
        seen, out = {heap[0][1]}, []
        while heap and len(out) < self.n_best:
            loss, picked = heapq.heappop(heap)
            out.append((loss, picked))
            for k, p in enumerate(picked):
                if p + 1 < len(open_[k]):
                    following = (*picked[:k], p + 1, *picked[k + 1 :])
                    if following not in seen:
                        seen.add(following)
                        heapq.heappush(heap, (loss - open_[k][p] + open_[k][p + 1], following))
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, list[float]]]:
        """(own ids, scores of the N best) of each text."""
        for ids, found in self.segmented(texts):
            yield ids, [s for s, _ in found]

    def segmented(self, texts: list[str]) -> Iterator[tuple[bytes, list[tuple[float, bytes]]]]:
        """(own ids, N best (score, ids)) of each text; the memory is bounded however long a text is."""
        at = 0
        while at < len(texts):
            words: list[list[str]] = []
            n = 0
            while at + len(words) < len(texts) and (not words or n < _WORDS):
                words.append(cut(texts[at + len(words)]) if texts[at + len(words)] else [])
                n += len(words[-1])
            if len(words) == 1 and n > _WORDS:
                yield self._long_text(texts[at], words[0])
            else:
                yield from self._short_texts(texts[at : at + len(words)], words)
            at += len(words)

    def _own(self, text: str, by_words: bytes) -> bytes:
        return by_words if self.own.by_word and SPACE not in text else self.own.whole(text)

    def _short_texts(self, texts: list[str], words: list[list[str]]) -> list[tuple[bytes, list[tuple[float, bytes]]]]:
        self._bounded()
        places = self.known(list(chain.from_iterable(words)))
        ids, ends = self.word_ids.of(places)
        stretches, begins = self.parts.of(places)
        paths, edges = self.paths.of(stretches)
        best = self.best[stretches]
        ids, paths = ids.astype("<u4").tobytes(), paths.astype("<u4").tobytes()
        at = np.concatenate([[0], np.cumsum(list(map(len, words)))])
        out = []
        for text, a, b, c, d in zip(texts, (4 * ends[at]).tolist(), (4 * ends[at[1:]]).tolist(), begins[at].tolist(), begins[at[1:]].tolist()):
            near = [(int(edges[c + k]), int(edges[c + k + 1]), self.choices(int(stretches[c + k]))) for k in self.least(stretches[c:d])]
            out.append((self._own(text, ids[a:b]), self.together(float(best[c:d].sum()), paths, int(edges[c]), int(edges[d]), near)))
        return out

    def together(self, best: float, path: bytes, begin: int, end: int, near: list[tuple[int, int, tuple]]) -> list[tuple[float, bytes]]:
        """N best (score, ids) of a text with the Viterbi path ``path[begin:end]`` (ids), of which the stretches ``near`` (begin, end, choices) can change."""
        near.sort(key=lambda x: x[:2])
        edges = [4 * begin, *(4 * x for a, b, _ in near for x in (a, b)), 4 * end]
        kept = [path[a:b] for a, b in zip(edges[::2], edges[1::2])]
        out = []
        for loss, picked in self.combined([tuple(x for x, _ in choice) for _, _, choice in near]):
            chosen = [choice[p][1] for (_, _, choice), p in zip(near, picked)]
            out.append((best - loss, b"".join([kept[0], *chain.from_iterable(zip(chosen, kept[1:]))])))
        return out

    def _bounded(self) -> None:
        if self.held > CACHE_BYTES:
            self.forget()

    def _long_text(self, text: str, words: list[str]) -> tuple[bytes, list[tuple[float, bytes]]]:
        ids, paths, best, end, near = [], [], 0.0, 0, []
        for at in range(0, len(words), _WORDS):
            self._bounded()
            places = self.known(words[at : at + _WORDS])
            stretches, _ = self.parts.of(places)
            path, edges = self.paths.of(stretches)
            best += float(self.best[stretches].sum())
            near += [(end + int(edges[k]), end + int(edges[k + 1]), self.choices(int(stretches[k]))) for k in self.least(stretches)]
            end += len(path)
            ids.append(self.word_ids.of(places)[0].astype("<u4").tobytes())
            paths.append(path.astype("<u4").tobytes())
        near = sorted(near, key=lambda x: x[2][1][0])[: self.n_best - 1]
        return self._own(text, b"".join(ids)), self.together(best, b"".join(paths), 0, end, near)

    def encode(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """N best (score, ids as little-endian uint32) of each text."""
        return [found for _, found in self.segmented(texts)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; the space put before the text is taken off.  Ids beyond the vocabulary are nothing."""
        numbers = np.frombuffer(ids[: len(ids) // 4 * 4], dtype="<u4")
        if len(numbers) and int(numbers.max()) >= len(self.text):
            numbers = numbers[numbers < len(self.text)]
        return self.spelt.take(pa.array(numbers)).buffers()[2].to_pybytes()[1:] if len(numbers) else b""


def piece_model(path: str, n_best: int = N_BEST, scores: np.ndarray | None = None) -> PieceModel:
    """The model of a worker; only the last one asked for is kept, with its memory."""
    key = (path, n_best, None if scores is None else scores.tobytes())
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(path, n_best, scores)
    return _models[key]


def _some(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(place, texts) of a column, a few million characters at a time."""
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + _CHARS, side="right")) - 1)
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def corpus_scores(docs: DataFrame, model: str) -> np.ndarray:
    """Log-probability of each piece id in the model's own encoding of all texts, every count one higher.

    Tasks count words first and encode each distinct one once.  One row per
    piece reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OwnEncoding(model)
        counts = np.zeros(own.processor.get_piece_size(), dtype=np.int64)
        words: Counter[str] = Counter()

        def add() -> None:
            ids, sizes = own.words(list(words))
            np.add.at(counts, ids, np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes))
            words.clear()

        for batch in batches:
            for _, texts in _some(batch.column(0)):
                for text in texts:
                    if text and (SPACE in text or not own.by_word):
                        np.add.at(counts, np.frombuffer(own.whole(text), dtype="<u4").astype(np.int64), 1)
                    elif text:
                        words.update(cut(text))
                if len(words) > _WORDS:
                    add()
        add()
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["piece", "n"])

    rows = documents(docs).select("text").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.ones(processor(model).get_piece_size())
    for r in rows:
        counts[r["piece"]] += r["n"]
    return np.log(counts / counts.sum())


def encode(docs: DataFrame, model: str, n_best: int = N_BEST) -> DataFrame:
    """doc_id, segmentations: array of (score, ids binary), best first; one row per input row.

    Null and empty texts have one segmentation without pieces.  White space is
    kept as it is (a space is put before the text), so decoding gives the text
    back.  A text has fewer than ``n_best`` segmentations if there are no more.
    They are ranked by :func:`corpus_scores`; the best one need not be the
    model's own encoding.  Columns other than doc_id and text are ignored; an
    empty table gives no rows.
    """
    scores = corpus_scores(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model, n_best, scores)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))
        for batch in batches:
            for at, texts in _some(batch.column(1)):
                found = [[{"score": s, "ids": ids} for s, ids in doc] for doc in own.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(found, kind)], names=["doc_id", "segmentations"])

    return documents(docs).mapInArrow(run, "doc_id long, segmentations array<struct<score:double,ids:binary>>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (doc_id, ids binary) to doc_id, text.

    Null ids give a null text.  Ids beyond the vocabulary are left out, and
    bytes that are not UTF-8 become U+FFFD.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for batch in batches:
            texts = [None if x is None else own.decode(x).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, n_best: int = N_BEST) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, best_score, scores, n_best, decoded_crc32, round_trip, and pieces, ids_crc32s and round_trips of the N best.

    scores, pieces, ids_crc32s and round_trips are lists over the segmentations
    of :func:`encode`, best first: scores, numbers of ids, checksums of the ids,
    and whether the ids decode to the text.  n_pieces, ids_crc32, decoded_crc32
    and round_trip are those of the model's own encoding, which reads a literal
    U+2581 as a space, so round_trip is false there.
    """
    weights = corpus_scores(docs, model)
    columns = {"doc_id": "long", "n_pieces": "long", "ids_crc32": "long", "scores": "array<double>", "decoded_crc32": "long", "round_trip": "boolean", "pieces": "array<long>", "ids_crc32s": "array<long>", "round_trips": "array<boolean>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model, n_best, weights)
        types = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
        for batch in batches:
            for at, texts in _some(batch.column(1)):
                rows = []
                for text, (ids, found) in zip(texts, own.segmented(texts)):
                    back, raw = own.decode(ids), text.encode()
                    paths = [path for _, path in found]
                    rows.append((len(ids) // 4, zlib.crc32(ids), [s for s, _ in found], zlib.crc32(back), back == raw, [len(x) // 4 for x in paths], list(map(zlib.crc32, paths)), [own.decode(x) == raw for x in paths]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=list(columns))

    out = documents(docs).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in columns.items()))
    return out.withColumns({"best_score": F.col("scores")[0], "n_best": F.size("scores").cast("long")})


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
