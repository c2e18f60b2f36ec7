"""Conversation structure repair: cheapest edits by the auction algorithm for shortest paths.

A conversation's rows are a lattice of (rows done, state), the state being what
the repaired roles end on: nothing, a system row, a user row or an assistant
row.  Keeping, renaming, deleting and inserting rows are arcs of whole costs,
and a repair is a path to the end in a state that the roles ``(s?(ua)+)?`` allow.

Every node has a price, never more than any arc's cost plus the price of its
head.  The auction walks a path from the start: where the end node's price can
rise it rises and the path contracts, else the path extends by the best arc.
When it reaches the goal the prices of its nodes are their distances, so the
arcs of cheapest paths are tight, and walking tight arcs in the order of their
letters gives the least of the cheapest repairs.  A letter and a node have one
successor, so the walk is at one node at a time.

A conversation of any length is cut into blocks of rows in its order.  Blocks of
a long one are solved beside each other: the auction gives each block's costs
from every state to every state, these go backwards along the conversation (a
few numbers a block) and tell the price of each state at each block's end, then
each block is traced from every state that it may begin in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import table

#: Rows of one block, and the characters after which it ends.
BLOCK_ROWS, BLOCK_CHARS = 32, 4_000_000
#: First characters of texts that deal out the rows of a tie.
TIE = 64
SPACE = " \t\n\r\x0b\x0c"
ENDS = (".", "!", "?")
KEEP, RENAME, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_GOAL = -1
_FAR = 1 << 40
#: The state after a row of each kind of role, by the state before it.
_NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state that a renamed or inserted row leads to.
_TURN = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: At a conversation's end: nothing, or an assistant row.
_END = (0, _FAR, _FAR, 0)
_LEGAL = {"su", "ua", "au"}


class Lattice:
    """Nodes ``4 * rows done + state`` of some rows, with prices that rise to the distance to the goal.

    ``kinds`` has a letter per row: s, u, a or - (by the role's first letter);
    ``faults`` too: blank, duplicate, truncated or -.  ``after`` prices each
    state at the end; only a ``closing`` block inserts rows behind its last.
    """

    def __init__(self, kinds: str, faults: str, after: tuple[int, ...], closing: bool):
        n = len(kinds)
        self.arcs: list[list[tuple[str, int, int]]] = []
        least, self.prices = min(after), []
        for at in range(n + 1):
            for state in range(4):
                arcs = []
                if at == n:
                    arcs += [("", after[state] - least, _GOAL)] if after[state] < _FAR else []
                else:
                    arcs.append(("D", DELETE, 4 * at + 4 + state))
                if at < n or closing:
                    arcs.append(("I", INSERT, 4 * at + _TURN[state]))
                if at < n and faults[at] not in "bd":
                    late = UNFINISHED if faults[at] == "t" else 0
                    if (state, kinds[at]) in _NEXT:
                        arcs.append(("K", KEEP + late, 4 * at + 4 + _NEXT[state, kinds[at]]))
                    arcs.append(("R", RENAME + late, 4 * at + 4 + _TURN[state]))
                self.arcs.append(arcs)
        rest = 0
        for at in range(n, -1, -1):  # what the rows cost whatever is done with them
            self.prices[:0] = [rest] * 4
            rest += {"b": DELETE, "d": DELETE, "t": UNFINISHED}.get(faults[at - 1], 0) if at else 0
        ways = {_GOAL}
        for node in (4 * at + state for at in range(n, -1, -1) for _ in range(3) for state in range(4)):  # inserts go through three states at most
            if any(j in ways for _, _, j in self.arcs[node]):
                ways.add(node)
        self.prices = [p if node in ways else _FAR for node, p in enumerate(self.prices)]  # dead ends
        self.prices.append(0)  # the goal's, at index -1
        self.exact = {_GOAL}

    def distance(self, start: int) -> int:
        """Least cost from a node to the goal, ``_FAR`` if there is no way; prices on the way are exact afterwards."""
        prices, path = self.prices, [start]
        if prices[start] >= _FAR:
            return _FAR
        while path[-1] not in self.exact:
            i = path[-1]
            best, to = min((cost + prices[j], j) for _, cost, j in self.arcs[i])
            if prices[i] < best:
                prices[i] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        self.exact.update(path)
        return prices[start]

    def least(self, start: int) -> tuple[str, int]:
        """(letters of the cheapest way, the ASCII-least of several; the node it leaves from)."""
        letters, i = [], start
        self.distance(i)
        while True:
            for letter, cost, j in self.arcs[i]:
                if self.prices[i] == cost + self.prices[j] and self.prices[i] == cost + self.distance(j):
                    break
            if j == _GOAL:
                return "".join(letters), i
            letters.append(letter)
            i = j


@lru_cache(maxsize=50_000)
def costs_between(kinds: str, faults: str, closing: bool) -> tuple[int, ...]:
    """Least cost of a block from each state to each state, 16 numbers."""
    to = [Lattice(kinds, faults, tuple(0 if s == end else _FAR for s in range(4)), closing) for end in range(4)]
    return tuple(to[end].distance(begin) for begin in range(4) for end in range(4))


@lru_cache(maxsize=50_000)
def traced(kinds: str, faults: str, after: tuple[int, ...], closing: bool, begins: tuple[int, ...]) -> tuple[tuple[str, int, int], ...]:
    """(letters, end state, cost without what comes after) of a block for each state that it may begin in."""
    lattice, out = Lattice(kinds, faults, after, closing), []
    for begin in begins:
        cost = lattice.distance(begin)
        if cost >= _FAR:
            out.append(("", begin, 0))  # nothing begins here
            continue
        letters, node = lattice.least(begin)
        out.append((letters, node % 4, cost + min(after) - after[node % 4]))
    return tuple(out)


def replay(letters: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of each row that is left after the edits."""
    at = 0
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        state = _NEXT[state, roles[at][:1]] if letter == "K" else _TURN[state]
        yield letter, roles[at] if letter == "K" else _ROLE[state], "" if letter == "I" else texts[at]
        at += letter != "I"


_BLOCK = "conv_id long, part long, roles array<string>, texts array<string>, faults string, first_turn long, last_turn long, n_turns long"


def _arrow(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


_BLOCK_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int64()]
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


def _cut(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows in order (conv_id, turn, role, text, seen) to blocks of one conversation each; a row like the one before it is a duplicate."""
    part, rows, chars, before = TaskContext.get().partitionId() << 33, [], 0, None

    def closed() -> tuple:
        turns = [r[1] for r in rows if r[1] is not None]
        return (rows[0][0], part, [r[2] for r in rows], [r[3] for r in rows], "".join(r[4] for r in rows), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)))

    for batch in batches:
        out = []
        for conv, turn, role, text, seen in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen"))):
            if rows and (rows[0][0] != conv or len(rows) == block_rows or chars > BLOCK_CHARS):
                out.append(closed())
                part, rows, chars = part + 1, [], 0
            row, ink = (conv, turn, role, text), text.strip(SPACE)
            rows.append((*row, "b" if not ink else "d" if seen or row == before else "t" if not ink.endswith(ENDS) else "-"))
            chars, before = chars + len(text), row
        yield _arrow(out, _BLOCK_TYPES, _BLOCK_NAMES)
    if rows:
        yield _arrow([closed()], _BLOCK_TYPES, _BLOCK_NAMES)


def _kinds(roles: list[str]) -> str:
    return "".join(r[0] if r[:1] in ("s", "u", "a") else "-" for r in roles)


def blocks_of(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of all conversations of ``turns`` (conv_id, turn, role, text): a table, ``part`` in the order of the rows.

    Rows are dealt by ranges of (conv_id, turn, role, text), so a long
    conversation is in many tasks.
    """
    null = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), null("role"), null("text"))
    rows = rows.withColumn("_name", F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256))
    # The order of rows of one role and text is that of their turns: what comes after the first turn was seen before.
    first = rows.groupBy("conv_id", "_name").agg(F.min(F.struct("turn")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("conv_id").alias("_conv"), F.col("_name").alias("_same"), "_first")
    marked = rows.join(first, rows["conv_id"].eqNullSafe(F.col("_conv")) & (rows["_name"] == F.col("_same")), "left")
    marked = table(marked.select("conv_id", "turn", "role", "text", F.coalesce(F.struct("turn") > F.col("_first"), F.lit(False)).alias("seen")), "turns")
    order = ["conv_id", "turn", "role"]
    return table(marked.repartitionByRange(*order, F.substring("text", 1, TIE)).sortWithinPartitions(*order, "text").mapInArrow(lambda batches: _cut(batches, block_rows), _BLOCK), "blocks")


def prices_after(blocks: DataFrame) -> DataFrame:
    """part, after (price of each state at the block's end), closing, for blocks of conversations that have several."""
    sizes = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"), F.max("part").alias("_last")).where("_n > 1").select(F.col("conv_id").alias("_conv"), "_last")
    several = blocks.select("conv_id", "part", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("roles"), "faults").join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv")))
    several = several.select("conv_id", "part", "roles", "faults", (F.col("part") == F.col("_last")).alias("closing"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, faults, closing = (batch.column(c).to_pylist() for c in ("roles", "faults", "closing"))
            costs = [costs_between(_kinds(r), f, c) for r, f, c in zip(roles, faults, closing)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("closing"), pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "part", "closing", "costs"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _END
        for batch in batches:
            rows = []
            for part, closing, costs in zip(*(batch.column(c).to_pylist() for c in ("part", "closing", "costs"))):
                now = _END if closing else now
                rows.append((part, closing, now))
                now = tuple(min(_FAR, *(costs[4 * a + b] + now[b] for b in range(4))) for a in range(4))
            yield _arrow(rows, [pa.int64(), pa.bool_(), pa.list_(pa.int64())], ["part", "closing", "after"])

    matrices = several.mapInArrow(solve, "conv_id long, part long, closing boolean, costs array<long>")
    return matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part")).mapInArrow(back, "part long, closing boolean, after array<long>")


_TRACED = _BLOCK + ", only boolean, letters array<string>, states array<long>, costs array<long>"


def traced_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with ``letters``, end ``states`` and ``costs`` by begin state: (whole conversations, blocks of the others)."""
    after = table(prices_after(blocks), "prices").withColumnRenamed("part", "_part")
    both = blocks.join(after, F.col("part") == F.col("_part"), "left").drop("_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for roles, faults, after, closing in zip(*(batch.column(c).to_pylist() for c in ("roles", "faults", "after", "closing"))):
                only = after is None
                ways = traced(_kinds(roles), faults, _END if only else tuple(after), only or closing, (NOTHING,) if only else (NOTHING, SYSTEM, USER, ASSISTANT))
                for column, value in zip(out, (only, *map(list, zip(*ways)))):
                    column.append(value)
            types = [pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _BLOCK_NAMES), *(pa.array(c, t) for c, t in zip(out, types))], names=[*_BLOCK_NAMES, "only", "letters", "states", "costs"])

    return tuple(both.where(c).mapInArrow(run, _TRACED) for c in ("after IS NULL", "after IS NOT NULL"))


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT_TYPES = [*[pa.int64()] * 7, pa.string(), pa.string()]
_REPORT_NAMES = [c.split()[0] for c in _REPORT.split(", ")]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its blocks in order; between them only counts, letters and a running digest are kept."""
    key, s = (), None

    def closed() -> tuple:
        gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
        return (key[0], gaps, s["b"], s["d"], s["t"], s["illegal"], s["cost"], "".join(s["audit"]), s["digest"].hexdigest())

    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "roles", "texts", "faults", "first_turn", "last_turn", "n_turns", "letters", "states", "costs"))):
            conv, roles, texts, faults, low, high, n_turns, letters, states, costs = row
            if key != (conv,):
                if s:
                    out.append(closed())
                key, s = (conv,), {"low": None, "high": None, "turns": 0, "b": 0, "d": 0, "t": 0, "illegal": 0, "cost": 0, "audit": [], "digest": hashlib.sha256(), "state": NOTHING, "kind": None, "any": False}
            for fault in "bdt":
                s[fault] += faults.count(fault)
            kinds = (s["kind"] or "") + _kinds(roles)
            s["illegal"] += sum(kinds[i : i + 2] not in _LEGAL for i in range(len(kinds) - 1))
            s["kind"] = kinds[-1]
            if n_turns:
                s["turns"] += n_turns - (s["high"] == low)
                s["low"], s["high"] = low if s["low"] is None else s["low"], high
            begin = s["state"]
            for _, role, text in replay(letters[begin], begin, roles, texts):
                s["digest"].update(("\n" if s["any"] else "").encode() + f"{role}:{text}".encode())
                s["any"] = True
            s["audit"].append(letters[begin])
            s["cost"], s["state"] = s["cost"] + costs[begin], states[begin]
        yield _arrow(out, _REPORT_TYPES, _REPORT_NAMES)
    if s:
        yield _arrow([closed()], _REPORT_TYPES, _REPORT_NAMES)


_ROWS = "conv_id long, part long, place long, edit string, role string, text string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of repaired conversations, from their blocks in order."""
    key, state = (), NOTHING
    for batch in batches:
        out = []
        for conv, part, roles, texts, letters, states in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "roles", "texts", "letters", "states"))):
            key, state = (conv,), state if key == (conv,) else NOTHING
            out += [(conv, part, k, *row) for k, row in enumerate(replay(letters[state], state, roles, texts))]
            state = states[state]
        yield _arrow(out, [pa.int64()] * 3 + [pa.string()] * 3, ["conv_id", "part", "place", "edit", "role", "text"])


def _along(turns: DataFrame, run, schema: str, block_rows: int) -> DataFrame:
    whole, others = traced_blocks(blocks_of(turns, block_rows))
    return whole.mapInArrow(run, schema).unionByName(others.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema))


def repair_report(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults, cost, edits (``audit``) and digest of the repaired text of each conversation of ``turns`` (conv_id, turn, role, text).

    Rows go by turn (nulls first), ties by role, then text; null roles and texts
    are one space.  A row's first fault counts: blank, duplicate (its role and
    text came before in its conversation), truncated (no ``.``, ``!`` or ``?`` at
    its end).  Edits: K keeps a row, R makes it a user or assistant row (2), D
    deletes it (3; must be for blank and duplicate rows), I inserts an empty
    user or assistant row (2); truncated rows that stay cost 1.  Rows without a
    conv_id are one conversation.  Repeated rows are duplicates; other columns
    go; an empty table gives none.
    Only a conversation's digest and its letters pass through one task, block by block.
    """
    return _along(turns, _report, _REPORT, block_rows)


def repaired_turns(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, part, place, edit, role, text: the rows of the repaired conversations, in the order of (part, place)."""
    return _along(turns, _rows, _ROWS, block_rows)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with rows dropped, emptied, cut, repeated or given to the user, by the checksum of ``conv_id:turn``."""
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(null("conv_id"), F.lit(":"), null("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", null("role").alias("role"), null("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_n"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_copy", "_n")


def op12_conversation_repair(spark: SparkSession, sf_dir: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report = repair_report(damaged(turns), block_rows)
    ids = turns.select(F.col("conv_id").alias("_id")).distinct()
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _REPORT_NAMES[1:7]}
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return ids.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(F.col("_id").alias("conv_id"), *zero.values(), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])


#: Cheapest edits from the last row back to the first; a value is (cost, letters, repaired text), and the least one wins.
ORACLE_SQL = r"""
WITH RECURSIVE bits(k, i, v) AS (
  SELECT 0, i, i FROM range(256) r(i)
  UNION ALL SELECT k + 1, i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), steps AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
rows AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), named AS (
  SELECT rows.*, xor(4294967295, list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ord(substr(name, i, 1)) AS BIGINT)), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295)) % 20 AS kind
  FROM rows, steps
), changed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink FROM changed
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS next_kind FROM placed
), f AS (
  SELECT *, left(role, 1) AS kind, CASE WHEN ink = '' THEN 'b' WHEN again THEN 'd' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM seen
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (next_kind IS NOT NULL AND kind || next_kind NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
), dp(conv_id, pos, v0, vs, vu, va) AS (
  SELECT conv_id, n + 1, {c: 0, a: '', t: ''}, {c: 4, a: 'II', t: 'user:' || chr(10) || 'assistant:'}, {c: 2, a: 'I', t: 'assistant:'}, {c: 0, a: '', t: ''} FROM counts
  UNION ALL
  SELECT conv_id, pos,
    list_min([r0, {c: mu.c + 2, a: 'I' || mu.a, t: 'user:' || CASE WHEN mu.t = '' THEN '' ELSE chr(10) || mu.t END}]),
    list_min([rs, {c: mu.c + 2, a: 'I' || mu.a, t: 'user:' || CASE WHEN mu.t = '' THEN '' ELSE chr(10) || mu.t END}]),
    mu,
    list_min([ra, {c: ru.c + 2, a: 'I' || ru.a, t: 'user:' || CASE WHEN ru.t = '' THEN '' ELSE chr(10) || ru.t END}])
  FROM (
    SELECT *, list_min([ru, {c: ra.c + 2, a: 'I' || ra.a, t: 'assistant:' || CASE WHEN ra.t = '' THEN '' ELSE chr(10) || ra.t END}]) AS mu
    FROM (
      SELECT dp.conv_id, f.pos,
        list_min([{c: v0.c + 3, a: 'D' || v0.a, t: v0.t},
          {c: vs.c + late + CASE WHEN kind = 's' THEN 0 ELSE 1000000 END, a: 'K' || vs.a, t: line || CASE WHEN vs.t = '' THEN '' ELSE chr(10) || vs.t END},
          {c: vu.c + late + CASE WHEN kind = 'u' THEN 0 ELSE 1000000 END, a: 'K' || vu.a, t: line || CASE WHEN vu.t = '' THEN '' ELSE chr(10) || vu.t END},
          {c: vu.c + late + 2, a: 'R' || vu.a, t: 'user:' || text || CASE WHEN vu.t = '' THEN '' ELSE chr(10) || vu.t END}]) AS r0,
        list_min([{c: vs.c + 3, a: 'D' || vs.a, t: vs.t},
          {c: vu.c + late + CASE WHEN kind = 'u' THEN 0 ELSE 1000000 END, a: 'K' || vu.a, t: line || CASE WHEN vu.t = '' THEN '' ELSE chr(10) || vu.t END},
          {c: vu.c + late + 2, a: 'R' || vu.a, t: 'user:' || text || CASE WHEN vu.t = '' THEN '' ELSE chr(10) || vu.t END}]) AS rs,
        list_min([{c: vu.c + 3, a: 'D' || vu.a, t: vu.t},
          {c: va.c + late + CASE WHEN kind = 'a' THEN 0 ELSE 1000000 END, a: 'K' || va.a, t: line || CASE WHEN va.t = '' THEN '' ELSE chr(10) || va.t END},
          {c: va.c + late + 2, a: 'R' || va.a, t: 'assistant:' || text || CASE WHEN va.t = '' THEN '' ELSE chr(10) || va.t END}]) AS ru,
        list_min([{c: va.c + 3, a: 'D' || va.a, t: va.t},
          {c: vu.c + late + CASE WHEN kind = 'u' THEN 0 ELSE 1000000 END, a: 'K' || vu.a, t: line || CASE WHEN vu.t = '' THEN '' ELSE chr(10) || vu.t END},
          {c: vu.c + late + 2, a: 'R' || vu.a, t: 'user:' || text || CASE WHEN vu.t = '' THEN '' ELSE chr(10) || vu.t END}]) AS ra
      FROM dp JOIN (SELECT *, role || ':' || text AS line, CASE fault WHEN '-' THEN 0 WHEN 't' THEN 1 ELSE 1000000 END AS late FROM f) f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos - 1
    )
  )
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(v0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM ids.conv_id AND dp.pos = 1
"""
