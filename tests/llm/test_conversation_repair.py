"""Conversation repair: the auction against plain dynamic programming, long conversations in blocks, edge cases."""

from __future__ import annotations

import random
from functools import lru_cache

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import conversation_repair as op

TURNS = "conv_id long, turn long, role string, text string, faults string"


def brute(kinds: str, faults: str) -> tuple[int, str]:
    """(cost, letters) of the cheapest repair by states "", s, u, a."""
    follows = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}

    @lru_cache(None)
    def best(at: int, state: str, inserts: int) -> tuple[int, str]:
        ways = [(0, "")] if at == len(kinds) and state in ("", "a") else []
        turn = "a" if state == "u" else "u"
        add = lambda cost, letter, rest: ways.append((cost + rest[0], letter + rest[1]))
        if inserts < 2:
            add(2, "I", best(at, turn, inserts + 1))
        if at < len(kinds):
            late = faults[at] == "t"
            add(3, "D", best(at + 1, state, 0))
            if faults[at] not in "bd":
                add(2 + late, "R", best(at + 1, turn, 0))
                if (state, kinds[at]) in follows:
                    add(late, "K", best(at + 1, kinds[at], 0))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


@given(st.lists(st.tuples(st.sampled_from("ssuuuaaa-"), st.sampled_from("bdt----")), max_size=12))
@settings(max_examples=400, deadline=None)
def test_auction_finds_the_least_of_the_cheapest(rows):
    kinds, faults = "".join(k for k, _ in rows), "".join(f for _, f in rows)
    ((letters, _, cost),) = op.traced(kinds, faults, op._END, True, (op.NOTHING,))
    assert (cost, letters) == brute(kinds, faults)


def test_prices_never_exceed_arcs():
    rng = random.Random(5)
    lattice = op.Lattice("".join(rng.choice("sua-") for _ in range(60)), "".join(rng.choice("bdt---") for _ in range(60)), op._END, True)
    lattice.distance(op.NOTHING)
    assert all(lattice.prices[i] <= cost + lattice.prices[j] for i, arcs in enumerate(lattice.arcs) for _, cost, j in arcs)


def odd_turns(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Why? ", "a" * 70 + "!", "é.", None, "two\nlines."]
    return [(rng.choice([1, 2, 2, 2, 3, None]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts), "x") for _ in range(n)]


@pytest.mark.parametrize("seed,n,block_rows", [(1, 40, 64), (2, 120, 64), (3, 120, 3), (4, 150, 1)])
def test_blocks_against_sql(spark, tmp_path, seed, n, block_rows):
    spark.createDataFrame(odd_turns(seed, n), TURNS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(op.ORACLE_SQL)
    got = op.op12_conversation_repair(spark, str(tmp_path), block_rows)
    cols = want.columns
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_a_long_conversation_is_cut_anywhere(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"text {i}" + "." * (i % 9 != 0), "") for i in range(2000) if i % 50]
    turns = spark.createDataFrame(rows, TURNS)
    small, large = (op.repair_report(turns, n).collect() for n in (16, 100_000))
    assert small == large and small[0]["gaps"] == 39 and small[0]["truncated"] == sum(1 for r in rows if r[1] % 9 == 0)
    assert op.blocks_of(turns, 16).select("part").distinct().count() > 100


def test_repaired_rows_read_well(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Be kind.", ""), (1, 1, "assistant", "Hello.", ""), (1, 2, "user", "Hi?", ""), (1, 2, "user", "Hi?", ""), (1, 3, "tool", "x.", ""), (1, 4, "user", " ", "")], TURNS)
    got = [(r["edit"], r["role"], r["text"]) for r in op.repaired_turns(turns).orderBy("part", "place").collect()]
    assert got == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hi?"), ("R", "assistant", "x.")]
    (row,) = op.repair_report(turns).collect()
    assert (row["blank"], row["duplicate"], row["truncated"], row["cost"], row["audit"]) == (1, 1, 0, 10, "KIKKDRD")


def test_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert op.repair_report(none).count() == 0 and op.repaired_turns(none).count() == 0
