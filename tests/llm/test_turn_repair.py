"""Conversation repair beside a plain search over all edits, on blocks of every size."""

import random
import zlib
from functools import lru_cache

import plain
import pytest
from kinfold.llm import turn_repair as tr
from pyspark.sql import functions as F

COLUMNS = ["conv_id", *tr.COUNTS, "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, g string, codes int, alive string"


def shown(value):
    return " " if value is None else str(value)


def plain_damage(rows):
    out = []
    for conv_id, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20
        text = "" if kind == 1 else shown(text).translate({ord(c): None for c in ".!?"}) if kind == 2 else shown(text)
        out += [(conv_id, turn, "user" if kind == 4 else shown(role), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows, every_id):
    """The result columns of every conversation, and its repaired turns."""
    found = {}
    for conv_id in every_id:
        mine = sorted(((t, r, x) for c, t, r, x in rows if c == conv_id), key=lambda m: (m[0] is not None, m[0] or 0, m[1], plain.md5(m[2])))
        seen, faults = set(), []
        for _, role, text in mine:
            said = text.rstrip(tr.BLANKS)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, state, inserted=0):
            """(cost, audit, turns) from the i-th turn on; the state is the string of initials that a repair can have, cut short"""
            options = []
            if i == len(mine):
                if state in ("", "a"):
                    options.append((0, "", ()))
            else:
                (_, role, text), fault = mine[i], faults[i]
                cost, audit, turns = best(i + 1, state)
                options.append((cost + 4, "D" + audit, turns))
                if fault in ("", "truncated"):
                    extra = 3 * (fault == "truncated")
                    for letter, name, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                        if name and state + name[:1] in ("s", "u", "su", "au", "ua"):
                            cost, audit, turns = best(i + 1, name[:1])
                            options.append((cost + extra + price, letter + audit, ((letter, name, text), *turns)))
            if inserted < 3:
                for name in ("user", "assistant"):
                    if state + name[0] in ("u", "su", "au", "ua"):
                        cost, audit, turns = best(i, name[0], inserted + 1)
                        options.append((cost + 3, "I" + audit, (("I", name, ""), *turns)))
            return min(options, default=(10**9, "", ()))

        cost, audit, turns = best(0, "")
        known = [t for t, _, _ in mine if t is not None]
        roles = [r[:1] for _, r, _ in mine]
        found[conv_id] = (
            (conv_id, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
             sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, plain.sha("\n".join(f"{r}:{x}" for _, r, x in turns))),
            [(conv_id, i, *t) for i, t in enumerate(turns)])
    return found


def awkward():
    rng = random.Random(11)
    rows = []
    for conv_id in [*range(30), None, 9_000_000_000]:
        for turn in range(rng.choice([1, 1, 2, 5, 9, 30, 60] if conv_id != 7 else [120])):
            if rng.random() < 0.1:
                turn = rng.choice([None, turn + 3, 0])
            role = rng.choice(["user", "assistant", "user", "assistant", "user", "system", "tool", None, "User", ""] if conv_id != 7 else ["system"])
            text = rng.choice([None, "", " \t", "Yes.", "No", "é\U0001F600", "word " * 50 + "!", f"Turn {rng.randint(0, 9)}.", f"Turn {rng.randint(0, 9)}"] + ["Fine."] * (conv_id == 3)
                              if conv_id != 7 else [f"{turn}."])
            rows.append((conv_id, turn, role, text, "g", 1, "x"))
    return rows + rows[:5] + [(3, 1, "user", "Fine.", "g", 1, "x")] * 40 + [(None, None, None, None, None, None, None)]


def same(df, want):
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_damaged_and_repaired(spark):
    rows = awkward()
    want = plain_repair(plain_damage(rows), {r[0] for r in rows})
    same(tr.repair_damaged(spark.createDataFrame(rows, SCHEMA)), [w for w, _ in want.values()])


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = plain_repair(plain_damage(rows), {r[0] for r in rows})
    assert any(w[-2].strip("K") for w, _ in want.values())
    same(tr.repair_damaged(df), [w for w, _ in want.values()])


@pytest.mark.parametrize("block_rows", [1, 3, 16])
def test_blocks(spark, tmp_path, block_rows):
    rows = awkward()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "turns"))
    df = spark.read.parquet(str(tmp_path / "turns"))
    want = plain_repair([(c, t, shown(r), shown(x)) for c, t, r, x, *_ in rows], {r[0] for r in rows})
    same(tr.repair(df, None, block_rows), [w for w, _ in want.values()])
    got = [tuple(r) for r in tr.repaired_turns(df, None, block_rows).collect()]
    assert sorted(got, key=repr) == sorted((t for _, turns in want.values() for t in turns), key=repr)


def test_passes_are_bounded_by_tasks(spark):
    """A chain whose vectors never converge (its parity reaches from end to end) is carried through a task's blocks in one pass."""
    blocks = spark.createDataFrame([(g, 1, "xxx") for g in range(40)] + [(g, 2, "ua" * 5) for g in range(40, 60)], "g long, conv_id long, codes string")
    for group in (100, 10):
        state, passes = tr.converged(blocks, group)
        vectors, steps, _ = tr.tables()
        due = {r["g"]: r for r in state.collect()}
        for g in range(60):
            after = due[g + 1]["out"] if g + 1 in due and due[g + 1]["conv_id"] == due[g]["conv_id"] else 0
            assert due[g]["given"] == after and tr.solved(due[g]["codes"], after, steps)[1] == due[g]["out"]
        assert passes <= 60 // group + 1


def test_empty(spark):
    assert tr.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tr.repair(spark.createDataFrame([(5, None, None, None)], "conv_id long, turn long, role string, text string"), F.lit(False)).collect()[0]["audit"] == ""


def test_steps_are_least_costs():
    vectors, steps, moves = tr.tables()
    for (number, code), (before, added) in steps.items():
        for state in range(4):
            letters, after = moves[number, code][state]
            price = sum({"D": 4, "I": 3, "R": 3 + 3 * code.isupper(), "K": 3 * code.isupper()}[x] for x in letters)
            assert price + vectors[number][after] == vectors[before][state] + added
