"""Conversations repaired by the cheapest edits that make their roles alternate.

A conversation is good if its role initials are nothing, or an optional `s` and then `ua` once or more. Turns are kept (0),
given the role user or assistant (3), deleted (4), or inserted with an empty text as user or assistant (3). Blank turns and
later turns with a role and text seen before must go; a turn that does not end a sentence costs 3 more if it stays.
The audit is the string of the edits' initials, D I K R; of equally cheap ones the least.

Method: rank-convergence parallel Viterbi. Turns are dealt out by ranges of (conversation, turn), so a long conversation is
spread over tasks, and cut in blocks. Each block is solved backward at once from a speculative vector: what the rest of
the conversation costs from each of the four states of the pattern, guessed as if nothing followed. Fix-up passes then
give each block the vector that its successor really has. A block runs the old and the new vector side by side and
stops where they differ by a constant only, since all before stands; passes go on until no block has an outdated vector.
Vectors are kept less their least entry, of which few are possible, so that a step is a lookup. The stitched vectors say of
every edit whether a cheapest repair goes on with it; from the first turn on, the least such letter is taken.

A pass carries vectors through all blocks that a task holds, so there are at most as many passes as tasks that share
a conversation; one or two are usual. A conversation of one block that touches no end of its task's range needs none. What is
sequential is only what one value of the result asks for: the digest of a conversation is streamed, block by block.

Ties of turn: by role, then by the md5 of the text; equal rows are next to each other. `turns` should be files or a
written table, since equal rows are dealt out by their place in it.

Defined cases: a null conv_id is one conversation; null turns come first and have no part in gaps; null roles and texts are
one space (so that such turns are blank, or of no known role); an empty role is no known role, it cannot be kept; empty and blank texts are blank; texts of any length are
whole (a turn fits in a task); repeated rows are duplicates; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from kinfold.session import join_sized, staged

BLOCK_ROWS = 128
BLOCK_BYTES = 1 << 20
OUT_BYTES = 4 << 20
INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # what has been said so far
ASKED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by an inserted or re-roled turn
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {("s", START): SYSTEM, **{("u", s): USER for s in (START, SYSTEM, ASSISTANT)}, ("a", USER): ASSISTANT}
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
END = tuple(INSERT * len(CLOSING[s]) for s in range(4))
MUST_GO = "-"
CODES = "suaxSUAX-"  # role initial, capital if the text is cut off; or a turn that must go
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = "array<struct<edit:string,role:string,text:string>>"
RESULT = ", ".join(["conv_id long", *[f"{c} long" for c in COUNTS], "audit string", "repaired_sha256 string", "place long", f"repaired {REPAIRED}"])
RESULT_ARROW = pa.schema([
    ("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("place", pa.int64()),
    ("repaired", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])))])
BLOCK = "part int, seq long, codes string, keys array<binary>, turns array<long>, roles array<string>, texts array<string>"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("codes", pa.string()), ("keys", pa.list_(pa.binary())),
                         ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
STATE = "g long, conv_id long, codes string, given int, out int"


def stepped(after: Vector, code: str) -> tuple[Vector, int]:
    """The vector before a turn, less its least entry, and that entry."""
    costs = []
    for state in range(4):
        best = DELETE + after[state]
        if code != MUST_GO:
            extra = CUT_OFF * code.isupper()
            best = min(best, REROLE + extra + after[ASKED[state]])
            if (code.lower(), state) in KEPT:
                best = min(best, extra + after[KEPT[code.lower(), state]])
        costs.append(best)
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    costs = [min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]
    least = min(costs)
    return tuple(c - least for c in costs), least


def moved(state: int, after: Vector, code: str) -> tuple[str, int]:
    """The least letters that lead from a state past a turn at least cost, and the state then."""
    vector, least = stepped(after, code)
    before = [v + least for v in vector]
    letters = ""
    while True:
        if DELETE + after[state] == before[state]:
            return letters + "D", state
        if INSERT + before[ASKED[state]] == before[state]:
            letters, state = letters + "I", ASKED[state]
            continue
        kept = KEPT.get((code.lower(), state))
        if kept is not None and CUT_OFF * code.isupper() + after[kept] == before[state]:
            return letters + "K", kept
        return letters + "R", ASKED[state]


def tables() -> tuple[list[Vector], dict, dict]:
    """All vectors that can come up, END first; steps {(vector, code): (vector before, added)}; moves {(vector, code): by state}.

    Vectors stand for their number in the list. Insertions keep the entries within a few units of each other, so they are few.
    """
    number, queue, steps, moves = {END: 0}, [END], {}, {}
    for vector in queue:
        for code in CODES:
            before, added = stepped(vector, code)
            if before not in number:
                number[before] = len(queue)
                queue.append(before)
            steps[number[vector], code] = number[before], added
            moves[number[vector], code] = [moved(state, vector, code) for state in range(4)]
    return queue, steps, moves


def code_of(role: str, text: str) -> str:
    """Role initial in small letters (x for others), a capital where the text is cut off, or MUST_GO for a blank text."""
    said = text.rstrip(BLANKS)
    if not said:
        return MUST_GO
    code = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return code if said[-1] in ".!?" else code.upper()


def solved(codes: str, given: int, steps: dict) -> tuple[list[int], int]:
    """The vector after each turn of a block, from the one after its last turn; and the vector before its first."""
    after, vector = [0] * len(codes), given
    for i in range(len(codes) - 1, -1, -1):
        after[i] = vector
        vector = steps[vector, codes[i]][0]
    return after, vector


def fixed(codes: str, old: int, new: int, out: int, steps: dict) -> int:
    """The vector before the first turn for a new vector after the last one; `out` is that for the old one."""
    for code in reversed(codes):
        if old == new:  # they differed by a constant: what was found before stands
            return out
        old, new = steps[old, code][0], steps[new, code][0]
    return new


class Account:
    """What is told of a conversation while its blocks pass in order."""

    def __init__(self, conv_id: int | None, turns: bool):
        self.conv_id, self.with_turns = conv_id, turns
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.distinct = self.place = 0
        self.low = self.last_turn = None
        self.initial, self.state, self.audit, self.sha, self.empty = None, START, [], hashlib.sha256(), True

    def say(self, edit: str, role: str, text: str, out: list) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False
        if self.with_turns:
            out.append({"edit": edit, "role": role, "text": text})

    def block(self, codes: str, given: int, turns: list, roles: list, texts: list, steps: dict, moves: dict) -> list:
        """Takes the next block; the repaired turns, if they are asked for."""
        out: list = []
        after, _ = solved(codes, given, steps)
        for code, vector, turn, role, text in zip(codes, after, turns, roles, texts):
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.distinct += turn != self.last_turn
                self.last_turn = turn
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in LEGAL
            self.initial = role[:1]
            if code == MUST_GO:
                empty = not text.strip(BLANKS)
                self.blank += empty
                self.duplicate += not empty
            self.truncated += code.isupper()
            letters, state = moves[vector, code][self.state]
            self.audit.append(letters)
            for letter in letters:
                if letter == "I":
                    self.insert(out)
                elif letter == "D":
                    self.cost += DELETE
                else:
                    self.cost += REROLE * (letter == "R") + CUT_OFF * code.isupper()
                    self.say(letter, role if letter == "K" else NAMES[state], text, out)
            self.state = state
        return out

    def insert(self, out: list) -> None:
        self.state = ASKED[self.state]
        self.cost += INSERT
        self.say("I", NAMES[self.state], "", out)

    def close(self) -> list:
        out: list = []
        self.audit.append(CLOSING[self.state])
        for _ in CLOSING[self.state]:
            self.insert(out)
        return out

    def row(self, repaired: list | None, closed: bool) -> tuple:
        """The result; with the turns asked for, a row of turns for each block, and the other columns in the last one only."""
        repaired, place = repaired if self.with_turns else None, self.place
        self.place += len(repaired or [])
        if not closed:
            return self.conv_id, *[None] * (len(COUNTS) + 2), place, repaired
        gaps = 0 if self.low is None else self.last_turn - self.low + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest(),
                place, repaired)


def key_of(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def batches_of(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def result_weight(row: tuple) -> int:
    return 300 + len(row[-4] or "") + sum(60 + len(t["text"]) for t in row[-1] or [])


def in_order(turns: DataFrame, alive: Column | None) -> DataFrame:
    """Turns in ranges of (conv_id, turn, role, digest of the text, place in the table), sorted by them."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.lit(True) if alive is None else alive).alias("alive"))
    rows = rows.withColumn("mark", F.md5(F.col("text").cast("binary"))).withColumn("nth", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "mark", "nth"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "alive")


def walked(turns: DataFrame, alive: Column | None, with_turns: bool, block_rows: int, block_bytes: int) -> DataFrame:
    """Results of the conversations that a task sees whole in one block (codes is null), and the blocks of the others."""
    _, steps, moves = tables()
    schema = pa.schema([*RESULT_ARROW, *BLOCK_ARROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def blocks() -> Iterator[tuple]:
            """(conversation's number in the task, conv_id, whether its last block, turns, roles, texts)"""
            conv, number, size, held = None, -1, 0, ([], [], [])
            for batch in batches:
                for conv_id, turn, role, text, alive in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "alive"))):
                    if number < 0 or conv_id != conv:
                        if number >= 0:
                            yield number, conv, True, *held
                        conv, number, size, held = conv_id, number + 1, 0, ([], [], [])
                    if not alive:
                        continue
                    if held[0] and (len(held[0]) >= block_rows or size + len(text) > block_bytes):
                        yield number, conv, False, *held
                        size, held = 0, ([], [], [])
                    for values, value in zip(held, (turn, role, text)):
                        values.append(value)
                    size += len(text)
            if number >= 0:
                yield -1, conv, True, *held  # the next task may go on with it

        def rows() -> Iterator[tuple]:
            seq, going_on = 0, False
            for number, conv_id, last, turns, roles, texts in blocks():
                codes, keys, seen = [], [], set()
                for role, text in zip(roles, texts):
                    code, key = code_of(role, text), None
                    if code != MUST_GO:
                        key = key_of(role, text)
                        if key in seen:
                            code, key = MUST_GO, None
                        else:
                            seen.add(key)
                    codes.append(code)
                    keys.append(key)
                codes = "".join(codes)
                if last and number > 0 and not going_on:
                    account = Account(conv_id, with_turns)
                    repaired = account.block(codes, 0, turns, roles, texts, steps, moves)
                    yield *account.row(repaired + account.close(), True), *[None] * len(BLOCK_ARROW)
                else:
                    yield conv_id, *[None] * (len(RESULT_ARROW) - 1), part, seq, codes, keys, turns, roles, texts
                    seq += 1
                going_on = not last

        yield from batches_of(rows(), schema, lambda r: result_weight(r[: len(RESULT_ARROW)]) + sum(100 + len(t) for t in r[-1] or []))

    return in_order(turns, alive).mapInArrow(run, f"{RESULT}, {BLOCK}")


def coded(blocks: DataFrame) -> DataFrame:
    """(g, conv_id, codes) of the blocks, with turns that must go because another block of the conversation has them earlier.

    A block sends each of its distinct turns once, as a digest with its first place.
    """
    keys = staged(blocks.select("g", "conv_id", F.posexplode("keys").alias("i", "key")).where("key IS NOT NULL"), "turn-keys")
    first = keys.groupBy("conv_id", "key").agg(F.min("g").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = staged(first.select(F.col("conv_id").alias("of"), F.col("key").alias("same"), "first"), "turn-firsts")
    again = keys.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same"))).where("g > first")
    again = again.groupBy("g").agg(F.collect_set("i").alias("again"))  # places in one block
    code = F.transform(F.split("codes", ""), lambda c, i: F.when(F.array_contains("again", i), F.lit(MUST_GO)).otherwise(c))
    return join_sized(blocks.select("g", "conv_id", "codes"), again, ["g"], "left").select(
        "g", "conv_id", F.when(F.col("again").isNull(), F.col("codes")).otherwise(F.concat_ws("", code)).alias("codes"))


def stale(state: DataFrame) -> DataFrame:
    """The state with `due`, the vector that a block's successor has now."""
    nexts = state.select((F.col("g") - 1).alias("g"), F.col("conv_id").alias("next_conv"), F.col("out").alias("next_out"))
    follows = F.col("next_out").isNotNull() & F.col("next_conv").eqNullSafe(F.col("conv_id"))
    return state.join(nexts, "g", "left").select(*state.columns, F.when(follows, F.col("next_out")).otherwise(F.lit(0)).alias("due"))


def converged(coded_blocks: DataFrame, group: int) -> tuple[DataFrame, int]:
    """(g, conv_id, codes, given, out) with the true vector after each block, and the number of fix-up passes."""
    _, steps, _ = tables()
    schema = pa.schema([("g", pa.int64()), ("conv_id", pa.int64()), ("codes", pa.string()), ("given", pa.int32()), ("out", pa.int32())])

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [solved(codes, 0, steps)[1] for codes in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([0] * len(out), pa.int32()), pa.array(out, pa.int32())], schema=schema)

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = None
        for batch in batches:
            rows = []
            for g, conv_id, codes, given, out, due in zip(*(c.to_pylist() for c in batch.columns)):
                if after is not None and after[:2] == (g + 1, conv_id):  # this pass has just found what comes after
                    due = after[2]
                out = fixed(codes, given, due, out, steps)
                after = g, conv_id, out
                rows.append((g, conv_id, codes, due, out))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    state = staged(coded_blocks.mapInArrow(speculate, STATE), "viterbi")
    passes = 0
    while True:
        due = staged(stale(state), "viterbi-due")
        touched = due.where("given <> due").select(F.expr(f"g div {group}").alias("range")).distinct()
        if touched.isEmpty():
            return state, passes
        ranged = due.withColumn("range", F.expr(f"g div {group}"))
        again = join_sized(ranged, touched, ["range"], "left_semi")
        rest = join_sized(ranged, touched, ["range"], "left_anti").select(*state.columns)
        again = again.repartition("range").sortWithinPartitions(F.col("g").desc()).select(*state.columns, "due")
        state = staged(again.mapInArrow(fix, STATE).unionByName(rest), "viterbi")
        passes += 1


def results(turns: DataFrame, alive: Column | None, with_turns: bool, block_rows: int, block_bytes: int) -> DataFrame:
    spark = turns.sparkSession
    _, steps, moves = tables()
    found = staged(walked(turns, alive, with_turns, block_rows, block_bytes), "conversations")
    done = found.where("codes IS NULL").select(*RESULT_ARROW.names)
    blocks = found.where("codes IS NOT NULL")
    sizes = [(r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]  # one row a task
    if not sizes:
        return done
    starts = [(part, end - n) for (part, n), end in zip(sizes, accumulate(n for _, n in sizes))]
    blocks = join_sized(blocks, spark.createDataFrame(starts, "part int, start long"), ["part"]).withColumn("g", F.col("start") + F.col("seq"))
    group = 1 + sum(n for _, n in sizes) // int(spark.conf.get("spark.sql.shuffle.partitions"))
    state, _ = converged(coded(blocks), group)
    open_blocks = join_sized(blocks.select("g", "turns", "roles", "texts"), state.select("g", "conv_id", "codes", "given"), ["g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            account = None
            for batch in batches:
                for conv_id, codes, given, turns, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                    if account is None or account.conv_id != conv_id:
                        if account is not None:
                            yield account.row(account.close(), True)
                        account = Account(conv_id, with_turns)
                    repaired = account.block(codes, given, turns, roles, texts, steps, moves)
                    if repaired:
                        yield account.row(repaired, False)
            if account is not None:
                yield account.row(account.close(), True)

        yield from batches_of(rows(), RESULT_ARROW, result_weight)

    streamed = open_blocks.repartition("conv_id").sortWithinPartitions("conv_id", "g").select("conv_id", "codes", "given", "turns", "roles", "texts")
    return done.unionByName(streamed.mapInArrow(run, RESULT))


def repair(turns: DataFrame, alive: Column | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and the digest of the repaired turns.

    Rows of `turns` that are not `alive` are no turns, but their conversation is told of.
    """
    return results(turns, alive, False, block_rows, block_bytes).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame, alive: Column | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, place, edit, role, text) of the turns of the repaired conversations; edit is K, R or I."""
    rows = results(turns, alive, True, block_rows, block_bytes).select("conv_id", F.col("place").alias("start"), F.posexplode("repaired").alias("i", "t"))
    return rows.select("conv_id", (F.col("start") + F.col("i")).alias("place"), "t.edit", "t.role", "t.text")


def damaged(rows: DataFrame) -> DataFrame:
    """Turns damaged by a checksum of their conversation and turn (nulls: one space); lost ones are not alive."""
    conv_id, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    copies = F.when(kind == 0, F.array(F.lit(False))).when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return rows.select(
        F.col("conv_id"), F.when(kind != 0, F.col("turn")).alias("turn"), F.when(kind == 4, F.lit("user")).when(kind != 0, role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).when(kind != 0, text).alias("text"), F.explode(copies).alias("alive"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations), F.col("alive"))
