"""Repair of conversations by cheapest edits: a backward cost-to-go table over rows and grammar states, then a forward walk.

A repaired conversation is empty, or one system turn at most and then pairs of a user's and an assistant's turn.  A row
is kept (cost 0), given the role that is due (1) or deleted (2; blank rows and duplicates must be); an empty turn of the role
that is due is inserted anywhere (5); a truncated row that stays costs 5 more.  Of the cheapest edits the walk takes those whose
initials (D, I, K, R) come first in ASCII: in each state every letter leads to one place, so the least tight letter is right.

Rows are range-sorted by conversation and turn and dealt into blocks.  A conversation inside one block is repaired there.  One
that reaches over several is repaired in all of them at once: each block gives the least costs from state to state (a
4 x 4 table over minimum and sum), from which the costs to go at every block's end follow; with these each block says
where the walk leaves it for each state it may enter in, and then makes its own part.  So no task ever holds more rows than a
block, however long the conversation; its hash is fed with the blocks' parts in order, and only its audit, a letter for each edit, is
held whole.  Repeated rows are one row with a count up to the end, and first rows of a role and text are found over salts.

Defined cases: a null role or text is one blank; a role's initial is its first character (an empty role has none that is legal);
rows of one turn go by role and text, null turns first; repeated rows are duplicates of the first; a null conversation is a
conversation; a conversation of which no row is left gives zeros, an empty audit and the empty text's hash; an empty table
gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import discard, least_per_key, materialise, salt_of, small_batches

INF = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
OPEN = (START, SYSTEM, ASSISTANT)  # states in which a user's turn is due
NAMED = {USER: "user", ASSISTANT: "assistant"}
AFTER = (USER, USER, ASSISTANT, USER)
LEGAL = {"su", "ua", "au"}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"

END = [0, 2 * INSERT, INSERT, 0]  # costs to go after the last row


def _kept(state: int, initial: str) -> int:
    """The state after a row of this initial is kept, or -1."""
    if initial == "s":
        return SYSTEM if state == START else -1
    if initial == "u":
        return USER if state in OPEN else -1
    return ASSISTANT if initial == "a" and state == USER else -1


def costs(items: list[tuple[str, int, int]], end: list[int]) -> list[list[int]]:
    """Costs to go from each state before each item, the last entry after all of them; items are (initial, fault, copies).

    Of a row's copies the first is free to stay unless it is blank or a duplicate; the others must be deleted.
    """
    out = [end]
    for initial, fault, copies in reversed(items):
        g = out[-1]
        if copies:
            forced = copies if fault in (BLANK, DUPLICATE) else copies - 1
            g = [x + DELETE * forced for x in g]
            if forced < copies:
                more = CUT_OFF if fault == TRUNCATED else 0
                f = [min(DELETE + g[s], REROLE + more + g[AFTER[s]], *([more + g[k]] if (k := _kept(s, initial)) >= 0 else [])) for s in range(4)]
                f[USER], f[ASSISTANT] = min(f[USER], INSERT + f[ASSISTANT]), min(f[ASSISTANT], INSERT + f[USER])
                g = [min(f[START], INSERT + f[USER]), min(f[SYSTEM], INSERT + f[USER]), f[USER], f[ASSISTANT]]
        out.append(g)
    return out[::-1]


def walk(items: list[tuple[str, int, int]], table: list[list[int]], state: int, last: bool) -> tuple[list[tuple[int, str, int]], int]:
    """The edits of the cheapest way from ``state``, least letters first, as (item, letter, state after), and the last state.

    A deletion of copies is one entry for all of them.  After the last item only a conversation's last part inserts turns.
    """
    edits = []
    for i, (initial, fault, copies) in enumerate(items):
        if not copies:
            continue
        after = table[i + 1]
        forced = copies if fault in (BLANK, DUPLICATE) else copies - 1
        g = [x + DELETE * forced for x in after] if forced < copies else None
        while g:  # the copy that may stay
            here, more = table[i][state], CUT_OFF if fault == TRUNCATED else 0
            if here == DELETE + g[state]:
                edits.append((i, "D", state))
                break
            if here == INSERT + table[i][AFTER[state]]:
                state = AFTER[state]
                edits.append((i, "I", state))
                continue
            kept = _kept(state, initial)
            letter, state = ("K", kept) if kept >= 0 and here == more + g[kept] else ("R", AFTER[state])
            edits.append((i, letter, state))
            break
        if forced:
            edits.append((i, "D" * forced, state))
    while last and table[-1][state]:
        state = AFTER[state]
        edits.append((len(items) - 1, "I", state))
    return edits, state


def _segments(keys: list) -> list[tuple[int, int]]:
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
    return list(zip(cuts, cuts[1:], strict=False))


def _items(table: pa.Table) -> list[tuple[str, int, int]]:
    return list(zip(*(table.column(c).to_pylist() for c in ("initial", "fault", "copies")), strict=True))


def ordered_rows(rows: DataFrame, conversation: str, turn: str, role: str, text: str, copies: str | None, per_block: int) -> DataFrame:
    """A table of distinct rows (conv, turn, role, text, copies, initial, fault, place, block), in order of place.

    The numbers of a block's places are consecutive; blocks have about ``per_block`` rows each.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    count = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    named = rows.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), count.alias("copies"))
    one = materialise(named.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    said = F.unhex(F.sha2(F.to_json(F.struct("conv", "role", "text"), {"ignoreNullFields": "false"}), 256))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    keyed = one.withColumns({"said": said, "at": at}).withColumn("salt", salt_of("turn"))
    firsts = least_per_key(keyed.where("copies > 0").select("said", "at", "salt"), "said", "at", "first", count="times").drop("times")
    keyed = keyed.join(firsts, ["said", "salt"], "left")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.col("first") < F.col("at"), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    keyed = keyed.select("conv", "turn", "role", "text", "copies", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")]
    blocks = max(1, one.count() // per_block)
    dealt = keyed.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    out = materialise(dealt.withColumn("block", F.shiftright("place", 33)), "ordered")
    discard(one)
    return out


def _outer(keys: list) -> list[tuple[int, int]]:
    """The segments that may go on in other blocks: the first and the last."""
    found = _segments(keys)
    return found if len(found) < 2 else [found[0], found[-1]]


def block_costs(table: pa.Table) -> pa.Table:
    """Least costs from state to state of a block's first and last conversation: (conv, block, costs)."""
    table = table.sort_by("place")
    keys = table.column("conv").to_pylist()
    found, made = _outer(keys), []
    for a, b in found:
        ends = [[INSERT * _inserts(s, y) for s in range(4)] for y in range(4)]  # to each state y, of every state s
        columns = [costs(_items(table.slice(a, b - a)), end)[0] for end in ends]
        made.append([columns[y][s] for s in range(4) for y in range(4)])
    return pa.table({"conv": table.column("conv").take([a for a, _ in found]), "block": table.column("block").take([a for a, _ in found]), "costs": pa.array(made, pa.list_(pa.int64()))})


def _inserts(state: int, to: int) -> int:
    """How many inserted turns lead from one state to another."""
    if state == to:
        return 0
    if AFTER[state] == to:
        return 1
    return 2 if AFTER[AFTER[state]] == to else INF


def costs_to_go(table: pa.Table) -> pa.Table:
    """(conv, block, go, last) of a conversation in several blocks: the costs to go at each block's end."""
    table = table.sort_by("block")
    made, go = [], END
    for m in reversed(table.column("costs").to_pylist()):
        made.append(go)
        go = [min(INF, *(m[4 * s + y] + go[y] for y in range(4))) for s in range(4)]
    n = len(table) if len(table) > 1 else 0  # in a single block there is nothing to be told
    return pa.table({"conv": table.column("conv"), "block": table.column("block"), "go": pa.array(made[::-1], pa.list_(pa.int64())), "last": [i == n - 1 for i in range(len(table))]}).slice(0, n)


def block_ways(table: pa.Table, told: pa.Table) -> pa.Table:
    """(conv, block, way): the state in which the walk leaves the block for each state in which it enters it."""
    table = table.sort_by("place")
    keys, made = table.column("conv").to_pylist(), []
    for conv, go, last in zip(*(told.column(c).to_pylist() for c in ("conv", "go", "last")), strict=True):
        a, b = next(x for x in _outer(keys) if keys[x[0]] == conv)
        items = _items(table.slice(a, b - a))
        found = costs(items, go)
        made.append([walk(items, found, s, last)[1] if found[0][s] < INF else -1 for s in range(4)])
    return pa.table({"conv": told.column("conv"), "block": told.column("block"), "go": told.column("go"), "last": told.column("last"), "way": pa.array(made, pa.list_(pa.int64()))})


def entries(table: pa.Table) -> pa.Table:
    """(conv, block, go, last, state): the state in which the walk enters each block."""
    table = table.sort_by("block")
    state, made = START, []
    for way in table.column("way").to_pylist():
        made.append(state)
        state = way[state]
    return table.drop_columns("way").append_column("state", pa.array(made, pa.int64()))


def _repaired(table: pa.Table, told: pa.Table) -> Iterator[tuple]:
    """For each conversation of a block: bounds of its rows, what is told of it, its edits and its costs from the start."""
    keys = table.column("conv").to_pylist()
    known = {conv: x for conv, *x in zip(*(told.column(c).to_pylist() for c in ("conv", "go", "last", "state")), strict=True)}
    for a, b in _segments(keys):
        go, last, state = known.get(keys[a], (END, True, START))
        items = _items(table.slice(a, b - a))
        found = costs(items, go)
        yield a, b, items, keys[a] in known, walk(items, found, state, last)[0], found[0][state]


def repaired_rows(table: pa.Table, told: pa.Table) -> pa.Table:
    """(conv, place, step, edit, turn, role, text) of the rows that a block's conversations are left with, in order of place and step."""
    table = table.sort_by("place")
    at, step, letters, roles, fresh = [], [], [], [], []
    for a, _, _, _, edits, _ in _repaired(table, told):
        before = -1
        for i, letter, state in edits:
            k = step[-1] + 1 if i == before and step else 0
            if letter in ("K", "R", "I"):
                before = i
                at.append(a + i)
                step.append(k)
                letters.append(letter)
                fresh.append(letter == "I")
                roles.append(None if letter == "K" else NAMED[state])
    some = table.take(pa.array(at, pa.int64()))
    mask = pa.array(fresh, pa.bool_())
    text = pc.if_else(mask, pa.scalar("", some.schema.field("text").type), some.column("text"))
    turn = pc.if_else(mask, pa.scalar(None, some.schema.field("turn").type), some.column("turn"))
    role = pc.coalesce(pa.array(roles, some.schema.field("role").type), some.column("role"))
    return pa.table({"conv": some.column("conv"), "place": some.column("place"), "step": pa.array(step, pa.int32()), "edit": pa.array(letters, pa.string()), "turn": turn, "role": role, "text": text})


def part_figures(table: pa.Table, told: pa.Table) -> pa.Table:
    """Figures of each conversation's rows in a block, its audit and what it is left with."""
    table = table.sort_by("place")
    turn, role, text, block = (table.column(c) for c in ("turn", "role", "text", "block"))
    out = []
    for a, b, items, several, edits, cost in _repaired(table, told):
        here = [i for i, x in enumerate(items) if x[2]]
        turns = [t for i, t in enumerate(turn.slice(a, b - a).to_pylist()) if items[i][2] and t is not None]
        distinct = sorted(set(turns))
        count = {f: sum(x[2] if f == BLANK else 1 for x in items if x[1] == f and x[2]) for f in (BLANK, DUPLICATE, TRUNCATED)}
        again = sum(x[2] - 1 for x in items if x[2] and x[1] != BLANK)
        illegal = sum(x[2] - 1 for x in items if x[2]) + sum(items[i][0] + items[j][0] not in LEGAL for i, j in zip(here, here[1:], strict=False))
        said = []
        for i, letter, state in edits:
            if letter in ("K", "R", "I"):
                name = role[a + i].as_py() if letter == "K" else NAMED[state]
                said.append(f"{name}:{'' if letter == 'I' else text[a + i].as_py()}")
        ends = (distinct[0], distinct[-1]) if distinct else (None, None)
        sha = None if several else hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append({
            "conv": None, "block": block[a].as_py(), "several": several, "least": ends[0], "most": ends[1], "turns": len(distinct), "blank": count[BLANK], "duplicate": count[DUPLICATE] + again, "truncated": count[TRUNCATED], "illegal": illegal, "cost": cost,
            "head": items[here[0]][0] if here else None, "tail": items[here[-1]][0] if here else None, "audit": "".join(e[1] for e in edits), "said": "\n".join(said) if several else None, "n_said": len(said), "sha": sha, "at": a,
        })
    made = pa.Table.from_pylist(out, PART)
    return made.drop_columns("at").set_column(0, table.schema.field("conv"), table.column("conv").take(made.column("at")))


PART = pa.schema([
    ("conv", pa.null()), ("block", pa.int64()), ("several", pa.bool_()), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("audit", pa.string()), ("said", pa.string()), ("n_said", pa.int64()), ("sha", pa.string()), ("at", pa.int64()),
])
PART_SQL = "block long, several boolean, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, head string, tail string, audit string, said string, n_said long, sha string"
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of several parts, whose parts come in order, as one row each; a part's text is let go once it is hashed."""
    now = None

    def done(x: dict) -> pa.RecordBatch:
        values = [[x["gaps"]], [x["blank"]], [x["duplicate"]], [x["truncated"]], [x["illegal"]], [x["cost"]], ["".join(x["audit"])], [x["sha"].hexdigest()]]
        types = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([x["conv"], *(pa.array(v, t) for v, t in zip(values, types, strict=True))], ["conv", *RESULT])

    for batch in batches:
        for i, r in enumerate(batch.drop_columns(["conv"]).to_pylist()):
            conv = batch.column("conv").slice(i, 1)
            if now is None or now["conv"] != conv:
                if now:
                    yield done(now)
                now = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0) | {"conv": conv, "cost": r["cost"], "audit": [], "sha": hashlib.sha256(), "most": None, "tail": None, "any": False}
            for f in ("blank", "duplicate", "truncated", "illegal"):
                now[f] += r[f]
            now["audit"].append(r["audit"])
            if r["head"] is not None:
                now["illegal"] += now["tail"] is not None and now["tail"] + r["head"] not in LEGAL
                now["tail"] = r["tail"]
            if r["turns"]:
                # places between the turns, and from the turn before them
                now["gaps"] += r["most"] - r["least"] + 1 - r["turns"] + (0 if now["most"] is None else max(0, r["least"] - now["most"] - 1))
                now["most"] = r["most"]
            if r["n_said"]:
                now["sha"].update((("\n" if now["any"] else "") + r["said"]).encode())
                now["any"] = True
    if now:
        yield done(now)


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, copies: str | None = None, per_block: int = 4096, digest: bool = False) -> DataFrame:
    """Rows of the repaired conversations: (conversation, place, step, edit, turn, role, text), in order of place and step.

    ``copies`` names a column that says how often a row counts; a conversation of which no row counts is left without rows.
    With ``digest`` a row per conversation instead: faults, cost, audit and the hash of what is left (``role:text`` lines).
    """
    small_batches(rows.sparkSession)
    kind = rows.schema[conversation].dataType.simpleString()
    at = ordered_rows(rows, conversation, turn, role, text, copies, per_block)
    told = f"conv {kind}, block long, go array<long>, last boolean"
    slim = at.select("conv", "block", "place", "initial", "fault", "copies")
    parts = slim.groupBy("block").applyInArrow(block_costs, f"conv {kind}, block long, costs array<long>")
    go = materialise(parts.groupBy("conv").applyInArrow(costs_to_go, told), "told")
    held = slim.join(go.select("block").distinct(), "block", "left_semi")
    ways = held.groupBy("block").cogroup(go.groupBy("block")).applyInArrow(block_ways, f"{told}, way array<long>")
    enter = ways.groupBy("conv").applyInArrow(entries, f"{told}, state long").groupBy("block")
    if not digest:
        made = at.groupBy("block").cogroup(enter).applyInArrow(repaired_rows, f"conv {kind}, place long, step int, edit string, turn long, role string, text string")
        return made.withColumnRenamed("conv", conversation)
    figures = materialise(at.groupBy("block").cogroup(enter).applyInArrow(part_figures, f"conv {kind}, {PART_SQL}"), "figures")
    discard(at, go)
    gaps = F.when(F.col("turns") > 0, F.col("most") - F.col("least") + 1 - F.col("turns")).otherwise(0).cast("long")
    whole = figures.where("not several").select("conv", gaps.alias("gaps"), *RESULT[1:-1], F.col("sha").alias("repaired_sha256"))
    many = figures.where("several").repartition("conv").sortWithinPartitions("conv", "block")
    return whole.unionByName(many.mapInArrow(_joined, whole.schema)).withColumnRenamed("conv", conversation)


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults and ``copies``, by the checksum of conversation and turn; nulls are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which: Column = F.crc32(F.concat(blank(conversation), F.lit(":"), blank(turn)).cast("binary")) % 20
    said = F.when(which == 1, "").when(which == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    return rows.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.when(which == 4, "user").otherwise(blank(role)).alias("role"), said.alias("text"),
        F.when(which == 0, 0).when(which == 3, 2).otherwise(1).alias("copies"),
    )
