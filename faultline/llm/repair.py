"""Conversation structure repair (operator 12): the cheapest edits that make a dialogue ``(system? (user assistant)+)?``.

A dialogue is a row of codes, and its repair a shortest path through (place, state) by a dynamic program whose backward vectors of
costs are kept at checkpoints only: at the ends of segments, which are rows of a table, and at every ``STEP``-th code
inside one.  Walking forward, the block between two checkpoints is computed again, and of the tight edits (those on a
cheapest path) the one with the least initial is taken, so that the edits are the ASCII-least of all cheapest ones.

Rows are ordered by ranges, so that a dialogue of any size is many segments of bounded length in many tasks: each gives its least costs
from state to state; these are combined by dialogue (a row for each segment) and tell each segment the vector at its end; each is walked
from every state, and the walks are chained by dialogue in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hinted, stored

WHITE = r"[\x20\x09-\x0D]"
#: Least costs: rerole, delete, insert, and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns of a segment at most (a power of two), and codes between two checkpoints inside it: its square root.
SEGMENT_BITS, STEP = 12, 64
FAR = 1 << 40
# States: nothing yet, after system, after user, after assistant; a dialogue may end in the first and the last.
ENDS = (0, 3)
AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = 1, 2, 3
#: State after a user or an assistant, by state before; and the role that it is.
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Initials of adjacent turns that are as they should be.
LEGAL = ("su", "ua", "au")


@cache
def edits_of(code: str, state: int) -> tuple[tuple[str, int, int, str], ...]:
    """(initial, cost, state after, role that stays) of the edits of one turn in a state, by initial.

    A code is the role's initial (s, u, a, or - for any other): in lower case for a sound turn, in upper case (or _) for a
    truncated one, and x for one that must go.
    """
    found = [("D", DELETE, state, "")]
    if code != "x":
        more = TRUNCATED if code.isupper() or code == "_" else 0
        own, due = code.lower(), "a" if state == AFTER_USER else "u"
        if own == due or own == "s" and state == 0:
            found.append(("K", more, AFTER_SYSTEM if own == "s" else NEXT[state], own))
        found.append(("R", REROLE + more, NEXT[state], due))
    return tuple(found)


def with_inserts(after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs by state before a place, from those of going on there without an insertion."""
    cost = list(after)
    for _ in range(2):  # two insertions lead from any state to any other that insertions reach
        cost = [min(c, INSERT + cost[NEXT[s]]) for s, c in enumerate(cost)]
    return tuple(cost)


@cache
def _before(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    return with_inserts(tuple(min(cost + after[to] for _, cost, to, _ in edits_of(code, s)) for s in range(4)))


def before(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs by state before a turn, from those after it (``with_inserts`` holds for both)."""
    least = min(after)
    return tuple(least + c for c in _before(code, tuple(min(c - least, FAR) for c in after)))


def costs_from(codes: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs by state at the beginning of ``codes``, from those at their end."""
    for code in reversed(codes):
        after = before(code, after)
    return after


def walk(codes: str, after: tuple[int, ...], state: int, last: bool) -> tuple[int, str, str]:
    """(state at the end, edits, roles) of the ASCII-least cheapest edits from ``state``, by turn with spaces between.

    An insertion stands with the turn after it, at the end of a dialogue with its last one; roles has - where an edit leaves no turn.
    ``after`` has the least costs at the end; insertions there belong to the ``last`` segment alone, others leave them to the next.
    """
    kept = {len(codes): after}
    for i in range(len(codes) - 1, -1, -1):  # backward: vectors at checkpoints only
        after = before(codes[i], after)
        if i % STEP == 0:
            kept[i] = after
    audit, roles = [], []
    for start in range(0, len(codes), STEP):
        stop = min(start + STEP, len(codes))
        block = [kept[stop]]
        for code in reversed(codes[start:stop]):  # the block again
            block.append(before(code, block[-1]))
        for i in range(start, stop):
            here, then = block[stop - i], block[stop - i - 1]
            edit = own = own_roles = ""
            while edit in ("", "I"):  # at most two insertions
                steps = [(e, to, role) for e, cost, to, role in edits_of(codes[i], state) if cost + then[to] == here[state]]
                if INSERT + here[NEXT[state]] == here[state]:
                    steps.append(("I", NEXT[state], "a" if state == AFTER_USER else "u"))
                edit, state, role = min(steps)
                own, own_roles = own + edit, own_roles + (role or "-")
            audit.append(own)
            roles.append(own_roles)
    while last and state not in ENDS:
        audit[-1] += "I"
        roles[-1] += "a" if state == AFTER_USER else "u"
        state = NEXT[state]
    return state, " ".join(audit), " ".join(roles)


#: Least costs at the end of a dialogue.
AT_END = with_inserts(tuple(0 if s in ENDS else FAR for s in range(4)))


def _arrow(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text, at; conv_id, turn, initial, at, fault) of every turn; at rises in the order of dialogue, turn (nulls first), role and text.

    at is stored once.  Rows of a dialogue are contiguous in it but for the ends of ranges.  fault: blank (no character but
    white space), else duplicate (role and text stood earlier in the dialogue), else truncated (the last character that isn't white space is no end mark), else null.
    """
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    parts = ["conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64)]
    placed = base.repartitionByRange(*parts).sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed, "turns")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{WHITE}*\z")
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    facts = placed.select("conv_id", "turn", F.rpad(F.substring("role", 1, 1), 1, "-").alias("initial"), "at", F.when(~blank, same).alias("same"), F.when(blank, "blank").when(cut, "truncated").alias("own"))
    facts = stored(facts, "facts")
    first = facts.filter("same is not null").groupBy("conv_id", "same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = hinted(stored(first.select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "first"), "repeats"))
    seen = facts.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    fault = F.when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("own"))
    return placed, seen.select("conv_id", "turn", "initial", "at", fault.alias("fault"))


def _code(initial: Column, fault: Column) -> Column:
    own = F.when(initial.isin(*ROLES), initial).otherwise("-")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.translate(own, "sua-", "SUA_")).otherwise(own)


def segments(ordered: DataFrame) -> DataFrame:
    """conv_id, seg, first (the least at), codes, initials of each segment of turns in order with their faults."""
    rows = ordered.select("conv_id", F.shiftright("at", SEGMENT_BITS).alias("seg"), "at", _code(F.col("initial"), F.col("fault")).alias("code"), "initial")
    own = F.array_sort(F.collect_list(F.struct("at", "code", "initial")))  # 4,096 turns at most
    got = rows.groupBy("conv_id", "seg").agg(F.min("at").alias("first"), own.alias("own"))
    join = lambda f: F.array_join(F.transform("own", lambda x: x[f]), "")
    return got.select("conv_id", "seg", "first", join("code").alias("codes"), join("initial").alias("initials"))


def _by_dialogue(segs: DataFrame, *columns: str) -> DataFrame:
    """conv_id and an array of its segments (seg and the columns) in order: a row of a dialogue holds one entry for each 4,096 of its turns."""
    return segs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", *columns))).alias("segs"))


def _costs(segs: DataFrame) -> DataFrame:
    """conv_id, seg, costs (least costs from each state to each, 16 numbers), illegal (pairs inside) and ends (first and last initial) of each segment."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                # The cost from s to t is what s costs if only t may be reached at the end; insertions there are the next segment's.
                to = [costs_from(r["codes"], tuple(0 if t == s else FAR for s in range(4))) for t in range(4)]
                own = r["initials"]
                out.append(r | {"costs": [min(to[t][s], FAR) for s in range(4) for t in range(4)], "illegal": sum(x + y not in LEGAL for x, y in zip(own, own[1:], strict=False)), "ends": own[0] + own[-1]})
            yield _arrow(out, ["conv_id", "seg", "costs", "illegal", "ends"], [batch.schema.field("conv_id").type, pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string()])

    return segs.select("conv_id", "seg", "codes", "initials").mapInArrow(run, f"conv_id {segs.schema['conv_id'].dataType.simpleString()}, seg long, costs array<long>, illegal long, ends string")


def _ends(costs: DataFrame) -> DataFrame:
    """conv_id, seg, after (least costs by state at the segment's end), last; cost and illegal of the dialogue with its first segment."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                after, illegal, follows = AT_END, 0, None
                for seg in reversed(r["segs"]):
                    out.append({"conv_id": r["conv_id"], "seg": seg["seg"], "after": list(after), "last": follows is None, "cost": None, "illegal": None})
                    c = seg["costs"]
                    after = tuple(min(c[4 * s + t] + after[t] for t in range(4)) for s in range(4))
                    illegal += seg["illegal"] + (follows is not None and seg["ends"][1] + follows not in LEGAL)
                    follows = seg["ends"][0]
                out[-1] |= {"cost": after[0], "illegal": illegal}
            yield _arrow(out, ["conv_id", "seg", "after", "last", "cost", "illegal"], [batch.schema.field("conv_id").type, pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64()])

    return _by_dialogue(costs, "costs", "illegal", "ends").mapInArrow(run, f"conv_id {costs.schema['conv_id'].dataType.simpleString()}, seg long, after array<long>, last boolean, cost long, illegal long")


def _walks(segs: DataFrame, ends: DataFrame) -> DataFrame:
    """conv_id, seg, first, cost, illegal and, by state at the segment's beginning: ends, audits, roles."""
    named = ends.withColumnsRenamed({"conv_id": "_conv", "seg": "_seg"})
    both = segs.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seg") == F.col("_seg"))).select("conv_id", "seg", "first", "codes", "after", "last", "cost", "illegal")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                after = tuple(r["after"])
                # A dialogue's first segment, often its only one, is entered in the state of nothing alone.
                found = [walk(r["codes"], after, s, r["last"]) for s in (range(4) if r["cost"] is None else range(1))]
                out.append(r | {"ends": [x[0] for x in found], "audits": [x[1] for x in found], "roles": [x[2] for x in found]})
            texts = pa.list_(pa.string())
            yield _arrow(out, ["conv_id", "seg", "first", "cost", "illegal", "ends", "audits", "roles"], [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), texts, texts])

    return both.mapInArrow(run, f"conv_id {segs.schema['conv_id'].dataType.simpleString()}, seg long, first long, cost long, illegal long, ends array<int>, audits array<string>, roles array<string>")


def _chained(walks: DataFrame) -> DataFrame:
    """conv_id, seg, state: the state in which each segment is entered; a dialogue's first in the state of nothing."""
    step = lambda a, x: F.struct(F.get(x["ends"], a["s"]).alias("s"), F.concat(a["all"], F.array(F.struct(x["seg"].alias("seg"), a["s"].alias("state")))).alias("all"))
    none = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<seg:bigint,state:int>>").alias("all"))
    return _by_dialogue(walks, "ends").select("conv_id", F.inline(F.aggregate("segs", none, step)["all"]))


def edits(segs: DataFrame) -> DataFrame:
    """conv_id, seg, first, cost and illegal (a dialogue's, with its first segment), audit and roles (by turn, with spaces between) of each of :func:`segments`."""
    walks = stored(_walks(segs, stored(_ends(_costs(segs)), "ends")), "walks")
    state = _chained(walks).select(F.col("conv_id").alias("_conv"), F.col("seg").alias("_seg"), "state")
    got = walks.join(state, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seg") == F.col("_seg")))
    return got.select("conv_id", "seg", "first", "cost", "illegal", F.get("audits", F.col("state")).alias("audit"), F.get("roles", F.col("state")).alias("roles"))


def repaired_turns(placed: DataFrame, made: DataFrame) -> DataFrame:
    """conv_id, at, k, edit, role, text of the repaired dialogues' turns, in order of at and k; without deleted ones.

    k counts the edits at the place of a turn: insertions before it, and it; insertions after the last turn come with it.  Inserted turns have an empty text.
    """
    each = F.arrays_zip(F.split("audit", " ").alias("own"), F.split("roles", " ").alias("own_roles"))
    at_turn = made.select("first", F.posexplode(each).alias("nth", "x")).select((F.col("first") + F.col("nth")).alias("_at"), "x.own", "x.own_roles")
    joined = placed.select("conv_id", "at", "role", "text").join(at_turn, F.col("at") == F.col("_at"))
    one = lambda i: F.struct(F.substring("own", i + 1, F.lit(1)).alias("edit"), F.substring("own_roles", i + 1, F.lit(1)).alias("initial"))
    out = joined.select("conv_id", "at", "role", "text", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("own") - 1), one)).alias("k", "e")).filter("e.edit <> 'D'")
    named = F.coalesce(*(F.when(F.col("e.initial") == i, F.lit(r)) for i, r in ROLES.items()))
    role = F.when(F.col("e.edit") == "K", F.col("role")).otherwise(named)
    return out.select("conv_id", "at", "k", F.col("e.edit").alias("edit"), role.alias("role"), F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of :func:`repaired_turns`: of role:text, joined by line feeds.

    A digest is one sequence by its nature: a dialogue's turns come to one task in order and pass through it, but none is gathered.
    """
    lines = turns.select("conv_id", "at", "k", F.concat_ws(":", "role", "text").cast("binary").alias("line"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        now, state, out = None, None, []
        for batch in batches:
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = conv, sha256(line)
                else:
                    state.update(b"\n")
                    state.update(line)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], batch.schema.field(0).type), pa.array([x for _, x in out])], ["conv_id", "repaired_sha256"])
                out = []
        if state is not None:
            out.append((now, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], batch.schema.field(0).type), pa.array([x for _, x in out])], ["conv_id", "repaired_sha256"])

    by = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k")
    return by.select("conv_id", "line").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts of the turns in order with their faults, edits by segment, repaired turns) of dialogues; null roles and texts count as one space.

    Blank and duplicate turns go, the rest is kept, given another role or dropped, and empty turns come in, at the least cost.  Turns with
    one number stand in the order of role and text; a null dialogue is one of its own; other columns aren't read; an empty
    table gives no rows.  See the constants for the costs.
    """
    clean = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    placed, ordered = ordered_turns(clean)
    ordered = stored(ordered, "ordered")
    made = stored(edits(stored(segments(ordered), "segments")), "edits")
    return ordered, made, repaired_turns(placed, made)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that each turn's checksum names: 0 drops it, 1 empties it, 2 takes its end marks, 3 repeats it, 4 makes it a user's."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    base = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = base.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return out.drop("copy")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """The counts, edits and digest of every dialogue of ``turns`` (conv_id, turn, role, text) after :func:`damaged` and :func:`repair`.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  A dialogue of which the damage leaves
    nothing has zeros, no edits and the digest of nothing.  Repeated rows are repeated turns.
    """
    ordered, made, fixed = repair(damaged(turns))
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    spread = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    facts = ordered.groupBy("conv_id").agg(spread.alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: F.replace(x["audit"], F.lit(" "), F.lit(""))), "")
    done = made.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), audit.alias("audit"))
    # Each part has a row for a dialogue at most; one aggregation puts them together, null dialogues, too.
    parts = [turns.select("conv_id").distinct(), facts, done, digests(fixed)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    number = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    counted = [number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.groupBy("conv_id").agg(*counted, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
