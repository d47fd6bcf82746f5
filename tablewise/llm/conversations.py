"""Conversations repaired to the role grammar by generalised LR parsing with weighted edits.

The grammar of roles, by initials, is

    conversation -> (nothing) | turns | s turns
    turns        -> u a | turns u a

and :data:`SHIFT`, :data:`REDUCE` and :data:`GOTO` are its LR table. A parser keeps every stack that
some choice of edits reaches: stacks share their lower parts (each is a top state and the stack below
it), and equal stacks merge by the least (cost, audit). That is exact: the letters of an audit and
the rows fix its cost, so of two audits with equal cost for the same rows none begins the other, and
whichever is less stays less whatever follows.

Rows are dealt in ranges of (conversation, turn), so a long conversation spreads over tasks. Blocks of
at most ``BLOCK`` rows are parsed on their own: a block that may not begin its conversation from each of
the grammar's stacks. Joining blocks is a minimum over the stacks between them. Texts are not needed for
that; they move once, for the repaired rows, which stream past the finished audit in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import columns_of, stored

# ---------------------------------------------------------------- grammar

#: LR states: 0 start, 1 after s, 2 after the first u, 3 and 4 turns (4 below s), 5 u a, 6 turns u, 7 turns u a.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
#: Length of the rule that a state has seen whole, and the state of its turns by the state below.
REDUCE, GOTO = {5: 2, 7: 3}, {0: 3, 1: 4}
ACCEPT = {0, 3, 4}
#: A stack is (top state, stack below); this one is empty but for the start state.
START = (0, None)
ROLES = {"u": "user", "a": "assistant"}

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
#: Rows that a block parses at most, and blocks of equal codes remembered by a task.
BLOCK, REMEMBERED = 4096, 4096


@lru_cache(maxsize=None)  # the grammar has eight stacks
def shifted(stack: tuple, initial: str) -> tuple | None:
    """The stack after a row of this initial, rules reduced; None where the grammar has no such row."""
    state = SHIFT.get((stack[0], initial))
    if state is None:
        return None
    stack = (state, stack)
    if state in REDUCE:
        for _ in range(REDUCE[state]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


def _all_stacks() -> list[tuple]:
    found = [START]
    for stack in found:
        found += [s for s in (shifted(stack, i) for i in "sua") if s is not None and s not in found]
    return found


#: Every stack of the grammar, in a fixed order; blocks name stacks by their place here.
STACKS = _all_stacks()
PLACE = {stack: i for i, stack in enumerate(STACKS)}

Tops = dict[tuple, tuple[int, str]]


def _put(tops: Tops, stack: tuple | None, cost: int, audit: str) -> bool:
    """Merge a way to ``stack`` into ``tops``; whether it is the best so far."""
    if stack is None or (stack in tops and tops[stack] <= (cost, audit)):
        return False
    tops[stack] = (cost, audit)
    return True


def _inserted(tops: Tops) -> Tops:
    """``tops`` with all that insertions add."""
    open_ = list(tops)
    while open_:
        more = []
        for stack in open_:
            cost, audit = tops[stack]
            for initial in ROLES:
                to = shifted(stack, initial)
                if _put(tops, to, cost + INSERT, audit + "I"):
                    more.append(to)
        open_ = more
    return tops


def parsed(tops: Tops, codes: tuple[str, ...]) -> Tops:
    """All stacks after rows of these codes: the initial of the role, then b, d, t or nothing for the fault."""
    for code in codes:
        initial, fault = code[:-1], code[-1]
        after: Tops = {}
        for stack, (cost, audit) in _inserted(tops).items():
            _put(after, stack, cost + DELETE, audit + "D")
            if fault in "bd":
                continue
            extra = UNFINISHED if fault == "t" else 0
            _put(after, shifted(stack, initial), cost + KEEP + extra, audit + "K")
            for role in ROLES:
                _put(after, shifted(stack, role), cost + REROLE + extra, audit + "R")
        tops = after
    return tops


def accepted(tops: Tops) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(way for stack, way in _inserted(tops).items() if stack[0] in ACCEPT)


@lru_cache(maxsize=REMEMBERED)
def ways(codes: tuple[str, ...], whole: bool) -> list[tuple[int, int, int, str]]:
    """(stack before, stack after, cost, audit) of a block; ``whole`` ones begin at the start."""
    return [
        (PLACE[first], PLACE[last], cost, audit)
        for first in ([START] if whole else STACKS)
        for last, (cost, audit) in parsed({first: (0, "")}, codes).items()
    ]


def replayed(audit: str, initials: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """(edit, new role or None) for each letter of an audit; a kept row's initial is taken from ``initials``."""
    stack = START
    for edit in audit:
        if edit == "D":
            next(initials)
            yield edit, None
            continue
        given = next(initials) if edit != "I" else ""
        wanted = given if edit == "K" else next(i for i in ROLES if shifted(stack, i) is not None)
        stack = shifted(stack, wanted)
        yield edit, None if edit == "K" else ROLES[wanted]


# ---------------------------------------------------------------- rows


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one space for null roles and texts."""
    rows = columns_of(conversations, conv_id="long", turn="long", role="string", text="string")
    return rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, unfinished, repeated or given to the user.

    A null in any column is one space.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = _rows(conversations).withColumn("fate", F.crc32(name) % 20).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return out.drop("copy")


#: Rows of a turn are taken by role, then by a digest of the text; rows alike in all of these are equal.
ORDER = ["conv_id", "turn", "role", "digest"]


def _ordered_by(rows: DataFrame) -> DataFrame:
    rows = columns_of(rows, conv_id="long", turn="long", role="string", text="string")
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def coded(rows: DataFrame) -> DataFrame:
    """Rows without their texts: ``code`` is the role's initial and the first fault (b, d, t or -).

    Equal rows of a turn are one row with their number ``n``, so no repeated row fills a task. A duplicate has
    the role and text of a row that comes earlier in its conversation.
    """
    shown = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = F.when(shown == "", "b").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    light = _ordered_by(rows).select(*ORDER, fault.alias("fault"))
    light = light.groupBy(*ORDER, "fault").agg(F.count(F.lit(1)).alias("n"))
    # Only texts that come in several turns go on to the join; null turns are the least.
    again = light.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
    again = again.where("turns > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"),
        F.lit(True).alias("again"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    light = light.join(again, same, "left")
    late = F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    code = F.when((F.col("fault") != "b") & late, "d").otherwise(F.col("fault"))
    return light.select(*ORDER, F.concat(F.substring("role", 1, 1), code).alias("code"), "n")


# ---------------------------------------------------------------- blocks

BLOCK_SCHEMA = (
    "conv_id long, part int, seq int, low long, high long, turns long, first_turn long, last_turn long, "
    "blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "ways array<struct<before:int,after:int,cost:long,audit:string>>"
)
LEGAL = {"su", "ua", "au"}


def _block(conv: int | None, part: int, seq: int, turns: list, codes: list[str], whole: bool) -> tuple:
    known = [t for t in turns if t is not None]
    initials = [c[:-1] for c in codes]
    faults = [c[-1] for c in codes]
    return (
        conv, part, seq, min(known, default=None), max(known, default=None), len(set(known)), turns[0], turns[-1],
        faults.count("b"), faults.count("d"), faults.count("t"),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        initials[0], initials[-1], ways(tuple(codes), whole),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_WAY = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_BLOCKS = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32())]
    + [(c, pa.int64()) for c in "low high turns first_turn last_turn blank duplicate truncated illegal".split()]
    + [("first", pa.string()), ("last", pa.string()), ("ways", pa.list_(_WAY))]
)


def blocks(codes: DataFrame, size: int = BLOCK) -> DataFrame:
    """Every block's numbers and its ways through the grammar; (part, seq) orders the blocks of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, turns, own, whole, out = None, [], [], False, []

        def close() -> None:
            nonlocal seq, turns, own
            made = _block(held, part, seq, turns, own, whole)
            out.append((*made[:-1], [dict(zip(("before", "after", "cost", "audit"), w, strict=True)) for w in made[-1]]))
            seq, turns, own = seq + 1, [], []

        for batch in batches:
            for conv, turn, code, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "n")), strict=True):
                if not seq and not own:
                    held = conv  # whatever comes first may go on from the task before
                elif conv != held:
                    if own:
                        close()
                    held, whole = conv, True
                first = True
                while n:
                    # The first of equal rows has its own code, the others repeat it.
                    taken = 1 if first else min(n, size - len(own))
                    turns += [turn] * taken
                    own += [code] * taken
                    n -= taken
                    if len(own) == size:
                        close()
                        whole = False
                    if first and code[-1] != "b":
                        code = code[:-1] + "d"
                    first = False
            yield _batch(out, _BLOCKS)
            out.clear()
        if own:
            close()
        yield _batch(out, _BLOCKS)

    dealt = codes.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(run, BLOCK_SCHEMA)


FAULTS_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
_FAULTS = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in "gaps blank duplicate truncated illegal cost".split()]
    + [("audit", pa.string())]
)


class _Joined:
    """A conversation's blocks, joined as they come."""

    def __init__(self, conv: int | None):
        self.conv, self.low, self.high, self.turns, self.counts = conv, None, None, 0, [0, 0, 0, 0]
        self.last_turn, self.last = None, None
        self.tops: Tops = {START: (0, "")}

    def add(self, b: dict) -> None:
        self.low = b["low"] if self.low is None else self.low
        self.high = b["high"] if b["high"] is not None else self.high
        self.turns += b["turns"] - (b["first_turn"] is not None and b["first_turn"] == self.last_turn)
        self.counts = [x + b[c] for x, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
        if self.last is not None and self.last + b["first"] not in LEGAL:
            self.counts[3] += 1
        self.last_turn, self.last = b["last_turn"], b["last"]
        tops: Tops = {}
        for w in b["ways"]:
            way = self.tops.get(STACKS[w["before"]])
            if way:
                _put(tops, STACKS[w["after"]], way[0] + w["cost"], way[1] + w["audit"])
        self.tops = tops

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return (self.conv, gaps, *self.counts, *accepted(self.tops))


def faults(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``rows`` has conv_id, turn, role, text. A conversation's rows are taken by turn, nulls first, rows of one turn
    by role and a digest of the text. NULL is a conversation as well; empty tables give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = None
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                if joined is None or b["conv_id"] != joined.conv:
                    if joined is not None:
                        out.append(joined.row())
                    joined = _Joined(b["conv_id"])
                joined.add(b)
            yield _batch(out, _FAULTS)
        if joined is not None:
            yield _batch([joined.row()], _FAULTS)

    # The ranges are cut by a sample of the rows, so these are stored rather than made twice.
    made = blocks(stored(coded(rows), "coded"), size)
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, FAULTS_SCHEMA)


# ---------------------------------------------------------------- repair

_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows after the cheapest edits: conv_id, place (from 0), edit (K, R or I), role, text.

    ``audits`` (conv_id, audit) is what :func:`faults` found for the same rows. All rows of a conversation are
    in one partition of the result, in order; they stream past, nothing but the audit is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, edits, given = [], 0, iter(()), []

        def unread() -> Iterator[str]:
            while True:
                yield given.pop()

        def pull(conv: int | None, role: str, text: str, rest: bool = False) -> None:
            """Take edits up to this row's own, or all that are left."""
            nonlocal place
            for edit, new in edits:
                if edit != "D":
                    out.append((conv, place, edit, role if edit == "K" else new, "" if edit == "I" else text))
                    place += 1
                if edit != "I" and not rest:
                    return

        held: tuple = ()
        for batch in batches:
            for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    if held:
                        pull(held[0], "", "", rest=True)
                    held, place, edits = (conv,), 0, replayed(text, unread())
                else:
                    given.append(role[:1])
                    pull(conv, role, text)
            yield _batch(out, _REPAIRED)
            out.clear()
        if held:
            pull(held[0], "", "", rest=True)
            yield _batch(out, _REPAIRED)

    some = audits.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
    )
    both = some.unionByName(_ordered_by(rows).withColumn("kind", F.lit(1)))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    dealt = dealt.select("conv_id", "kind", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows as :func:`repaired` returns them: ``role:text`` joined by line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            out = []
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if digest is not None:
                        out.append((held, digest.hexdigest()))
                    held, digest = conv, hashlib.sha256()
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield _batch(out, _DIGESTS)
        if digest is not None:
            yield _batch([(held, digest.hexdigest())], _DIGESTS)

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults and repair of the damaged conversations, a row for every conv_id of the table.

    Columns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A conversation
    that loses all rows has zeros, an empty audit and the digest of the empty string, and so has one whose repair
    deletes all. Rows without conv_id are one conversation. Null roles and texts are one space. An empty table
    gives no rows; other columns are ignored.
    """
    rows = damaged(conversations)
    found = stored(faults(rows), "faults")
    sums = digests(repaired(rows, found)).withColumnRenamed("conv_id", "c")
    everyone = _rows(conversations).select(F.col("conv_id").alias("id")).distinct()
    out = everyone.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(sums, F.col("id").eqNullSafe(F.col("c")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in "gaps blank duplicate truncated illegal cost".split()]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
