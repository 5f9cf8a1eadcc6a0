"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A conversation's rows are taken by turn (nulls first; rows of one turn by role, then by a hash of the
text). A row can be kept, given the role that is due (3), or deleted (4), and empty turns of the role
that is due can be inserted (3). What is left must be ``(s?(ua)+)?`` in initials of roles. Blank rows
and rows whose role and text were seen before must go; a truncated row that stays costs 3.

The states are: begin, after system, after user, after assistant. The rows are numbered by one range
partitioning and cut into blocks of ``BLOCK``; a conversation's part of a block is a segment.

1. The cost of a segment from each state to each is a product of small matrices, in which a sum is the
   smaller one and a product the sum. Products over all segments to come are made by doubling: a
   segment joins that 1, 2, 4, ... segments on. So the cost to go is known at every segment's end.
2. In a segment, a node is a row and a state. Its optimal arcs are those on which the cost to go adds
   up. Nodes are ranked by the least letters that follow: by one letter, then by 2, 4, ... letters,
   a node's rank and that of the node its doubled pointer leads to making the next rank. Of optimal
   arcs the one of least letter and then of least rank is taken; doubled pointers lead along the path.
   This gives the audit and the last state of each first state.
3. First states follow from the segments' maps of states, doubled in the same way.

No conversation is gathered in a task, except for the one string that its audit is, and for the hash
of its repaired text, whose rows pass through a task one after the other.

Results: null roles and texts are one space, so such a text is blank. A role's initial is its first
character; only s, u and a can be kept. Rows without conversation are one conversation. Repeated rows
are duplicates. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.staging import partitions, sized_batches, staged

BLOCK = 4_096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
#: The letters of edits in the order in which ties are decided.
LETTERS = b"DIKR"
#: State after an insertion or a change of role, by state; state after keeping s, u, a (-1: not allowed).
_DUE = np.array([2, 2, 3, 2])
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_END = np.array([0, _FAR, _FAR, 0])


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that a hash of conversation and turn deals out."""
    turn, conv = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("turn", "conv_id"))
    fate = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    cut = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    given = rows.select("conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"), cut.alias("text"), fate.alias("fate"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return given.where("fate != 0").withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``ord``, which grows with conversation, turn, role and text, as a written table."""
    n = partitions(rows.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    given = rows.select("conv_id", "turn", role, text).withColumns({"tie": F.xxhash64("text"), "copy": F.monotonically_increasing_id()})
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "tie", "copy")]  # copy spreads equal rows
    ordered = given.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return staged(ordered.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("ord")), "turns")


def _block() -> Column:
    return F.floor(F.col("ord") / BLOCK).cast("long")


def faulted(ordered: DataFrame) -> DataFrame:
    """``ord, conv_id, initial, fault`` of every row: 1 blank, 2 seen before, 3 truncated, 0 none."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    look = ordered.select(
        "ord", "conv_id", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended")
    )
    first = ordered.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(~F.col("ended"), 3).otherwise(0)
    return look.join(first, "ord", "left").select("ord", "conv_id", "initial", fault.alias("fault"))


# ---- the path algebra, over many segments at once -----------------------------------------------


def _closed(b: np.ndarray) -> np.ndarray:
    """Cost to go with insertions before what ``b`` (states last) has without."""
    u, a = np.minimum(b[..., 2], INSERT + b[..., 3]), np.minimum(b[..., 3], INSERT + b[..., 2])
    return np.stack([np.minimum(b[..., 0], INSERT + u), np.minimum(b[..., 1], INSERT + u), u, a], -1)


def _step(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost of deleting, keeping and changing the role of rows, from each state, when ``after`` is the cost to go behind them."""
    initial, fault = codes >> 2, codes & 3
    stay = np.where((fault == 1) | (fault == 2), _FAR, np.where(fault == 3, TRUNCATED, 0))[:, None]
    to = _KEEP[:, initial].T
    keep = np.where(to < 0, _FAR, np.take_along_axis(after, np.maximum(to, 0), 1)) + stay
    return after + DELETE, keep, after[:, _DUE] + REROLE + stay


def _layers(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For 1, 2, ...: the segments that have so many rows at least, by that row from the end."""
    order = np.argsort(-sizes, kind="stable")
    live = len(order)
    for k in range(1, int(sizes.max(initial=0)) + 1):
        live = np.searchsorted(-sizes[order], -k, "right")
        yield k, order[:live]


def matrices(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The cost from each state before a segment to each behind it, segments first."""
    out = np.where(np.eye(4, dtype=bool), 0, _FAR)[None].repeat(len(sizes), 0)  # by last state, then first state
    for k, live in _layers(sizes):
        row = codes[starts[live] + sizes[live] - k]
        for last in range(4):
            out[live, last] = _closed(np.minimum.reduce(_step(row, out[live, last])))
    return np.minimum(out.transpose(0, 2, 1), _FAR)


def paths(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, list, list, np.ndarray]:
    """Of every segment and first state: cost to go, audit, the state before each letter, last state.

    ``ends`` is the cost to go behind the segments; ``final`` says where the conversation ends.
    """
    n = len(sizes)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # a segment has one layer more than rows
    layers = int((sizes + 1).sum())
    go = np.zeros((layers, 4), np.int64)
    cost, target = np.full((layers, 4, 4), _FAR), np.zeros((layers, 4, 4), np.int64)  # by node and letter
    last = base + sizes
    go[last] = np.where(final[:, None], _closed(ends), ends)
    for k, live in _layers(sizes):
        at = last[live] - k
        row = codes[starts[live] + sizes[live] - k]
        delete, keep, change = _step(row, go[at + 1])
        go[at] = _closed(np.minimum(np.minimum(delete, keep), change))
        cost[at, :, 0], cost[at, :, 2], cost[at, :, 3] = delete, keep, change
        target[at, :, 0] = (at[:, None] + 1) * 4 + np.arange(4)
        target[at, :, 2] = (at[:, None] + 1) * 4 + np.maximum(_KEEP[:, row >> 2].T, 0)
        target[at, :, 3] = (at[:, None] + 1) * 4 + _DUE
    inner = np.ones(layers, bool)
    inner[last] = final
    cost[inner, :, 1] = go[inner][:, _DUE] + INSERT
    target[:, :, 1] = np.arange(layers)[:, None] * 4 + _DUE
    # arcs that the end of a segment or of the conversation doesn't have
    nodes = layers * 4
    stop = np.zeros((layers, 4), bool)
    stop[last] = np.where(final[:, None], ends == 0, True)
    cost[stop] = _FAR
    optimal = (cost.reshape(nodes, 4) == go.reshape(nodes, 1)) & ~stop.reshape(nodes, 1)
    target = target.reshape(nodes, 4)
    target[stop.reshape(nodes)] = np.arange(nodes)[stop.reshape(nodes), None]
    levels = max(1, int(np.ceil(np.log2(2 * int(sizes.max(initial=0)) + 4))))
    letter = np.where(optimal.any(1), optimal.argmax(1), -1)
    rank = ranks(letter, target[np.arange(nodes), np.maximum(letter, 0)], levels)
    choice = np.where(optimal, np.arange(4) * (nodes + 1) + rank[target], 4 * (nodes + 1)).argmin(1)
    ahead = [target[np.arange(nodes), choice]]
    for _ in range(levels):
        ahead.append(ahead[-1][ahead[-1]])
    entry = (base[:, None] * 4 + np.arange(4)).ravel()
    ended = stop.reshape(nodes)
    steps, node = np.zeros(len(entry), np.int64), entry.copy()
    for k in range(levels, -1, -1):
        far = ~ended[ahead[k][node]]
        steps[far] += 1 << k
        node[far] = ahead[k][node[far]]
    steps[~ended[entry]] += 1
    node = ahead[0][node]  # an end leads to itself
    edges = np.concatenate([[0], np.cumsum(steps)])
    where = np.repeat(entry, steps)
    t = np.arange(edges[-1]) - np.repeat(edges[:-1], steps)
    for k in range(levels + 1):
        odd = (t >> k) & 1 == 1
        where[odd] = ahead[k][where[odd]]
    letters = np.frombuffer(LETTERS, np.uint8)[choice[where]].tobytes()
    states = (where % 4).astype(np.uint8).tobytes()
    cut = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return go[base].reshape(n, 4), [letters[a:b] for a, b in cut], [states[a:b] for a, b in cut], (node % 4).reshape(n, 4)


def ranks(letter: np.ndarray, ahead: np.ndarray, levels: int) -> np.ndarray:
    """Ranks of nodes by their least audits: of 1 letter, then of 2, 4, ..., ``2 ** levels`` letters; an end is least."""
    rank = np.unique(letter, return_inverse=True)[1]
    for _ in range(levels):
        rank = np.unique(rank * (len(rank) + 1) + rank[ahead], return_inverse=True)[1]
        ahead = ahead[ahead]
    return rank


# ---- segments as a table ------------------------------------------------------------------------

_SEGMENT = "at long, size long, first string, last string, illegal long, blank long, duplicate long, truncated long, codes binary, costs array<long>"
_LEGAL = ("su", "ua", "au")


def segments(rows: DataFrame) -> DataFrame:
    """A row per conversation and block of the faulted rows: counts, codes of the rows, and costs from state to state."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            block = np.asarray(table.column("block"))
            end = int(np.flatnonzero(block != block[-1])[-1]) + 1 if len(block) and block[0] != block[-1] else 0
            if end:
                yield _segments_of(table.slice(0, end))
            held = table.slice(end)
        if held is not None and held.num_rows:
            yield _segments_of(held)

    dealt = rows.withColumn("block", _block()).repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block", "ord")
    return dealt.mapInArrow(run, f"conv_id {kind}, {_SEGMENT}")


def _segments_of(table: pa.Table) -> pa.RecordBatch:
    conv = table.column("conv_id").combine_chunks()
    group = np.asarray(conv.dictionary_encode("encode").indices if not isinstance(conv, pa.ChunkedArray) else conv.chunk(0).dictionary_encode("encode").indices)
    block = np.asarray(table.column("block"))
    starts = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(block, prepend=block[0] - 1) != 0))
    sizes = np.diff(starts, append=len(group))
    initial = table.column("initial").to_pylist()
    fault = np.asarray(table.column("fault")).astype(np.uint8)
    codes = (np.array(["sua".find(i) if i else -1 for i in initial], np.int8) & 3).astype(np.uint8) << 2 | fault
    wrong = np.array([x + y not in _LEGAL for x, y in zip(initial, [*initial[1:], ""], strict=True)])
    wrong[starts + sizes - 1] = False
    costs = matrices(codes, starts, sizes)

    def total(hit: np.ndarray) -> pa.Array:
        return pa.array(np.add.reduceat(hit.astype(np.int64), starts))

    return pa.RecordBatch.from_arrays([
        conv.take(pa.array(starts)), table.column("ord").combine_chunks().take(pa.array(starts)), pa.array(sizes),
        pa.array([initial[a] for a in starts], pa.string()), pa.array([initial[a] for a in starts + sizes - 1], pa.string()),
        total(wrong), total(fault == 1), total(fault == 2), total(fault == 3),
        pa.array([codes[a : a + k].tobytes() for a, k in zip(starts, sizes, strict=True)], pa.binary()),
        pa.array([c.ravel().tolist() for c in costs], pa.list_(pa.int64())),
    ], ["conv_id", "at", "size", "first", "last", "illegal", "blank", "duplicate", "truncated", "codes", "costs"])


def _product(x: Column, y: Column) -> Column:
    return F.array(*(F.least(*(x[4 * i + j] + y[4 * j + k] for j in range(4)), F.lit(_FAR)) for i in range(4) for k in range(4)))


def _scanned(table: DataFrame, column: str, back: bool, combine, most: int) -> DataFrame:
    """``g, k, column`` where a segment's value is combined with those of all before (``back``) or behind it, by doubling."""
    step, found = 1, table.select("g", "k", column)
    while step < most:
        other = found.select("g", (F.col("k") + (step if back else -step)).alias("k"), F.col(column).alias("other"))
        joined = combine(F.col("other"), F.col(column)) if back else combine(F.col(column), F.col("other"))
        found = staged(found.join(other, ["g", "k"], "left").select("g", "k", F.when(F.col("other").isNull(), F.col(column)).otherwise(joined).alias(column)), "doubled")
        step *= 2
    return found


def _pathed(rows: DataFrame) -> DataFrame:
    """``g, k, cost, audits, states, exits`` of segments, the last four by first state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.asarray(b.column("size")).astype(np.int64)
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8)
            final = np.asarray(b.column("final"))
            behind = np.array([np.zeros(16, np.int64) if x is None else x for x in b.column("behind").to_pylist()], np.int64).reshape(-1, 4, 4)
            ends = np.where(final[:, None], _END, (behind + _closed(_END)).min(2))
            go, audits, states, exits = paths(codes, np.cumsum(sizes) - sizes, sizes, ends, final)
            four = [audits[i : i + 4] for i in range(0, len(audits), 4)], [states[i : i + 4] for i in range(0, len(states), 4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("g"), b.column("k"), pa.array(go[:, 0]), *(pa.array(x, pa.list_(pa.binary())) for x in four), pa.array(exits.tolist(), pa.list_(pa.int32()))],
                ["g", "k", "cost", "audits", "states", "exits"],
            )

    return rows.select("g", "k", "size", "codes", "final", "behind").mapInArrow(
        run, "g long, k int, cost long, audits array<binary>, states array<binary>, exits array<int>"
    )


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and the edits of every segment: its conversation, counts, audit, and states before each edit.

    ``g`` names a conversation (its first ``ord``), ``k`` counts its segments from 0; ``cost`` is
    the whole conversation's, in its segment 0.
    """
    sized_batches(rows.sparkSession)
    ordered = numbered(rows)
    own = Window.partitionBy("conv_id").orderBy("at")
    cut = staged(segments(faulted(ordered)), "segments").withColumns({
        "g": F.min("at").over(own), "k": F.row_number().over(own) - 1, "before": F.lag("last").over(own), "final": F.lead("at").over(own).isNull(),
    })
    cut = staged(cut, "numbered")
    most = (cut.agg(F.max("k")).first()[0] or 0) + 1
    several = cut.join(cut.where("k = 1").select("g"), "g", "left_semi") if most > 1 else cut.limit(0)
    behind = _scanned(several, "costs", False, _product, most).select("g", (F.col("k") - 1).alias("k"), F.col("costs").alias("behind"))
    pathed = staged(_pathed(cut.join(behind, ["g", "k"], "left")), "paths")
    joined = pathed.join(several.select("g").distinct(), "g", "left_semi") if most > 1 else pathed.limit(0)
    maps = _scanned(joined, "exits", True, lambda x, y: F.transform(x, lambda s: y[s]), most)
    entry = maps.select("g", (F.col("k") + 1).alias("k"), F.col("exits")[0].alias("entry"))
    told = pathed.join(entry, ["g", "k"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    picked = told.select("g", "k", "cost", F.col("audits")[F.col("entry")].cast("string").alias("audit"), F.col("states")[F.col("entry")].alias("states"))
    broken = F.when(F.col("before").isNotNull() & ~F.concat("before", "first").isin(*_LEGAL), 1).otherwise(0)
    return ordered, staged(cut.drop("codes", "costs").withColumn("illegal", F.col("illegal") + broken).join(picked, ["g", "k"]), "edits")


def repaired(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """``g, k, j, conv_id, role, text``: the rows of the repaired conversations, in the order of ``k, j``."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    plans = edits.select(_block_of("at").alias("block"), F.col("at").alias("ord"), "g", "k", "audit", "states", "conv_id", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turns = ordered.select(_block().alias("block"), "ord", F.lit(None).cast("long").alias("g"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("binary").alias("states"), "conv_id", "role", "text")
    both = plans.unionByName(turns).repartition(partitions(ordered.sparkSession), "block").sortWithinPartitions("block", "ord", F.col("g").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        plan, j, mine = iter(()), 0, None

        def inserted() -> tuple | None:
            """Take the insertions that come next; returns the edit of the next row."""
            nonlocal j
            for letter, state in plan:
                if letter != "I":
                    return letter, state
                out.append((*mine, j, "assistant" if state == 2 else "user", ""))
                j += 1
            return None

        for b in batches:
            for g, k, audit, states, conv, role, text in zip(*(b.column(c).to_pylist() for c in ("g", "k", "audit", "states", "conv_id", "role", "text")), strict=True):
                if g is not None:
                    inserted()
                    plan, j, mine = zip(audit, states, strict=True), 0, (conv, g, k)
                    continue
                letter, state = inserted()
                if letter != "D":
                    out.append((*mine, j, role if letter == "K" else "assistant" if state == 2 else "user", text))
                    j += 1
            inserted_all = len(out) > 4_096
            if inserted_all:
                yield _rows(out, b.schema.field("conv_id").type)
                out.clear()
            last = b.schema.field("conv_id").type
        inserted()
        if out:
            yield _rows(out, last)

    return both.mapInArrow(run, f"conv_id {kind}, g long, k int, j int, role string, text string")


def _block_of(column: str) -> Column:
    return F.floor(F.col(column) / BLOCK).cast("long")


def _rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "g", "k", "j", "role", "text"])


def _hashed(rows: DataFrame) -> DataFrame:
    """``g, repaired_sha256``; rows pass one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, digest = None, None
        for b in batches:
            done = []
            for own, role, text in zip(*(b.column(c).to_pylist() for c in ("g", "role", "text")), strict=True):
                if own != g:
                    if digest is not None:
                        done.append((g, digest.hexdigest()))
                    g, digest = own, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            yield _digests(done)
        if digest is not None:
            yield _digests([(g, digest.hexdigest())])

    dealt = rows.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "k", "j")
    return dealt.select("g", "role", "text").mapInArrow(run, "g long, repaired_sha256 string")


def _digests(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], ["g", "repaired_sha256"])


def report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation of ``every``."""
    ordered, edits = repair(rows)
    turns = ordered.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    ).withColumnRenamed("conv_id", "own")
    pieces = F.array_sort(F.collect_list(F.struct("k", "audit")))
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    told = edits.groupBy("g", F.col("conv_id").alias("conv")).agg(
        *counts, F.max(F.when(F.col("k") == 0, F.col("cost"))).alias("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit")
    ).join(_hashed(repaired(ordered, edits)), "g", "left")
    empty = {"gaps": F.lit(0), **{c: F.lit(0) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}}
    ids = every.select("conv_id").distinct()
    joined = ids.join(told, ids["conv_id"].eqNullSafe(told["conv"]), "left").join(turns, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    return joined.select(
        "conv_id", *(F.coalesce(F.col(c), v).cast("long").alias(c) for c, v in empty.items()), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
