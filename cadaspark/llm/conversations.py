"""Structure of conversations: damage, faults, and the cheapest edits that give ``(s?(ua)+)?``.

A conversation is a path through four states (nothing yet, after the system row, after a user row,
after an assistant row), and every edit is an arc with a cost.  A cost DP leaves the arcs of cheapest
paths; of those the path whose letters are least is wanted.  It is found by prefix doubling: nodes
are ranked by the first letter of their least path, then by the first two, four, eight, ..., as a
pair (own rank, rank of the node so many letters on), with pointers doubled alongside; the ranks
choose each node's arc, and the doubled pointers of the chosen arcs give the whole path.

Rows are sorted over the whole table (a range of rows a task, whatever conversation they are of) and
cut into blocks of at most ``BLOCK`` rows of one conversation.  A block is a 4 x 4 matrix of costs and
a map of states, so long conversations are chained by their blocks and no task holds one whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.llm.common import BLANKS, freed, joined_by_count, stored

#: Rows of one conversation that a block has at most, as a power of two; rows that a task handles at once.
BLOCK_BITS, AT_ONCE = 12, 1 << 15
FAR = 1 << 60
#: The state after an inserted (or re-roled) row: a user row, but an assistant one after a user row.
NEXT = np.array([2, 2, 3, 2])
#: The state after a kept row of initial s, u, a or another, by state; -1 where it may not follow.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Letters of edits in their order; END stands for the end of a path.
LETTERS = np.frombuffer(b"DIKR", np.uint8)
DELETE, INSERT, KEEP, REROLE, END = 0, 1, 2, 3, 4
#: What a row must or may be: any edit, only deleted, or kept at a price.
SOUND, GONE, CUT = 0, 1, 2


@dataclass(frozen=True)
class EditCosts:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: ``df`` damaged by ``crc32('conv:turn') % 20``; nulls count as one space."""
    spaced = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn))) % 20
    return df.filter(kind != 0).select(
        df[conv].alias("conv_id"),
        df[turn].alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(spaced(text), ".!?", "")).otherwise(spaced(text)).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows in order: conv_id, turn, role, text, n (times), fault, initial, later (a repeat of an earlier turn), pos.

    ``pos`` grows in the order of conversation, turn (nulls first), role and text.
    """
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("n"))
    key = F.sha2(F.to_json(F.struct(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")), {"ignoreNullFields": "false"}), 256)
    alike = stored(alike.withColumn("key", F.unhex(key)), "conversation-rows")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = alike.groupBy("key").agg(F.min(turn).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    again = stored(again.withColumn("again", F.lit(True)), "conversation-repeats")
    both = joined_by_count(alike, again, ["key"], "turns", "left")
    shown = F.rtrim("text", F.lit(BLANKS))
    later = F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(shown == "", "blank").when(later, "duplicate").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    marked = both.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), F.left("role", F.lit(1)).alias("initial"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    ranged = marked.repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    return stored(ranged.withColumn("pos", F.monotonically_increasing_id()), "conversation-order")


def blocks_of(ordered: DataFrame) -> DataFrame:
    """conv_id, block, rows (pos, code, n): code is the initial (s, u, a, other) and four times what may become of the row."""
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.col("initial")) - 1, F.lit(-1))
    what = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(SOUND)
    code = (F.when(initial < 0, 3).otherwise(initial) + 4 * what).cast("int")
    rows = ordered.select("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block"), F.struct("pos", code.alias("code"), "n").alias("row"))
    return stored(rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("row")).alias("rows")), "conversation-blocks")


class Blocks:
    """Rows of some blocks as flat arrays; a position stands before each row and at each block's end."""

    def __init__(self, batch: pa.RecordBatch, costs: EditCosts):
        rows = batch.column("rows")
        sizes = np.diff(rows.offsets.to_numpy())
        flat = rows.flatten()
        self.pos, code, self.n = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
        self.initial, self.what = code & 3, code >> 2
        self.count, self.sizes = len(sizes), sizes
        self.first = np.append(0, np.cumsum(sizes + 1))  # first position of each block, and their number
        self.ends = self.first[1:] - 1
        self.place = np.arange(len(code)) + np.repeat(np.arange(self.count), sizes)  # position before each row
        self.costs = costs
        price = np.where(self.what == CUT, costs.truncated, 0)
        more = costs.delete * (self.n - 1)  # further copies are deleted
        self.delete = costs.delete + more
        self.keep = np.where(self.what == GONE, FAR, price + more)
        self.rerole = np.where(self.what == GONE, FAR, price + more + costs.rerole)

    def to_go(self, terminal: np.ndarray) -> np.ndarray:
        """Least cost from every position and state (positions, 4, exits) to the exits' costs at the block's end."""
        out = np.full((self.first[-1], 4, terminal.shape[2]), FAR, np.int64)
        out[self.ends] = terminal
        by_size = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[by_size]
        row_ends = np.cumsum(self.sizes)[by_size]
        for j in range(int(sizes[0]) if self.count else 0):  # a row of every block at a time, from the last on
            live = int(np.searchsorted(-sizes, -j, side="left"))
            row = row_ends[:live] - 1 - j
            after = out[self.place[row] + 1]
            now = after + self.delete[row, None, None]
            now = np.minimum(now, after[:, NEXT] + self.rerole[row, None, None])
            kept = KEPT[:, self.initial[row]].T
            stay = np.take_along_axis(after, np.maximum(kept, 0)[:, :, None], 1) + self.keep[row, None, None]
            now = np.minimum(np.minimum(now, np.where(kept[:, :, None] >= 0, stay, FAR)), FAR)
            now[:, 2:] = np.minimum(now[:, 2:], now[:, NEXT[2:]] + self.costs.insert)
            now[:, :2] = np.minimum(now[:, :2], now[:, NEXT[:2]] + self.costs.insert)
            out[self.place[row]] = np.minimum(now, FAR)
        return out

    def arcs(self, to_go: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Node that each cheapest arc leads to, (nodes, letters), or -1; a node is 4 * position + state.

        At the end of a ``last`` block rows may still be inserted.
        """
        cost = to_go[:, :, 0]
        state = np.arange(4)
        to = np.full((len(cost), 4, 4), -1, np.int64)
        at, after = self.place[:, None], (self.place + 1)[:, None]

        def mark(letter: int, at: np.ndarray, at_next: np.ndarray, next_state: np.ndarray, price: np.ndarray) -> None:
            target = 4 * at_next + np.maximum(next_state, 0)
            tight = (next_state >= 0) & (cost[at, state] < FAR) & (price + cost[at_next, np.maximum(next_state, 0)] == cost[at, state])
            to[at, state, letter] = np.where(tight, target, -1)

        mark(DELETE, at, after, state[None], self.delete[:, None])
        mark(KEEP, at, after, KEPT[:, self.initial].T, self.keep[:, None])
        mark(REROLE, at, after, NEXT[None], self.rerole[:, None])
        for where in (at, self.ends[last][:, None]):
            mark(INSERT, where, where, NEXT[None], np.array([[self.costs.insert]]))
        return to.reshape(-1, 4)


def least_arcs(to: np.ndarray) -> np.ndarray:
    """The letter of each node's arc on its least path (``END`` where none leads on), by ranks of doubled lengths.

    A letter leads to one node at most, so pointers are functions.
    """
    nodes = np.arange(len(to))

    def chosen(rank: np.ndarray) -> np.ndarray:
        key = np.where(to >= 0, np.arange(4) * (len(to) + 1) + rank[to], 4 * (len(to) + 1))
        return np.where(key.min(axis=1, initial=4 * (len(to) + 1)) < 4 * (len(to) + 1), key.argmin(axis=1), END)

    rank = (chosen(np.zeros(len(to), np.int64)) + 1) % (END + 1)  # by the first letter; a path that ends is least
    letter = chosen(rank)
    jump = np.where(letter < END, to[nodes, np.minimum(letter, 3)], nodes)
    while not np.array_equal(jump, jump[jump]):
        # ranks tell paths apart by so many letters, and now by twice as many
        rank = np.unique(rank * (len(to) + 1) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
    return chosen(rank)


def paths(start: np.ndarray, to: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path, node and letter of each step of the paths from ``start``, in order, by doubled pointers; and last, where each ends."""
    nodes = np.arange(len(to))
    jumps = [np.where(letter < END, to[nodes, np.minimum(letter, 3)], nodes)]
    while not np.array_equal(jumps[-1], jumps[-1][jumps[-1]]):
        jumps.append(jumps[-1][jumps[-1]])
    ends = jumps[-1][jumps[-1]][start]
    path, node, step = np.arange(len(start)), start, np.zeros(len(start), np.int64)
    for k in range(len(jumps) - 1, -1, -1):
        far = jumps[k][node]
        path, step = np.append(path, path), np.append(step, step + (1 << k))
        node = np.append(node, far)
        on = letter[node] < END
        path, node, step = path[on], node[on], step[on]
    first = np.unique(path * (step.max(initial=0) + 1) + step, return_index=True)[1]
    return path[first], node[first], ends


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of blocks with at most ``AT_ONCE`` rows (one block at least)."""
    sizes = np.diff(batch.column("rows").offsets.to_numpy())
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > AT_ONCE:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def end_costs(costs: EditCosts) -> np.ndarray:
    """What is still to be inserted after the last row."""
    return np.array([0, 2 * costs.insert, costs.insert, 0])


def in_parts(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns], names=batch.schema.names)):
                yield f(part)

    return run


def chained(blocks: DataFrame, costs: EditCosts) -> DataFrame:
    """conv_id, block, entry (state), exits (costs at the block's end), last, joint of conversations of several blocks.

    ``joint`` is 1 where the initials of the block before and this one may not follow each other.
    """
    several = blocks.groupBy("conv_id").agg(F.count("*").alias("blocks")).filter("blocks > 1").select(F.col("conv_id").alias("c"))
    many = stored(blocks.join(several, blocks["conv_id"].eqNullSafe(several["c"]), "left_semi"), "conversation-long")
    kind = dict(blocks.dtypes)["conv_id"]

    def matrix(part: pa.RecordBatch) -> pa.RecordBatch:
        b = Blocks(part, costs)
        terminal = np.where(np.eye(4, dtype=bool), 0, FAR)
        whole = b.to_go(np.broadcast_to(terminal, (b.count, 4, 4)))[b.first[:-1]]
        rows = np.append(0, np.cumsum(b.sizes))
        ends = [pa.array(b.initial[rows[:-1]].astype(np.int32)), pa.array(b.initial[rows[1:] - 1].astype(np.int32))]
        return pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("block"), pa.array(list(whole.reshape(-1, 16)), pa.list_(pa.int64())), *ends], names=["conv_id", "block", "matrix", "head", "tail"])

    def back(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        x, out = end_costs(costs), []
        for m in reversed(table.column("matrix").to_pylist()):
            out.append(x)
            x = np.minimum((np.array(m).reshape(4, 4) + x).min(axis=1), FAR)
        heads, tails = table.column("head").to_numpy(), table.column("tail").to_numpy()
        joint = np.append(0, illegal(tails[:-1], heads[1:]))
        last = np.arange(len(out)) == len(out) - 1
        return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), "exits": pa.array(out[::-1], pa.list_(pa.int64())), "last": last, "joint": pa.array(joint, pa.int32())})

    matrices = many.mapInArrow(in_parts(matrix), f"conv_id {kind}, block bigint, matrix array<bigint>, head int, tail int")
    exits = stored(matrices.groupBy("conv_id").applyInArrow(back, f"conv_id {kind}, block bigint, exits array<bigint>, last boolean, joint int"), "conversation-exits")

    def states(part: pa.RecordBatch) -> pa.RecordBatch:
        b = Blocks(part, costs)
        last = np.zeros(b.count, bool)
        to = b.arcs(b.to_go(np.array(part.column("exits").to_pylist(), np.int64)[:, :, None]), last)
        start = (4 * b.first[:-1, None] + np.arange(4)).ravel()
        leads = paths(start, to, least_arcs(to))[2] & 3
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "block", "exits", "last", "joint")), pa.array(list(leads.reshape(-1, 4)), pa.list_(pa.int64()))], names=["conv_id", "block", "exits", "last", "joint", "leads"])

    def forth(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        entry, out = 0, []
        for leads in table.column("leads").to_pylist():
            out.append(entry)
            entry = leads[entry]
        return table.drop_columns(["leads"]).append_column("entry", pa.array(out, pa.int32()))

    schema = f"conv_id {kind}, block bigint, exits array<bigint>, last boolean, joint int"
    led = same_block(many, exits).mapInArrow(in_parts(states), f"{schema}, leads array<bigint>")
    return stored(led.groupBy("conv_id").applyInArrow(forth, f"{schema}, entry int"), "conversation-entries")


def same_block(blocks: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    named = other.withColumnsRenamed({"conv_id": "c", "block": "b"})
    return blocks.join(named, (blocks["block"] == named["b"]) & blocks["conv_id"].eqNullSafe(named["c"]), how).drop("c", "b")


def illegal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 where initials (s, u, a, other) may not stand side by side: all pairs but su, ua and au."""
    return 1 - (((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))).astype(np.int64)


def audited(ordered: DataFrame, costs: EditCosts) -> DataFrame:
    """conv_id, block, audit, cost, illegal, edits (pos, k, role, added): what stays or comes, in order of pos and k."""
    blocks = blocks_of(ordered)
    whole = same_block(blocks, chained(blocks, costs), "left")
    kind = dict(blocks.dtypes)["conv_id"]
    end = end_costs(costs)

    def audit(part: pa.RecordBatch) -> pa.RecordBatch:
        b = Blocks(part, costs)
        exits = np.array([e if e is not None else end for e in part.column("exits").to_pylist()], np.int64).reshape(-1, 4)
        last = np.array([x is not False for x in part.column("last").to_pylist()], bool)
        entry = np.array([e or 0 for e in part.column("entry").to_pylist()], np.int64)
        joint = np.array([j or 0 for j in part.column("joint").to_pylist()], np.int64)
        to_go = b.to_go(exits[:, :, None])
        to = b.arcs(to_go, last)
        letter = least_arcs(to)
        start = 4 * b.first[:-1] + entry
        path, node, ends = paths(start, to, letter)
        cost = to_go[b.first[:-1], entry, 0] - np.where(last, 0, exits[np.arange(b.count), ends & 3])

        place, state, edit = node >> 2, node & 3, letter[node]
        row = place - path - np.isin(place, b.ends)  # the row after the position, at a block's end the one before
        times = np.where(edit == INSERT, 1, b.n[row])
        text = np.full(int(times.sum()), LETTERS[DELETE])
        text[np.cumsum(times) - times] = LETTERS[edit]
        cuts = np.append(0, np.cumsum(np.bincount(path, times, b.count).astype(np.int64)))
        audits = [text[x:y].tobytes().decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

        stay = np.flatnonzero(edit != DELETE)
        new = np.where(NEXT[state[stay]] == 2, "user", "assistant")
        inserts = (edit == INSERT).cumsum()
        k = inserts[stay] + np.where(edit[stay] == INSERT, 0, 1 << 30) + np.where(np.isin(place[stay], b.ends), 1 << 31, 0)
        edits = pa.StructArray.from_arrays(
            [
                pa.array(b.pos[row[stay]]),
                pa.array(k.astype(np.int64)),
                pa.array(new.tolist(), pa.string(), mask=edit[stay] == KEEP),
                pa.array(edit[stay] == INSERT),
            ],
            names=["pos", "k", "role", "added"],
        )
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(path[stay], minlength=b.count))).astype(np.int32)), edits)
        rows = np.append(0, np.cumsum(b.sizes))
        inner = np.append(illegal(b.initial[:-1], b.initial[1:]), 0)
        inner[rows[1:] - 1] = 0
        wrong = np.add.reduceat(inner + b.n - 1, rows[:-1]) + joint if b.count else joint
        return pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("block"), pa.array(audits, pa.string()), pa.array(cost), pa.array(wrong), lists], names=["conv_id", "block", "audit", "cost", "illegal", "edits"])

    edits = "array<struct<pos: bigint, k: bigint, role: string, added: boolean>>"
    out = whole.select("conv_id", "block", "rows", "exits", "last", "entry", "joint").mapInArrow(in_parts(audit), f"conv_id {kind}, block bigint, audit string, cost bigint, illegal bigint, edits {edits}")
    return stored(out, "conversation-audits")


def repaired_conversations(rows: DataFrame, costs: EditCosts = EditCosts()) -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest edits of conversations, and their rows after those edits.

    ``rows`` has conv_id, turn, role, text and copies (how often the row stands there).  A row is of a
    turn (nulls first), rows of one turn stand in the order of role and text, and a null conv_id is a
    conversation like others.  Its first fault counts: blank, duplicate (role and text stood earlier),
    truncated (the last character that is no blank is not ``.``, ``!`` or ``?``).

    The first table has a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit.  The second has conv_id, pos, k, role, text in the order of pos and k.  Very long
    conversations are worked on in blocks; texts are moved, never gathered; an empty table gives
    empty tables; other columns are not read.
    """
    ordered = ordered_rows(rows)
    audits = audited(ordered, costs)
    n, is_fault = F.col("n"), lambda f: F.col("fault").eqNullSafe(f)
    lone = F.col("fault").isNull() | is_fault("truncated")
    turns = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    faults = ordered.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("bigint").alias("gaps"),
        F.sum(F.when(is_fault("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(is_fault("duplicate"), n).when(lone, n - 1).otherwise(0)).alias("duplicate"),
        F.sum(is_fault("truncated").cast("bigint")).alias("truncated"),
    )
    parts = audits.groupBy(F.col("conv_id").alias("c")).agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("parts")
    )
    report = faults.join(parts, faults["conv_id"].eqNullSafe(parts["c"])).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("parts.audit", "").alias("audit"))
    edits = audits.select("conv_id", F.explode("edits").alias("edit")).select("conv_id", "edit.*")
    source = ordered.select(F.col("pos").alias("p"), F.col("role").alias("old"), F.col("text").alias("old_text"))
    repaired = edits.join(source, edits["pos"] == source["p"]).select("conv_id", "pos", "k", F.coalesce("role", "old").alias("role"), F.when(F.col("added"), "").otherwise(F.col("old_text")).alias("text"))
    return report, repaired


def digests(repaired: DataFrame, line: Column) -> DataFrame:
    """conv_id, sha256: of the newline-joined lines of each conversation.

    A digest takes one byte after the other, so the lines of a conversation stream through one task,
    which holds a batch of them at a time.
    """
    kind = dict(repaired.dtypes)["conv_id"]

    @freed
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, digest, done = None, None, []
        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if digest is None or conv != open_conv:
                    done += [(open_conv, digest.hexdigest())] if digest else []
                    open_conv, digest = conv, hashlib.sha256(text.encode())
                else:
                    digest.update(b"\n")
                    digest.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], batch.schema.field("conv_id").type), pa.array([d for _, d in done])], names=["conv_id", "sha256"])
                done, kind_of = [], batch.schema.field("conv_id").type
            kind_of = batch.schema.field("conv_id").type
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([open_conv], kind_of), pa.array([digest.hexdigest()])], names=["conv_id", "sha256"])

    lines = repaired.select("conv_id", "pos", "k", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k")
    return lines.select("conv_id", "line").mapInArrow(hashed, f"conv_id {kind}, sha256 string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report, repaired = repaired_conversations(damaged(df))
    hashes = digests(repaired, F.concat("role", F.lit(":"), "text")).withColumnRenamed("conv_id", "h")
    ids = df.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(report, ids["id"].eqNullSafe(report["conv_id"]), "left").join(hashes, ids["id"].eqNullSafe(hashes["h"]), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_PRICE, _LINE = "case when truncated then 5 else 0 end", "role || ':' || text"


def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """SQL of a state after one more edit: cost, audit, lines."""
    lines = f"list_append({state}.l, {line})" if line else f"{state}.l"
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {lines}}} end"


def _rows(state: str, to: str, initial: str) -> str:
    """SQL of the lesser of keeping and re-roling a row after ``state``."""
    keep = _edit(state, _PRICE, "K", _LINE)
    rerole = _edit(state, f"({_PRICE}) + 1", "R", f"'{to}:' || text")
    return f"case when not gone then least(case when role[1] = '{initial}' then {keep} end, {rerole}) end"


_AFTER_USER = ", ".join(_edit(q, "5", "I", "'user:'") for q in ("p0", "p1", "p3"))
_NOTHING = "cast(null as struct(c bigint, a varchar, l varchar[]))"
OP11_SQL = f"""
with recursive o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, (2 ** 32 - 1 - list_reduce(list_concat([4294967295], list_transform(
    string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))::bigint % 20 as kind
  from conversations),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from o, unnest(generate_series(1, case when kind = 3 then 2 else 1 end)) where kind <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown from d),
m as (select *, shown = '' as blank, shown <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as duplicate,
             lag(role[1]) over (partition by conv_id order by i) || role[1] as pair, i > 1 as after from n),
f as (select *, not blank and not duplicate and right(shown, 1) not in ('.', '!', '?') as truncated, blank or duplicate as gone from m),
r as (
  select distinct conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': '', 'l': []::varchar[]}} as p0, {_NOTHING} as p1, {_NOTHING} as p2, {_NOTHING} as p3 from f
  union all
  select conv_id, i, {_edit('q0', '2', 'D')}, least({_edit('q1', '2', 'D')}, case when not gone and role[1] = 's' then {_edit('q0', _PRICE, 'K', _LINE)} end),
         least({_edit('q2', '2', 'D')}, {_rows('q0', 'user', 'u')}, {_rows('q1', 'user', 'u')}, {_rows('q3', 'user', 'u')}),
         least({_edit('q3', '2', 'D')}, {_rows('q2', 'assistant', 'a')})
  from (select f.*, q0, q1, q2, least(p3, {_edit('q2', '5', 'I', "'assistant:'")}) as q3
        from (select conv_id as conv, i as done, p0 as q0, p1 as q1, least(p2, {_AFTER_USER}) as q2, p3 from r) as s
        join f on f.conv_id is not distinct from s.conv and f.i = s.done + 1)),
e as (select conv_id, least(p0, {_edit('q2', '5', 'I', "'assistant:'")}, p3) as best
      from (select conv_id, p0, p3, least(p2, {_AFTER_USER}) as q2 from r where i = (select max(i) from f where f.conv_id is not distinct from r.conv_id))),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
             count(*) filter (where truncated) as truncated, count(*) filter (where after and pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) as ids left join c on c.conv_id is not distinct from ids.conv_id left join e on e.conv_id is not distinct from ids.conv_id
"""
