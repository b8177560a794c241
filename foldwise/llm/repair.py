r"""Operator 12: conversation structure repair by prefix-doubling path ranking.

A conversation's roles must read ``(s?(ua)+)?`` by their initials.  Its rows are
kept (K, 0), given the role that is due (R, 2) or deleted (D, 3; required for blank
and duplicate ones), and empty rows of the role that is due are inserted anywhere
(I, 2); a truncated row that stays costs 1 more.  Wanted are the least cost and, of
the cheapest audits (the edits' initials in order), the one that is first in ASCII order.

1. Conversations are range-sorted and cut into blocks, so one of any length spreads
   over tasks.  A block's cost DP gives the least cost from each entry state to each
   exit state (states: nothing yet, s, u, a).
2. The blocks' matrices are chained from the end of each conversation: the cost from
   every block's end on.
3. With these, each block knows its optimal arcs: (row, state) nodes by edits.  Arcs
   are ranked by their first audit letter, then by their first 2, 4, 8, ... letters:
   the rank of twice the length follows from the pair (rank, rank of the best arc at
   the node that the doubled pointer leads to).  An edit fixes the node it leads to,
   so one pointer to a length is enough.  Following the doubled pointers from each of
   the four entry states by the bits of every distance gives all letters of the path.
4. The blocks' (entry, exit) maps are chained from the start, which selects the audits.

Only matrices, exits and audits move between the steps; texts are shuffled when they
are sorted into blocks, for the search of duplicates, and to meet the audits.

Defined results: a null role or text is one space; a role without an initial s, u or a
can't be kept; rows go by turn (null first), ties by role and the text's digest;
repeated rows are rows of their own (all but the first duplicates); a null conv_id is a
conversation; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import rows_out, saved, small_batches

#: Costs of the edits (fixed by the contract), in the ASCII order of their letters.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
#: States: nothing yet, after s, after u, after a.  The state after an edit that
#: gives the due role, and after keeping each initial (none, s, u, a); -1: not allowed.
DUE = np.array([2, 2, 3, 2])
AFTER = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: Cost from each state at the end of a conversation, and the inserts that it takes.
END_COST, END_AUDIT = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
ROLES = {2: "user", 3: "assistant"}
FAR = 1 << 40
#: Rows and bytes of text of a block; rows that a task solves together.
BLOCK, BLOCK_BYTES, TOGETHER = 1024, 4 << 20, 1 << 15
#: A row's code: initial (0 to 3), + 4 truncated, + 8 must go; + 16 blank, + 32 duplicate.
CUT, GOES, BLANK, SEEN = 4, 8, 16, 32

SPACE = r"[\x20\x09-\x0D]"


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row,
    1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes it the user's."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    hit = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.when(hit == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                        F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).drop("_")


# ---- cost DP over blocks of codes ----

def _padded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks by descending length: their order, lengths and codes side by side."""
    size = np.fromiter(map(len, codes), np.int64, len(codes))
    order = np.argsort(-size, kind="stable")
    wide = np.zeros((len(codes), int(size.max(initial=0))), np.uint8)
    for i, k in enumerate(order):
        wide[i, :size[k]] = np.frombuffer(codes[k], np.uint8)
    return order, size[order], wide


def _step(code: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs (block, exits, 4 edits, state) of the edits in one row's layer from the costs
    after the row (block, exits, state), and the least of each node."""
    initial, extra = code & 3, np.where(code & CUT, TRUNCATED, 0)[:, None, None]
    stays = np.where(code & GOES, FAR, 0)[:, None, None]
    edits = np.full((*ahead.shape[:2], 4, 4), FAR, np.int64)
    edits[:, :, 0] = ahead + DELETE
    after = AFTER[:, initial].T                               # (block, state)
    kept = np.take_along_axis(ahead, np.maximum(after, 0)[:, None, :].repeat(ahead.shape[1], 1), 2)
    edits[:, :, 2] = np.where(after[:, None, :] < 0, FAR, kept) + KEEP + extra + stays
    edits[:, :, 3] = ahead[:, :, DUE] + REROLE + extra + stays
    bare = edits.min(2)
    # inserts lead to u or a in the same layer; more than one full turn never pays
    best = bare.copy()
    best[:, :, 2] = np.minimum(bare[:, :, 2], INSERT + bare[:, :, 3])
    best[:, :, 3] = np.minimum(bare[:, :, 3], INSERT + bare[:, :, 2])
    edits[:, :, 1] = INSERT + best[:, :, DUE]
    return edits, np.minimum(np.minimum(bare, edits[:, :, 1]), FAR)


def matrices(codes: list[bytes]) -> np.ndarray:
    """For each block the least cost (exit, entry) through it."""
    order, size, wide = _padded(codes)
    cost = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(codes), 4, 4)).copy()
    for t in range(wide.shape[1] - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))         # blocks longer than t
        cost[:live] = _step(wide[:live, t], cost[:live])[1]
    out = np.empty_like(cost)
    out[order] = cost
    return out


def audits(codes: list[bytes], ahead: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """For each block and entry state the least of the cheapest audits through it, and
    the exit state, given the costs ``ahead`` (block, state) from its end on."""
    order, size, wide = _padded(codes)
    first = np.concatenate([[0], np.cumsum((size + 1) * 4)])   # nodes: (row, state), and the exits
    n = int(first[-1])
    cost = ahead[order][:, None, :].copy()
    valid = np.zeros((n, 4), bool)                             # optimal arcs, by edit
    target = np.broadcast_to(np.arange(n)[:, None], (n, 4)).copy()
    states = np.arange(4)
    for t in range(wide.shape[1] - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        edits, best = _step(wide[:live, t], cost[:live])
        cost[:live] = best
        node = first[:live, None] + 4 * t + states             # (block, state)
        valid[node] = ((edits == best[:, :, None, :]) & (best < FAR)[:, :, None, :])[:, 0].transpose(0, 2, 1)
        below = first[:live, None] + 4 * (t + 1)
        after = np.maximum(AFTER[:, wide[:live, t] & 3].T, 0)
        target[node] = np.stack([below + states, first[:live, None] + 4 * t + DUE[None, :].repeat(live, 0), below + after, below + DUE[None, :].repeat(live, 0)], 2)
    arc_node, letter = np.nonzero(valid)                       # the arcs, by node
    jump = target[arc_node, letter]
    rank = letter + 1
    begin = np.searchsorted(arc_node, np.arange(n))
    ends = np.searchsorted(arc_node, np.arange(n), "right")
    inner = np.flatnonzero(ends > begin)

    def best_of(rank: np.ndarray) -> np.ndarray:
        """The arc of least rank at each inner node."""
        by = np.lexsort((rank, arc_node))
        return by[begin[inner]]

    pointers, steps = [], np.zeros(n, np.int64)
    steps[inner] = 1
    while True:
        best = best_of(rank)
        lead, node_rank = np.arange(n), np.zeros(n, np.int64)
        lead[inner], node_rank[inner] = jump[best], rank[best]
        pointers.append(lead)
        more = steps[lead]
        if not more.any():
            break
        # twice the length: the letters so far, then those from the node reached on
        rank = np.unique(rank * (node_rank.max() + 1) + node_rank[jump], return_inverse=True)[1] + 1
        jump, steps = lead[jump], steps + more
    chosen = np.full(n, -1, np.int64)
    chosen[inner] = letter[best]
    entry = (first[:-1, None] + states).ravel()
    length = steps[entry]
    upto = np.concatenate([[0], np.cumsum(length)])
    far = np.arange(upto[-1]) - np.repeat(upto[:-1], length)    # distance from the entry
    at = np.repeat(entry, length)
    for k, lead in enumerate(pointers):
        at = np.where(far >> k & 1, lead[at], at)
    text = np.frombuffer(LETTERS.encode(), np.uint8)[chosen[at]].tobytes().decode()
    ended = entry
    for k, lead in enumerate(pointers):
        ended = np.where(length >> k & 1, lead[ended], ended)
    exits = np.empty((len(codes), 4), np.int64)
    exits[order] = ((ended - first[:-1].repeat(4)) % 4).reshape(-1, 4)
    found: list[list[str]] = [[]] * len(codes)
    for i, k in enumerate(order):
        found[k] = [text[upto[4 * i + s]:upto[4 * i + s + 1]] for s in range(4)]
    return found, exits


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, int | None, str | None, str | None]]:
    """(edit, row or None, role, text) of each edit of an audit, from an entry state on;
    role and text are null for deleted rows."""
    row = 0
    for e in audit:
        if e == "I":
            state = int(DUE[state])
            yield e, None, ROLES[state], ""
            continue
        if e == "D":
            yield e, row, None, None
        else:
            state = int(DUE[state] if e == "R" else AFTER[state, initial_of(roles[row])])
            yield e, row, ROLES[state] if e == "R" else roles[row], texts[row]
        row += 1


def initial_of(role: str) -> int:
    return " sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 0


# ---- Spark ----

def _codes(text: Column, seen: Column) -> Column:
    """A row's code without its initial."""
    bare = F.regexp_replace(text, SPACE, "")
    blank = bare == ""
    cut = ~blank & ~seen & ~bare.rlike(r"[.!?]\z")
    return (F.when(blank, BLANK + GOES).when(seen, SEEN + GOES).otherwise(0) + F.when(cut, CUT).otherwise(0)).cast("int")


BLOCKS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.int64())),
                    ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def blocks(turns: DataFrame) -> DataFrame:
    """Conversations in order, cut into blocks: one row each with the codes of its rows
    and the costs through it."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("sha").alias("_s")).agg(F.min(place).alias("_first"))
    # a frequent row of one conversation is split by AQE: its side of firsts is one row
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("sha") == F.col("_s")))
    seen = ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    order = ["conv_id", "turn", "role", "sha"]
    rows = (rows.select(*order, "text", _codes(F.col("text"), seen).alias("code"), _codes(F.col("text"), F.lit(True)).alias("again"))
            .repartitionByRange(*order).sortWithinPartitions(*order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []           # finished blocks: (conv, codes, turns, roles, texts)
        conv, codes, turn_, role_, text_, size, last = None, bytearray(), [], [], [], 0, None

        def out() -> pa.RecordBatch:
            nonlocal held, made
            costs = matrices([h[1] for h in held]).reshape(-1, 16).tolist()
            batch = rows_out(BLOCKS, [h[0] for h in held], [part] * len(held), range(made, made + len(held)), [h[1] for h in held], costs,
                             *([h[i] for h in held] for i in (2, 3, 4)))
            made, held = made + len(held), []
            return batch

        waiting = 0
        for b in small_batches(batches, "text", BLOCK_BYTES):
            for c, t, r, s, text, code, again in zip(*(x.to_pylist() for x in b.columns)):
                if codes and (c != conv or len(codes) >= BLOCK or size >= BLOCK_BYTES):
                    held.append((conv, bytes(codes), turn_, role_, text_))
                    waiting += len(codes) + size // 256
                    codes, turn_, role_, text_, size = bytearray(), [], [], [], 0
                    if waiting >= TOGETHER:
                        yield out()
                        waiting = 0
                conv = c
                codes.append((again if last == (c, t, r, s) else code) + initial_of(r))
                last = (c, t, r, s)
                turn_.append(t)
                role_.append(r)
                text_.append(text)
                size += len(text)
        if codes:
            held.append((conv, bytes(codes), turn_, role_, text_))
        if held:
            yield out()

    return rows.mapInArrow(run, "conv_id bigint, part bigint, block bigint, codes binary, costs array<bigint>, turns array<bigint>, "
                                "roles array<string>, texts array<string>")


def _ahead(summary: DataFrame) -> DataFrame:
    """The costs from every block's end on, and the whole conversation's cost at its
    first block: each conversation's matrices stream through one task, last block first."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("ahead", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ahead = (), None
        for b in batches:
            rows = []
            for conv, part, block, costs in zip(*(c.to_pylist() for c in b.columns)):
                if (conv,) != now:
                    now, ahead = (conv,), np.array(END_COST, np.int64)
                rows.append((part, block, ahead.tolist()))
                ahead = np.minimum((np.array(costs).reshape(4, 4) + ahead[:, None]).min(0), FAR)
            if rows:
                yield rows_out(schema, *zip(*rows))

    return (summary.select("conv_id", "part", "block", "costs").repartition("conv_id")
            .sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
            .mapInArrow(run, "part bigint, block bigint, ahead array<bigint>"))


def _solved(summary: DataFrame) -> DataFrame:
    """Least audits and exits of every block for each entry state."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "codes", TOGETHER):
            found, exits = audits(b.column("codes").to_pylist(), np.array(b.column("ahead").to_pylist(), np.int64).reshape(-1, 4))
            yield rows_out(schema, *b.columns[:3], found, exits.tolist())

    return (summary.select("conv_id", "part", "block", "codes").join(_ahead(summary), ["part", "block"])
            .select("conv_id", "part", "block", "codes", "ahead")
            .mapInArrow(run, "conv_id bigint, part bigint, block bigint, audits array<string>, exits array<bigint>"))


def _selected(solved: DataFrame) -> DataFrame:
    """Every block's entry state and audit: exits are followed from each conversation's
    start.  The last block's audit has the inserts at the end; ``number`` counts blocks."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("number", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                      # the block before: (conv, part, block, number, state, audit, exit)
        for b in batches:
            rows = []
            for conv, part, block, found, exits in zip(*(c.to_pylist() for c in b.columns)):
                number, state = 0, 0
                if held is not None:
                    if held[0] == conv:
                        number, state = held[3] + 1, held[6]
                        rows.append(held[1:6])
                    else:
                        rows.append((*held[1:5], held[5] + END_AUDIT[held[6]]))
                held = (conv, part, block, number, state, found[state], exits[state])
            if rows:
                yield rows_out(schema, *zip(*rows))
        if held is not None:
            yield rows_out(schema, *zip((*held[1:5], held[5] + END_AUDIT[held[6]])))

    return (solved.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
            .mapInArrow(run, "part bigint, block bigint, number bigint, state int, audit string"))


def repaired_blocks(turns: DataFrame) -> DataFrame:
    """Every block of the conversations with its rows (``turns``, ``roles``, ``texts``,
    ``codes``), its number in its conversation, entry ``state`` and ``audit``."""
    cut = saved(blocks(turns))
    found = _selected(_solved(cut.drop("turns", "roles", "texts")))
    return cut.drop("costs").join(found, ["part", "block"]).drop("part", "block")


def repair(turns: DataFrame) -> DataFrame:
    """The edits of every conversation in order: ``conv_id``, ``number`` (of the block),
    ``place`` (of the edit there), ``edit`` (D, I, K or R), the row's ``turn`` and
    ``old_role`` (null for inserted ones) and the repaired ``role`` and ``text`` (null for deleted ones)."""
    schema = pa.schema([("conv_id", pa.int64()), ("number", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
                        ("old_role", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "texts"):
            for conv, number, state, audit, turn, roles, texts in zip(*(c.to_pylist() for c in b.columns)):
                rows = [(conv, number, k, e, *((None, None) if i is None else (turn[i], roles[i])), role, text)
                        for k, (e, i, role, text) in enumerate(edited(audit, state, roles, texts))]
                if rows:
                    yield rows_out(schema, *zip(*rows))

    return (repaired_blocks(turns).select("conv_id", "number", "state", "audit", "turns", "roles", "texts")
            .mapInArrow(run, "conv_id bigint, number bigint, place bigint, edit string, turn bigint, old_role string, role string, text string"))


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation: gaps in its turns, faults, illegal neighbours, cost,
    audit, and the digest of the repaired rows.  The digest is sequential: a
    conversation's blocks stream in order through one task, which holds one of them."""
    schema = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                        ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    legal = {(1, 2), (2, 3), (3, 2)}
    price = dict(zip(LETTERS, (DELETE, INSERT, KEEP, REROLE)))

    class Digest:
        def __init__(self, conv):
            self.conv, self.least, self.most, self.distinct = conv, None, None, 0
            self.faults, self.illegal, self.cost, self.audit = [0, 0, 0], 0, 0, []
            self.sha, self.lines, self.before = hashlib.sha256(), 0, None

        def add(self, codes, state, audit, turns, roles, texts) -> None:
            for t in turns:                                   # ascending, nulls first
                if t is not None and t != self.most:
                    self.least, self.most, self.distinct = t if self.least is None else self.least, t, self.distinct + 1
            for code in codes:
                for k, bit in enumerate((BLANK, SEEN, CUT)):
                    self.faults[k] += code & bit > 0
                if self.before is not None:
                    self.illegal += (self.before, code & 3) not in legal
                self.before = code & 3
            self.audit.append(audit)
            for e, row, role, text in edited(audit, state, roles, texts):
                self.cost += price[e] + (TRUNCATED if e in "KR" and codes[row] & CUT else 0)
                if role is not None:
                    self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                    self.lines += 1

        def row(self) -> tuple:
            gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
            return self.conv, gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in small_batches(batches, "texts"):
            for conv, _, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(conv)
                now.add(*rest)
            if done:
                yield rows_out(schema, *zip(*done))
                done = []
        if now is not None:
            yield rows_out(schema, *zip(now.row()))

    return (repaired_blocks(turns).select("conv_id", "number", "codes", "state", "audit", "turns", "roles", "texts")
            .repartition("conv_id").sortWithinPartitions("conv_id", "number")
            .mapInArrow(run, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                             "cost bigint, audit string, repaired_sha256 string"))
