"""Operator 6: exact deduplication with Patricia-trie owners.

Texts are equal when their normalised bytes are (ASCII white space deleted).
A compressed radix trie holds the full byte strings; the terminal node of each
keeps its owner: the row with the most code points, then the smallest id.
Tasks first build tries over the rows they read, so a text that a third of all
rows hold leaves each task once.  A trie beyond its byte budget hands its heaviest
subtree on (spill by subtree; Spark's shuffle holds and spills it).  The owners
then meet by (length, content hash) and are merged in a trie for each such
partition, read in sorted order, so a task holds one partition's texts at most.

Defined results: a null text counts as empty, and all texts of white space only
are equal; a null id loses ties to every id; rows with the same id and text are
one document and share its verdict; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import ASCII_SPACE, let_go, rows_out, small_batches

#: Bytes of labels that a task's trie may hold before it hands subtrees on.
TRIE_BYTES = 32 << 20
#: Rough bytes of a node besides its label.
NODE_BYTES = 200


class Owner:
    """What a terminal node keeps of the rows with its text."""
    __slots__ = ("chars", "id", "rows", "sha")

    def __init__(self, chars: int, id_: int | None, rows: int, sha: str):
        self.chars, self.id, self.rows, self.sha = chars, id_, rows, sha

    def merge(self, chars: int, id_: int | None, rows: int) -> None:
        self.rows += rows
        if chars > self.chars or chars == self.chars and (self.id is None or id_ is not None and id_ < self.id):
            self.chars, self.id = chars, id_


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, children: dict[int, Node], owner: Owner | None):
        self.label, self.children, self.owner = label, children, owner


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n                            # equal up to lo, different before hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Patricia:
    """A compressed radix trie from byte strings to owners."""

    def __init__(self):
        self.root, self.size = Node(b"", {}, None), 0

    def add(self, text: bytes, chars: int, id_: int | None, rows: int, sha: str | None = None) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                leaf = Node(text[at:], {}, None)
                node.children[text[at]] = leaf
                self.size += len(leaf.label) + NODE_BYTES
                node, at = leaf, len(text)
                break
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            same = common(child.label, text[at:at + len(child.label)])
            upper = Node(child.label[:same], {child.label[same]: child}, None)
            child.label = child.label[same:]
            node.children[text[at]] = upper
            self.size += NODE_BYTES
            node, at = upper, at + same
        if node.owner is None:
            node.owner = Owner(chars, id_, rows, sha or hashlib.sha256(text).hexdigest())
        else:
            node.owner.merge(chars, id_, rows)

    @staticmethod
    def walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Owner]]:
        """All texts at and below a node whose path is ``prefix``, with their owners."""
        todo = [(node, prefix)]
        while todo:
            node, path = todo.pop()
            if node.owner is not None:
                yield path, node.owner
            todo.extend((c, path + c.label) for c in node.children.values())

    def items(self) -> Iterator[tuple[bytes, Owner]]:
        return self.walk(self.root, b"")

    @staticmethod
    def weight(node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            n = todo.pop()
            total += len(n.label) + NODE_BYTES
            todo.extend(n.children.values())
        return total

    def spill(self, most: int) -> Iterator[tuple[bytes, Owner]]:
        """Hands on the heaviest subtrees below the root until ``most`` bytes are left."""
        by_weight = sorted(self.root.children, key=lambda c: -self.weight(self.root.children[c]))
        for c in by_weight:
            if self.size <= most:
                return
            child = self.root.children.pop(c)
            self.size -= self.weight(child)
            yield from self.walk(child, child.label)


def normalised(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes without ASCII white space (null: empty)."""
    spaces = ASCII_SPACE.encode()
    return [(t or b"").translate(None, spaces) for t in column.cast(pa.large_binary()).to_pylist()]


def code_points(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.utf8_length(column), 0).cast(pa.int64())


_OWNERS = pa.schema([("length", pa.int64()), ("content", pa.int64()), ("norm", pa.binary()), ("sha", pa.string()),
                     ("chars", pa.int64()), ("id", pa.int64()), ("rows", pa.int64())])
_OWNERS_SQL = "length bigint, content bigint, norm binary, sha string, chars bigint, id bigint, rows bigint"


def _emit(found: Iterator[tuple[bytes, Owner]]) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for text, o in found:
        content = int.from_bytes(bytes.fromhex(o.sha[:16]), "big", signed=True)
        part.append((len(text), content, text, o.sha, o.chars, o.id, o.rows))
        size += len(text)
        if size > 4 << 20 or len(part) >= 8192:
            yield rows_out(_OWNERS, *zip(*part))
            part, size = [], 0
    if part:
        yield rows_out(_OWNERS, *zip(*part))


def owners(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per different text: its digest ``sha``, the id that stays, the code
    points of that row's text and how many rows have the text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        trie = Patricia()
        for b in small_batches(batches, "text"):
            col = b.column("text")
            for t, c, i in zip(normalised(col), code_points(col).to_pylist(), b.column("id").to_pylist()):
                trie.add(t, c, i, 1)
            if trie.size > TRIE_BYTES:
                yield from _emit(trie.spill(TRIE_BYTES // 2))
        yield from _emit(trie.items())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie = None, Patricia()

        def finished() -> Iterator[tuple[str, int, int, int]]:
            return ((o.sha, o.id, o.chars, o.rows) for _, o in trie.items())

        done: list[tuple] = []
        for b in small_batches(batches, "norm"):
            for length, content, t, sha, c, i, n in zip(*(col.to_pylist() for col in b.columns)):
                if (length, content) != key:
                    done.extend(finished())
                    key, trie = (length, content), Patricia()
                trie.add(t, c, i, n, sha)
            if done:
                yield rows_out(out_schema, *zip(*done))
                done = []
        done.extend(finished())
        if done:
            yield rows_out(out_schema, *zip(*done))

    out_schema = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("keep_chars", pa.int64()), ("group_size", pa.int64())])
    return (rows.mapInArrow(local, _OWNERS_SQL).repartition("length", "content")
            .sortWithinPartitions("length", "content")
            .mapInArrow(merged, "sha string, keep_id bigint, keep_chars bigint, group_size bigint"))


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, code points and SHA-256 of the normalised text of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("chars", pa.int64()), ("text_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            col = b.column("text")
            yield rows_out(schema, b.column("doc_id"), code_points(col), [hashlib.sha256(t).hexdigest() for t in normalised(col)])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id bigint, chars bigint, text_sha256 string"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``keep_id``, ``group_size``, ``kept`` and the
    normalised text's SHA-256.  Full texts meet in the tries only; rows find
    their owner by the digest that names it."""
    own = owners(docs, id_col, text).withColumnRenamed("sha", "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return (digests(docs, id_col, text).join(own, "text_sha256")
            .select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each different text; of rows that share both id
    and text, one stays.  Only rows whose id owns some text are kept at all, so
    the last step sees no copies but those."""
    def key(doc_id, sha, chars):
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), sha, chars.cast("string"))

    own = owners(docs, id_col, text).select(key(F.col("keep_id"), F.col("sha"), F.col("keep_chars")).alias("_key"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    row_id, row_text = names[docs.columns.index(id_col)], F.coalesce(names[docs.columns.index(text)], F.lit(""))
    sha = F.sha2(F.regexp_replace(row_text, r"[\x20\x09-\x0D]+", "").cast("binary"), 256)
    rows = rows.withColumn("_key", key(F.col(row_id).cast("bigint"), sha, F.char_length(row_text)))
    # one plain key: rows are dealt and sorted by it once, for the join and for the copies
    return rows.join(own, "_key").dropDuplicates(["_key"]).select(*names).toDF(*docs.columns)
