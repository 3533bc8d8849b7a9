"""Merkle dataset manifest (13): a root over all rows, a witness for each row, and appends that extend both.

A row's leaf is a digest of its fields. Leaves of a tree (one language) ascend by key; every two consecutive
nodes become one, an odd last node becomes the digest of itself alone, until one node, the subroot, is left.
Subroots in order of their trees' names give the root in the same way.

Witnesses are incremental. Leaves are appended left to right; finished subtrees of different heights stay
open, and all leaves below one hold a partial witness. When the sibling of an open subtree is complete, both
halves get the other's root as their next step, and the two are one open subtree. Appends are aligned: a
block is 2^BLOCK_BITS leaves from a multiple of that number on, so blocks never share a subtree and are grown
by different tasks. Their roots are appended in turn as leaves of the blocks above, until a tree has one node.
A full block's steps never change again: `extend` regrows only the last, open block of a tree, appends the new
rows to it and goes on with the block roots.

What moves is keys and digests, never texts. Rows are placed by range of (tree, key, leaf), so a tree with a
third of all rows, or one key on all of them, fills many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import join_small, prepared
from martloom.workspace import Saved, Workspace

#: Leaves of a block, as a power of two.
BLOCK_BITS = 10
#: A table of witnesses is broadcast only if a count finds no more rows than this; a row has some hundred bytes.
BROADCAST_WITNESSES = 50_000
#: A step of a witness: on which side the sibling stands, and its digest. A lone node has none.
ALONE, LEFT, RIGHT = 0, 1, 2
STEP = 33

#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# monotonically_increasing_id() holds the partition above this bit, the position below.
_POSITION_BITS = 33


def digest(*nodes: bytes) -> bytes:
    """H of nodes: SHA-256 over their hex texts."""
    return hashlib.sha256("".join([n.hex() for n in nodes]).encode()).digest()


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for at in range(0, len(witness), STEP):
        side, sibling = witness[at], witness[at + 1 : at + STEP]
        leaf = digest(leaf) if side == ALONE else digest(sibling, leaf) if side == LEFT else digest(leaf, sibling)
    return leaf


def siblings(witness: bytes) -> list[bytes]:
    """The siblings of a witness, level by level."""
    return [witness[at + 1 : at + STEP] for at in range(0, len(witness), STEP) if witness[at] != ALONE]


class OpenSubtrees:
    """Nodes appended from the left, with the witness of each inside what was appended so far."""

    def __init__(self, nodes: int, height: int):
        self.steps = np.zeros((nodes, height, STEP), np.uint8)
        self.height, self.size = height, 0
        self._open: list[tuple[int, int, bytes]] = []

    def _joined(self, level: int, start: int, node: bytes) -> tuple[int, int, bytes]:
        """Joins a finished subtree with the open one of its height before it: both get a step."""
        _, left_start, left = self._open.pop()
        self.steps[left_start:start, level] = np.frombuffer(bytes([RIGHT]) + node, np.uint8)
        self.steps[start : self.size, level] = np.frombuffer(bytes([LEFT]) + left, np.uint8)
        return level + 1, left_start, digest(left, node)

    def append(self, node: bytes) -> None:
        level, start = 0, self.size
        self.size += 1
        while self._open and self._open[-1][0] == level:
            level, start, node = self._joined(level, start, node)
        self._open.append((level, start, node))

    def close(self) -> bytes:
        """The root, at the height given; lone nodes of the right edge rise by themselves."""
        level, start, node = self._open.pop()
        while level < self.height:
            if self._open and self._open[-1][0] == level:
                level, start, node = self._joined(level, start, node)
            else:
                level, node = level + 1, digest(node)
        return node


def leaf_hash(fields: Sequence[Column]) -> Column:
    """The leaf of a row as 32 bytes: each field `-` if null, else its bytes in UTF-8 with their count before."""
    text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _tree_name(column: Column) -> Column:
    """Null first, then by the bytes of the name."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _before(ws: Workspace, placed: DataFrame) -> Saved:
    """One row per task and tree: the number of rows of the tree in earlier tasks, and its size."""
    per_run = placed.groupBy(F.shiftright("at", _POSITION_BITS).alias("part"), "tree").agg(
        F.count(F.lit(1)).alias("rows"), F.min("at").alias("first")
    )
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    size = F.sum("rows").over(Window.partitionBy("tree")).alias("size")
    return ws.save(per_run.select("part", "tree", "first", before, size), "tree-runs")


def _numbered(ws: Workspace, nodes: DataFrame) -> DataFrame:
    """Nodes (tree, key, node, ...) with `pos`, their number in the tree from 0 by (key, node), and the tree's `size`.

    Rows that are equal in all three are interchangeable; their number in the input spreads them over ranges.
    """
    spread = ws.save(nodes.withColumn("spread", F.monotonically_increasing_id()), "leaves").df
    order = ["tree", "key", "node"]
    placed = spread.repartitionByRange(*order, "spread").sortWithinPartitions(*order).drop("spread")
    placed = ws.save(placed.withColumn("at", F.monotonically_increasing_id()), "placed").df
    runs = _before(ws, placed)
    rows = placed.withColumn("part", F.shiftright("at", _POSITION_BITS))
    joined = join_small(rows, runs.df, runs.rows, ["part", "tree"])
    return joined.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def _height(size: int, bits: int) -> int:
    """Of a block: that of its tree, if the tree is no more than one block."""
    return bits if size > 1 << bits else (size - 1).bit_length()


def _grow(bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        subtrees = OpenSubtrees(len(block), _height(block.column("size")[0].as_py(), bits))
        for node in block.column("node").to_pylist():
            subtrees.append(node)
        root = subtrees.close()
        width = subtrees.height * STEP
        ends = pa.array(np.arange(len(block) + 1, dtype=np.int32) * width).buffers()[1]
        witness = pa.Array.from_buffers(pa.binary(), len(block), [None, ends, pa.py_buffer(subtrees.steps.tobytes())])
        roots = pa.array([root] + [None] * (len(block) - 1), pa.binary())
        return block.append_column("witness", witness).append_column("block_root", roots)

    return run


def _grown(nodes: DataFrame, bits: int) -> DataFrame:
    """Adds `witness`, inside the node's block, and `block_root` at the first node of each block."""
    schema = nodes.withColumn("witness", F.lit(None).cast("binary")).withColumn("block_root", F.lit(None).cast("binary")).schema
    return nodes.groupBy("tree", F.shiftright("pos", bits)).applyInArrow(_grow(bits), schema)


def _above(ws: Workspace, blocks: DataFrame, bits: int) -> tuple[DataFrame, Saved]:
    """From grown nodes: (tree, pos, witness above the block) by number of block, and (tree, size, root)."""
    levels: list[DataFrame] = []
    nodes = blocks
    while True:
        size = F.ceil(F.col("size") / F.lit(1 << bits)).cast("long").alias("size")
        up = nodes.where("block_root IS NOT NULL").select("tree", F.shiftright("pos", bits).alias("pos"), size, F.col("block_root").alias("node"))
        if not (up.agg(F.max("size")).first()[0] or 0) > 1:
            break
        nodes = ws.save(_grown(up, bits), "block-roots").df
        levels.append(nodes)
    roots = up.select("tree", F.col("node").alias("root"))
    upper = up.select("tree", "pos", F.lit(b"").alias("witness"))
    for level in reversed(levels):
        upper = _with_upper(ws, level, ws.save(upper, "upper"), bits).select("tree", "pos", "witness")
    return upper, ws.save(roots, "roots")


def _with_upper(ws: Workspace, nodes: DataFrame, upper: Saved, bits: int) -> DataFrame:
    """Nodes with their block's witness continued by that of the block's root."""
    above = upper.df.select("tree", F.col("pos").alias("block"), F.col("witness").alias("upper"))
    joined = join_small(nodes.withColumn("block", F.shiftright("pos", bits)), above, upper.rows, ["tree", "block"], most=BROADCAST_WITNESSES)
    return joined.withColumn("witness", F.concat("witness", "upper")).drop("upper", "block")


@dataclass(frozen=True)
class Manifest:
    """rows: tree, key, node (the leaf), pos, size, witness inside the row's block, block_root at the first row of
    a block, and the columns carried. trees: tree, subroot, witness of the subroot. root: of all, None without rows."""

    workspace: Workspace
    rows: DataFrame
    upper: Saved
    trees: Saved
    root: bytes | None
    bits: int
    carried: tuple[str, ...]

    def witnessed(self) -> DataFrame:
        """tree, key, node, the columns carried, subroot and the whole witness, from leaf to root."""
        rows = _with_upper(self.workspace, self.rows, self.upper, self.bits)
        top = self.trees.df.select("tree", "subroot", F.col("witness").alias("top"))
        joined = join_small(rows, top, self.trees.rows, "tree", most=BROADCAST_WITNESSES)
        return joined.select("tree", "key", "node", *self.carried, "subroot", F.concat("witness", "top").alias("witness"))


def _finished(ws: Workspace, rows: DataFrame, bits: int, carried: tuple[str, ...]) -> Manifest:
    upper, subroots = _above(ws, rows, bits)
    # one tree over the subroots; their names are the keys
    top = _numbered(ws, subroots.df.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("node")))
    top = ws.save(_grown(top, bits), "top").df
    over, root = _above(ws, top, bits)
    trees = _with_upper(ws, top, ws.save(over, "over"), bits)
    trees = ws.save(trees.select(F.col("key").alias("tree"), F.col("node").alias("subroot"), "witness"), "trees")
    found = root.df.first()  # one row at most
    return Manifest(ws, rows, ws.save(upper, "upper"), trees, bytes(found.root) if found else None, bits, carried)


def _leaves(docs: DataFrame, key_col: str, tree_col: str, fields: Sequence[str], carry: dict[str, Column]) -> DataFrame:
    own = leaf_hash([docs[f] for f in fields]).alias("node")
    more = [c.alias(name) for name, c in carry.items()]
    return docs.select(_tree_name(docs[tree_col]).alias("tree"), docs[key_col].alias("key"), own, *more)


def merkle_manifest(
    docs: DataFrame,
    key_col: str = "doc_id",
    tree_col: str = "lang",
    fields: Sequence[str] = FIELDS,
    carry: dict[str, Column] | None = None,
    bits: int = BLOCK_BITS,
) -> Manifest:
    """The manifest of all rows. `carry` names columns computed from `docs` that stay with each row.

    Any field may be null; a null is told apart from an empty text. Rows without a tree are a tree of their own,
    the first; rows without a key come first in their tree, and rows with equal keys follow in order of their leaves,
    so the root does not depend on the order of the input. Repeated rows are leaves of their own. An empty table
    has no root and no rows. Columns that are no field are not looked at, whatever their names.
    """
    ws = prepared(docs.sparkSession)
    carry = carry or {}
    nodes = _numbered(ws, _leaves(docs, key_col, tree_col, fields, carry))
    return _finished(ws, ws.save(_grown(nodes, bits), "grown").df, bits, tuple(carry))


def extend(
    manifest: Manifest,
    docs: DataFrame,
    key_col: str = "doc_id",
    tree_col: str = "lang",
    fields: Sequence[str] = FIELDS,
    carry: dict[str, Column] | None = None,
) -> Manifest:
    """The manifest after an append: the same as one of all rows, without growing full blocks again.

    Keys must follow the last key of their tree: a row that would stand before an earlier one is refused by name.
    """
    ws, bits, carry = manifest.workspace, manifest.bits, carry or {}
    if tuple(carry) != manifest.carried:
        raise ValueError(f"carried are {manifest.carried}, not {tuple(carry)}")
    old = ws.save(manifest.rows.groupBy("tree").agg(F.max("size").alias("old"), F.max("key").alias("last")), "sizes")
    new = ws.save(_numbered(ws, _leaves(docs, key_col, tree_col, fields, carry)), "new")
    met = join_small(new.df, old.df, old.rows, "tree", "left")
    late = met.where("old IS NOT NULL AND (key IS NULL OR key <= last)").select("tree", "key").first()
    if late:
        raise ValueError(f"not an append: {tuple(late)} does not follow the keys that are there")
    grown = ws.save(met.groupBy("tree").agg((F.coalesce(F.first("old"), F.lit(0)) + F.first("size")).alias("now")), "grown-trees")
    columns = [c for c in manifest.rows.columns if c not in ("witness", "block_root")]
    rest = join_small(manifest.rows, grown.df, grown.rows, "tree", "left").withColumn("size", F.coalesce("now", "size"))
    is_open = F.col("now").isNotNull() & (F.shiftleft(F.shiftright("pos", bits) + 1, bits) > F.col("old"))
    rest = join_small(rest, old.df.select("tree", "old"), old.rows, "tree").withColumn("is_open", is_open)
    rest = ws.save(rest.select(*manifest.rows.columns, "is_open"), "before").df
    added = join_small(met, grown.df, grown.rows, "tree").withColumn("pos", F.coalesce("old", F.lit(0)) + F.col("pos"))
    added = added.withColumn("size", F.col("now")).select(*columns)
    regrown = _grown(rest.where("is_open").select(*columns).union(added), bits)
    rows = rest.where("NOT is_open").drop("is_open").union(regrown.select(*manifest.rows.columns))
    return _finished(ws, ws.save(rows, "grown").df, bits, manifest.carried)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        witnesses = batch.column("witness").to_pylist()
        leaves, claims = (batch.column(c).to_pylist() for c in ("node", "claim"))
        proofs = [hashlib.sha256("".join([s.hex() for s in siblings(w)]).encode()).hexdigest() for w in witnesses]
        folded = [fold(claim or leaf, w).hex() for leaf, claim, w in zip(leaves, claims, witnesses, strict=True)]
        columns = [batch.column("key"), batch.column("node"), batch.column("subroot"), pa.array(proofs, pa.string()), pa.array(folded, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "subroot", "proof_sha256", "folded_root"])


def verify(manifest: Manifest) -> DataFrame:
    """Folds each row's claimed leaf, the carried column `claim`, or else its leaf, with the witness of the manifest.

    key, leaf, subroot, root, proof_sha256 (of the siblings in order), folded_root, verified: whether that is the root.
    """
    kind = manifest.rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, node binary, subroot binary, proof_sha256 string, folded_root string"
    rows = manifest.witnessed()
    if "claim" not in manifest.carried:
        rows = rows.withColumn("claim", F.lit(None).cast("binary"))
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    return (
        rows.select("key", "node", "claim", "subroot", "witness")
        .mapInArrow(_check, schema)
        .select(
            "key",
            F.lower(F.hex("node")).alias("leaf"),
            F.lower(F.hex("subroot")).alias("subroot"),
            root.alias("root"),
            "proof_sha256",
            "folded_root",
            (F.col("folded_root") == root).alias("verified"),
        )
    )
