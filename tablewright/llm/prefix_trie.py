"""Prefix trie of conversations by adaptive radix trees.

A turn's id is 16 bytes, the digest of its role and text read as a big-endian number; a conversation's key joins the
ids of its turns. Distinct keys (copies are one key with a count) are dealt into ranges, and each range builds an
adaptive radix tree: inner nodes grow through layouts of 4, 16, 48 and 256 children, and runs of single children are
kept as one compressed path. Only byte depths that are a multiple of an id's width are nodes of the trie.

Nodes that two neighbouring ranges share lie on the path that the last key of one and the first key of the next have
in common. A range counts what it owns (a node belongs to the first range that has it), so that all figures of a shared
node are sums over the ranges; only these few rows meet in an aggregate. A subtree is therefore never held by one task,
however common its first turns are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import full_text, written

#: Bytes of a turn's id.
WIDTH = 16
#: Keys of a range (one tree).
RANGE_KEYS = 10_000
#: Bytes of decimal ids packed in one row before they are hashed.
PACKED = 4096
#: The rebuilt conversations: turns taken from the first conversation of each hundred, fewer than this many.
HEADS = 6
HUNDRED = 100


# -- adaptive radix tree -----------------------------------------------------------------

class Small:
    """Up to `room` (4 or 16) children: their bytes in order and, beside them, the nodes."""

    __slots__ = ("room", "edges", "nodes")

    def __init__(self, room: int = 4) -> None:
        self.room, self.edges, self.nodes = room, bytearray(), []

    def get(self, edge: int):
        k = self.edges.find(edge)
        return self.nodes[k] if k >= 0 else None

    def add(self, edge: int, node):
        if len(self.edges) == self.room:
            return _grown(self, Small(16) if self.room == 4 else Indexed()).add(edge, node)
        k = bisect_left(self.edges, edge)
        self.edges.insert(k, edge)
        self.nodes.insert(k, node)
        return self

    def items(self):
        return list(zip(self.edges, self.nodes))


class Indexed:
    """Up to 48 children: a table from byte to place in a short list."""

    __slots__ = ("places", "nodes")

    def __init__(self) -> None:
        self.places, self.nodes = bytearray(b"\xff" * 256), []

    def get(self, edge: int):
        k = self.places[edge]
        return self.nodes[k] if k != 255 else None

    def add(self, edge: int, node):
        if len(self.nodes) == 48:
            return _grown(self, Direct()).add(edge, node)
        self.places[edge] = len(self.nodes)
        self.nodes.append(node)
        return self

    def items(self):
        return [(e, self.nodes[k]) for e, k in enumerate(self.places) if k != 255]


class Direct:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self) -> None:
        self.nodes = [None] * 256

    def get(self, edge: int):
        return self.nodes[edge]

    def add(self, edge: int, node):
        self.nodes[edge] = node
        return self

    def items(self):
        return [(e, n) for e, n in enumerate(self.nodes) if n is not None]


def _grown(old, new):
    for edge, node in old.items():
        new = new.add(edge, node)
    return new


class Node:
    """prefix: the bytes below the edge that all keys share; value: that of the key that ends here."""

    __slots__ = ("prefix", "value", "children")

    def __init__(self, prefix: bytes, value=None, children=None) -> None:
        self.prefix, self.value, self.children = prefix, value, children

    def add(self, edge: int, node: Node) -> None:
        self.children = (self.children or Small()).add(edge, node)


class RadixTree:
    """Keys of any length; a key may be the start of another."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                same = 0
                for x, y in zip(prefix, key[at:at + len(prefix)]):
                    if x != y:
                        break
                    same += 1
                lower = Node(prefix[same + 1:], node.value, node.children)
                node.prefix, node.value, node.children = prefix[:same], None, None
                node.add(prefix[same], lower)
            at += len(node.prefix)
            if at == len(key):
                node.value = value
                return
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                node.add(key[at], Node(key[at + 1:], value))
                return
            node, at = child, at + 1


# -- nodes of a range --------------------------------------------------------------------

class _Sums:
    """What a subtree adds up to: members, their smallest, leaves, saved tokens, owned top nodes, rows whose parent is
    not known yet, turn lengths of one member."""

    __slots__ = ("n", "first", "leaves", "saved", "tops", "waiting", "lengths")

    def __init__(self) -> None:
        self.n, self.first, self.leaves, self.saved, self.tops = 0, None, 0, 0, 0
        self.waiting, self.lengths = [], ()

    def take(self, n: int, first: int, lengths) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)
        self.lengths = lengths

    def join(self, below: _Sums) -> None:
        self.take(below.n, below.first, below.lengths)
        self.leaves += below.leaves
        self.saved += below.saved
        self.tops += below.tops
        self.waiting += below.waiting


class _Frame:
    """A node on the way down: its turn-aligned depths with their hashes, and what is left to visit."""

    __slots__ = ("node", "left", "right", "depth", "chain", "tail", "aligned", "todo", "sums")

    def __init__(self, node: Node, segment: bytes, above: _Frame | None, left: bool, right: bool) -> None:
        self.node, self.left, self.right = node, left, right
        self.depth, self.chain, self.tail = (above.depth, above.chain, above.tail) if above else (0, b"", b"")
        self.aligned = [] if above else [(0, b"", None)]
        bits = self.tail + segment
        whole = len(bits) - len(bits) % WIDTH
        for k in range(0, whole, WIDTH):
            parent = self.chain
            self.chain, self.depth = hashlib.md5(parent + bits[k:k + WIDTH]).digest(), self.depth + 1
            self.aligned.append((self.depth, self.chain, parent))
        self.tail = bits[whole:]
        children = node.children.items() if node.children else []
        last = len(children) - 1
        self.todo = [(edge, child, left and node.value is None and k == 0, right and k == last)
                     for k, (edge, child) in reversed(list(enumerate(children)))]
        self.sums = _Sums()


def trie_nodes(tree: RadixTree, before: int, after: int, extended: bool) -> list[list]:
    """Rows of the tree's turn-aligned depths.

    before / after: turns that the first / last key shares with the range before / after, -1 where there is none;
    extended: the last key begins a key of the next range. Values are (n, smallest conversation, lengths, digest of
    the key). A row: node, parent, depth, n, first, children, leaves, saved, digest of its own key, shared, the
    parent's smallest conversation (None while the parent is shared).
    """
    rows: list[list] = []
    stack = [_Frame(tree.root, b"", None, True, True)]
    while stack:
        frame = stack[-1]
        if frame.todo:
            edge, child, left, right = frame.todo.pop()
            stack.append(_Frame(child, bytes([edge]) + child.prefix, frame, left, right))
            continue
        stack.pop()
        sums, value = frame.sums, frame.node.value
        own = None
        if value is not None:
            n, first, lengths, own = value
            sums.take(n, first, lengths)
            if frame.node.children is None and not (frame.right and extended):
                sums.leaves += 1
        for depth, chain, parent in reversed(frame.aligned):
            owned = not (frame.left and depth <= before)
            shared = not owned or (frame.right and depth <= after)
            length = sums.lengths[depth - 1] if depth else 0
            sums.saved += (sums.n - owned) * length
            for k in sums.waiting:
                rows[k][10] = None if shared else sums.first
            rows.append([chain, parent, depth, sums.n, sums.first, sums.tops, sums.leaves, sums.saved, own, shared, None])
            sums.waiting, sums.tops, own = [len(rows) - 1], int(owned), None
        if stack:
            stack[-1].sums.join(sums)
    return rows


ROW = ("node binary, parent binary, depth long, n_convs long, conv_id long, n_children long, n_leaves long, "
       "saved_tokens long, own binary, shared boolean, parent_conv_id long")
_ROW = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n_convs", pa.int64()),
                  ("conv_id", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                  ("saved_tokens", pa.int64()), ("own", pa.binary()), ("shared", pa.bool_()),
                  ("parent_conv_id", pa.int64())])


def _build(bounds: dict[int, tuple[int, int, bool]]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now = RadixTree(), None

        def close() -> Iterator[pa.RecordBatch]:
            rows = trie_nodes(tree, *bounds[now]) if now is not None else []
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*rows[k:k + 10_000]), _ROW)], schema=_ROW)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("range", "path", "lengths", "n", "first")]
            for part, path, lengths, n, first in zip(*columns):
                if part != now:
                    yield from close()
                    tree, now = RadixTree(), part
                tree.insert(path, (n, first, lengths, hashlib.md5(path).digest()))
        yield from close()
    return build


def _same_turns(a: bytes, b: bytes) -> int:
    k = 0
    while a[k:k + WIDTH] == b[k:k + WIDTH] and k < min(len(a), len(b)):
        k += WIDTH
    return k // WIDTH


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range in order: turns shared with the one before, and whether its first key goes on the last one's."""
    parts, shared, goes_on, last = [], [], [], None
    for batch in batches:
        for part, low, high in zip(*[batch.column(c).to_pylist() for c in ("range", "low", "high")]):
            parts.append(part)
            shared.append(-1 if last is None else _same_turns(last, low))
            goes_on.append(last is not None and low.startswith(last))
            last = high
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(shared, pa.int64()),
                                      pa.array(goes_on, pa.bool_())], names=["range", "shared", "goes_on"])


def _ranges(keys: DataFrame, range_keys: int, folder: str | None) -> tuple[DataFrame, dict[int, tuple[int, int, bool]]]:
    """Distinct keys dealt into ranges in their order, and each range's (before, after, extended)."""
    n = max(1, -(-keys.count() // range_keys))
    dealt = written(keys.repartitionByRange(n, "path").withColumn("range", F.spark_partition_id()), folder)
    ends = dealt.groupBy("range").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    # one row a range
    rows = (ends.coalesce(1).sortWithinPartitions("range")
            .mapInArrow(_edges, "range int, shared long, goes_on boolean").collect())
    after = [*[(r.shared, r.goes_on) for r in rows[1:]], (-1, False)]
    return dealt, {r.range: (r.shared, *a) for r, a in zip(rows, after)}


# -- digests of ids ----------------------------------------------------------------------

def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a key, in order, as packed decimals."""
    schema = pa.schema([("own", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    now, ids, size, out = None, [], 0, []
    for batch in batches:
        for own, conv in zip(batch.column("own").to_pylist(), batch.column("conv_id").to_pylist()):
            if own != now or size >= PACKED:
                if ids:
                    out.append((now, ids[0], ",".join(map(str, ids)).encode()))
                now, ids, size = own, [], 0
            ids.append(conv)
            size += 1 + len(str(conv))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
    if ids:
        last = [(now, ids[0], ",".join(map(str, ids)).encode())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), schema)], schema=schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's packed ids, one after the other."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(owns, pa.binary()), pa.array(digests, pa.string())],
                                          names=["end", "ends_sha256"])

    owns, digests = [], []
    for batch in batches:
        for own, ids in zip(batch.column("own").to_pylist(), batch.column("ids").to_pylist()):
            if own == now:
                state.update(b",")
            else:
                if state:
                    owns.append(now)
                    digests.append(state.hexdigest())
                now, state = own, hashlib.sha256()
            state.update(ids)
        if owns:
            yield row()
            owns, digests = [], []
    if state:
        owns.append(now)
        digests.append(state.hexdigest())
        yield row()


def end_digests(paths: DataFrame) -> DataFrame:
    """(end, ends_sha256) of each key: the ids that end there, ascending, joined by commas.

    Ids are sorted in ranges and packed, so that the one task that must hash a common key's ids in a row gets few rows.
    """
    each = paths.select(F.unhex(F.md5("path")).alias("own"), "conv_id")
    packed = (each.repartitionByRange("own", "conv_id").sortWithinPartitions("own", "conv_id")
              .mapInArrow(_pack, "own binary, first long, ids binary"))
    return (packed.repartition("own").sortWithinPartitions("own", "first")
            .mapInArrow(_digest, "end binary, ends_sha256 string"))


# -- conversations -----------------------------------------------------------------------

def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, turns): id and length (code points) of each turn in order; NULL turns first, ties by id."""
    said, who = full_text(F.col(text)), full_text(F.col(role))
    digest = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said)))
    each = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), digest.alias("id"), F.length(said).alias("length")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["length"].alias("length")))
    return each.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the hundred's first conversation, then the own ones after h."""
    heads = (conversations.filter(F.col("conv_id") % HUNDRED == 0)
             .select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = (conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
              .withColumn("h", h).join(heads, "base", "left"))
    none = F.slice("turns", 1, F.lit(0))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), none)
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _path(turns: Column) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["id"])), ""))


def trie(conversations: DataFrame, range_keys: int = RANGE_KEYS, folder: str | None = None) -> DataFrame:
    """Nodes of the prefix trie of (conv_id long, turns), one row each; the root has depth 0.

    conv_id: smallest member; parent_conv_id: the parent's; n_convs: members; n_children; n_leaves: childless nodes of
    the subtree, the node included; saved_tokens: sum over the subtree of (n_convs - 1) x length of the last turn;
    ends_sha256: digest of the ids that end here.
    """
    paths = written(conversations.select("conv_id", _path(F.col("turns")).alias("path"),
                                         F.transform("turns", lambda t: t["length"]).alias("lengths")), folder)
    keys = written(paths.groupBy("path", "lengths").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")),
                   folder)
    dealt, bounds = _ranges(keys, range_keys, folder)
    rows = written(dealt.repartition("range").sortWithinPartitions("range", "path").mapInArrow(_build(bounds), ROW), folder)
    shared = written(rows.filter("shared").groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("own").alias("own"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]), folder)
    columns = ["parent", "depth", "own", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    known = rows.filter(~F.col("shared") & F.col("parent_conv_id").isNotNull())
    orphans = (rows.filter(~F.col("shared") & F.col("parent_conv_id").isNull()).select(*columns)
               .union(shared.select(*columns)))
    parents = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = known.select(*columns, "parent_conv_id").union(
        orphans.join(parents, "parent", "left").select(*columns, "parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = nodes.filter(F.col("own").isNotNull()).join(end_digests(paths), F.col("own") == F.col("end"))
    return ended.select(*out, "ends_sha256").union(
        nodes.filter(F.col("own").isNull()).select(*out, F.sha2(F.lit(""), 256)))


def conversation_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", range_keys: int = RANGE_KEYS, folder: str | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns.

    Turns are ordered by their number, NULL first, rows of one number by the digest of role and text; repeated rows are
    turns of their own. NULL role or text is empty. Rows without a conv_id belong to no conversation and are left out.
    An empty table gives no rows, other columns are left out. Texts of any length are digested, not held; a
    conversation's key (20 bytes a turn) is held by one task, like a text.
    """
    return trie(rebuilt(ordered_turns(rows, conv_col, turn_col, role_col, text_col)), range_keys, folder)
