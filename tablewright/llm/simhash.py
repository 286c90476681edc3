"""SimHash near-duplicates: fingerprints, BK-trees over shards, connected components.

Equal fingerprints are one node. With at most 4 differing bits, two fingerprints agree on at least b - 4 of b bit
bands, so each choice of b - 4 bands is a shard key and no link is lost; b grows with the number of fingerprints.
Each shard is a BK-tree: children are keyed by their Hamming distance to the parent, and a search follows only edges
within the radius. A shard with too many fingerprints is cut into blocks and each pair of blocks searched apart.
Shard trees reach their searches by a shuffle and not by broadcast, as their size grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import full_text, written
from tablewright.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
BITS = 64
#: Most fingerprints searched in one tree; larger shards are cut into blocks.
SHARD_ROWS = 4096
#: Expected fingerprints of a shard, from which more bands are used.
SHARD_MEAN = 256


# -- fingerprints ------------------------------------------------------------------------

def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's lower-cased (A-Z) word shingles, repeats included; 0 without words."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = min(shingle, len(tokens))
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(tokens) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))],
                                         names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as long) for each row; NULL text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


# -- BK-tree -----------------------------------------------------------------------------

class BKTree:
    """Integers by Hamming distance; a node is [value, children by distance]."""

    def __init__(self, values=()) -> None:
        self.root = None
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Every value of the tree at most `radius` bits away."""
        stack = [self.root] if self.root is not None else []
        while stack:
            other, children = stack.pop()
            distance = (other ^ value).bit_count()
            if distance <= radius:
                yield other
            for edge, child in children.items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)


def _root(parents: dict[int, int], x: int) -> int:
    while parents.setdefault(x, x) != x:
        parents[x] = parents[parents[x]]
        x = parents[x]
    return x


def _search(first: list[int], second: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """A forest of the links inside `first` (second None), or between both: no pair that the forest implies."""
    parents: dict[int, int] = {}
    tree = BKTree(first if second is not None else ())
    for value in first if second is None else second:
        for other in tree.within(value, radius):
            a, b = _root(parents, value), _root(parents, other)
            if a != b:
                parents[a] = b
                yield value, other
        if second is None:
            tree.add(value)


def _links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, found = None, ([], []), []

        def close() -> None:
            first, second = members
            if key is not None and (key[1] == key[2] and len(first) > 1 or first and second):
                found.extend(_search(first, second if key[1] != key[2] else None, radius))

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("shard", "i", "j", "block", "fp")]
            for shard, i, j, block, fp in zip(*columns):
                if (shard, i, j) != key:
                    close()
                    key, members = (shard, i, j), ([], [])
                members[0 if block == i else 1].append(fp & 0xFFFFFFFFFFFFFFFF)
            if found:
                yield _pairs(found, schema)
                found.clear()
        close()
        if found:
            yield _pairs(found, schema)
    return find


def _pairs(found: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    values = np.array(found, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1])], schema=schema)


# -- shards ------------------------------------------------------------------------------

def bands_for(n: int, radius: int = RADIUS, mean: int = SHARD_MEAN) -> int:
    """Number of bit bands: the fewest that keep the expected shard at `mean` fingerprints."""
    bands = radius + 1
    while n >> (BITS * (bands - radius) // bands) > mean and bands < 2 * radius + 2:
        bands += 1
    return bands


def _keys(fp: Column, bands: int, radius: int) -> Column:
    """Shard keys of a fingerprint: a hash of each choice of bands - radius bands with the choice's number."""
    edges = [BITS * k // bands for k in range(bands + 1)]
    cut = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(n), *[cut[k] for k in choice])
                     for n, choice in enumerate(combinations(range(bands), bands - radius))])


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, mean: int = SHARD_MEAN) -> DataFrame:
    """Links (a, b) that span every component of the distinct fingerprints `nodes` (fp) at the radius."""
    bands = bands_for(nodes.count(), radius, mean)
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"), bands, radius)).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    blocks = sizes.select("shard", F.ceil(F.col("rows") / shard_rows).cast("int").alias("n"))
    placed = keyed.join(blocks, "shard").withColumn(
        "block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    return (pairs.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
            .mapInArrow(_links(radius), "a long, b long"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                   shard_rows: int = SHARD_ROWS, mean: int = SHARD_MEAN, folder: str | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable by links of at most `radius` bits. NULL and empty texts have
    fingerprint zero and are linked like any other. A row with a NULL id takes part; its component's id is the
    smallest id that is not NULL (NULL if there is none). Rows that repeat an id are fingerprinted one by one. An
    empty table gives no rows; other columns are left out.
    """
    prints = written(fingerprints(docs, id_col, text_col), folder)
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), folder)
    roots = components(links(nodes.select("fp"), radius, shard_rows, mean), folder)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        nodes["fp"], "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
