"""Jaccard self-join of documents on word n-grams, by token-combination prefixes.

Tokens are hashes of shingles. They have a global order, rare classes first; a set's prefix is the shortest start that a
linked set cannot miss: with at most t tokens outside the other set, a prefix whose classes add up to t + 1, where c
tokens of a class indexed by k-token combinations add c - k + 1. So the prefix is extended where frequent tokens stand in
it, and two linked sets share a single rare token or a combination of k frequent ones of one class. Frequent classes are
cut into subclasses by hash (more for longer sets), which keeps the combinations of a set few.

A token that one set alone holds is outside every other set, so a set with more than t of them has no link. First this
is judged on a share of all tokens, chosen by hash and counted exactly, then on all tokens of the sets left, in rounds.
The last round's counts give the classes of tokens, sent as bits of bounded size; a token that the bits take for more
frequent by chance is so for every task, which changes no result.

Equal sets are one class. Sets that share a signature are first compared with one leader per signature, in rounds with
other leaders; a large group of near copies becomes one component without making all its pairs. Of what is then still
apart, blocks of a signature's sets are searched inside tasks, and only pairs come out that neither the tokens held
alone nor the counts of tokens in a few cells rule out. Pairs are verified on the texts in tiles, so that a text is sent
once for a tile and not for each of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bits import bits_of, has
from tablewright.llm.common import full_text, match, written
from tablewright.llm.components import components
from tablewright.llm.spans import Powers, mix, spans, window_hashes, word_hashes

SHINGLE = 3
PERCENT = 90
#: Sets that hold a token, from which it is shared, indexed by pairs, and by triples.
CLASSES = (2, 16, 256)
#: Share of the tokens that are counted over all sets.
SHARE = 0.2
#: Rounds of counting all tokens of the sets left.
COUNT_ROUNDS = 2
#: Expected prefix tokens of a subclass grow with this share of a band's sizes (by k).
SUBCLASS = {2: 64, 3: 32}
#: Rounds of comparing with leaders before the rest is compared in blocks.
STARS = 3
#: Tokens of a tile in which pairs are verified, and sets of a block of what the rounds leave.
TILE_TOKENS = 1_000_000
BLOCK_SETS = 1_024
#: Cells that a set's tokens are counted in; counts end at 255, which only lets more pairs through.
CELLS = 256
#: Keys of sets that a task remembers in order to pass over further copies, and texts whose tokens it holds at once.
SEEN = 300_000
HELD = 1_000


# -- sets and signatures -----------------------------------------------------------------

def tokens(text: str, powers: Powers, size: int = SHINGLE) -> np.ndarray:
    """Hashes (uint64, ascending) of the distinct shingles of a text; of the whole sequence where words are fewer."""
    data = np.frombuffer(text.encode().lower(), dtype=np.uint8)  # of bytes, lower() changes A-Z only
    starts, ends = spans(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(window_hashes(word_hashes(data, starts, ends, powers, 0), min(size, len(starts)), powers, 0))


def missing(n: int, percent: int = PERCENT) -> int:
    """Most tokens of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def bands(n: int, percent: int = PERCENT) -> range:
    """Powers of two around the sizes of the sets that a set of n can be linked with (two at most)."""
    return range((-(-percent * n // 100)).bit_length() - 1, (100 * n // percent).bit_length())


def largest_k(band: int) -> int:
    """Small sets have too few tokens for larger combinations."""
    return 1 if band == 0 else 2 if band < 3 else 3


def _combined(found: np.ndarray, k: int, salt: int) -> np.ndarray:
    """A hash of each combination of k of the tokens, which are in order."""
    picks = np.array(list(combinations(range(len(found)), k)), dtype=np.int64).reshape(-1, k)
    h = np.full(len(picks), salt, dtype=np.uint64)
    for column in picks.T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + found[column])
    return h


def signatures(found: np.ndarray, classes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of a set's signatures. found: its tokens; classes: 0 for one that no other set holds, 1 for a rare one,
    else k of its combinations."""
    n = len(found)
    need_all = missing(n, percent) + 1 - int(np.count_nonzero(classes == 0))
    if n < 2 or need_all <= 0:
        return np.zeros(0, dtype=np.uint64)  # of a set with one token only an equal one is linked
    found, classes = found[classes > 0], classes[classes > 0]
    out, singles = [], found[classes == 1]
    for band in bands(n, percent):
        need = need_all
        k_of = np.minimum(classes, largest_k(band))
        rare = singles if largest_k(band) > 1 else found
        out.append(rare[:need])
        need -= min(need, len(rare))
        for k in range(2, largest_k(band) + 1):
            if not need:
                break
            mine = found[k_of == k]
            cut = max(1, (1 << band) // SUBCLASS[k])
            part = (mine >> np.uint64(20)) % np.uint64(cut)
            by_part = np.argsort(part, kind="stable")
            first = np.searchsorted(part[by_part], part[by_part], side="left")
            rank = np.empty(len(mine), dtype=np.int64)
            rank[by_part] = np.arange(len(mine)) - first
            gained = np.cumsum(rank >= k - 1)
            last = int(np.searchsorted(gained, need)) + 1 if len(gained) and gained[-1] >= need else len(mine)
            need -= min(need, int(gained[-1]) if len(gained) else 0)
            for p in np.unique(part[:last]).tolist():
                out.append(_combined(mine[:last][part[:last] == p], k, 4096 * k + band))
    return np.unique(np.concatenate(out))


def classes_of(found: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Class of each token: the number of the last bits that hold it, 0 for none."""
    out = np.zeros(len(found), dtype=np.int64)
    for k, held in enumerate(bits, 1):
        out[has(held, found)] = k
    return out


# -- passes over the texts ---------------------------------------------------------------

def _set_key(found: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _body(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode())


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, HELD):
            yield batch.slice(k, HELD)


def _sizes(size: int, share: float):
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for batch in _sliced(batches):
            n, keys, bodies, some = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = tokens(text, powers, size)
                key = _set_key(found) if len(found) else (None, None)
                n.append(len(found))
                keys.append(key)
                bodies.append(_body(text))
                # copies add nothing to the counts; the others' tokens are in order
                some.append(found[:0] if key in seen else found[:np.searchsorted(found, limit)])
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *some]).view(np.int64)
            cuts = np.cumsum([0, *map(len, some)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)],
                 pa.array(np.array(bodies, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
                names=["doc_id", "n", "s1", "s2", "body", "some"])
    return measure


def _each_set(batches: Iterator[pa.RecordBatch], size: int, left) -> Iterator[list[tuple[int, int, str, np.ndarray]]]:
    """For each batch the sets (key, text, tokens) of the bodies left, but for those that the task saw lately."""
    powers, seen = Powers(), set()
    for batch in _sliced(batches):
        out, texts = [], batch.column("text").to_pylist()
        bodies = np.array([_body(t) for t in texts], dtype=np.uint64)
        for k in np.flatnonzero(has(left.value, bodies)).tolist():
            found = tokens(texts[k], powers, size)
            key = _set_key(found)
            if len(found) < 2 or key in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(key)
            out.append((*key, texts[k], found))
        yield out


def _token_rows(size: int, left):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _each_set(batches, size, left):
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *[s[3] for s in sets]]).view(np.int64)
            keys = np.repeat(np.array([s[0] for s in sets], dtype=np.int64), [len(s[3]) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(keys)], names=["token", "s1"])
    return emit


def _signature_rows(size: int, percent: int, left, bits: list):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.value for b in bits]
        for sets in _each_set(batches, size, left):
            sigs = [signatures(s[3], classes_of(s[3], held), percent) for s in sets]
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *sigs]).view(np.int64)
            keys = [np.repeat(np.array([s[i] for s in sets], dtype=np.int64), [len(x) for x in sigs]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(flat), *map(pa.array, keys)], names=["sig", "s1", "s2"])
    return emit


def cells_of(found: np.ndarray) -> bytes:
    """Number of tokens in each cell, a byte each."""
    counts = np.bincount((found >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _texts_of(size: int, left):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _each_set(batches, size, left):
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in sets], pa.int64()), pa.array([s[1] for s in sets], pa.int64()),
                 pa.array([s[2] for s in sets], pa.string()), pa.array([cells_of(s[3]) for s in sets], pa.binary())],
                names=["s1", "s2", "text", "cells"])
    return emit


# -- sets that can have a link -----------------------------------------------------------

def _counted(each: DataFrame) -> DataFrame:
    """(token, low, high, n) of rows (token, s1): smallest and largest key of its sets, rows."""
    return each.groupBy("token").agg(F.min("s1").alias("low"), F.max("s1").alias("high"), F.count(F.lit(1)).alias("n"))


def _still(classes: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """The classes that hold few enough tokens alone; `alone` counts these."""
    alone = (counted.filter(F.col("low") == F.col("high")).groupBy(F.col("low").alias("_s1"))
             .agg(F.count(F.lit(1)).alias("_alone")))
    allowed = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100))
    named = [c for c in classes.columns if c != "alone"]
    return (classes.join(alone, F.col("s1") == F.col("_s1"), "left")
            .select(*named, F.coalesce("_alone", F.lit(0)).alias("alone")).filter(F.col("alone") <= allowed))


def _left_bits(rows: DataFrame, classes: DataFrame):
    """Bits of the texts whose class is left."""
    bodies = rows.select("s1", "s2", "body").distinct().join(classes.select("s1", "s2"), ["s1", "s2"], "left_semi")
    return rows.sparkSession.sparkContext.broadcast(bits_of(bodies, "body"))


# -- verification ------------------------------------------------------------------------

def _verify(size: int, percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, tile, held = Powers(), None, {}
        for batch in batches:
            linked = []
            columns = [batch.column(c).to_pylist() for c in ("i", "j", "a", "b", "text")]
            for i, j, a, b, text in zip(*columns):
                if (i, j) != tile:
                    tile, held = (i, j), {}
                if b is None:
                    held[a] = tokens(text, powers, size)
                    continue
                x, y = sorted((held[a], held[b]), key=len)
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in linked], pa.int64()),
                                              pa.array([p[1] for p in linked], pa.int64())], names=["a", "b"])
    return check


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
             tile_tokens: int = TILE_TOKENS) -> DataFrame:
    """The pairs (a, b, weight) whose texts (node, text) are linked. weight: tokens of both.

    Nodes are dealt into tiles by hash, pairs into pairs of tiles; the number of tiles grows with the pairs.
    """
    weight = pairs.agg(F.sum("weight")).first()[0] or 0
    n = max(1, round((weight / tile_tokens) ** 0.5))

    def tile(node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(n)).cast("int")

    placed = pairs.select(F.least(tile("a"), tile("b")).alias("i"), F.greatest(tile("a"), tile("b")).alias("j"), "a", "b")
    ends = placed.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = ends.join(texts.select("node", "text"), "node").select("i", "j", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = placed.select("i", "j", "a", "b", F.lit(None).cast("string").alias("text")).union(sent)
    return (rows.repartition("i", "j").sortWithinPartitions("i", "j", F.col("b").asc_nulls_first())
            .mapInArrow(_verify(size, percent), "a long, b long"))


# -- join --------------------------------------------------------------------------------

def _near(percent: int) -> Column:
    """Whether sizes and tokens held alone allow a link of (n, alone) and (m_n, m_alone)."""
    most = F.least(F.col("n") - F.col("alone"), F.col("m_n") - F.col("m_alone"))
    return F.lit(100) * most >= F.lit(percent) * (F.col("n") + F.col("m_n") - most)


def _star_pairs(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Members of each signature with a leader of another component; in the first turn one with few tokens alone."""
    order = F.struct((F.col("alone") if turn == 0 else F.lit(0).cast("long")).alias("k"),
                     F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "alone", "root")
    leaders = (placed.groupBy("sig").agg(F.min(order).alias("lead"), F.min("root").alias("low"), F.max("root").alias("high"))
               .filter(F.col("low") < F.col("high"))
               .select("sig", F.col("lead.node").alias("m"), F.col("lead.n").alias("m_n"),
                       F.col("lead.alone").alias("m_alone"), F.col("lead.root").alias("m_root")))
    met = placed.join(leaders, "sig").filter((F.col("root") != F.col("m_root")) & _near(percent))
    return met.select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b"),
                      (F.col("n") + F.col("m_n")).alias("weight")).distinct()


def _apart(percent: int):
    """Pairs of a signature's sets that lie in different components and that no count rules out.

    Every token of one set alone changes the count of one cell by one, so two sets differ in as many tokens at least as
    their cells differ by in sum; linked sets differ in few.
    """
    def search(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
        if not sides[0]:
            return
        same = not sides[1]
        (n, alone, root, node, cells), (m, m_alone, m_root, m_node, m_cells) = [
            (*[np.array([r[k] for r in side], dtype=np.int64) for k in (1, 2, 3, 4)],
             np.frombuffer(b"".join(r[5] for r in side), dtype=np.uint8).reshape(len(side), -1).astype(np.int16))
            for side in (sides[0], sides[0] if same else sides[1])]
        for k in range(len(n)):
            most = np.minimum(n[k] - alone[k], m - m_alone)
            maybe = (root[k] != m_root) & (100 * most >= percent * (n[k] + m - most))
            if same:
                maybe[:k + 1] = False
            at = np.flatnonzero(maybe)
            differ = np.abs(m_cells[at] - cells[k]).sum(axis=1)
            for j in at[(100 + percent) * differ <= (100 - percent) * (n[k] + m[at])].tolist():
                yield (*sorted((int(node[k]), int(m_node[j]))), int(n[k] + m[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            found = sorted(set(search(held))) if held else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)],
                                              names=["a", "b", "weight"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sig", "i", "j", "block", "n", "alone", "root", "node", "cells")]
            for sig, i, j, block, *rest in zip(*columns):
                if (sig, i, j) != key:
                    yield close()
                    key, held = (sig, i, j), []
                held.append((0 if block == i else 1, *rest))
        yield close()
    return run


def _rest_pairs(placed: DataFrame, texts: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """All pairs of one signature that lie in different components, without those that counts rule out.

    A signature's sets are cut into blocks, and each pair of blocks is searched apart.
    """
    sizes = (placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                       F.ceil(F.count(F.lit(1)) / block_sets).cast("int").alias("blocks"))
             .filter(F.col("low") < F.col("high")).select("sig", "blocks"))
    dealt = (placed.join(sizes, "sig").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .join(texts.select("node", "cells"), "node"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "alone", "root",
        "node", "cells")
    return (pairs.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
            .mapInArrow(_apart(percent), "a long, b long, weight long").distinct())


def links(members: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT, stars: int = STARS,
          tile_tokens: int = TILE_TOKENS, block_sets: int = BLOCK_SETS, folder: str | None = None) -> DataFrame:
    """(node, root) of the sets that have a link. members: (sig, node, n, alone); texts: (node, text, cells).

    Every pair that shares a signature is compared or lies in one component already.
    """
    roots, found = None, None
    for turn in range(stars + 1):
        placed = members.withColumn("root", F.col("node"))
        if roots is not None:
            named = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
            placed = members.join(named, F.col("node") == F.col("_node"), "left").select(
                *members.columns, F.coalesce("_root", "node").alias("root"))
        pairs = _star_pairs(placed, turn, percent) if turn < stars else _rest_pairs(placed, texts, percent, block_sets)
        now = written(verified(written(pairs, folder), texts, size, percent, tile_tokens), folder)
        if not now.isEmpty():
            found = now if found is None else found.union(now)
            roots = written(components(found, folder), folder)
    return roots if roots is not None else members.select("node", F.col("node").alias("root")).limit(0)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                   percent: int = PERCENT, frequent: tuple[int, ...] = CLASSES, share: float = SHARE,
                   rounds: int = COUNT_ROUNDS, stars: int = STARS, tile_tokens: int = TILE_TOKENS,
                   block_sets: int = BLOCK_SETS, folder: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A row's set holds its distinct shingles of `size` words (A-Z lower-cased; all words as one where they are fewer).
    Rows are linked when 100 x intersection >= percent x union; component_id is the smallest doc_id reachable. NULL and
    empty texts have an empty set, are linked with nothing and keep their own id. A row with a NULL id takes part; its
    component's id is the smallest that is not NULL (NULL if there is none). Rows that repeat an id are compared one by
    one. An empty table gives no rows; other columns are left out. A text is held whole by one task, whatever its length.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).alias("doc_id"), full_text(F.col(text_col)).alias("text"))
    texts = raw.select("text")
    id_type = raw.schema["doc_id"].dataType.simpleString()
    rows = written(raw.mapInArrow(_sizes(size, share), f"doc_id {id_type}, n long, s1 long, s2 long, body long, "
                                  "some array<long>"), folder)
    classes = written(rows.filter(F.col("n") > 0).groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("first"))
                      .withColumn("node", F.monotonically_increasing_id()), folder)
    counted = _counted(rows.select(F.explode("some").alias("token"), "s1"))
    left = written(_still(classes.filter(F.col("n") > 1).withColumn("alone", F.lit(0).cast("long")), counted, percent), folder)
    bits: list = []
    for _ in range(rounds):
        bodies = _left_bits(rows, left)
        counted = written(_counted(texts.mapInArrow(_token_rows(size, bodies), "token long, s1 long")), folder)
        left = written(_still(left, counted, percent), folder)
        shared = counted.filter(F.col("low") < F.col("high"))
        bits = [spark.sparkContext.broadcast(bits_of(shared.filter(F.col("n") >= least), "token")) for least in frequent]
    bodies = _left_bits(rows, left)
    each = written(texts.mapInArrow(_signature_rows(size, percent, bodies, bits), "sig long, s1 long, s2 long").distinct(),
                   folder)
    met = each.groupBy("sig").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > 1).select("sig")
    members = written(each.join(met, "sig", "left_semi").join(left, ["s1", "s2"]).select("sig", "node", "n", "alone"), folder)
    held = (texts.mapInArrow(_texts_of(size, _left_bits(rows, left.join(members.select("node").distinct(), "node", "left_semi"))),
                             "s1 long, s2 long, text string, cells binary")
            .groupBy("s1", "s2").agg(F.first("text").alias("text"), F.first("cells").alias("cells")))
    held = written(held.join(left, ["s1", "s2"]).select("node", "text", "cells"), folder)
    roots = links(members, held, size, percent, stars, tile_tokens, block_sets, folder)
    linked = classes.select("node", "first").join(roots, "node")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    lowest = linked.join(lowest, "root").select("node", "lowest")
    labels = written(classes.join(lowest, "node", "left").select(
        "s1", "s2", F.coalesce("lowest", "first").alias("component_id")), folder)
    some, none = rows.filter(F.col("n") > 0), rows.filter(F.col("n") == 0)
    return (match(some, labels, ["s1", "s2"], "inner").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .union(none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))
