"""Exact removal of repeated 50-word windows, with a count-min sketch as prefilter.

Pass 1 counts the windows' anchors in a count-min sketch. An anchor is the smallest 20-word hash inside a window:
equal windows have equal anchors, so the count of an anchor is never below that of its windows, while there is one
anchor for about 16 words. Each task sends the sparse cells of its own sketch, blocks of cells are summed apart, and
one bit for each cell (counted twice or more) is broadcast; its size is bounded by `max_cells`.

Pass 2 groups only windows whose anchor is estimated repeated, by a 96-bit hash of their words, and finds the
smallest document of each. What the sketch overestimates is sorted out here; nothing repeated can be missed. The windows
of several documents are written, and a third pass sends only windows that their bits hold to be looked up there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bits import bits_of, has
from tablewright.llm.common import full_text, match, written
from tablewright.llm.spans import Powers, mix, spans, window_hashes, word_hashes

WINDOW = 50
ANCHOR = 20
#: Rows of the sketch; cells of a row lie in blocks of BLOCK cells.
DEPTH = 2
BLOCK = 1 << 16
#: Slots in which the tasks' sketches first meet.
SLOTS = 32
#: Cells of a row: eight for each expected anchor, between these bounds (2**29 cells are 64 MB of bits a row).
MIN_CELLS = 1 << 20
MAX_CELLS = 1 << 29


def sketch_cells(docs: DataFrame, max_cells: int = MAX_CELLS) -> int:
    """Cells of a sketch row for the number of characters in the table; bounded by max_cells."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    cells = MIN_CELLS
    while cells < min(max_cells, 8 * chars // 6 // 16):
        cells *= 2
    return cells


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of `size` values, by doubling."""
    out, width = values, 1
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _anchors(text: str, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the text, hash of each word, anchor of each window (none where there is no window)."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = spans(data)
    first = word_hashes(data, starts, ends, powers, 0)
    if len(starts) < WINDOW:
        return data, first, np.zeros(0, dtype=np.uint64)
    return data, first, _sliding_min(window_hashes(first, ANCHOR, powers, 0), WINDOW - ANCHOR + 1)


def _cell(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (anchors if row == 0 else mix(anchors + np.uint64(0x9E3779B97F4A7C15))) & np.uint64(cells - 1)


def _sketch_of_task(cells: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        powers, pending, size, slot = Powers(), [], 0, TaskContext.get().partitionId() % SLOTS

        def flush() -> Iterator[pa.RecordBatch]:
            all_anchors = np.concatenate(pending) if pending else np.zeros(0, dtype=np.uint64)
            for row in range(DEPTH):
                # a task's cell counts no more than twice: two is all that the filter asks
                cell, counts = np.unique(_cell(all_anchors, row, cells), return_counts=True)
                cell = np.repeat(cell, np.minimum(counts, 2))
                cuts = np.flatnonzero(np.diff(cell // BLOCK)) + 1
                parts = np.split(cell, cuts) if len(cell) else []
                yield pa.RecordBatch.from_pydict({
                    "sketch_row": pa.array([row] * len(parts), pa.int32()),
                    "slot": pa.array([slot] * len(parts), pa.int32()),
                    "block": pa.array([int(p[0]) // BLOCK for p in parts], pa.int64()),
                    "hits": pa.array([(p % BLOCK).astype("<u2").tobytes() for p in parts], pa.binary())})
            pending.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                anchors = np.unique(_anchors(text, powers)[2])  # a document counts an anchor once
                pending.append(anchors)
                size += len(anchors)
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()
    return count


def _merge(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Sums of the blocks' cells over rows sorted by their first `keys` columns, one block at a time."""
    now, counts = None, None
    for batch in batches:
        for *key, hits in zip(*[batch.column(k).to_pylist() for k in range(keys)], batch.column("hits").to_pylist()):
            if key != now:
                if now is not None:
                    yield now, counts
                now, counts = key, np.zeros(BLOCK, dtype=np.uint32)
            counts += np.bincount(np.frombuffer(hits, dtype="<u2"), minlength=BLOCK).astype(np.uint32)
    if now is not None:
        yield now, counts


def _merge_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' sketches of a slot as one sketch, no cell above two."""
    for (row, block, _), counts in _merge(batches, 3):
        hits = np.repeat(np.arange(BLOCK), np.minimum(counts, 2)).astype("<u2").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int64()), pa.array([hits])],
                                         names=["sketch_row", "block", "hits"])


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit for each cell of a block that is counted twice or more."""
    for (row, block), counts in _merge(batches, 2):
        yield pa.RecordBatch.from_arrays(
            [pa.array([row], pa.int32()), pa.array([block], pa.int64()), pa.array([np.packbits(counts > 1).tobytes()])],
            names=["sketch_row", "block", "bits"])


def repeated_cells(docs: DataFrame, cells: int) -> list[np.ndarray]:
    """Bits of the cells counted twice or more, one array for each sketch row (cells / 8 bytes).

    Blocks meet in two levels, so a task reads SLOTS rows for a block, however many tasks there were. Where max_cells
    bounds the cells, more of them are counted twice and more windows go on to the exact pass; none is lost.
    """
    parts = docs.select("text").mapInArrow(_sketch_of_task(cells), "sketch_row int, slot int, block long, hits binary")
    slots = ["sketch_row", "block", "slot"]
    merged = (parts.select(*slots, "hits").repartition(*slots).sortWithinPartitions(*slots)
              .mapInArrow(_merge_slots, "sketch_row int, block long, hits binary"))
    whole = (merged.repartition("sketch_row", "block").sortWithinPartitions("sketch_row", "block")
             .mapInArrow(_merge_blocks, "sketch_row int, block long, bits binary"))
    bits = [np.zeros(max(cells, BLOCK) // 8, dtype=np.uint8) for _ in range(DEPTH)]
    for batch in whole.toArrow().to_batches():  # cells / 8 bytes a row of the sketch
        for row, block, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            at = block * BLOCK // 8
            bits[row][at:at + BLOCK // 8] = np.frombuffer(held.as_buffer(), dtype=np.uint8)
    return bits


def _is_set(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    at = cell.astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _candidates(sketch, cells: int, repeated=None):
    """Windows whose anchor is estimated repeated; with bits of repeated windows only those that they hold."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), sketch.value
        for batch in batches:
            ids, bodies = batch.column("doc_id"), batch.column("body")
            for k, text in enumerate(batch.column("text").to_pylist()):
                data, first, anchors = _anchors(text, powers)
                if not len(anchors):
                    continue
                maybe = np.ones(len(anchors), dtype=bool)
                for row in range(DEPTH):
                    maybe &= _is_set(bits[row], _cell(anchors, row, cells))
                at = np.flatnonzero(maybe)
                if not len(at):
                    continue
                own = window_hashes(first, WINDOW, powers, 0)
                if repeated is not None:
                    at = at[has(repeated.value, own[at])]
                    if not len(at):
                        continue
                starts, ends = spans(data)
                second = word_hashes(data, starts, ends, powers, 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own[at].view(np.int64)),
                    pa.array((window_hashes(second, WINDOW, powers, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.repeat(ids[k], n), pa.repeat(bodies[k], n), pa.array(at.astype(np.int32))],
                    names=["w1", "w2", "doc_id", "body", "pos"])
    return find


def later_windows(docs: DataFrame, max_cells: int = MAX_CELLS, folder: str | None = None) -> DataFrame:
    """(doc_id, body, pos) of every window whose words also start in a document with a smaller id."""
    spark = docs.sparkSession
    asked = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 2 * WINDOW - 2)).select("doc_id", "body", "text")
    cells = sketch_cells(asked, max_cells)
    sketch = spark.sparkContext.broadcast(repeated_cells(asked, cells))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = f"w1 long, w2 int, doc_id {id_type}, body long, pos int"
    # Grouped in parts on each task first, so a window of many documents sends a row for each task.
    groups = (asked.mapInArrow(_candidates(sketch, cells), shape).groupBy("w1", "w2")
              .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last")))
    first = written(groups.select("w1", "w2", "first"), folder)
    repeated = spark.sparkContext.broadcast(bits_of(first, "w1"))
    # Both sides are scans, so that a join can split a window of very many documents.
    windows = asked.mapInArrow(_candidates(sketch, cells, repeated), shape)
    return windows.join(first, ["w1", "w2"]).filter(F.col("doc_id") > F.col("first")).select("doc_id", "body", "pos")


def _covered(n_words: int, starts: list[int]) -> np.ndarray:
    """True for each word that a window covers."""
    steps = np.zeros(n_words + WINDOW + 1, dtype=np.int32)
    at = np.asarray(starts, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return np.cumsum(steps)[:n_words] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
            tokens = text.encode().split()
            n_words.append(len(tokens))
            if starts:
                gone = _covered(len(tokens), starts)
                tokens = [t for t, g in zip(tokens, gone) if not g]
            n_removed.append(n_words[-1] - len(tokens))
            kept.append(b" ".join(tokens).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_cells: int = MAX_CELLS, folder: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes when a window of 50 words that covers it also starts in a document with a smaller id; windows are
    those of the input. NULL text is empty. A row with a NULL id neither loses words nor counts as a document.
    Rows that repeat an id are not smaller than each other: both keep what no smaller id holds. Texts under 50 words
    and empty tables pass unchanged; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(F.col(text_col)).alias("text"))
    rows = rows.withColumn("body", F.xxhash64("text"))
    found = later_windows(rows, max_cells, folder).groupBy("doc_id", "body").agg(F.collect_set("pos").alias("starts"))
    joined = match(rows, found, ["doc_id", "body"]).select("doc_id", "text", "starts")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"doc_id {id_type}, n_words long, n_removed long, kept_text string")
