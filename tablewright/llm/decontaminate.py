"""Benchmark decontamination: test items in a BM25 index, every passage of every document as a query.

The index holds, for each term, its items with their share of the item's own score, in blocks with block maxima.
Block-max pruning runs in steps: sums of block maxima over all passages of a document at once, one column for each
block of items; then over the distinct terms of each passage that is left; then a block-max WAND inside the blocks that
may still reach the threshold. What WAND retrieves is verified on the words: five-word shingles of the item, and the words of its question and of its answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import numbered, written

K1, B = 1.2, 0.75
#: Retrieved: a passage with this share of the score that the item itself would get.
THRESHOLD = 0.6
#: Verified: share of the item's five-word shingles, and of the distinct words of its question and of its answer.
OVERLAP, PART_OVERLAP = 0.8, 0.5
SHINGLE = 5
#: Words from one passage to the next.
STRIDE = 32
#: Items of a block (more where that would make over MOST_BLOCKS blocks), and most characters of items in one
#: broadcast index; more items are searched in further passes.
BLOCK_ITEMS, MOST_BLOCKS = 4, 128
INDEX_CHARS = 32_000_000

_WORD = re.compile(r"[^\W_]+")
_LAST_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def terms_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: the answer is its last line, else its last sentence, else its last
    half of the words."""
    body = text.strip()
    head, cut, tail = body.rpartition("\n")
    if not cut:
        parts = _LAST_SENTENCE.split(body)
        head, tail = " ".join(parts[:-1]), parts[-1]
    question, answer = terms_of(head), terms_of(tail)
    if not question or not answer:
        every = question + answer
        question, answer = every[:(len(every) + 1) // 2], every[(len(every) + 1) // 2:]
    return question, answer


def shingles(terms: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; the whole of a shorter list."""
    if not terms:
        return set()
    size = min(SHINGLE, len(terms))
    return {tuple(terms[i:i + size]) for i in range(len(terms) - size + 1)}


@dataclass
class Index:
    """Items in order of their length, so that a block's maxima fit its items."""

    ids: list = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    #: by term: item numbers and shares, both ascending by item; block maxima by block
    items: list[list[int]] = field(default_factory=list)
    shares: list[list[float]] = field(default_factory=list)
    bounds: np.ndarray = None
    block: int = BLOCK_ITEMS
    shingles: list[set] = field(default_factory=list)
    parts: list[tuple[set, set]] = field(default_factory=list)
    longest: int = 0


def build_index(items: list[tuple], frequency: dict[str, int] | None = None, n_items: int | None = None,
                mean: float | None = None) -> Index:
    """items: (id, text). frequency, n_items and mean: document frequencies, number and mean number of terms of all
    items, where these are a part."""
    split = [(i, text or "", terms_of(text or "")) for i, text in items]
    split = sorted((s for s in split if s[2]), key=lambda s: (len(s[2]), s[1]))
    index = Index(ids=[s[0] for s in split], longest=max((len(s[2]) for s in split), default=0))
    total = n_items if n_items is not None else len(split)
    if frequency is None:
        frequency = Counter(t for s in split for t in set(s[2]))
    mean = sum(len(s[2]) for s in split) / max(1, len(split)) if mean is None else mean
    postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for number, (_, text, terms) in enumerate(split):
        weights = {}
        for term, tf in Counter(terms).items():
            idf = math.log(1 + (total - frequency[term] + 0.5) / (frequency[term] + 0.5))
            weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(terms) / mean))
        own = sum(weights.values())
        for term, weight in weights.items():
            postings[term].append((number, weight / own if own > 0 else 1 / len(weights)))
        question, answer = question_and_answer(text)
        index.shingles.append(shingles(terms))
        index.parts.append((set(question), set(answer)))
    index.block = max(BLOCK_ITEMS, -(-len(split) // MOST_BLOCKS))
    index.bounds = np.zeros((len(postings), max(1, -(-len(split) // index.block))), dtype=np.float32)
    for k, (term, found) in enumerate(postings.items()):
        index.terms[term] = k
        index.items.append([n for n, _ in found])
        index.shares.append([s for _, s in found])
        for number, share in found:
            index.bounds[k, number // index.block] = max(index.bounds[k, number // index.block], np.float32(share))
    return index


#: Room for the rounding of sums in single precision.
SLACK = 1e-4


def wand(index: Index, query: list[int], threshold: float, first: int = 0, end: int | None = None) -> list[tuple]:
    """(item, share) of every item in first..end-1 whose share over the distinct query terms reaches the threshold."""
    found, end = [], len(index.ids) if end is None else end
    tops, cursors = {}, []

    def to(cursor: list, item: int) -> None:
        postings = index.items[cursor[2]]
        cursor[1] = bisect_left(postings, item, cursor[1])
        cursor[0] = postings[cursor[1]] if cursor[1] < len(postings) else end

    for term in query:
        own = index.bounds[term, first // index.block:(end - 1) // index.block + 1]
        tops[term] = float(own.max()) if len(own) else 0.0
        cursors.append([0, 0, term])
        to(cursors[-1], first)
    while True:
        cursors = sorted(c for c in cursors if c[0] < end)
        bound, pivot = 0.0, -1
        for k, cursor in enumerate(cursors):
            bound += tops[cursor[2]]
            if bound >= threshold - SLACK:
                pivot = k
                break
        if pivot < 0:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        block = item // index.block
        ahead = cursors[:pivot + 1]
        if sum(float(index.bounds[c[2], block]) for c in ahead) < threshold - SLACK:
            # no item of this block before the next cursor can reach it
            stop = (block + 1) * index.block
            if pivot + 1 < len(cursors):
                stop = min(stop, cursors[pivot + 1][0])
            for cursor in ahead:
                to(cursor, max(stop, item + 1))
        elif cursors[0][0] == item:
            share = sum(index.shares[c[2]][c[1]] for c in ahead)
            if share >= threshold - 1e-9:
                found.append((item, share))
            for cursor in ahead:
                to(cursor, item + 1)
        else:
            for cursor in ahead:
                if cursor[0] < item:
                    to(cursor, item)


def overlaps(index: Index, item: int, passage: list[str]) -> tuple[float, float, float]:
    """Shares of the item's shingles, its question's words and its answer's words that the passage has."""
    held, own = set(passage), index.shingles[item]
    size = len(next(iter(own)))
    there = {tuple(passage[i:i + size]) for i in range(len(passage) - size + 1)}
    parts = [len(p & held) / len(p) if p else 1.0 for p in index.parts[item]]
    return len(own & there) / len(own), parts[0], parts[1]


def leaks(index: Index, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple]:
    """item number -> (share, overlap, question overlap, answer overlap) of the items that a text holds."""
    if not index.ids:
        return {}
    terms, number = terms_of(text), index.terms.get
    known = np.array([number(t, -1) for t in terms], dtype=np.int64)
    at = np.flatnonzero(known >= 0)
    if not len(at):
        return {}
    n_chunks = (len(known) - 1) // STRIDE + 1
    pairs = np.unique((at // STRIDE) * len(index.terms) + known[at])
    chunk, term = np.divmod(pairs, len(index.terms))
    firsts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
    sums = np.zeros((n_chunks + 1, index.bounds.shape[1]), dtype=np.float32)
    sums[chunk[firsts]] = np.add.reduceat(index.bounds[term], firsts, axis=0)
    # A passage: so many chunks that any item lies inside one of them as a whole.
    span = min((index.longest - 1) // STRIDE + 2, n_chunks)
    total = np.array([sums[k:n_chunks - span + 1 + k] for k in range(span)]).sum(axis=0)
    out: dict[int, tuple] = {}
    for first in np.flatnonzero((total >= threshold - SLACK).any(axis=1)):
        lo, hi = int(first) * STRIDE, (int(first) + span) * STRIDE
        query = np.unique(known[lo:hi])
        query = query[query >= 0]
        for block in np.flatnonzero(index.bounds[query].sum(axis=0) >= threshold - SLACK):
            begin = int(block) * index.block
            for item, share in wand(index, query.tolist(), threshold, begin, min(begin + index.block, len(index.ids))):
                seen = overlaps(index, item, terms[lo:hi])
                if seen[0] >= overlap - 1e-9 and min(seen[1:]) >= PART_OVERLAP and (share, *seen) > out.get(item, ()):
                    out[item] = (share, *seen)
    return out


# -- Spark -------------------------------------------------------------------------------

def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms_of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), batch.column("text"), pa.array([len(t) for t in found], pa.int64()),
             pa.array([sorted(set(t)) for t in found], pa.list_(pa.string()))], names=["item", "text", "n", "terms"])


def item_texts(benchmark: DataFrame, text_col: str, folder: str | None = None) -> DataFrame:
    """(item, text, n, terms): the distinct texts that have terms, numbered; their number of terms and distinct terms."""
    texts = benchmark.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    kept = texts.withColumn("item", F.monotonically_increasing_id()).select("item", "text")
    return written(kept.mapInArrow(_item_terms, "item long, text string, n long, terms array<string>").filter("n > 0"), folder)


def indexes(items: DataFrame, most_chars: int = INDEX_CHARS) -> Iterator[Index]:
    """One index for each part of the item texts, each of bounded size (a text is never cut).

    Number, mean length and frequencies are those of all items and counted in one way, so scores do not depend on the
    parts. Copies of an item are one text and meet in one part.
    """
    row = items.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    parts = -(-(row["chars"] or 0) // most_chars)
    counts = items.select(F.explode("terms").alias("term")).groupBy("term").count()
    counts = written(counts) if parts > 1 else counts
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        mine = own.select(F.explode("terms").alias("term")).distinct()
        frequency = {r["term"]: r["count"] for r in counts.join(mine, "term").toLocalIterator()}
        yield build_index([tuple(r) for r in own.select("item", "text").toLocalIterator()], frequency, row["n"], row["mean"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
                 overlap: float = OVERLAP, most_chars: int = INDEX_CHARS) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, share, overlap, question_overlap, answer_overlap.

    Rows that repeat a document give repeated rows; NULL ids keep NULL; NULL and empty texts or items match nothing.
    Items longer than a document are found as far as the thresholds allow. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    types = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = (f"doc_id {types[0]}, item_id {types[1]}, share double, overlap double, question_overlap double, "
              "answer_overlap double")
    schema = schema.replace(f"item_id {types[1]}", "item long")
    found, items = spark.createDataFrame([], schema), item_texts(benchmark, item_text)
    for index in indexes(items, most_chars):
        sent = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                out = []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    doc_id = None
                    for item, seen in leaks(index, text, threshold, overlap).items():
                        doc_id = batch.column("doc_id")[k].as_py() if doc_id is None else doc_id
                        out.append((doc_id, index.ids[item], *seen))
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], batch.schema.field("doc_id").type), pa.array(columns[1]),
                         *[pa.array(c, pa.float64()) for c in columns[2:]]],
                        names=["doc_id", "item", "share", "overlap", "question_overlap", "answer_overlap"])

        found = found.union(rows.mapInArrow(find, schema))
    # every id of a found text
    named = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).join(
        items.select("item", "text"), "text").select("item", "item_id")
    return found.join(named, "item").select("doc_id", "item_id", "share", "overlap", "question_overlap", "answer_overlap")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text",
                  threshold: float = THRESHOLD, overlap: float = OVERLAP, most_chars: int = INDEX_CHARS) -> DataFrame:
    """The rows that hold no item, all columns unchanged; nothing is shuffled."""
    kept, at = numbered(docs), docs.columns.index(text_col)
    for index in indexes(item_texts(benchmark, item_text), most_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                clean = [not leaks(index, t or "", threshold, overlap)
                         for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(keep, kept.schema)
    return kept.toDF(*docs.columns)
