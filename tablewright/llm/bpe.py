"""Byte-level BPE encoding and decoding.

Distinct words are encoded by Spark higher-order functions: an `aggregate` folds over the word's bytes and merges, in
each step, the adjacent pair of lowest rank. Ranks come from one map, cut by the hash of the piece so that a lookup
compares a few keys: the value of a one-row table, as a literal would stand in each description of the plan and of its
changes, which the driver keeps. The most frequent words (a bounded number, counted over all texts) are encoded so,
once, and their ids broadcast. A word outside that list is merged by the same rule in the task that meets it, as the fold
is too slow for words that occur once (see README); so the ids do not depend on the bound, and no text is shuffled. Both
passes cut their texts in Arrow and handle a chunk once for each round of texts. Decoding looks the pieces up in one
literal array and joins their bytes.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import full_text, let, written

#: Words whose ids are broadcast, and the longest of them in bytes: the broadcast has a fixed bound.
FREQUENT = 1 << 17
FREQUENT_BYTES = 32
#: Parts of the rank map.
PARTS = 1 << 14
#: Distinct chunks that a counting task holds before it hands their words on.
HELD = 300_000
#: Bytes of the texts that are cut in one round.
ROUND_BYTES = 2 << 20
#: Chunks that a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Bytes from which a word is merged with a heap.
LONG = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank (its token id) of a rank file: a base64 piece and a number on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, file))}


class Ranks:
    """The rank map as a table of one row: pieces are hex strings, one map for each part of the hash space."""

    def __init__(self, ranks: dict[bytes, int], parts: int = PARTS) -> None:
        maps: list[list[tuple[str, int]]] = [[] for _ in range(parts)]
        for piece, rank in ranks.items():
            code = piece.hex().upper()
            # xxhash64 of Spark, which pmod cuts into parts below
            digest = xxhash.xxh64_intdigest(code.encode(), 42)
            maps[(digest - (digest >> 63 << 64)) % parts].append((code, rank))
        self.parts = parts
        self.table = pa.table({"ranks": pa.array([maps], pa.list_(pa.map_(pa.string(), pa.int32())))})

    def of(self, table: Column, piece: Column) -> Column:
        """Rank of a piece in the bound table, NULL if it is none."""
        return F.get(table, F.pmod(F.xxhash64(piece), F.lit(self.parts)).cast("int"))[piece]


def encode_words(words: DataFrame, ranks: Ranks) -> DataFrame:
    """(word, ids): token ids of each word (string) by ranked merges folded over its bytes."""
    # a column before it is used, as Spark takes no subquery inside a lambda; the optimizer puts it there
    table = words.sparkSession.createDataFrame(ranks.table).scalar()
    return words.select("word", table.alias("ranks")).select("word", let(F.col("ranks"), lambda ranked: _fold(
        F.col("word").cast("binary"), lambda piece: ranks.of(ranked, piece))).alias("ids"))


def _fold(word: Column, rank_of) -> Column:
    code = F.hex(word)
    n = F.length(code) / 2
    none = F.lit(None).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.substring(code, i * 2 + 1, F.lit(2)))

    def pair_rank(p: Column, i: Column) -> Column:
        return rank_of(F.concat(F.get(p, i), F.get(p, i + 1)))

    def start(p: Column) -> Column:
        pairs = F.transform(p, lambda _, i: F.when(i + 1 < F.size(p), pair_rank(p, i)).otherwise(none))
        return F.struct(p.alias("p"), pairs.alias("r"))

    def merge(state: Column, _: Column) -> Column:
        def at(low: Column) -> Column:
            spot = F.array_position(state["r"], low).cast("int") - 1

            def joined(k: Column) -> Column:
                p = F.concat(F.slice(state["p"], F.lit(1), k),
                             F.array(F.concat(F.get(state["p"], k), F.get(state["p"], k + 1))),
                             F.slice(state["p"], k + 3, F.size(state["p"])))

                def ranked(q: Column) -> Column:
                    left = F.when(k > 0, F.concat(F.slice(state["r"], F.lit(1), k - 1), F.array(pair_rank(q, k - 1)))
                                  ).otherwise(F.array().cast("array<int>"))
                    own = F.array(F.when(k + 1 < F.size(q), pair_rank(q, k)).otherwise(none))
                    return F.struct(q.alias("p"), F.concat(left, own, F.slice(
                        state["r"], k + 3, F.size(state["r"]))).alias("r"))

                return let(p, ranked)

            return let(spot, joined)

        lowest = F.array_min(state["r"])
        return F.when(lowest.isNull(), state).otherwise(let(lowest, at))

    folded = let(pieces, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p)), start(p), merge, lambda s: s["p"]))
    ids = let(folded, lambda p: F.transform(p, rank_of))
    # a word that is a piece needs no merges
    return let(code, lambda c: let(rank_of(c), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(ids)))


# -- words of a text ---------------------------------------------------------------------

#: White space as `\\s` of Python's patterns has it.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space beside other white space, or at an end: there a cut at single spaces could split a match.
_CROWDED = f" {_SPACE}|{_SPACE} |^ | $"


def rounds(texts: pa.Array) -> Iterator[slice]:
    """Runs of texts with ROUND_BYTES in all, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + ROUND_BYTES, side="right")))
        yield slice(first, last)
        first = last


def cut_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Texts cut before each single space, so that every match of the pattern lies in one chunk.

    (whole, sizes, codes, words): the places of texts that stay whole, as they are empty or a space has white space
    beside it; the number of chunks of each other text and the code of each chunk: k for a space and words[k],
    len(words) + k for words[k] where it begins a text.
    """
    whole = pc.or_(pc.match_substring_regex(texts, _CROWDED), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
    coded = parts.flatten().dictionary_encode()
    codes, sizes = coded.indices.to_numpy().astype(np.int64), pc.list_value_length(parts).to_numpy().astype(np.int64)
    codes[np.cumsum(sizes) - sizes] += len(coded.dictionary)
    return np.flatnonzero(whole), sizes, codes, coded.dictionary


def one_word(chunk: str) -> bool:
    """True for a space and letters, which the pattern takes as one match."""
    return chunk[0] == " " and chunk[1:].isalpha()


#: Chunks that are one word, up to the version of the letters' table.
_ONE_WORD = r"^ \p{L}+$"


def _summed(words: list, counts: list) -> tuple[pa.Array, pa.Array]:
    """Each word once, its counts added up."""
    table = pa.table({"word": pa.chunked_array(words, pa.string()), "n": pa.chunked_array(counts, pa.int64())})
    table = table.group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    return tuple(table.column(c).combine_chunks() for c in ("word", "n_sum"))


def _count_words(pattern: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        chunks, counts, n, own = [], [], 0, Counter()  # own: words of texts that stay whole

        def flush() -> pa.RecordBatch:
            held, times = _summed(chunks, counts)
            one = pc.match_substring_regex(held, _ONE_WORD)
            more, words = pc.invert(one), own.copy()
            for chunk, k in zip(held.filter(more).to_pylist(), times.filter(more).to_pylist()):
                for word in cut.findall(chunk):
                    words[word] += k
            word, k = _summed([held.filter(one), pa.array(list(words), pa.string())],
                              [times.filter(one), pa.array(list(words.values()), pa.int64())])
            short = pc.less_equal(pc.binary_length(word), FREQUENT_BYTES)
            return pa.RecordBatch.from_arrays([word.filter(short), k.filter(short)], names=["word", "n"])

        for batch in batches:
            texts = batch.column("text").drop_null()
            for part in rounds(texts):
                some = texts[part]
                whole, _, codes, words = cut_chunks(some)
                for text in some.take(pa.array(whole)).to_pylist():
                    own.update(cut.findall(text))
                times = np.bincount(codes, minlength=2 * len(words))
                for places, start in zip(np.split(times, 2), (" ", "")):
                    met = np.flatnonzero(places)
                    chunks.append(pc.binary_join_element_wise(start, words.take(pa.array(met)), ""))
                    counts.append(pa.array(places[met]))
                    n += len(met)
                if n + len(own) < HELD:
                    continue
                chunks, counts = ([x] for x in _summed(chunks, counts))
                n = len(chunks[0])
                if n + len(own) >= HELD // 2:
                    yield flush()
                    chunks, counts, n = [], [], 0
                    own.clear()
        yield flush()
    return count


def frequent_words(docs: DataFrame, pattern: str, most: int = FREQUENT, folder: str | None = None) -> DataFrame:
    """The words of highest count, `most` at most: those at or above a count that all together keep the bound.

    Counted over all texts. The bound is found from counts of counts on a logarithmic scale (a few hundred rows), so no task sorts all words.
    """
    counted = (docs.select("text").mapInArrow(_count_words(pattern), "word string, n long").groupBy("word")
               .agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
               .withColumn("step", F.floor(F.log2("n") * 16).cast("int")))
    counted = written(counted, folder)
    least, held = None, 0
    for row in counted.groupBy("step").count().orderBy(F.desc("step")).collect():
        if held + row["count"] > most:
            break
        least, held = row["step"], held + row["count"]
    return counted.filter(F.col("step") >= least if least is not None else F.lit(False)).select("word")


# -- encoding ----------------------------------------------------------------------------

class Merges:
    """The rank map for merging by token ids: bytes as ids, and the rank of each pair of ids that makes a piece."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.whole = ranks
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.size = max(ranks.values()) + 1

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Made by each worker once, so that neither the driver nor the broadcast holds it."""
        ranks, found = self.whole, {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * self.size + right] = rank
        return found

    def of(self, word: bytes) -> list[int]:
        """Token ids of a word: the adjacent pair of lowest rank, the first of equals, is merged until none is left."""
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        if len(word) >= LONG:
            return self._of_long(word)
        size, rank_of = self.size, self.pairs.get
        ids = [self.bytes[b] for b in word]
        ranks = [rank_of(a * size + b, size) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == size:
                break
            k = ranks.index(low)
            ids[k:k + 2] = [low]  # a piece's rank is its id
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of(ids[k - 1] * size + low, size)
            if k < len(ranks):
                ranks[k] = rank_of(low * size + ids[k + 1], size)
        return ids

    def _of_long(self, word: bytes) -> list[int]:
        """The same by a heap over linked places: n log n for a word of any length."""
        n, size = len(word), self.size
        ids, before, after = [self.bytes[b] for b in word], list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n:
                rank = self.pairs.get(ids[a] * size + ids[b])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, ids[a], ids[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            rank, a, left, right = heapq.heappop(heap)
            b = after[a]
            if ids[a] != left or b >= n or ids[b] != right:
                continue  # one of both was merged since
            ids[a], ids[b], after[a] = rank, -1, after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append(ids[a])
            a = after[a]
        return out


class _Ids(dict):
    """Chunk -> its token ids as bytes of 32-bit numbers, remembered for a bounded number of chunks.

    Two generations: when the younger is full it becomes the older, and what is met again moves up.
    """

    def __init__(self, known: pa.Table, merges: Merges, pattern: str) -> None:
        super().__init__()
        self.known = {w: np.array(ids, dtype="<i4").tobytes()
                      for w, ids in zip(known.column("word").to_pylist(), known.column("ids").to_pylist())}
        self.merges, self.cut, self.older = merges, regex.compile(pattern), {}
        self.parts: dict[str, bytes] = {}  # matches inside other chunks

    def of_word(self, word: str) -> bytes:
        return self.known.get(word) or array("i", self.merges.of(word.encode())).tobytes()

    def of_words(self, text: str) -> bytes:
        return b"".join(map(self.of_part, self.cut.findall(text)))

    def of_part(self, word: str) -> bytes:
        if one_word(word):
            return self[word]
        ids = self.parts.get(word)
        if ids is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            ids = self.of_word(word)
            if len(word) <= LONG:
                self.parts[word] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.of_word(chunk) if one_word(chunk) else self.of_words(chunk)
        if len(chunk) <= LONG:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


#: The memory of a worker process, which serves one task after the other: (its broadcasts, pattern) and the ids.
_REMEMBERED: list = [None, None]


def _ids_of(known, merges, pattern: str) -> _Ids:
    key = (known.value, merges.value, pattern)
    held = _REMEMBERED[0]
    if held is None or held[0] is not key[0] or held[1] is not key[1] or held[2] != pattern:
        _REMEMBERED[:] = [key, _Ids(pa.ipc.open_stream(key[0]).read_all(), key[1], pattern)]
    return _REMEMBERED[1]


def _encoded(ids: _Ids, texts: pa.Array) -> pa.Array:
    """Token ids of each text: those of a chunk are looked up once and copied to its places."""
    whole, sizes, codes, words = cut_chunks(texts)
    used = np.bincount(codes, minlength=2 * len(words)) > 0
    with_space, first = (words.take(pa.array(np.flatnonzero(u))).to_pylist() for u in np.split(used, 2))
    found = [ids[" " + w] for w in with_space] + [ids[w] for w in first]
    found += map(ids.of_words, texts.take(pa.array(whole)).to_pylist())
    flat = np.frombuffer(b"".join(found), dtype="<i4")
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(lengths) - lengths

    n_chunks = np.ones(len(texts), np.int64)  # a whole text is a chunk
    cut = np.ones(len(texts), bool)
    cut[whole] = False
    n_chunks[cut] = sizes
    ends = np.cumsum(n_chunks)
    place = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)  # of each chunk among the found ones
    kept = np.ones(len(place), bool)
    kept[ends[whole] - 1] = False
    place[kept] = (np.cumsum(used) - 1)[codes]
    place[~kept] = len(found) - len(whole) + np.arange(len(whole))

    size = lengths[place]
    upto = np.concatenate(([0], np.cumsum(size)))
    values = flat[np.repeat(starts[place] - upto[:-1], size) + np.arange(upto[-1])]
    offsets = upto[np.concatenate(([0], ends))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encode(known, merges, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids_of(known, merges, pattern)
        for batch in batches:
            texts = batch.column("text")
            for part in rounds(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], _encoded(ids, texts[part])],
                                                 names=["doc_id", "ids"])
    return encode


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           most: int = FREQUENT, folder: str | None = None) -> DataFrame:
    """One row per input row: doc_id, ids (array of token ids, no special tokens).

    ranks_path: rank file, read on the driver; pattern: how text is cut into words. NULL and empty texts give an empty
    array. NULL and repeated ids keep their rows. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), full_text(F.col(text_col)).alias("text"))
    words = frequent_words(rows, pattern, most, folder)
    # as many tasks as cores: each has the table to load, and the words are bounded
    coded = encode_words(words.repartition(spark.sparkContext.defaultParallelism), Ranks(ranks))
    known, sink = coded.toArrow(), pa.BufferOutputStream()  # `most` rows at most
    with pa.ipc.new_stream(sink, known.schema) as stream:
        stream.write_table(known)
    sent = [spark.sparkContext.broadcast(x) for x in (sink.getvalue().to_pybytes(), Merges(ranks))]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(*sent, pattern), f"doc_id {id_type}, ids array<int>")


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes of an array of token ids: pieces from one literal array, joined. An unknown id adds nothing.

    In the plan and not in Arrow tasks: a second Python worker beside each encoding one would not fit the memory.
    """
    ranks = load_ranks(ranks_path)
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))
