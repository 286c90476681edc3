"""Phrase collocations mined from sorted occurrence relations, level by level (SETM).

R1 holds every occurrence (place, word) of a document in order of its place; places are consecutive inside a piece and
skip a number between pieces. R1 is written. A level merge-joins R(k-1) with R1 on adjacent places, counts the phrases
by one distributed group-count, and keeps in R(k) the occurrences of frequent phrases only (a semi-join with bounded
bits; phrases let through by chance fail the next count, as each longer phrase is at most as frequent). R(k) is
written with the rows of R1 that can still extend it.

A document's relations are arrays in one row, so a merge-join meets both sides sorted and in the same task, and only
counts are shuffled. Words are 64-bit codes of (lang, word), checked to be distinct over the whole vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.bits import bits_of, has
from tablewright.llm.common import full_text, shared_folder, written
from tablewright.llm.spans import Powers, mix, word_hashes

MIN_COUNT = 10
MOST_WORDS = 3
TOP = 2000
SCALE = 1_000_000
#: A candidate goes when a longer one around it has this percentage of its occurrences.
COVERED = 50
NO_LANG = "und"

#: Bytes of text hashed together, words joined together, and phrases that a task counts at once.
CHUNK = 1 << 20
JOINED = 250_000
HELD = 500_000

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


# -- words of texts ----------------------------------------------------------------------

class Words:
    """Words of some texts (UTF-8, A-Z lower-cased): row, first and last byte, place in the row, code."""

    def __init__(self, texts: list[bytes], seeds: list[int], powers: Powers) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        stop = _STOP[self.data]
        inside = np.concatenate(([False], ~(stop | _GAP[self.data]), [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        firsts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.rows = np.searchsorted(firsts, self.starts, side="right") - 1
        stops = np.cumsum(stop)[self.starts]
        place = np.arange(len(self.starts)) + stops
        first_word = np.searchsorted(self.rows, np.arange(len(texts)))
        base = place[np.minimum(first_word, max(len(place) - 1, 0))] if len(place) else place
        self.places = (place - base[self.rows]).astype(np.int32)
        self.cuts = np.searchsorted(self.rows, np.arange(len(texts) + 1))
        hashes = word_hashes(self.data, self.starts, self.ends, powers, 0)
        self.codes = mix(hashes ^ np.array(seeds, dtype=np.uint64)[self.rows])

    def word(self, k: int) -> str:
        return self.data[self.starts[k]:self.ends[k]].tobytes().decode()


def _seeds(langs: list[str], salt: int) -> list[int]:
    return [xxhash.xxh64_intdigest(lang.encode(), salt) for lang in langs]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[bytes]]]:
    """Langs and lower-cased texts of some consecutive rows, about CHUNK bytes together."""
    langs, texts, size = [], [], 0
    for lang, text in zip(batch.column("lang"), batch.column("text")):
        langs.append(lang.as_py())
        texts.append(text.as_buffer().to_pybytes().lower())  # of bytes, lower() changes A-Z only
        size += len(texts[-1]) + 1
        if size >= CHUNK:
            yield langs, texts
            langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def _vocabulary(salt: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for langs, texts in _chunks(batch):
                found = Words(texts, _seeds(langs, salt), powers)
                codes, first, n = np.unique(found.codes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(codes.view(np.int64)), pa.array([langs[r] for r in found.rows[first].tolist()], pa.string()),
                    pa.array([found.word(k) for k in first.tolist()], pa.string()), pa.array(n.astype(np.int64))],
                    names=["code", "lang", "word", "n"])
    return count


def vocabulary(texts: DataFrame, folder: str | None = None, salts: int = 8) -> tuple[DataFrame, int]:
    """(code, lang, word, n) of all words and the salt of their codes; no two words share a code."""
    for salt in range(salts):
        counted = written(texts.mapInArrow(_vocabulary(salt), "code long, lang string, word string, n long")
                          .groupBy("code", "lang", "word").agg(F.sum("n").alias("n")), folder)
        if counted.groupBy("code").count().filter(F.col("count") > 1).isEmpty():
            return counted, salt
    raise RuntimeError("Word codes collide under every salt.")


# -- relations ---------------------------------------------------------------------------

def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def _first_relation(salt: int, frequent):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), frequent.value
        for batch in batches:
            for langs, texts in _chunks(batch):
                found = Words(texts, _seeds(langs, salt), powers)
                kept = has(bits, found.codes)
                cuts = np.concatenate(([0], np.cumsum(kept)))[found.cuts]
                yield pa.RecordBatch.from_arrays([
                    _lists(found.places[kept], cuts), _lists(found.codes[kept].view(np.int64), cuts)],
                    names=["at", "phrase"])
    return occurrences


#: R1; each later relation has the rows of R1 that can extend it beside its own.
FIRST = "at array<int>, phrase array<long>"
RELATION = f"{FIRST}, at1 array<int>, word array<long>"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin."""
    cuts = column.offsets.to_numpy()
    return column.values.to_numpy()[cuts[0]:cuts[-1]], cuts - cuts[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut after about JOINED words each, so that a join's arrays stay small; a row is never cut."""
    for batch in batches:
        ends = batch.column(batch.num_columns - 1).offsets.to_numpy()
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + JOINED)) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def _joined(batch: pa.RecordBatch, k: int) -> tuple:
    """R(k-1) merge-joined with R1: row, place and k words of each phrase of k words; R1's rows, places and words."""
    at, cuts = _flat(batch.column(0))
    at1, cuts1 = _flat(batch.column(batch.num_columns - 2))
    words = _flat(batch.column(batch.num_columns - 1))[0]
    rows = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    rows1 = np.repeat(np.arange(len(cuts1) - 1), np.diff(cuts1))
    key, key1 = (rows << 32) + at + (k - 1), (rows1 << 32) + at1  # both ascend
    near = np.searchsorted(key1, key)
    met = np.flatnonzero(np.append(key1, -1)[near] == key)
    phrase = _flat(batch.column(1))[0].reshape(-1, k - 1)[met]
    return rows[met], at[met], np.column_stack((phrase, words[near[met]])).view(np.uint64), rows1, at1, words


def folded(words: list[np.ndarray]) -> np.ndarray:
    """One hash of a phrase's codes (uint64), the same as `folded_column`."""
    h = words[0]
    for w in words[1:]:
        h = ((h << np.uint64(21)) | (h >> np.uint64(43))) ^ w
    return h


def folded_column(words: list[Column]) -> Column:
    h = words[0]
    for w in words[1:]:
        h = F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43)).bitwiseXOR(w)
    return h


def _count_phrases(k: int):
    names = [f"c{i}" for i in range(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            # sorted by most of the first word's digits, so that neighbours share it and the shuffle packs them well
            phrases = np.concatenate(held) if held else np.zeros((0, k), dtype=np.uint64)
            rest = folded(list(phrases.T[1:]))
            phrases = phrases[np.argsort((phrases[:, 0] & ~np.uint64(0xFFFFFF)) | (rest >> np.uint64(40)))]
            new = np.ones(len(phrases), dtype=bool)
            new[1:] = (phrases[1:] != phrases[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(phrases)))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(phrases[first, i].view(np.int64)) for i in range(k)] + [pa.array(n.astype(np.int64))],
                names=[*names, "n"])

        for batch in _slices(batches):
            held.append(_joined(batch, k)[2])
            size += len(held[-1])
            if size >= HELD:
                yield flush()
                size = 0
        yield flush()
    return count


def phrase_counts(relation: DataFrame, k: int, min_count: int) -> DataFrame:
    """(c0, .., n) of the phrases of k words with min_count occurrences or more. relation: R(k-1) with R1."""
    names = [f"c{i}" for i in range(k)]
    each = relation.mapInArrow(_count_phrases(k), ", ".join(f"{c} long" for c in names) + ", n long")
    return each.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _next_relation(k: int, frequent):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        for batch in _slices(batches):
            rows, at, phrases, rows1, at1, words = _joined(batch, k)
            kept = has(bits, folded(list(phrases.T)))
            rows, at, phrases = rows[kept], at[kept], phrases[kept]
            after = np.isin((rows1 << 32) + at1, (rows << 32) + at + k)
            n = batch.num_rows
            cuts, cuts1 = np.searchsorted(rows, np.arange(n + 1)), np.searchsorted(rows1[after], np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([
                _lists(at, cuts), _lists(np.ascontiguousarray(phrases).view(np.int64).ravel(), cuts * k),
                _lists(at1[after], cuts1), _lists(words[after], cuts1)],
                names=["at", "phrase", "at1", "word"])
    return extend


def _written_relation(relation: DataFrame, folder: str | None) -> DataFrame:
    """Written in the order of places, packed well, and read again."""
    path = shared_folder(relation.sparkSession, folder)
    relation.filter(F.size("at") > 0).write.option("compression", "zstd").parquet(path)
    return relation.sparkSession.read.schema(relation.schema).parquet(path)


# -- scores ------------------------------------------------------------------------------

def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exact: the products are decimals of 38 digits."""
    wide = a.cast("decimal(18,0)")
    over = wide * wide * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", over, left.cast("decimal(18,0)") * right.cast("decimal(18,0)"))


def _names(k: int) -> list[str]:
    return [f"c{i}" for i in range(k)]


def _scored(found: dict[int, DataFrame], k: int) -> DataFrame:
    """The phrases of k words with the counts l and r of their lowest-scoring cut, the first of equals."""
    scored = found[k].withColumnRenamed("n", "a")
    for cut in range(1, k):
        for side, lo, hi in (("l", 0, cut), ("r", cut, k)):
            part = found[hi - lo].select(*[F.col(f"c{i}").alias(f"_c{lo + i}") for i in range(hi - lo)],
                                         F.col("n").alias(f"{side}{cut}"))
            on = [F.col(f"c{i}") == F.col(f"_c{i}") for i in range(lo, hi)]
            scored = scored.join(part, on).drop(*[f"_c{i}" for i in range(lo, hi)])
    # by score, then by cut
    cuts = F.array_min(F.array(*[F.struct(
        _score(F.col("a"), F.col(f"l{c}"), F.col(f"r{c}")).cast("long").alias("score"), F.lit(c).alias("cut"),
        F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]))
    return scored.withColumn("best", cuts).select(*_names(k), "a", "best.l", "best.r", "best.score")


def _uncovered(candidates: DataFrame, k: int, found: dict[int, DataFrame], covered: int) -> DataFrame:
    """Candidates of k words that no longer candidate around them covers."""
    for longer in range(k + 1, max(found) + 1):
        inside = [found[longer].select(*[F.col(f"c{s + i}").alias(f"_c{i}") for i in range(k)], "n")
                  for s in range(longer - k + 1)]
        most = inside[0]
        for part in inside[1:]:
            most = most.union(part)
        most = most.groupBy(*[f"_c{i}" for i in range(k)]).agg(F.max("n").alias("_n"))
        candidates = (candidates.join(most, [F.col(f"c{i}") == F.col(f"_c{i}") for i in range(k)], "left")
                      .filter(F.col("_n").isNull() | (F.lit(100) * F.col("_n") < F.lit(covered) * F.col("a")))
                      .drop("_n", *[f"_c{i}" for i in range(k)]))
    return candidates


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS,
                 min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED,
                 folder: str | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each lang by score, then a, then phrase.

    A phrase is 2 to most_words consecutive words of a piece with min_count occurrences (a) in its lang; l and r count
    the parts of its lowest-scoring cut; n is the lang's number of words. Phrases inside a longer one that has
    `covered` percent of their occurrences are left out. NULL text is empty, a NULL lang is `und`. Rows that repeat
    count each time, ids play no part. An empty table and texts without words give no rows; other columns are left
    out. A text is held whole by one task, whatever its length; phrases of a lang tie only if they are the same.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                        full_text(F.col(text_col)).alias("text"))
    every, salt = vocabulary(texts, folder)
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    words = every.filter(F.col("n") >= min_count)
    found = {1: words.select(F.col("code").alias("c0"), "n")}
    frequent = spark.sparkContext.broadcast(bits_of(words, "code"))
    relation = _written_relation(texts.mapInArrow(_first_relation(salt, frequent), FIRST), folder)
    for k in range(2, most_words + 1):
        found[k] = written(phrase_counts(relation, k, min_count), folder)
        if k < most_words:
            hashed = found[k].select(folded_column([F.col(c) for c in _names(k)]).alias("hash"))
            frequent = spark.sparkContext.broadcast(bits_of(hashed, "hash"))
            relation = _written_relation(relation.mapInArrow(_next_relation(k, frequent), RELATION), folder)
    candidates = None
    for k in range(2, most_words + 1):
        kept = _uncovered(_scored(found, k), k, found, covered)
        for i in range(k):
            named = words.select(F.col("code").alias(f"_c{i}"), F.col("word").alias(f"w{i}"),
                                 *[F.col("lang")] * (i == 0))
            kept = kept.join(named, F.col(f"c{i}") == F.col(f"_c{i}"))
        kept = kept.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(k)]).alias("phrase"), "a", "l", "r",
                           "score")
        candidates = kept if candidates is None else candidates.union(kept)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
