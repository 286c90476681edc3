"""Line dedup by winnowing over line hashes, in DataFrame functions only.

From each line on, the shortest window that counts (`run` lines, or fewer with `least_words` words) selects its line of
smallest hash as a fingerprint. Whatever run of lines two places share, if it counts, holds such a window, so both places
select the same fingerprint in it. Fingerprints that stand at one place only are dropped; those left are joined with
their positions and extended both ways to the runs of up to `run` lines around them. Equal runs meet by fingerprint and
hash, their first place stays, and the lines of all later ones go; a longer match is the union of the runs around its
fingerprints, which are never further apart than a window. No pair of places is made: a run keeps its first place only,
found in parts on each task, and later places are looked up in a written table, so that a common run can be split.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WORD_CHAR, full_text, let, match, packed, words, written

#: Lines of the shortest run that is removed, whatever it holds, and words of a shorter one that is removed.
RUN = 3
LEAST_WORDS = 50


def line_hashes(text: Column) -> Column:
    """(hash, at, words) of each line that has a word, in order; `at` is its number among all lines, from 0."""
    lines = F.transform(F.split(text, "\n"), lambda line, at: F.struct(
        F.when(line.rlike(WORD_CHAR), F.xxhash64(F.trim(line))).alias("hash"), at.alias("at"),
        F.size(words(line)).alias("words")))
    return F.filter(lines, lambda x: x["hash"].isNotNull())


def _counts(lines: Column, start: Column, size: int, run: int, least_words: int | None) -> Column:
    """Whether `size` lines from `start` on are a run that counts; NULL or false where they reach over the end."""
    inside = (start >= 0) & (start + size <= F.size(lines))
    if size == run:
        return inside
    if least_words is None:
        return F.lit(False)
    held = reduce(add, [F.coalesce(F.get(lines, start + k)["words"], F.lit(0)) for k in range(size)])
    return inside & (held >= least_words)


def minima(lines: Column, run: int, least_words: int | None) -> Column:
    """Numbers of the lines that are the smallest (the first of equals) of some shortest window that counts."""
    def smallest(i: Column) -> Column:
        size = F.lit(None).cast("int")
        for n in range(run, 0, -1):
            size = F.when(_counts(lines, i, n, run, least_words), n).otherwise(size)
        held = F.transform(F.slice(lines, i + 1, F.coalesce(size, F.lit(1))), lambda x, k: F.struct(x["hash"], (i + k).alias("p")))
        return F.when(size.isNotNull(), F.array_min(held)["p"])

    every = F.when(F.size(lines) > 0, F.transform(F.sequence(F.lit(0), F.size(lines) - 1), smallest))
    return F.array_distinct(F.filter(F.coalesce(every, F.array().cast("array<int>")), lambda p: p.isNotNull()))


def fingerprints(rows: DataFrame, run: int, least_words: int | None) -> DataFrame:
    """(doc_id, body, fingerprint, p, near) of the selected lines; near: (hash, words) of the lines around p that a run
    over p can hold, `before` of them in front of p."""
    found = let(line_hashes(F.col("text")), lambda lines: F.transform(minima(lines, run, least_words), lambda p: F.struct(
        F.get(lines, p)["hash"].alias("fingerprint"), p.alias("p"), F.least(p, F.lit(run - 1)).alias("before"),
        F.transform(F.slice(lines, F.greatest(p - run + 2, F.lit(1)), F.least(p, F.lit(run - 1)) + run),
                    lambda x: F.struct(x["hash"], x["words"])).alias("near"))))
    return (rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "body", F.explode(found).alias("f"))
            .select("doc_id", "body", "f.*"))


def _extended(run: int, least_words: int | None) -> Column:
    """Every run of up to `run` lines that counts and holds the fingerprint's line: start, lines, hash."""
    near, before, p = F.col("near"), F.col("before"), F.col("p")
    sides = [F.when(_counts(near, before - left, size, run, least_words), F.struct(
        (p - left).cast("int").alias("start"), F.lit(size).alias("lines"),
        F.xxhash64(F.transform(F.slice(near, before - left + 1, F.lit(size)), lambda x: x["hash"])).alias("hash")))
        for size in range(1, run + 1) for left in range(size)]
    return F.filter(F.array(*sides), lambda r: r.isNotNull())


def repeated_runs(rows: DataFrame, run: int, least_words: int | None, folder: str | None = None) -> DataFrame:
    """(doc_id, body, starts): (start, lines) of the runs that an earlier place holds too.

    Places are ordered by doc_id, then by start; rows: doc_id, body (hash of the text), text.
    """
    place = F.struct("doc_id", "p")
    each = fingerprints(rows, run, least_words)
    twice = (each.groupBy("fingerprint").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter(F.col("first") < F.col("last")).select("fingerprint"))
    joined = written(each.join(twice, "fingerprint", "left_semi"), folder)
    runs = joined.select("doc_id", "body", "fingerprint", F.explode(_extended(run, least_words)).alias("r")).select(
        "doc_id", "body", "fingerprint", "r.*")
    start = F.struct("doc_id", "start")
    groups = written(runs.groupBy("fingerprint", "hash", "lines").agg(F.min(start).alias("first"), F.max(start).alias("last"))
                     .filter(F.col("first") < F.col("last")).select("fingerprint", "hash", "lines", "first"), folder)
    later = match(runs, groups, ["fingerprint", "hash", "lines"], "inner").filter(start > F.col("first"))
    return later.groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "lines")).alias("starts"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
           least_words: int | None = LEAST_WORDS, folder: str | None = None) -> DataFrame:
    """(row, text, n_removed): each input row as a struct, its new text and how many lines went."""
    whole = docs.select(packed(docs).alias("row"))
    text = F.col("row").getField(text_col)
    body = F.xxhash64(full_text(text))
    rows = whole.select(F.col("row").getField(id_col).alias("doc_id"), full_text(text).alias("text"), body.alias("body"))
    found = repeated_runs(rows, run, least_words, folder).withColumnsRenamed({"doc_id": "place", "body": "of"})
    joined = whole.withColumn("body", body).join(
        found, (F.col("row").getField(id_col) == F.col("place")) & (F.col("body") == F.col("of")), "left")

    def cut(hashed: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.transform(
            F.sequence(s["start"], s["start"] + s["lines"] - 1), lambda k: F.get(hashed, k)["at"]))))
        return let(F.sort_array(gone), lambda g: F.struct(
            F.array_join(_without(F.split(text, "\n"), g), "\n").alias("text"), F.size(g).cast("long").alias("n")))

    new = F.when(F.col("starts").isNotNull(), let(line_hashes(text), cut))
    return joined.withColumn("new", new).select(
        "row", F.coalesce("new.text", text).alias("text"), F.coalesce("new.n", F.lit(0).cast("long")).alias("n_removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
               least_words: int | None = LEAST_WORDS, folder: str | None = None) -> DataFrame:
    """The input rows and columns with later repeated runs of lines taken out of the text, and _n_removed (long).

    A line (trimmed; lines without a word stand outside all runs and always stay) goes when a run that covers it begins
    at an earlier place too: in a document with a smaller id, or further up in the same one. A run is `run` consecutive
    lines, or fewer, a single one too, that hold `least_words` words (None: only `run` lines count). NULL text stays
    NULL. A row with a NULL id keeps its lines and does not count. Rows that repeat an id are one place: both keep what
    no earlier place holds. Shorter texts and empty tables pass unchanged. Columns may have any names; an input column
    _n_removed gives way to the operator's.
    """
    out = edited(docs, id_col, text_col, run, least_words, folder)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                        for c in docs.columns if c != "_n_removed"], F.col("n_removed").alias("_n_removed"))


def _without(lines: Column, gone: Column) -> Column:
    """Lines whose number is not in the sorted list `gone`: the pieces between its neighbours."""
    edges = F.concat(F.array(F.lit(-1)), gone)
    return let(edges, lambda e: let(lines, lambda x: F.flatten(F.transform(e, lambda at, k: F.slice(
        x, at + 2, F.greatest(F.lit(0), F.coalesce(F.get(e, k + 1), F.size(x)) - at - 1))))))
