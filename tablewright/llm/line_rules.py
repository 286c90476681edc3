"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each line is normalised and hashed, the distinct documents that hold it are counted per host, lines above the host's
limit are taken out, and documents with too little left are rejected. Lines are held once for each distinct text, with
the number of documents behind it, so that copies are counted and not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WORD_CHAR, full_text, let, match, words, written

#: A line is common when more documents of its host hold it than the larger of both.
MIN_DOCUMENTS = 20
MIN_SHARE = 0.02
#: A document is depleted when a smaller share of its words is left.
LEAST_LEFT = 0.5
#: Base rules: fewest words, largest percentage of words in repeated windows.
LEAST_WORDS = 50
MOST_REPEATED = 50

SYMBOLS = "#*$%&|<>"


def normal_words(line: Column) -> Column:
    """A line's words in lower case with every digit as 0; equal lists are equal normal lines."""
    return words(F.translate(F.lower(line), "123456789", "000000000"))


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are hashed, sorted with their positions and compared with their neighbours: n log n steps for a text
    of any length, nothing shuffled.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(
        F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(s: Column) -> Column:
        def equal(i: Column, j: Column) -> Column:
            return (F.get(s, i)["h"] == F.get(s, j)["h"]).eqNullSafe(True)

        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: equal(i, i - 1) | equal(i, i + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(
            *[F.get(s, i)["p"] + F.lit(k) for k in range(3)])))))

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, covered)).otherwise(0)

    return F.when(F.size(w) >= 3, let(hashes, counted)).otherwise(0)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    body = full_text(F.col(text))
    of_words = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD_CHAR))
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return (docs.withColumn("_of", of_words).withColumn("n_dup_lines", dup_lines)
            .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"))
            .select(*docs.columns, "_of.n_words", "_of.word_chars", "n_symbols", "n_dup_lines",
                    "_of.n_repeat_words"))


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words")))


def documents_of(rows: DataFrame) -> DataFrame:
    """(host, body, documents): how many documents with a word have a text; rows (doc_id, host, body, text) that repeat
    an id and a text are one document, those without an id one for each text."""
    return (rows.filter(full_text(F.col("text")).rlike(WORD_CHAR)).select("host", "body", "doc_id").distinct()
            .groupBy("host", "body").agg(F.count(F.lit(1)).alias("documents")))


def common_lines(lines: DataFrame, documents: DataFrame, min_documents: int = MIN_DOCUMENTS,
                 min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line) held by more documents of the host than the limit.

    lines: one row per (host, body, line), body being a hash of a document's text; documents: as documents_of gives
    them. A hot line is counted in parts on every task before its counts meet.
    """
    held = (match(lines, documents, ["host", "body"], "inner").groupBy("host", "line")
            .agg(F.sum("documents").alias("held")).filter(F.col("held") > min_documents))
    hosts = documents.groupBy("host").agg(F.sum("documents").alias("of"))
    return match(held, hosts, ["host"], "inner").filter(F.col("held") > F.col("of") * min_share).select("host", "line")


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE,
               least_left: float = LEAST_LEFT, folder: str | None = None) -> DataFrame:
    """One row per input row: doc_id, base counts, base_failed, n_common_words, kept.

    NULL text has no words and fails; NULL hosts form one host; rows with NULL or repeated ids are judged one by
    one, rows equal in id, text and host get equal results and count as one document. Copies of a text under other ids
    are documents of their own: where they pass the limit, all of their lines are common and all of them go. An empty
    table gives no rows. Other columns are left.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    body = F.xxhash64(full_text(F.col("text")), F.length(full_text(F.col("text"))))
    base = base_counts(rows).select("doc_id", "host", body.alias("body"), "n_words", "word_chars", "n_symbols",
                                    "n_dup_lines", "n_repeat_words")
    split = F.filter(F.split(full_text(F.col("text")), "\n"), lambda line: line.rlike(WORD_CHAR))
    each = (rows.select("host", body.alias("body"), split.alias("split"))
            .select("host", "body", F.explode("split").alias("line"))
            .select("host", "body", normal_words(F.col("line")).alias("line"))
            .select("host", "body", F.xxhash64("line").alias("line"), F.size("line").alias("words")))
    # max: rows that repeat a text give the same number more than once
    lines = written(each.groupBy("host", "body", "line").agg(
        F.max("words").alias("words"), F.count(F.lit(1)).alias("times")), folder)
    documents = written(documents_of(rows.withColumn("body", body)), folder)
    common = common_lines(lines, documents, min_documents, min_share)
    texts = rows.select("host", body.alias("body")).groupBy("host", "body").agg(F.count(F.lit(1)).alias("rows"))
    found = match(lines, common, ["host", "line"], "inner")
    lost = match(found.groupBy("host", "body").agg(F.sum(F.col("words") * F.col("times")).alias("lost")),
                 texts, ["host", "body"], "inner")
    # written, so that the join below can split a text with very many copies
    lost = written(lost.select("host", "body", (F.col("lost") / F.col("rows")).cast("long").alias("lost")), folder)
    joined = match(base, lost, ["host", "body"]).withColumn(
        "n_common_words", F.coalesce("lost", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_common_words")
    return (joined.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * least_left))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "n_common_words", "kept"))
