"""Quality rules, with DataFrame functions only: counts within a text and line frequency across documents.

A line is boilerplate of a host if enough of the host's documents hold it. Each of them but one loses it, and a
document that has lost too much of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the holders of one line are dealt for the join with the boilerplate lines.
SALTS = 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that the text has twice or more.

    Windows are sorted by hash, so equal ones are neighbours; then each repeated window at place p adds the
    words that the one before it (at most three places back) has not counted. No step compares all pairs.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), n - 3)
    windows = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    ordered = F.sort_array(windows)

    def twins(s: Column) -> Column:
        near = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(near, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        # The places of repeated windows, each with the place before it.
        steps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), p, lambda b, a: F.when(b.isNull(), 3).otherwise(F.least(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return F.when(n < 3, F.lit(0)).otherwise(let(ordered, lambda s: let(twins(s), covered)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(*keep, text.alias("_text"), words_of(text).alias("_words"), lines.alias("_lines"))
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normal(line: Column) -> Column:
    """A line's form for counting: blanks as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def hashes(line: Column) -> list[Column]:
    """Two hashes: lines are told apart by 128 bits."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def counted(lines: Column) -> Column:
    """(line, times) of each different line, found by sorting: a line's times are the places up to the next other line."""
    def starts(o: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i) != F.get(o, i - 1)))

    return let(F.array_sort(lines), lambda o: let(starts(o), lambda s: F.transform(s, lambda i, k: F.struct(F.get(o, i).alias("line"), (F.coalesce(F.get(s, k + 1), F.size(o)) - i).alias("times")))))


def boilerplate(docs: DataFrame, min_docs: int, min_share: float, most_docs: int) -> DataFrame:
    """(doc_id, host, h1, h2, n): the different lines that each document loses, and the code points of all their occurrences."""
    line = F.explode(counted(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), normal)))
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    lines = docs.select("doc_id", host.alias("host"), line.alias("x")).filter(F.col("x.line") != "")
    lines = lines.select("doc_id", "host", *hashes(F.col("x.line")), (F.length("x.line") * F.col("x.times")).alias("n"))
    sizes = docs.select(host.alias("host"), "doc_id").groupBy("host").agg(F.count_distinct("doc_id").alias("docs"))
    key = ["host", "h1", "h2"]
    counts = lines.groupBy(*key).agg(F.count_distinct("doc_id").alias("found"), F.min("doc_id").alias("first")).filter(F.col("found") >= min_docs)
    often = counts.join(sizes, "host").filter(F.col("found") >= F.least(min_share * F.col("docs"), F.lit(most_docs)))
    often = often.select(*key, "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(often, [*key, "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", *key, "n")


def lost_chars(docs: DataFrame, min_docs: int, min_share: float, most_docs: int) -> DataFrame:
    """(doc_id, lost): code points in boilerplate lines that a document loses. Documents that lose none are left out."""
    return boilerplate(docs, min_docs, min_share, most_docs).groupBy("doc_id").agg(F.sum("n").alias("lost"))


def remove_lines(docs: DataFrame, min_docs: int = 20, min_share: float = 0.01, most_docs: int = 1000) -> DataFrame:
    """(doc_id, source, text): texts without the boilerplate lines of their host, in the terms of ``judge``.

    The lines that stay are as they were and in their order; a null text stays null. Rows that share a doc_id or have none
    lose what any of them loses. The set of lines to remove is no larger than the document.
    """
    gone = boilerplate(docs, min_docs, min_share, most_docs).groupBy(F.col("doc_id").alias("_gone_id"), F.col("host").alias("_host")).agg(F.collect_set(F.struct("h1", "h2")).alias("_gone"))
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "source", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (host == F.col("_host")), "left")
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("_gone"), F.struct(*hashes(normal(x)))))
    return rows.select("doc_id", "source", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))


def judge(docs: DataFrame, min_docs: int = 20, min_share: float = 0.01, min_left: float = 0.3, most_docs: int = 1000) -> DataFrame:
    """Counts and verdict for each row: doc_id, the counts, base_failed, lost_chars and kept.

    A normalised line (blanks as one space, trimmed, lower case) is boilerplate of a host (``source``) if at least
    ``min_docs`` of its documents and a share ``min_share`` of them, or ``most_docs``, hold it. The document with the
    smallest doc_id keeps it; the others lose it, wherever they have it. A document is rejected if base_failed, or if less
    than ``min_left`` of its line characters is left. A null text has no words and fails the base rule; a null source
    is the host "". Rows that share a doc_id are one document to the line counts, and each gets its own verdict.
    Rows without a doc_id count as no document but lose boilerplate too. Other columns may have any names.
    """
    rows = text_counts(docs, "doc_id")
    lost = lost_chars(docs, min_docs, min_share, most_docs).select(F.col("doc_id").alias("_lost_id"), "lost")
    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("_lost_id")), "left").drop("_lost_id")
    rows = rows.withColumn("lost_chars", F.coalesce("lost", F.lit(0)).cast("long")).drop("lost")
    # A line's blanks count little: words and the blanks between them.
    whole = F.col("word_chars") + F.col("n_words")
    depleted = F.col("lost_chars") > (1 - min_left) * whole
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted)
