"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one document. The cross-document rule hashes normalised lines (lower case, white space
collapsed, trimmed) and counts, for each host, the distinct documents that hold a line. Documents are told
apart by the hash of their whole text: copies of one document do not make its own lines look like boilerplate,
but documents that differ anywhere count each, however much of them is shared. A line held by at least
``min_docs`` documents and ``min_share`` of its host's documents is removed; a document that loses more than
``max_removed`` of its characters is depleted and rejected.

Defined cases: null text has no words and fails the base rules; a null host is a host of its own; null ids
are carried; repeated rows get equal verdicts; very long texts and lines are read whole; a line exactly at both
limits is removed, a document that loses exactly ``max_removed`` is kept; an empty table gives an empty result; other input columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.llm.columns import let, unpacked, whole_row
from chromafold.llm.lineage import hold

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def window_hashes(words: Column, size: int) -> Column:
    """The hash of every run of ``size`` words; empty if there are fewer."""
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))

    return let(words, lambda w: F.when(F.size(w) >= size, hashes(w)).otherwise(F.array().cast("array<bigint>")))


def repeated_words(hashes: Column, size: int) -> Column:
    """How many words lie in a window whose hash occurs twice or more among ``hashes``."""
    def positions(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])

        return F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(p, start, lambda a, i: F.struct(
            (a["n"] + i + size - F.greatest(i, a["end"])).alias("n"), (i + size).alias("end")), lambda a: a["n"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, let(ordered, lambda s: covered(positions(s)))).otherwise(0).cast("long")


def line_hashes(text: Column) -> Column:
    """(h, n) of every line with a word: the hash and the length of its normalised form."""
    flat = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.char_length(x).alias("n")))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = 5,
               min_words: int = 10, max_repeated: int = 20) -> DataFrame:
    """The base counts of every row, its host and line hashes, and the hash of its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    split = read.select("*", F.array_remove(F.split("text", SPACE), "").alias("w"), F.split("text", "\n").alias("lines"))
    hashed = split.select("*", window_hashes(F.col("w"), window).alias("g"), F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"))
    counted = hashed.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"), F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("g"), window).alias("n_repeat_words"),
        line_hashes(F.col("text")).alias("lines"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), F.monotonically_increasing_id().alias("row"))


def frequent_lines(stats: DataFrame, min_docs: int = 20, min_share: float = 0.05) -> DataFrame:
    """(host, h) of the lines above both limits."""
    line = stats.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    held = line.groupBy("host", "h", "text_hash").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("docs"))
    held = held.where(F.col("docs") >= min_docs)
    hosts = stats.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("all_docs"))
    hosts = hosts.select(F.col("host").alias("of"), "all_docs").repartition(stats.sparkSession.sparkContext.defaultParallelism)
    return held.join(hosts, held.host.eqNullSafe(hosts.of)).where(F.col("docs") >= min_share * F.col("all_docs")).select("host", "h")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20,
             min_share: float = 0.05, max_removed: float = 0.7) -> DataFrame:
    """One row per document: the base counts, what the line rule removes (``removed``: line hashes), and the verdict."""
    stats = hold(statistics(docs, id_col, text_col, host_col))
    bad = frequent_lines(stats, min_docs, min_share).select(F.col("host").alias("bad_host"), F.col("h").alias("bad_h"))
    bad = bad.repartition(stats.sparkSession.sparkContext.defaultParallelism)
    lines = stats.select("row", "host", F.inline("lines"))
    hit = lines.join(bad, lines.host.eqNullSafe(bad.bad_host) & (lines.h == bad.bad_h))
    lost = hit.groupBy("row").agg(F.sum("n").alias("lost"), F.count("*").alias("removed_lines"), F.collect_set("h").alias("removed"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = stats.withColumn("total", total).drop("lines").join(lost.withColumnRenamed("row", "lost_row"), F.col("row") == F.col("lost_row"), "left")
    depleted = F.coalesce(F.col("lost") > max_removed * F.col("total"), F.lit(False))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"),
        F.coalesce("lost", F.lit(0)).cast("long").alias("removed_chars"), "host", "text_hash", "removed")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows that pass, with their frequent lines taken out of the text and all other columns unchanged."""
    found = verdicts(docs, id_col, text_col, host_col, **limits).where("kept")
    found = found.groupBy(F.col("doc_id").alias("of_id"), F.col("host").alias("of_host"), F.col("text_hash").alias("of_hash")).agg(F.first("removed").alias("removed"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("of_id")) & F.col("host").eqNullSafe(F.col("of_host")) & (F.xxhash64(text) == F.col("of_hash")))

    def normal(x: Column) -> Column:
        return F.xxhash64(F.trim(F.lower(F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " "))))

    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("removed"), normal(x)))
    cleaned = F.when(F.col("removed").isNull(), F.col("row").getField(text_col)).otherwise(F.array_join(left, "\n"))
    return joined.select(*unpacked(joined, **{text_col: cleaned}))
