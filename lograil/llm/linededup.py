"""Line dedup: repeated runs of lines by a suffix array over line ids, all in DataFrame operations.

Every line that is not blank is named by 128 bits of hashes of its text, and has a rank among the lines that occur again; a document is its sequence of ranks. Lines that occur
once end a run, so only stretches of repeated lines enter the suffix array. Prefix doubling ranks their suffixes: with
ranks by the first k lines, the pair (rank at i, rank at i + k) ranks by the first 2k, until no two suffixes that agree go
on. The suffixes that agree in their first k lines are an interval of the array whose longest common prefix is at least
k; its first occurrence in (document, position) order is kept, and the later ones are copies of k lines each. The lines
covered by such copies are exactly those of later copies of maximal repeated runs of k lines or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lograil.llm._common import exclusive_prefix, materialize, word_count

#: Columns that name a document inside: id and hash of the text, so that rows with the same id and another text differ.
DOC = ["doc", "th"]


def _lines(text):
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def stretches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, th, seg, pos, rank, words of each line that occurs more than once; seg numbers unbroken stretches."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    names = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")]
    lines = base.select("doc", "th", "pos", *names, F.least(word_count(F.col("line")), F.lit(1 << 30)).cast("int").alias("words"))
    often = lines.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1")
    ranked = exclusive_prefix(often, ["h", "g"], "c", "rank").select("h", "g", "rank")
    kept = lines.join(ranked, ["h", "g"]).dropDuplicates([*DOC, "pos"])
    by_doc = Window.partitionBy(*DOC).orderBy("pos")
    return kept.withColumn("seg", F.col("pos") - F.row_number().over(by_doc)).select(*DOC, "seg", "pos", "rank", "words")


def intervals(suffixes: DataFrame, depth: int) -> DataFrame:
    """Intervals of the suffix array at a depth: depth, rank, occurrences and the first one (doc, th, pos)."""
    at = F.struct(F.col("doc").isNull().alias("n"), "doc", "th", "pos")
    return suffixes.groupBy("rank").agg(F.count("*").alias("c"), F.min(at).alias("first")).where("c > 1").select(F.lit(depth).alias("depth"), "rank", "c", "first")


def double(suffixes: DataFrame, depth: int) -> DataFrame:
    """Ranks by the first 2 * depth lines from those by the first depth lines; suffixes too short for that are left out.

    Each distinct pair of ranks is counted before it is ordered, so a line that a third of all documents share is one row
    for each rank that follows it; the order is a prefix sum over range partitions.
    """
    ahead = Window.partitionBy(*DOC, "seg").orderBy("pos")
    paired = materialize(suffixes.withColumn("next", F.lead("rank", depth).over(ahead)).where("next is not null"), "paired")
    counted = paired.groupBy("rank", "next").agg(F.count("*").alias("c"))
    ranked = exclusive_prefix(counted, ["rank", "next"], "c", "new").select("rank", "next", F.col("new").alias("_new"))
    return materialize(paired.join(ranked, ["rank", "next"]).select(*DOC, "seg", "pos", F.col("_new").alias("rank"), "words"), "suffixes")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """doc, th, pos, depth: the longest power-of-two stretch of lines from pos on that is a later copy and counts.

    It counts with min_lines lines or, being one line, with min_words words. Doubling ends when no suffixes agree further.
    """
    suffixes, depth, found = materialize(stretches(docs, id_col, text_col), "suffixes"), 1, None
    while True:
        here = F.struct(F.col("doc").isNull().alias("n"), "doc", "th", "pos")
        groups = materialize(intervals(suffixes, depth), "intervals")
        later = suffixes.join(groups, "rank").where(here > F.col("first"))
        if depth < min_lines:
            later = later.where(F.col("words") >= min_words) if depth == 1 else later.where(F.lit(False))
        later = later.select(*DOC, "pos", "depth")
        found = later if found is None else found.unionAll(later)
        if groups.isEmpty():
            break
        suffixes, depth = double(suffixes, depth), 2 * depth
    return found.groupBy(*DOC, "pos").agg(F.max("depth").alias("depth"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """doc, th, removed (sorted array of line numbers, blank lines not counted) and longest_run, for documents with any."""
    if min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    marks = copies(docs, id_col, text_col, min_lines, min_words)
    before = Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("pos") > F.max(F.col("pos") + F.col("depth")).over(before), F.lit(True))
    island = marks.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.groupBy(*DOC, "run").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("depth") - 1).alias("hi"))
    return runs.groupBy(*DOC).agg(F.array_sort(F.flatten(F.collect_list(F.sequence("lo", "hi")))).alias("removed"), F.max(F.col("hi") - F.col("lo") + 1).alias("longest_run"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, longest_run (lines removed in a row) and the text left.

    A text that loses no line stays as it is; of others the remaining lines that are not blank are joined by newlines.
    Null texts have no lines and stay null; rows that repeat an id and a text count as one document and get the same
    result; null ids are a document behind all others; other columns are not read; an empty table gives no rows.
    """
    out = _cleaned(docs, id_col, text_col, min_lines, min_words)
    return out.select(F.col("_id").alias("doc_id"), "n_lines", "n_removed", "longest_run", F.col("_clean").alias("text"))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_words: int) -> DataFrame:
    found = materialize(removed_lines(docs, id_col, text_col, min_lines, min_words), "removed")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("doc")) & (F.xxhash64("_text") == F.col("th")), "left")
    lines = _lines(F.col("_text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    text = F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")
    gone = F.coalesce(F.size("removed"), F.lit(0))
    clean = F.when(F.col("removed").isNull(), F.col("_text")).when(F.size("removed") >= F.size(lines), F.lit("")).otherwise(text)
    return joined.select("_row", "_id", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.greatest(gone, F.lit(0)).cast("long").alias("n_removed"), F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"), clean.alias("_clean"))


def keep_deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """docs with the cleaned texts; documents of which every line was a later copy go. All columns are kept.

    Null and empty texts have no lines and stay as they are. Rows that agree in id and text are one document, of which all
    stay or go; a null id comes first. Extra columns stay as they are; an empty table gives no rows.
    """
    out = _cleaned(docs, id_col, text_col, min_lines, min_words).where("n_removed = 0 or _clean <> ''")
    cols = [F.col("_clean").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols)
