"""Quality rules as a ledger: every rule is evaluated once, policies and ablations read its bits.

The ledger has, for each document, the measurements and a long whose bit r is set if the document fails rule r. A policy is
a version, a name and the mask of rules that reject; applying it, or asking what each of its rules rejects alone, needs
no text and no rule again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measurements of the ledger, in order.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_upper_words", "n_bullet_lines", "n_ellipsis_lines"]

#: Rules in bit order: name and the condition on the measurements under which a document fails. Never reorder; append.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("too_many_words", "n_words > 1000000"),
    ("mean_word_short", "word_chars < 2 * n_words"),
    ("mean_word_long", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("few_alphabetic_words", "10 * n_alpha_words < 7 * n_words"),
    ("upper_case", "10 * n_upper_words > 5 * n_words"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]

#: Versioned policies: masks over RULES.
POLICIES: dict[int, tuple[str, int]] = {
    1: ("base", BASE),
    2: ("base and shape", BASE | BIT["mean_word_short"] | BIT["mean_word_long"] | BIT["symbols"] | BIT["few_alphabetic_words"]),
    3: ("all rules", (1 << len(RULES)) - 1),
}

_SYMBOL = re.compile(r"[#*$%&|<>]")
_ALPHA = re.compile(r"[^\W\d_]")


def measure(text: str | None) -> list[int]:
    """The measurements of one whole text, in the order of MEASURES; null and empty: zeros."""
    if not text:
        return [0] * len(MEASURES)
    lines = [(x, w) for x in text.split("\n") if (w := x.encode().split())]
    words = [w.decode() for _, ws in lines for w in ws]
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    repeated = 0
    if len(counts) < len(windows):
        twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(windows)] |= twice
        repeated = int(covered.sum())
    seen = Counter(x for x, _ in lines)
    alpha = sum(1 for w in words if _ALPHA.search(w)) if not text.isalpha() else n
    bullets = sum(1 for _, ws in lines if ws[0][:1] in (b"-", b"*") or ws[0].startswith("•".encode()))
    ellipses = sum(1 for x, _ in lines if x.rstrip().endswith(("...", "…")))
    return [n, sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(seen), repeated, len(lines), alpha, sum(1 for w in words if len(w) > 1 and w.isupper()), bullets, ellipses]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements (long) and failed_mask (long): one row for each row of docs.

    A map over Arrow batches, without a shuffle; each whole text is measured by itself. Null and empty texts measure zero
    (and fail too_few_words); repeated rows and null ids pass through; other columns are not read; an empty table gives no
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, k]) for k in range(len(MEASURES))]], names=["doc_id", *MEASURES])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = kept.mapInArrow(run, ", ".join(["doc_id long", *[f"{m} long" for m in MEASURES]]))
    mask: Column = F.lit(0).cast("long")
    for name, failed in RULES:
        mask = mask.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_mask", mask)


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version; no rule is evaluated again."""
    mask = F.col("failed_mask")
    return rows.withColumns({"base_failed": mask.bitwiseAND(F.lit(BASE)) != 0, "kept": mask.bitwiseAND(F.lit(POLICIES[version][1] | BASE)) == 0, "policy_version": F.lit(version)})


def ablation(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    Aggregates the ledger by its masks first (at most 2^rules rows, and partial aggregation before the shuffle).
    """
    policy = POLICIES[version][1]
    masks = rows.select(F.col("failed_mask").bitwiseAND(F.lit(policy)).alias("m")).groupBy("m").agg(F.count("*").alias("c"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if policy & bit])
    each = masks.select("m", "c", F.explode(rules).alias("r")).select("m", "c", "r.*")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    zero = F.lit(0).cast("long")
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("c")).otherwise(zero)).alias("failed"),
        F.sum(F.when(F.col("m") == F.col("bit"), F.col("c")).otherwise(zero)).alias("failed_alone"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("c")).otherwise(zero)).alias("kept_without"),
    )
