"""Host-level quality rules with DataFrame functions only.

Each document gets its measures and base rules. Rule failures are counted by
domain; a domain's failure rate is shrunk towards the corpus rate with a beta
prior fitted to the domains by moments; a domain whose shrunk rate of any rule
exceeds ``MAX_RATE`` is rejected, and the verdicts are joined back to documents.

A null text has no words (so it fails the base rules), a null domain is a domain
of its own, repeated rows count as often as they occur, other columns are kept
aside. With no rows at all the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assaykit.llm.common import SPACES, WORD_SPLIT, written

MIN_WORDS = 50
#: Largest share, in percent, of a text's words that may stand in repeated 3-word windows.
MAX_REPEAT_PCT = 50
#: A domain is rejected when the shrunk failure rate of a rule is above this.
MAX_RATE = 0.8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (row by row, no shuffle).

    Repeated 3-word windows are found by sorting a text's window hashes (64 bits) with their
    positions, n log n in its words; the sort is skipped for texts whose windows are all distinct.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    at = F.struct(*keep).alias("_row")
    words = docs.select(at, text.alias("_t"), F.array_remove(F.split(text, WORD_SPLIT), "").alias("_w"))
    w = F.col("_w")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1,
                      F.greatest(F.size(w) - 2, F.lit(0)))
    hashed = words.select("_row", F.size(w).cast("long").alias("n_words"),
                          F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                          F.regexp_count(F.col("_t"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                          lines.alias("_lines"), windows.alias("_h"))
    h = F.col("_h")
    counted = hashed.select(
        "_row", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(
            h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_p"))
    p = F.col("_p")
    again = counted.withColumn("_at", F.sort_array(F.transform(F.filter(p, lambda e, k: (
        e["h"].eqNullSafe(F.get(p, k - 1)["h"]) | e["h"].eqNullSafe(F.get(p, k + 1)["h"]))), lambda e: e["i"])))
    a = F.col("_at")
    covered = F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1), x + 3) - x)),
                          F.lit(0), lambda n, x: n + x)
    done = again.select("_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # The generator keeps the optimizer from pushing filters on a measure below, where it would be spelled out again and again.
    return done.withColumn("base_failed", base_failed()).select(F.inline(F.array(F.struct("*"))))


def failures() -> dict[str, Column]:
    """Base rules by name: true where a measured document fails."""
    return {"short": F.col("n_words") < MIN_WORDS,
            "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")}


def base_failed() -> Column:
    short, repetitive = failures().values()
    return short | repetitive


def host_verdicts(docs: DataFrame, host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """host, n_docs, rate_<rule> (shrunk) and host_kept, one row per domain of measured documents.

    The prior of a rule is Beta(m * nu, (1 - m) * nu): m the failure rate over all documents, nu from
    the spread of the domains' rates, weighted by their documents (no spread: full shrinkage to m).
    Counts are combined before they are shuffled, so a domain with most documents is one row a task.
    """
    rules = failures()
    hosts = docs.groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("n_docs"), *[F.count_if(v).alias(f"n_{k}") for k, v in rules.items()])
    n, total = F.col("n_docs"), F.sum("n_docs")
    prior = hosts.agg(*[c for k in rules for c in (
        (F.sum(f"n_{k}") / total).alias(f"m_{k}"),
        (F.sum(F.col(f"n_{k}") * F.col(f"n_{k}") / n) / total
         - (F.sum(f"n_{k}") / total) * (F.sum(f"n_{k}") / total)).alias(f"v_{k}"))])

    def shrunk(k: str) -> Column:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        nu = F.greatest(m * (1 - m) / v - 1, F.lit(0.0))
        return F.when(v <= 1e-12, m).otherwise((F.col(f"n_{k}") + m * nu) / (n + nu)).alias(f"rate_{k}")

    rated = hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", *[shrunk(k) for k in rules])  # one row
    worst = F.greatest(*[F.col(f"rate_{k}") for k in rules])
    return rated.withColumn("host_kept", worst <= max_rate)


def judged(docs: DataFrame, hosts: DataFrame, host_col: str = "source") -> DataFrame:
    """Measured documents with ``kept``: the base rules hold and the document's domain is not rejected."""
    verdicts = hosts.select(F.col("host").alias("_host"), "host_kept")
    return (docs.join(verdicts, F.col(host_col).eqNullSafe(F.col("_host")), "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True)))
            .drop("_host", "host_kept"))


def quality_report(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs`` (doc_id, text, source).

    The measures (a few numbers a document) are written to the shared folder once and read by both
    the counts and the join.
    """
    measures = written(measured(docs.select("doc_id", "text", "source")).drop("text"), "host-measures")
    hosts = written(host_verdicts(measures, max_rate=max_rate), "host-verdicts")
    return judged(measures, hosts).select("doc_id", *MEASURES, "kept")


def keep_good(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were (a text-free pass counts the domains first).

    The row travels as one struct, so columns of it named like a measure keep their own values.
    """
    measures = measured(docs.select("text", "source")).drop("text")
    hosts = written(host_verdicts(measures, max_rate=max_rate), "host-verdicts")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text", "source")
    return judged(measured(whole), hosts).filter("kept").select("_doc.*")
