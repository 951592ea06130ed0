"""Source divergence audit: how far each source's words are from its language's other sources and from the language.

Identical texts of a language are collapsed first: one shuffle brings each distinct text
once (copies are combined before it), digest-only aggregates bring its multiplicity in
every source, and it is tokenized once with its counts and document frequencies weighted
by them. Counts go on as (lang, source, term) rows, combined in the task before the
shuffle.

A language keeps the terms that at least ``MIN_DOCS`` of its documents hold. A group of a
language (one of its sources, or all of it) gives a kept term that occurs ``count`` times
there ``p = 1 + floor(SCALE * (count + 1) / (N + V))``, N the group's occurrences of the V
kept terms. ``f(p, q) = floor((p - q)**2 / q)``.

* ``pair``: for each two sources of a language the sum of f over all kept terms. Absent
  terms have one p for a whole group, so the sum is V times f of the two absent values,
  corrected by each group's histogram of counts (few rows a group) and, for the terms that
  both hold, by a join on the term. Each unordered pair is met once for both directions;
  the pairs of sources are the result itself, never pairs of documents.
* ``term``: each source's kept terms that it uses more than the language, the first
  ``TOP`` by f; a rank limit that Spark applies before the shuffle.

All arithmetic is exact: p by decimals of 38 digits
where a long does not hold it; p is at most SCALE + 1, so a square is
below 2**63, and a group's values add up to at most SCALE + V, which bounds every sum of f.

Null text, lang and source count as ''. Groups without a term still are groups; a language
without kept terms has pair values of 0; rows count one by one, equal or not; without rows
the result is empty. Columns other than text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assaykit.llm.common import written

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Entries of a task's term counts (and bytes of their terms) that are held before they are passed on.
HELD, HELD_BYTES = 1 << 19, 1 << 25

#: Bytes of a term stay (A-Z lower-cased; all bytes of characters beyond ASCII); all others become spaces.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                     ("docs", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def _passed_on(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in held.items():
        n = len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n),
             pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()),
             pa.array(list(map(docs.__getitem__, counts)), pa.int64())], schema=_COUNTS)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document frequencies of distinct texts, times the text's multiplicity in each source."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = size = 0
    for batch in batches:
        for lang, text, sources in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            terms = terms_of(text.as_py())
            once = set(terms)
            for of in sources:
                counts, docs = held.setdefault((lang, of["source"]), (Counter(), Counter()))
                before, times = len(counts), of["copies"]
                if times == 1:
                    counts.update(terms)
                    docs.update(once)
                else:
                    for term, n in Counter(terms).items():
                        counts[term] += n * times
                        docs[term] += times
                entries += len(counts) - before
            size += sum(map(len, once))
            if entries > HELD or size > HELD_BYTES:
                yield from _passed_on(held)
                held, entries, size = {}, 0, 0
    yield from _passed_on(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of each source of each language.

    The rows are dealt by language and term: a task has combined its texts' counts before, so a term has at most one
    row for each task's pass and source.
    """
    rows = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = rows.select("lang", "digest", "text").dropDuplicates(["lang", "digest"])
    copies = (rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
              .groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("sources")))
    counted = (texts.join(copies, ["lang", "digest"]).select("lang", "text", "sources")
               .mapInArrow(_count_terms, "lang string, source string, term string, n bigint, docs bigint"))
    return (counted.repartition("lang", "term").groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count in a group of ``total`` occurrences of ``terms`` kept terms; null without terms."""
    wide = (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    fits = count < (1 << 63) // SCALE - 1           # the product stays a long
    return F.when(terms > 0, 1 + F.when(fits, F.call_function("div", (count + 1) * F.lit(SCALE).cast("long"), total + terms))
                  .otherwise(F.call_function("div", wide, (total + terms).cast("decimal(20,0)"))))


def apart(p: Column, q: Column) -> Column:
    """f(p, q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) as the module's docstring says."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    in_lang = Window.partitionBy("lang", "term")
    kept = written(term_counts(docs).withColumns({"in_docs": F.sum("docs").over(in_lang), "lang_n": F.sum("n").over(in_lang)})
                   .filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"), "kept-terms")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = (kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n"))
             .groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total")))
    nothing = F.lit(0).cast("long")
    groups = written(
        docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, nothing).alias(c) for c in ("total", "terms", "lang_total")])
        .withColumn("absent", share(nothing, F.col("total"), F.col("terms"))), "source-groups")

    told = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    return _pairs(told, groups).unionByName(_terms(told, top))


def _terms(told: DataFrame, top: int) -> DataFrame:
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return (told.withColumn("q", q).filter("p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                    apart(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))


def _pairs(told: DataFrame, groups: DataFrame) -> DataFrame:
    # what one group's own terms add to a pair, by its distinct counts: against the other's absent value, both ways
    counts = told.groupBy("lang", "source", "p", "absent").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("other_absent"))
    own = (counts.join(other, "lang").filter("source != other").groupBy("lang", "source", "other").agg(
        F.sum(F.col("times") * (apart(F.col("p"), F.col("other_absent"))
                                - apart(F.col("absent"), F.col("other_absent")))).alias("held"),
        F.sum(F.col("times") * (apart(F.col("other_absent"), F.col("p"))
                                - apart(F.col("other_absent"), F.col("absent")))).alias("lacked")))
    base = (groups.select("lang", "source", "terms", "absent").join(other, "lang").filter("source != other")
            .select("lang", "source", "other", F.when(F.col("terms") > 0, F.col("terms") * apart(
                F.col("absent"), F.col("other_absent"))).otherwise(F.lit(0)).alias("value")))

    # terms that both hold, each unordered pair of sources once
    a = told.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p"), F.col("absent").alias("p0"))
    b = told.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("absent").alias("q0"))

    def both(p: str, p0: str, q: str, q0: str) -> Column:
        p, p0, q, q0 = (F.col(c) for c in (p, p0, q, q0))
        return F.sum(apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))

    shared = (a.join(b, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b")
              .agg(both("p", "p0", "q", "q0").alias("there"), both("q", "q0", "p", "p0").alias("back")))
    shared = shared.select("lang", F.inline(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("other"), F.col("there").alias("value")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("other"), F.col("back").alias("value")))))

    held = own.select("lang", "source", "other", F.col("held").alias("value"))
    lacked = own.select("lang", F.col("other").alias("source"), F.col("source").alias("other"),
                        F.col("lacked").alias("value"))
    whole = (base.unionByName(held).unionByName(lacked).unionByName(shared)
             .groupBy("lang", "source", "other").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "other")
    return whole.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value",
                        F.row_number().over(order).alias("rank"))
