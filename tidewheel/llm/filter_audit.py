"""Interaction of five document filters: what each removes in each of the 120 orders.

A document fails A under 200 words, B where distinct words are less than half
of its words, C where capitals are over 3 of 100 code points, D with any of
``#$%&*|``, and E where a document of smaller id has the same text. E is a
left-semi self-join on the text's hash, the exact text and the smaller id. Its
right side is aggregated first to one row a text, its smallest id, so that a
text with very many copies meets each of them once; the left side of a hot key
can be split by adaptive execution. The documents that E marks are then united
with all documents, as rows that move a document from the combination without E
to the one with it, and everything after that are counts by part, combination
of failures (32) and labels. All 120 orders are evaluated on those counts.

Only built-in functions are used. Texts are shuffled twice, once for each side
of the join (the right side after a combine in each task).

Defined cases: a null text is the empty text: no words, no code points, equal to
other empty ones; it fails A, and of two documents without text the later fails E. A
null doc_id is smaller than none and has no smaller one. Repeated rows of one
doc_id each count; they aren't copies of one another. A null lang is the part
``''``. A document without labels, or with null ones, is neither good nor toxic;
one labelled twice has a label if any row gives it. An empty table has no part
and gives no row. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters' letters; the bit of each is its place here.
FILTERS = "ABCDE"
E_BIT = 1 << FILTERS.index("E")

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    points = F.length(text)
    capitals = points - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * points, text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def later_copies(texts: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of those rows of (h, t, d, ...) whose text a row of smaller ``d`` has, too."""
    first = texts.groupBy("h", "t").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most")
    a, b = texts.alias("a"), first.alias("b")
    return a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.t") == F.col("b.t")) & (F.col("b.least") < F.col("a.d")), "left_semi").select(*keep)


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of documents that fail any filter, a row each: (doc_id, failed), the letters in order."""
    texts = docs.select(F.col(id_col).alias("d"), F.coalesce(text_col, F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    own = texts.select("d", own_failures(F.col("t")).alias("bits")).where("bits > 0")
    every = own.unionByName(later_copies(texts, ["d"]).select("d", F.lit(E_BIT).alias("bits")))
    bits = every.groupBy("d").agg(F.bit_or("bits").alias("bits"))
    letters = F.concat(*(F.when(F.col("bits").bitwiseAND(1 << k) != 0, c).otherwise("") for k, c in enumerate(FILTERS)))
    return bits.select(F.col("d").alias("doc_id"), letters.alias("failed"))


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents by part and combination of failures: (part, bits, n, good, toxic)."""
    texts = docs.select(F.col("doc_id").alias("d"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    own = lambda rows: rows.select("d", "part", own_failures(F.col("t")).alias("bits"))
    # a later copy leaves the combination without E and enters the one with it
    moves = F.array(F.struct("bits", F.lit(-1).alias("n")), F.struct((F.col("bits") + E_BIT).alias("bits"), F.lit(1).alias("n")))
    moved = own(later_copies(texts, ["d", "part", "t"])).select("d", "part", F.explode(moves).alias("x")).select("d", "part", "x.*")
    rows = own(texts).withColumn("n", F.lit(1)).unionByName(moved)
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks, rows.d == marks.doc_id, "left")
    of = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0))
    return marked.groupBy("part", "bits").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def _orders() -> Column:
    """All (filter_order, step, bit of the step's filter, bits of the filters before it): 600 constants."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, c in enumerate(order, 1):
            bit = 1 << FILTERS.index(c)
            rows.append(f"('{''.join(order)}',{step},{bit},{before})")
            before |= bit
    fields = "struct<filter_order:string,step:int,bit:int,before:int>"
    return F.expr(f"cast(array({','.join(rows)}) as array<{fields}>)")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    every = range(1 << len(FILTERS))
    held = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("bits") == k, F.col(c))), F.lit(0)) for k in every)).alias(c)
    parts = combinations(docs, labels).groupBy("part").agg(*(held(c) for c in ("n", "good", "toxic")))
    steps = parts.select("part", "n", "good", "toxic", F.explode(_orders()).alias("o")).select("part", "n", "good", "toxic", "o.*")

    def total(c: str, which: str, weight: str = "1"):
        """The counts ``c`` of the combinations k for which a condition holds."""
        return F.expr(f"aggregate(sequence(0, {len(every) - 1}), 0L, (s, k) -> s + if({which}, {c}[k] * {weight}, 0L))")

    fails, earlier = "(k & bit) != 0", "(k & before) != 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", "(k & (before | bit)) = 0").alias("kept"),
        total("n", f"{fails} and not ({earlier})").alias("removed"),
        total("n", f"{fails} and {earlier}").alias("redundant"),
        total("n", "k = bit").alias("unique_fails"),
        total("good", f"{fails} and not ({earlier})").alias("good_lost"),
        total("toxic", f"{fails} and not ({earlier})").alias("toxic_lost"),
        # of all orders of m failed filters a filter comes first in one of m
        total("n", fails, "(120 div bit_count(k))").alias("shapley"),
    )
