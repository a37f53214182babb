"""How filters interact: what each removes, by their order, and its share over all orders.

Filters applied one after the other walk through the lattice of their subsets:
a state is the set of filters already applied, an edge applies one more. What an
edge removes depends on its state alone, not on the order that led there.

1. Each document gets the set of filters it fails, as bits. An aggregate counts
   documents by part and set: a few dozen rows for each part.
2. For each part the edges follow from these counts: an edge removes the
   documents that fail its filter and none of the state's.
3. Forward counting gives the number of orders that reach each state, backward
   counting the number that leave it. An edge lies on (orders reaching its start)
   x (orders leaving its end) orders; with that weight, the removals of a filter's
   edges add up to its removals over all orders, which are its Shapley value
   times the number of orders.
4. The steps of every order are read from the same edges.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import Shared, let

BLANK = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"


def text_failures(text: Column) -> Column:
    """The failure conditions A to D of a text, in order, as an array of booleans.

    Words are the maximal runs of other characters than ``[\\x20\\x09-\\x0D]``. A: under
    100 words; B: fewer than 80 distinct words in 100; C: more than 10 capital
    letters A to Z in 100 code points; D: holds any of ``#$%&*|``. A text without
    words fails A alone.
    """
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    bare = F.btrim(text, F.lit(BLANK))
    words = F.when(bare != "", F.split(bare, WORD_BREAK)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        let(words, lambda w: F.array(F.size(w) < 100, F.size(F.array_distinct(w)) * 100 < F.size(w) * 80)),
        F.array(capitals * 100 > F.length(text) * 10, text.rlike(MARKS)),
    )


def mark_documents(
    docs: DataFrame,
    labels: DataFrame,
    shared: Shared,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """A row per document: ``part``, ``fails`` (bit i: it fails filter i) and 0 or 1 for ``good`` and ``toxic``.

    Filters 0 to 3 are those of ``text_failures``; filter 4 is failed by a text that
    is identical to that of a smaller id anywhere in the table. Texts are the same
    if their SHA-256 and length are. A hot text is one row of an aggregate, and
    the join back can be split, as that aggregate is a table.

    Null text is empty, a null part the empty string. Rows with one id are not
    smaller than each other, a row without id fails filter 4 if any id has its
    text. A document with several labels counts as good or toxic if one says so.
    """
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    checks = let(text_failures(text), lambda f: sum(((F.get(f, F.lit(i)).cast("int") * (1 << i)) for i in range(4)), F.lit(0)))
    marked = shared.table(
        docs.select(
            docs[f"`{id_col}`"].cast("long").alias("id"),
            F.coalesce(docs[f"`{part_col}`"].cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            F.octet_length(text).alias("bytes"),
            checks.alias("checks"),
        )
    )
    first = shared.table(
        marked.groupBy("digest", "bytes").agg(F.min("id").alias("first_id"), F.count("*").alias("many"))
        .where("many > 1 and first_id is not null")
        .drop("many")
    )
    known = shared.table(
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
        )
    )
    repeated = F.when(F.col("first_id").isNotNull() & F.coalesce(F.col("first_id") < F.col("id"), F.lit(True)), 16).otherwise(0)
    judged = shared.table(
        marked.join(first, ["digest", "bytes"], "left").select("id", "part", (F.col("checks") + repeated).alias("fails"))
    )
    shared.drop(marked)
    return judged.join(known, "id", "left").select(
        "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each set of ``n`` filters, how many orders of its members reach it and how many of the others leave it."""
    full = 1 << n
    reach, leave = [0] * full, [0] * full
    reach[0] = leave[full - 1] = 1
    for state in range(full):  # a state comes after all its subsets
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in reversed(range(full)):
        for f in range(n):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return reach, leave


def audit(marked: DataFrame, names: str, shared: Shared) -> DataFrame:
    """For each part, each order of the filters ``names`` and each step: what happens at that step.

    ``marked`` has ``part``, ``fails`` (bits in the order of ``names``), ``good`` and
    ``toxic``. Columns: ``part``, ``filter_order``, ``step`` (from 1), ``kept`` after the
    step, ``removed`` at it, ``redundant`` (fail its filter, were removed earlier),
    ``unique_fails`` (fail its filter only), ``good_lost`` and ``toxic_lost`` at it, and
    ``shapley``: the removals of its filter, summed over all orders.

    All orders and steps are there, with zeros too. Without documents there are no
    parts and so no rows. Counts of a part are partial aggregates, so one part may
    hold any share of the rows.
    """
    n = len(names)
    reach, leave = path_counts(n)
    counts = marked.groupBy("part", "fails").agg(
        F.count("*").alias("docs"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")
    )
    # of one part: at most a row for each set of filters
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "docs", "good", "toxic")).alias("sets"))

    bit = lambda f: F.call_function("shiftleft", F.lit(1), f.cast("int"))

    def total(sets: Column, keep, measure: str) -> Column:
        return F.aggregate(F.filter(sets, keep), F.lit(0).cast("long"), lambda acc, s: acc + s[measure])

    def edge(number: Column) -> Column:
        """Edge ``state * n + f`` applies filter f to what the state's filters left."""
        state, f = F.floor(number / F.lit(n)).cast("int"), F.pmod(number, F.lit(n))
        removes = lambda s: (s["fails"].bitwiseAND(state) == 0) & (s["fails"].bitwiseAND(bit(f)) != 0)
        kept = lambda s: s["fails"].bitwiseAND(state.bitwiseOR(bit(f))) == 0
        sets = F.col("sets")
        return F.struct(
            total(sets, removes, "docs").alias("removed"),
            total(sets, kept, "docs").alias("kept"),
            total(sets, removes, "good").alias("good_lost"),
            total(sets, removes, "toxic").alias("toxic_lost"),
        )

    weights = [reach[s] * leave[s | 1 << f] if not s >> f & 1 else 0 for s in range(1 << n) for f in range(n)]
    # a few rows for each part, written so that each edge is computed once
    edges = shared.table(parts.withColumn("edges", F.transform(F.sequence(F.lit(0), F.lit((n << n) - 1)), edge)))
    edges = edges.withColumn("weights", F.array(*(F.lit(w).cast("long") for w in weights)))
    shares = lambda f: F.aggregate(
        F.sequence(f, f + (n << n) - n, F.lit(n)),
        F.lit(0).cast("long"),
        lambda acc, e: acc + F.get("weights", e) * F.get("edges", e)["removed"],
    )
    per_filter = lambda f: F.struct(
        shares(f).alias("shapley"),
        total(F.col("sets"), lambda s: s["fails"].bitwiseAND(bit(f)) != 0, "docs").alias("fail"),
        total(F.col("sets"), lambda s: s["fails"] == bit(f), "docs").alias("unique_fails"),
    )
    orders = ",".join("".join(p) for p in permutations(names))
    filters = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), per_filter)
    steps = (
        shared.table(edges.select("part", "edges", filters.alias("filters")))
        .withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("f", F.instr(F.lit(names), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    )
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    state = sum((F.when(F.instr(earlier, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0))
    return steps.withColumn("e", F.get("edges", state * n + F.col("f"))).withColumn("own", F.get("filters", F.col("f"))).select(
        "part",
        "filter_order",
        "step",
        "e.kept",
        "e.removed",
        (F.col("own.fail") - F.col("e.removed")).alias("redundant"),
        "own.unique_fails",
        "e.good_lost",
        "e.toxic_lost",
        "own.shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of ``mark_documents``, named A to E, by language."""
    shared = Shared(docs.sparkSession, "audit")
    return audit(mark_documents(docs, labels, shared), "ABCDE", shared)
