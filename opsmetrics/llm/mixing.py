"""Mixing sources to target weights by entropy balancing.

A document may be taken up to ``limit`` times. Of all rates that give each source
its target of words, those with the smallest relative entropy to one copy of
each document are ``min(limit, exp(t * size))``, with a tilt t for each source. The
tilts solve the convex dual, whose gradient is the words at these rates minus
the target.

1. An aggregate counts documents by source and size. A rate depends on these two
   only, so everything after it works on that small frame.
2. Targets: shares by weight, held at ``limit`` times a source's words; the excess
   goes to the others by weight until none is above its limit.
3. Newton iterations for all sources at once: an aggregate gives gradient and
   curvature, a step outside the source's bracket is replaced by its middle. Terms
   are summed as decimals, so no result depends on the order of the rows.
4. Rounding: from large sizes to small, the fractions of copies carry over, so the
   copies of a source are never more than half a copy away from the rates. What the
   source's words then lack or exceed is made up with copies of whole documents,
   from large sizes to small again.
5. The copies of a size are dealt to its documents in the order of their ids.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.common import Shared
from opsmetrics.llm.ordering import number_within, place_in_key

_BLANK = " \t\n\x0b\x0c\r"
_BREAK = r"[\x20\x09-\x0D]+"
_EXACT = "decimal(38,9)"


def count_words(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_BLANK))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, _BREAK))).cast("long")


def set_targets(sources: DataFrame, weights: list[float], limit: int, shared: Shared) -> DataFrame:
    """``sources`` (``key``, ``words``) with ``target``: shares of all words by weight, at most ``limit`` times the source's.

    Sources in the order of their key weigh ``weights``, repeating. Each round
    holds the sources above their limit there and deals the rest to the others; the
    share per weight only rises, so it ends when no further source is above.
    """
    rows, spans = number_within(sources, [], [F.col("key")], shared)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place_in_key(), F.lit(len(weights))) + 1).cast("int"))
    weighed = shared.table(rows.join(spans, "part").select("key", "words", weight.alias("weight")))
    top = F.col("words") * limit
    share, held = 0.0, -1
    while True:
        above = top <= F.col("weight") * F.lit(share)
        total, fixed, rest, now = weighed.agg(
            F.sum("words"),
            F.coalesce(F.sum(F.when(above, top)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight").cast(_EXACT))), F.lit(0)).cast("double"),
            F.count_if(above),
        ).first()
        if now == held or not rest:
            break
        share, held = (total - fixed) / rest, now
    return weighed.select("key", "words", F.least(top.cast("double"), F.col("weight") * F.lit(share)).alias("target"))


def solve_tilts(classes: DataFrame, sources: DataFrame, limit: int, shared: Shared, tolerance: float = 1e-9, rounds: int = 80) -> DataFrame:
    """``sources`` (``key``, ``words``, ``docs``, ``smallest``, ``target``) with ``tilt``.

    ``classes`` has ``key``, ``size`` and the number of documents, ``docs``. Sizes are
    in units of the source's mean, so tilts are of the order of 1. A source at its
    limit needs no tilt (null): all its rates are the limit. The bracket is halved
    at least every other round, so ``rounds`` is a bound that is not met in practice.
    """
    mean = F.col("words") / F.col("docs")
    ratio = F.col("target") / F.col("words")
    # at these tilts the rates of all sizes are on one side of the ratio
    edge = lambda r: F.log(r) * mean / F.col("smallest")
    state = shared.table(
        sources.select(
            "key", "words", "docs", "smallest", "target",
            F.when(F.col("target") < F.col("words") * limit, 0.0).alias("tilt"),
            F.when(ratio < 1, edge(ratio)).otherwise(0.0).alias("low"),
            F.when(ratio < 1, 0.0).otherwise(edge(F.lit(float(limit)))).alias("high"),
            F.lit(False).alias("done"),
        )
    )
    x = F.col("size") * F.col("docs") / F.col("words")
    rate = F.least(F.lit(float(limit)), F.exp(F.least(F.col("tilt") * x, F.lit(log(limit) + 1))))
    carried = [c for c in state.columns if c != "key"]
    for _ in range(rounds):
        sums = (
            classes.withColumnRenamed("docs", "n")
            .join(state.where("tilt is not null and not done"), "key")
            .groupBy("key")
            .agg(
                F.sum((F.col("n") * F.col("size") * rate).cast(_EXACT)).cast("double").alias("at"),
                F.sum(F.when(rate < limit, F.col("n") * F.col("size") * x * rate).otherwise(0.0).cast(_EXACT)).cast("double").alias("slope"),
            )
        )
        gap = F.col("at") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.try_divide(F.col("tilt") * F.col("slope") - gap, F.col("slope"))
        inside = (newton > F.col("_low")) & (newton < F.col("_high"))
        solved = F.abs(gap) <= F.col("target") * tolerance
        stepped = state.join(sums, "key", "left").withColumns({"_low": low, "_high": high}).withColumns(
            {
                "_tilt": F.when(F.col("at").isNull() | solved, F.col("tilt"))
                .when(inside, newton)
                .otherwise((F.col("_low") + F.col("_high")) / 2),
                "_done": F.col("at").isNull() | solved,
            }
        )
        renamed = {"tilt": "_tilt", "low": "_low", "high": "_high", "done": "_done"}
        state = shared.table(stepped.select("key", *(F.col(renamed.get(c, c)).alias(c) for c in carried)))
        if not state.where("not done").limit(1).count():
            break
    return state


def round_copies(classes: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """``classes`` (``key``, ``size``, ``docs``) with ``copies``: how many copies all documents of a size have together.

    Fractions carry over from the larger size to the next; then copies are added
    or taken back, again from large to small, while a whole one fits into what is
    missing or too much. A source has as many classes as different sizes,
    however many documents.
    """
    x = F.col("size") * F.col("n") / F.col("words")
    rate = F.when(F.col("tilt").isNull(), F.lit(float(limit))).otherwise(
        F.least(F.lit(float(limit)), F.exp(F.least(F.col("tilt") * x, F.lit(log(limit) + 1))))
    )
    falling = Window.partitionBy("key").orderBy(F.desc("size"))
    half = F.lit("0.5").cast(_EXACT)
    dealt = (
        classes.join(sources.withColumnRenamed("docs", "n"), "key")
        .withColumn("want", (rate * F.col("docs")).cast(_EXACT))
        .withColumn("sum", F.sum("want").over(falling))
        .withColumn("copies", (F.floor(F.col("sum") + half) - F.floor(F.col("sum") - F.col("want") + half)).cast("long"))
        .select("key", "target", "size", "docs", "copies")
    )
    listed = dealt.groupBy("key", "target").agg(  # of one source
        F.sort_array(F.collect_list(F.struct("size", "docs", "copies")), asc=False).alias("classes"),
        F.sum(F.col("size") * F.col("copies")).alias("words"),
    )
    start = F.struct(
        (F.col("target") - F.col("words")).alias("lacks"), F.expr("CAST(array() AS array<struct<size:long,change:long>>)").alias("changes")
    )

    def mend(acc: Column, c: Column) -> Column:
        whole = (F.signum(acc["lacks"]) * F.floor(F.abs(acc["lacks"]) / c["size"])).cast("long")
        change = F.greatest(-c["copies"], F.least(whole, c["docs"] * limit - c["copies"]))
        noted = F.concat(acc["changes"], F.array(F.struct(c["size"].alias("size"), change.alias("change"))))
        return F.when(change == 0, acc).otherwise(
            F.struct((acc["lacks"] - change * c["size"]).alias("lacks"), noted.alias("changes"))
        )

    changes = listed.select("key", F.inline(F.aggregate("classes", start, mend)["changes"]))
    return dealt.join(changes, ["key", "size"], "left").select(
        "key", "size", "docs", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")
    )


def mix_sources(
    docs: DataFrame,
    weights: list[float],
    limit: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row per document: ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, with ``source`` and ``copies``.

    ``size`` is the number of words, ``source_size`` and ``target`` are the words of the
    document's source now and in the mix, ``taken`` is ``copies`` times the size.
    Sources are ordered by code point, null last, and weigh ``weights``, repeating;
    the mix has as many words as the table.

    Null and empty texts have size 0 and 1 copy, of no words. Sources without words
    have target 0. Rows with one id are documents of their own; which of several
    rows that are alike gets a further copy does not show. Very long texts count
    whole, and a document is taken as a whole or not. An empty table gives no rows;
    other columns are not read.
    """
    shared = Shared(docs.sparkSession, "mix")
    source = docs[f"`{source_col}`"].cast("string")
    # the order of sources as a text that is never null: null comes last
    key = F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))
    sized = shared.table(
        docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), key.alias("key"), count_words(docs[f"`{text_col}`"]).alias("size"))
    )
    rows, spans = number_within(sized, ["key", "size"], [F.col("id").asc_nulls_first()], shared)
    shared.drop(sized)
    classes = shared.table(spans.where("before = 0").select("key", "size", F.col("total").alias("docs")))
    filled = classes.where("size > 0")
    sources = shared.table(
        classes.groupBy("key").agg(
            F.sum(F.col("size") * F.col("docs")).alias("words"),
            F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("docs"))), F.lit(0)).alias("docs"),
            F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"),
        )
    )
    targets = shared.table(set_targets(sources.select("key", "words"), weights, limit, shared))
    tilted = solve_tilts(filled, sources.where("words > 0").join(targets.drop("words"), "key"), limit, shared)
    copies = shared.table(round_copies(filled, tilted, limit))
    # at the ranges of the numbering: no key has more rows there than ranges
    plan = spans.join(targets, "key").join(copies, ["key", "size"], "left").select(
        "part", "key", "size", "before", "start", "words", "target", "docs", "copies"
    )
    place = place_in_key()
    base = F.floor(F.col("copies") / F.col("docs"))
    own = F.when(F.col("size") == 0, 1).otherwise(base + F.when(place < F.pmod("copies", F.col("docs")), 1).otherwise(0)).cast("long")
    return rows.join(plan, ["part", "key", "size"]).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("words").alias("source_size"),
        "target",
        (own * F.col("size")).alias("taken"),
        F.when(F.col("key").startswith("0"), F.substring("key", F.lit(2), F.length("key"))).alias("source"),
        own.alias("copies"),
    )
