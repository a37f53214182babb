"""A Merkle manifest of a table, with a proof for each row, by butterfly exchange.

Rows are leaves. The leaves of a group in order make a tree, and the groups'
roots in order make the tree above it; each run of ``fanout`` consecutive nodes
becomes one node until one is left.

1. Leaves are numbered within their group by ranges (``ordering``), and
   ``fanout ** height`` consecutive ones are a block: an aligned subtree, whose
   root one task computes.
2. In each round the blocks of up to ``fanout`` sibling subtrees swap roots. All
   blocks of a subtree hold its root, so a block needs only one partner in each
   sibling: blocks meet by their place (lane) in the subtree, and where a sibling
   has fewer blocks, these serve further lanes by turns. No group of the exchange
   has more than ``fanout`` rows, whatever the size of the tree.
3. Each block hashes the parent itself and notes the siblings, round by round,
   first within the group, then over the groups. After the last round every
   block knows the upper proof of its leaves; nothing is sent down again.
4. The lower levels of a leaf's proof come from its own block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.common import Shared
from opsmetrics.llm.ordering import number_within, place_in_key

_HEX = 64  # characters of a digest


def field_text(c: Column) -> Column:
    """A value as a leaf hashes it: its UTF-8 byte count, a colon and the value, or ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: lowercase hex SHA-256 of its values."""
    return F.sha2(F.concat(*(field_text(v) for v in values)).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(
        proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256)
    )


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    siblings = F.transform(proof, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def _levels(leaves: list[bytes], fanout: int, height: int, alone: bool) -> list[bytes]:
    """The digests of each level of a block, as the hex text of one level after the other.

    A block that is a whole tree ends at one node; others rise ``height`` levels.
    """
    level = b"".join(leaf.hex().encode() for leaf in leaves)
    out = [level]
    while (len(level) > _HEX) if alone else (len(out) <= height):
        runs = (level[at : at + fanout * _HEX] for at in range(0, len(level), fanout * _HEX))
        level = b"".join(sha256(run).hexdigest().encode() for run in runs)
        out.append(level)
    return out


def _block_roots(blocks: DataFrame, fanout: int, height: int) -> DataFrame:
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for leaves, count in zip(batch.column("leaves"), batch.column("blocks").to_pylist()):
                top = _levels(leaves.values.field("leaf").to_pylist(), fanout, height, count == 1)[-1]
                found.append(top.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("tree", "block", "part")] + [pa.array(found, pa.string())],
                names=["tree", "block", "part", "node"],
            )

    return blocks.mapInArrow(roots, "tree string, block long, part int, node string")


def _proofs(blocks: DataFrame, fanout: int, height: int) -> DataFrame:
    """A row per leaf with its whole proof: the block's levels, then the upper ones."""

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield of_block({c: batch.column(c)[row] for c in batch.schema.names})

    def of_block(block: dict) -> pa.RecordBatch:
        own = block["leaves"].values
        leaves = own.field("leaf").to_pylist()
        levels = _levels(leaves, fanout, height, block["blocks"].as_py() == 1)
        upper = block["path"].as_py() or []
        above = [s["left"] for s in upper], [s["right"] for s in upper]
        left, right = [], []
        for leaf in range(len(leaves)):
            node = leaf
            for level in levels[:-1]:
                first = node // fanout * fanout
                left.append(level[_HEX * first : _HEX * node].decode())
                right.append(level[_HEX * (node + 1) : _HEX * (first + fanout)].decode())
                node //= fanout
            left += above[0]
            right += above[1]
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        size = len(levels) - 1 + len(upper)
        offsets = pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * size)
        columns = {
            "id": own.field("id"),
            "leaf": pa.array([x.hex() for x in leaves]),
            "claimed_leaf": pa.array([x.hex() for x in own.field("claimed").to_pylist()]),
            "subroot": pa.array([block["subroot"].as_py()] * len(leaves)),
            "root": pa.array([block["root"].as_py()] * len(leaves)),
            "proof": pa.ListArray.from_arrays(offsets, steps),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return blocks.mapInArrow(
        proofs,
        "id long, leaf string, claimed_leaf string, subroot string, root string, proof array<struct<left:string,right:string>>",
    )


def _rounds(nodes: int, fanout: int) -> int:
    """How often ``nodes`` consecutive nodes are grouped until one is left."""
    rounds = 0
    while nodes > 1:
        nodes, rounds = -(-nodes // fanout), rounds + 1
    return rounds


def _div(c: Column, by: int) -> Column:
    return F.floor(c / F.lit(by)).cast("long") if by > 1 else c


def _swap(state: DataFrame, run: list[Column], digit: Column, ordinal: Column, count: Column, lanes: Column, rises: Column) -> DataFrame:
    """One round: blocks with the same lane in the subtrees of a run swap roots, and hash the parent.

    ``ordinal`` is a block's place among the ``count`` blocks of its subtree and
    ``lanes`` the most blocks of a subtree in the run. Where the level has one
    node already (not ``rises``), a block stays as it is.
    """
    sent = state.withColumns(
        {"_digit": digit, "_ordinal": ordinal, "_rises": rises, **{f"_run{i}": c for i, c in enumerate(run)}}
    ).withColumn("_lane", F.explode(F.sequence("_ordinal", lanes - 1, count)))
    meeting = Window.partitionBy(*(f"_run{i}" for i in range(len(run))), "_lane")
    met = sent.withColumn("_met", F.array_sort(F.collect_set(F.struct("_digit", "node")).over(meeting)))

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter("_met", keep), lambda peer: peer["node"]), "")

    return (
        met.where("_lane = _ordinal")
        .withColumn("_left", side(lambda peer: peer["_digit"] < F.col("_digit")))
        .withColumn("_right", side(lambda peer: peer["_digit"] > F.col("_digit")))
        .withColumn(
            "path",
            F.when(
                F.col("_rises"), F.concat("path", F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right"))))
            ).otherwise(F.col("path")),
        )
        .withColumn(
            "node",
            F.when(F.col("_rises"), F.sha2(F.concat("_left", "node", "_right").cast("binary"), 256)).otherwise(F.col("node")),
        )
        .select(*state.columns)
    )


def _upper_places(trees: DataFrame, rounds: int, fanout: int, shared: Shared) -> DataFrame:
    """For each tree and round over the trees: a tree's first place in its subtree, the subtree's blocks and the run's lanes."""
    rows, spans = number_within(trees, [], [F.col("tree")], shared)
    sums = rows.groupBy("part").agg(F.sum("blocks").alias("_sum"))
    sums = sums.withColumn("_earlier", F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum"))  # a row per range
    running = F.sum("blocks").over(Window.partitionBy("part").orderBy("pos")) - F.col("blocks")
    ranked = shared.table(
        rows.join(spans, "part").join(sums, "part").select(
            "tree", "blocks", place_in_key().alias("rank"), (F.col("_earlier") + running).alias("first")
        )
    )
    out = ranked
    for q in range(rounds):
        run, digit = _div(F.col("rank"), fanout ** (q + 1)), F.pmod(_div(F.col("rank"), fanout**q), F.lit(fanout))
        of = lambda d, c: F.when(digit == d, F.col(c))  # noqa: E731, B023
        sizes = ranked.groupBy(run.alias("_run")).agg(
            F.array(*(F.coalesce(F.sum(of(d, "blocks")), F.lit(0)) for d in range(fanout))).alias("_sizes"),
            F.array(*(F.min(of(d, "first")) for d in range(fanout))).alias("_firsts"),
        )
        at = (digit + 1).cast("int")
        out = out.withColumn("_run", run).join(sizes, "_run").withColumn(
            f"up{q}",
            F.struct(
                (F.col("first") - F.element_at("_firsts", at)).alias("ordinal"),
                F.element_at("_sizes", at).alias("count"),
                F.array_max("_sizes").alias("lanes"),
            ),
        ).drop("_run", "_sizes", "_firsts")
    return out


def build_manifest(
    docs: DataFrame,
    values: list[str] | None = None,
    id_col: str = "doc_id",
    group_col: str = "source",
    claimed: dict[str, Column] | None = None,
    fanout: int = 3,
    height: int = 6,
) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``leaf``, ``claimed_leaf``, ``subroot``, ``root`` and ``proof``.

    A leaf hashes ``values`` (all columns by default). The leaves of a group ascend
    by id; groups are in the byte order of their name. ``subroot`` is the root of
    the row's group and ``root`` that of all. ``proof`` has a step for each level
    from the leaf to the root, with the siblings to the left and to the right
    (hex digests in a row; both empty for a node without siblings).
    ``claimed`` replaces columns by what someone else holds: ``claimed_leaf`` is the
    leaf of that, and ``fold(claimed_leaf, proof)`` equals ``root`` if it is the same.

    A null group is a group of its own and comes first, so do null ids in their
    group. Rows of one id are in the order of their digests; equal rows are leaves
    of their own. Null values differ from empty ones. Texts of any length are
    hashed whole. A group of one row has its leaf as its root. An empty table gives
    no rows. Other columns take part only if ``values`` names them.
    """
    shared = Shared(docs.sparkSession, "manifest")
    values = values or docs.columns
    own = {c: docs[f"`{c}`"] for c in values}
    digest = lambda columns: F.unhex(leaf_digest(*columns.values()))
    # the group's name, null first; the byte order of the names is kept
    tree = F.coalesce(F.concat(F.lit("="), docs[f"`{group_col}`"].cast("string")), F.lit("-"))
    leaves = shared.table(
        docs.select(
            tree.alias("tree"),
            docs[f"`{id_col}`"].cast("long").alias("id"),
            digest(own).alias("leaf"),
            digest(own | {c: v for c, v in (claimed or {}).items() if c in own}).alias("claimed"),
        )
    )
    rows, spans = number_within(leaves, ["tree"], [F.col("id").asc_nulls_first(), F.col("leaf")], shared)
    shared.drop(leaves)

    width = fanout**height
    spans = spans.withColumn("blocks", F.ceil(F.col("total") / F.lit(width)).cast("long"))
    place = place_in_key()
    blocks = shared.table(
        rows.join(spans, ["part", "tree"])
        .select("tree", "part", "blocks", "id", "leaf", "claimed", place.alias("place"), _div(place, width).alias("block"))
        .groupBy("tree", "block")
        .agg(
            F.min("part").alias("part"),
            F.first("blocks").alias("blocks"),
            F.array_sort(F.collect_list(F.struct("place", "id", "leaf", "claimed"))).alias("leaves"),  # of one block
        )
    )
    shared.drop(rows)

    trees = shared.table(spans.where("before = 0").select("tree", "blocks"))
    n_trees, largest = trees.agg(F.count("*"), F.coalesce(F.max("blocks"), F.lit(0))).first()
    upper = _rounds(n_trees, fanout)
    places = shared.table(_upper_places(trees, upper, fanout, shared))
    state = (
        _block_roots(blocks, fanout, height)
        .join(spans.select("part", "tree").join(places, "tree"), ["part", "tree"])
        .withColumn("path", F.expr("CAST(array() AS array<struct<left:string,right:string>>)"))
    )
    block, many = F.col("block"), F.col("blocks")
    for r in range(_rounds(largest, fanout)):
        step = fanout**r
        size = lambda first: F.least(F.lit(step), many - first)  # noqa: E731, B023
        state = _swap(
            state,
            [F.col("tree"), _div(block, step * fanout)],
            F.pmod(_div(block, step), F.lit(fanout)),
            F.pmod(block, F.lit(step)),
            size(_div(block, step) * step),
            size(_div(block, step * fanout) * (step * fanout)),
            many > step,
        )
    state = state.withColumn("subroot", F.col("node"))
    for q in range(upper):
        up = F.col(f"up{q}")
        state = _swap(
            state,
            [_div(F.col("rank"), fanout ** (q + 1))],
            F.pmod(_div(F.col("rank"), fanout**q), F.lit(fanout)),
            up["ordinal"] + block,
            up["count"],
            up["lanes"],
            F.lit(True),
        )
    done = shared.table(state.select("tree", "block", "path", "subroot", F.col("node").alias("root")))
    return _proofs(blocks.join(done, ["tree", "block"]).drop("tree", "block", "part"), fanout, height)
