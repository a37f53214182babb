"""Similarity join on sets of word n-grams by MinHash banding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from opsmetrics.llm.common import Shared, record_id, record_text, tagged
from opsmetrics.llm.graph import components
from opsmetrics.llm.words import mix, run_hashes, word_hashes

_MINHASH_SEED = 20
#: Grams in more sets than this are counted by matrix products of so many columns.
_FEW, _COLUMNS = 12, 2048
#: n-grams hashed at once; bounds a task's memory and keeps them in cache.
_SLICE = 1 << 15


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): as many rows as possible within ``max_hashes`` while pairs at the threshold
    share a band with probability ``recall`` at least."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def grams(text: str, n: int) -> np.ndarray:
    """The set of n-grams of the words, as sorted 64-bit hashes; a text with fewer words is one gram, one without words has none."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    return np.unique(run_hashes(words, min(n, len(words)))) if len(words) else words


def common_grams(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams each two sets share."""
    common = np.zeros((len(sets), len(sets)), dtype=np.int32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    held = np.diff(np.append(first, len(flat)))
    n = len(sets)
    for size in range(2, _FEW + 1):  # grams of few sets: their pairs
        own = owner[first[held == size][:, None] + np.arange(size)]
        if len(own):
            pairs = (own[:, :, None] * n + own[:, None, :]).ravel()
            common += np.bincount(pairs, minlength=n * n).reshape(n, n).astype(np.int32)
    many = np.flatnonzero(held > _FEW)
    for begin in range(0, len(many), _COLUMNS):  # the others: a product of incidence matrices
        part = many[begin : begin + _COLUMNS]
        sizes = held[part]
        column = np.repeat(np.arange(len(part)), sizes)
        place = np.repeat(first[part] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        incidence = np.zeros((n, len(part)), dtype=np.float32)
        incidence[owner[place], column] = 1
        common += (incidence @ incidence.T).astype(np.int32)
    return common


_BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def _split(text: str) -> list[str]:
    return [w for w in text.translate(_BLANKS).split(" ") if w]


def _signatures(hashed: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes of each set of gram hashes; none of them is empty."""
    rng = np.random.default_rng(_MINHASH_SEED)
    factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    low = np.full((bands * rows, len(hashed)), np.uint64(2**64 - 1))

    def lower(owners: list[int], parts: list[np.ndarray]) -> None:
        flat = np.concatenate(parts)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
        for k in range(bands * rows):
            smallest = np.minimum.reduceat(flat * factor[k] + shift[k], starts)
            low[k, owners] = np.minimum(low[k, owners], smallest)

    owners, parts, size = [], [], 0
    for doc, own in enumerate(hashed):
        for begin in range(0, len(own), _SLICE):
            if begin or size > _SLICE:  # a slice has one part of a document at most
                lower(owners, parts)
                owners, parts, size = [], [], 0
            owners.append(doc)
            parts.append(own[begin : begin + _SLICE])
            size += len(parts[-1])
    lower(owners, parts)
    weight = powers_of_rows(rows)
    return mix((low.reshape(bands, rows, -1) * weight[None, :, None]).sum(axis=1, dtype=np.uint64)).T


def powers_of_rows(rows: int) -> np.ndarray:
    """Odd factors, one for each row of a band."""
    rng = np.random.default_rng(_MINHASH_SEED + 1)
    return rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sign(base: DataFrame, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """Each row with a digest of its word sequence and its band hashes (none for a text without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, hashed, filled = [], [], []
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                plain = " ".join(_split(text)).encode("utf-8", "surrogatepass")
                digests.append(hashlib.blake2b(plain, digest_size=16).digest())
                words = word_hashes(plain)
                if len(words):
                    filled.append(i)
                    hashed.append(run_hashes(words, min(n, len(words))))
            values: list = [None] * batch.num_rows
            if filled:
                for i, row in zip(filled, _signatures(hashed, bands, rows).view(np.int64)):
                    values[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("record"), pa.array(digests, pa.binary()), pa.array(values, pa.list_(pa.int64()))],
                names=["row", "record", "digest", "bands"],
            )

    schema = base.schema.add("digest", BinaryType()).add("bands", ArrayType(LongType()))
    return base.withColumn("text", record_text(text_col)).mapInArrow(sign, schema)


def _compare(texts: list[str], half: list[int], bands: np.ndarray, band: int, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the texts of one or two blocks of a bucket: links of each, and the smallest place it is joined to.

    With two blocks only pairs across them count. ``bands`` holds the band hashes of
    each text: a link counts in the first band that the two texts share, so it
    counts once however many buckets hold both.
    """
    sets = [grams(t, n) for t in texts]
    size = np.array([len(s) for s in sets])
    side = np.array(half)
    common = common_grams(sets)
    linked = common >= threshold * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    label = np.arange(len(sets))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(sets)).min(axis=1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    count = np.zeros(len(sets), dtype=np.int64)
    rows, columns = np.nonzero(linked)
    first = np.concatenate(
        [(bands[rows[k : k + 65536]] == bands[columns[k : k + 65536]]).argmax(axis=1) for k in range(0, len(rows), 65536)]
        or [np.zeros(0, dtype=np.int64)]
    )
    np.add.at(count, rows[first == band], 1)
    return count, label


def _verify(parts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Compares the texts of each block pair on their full n-gram sets.

    ``parts`` is sorted by block pair within its partitions. Returns a row for each
    text with a link: the id it is joined to and the links that count here.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            ids = [h["id"] for h in held]
            bands = np.array([h["bands"] for h in held])
            count, label = _compare([h["text"] for h in held], [h["half"] for h in held], bands, key[0], n, threshold)
            joined = np.flatnonzero(label != np.arange(len(ids)))
            rows = sorted({*joined.tolist(), *np.flatnonzero(count).tolist()})
            columns = ([ids[i] for i in rows], [ids[label[i]] for i in rows], [int(count[i]) for i in rows])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_links"])

        for batch in batches:
            for row in batch.to_pylist():
                own = (row["band"], row["hash"], row["low"], row["high"])
                if own != key:
                    if (out := close()) is not None:
                        yield out
                    key, held = own, []
                held.append(row)
        if (out := close()) is not None:
            yield out

    return parts.mapInArrow(compare, "a long, b long, n_links long")


def similar_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    max_hashes: int = 128,
    block_texts: int = 512,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """A row per document: ``doc_id``, ``class_id``, ``class_size``, ``n_links`` and ``kept``.

    Documents are linked when the sets of their word n-grams have a Jaccard
    similarity of ``threshold`` or more. Classes are the connected components,
    ``class_id`` the smallest doc_id of the class; that document is kept.
    ``n_links`` counts the other texts that a document's text is linked to;
    copies share it.

    1. Documents with the same word sequence become one text.
    2. MinHash bands, chosen for ``recall`` at the threshold, are shuffled; a
       bucket is the texts that share a band hash. Buckets of the same texts are one.
    3. A bucket is dealt into blocks of about ``block_texts`` texts and
       ``block_chars`` characters, and each block meets each: so every pair of a
       bucket is compared on the full sets, in tasks of bounded size, however
       large the bucket. A task returns a row for each text, never pairs: how
       many links it has there and one text it is joined to.
    4. The classes are the components of those joins.

    Null and empty texts, and texts of separators alone, have no n-gram: each
    is a class of its own. A text with fewer than ``n`` words is one gram. A very long
    text counts with all its grams, and its block may be larger than ``block_chars``. Rows
    that repeat an id are separate documents with the same class if their texts
    are similar, and one of them is kept; a null id never names a class unless
    all its ids are null. An empty table gives no rows; other columns are not read.
    """
    shared = Shared(docs.sparkSession, "ngrams")
    signed = shared.table(_sign(tagged(docs.select(id_col, text_col)), text_col, n, *choose_bands(threshold, recall, max_hashes)))
    classes = _classes(signed, shared, id_col, text_col, n, threshold, block_texts, block_chars)
    return classes.select("doc_id", "class_id", "class_size", "n_links", "kept")


def keep_one(
    docs: DataFrame,
    shared: Shared,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    max_hashes: int = 128,
    block_texts: int = 512,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """One document of each class, with all its columns. Cases as in ``similar_classes``."""
    signed = shared.table(_sign(tagged(docs), text_col, n, *choose_bands(threshold, recall, max_hashes)))
    gone = shared.table(_classes(signed, shared, id_col, text_col, n, threshold, block_texts, block_chars).where("not kept").select("row"))
    return signed.join(gone, "row", "left_anti").select("record.*")


def _classes(
    signed: DataFrame, shared: Shared, id_col: str, text_col: str, n: int, threshold: float, block_texts: int, block_chars: int
) -> DataFrame:
    # one text for each word sequence, named by the smallest row that has it
    text_of = shared.table(signed.where("bands is not null").groupBy("digest").agg(F.min("row").alias("id")))
    # joins with tables that grow with the input are merge joins at every size
    sized = signed.select(F.col("row").alias("id"), "bands", F.length(record_text(text_col)).alias("chars"))
    texts = sized.join(text_of.select("id").hint("merge"), "id", "left_semi")
    entries = shared.table(texts.select("id", "chars", F.posexplode("bands").alias("band", "hash")))
    # buckets with the same texts are one: the sums of two hashes name a set of ids
    buckets = (
        entries.groupBy("band", "hash")
        .agg(
            F.count("*").alias("n"),
            F.sum("chars").alias("chars"),
            F.sum(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40))).alias("set_1"),
            F.sum(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 40))).alias("set_2"),
        )
        .where("n > 1")
        .groupBy("n", "chars", "set_1", "set_2")
        .agg(F.min(F.struct("band", "hash")).alias("first"))
    )
    blocks = F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("chars") / block_chars)).cast("int")
    buckets = shared.table(buckets.select("first.band", "first.hash", blocks.alias("blocks")))
    members = entries.select("id", "band", "hash").join(buckets.hint("merge"), ["band", "hash"])
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    members = shared.table(members.select("id", "band", "hash", "blocks", own.alias("block")))
    shared.drop(entries, buckets)
    # every block meets itself and every other one: a text goes to as many pairs as its bucket has blocks
    pairs = members.select(
        "id", "band", "hash", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "id",
        "band",
        "hash",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("half"),
    )
    bodies = shared.table(
        signed.select(F.col("row").alias("id"), record_text(text_col).alias("text"), "bands").join(
            members.select("id").distinct().hint("merge"), "id", "left_semi"
        )
    )
    keys = ["band", "hash", "low", "high"]
    parts = pairs.join(bodies.hint("merge"), "id").repartition(*keys).sortWithinPartitions(*keys)
    found = shared.table(_verify(parts, n, threshold))
    shared.drop(members, bodies)

    labels = components(found.where("a <> b"), shared)
    degree = found.groupBy(F.col("a").alias("id")).agg(F.sum("n_links").alias("n_links"))
    per_text = (
        text_of.join(labels.withColumnRenamed("node", "id"), "id", "left")
        .join(degree, "id", "left")
        .select("digest", F.coalesce("label", "id").alias("label"), "n_links")
    )
    named_rows = shared.table(
        signed.select("row", record_id(id_col).alias("doc_id"), "digest", F.col("bands").isNull().alias("blank"))
        .join(shared.table(per_text).hint("merge"), "digest", "left")
        .select(
            "row",
            "doc_id",
            F.when(F.col("blank"), F.col("row")).otherwise(F.col("label")).alias("label"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        )
    )
    shared.drop(text_of, labels, found)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    classes = shared.table(
        named_rows.groupBy("label")
        .agg(first.alias("first"), F.count("*").alias("class_size"))
        .select("label", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"), "class_size")
    )
    return named_rows.join(classes, "label").select(
        "doc_id", "class_id", "class_size", "n_links", (F.col("row") == F.col("first_row")).alias("kept"), "row"
    )
