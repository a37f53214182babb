"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import id_text
from opsmetrics.llm.words import BLANK, mix, word_bounds, word_hashes

_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[ord("a") : ord("z") + 1] = True
_LOWER[128:] = True  # letters beyond ASCII are mostly small
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SIGNS = {name: np.isin(np.arange(256), [ord(c) for c in chars]) for name, chars in (
    ("stop", "."), ("comma", ",;:"), ("loud", "!?"), ("bar", "|"), ("odd", "#$%&*@=+<>{}[]\\^_~/"), ("quote", "\"'()-"),
)}
#: Words hashed into so many classes, as shares of the words.
_HASHED = 64
N_FEATURES = 20 + _HASHED


def features(text: str) -> np.ndarray:
    """Shape, repetition and word features of a whole text; all zero if it has no word."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(N_FEATURES)
    start, end = word_bounds(raw)
    if not len(start):
        return out
    counts = np.bincount(raw, minlength=256)
    n, n_words = len(raw), len(start)
    hashes = word_hashes(raw.tobytes())
    lines = [line for line in text.split("\n") if line.strip()]
    line_counts = set(lines)
    alone = int((end - start == 1).sum())
    distinct = len(np.unique(hashes))
    last = raw[end - 1]
    shares = [counts[table].sum() / n for table in (_UPPER, _LOWER, _DIGIT, BLANK, *_SIGNS.values())]
    out[:20] = [
        *shares,
        float((hashes[1:] == hashes[:-1]).mean()) if n_words > 1 else 0.0,
        np.log1p(n_words) / 10,
        (n - counts[BLANK].sum()) / n_words / 10,
        np.log1p(distinct) / np.log1p(n_words),
        1 - len(line_counts) / max(len(lines), 1),
        np.log1p(n_words / max(len(lines), 1)) / 5,
        alone / n_words,
        float(_UPPER[raw[start]].mean()),
        float(np.isin(last, [ord(c) for c in ".,;:!?"]).mean()),
        float(np.bincount((hashes % np.uint64(1009)).astype(np.int64)).max() / n_words),
    ]
    out[20:] = np.bincount((mix(hashes) % np.uint64(_HASHED)).astype(np.int64), minlength=_HASHED) / n_words
    return out


def _feature_rows(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "trusted", "x"]
            )

    return docs.select("doc_id", "text", "trusted").mapInArrow(rows, "doc_id long, trusted boolean, x array<double>")


@dataclass(frozen=True)
class QualityModel:
    """A logistic model on standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_expand(x, self.mean, self.scale) @ self.weights + self.bias, -30, 30)))


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z[:, :20] ** 2 - 1], axis=1)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.3) -> float:
    """The share of positives among the unlabelled.

    Above any score the unlabelled contain at least their positives, so
    ``P_u(score >= t) / P_p(score >= t)`` bounds the prior from above; the smallest
    bound over thresholds that keep ``least_share`` of the positives is taken.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - least_share, 41))
    bounds = [(unlabelled >= t).mean() / max((positive >= t).mean(), 1e-9) for t in cuts]
    return float(np.clip(min(bounds), 0.05, 0.95))


def _risk_step(
    zp: np.ndarray, zu: np.ndarray, weights: np.ndarray, bias: float, prior: float, penalty: float
) -> tuple[np.ndarray, float]:
    """Gradient of the non-negative unbiased risk with the logistic loss.

    Risk: prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]). Where the
    second term is negative the step goes up on it alone, as non-negative
    learning prescribes.
    """
    fp, fu = zp @ weights + bias, zu @ weights + bias
    sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    gp_wrong = (sp - 1) / len(zp) * prior  # of prior * l(f) over the positives
    gp_negative = -prior * sp / len(zp)
    gu_negative = su / len(zu)
    if negative >= 0:
        gp, gu = gp_wrong + gp_negative, gu_negative
    else:
        gp, gu = -gp_negative, -gu_negative
    return zp.T @ gp + zu.T @ gu + penalty * weights, float(gp.sum() + gu.sum())


def _fit(
    zp: np.ndarray, zu: np.ndarray, prior: float, steps: int, rate: float, penalty: float
) -> tuple[np.ndarray, float]:
    """Adam over the whole sample."""
    size = zp.shape[1]
    state = np.zeros(size + 1)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        gw, gb = _risk_step(zp, zu, state[:-1], state[-1], prior, penalty)
        grad = np.append(gw, gb)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        state -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return state[:-1], float(state[-1])


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
    max_positive: int = 4_000,
    max_unlabelled: int = 12_000,
    steps: int = 400,
    rate: float = 0.03,
    penalty: float = 1e-3,
) -> QualityModel | None:
    """Fits on at most ``max_positive`` trusted positives and ``max_unlabelled`` documents taken as unlabelled.

    Both are drawn by a hash of the id alone. A document with label 1 (and no
    other label) is a trusted positive; the unlabelled sample is drawn from all
    documents, whatever their label, so it is the mixture that the risk assumes.
    Rows without id or label teach nothing; of several rows with one id, the first
    text in order teaches. So the bounds hold for rows. None if there is no positive.
    """
    own = id_text(docs, id_col, text_col).where("doc_id is not null")
    trusted = (
        labels.where(F.col(label_col).isNotNull())
        .groupBy(F.col(label_id).cast("long").alias("doc_id"))
        .agg(F.min(F.col(label_col).cast("int")).alias("label"))
        .where("label = 1")
        .select("doc_id")
    )
    ids = own.select("doc_id")
    order = [F.xxhash64("doc_id", F.lit("sample")), "doc_id"]
    drawn_p = ids.join(trusted, "doc_id", "left_semi").distinct().orderBy(*order).limit(max_positive)
    drawn_u = ids.distinct().orderBy(*order).limit(max_unlabelled)
    # both bounded by the parameters, so they may be broadcast
    chosen = drawn_p.withColumn("trusted", F.lit(True)).unionAll(drawn_u.withColumn("trusted", F.lit(False)))
    # an id can have any number of rows: one text speaks for it
    drawn = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "trusted").agg(F.min("text").alias("text"))
    rows = _feature_rows(drawn.select("doc_id", "text", "trusted")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["trusted"], r["x"]))
    positive = np.array([r["x"] for r in rows if r["trusted"]]).reshape(-1, N_FEATURES)
    unlabelled = np.array([r["x"] for r in rows if not r["trusted"]]).reshape(-1, N_FEATURES)
    if not len(positive) or not len(unlabelled):
        return None
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    zp, zu = _expand(positive, mean, scale), _expand(unlabelled, mean, scale)
    # the prior from a plain positive-against-unlabelled score on the half it was not fitted on, then the risk with it
    priors = []
    for part in (0, 1):
        halves = [(z[part::2], z[1 - part :: 2]) if len(z) > 1 else (z, z) for z in (zp, zu)]
        (fit_p, rest_p), (fit_u, rest_u) = halves
        weights, bias = _fit(fit_p, fit_u, 0.5, steps, rate, penalty)
        priors.append(estimate_prior(rest_p @ weights + bias, rest_u @ weights + bias))
    prior = float(np.mean(priors))
    weights, bias = _fit(zp, zu, prior, steps, rate, penalty)
    return QualityModel(mean, scale, weights, bias, prior)


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every document, from its whole text alone.

    Null and empty texts are scored too, as a text with no word; without a
    model every score is 0.5. Rows that repeat an id are scored each; other columns
    are not read; an empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
            values = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")
