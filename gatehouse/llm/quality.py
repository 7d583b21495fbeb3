"""Quality by positive-unlabelled learning.

Only good documents are trusted; all other text is unlabelled. A linear model over binned style features
minimises the non-negative unbiased risk: prior * loss(positives as 1) + max(0, loss(unlabelled as 0) -
prior * loss(positives as 0)). The class prior is estimated from how much of the unlabelled text scores above a
threshold compared to trusted documents kept out of that fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import documents_of, id_remainder, staged
from gatehouse.llm.textvec import Words, grams, text_blocks, words_of

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.zeros(256, np.int64)
for _k, _c in enumerate([*_PUNCTUATION, 32, 10]):
    _CLASS[_c] = _k + 1
_UPPER, _LOWER, _DIGIT, _HIGH, _CONTROL = range(len(_PUNCTUATION) + 3, len(_PUNCTUATION) + 8)
for _a, _b, _k in ((65, 90, _UPPER), (97, 122, _LOWER), (48, 57, _DIGIT), (128, 255, _HIGH), (0, 31, _CONTROL)):
    _CLASS[_a : _b + 1] = np.where(_CLASS[_a : _b + 1] == 0, _k, _CLASS[_a : _b + 1])
N_CLASSES = _CONTROL + 1
N_FEATURES = N_CLASSES + 8
BINS = 8


def style_features(words: Words) -> np.ndarray:
    """A row of numbers per text: shares of character classes, word lengths, repetition and size."""
    n = len(words.text_start) - 1
    size = np.diff(words.text_start) - 1
    text = np.repeat(np.arange(n), size + 1)
    counts = np.bincount(text * N_CLASSES + _CLASS[words.data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    counts[:, _CONTROL] -= 1  # the byte that ends each text
    share = counts / np.maximum(size, 1)[:, None]
    n_words = np.diff(words.first)
    some = np.maximum(n_words, 1)
    per_text = lambda x, d: np.bincount(d, x, n)
    length = words.end - words.start

    def distinct(gram: int) -> np.ndarray:
        g = grams(words.hash, gram)
        d = words.doc[: len(g)]
        inside = d == words.doc[gram - 1 :] if len(g) else np.zeros(0, bool)
        order = np.lexsort((g[inside], d[inside]))
        gd, gg = d[inside][order], g[inside][order]
        new = np.ones(len(gg), bool)
        new[1:] = (gg[1:] != gg[:-1]) | (gd[1:] != gd[:-1])
        return per_text(new, gd) / np.maximum(per_text(np.ones(len(gd)), gd), 1)

    adjacent = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1]) if len(words.hash) else np.zeros(0, bool)
    mean = per_text(length, words.doc) / some
    extra = [
        np.log1p(size),
        mean,
        np.sqrt(np.maximum(per_text(length.astype(float) ** 2, words.doc) / some - mean**2, 0)),
        distinct(1),
        distinct(3),
        per_text(adjacent, words.doc[1:]) / some,
        counts[:, _UPPER] / np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1),
        counts[:, _CLASS[10]] / some,
    ]
    return np.column_stack([share, *extra])


@dataclass
class Model:
    cuts: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)])

    def logit(self, bins: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[np.arange(len(self.cuts)), bins].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -40, 40)))


@dataclass
class Half:
    model: Model  # fitted on one half
    pos: np.ndarray  # its scores of the trusted documents of the other half
    fitted: np.ndarray  # which unlabelled rows it was fitted on


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(model: Model, pos: np.ndarray, unl: np.ndarray, steps: int, l2: float, prior: float | None) -> Model:
    """Adam on the non-negative risk, or with no prior on the plain risk of positives against unlabelled."""
    f = len(model.cuts)
    place = np.arange(f) * BINS
    pos_at, unl_at = pos + place, unl + place
    w, b = np.zeros(f * BINS), 0.0
    m, v = np.zeros(f * BINS + 1), np.zeros(f * BINS + 1)
    for step in range(1, steps + 1):
        sp, su = _sigmoid(b + w[pos_at].sum(axis=1)), _sigmoid(b + w[unl_at].sum(axis=1))
        if prior is None:
            gp, gu = (sp - 1) / len(sp), su / len(su)
        else:
            rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            if rest >= 0:
                gp, gu = np.full(len(sp), -prior / len(sp)), su / len(su)
            else:  # the estimate of the negatives' loss went below nothing: step it back up
                gp, gu = prior * sp / len(sp), -su / len(su)
        grad = np.append(np.bincount(pos_at.ravel(), np.repeat(gp, f), f * BINS) + np.bincount(unl_at.ravel(), np.repeat(gu, f), f * BINS) + l2 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(model.cuts, w.reshape(f, BINS), float(b), model.prior)


def _tail_cuts(pos: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(pos, np.linspace(0.02, 0.9, 60)))


def prior_of_tails(p: np.ndarray, u: np.ndarray, n_pos: int, n_unl: int) -> float:
    """Share of positives by the shares ``p`` and ``u`` of both sides above the same cuts: their least ratio, each with its sampling margin."""
    margin = np.sqrt(np.log(20) / (2 * n_unl)) + np.sqrt(np.log(20) / (2 * n_pos))
    best = int(np.argmin((u + margin) / np.maximum(p, 1e-9)))
    error = np.sqrt(u[best] * (1 - u[best]) / n_unl)  # one standard error less: the least of many ratios in small samples is high
    return float(np.clip((u[best] - error) / p[best], 0.01, 0.99))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled scores."""
    cuts = _tail_cuts(pos)
    tail = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    return prior_of_tails(tail(pos), tail(unl), len(pos), len(unl))


def train(pos: np.ndarray, unl: np.ndarray, steps: int = 600, l2: float = 1e-5, cuts: np.ndarray | None = None, priors_of: Callable[[list[Half]], list[float]] | None = None) -> Model:
    """Fit on feature rows of trusted and of unlabelled documents (in a fixed order).

    ``cuts`` and ``priors_of`` give the bins' cuts and the priors of the two half fits where these cover more rows than ``unl``.
    """
    if not len(pos) or not len(unl):
        return Model(np.zeros((N_FEATURES, BINS - 1)), np.zeros((N_FEATURES, BINS)), 0.0, 0.5)
    cuts = np.quantile(unl, np.arange(1, BINS) / BINS, axis=0).T if cuts is None else cuts
    model = Model(cuts, np.zeros((len(cuts), BINS)), 0.0, 0.5)
    p, u = model.bins(pos), model.bins(unl)
    if len(p) > 20:
        half = np.arange(len(p)) % 2 == 0
        other = np.arange(len(u)) % 2 == 0
        parts = []
        for a, c in ((half, other), (~half, ~other)):
            plain = _descend(model, p[a], u[c], steps // 3, 1e-5, None)
            parts.append(Half(plain, plain.logit(p[~a]), c))
        priors = priors_of(parts) if priors_of else [estimate_prior(h.pos, h.model.logit(u[~h.fitted])) for h in parts]
        model.prior = float(np.mean(priors))
    return _descend(model, p, u, steps, l2, model.prior)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def features_of(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every document, kept as a table, since the cuts, the priors, the fit and the scores read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(1)):
                x = style_features(words_of(texts))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rows], ["doc_id", "x"])

    return staged(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>"), "quality-features")


def all_cuts(features: DataFrame) -> np.ndarray:
    """The bins' cuts, quantiles of all documents to within a 512th of a value.

    Values are counted by the leading bits of their floating-point form, in an order that is theirs: a task gives a count for each
    that it saw, so nothing grows with the number of tasks but what Spark adds up over many reducers.
    """
    shift, middle = 43, 1 << 20  # keeps the exponent and 9 bits of the fraction

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            keys = (_ordered(_matrix(batch.column(0)).astype("<f8").view(np.int64)) >> shift) + middle
            held.append(np.unique((np.arange(N_FEATURES) << 21 | keys).ravel(), return_counts=True))
            rows += 1
            if rows % 16 == 0:
                held = [_added(held)]
        if held:
            key, n = _added(held)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 21), pa.array(key & (1 << 21) - 1), pa.array(n)], ["feature", "at", "n"])

    counts = features.select("x").mapInArrow(run, "feature long, at long, n long").groupBy("feature", "at").agg(F.sum("n").alias("n"))
    below = counts.selectExpr("feature", "at", "sum(n) over (partition by feature order by at) as upto", "sum(n) over (partition by feature) as total")
    firsts = below.groupBy("feature").agg(*[F.min(F.when(F.col("upto") * BINS >= F.col("total") * k, F.col("at"))).alias(f"q{k}") for k in range(1, BINS)]).orderBy("feature").collect()
    edges = np.array([r[1:] for r in firsts], np.int64)
    return _ordered(((edges - middle + 1) << shift) - 1).view(np.float64)  # the largest value of each


def _ordered(bits: np.ndarray) -> np.ndarray:
    """The bits of numbers as integers of the same order, and back."""
    return bits ^ ((bits >> 63) & ((1 << 63) - 1))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, own = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(own, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


def all_priors(features: DataFrame, parts: list[Half], ids: np.ndarray) -> list[float]:
    """Each half fit's prior against all documents but those that it was fitted on (``ids`` are those of the sample)."""
    shared = features.sparkSession.sparkContext.broadcast([(h.model, _tail_cuts(h.pos), np.unique(ids[h.fitted])) for h in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(len(cuts) + 1, np.int64) for _, cuts, _ in shared.value]
        for batch in batches:
            x, own = _matrix(batch.column(1)), batch.column(0)
            known = own.is_valid().to_numpy(zero_copy_only=False)
            doc_ids = own.fill_null(0).to_numpy(zero_copy_only=False)
            for (model, cuts, used), n in zip(shared.value, found, strict=True):
                z = model.logit(model.bins(x[~(known & np.isin(doc_ids, used))]))
                n += np.bincount(np.searchsorted(cuts, z, "right"), minlength=len(cuts) + 1)
        yield pa.RecordBatch.from_pylist([{"part": k, "n": n.tolist()} for k, n in enumerate(found)], pa.schema([("part", pa.int32()), ("n", pa.list_(pa.int64()))]))

    counts = features.mapInArrow(run, "part int, n array<long>").select("part", F.posexplode("n").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n")).collect()
    out = []
    for k, h in enumerate(parts):
        cuts = _tail_cuts(h.pos)
        n = np.zeros(len(cuts) + 1)
        for r in counts:
            if r.part == k:
                n[r["at"]] = r.n
        if not n.sum():
            out.append(0.5)
            continue
        above = np.cumsum(n[::-1])[::-1][1:] / n.sum()  # the share of scores of at least each cut
        p = 1 - np.searchsorted(np.sort(h.pos), cuts, "left") / len(h.pos)
        out.append(prior_of_tails(p, above, len(h.pos), int(n.sum())))
    return out


def fit(features: DataFrame, labels: DataFrame, holdout_mod: int = 5, holdout_rest: int = 0, max_positive: int = 6000, max_unlabelled: int = 8000) -> Model:
    """Fit weights on at most so many trusted documents, none held out, and so many of all documents, those of least id hash.

    Cuts and priors are of all documents. The unlabelled side of the risk is a mean over a few hundred bins, of which the
    default bound gives each about twenty documents. An id counts once: of rows that repeat it, that of the least features.
    """
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (id_remainder("doc_id", holdout_mod) != holdout_rest))
    order = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = order(trusted, max_positive).withColumn("kind", F.lit(1)).unionByName(order(features.where("doc_id is not null"), max_unlabelled).withColumn("kind", F.lit(0)))
    rows = features.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "kind").agg(F.min("x").alias("x")).collect()
    rows = sorted(rows, key=lambda r: (np.array(r.x, "<f8").tobytes(), r.doc_id))  # an order that the partitions don't decide
    rng = np.random.default_rng(7)
    order_of = [rng.permutation(sum(r.kind == y for r in rows)) for y in (1, 0)]
    sides = [np.array([r.x for r in rows if r.kind == y], float).reshape(-1, N_FEATURES)[o] for y, o in zip((1, 0), order_of, strict=True)]
    if not len(sides[0]) or not len(sides[1]):
        return train(*sides)
    ids = np.array([r.doc_id for r in rows if r.kind == 0], np.int64)[order_of[1]]
    return train(*sides, cuts=all_cuts(features), priors_of=lambda parts: all_priors(features, parts, ids))


def score(features: DataFrame, model: Model) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(_matrix(batch.column(1))))], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, holdout_mod: int = 5, holdout_rest: int = 0, max_positive: int = 6000, max_unlabelled: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document; returns doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without characters; null ids are scored and never train; without
    trusted documents every text scores 0.5; ties and repeated rows are scored alike. The
    features are of the text alone, the whole of it however long. An empty table gives no rows; further columns, whatever their names, are ignored.
    """
    own = features_of(documents_of(docs, id_col, text_col))
    scored = score(own, fit(own, labels, holdout_mod, holdout_rest, max_positive, max_unlabelled))
    return scored.select("doc_id", (id_remainder("doc_id", holdout_mod) == holdout_rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
