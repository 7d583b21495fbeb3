"""Toxicity by multiple-instance learning.

Only documents are labelled. A document is a bag of sentences; a sentence's score is a logistic function of hashed
word features, and the document's is the noisy-or of its sentences': toxic if any sentence is. Training
maximises the likelihood of the document labels, and sentence scores then locate the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import Scratch, documents_of, id_remainder
from gatehouse.llm.textvec import FEW_BYTES, U64, Words, mix, text_blocks, words_of

FEATURE_BITS = 20
PREFIX_BYTES = (4, 5)
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


def sentence_ids(words: Words) -> np.ndarray:
    """Number of each word's sentence in the block; a sentence ends at . ! ? or a line's or text's end."""
    ends = SENTENCE_END[words.data].astype(np.int64)
    ends[words.text_start[1:] - 1] = 1
    before = np.cumsum(ends)[words.start] if len(words.start) else np.zeros(0, np.int64)
    return np.unique(before, return_inverse=True)[1]


def word_features(words: Words) -> list[np.ndarray]:
    """Feature numbers of each word: the word, and its first bytes."""
    shift = U64(64 - FEATURE_BITS)
    return [(h >> shift).astype(np.int64) for h in (words.hash, *(mix(words.prefix_hash(n) + U64(n)) for n in PREFIX_BYTES))]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(score, text) of each sentence of the block that has words."""
        sentence = sentence_ids(words)
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        z = np.full(n, self.bias) + np.bincount(sentence, sum(self.weights[f] for f in word_features(words)), n)
        doc = np.zeros(n, np.int64)
        doc[sentence] = words.doc
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), doc


def noisy_or(scores: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(scores, 1 - 1e-15)), n))


@dataclass
class Bag:
    """A labelled document: the numbers of its chosen features, the sentence of each, and how many sentences it has."""

    label: int
    feature: np.ndarray
    sentence: np.ndarray
    n_sentences: int


def train(bags: Sequence[Bag], chosen: np.ndarray, weights: tuple[float, float] = (1.0, 1.0), steps: int = 300, l2: float = 1e-4) -> Model:
    """Fit the chosen features' weights; ``weights`` of negative and positive bags."""
    model = Model(np.zeros(1 << FEATURE_BITS), -6.0)
    labels = {b.label for b in bags}
    if len(labels) < 2:
        model.bias = 0.0 if labels == {1} else -40.0
        return model
    feature, sentence, sentence_doc, extra, at = [], [], [], np.zeros(len(bags)), 0
    for d, bag in enumerate(bags):
        found, own = np.unique(bag.sentence, return_inverse=True)
        feature.append(bag.feature)
        sentence.append(own + at)
        sentence_doc.append(np.full(len(found), d))
        extra[d] = bag.n_sentences - len(found)  # sentences that have the bias alone
        at += len(found)
    x, s, d = (np.concatenate(v).astype(np.int64) for v in (feature, sentence, sentence_doc))
    y = np.array([b.label for b in bags], float)
    importance = np.where(y == 1, weights[1], weights[0])
    importance /= importance.sum()
    w, b = np.zeros(len(chosen)), -6.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(s, w[x], at)
        soft = np.logaddexp(0, z)
        total = np.bincount(d, soft, len(bags)) + extra * np.logaddexp(0, b)
        pull = np.where(y == 1, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), 1.0) * importance
        grad_z = pull[d] / (1 + np.exp(-z))
        grad = np.append(np.bincount(x, grad_z[s], len(chosen)) + l2 * w, grad_z.sum() + (pull * extra).sum() / (1 + np.exp(-b)))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weights[chosen], model.bias = w, float(b)
    return model


def labelled_texts(docs: DataFrame, known: DataFrame, max_per_class: int) -> DataFrame:
    """``doc_id, toxic, text`` of at most ``max_per_class`` documents of each class, those of least id hash.

    An id counts once: as toxic if any label says so, with the text of least hash if rows repeat it.
    """
    picked = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.join(F.broadcast(picked), "doc_id").withColumn("hash", F.xxhash64("text"))
    first = texts.groupBy("doc_id").agg(F.min("hash").alias("hash"))
    return texts.join(F.broadcast(first), ["doc_id", "hash"]).dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text")


def bag_pairs(text: str) -> tuple[np.ndarray, int]:
    """(distinct pairs of a sentence and a feature that it has, number of sentences)."""
    words = words_of([text])
    sentence = sentence_ids(words)
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *((sentence << FEATURE_BITS) | f for f in word_features(words))]))
    return pairs, int(sentence[-1]) + 1 if len(sentence) else 0


def chosen_features(texts: DataFrame, counts: dict[int, int], max_features: int = 4000) -> np.ndarray:
    """Features that are in at least five positive bags and clearly more often there than in negative ones, those that tell most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << FEATURE_BITS), np.int32)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[y][np.unique(bag_pairs(text.as_py())[0] & ((1 << FEATURE_BITS) - 1))] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1][some].astype(np.int64)), pa.array(seen[0][some].astype(np.int64))], ["feature", "pos", "neg"])

    in_bags = texts.select("toxic", "text").mapInArrow(run, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rated = in_bags.where("pos >= 5").selectExpr("feature", "pos", f"(pos + 0.5D) / {counts[1] + 1} as p", f"(neg + 0.5D) / {counts[0] + 1} as q")
    best = rated.where("p > 3 * q").orderBy(F.expr("pos * ln(p / q)").desc(), "feature").limit(max_features)
    return np.sort(np.array([r.feature for r in best.select("feature").collect()], np.int64))


def fit(docs: DataFrame, labels: DataFrame, holdout_mod: int = 3, holdout_rest: int = 1, max_per_class: int = 3000) -> Model:
    """Train on at most ``max_per_class`` labelled documents of each class, none of them held out.

    Their features are counted and chosen by Spark; the driver gets only the pairs of at most 4000 chosen ones.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((id_remainder("doc_id", holdout_mod) != holdout_rest) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of_class = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = scratch.put("texts", labelled_texts(docs, known, max_per_class))
    counts = {0: 0, 1: 0} | {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = chosen_features(texts, counts) if all(counts.values()) else np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << FEATURE_BITS, -1)
        number[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            kept, sizes = [], []
            for text in batch.column(2):
                pair, n = bag_pairs(text.as_py())
                own = number[pair & ((1 << FEATURE_BITS) - 1)]
                kept.append(((pair >> FEATURE_BITS << FEATURE_BITS) | own)[own >= 0].tobytes())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "toxic", "pairs", "n_sentences"])

    rows = texts.mapInArrow(run, "doc_id long, toxic int, pairs binary, n_sentences long").orderBy("doc_id").collect()
    scratch.drop("texts")
    shared.destroy()
    pairs = [np.frombuffer(r.pairs, np.int64) for r in rows]
    told = [Bag(r.toxic, p & ((1 << FEATURE_BITS) - 1), p >> FEATURE_BITS, r.n_sentences) for r, p in zip(rows, pairs, strict=True)]
    return train(told, chosen, tuple(of_class.get(y, 0) / max(1, counts[y]) for y in (0, 1)))


SCORES = "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model, sentence_threshold: float = 0.5) -> DataFrame:
    """doc_id, score, offending sentences (code points, end exclusive, from first to last word)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(1)):
                words = words_of(texts)
                p, doc = own.sentence_scores(words)
                sentence, found = sentence_ids(words), [[] for _ in range(b - a)]
                for k in np.flatnonzero(p >= sentence_threshold).tolist():
                    first, last = np.searchsorted(sentence, [k, k + 1])
                    zero = words.text_start[doc[k]]
                    span = [len(words.data[zero:x].tobytes().decode("utf-8", "replace")) for x in (words.start[first], words.end[last - 1])]
                    found[doc[k]].append({"start": span[0], "end": span[1], "score": float(p[k])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(noisy_or(p, doc, b - a)), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], ["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, holdout_mod: int = 3, holdout_rest: int = 1, max_per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document; returns doc_id, held_out, score, predicted, offending.

    Null and empty texts have no sentence and score 0; null ids are scored and never train; without labels of
    both classes every text gets a constant score; ties and repeated rows are scored alike, each row by its own text. An empty
    table gives no rows; further columns, whatever their names, are ignored.
    """
    own = documents_of(docs, id_col, text_col)
    scored = score(own, fit(own, labels, holdout_mod, holdout_rest, max_per_class))
    return scored.select("doc_id", (id_remainder("doc_id", holdout_mod) == holdout_rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **fit_settings: int) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns as they are.

    Null and empty texts have no sentence and stay; rows without an id are scored like others; of rows that repeat an id each is
    judged by its own text; columns of any name are carried along; an empty table stays empty.
    """
    model = fit(documents_of(docs, id_col, text_col), labels, **fit_settings)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, b, texts in text_blocks(batch.column(column).fill_null(""), FEW_BYTES):
                clean[a:b] = noisy_or(*own.sentence_scores(words_of(texts)), b - a) < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
