"""Toxicity by non-negative positive-unlabelled learning.

Positives are the documents confirmed toxic, the unlabelled set is a sample of all
documents of the corpus. A linear classifier g over the features present in a text
minimises the class-prior-corrected risk with the logistic loss l,

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),

whose second term, the risk on negatives, can't fall below 0: while it would, the step
goes up that term's gradient instead, which keeps a flexible model from overfitting.
Soft thresholding keeps most weights at 0; those left are refitted with a
slight decay (less the more positives there are). Last the bias
is lowered, where needed, until no more of the unlabelled than the prior scores above 0. A feature
is a word or the beginning of one, known by its 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.textarrays import U64, Words, lean, list_array, pieces
from newsloom.session import ship

#: Bounds of the training sample, picked by a hash of the ids: documents labelled toxic, and any documents.
POSITIVES, UNLABELLED = 2000, 4000
#: A feature is used if at least so many sampled documents have it.
MIN_DOCS = 10
#: Features besides whole words: the first so many bytes of longer words (stems and compounds).
PREFIXES = (4, 5, 6, 7)
_FILTER_BITS = 16


@dataclass
class Model:
    """Feature hashes (sorted), their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, words: Words) -> np.ndarray:
        """g of each document: the bias and the weights of the distinct features it has."""
        size = len(self.words)
        if not size:
            return np.full(words.rows, self.bias)
        mask = U64((1 << _FILTER_BITS) - 1)
        known = np.zeros(1 << _FILTER_BITS, bool)
        known[(self.words & mask).astype(np.int64)] = True
        pairs = []
        for doc, value in features(words):
            at = np.flatnonzero(known[(value & mask).astype(np.int64)])
            feature = np.searchsorted(self.words, value[at])
            feature[feature == size] = 0
            same = self.words[feature] == value[at]
            pairs.append(doc[at[same]] * size + feature[same])
        pair = np.unique(np.concatenate(pairs))
        return self.bias + np.bincount(pair // size, self.weights[pair % size], words.rows)


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(doc, hash) of all features, repeats included."""
    yield words.doc, words.hash
    for length in PREFIXES:
        yield words.prefixes(length)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 1.5, penalty: float | None = None, min_docs: int = MIN_DOCS) -> Model:
    """Train on documents given as arrays of distinct feature hashes. Without positives nothing is toxic.

    Proximal gradient steps: a feature gets a weight only if its gradient exceeds `penalty`,
    by default prior / (2 sqrt(positives)), about thrice the noise of a common word.
    """
    if not positive or not unlabelled or not prior:
        return Model(np.zeros(0, U64), np.zeros(0), -1.0)
    documents = [*positive, *unlabelled]
    vocabulary, count = np.unique(np.concatenate(documents), return_counts=True)
    vocabulary = vocabulary[count >= min_docs]
    flat = np.concatenate(documents)
    row = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    at = np.searchsorted(vocabulary, flat)
    at[at == len(vocabulary)] = 0
    keep = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    row, at = row[keep], at[keep]
    n, n_p, size = len(documents), len(positive), len(vocabulary)
    penalty = prior / (2 * np.sqrt(n_p)) if penalty is None else penalty
    is_p = np.arange(n) < n_p
    p_weight, u_weight = prior / n_p, 1 / (n - n_p)
    w, b = np.zeros(size), np.log(prior / (1 - prior)) if prior < 1 else 1.0
    free = np.ones(size, bool)
    for step in range(2 * rounds):
        if step == rounds:  # the features are chosen; their weights are no longer shrunk
            free, penalty = w != 0, 0.0
            chosen = free[at]
            row, at = row[chosen], at[chosen]
        g = np.clip(b + np.bincount(row, w[at], n), -30, 30)
        s = 1 / (1 + np.exp(-g))
        as_negative = np.log1p(np.exp(g))  # l(-g)
        negative_risk = u_weight * as_negative[~is_p].sum() - p_weight * as_negative[is_p].sum()
        part = np.where(is_p, -p_weight * s, u_weight * s)
        own = np.where(is_p, -p_weight * (1 - s), 0.0)
        d = own + part if negative_risk >= 0 else -part
        if step >= rounds:  # few positives leave the weights uncertain: they shrink by that
            w *= 1 - rate * prior / n_p
        w -= rate * np.bincount(at, d[row], size)
        b -= rate * d.sum()
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * penalty)
    used = w != 0
    # no more of the unlabelled than the prior can be toxic: the highest scores are
    g = np.sort(b + np.bincount(row, w[at], n)[~is_p])[::-1]
    b -= max(0.0, g[min(len(g) - 1, int(prior * len(g)))])
    return Model(vocabulary[used], w[used], float(b))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            found = list(features(Words(part.column("text"))))
            doc, value = np.concatenate([d for d, _ in found]), np.concatenate([v for _, v in found])
            order = np.lexsort((value, doc))
            doc, value = doc[order], value[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])] if len(doc) else np.zeros(0, bool)
            counts = np.bincount(doc[new], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), list_array(value[new].view(np.int64), counts, pa.int64())], ["toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None, **params) -> Model:
    """Fit on at most `positives` documents labelled toxic and `unlabelled` documents of the corpus.

    The unlabelled are drawn from all documents, whatever their labels: the risk is corrected by
    the share of toxic ones among them.
    prior: the share of toxic documents; without it, the share among the labelled ones.
    An id with several labels is toxic if one of them says so; null ids and labels don't count.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    if prior is None:
        prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    toxic = known.where("toxic = 1").select("id")
    ps = toxic.orderBy(F.xxhash64("id"), "id").limit(positives).select("id", F.lit(1).alias("toxic"))
    others = docs.select(F.col(id_col).alias("id")).where("id is not null")
    us = others.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(unlabelled).distinct().select("id", F.lit(0).alias("toxic"))
    sample = ps.union(us)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("toxic", "text")  # sample: bounded above
    rows = texts.mapInArrow(lean(_features), "toxic int, words array<long>").toArrow()
    split = {0: [], 1: []}
    for batch in rows.to_batches():
        column = batch.column("words")
        flat = column.flatten().to_numpy().view(U64)
        ends = np.cumsum(np.r_[0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
        for k, t in enumerate(batch.column("toxic").to_pylist()):
            split[t].append(flat[ends[k] : ends[k + 1]])
    return fit(split[1], split[0], prior, **params)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, 1):
                score = model.scores(Words(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(score, 6)), pa.array(score > 0)], ["id", "score", "toxic"])

    return run


def _clean(shared, at: int):
    """The rows of batches that aren't toxic, by the text in column `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, at):
                yield part.filter(pa.array(model.scores(Words(part.column(at).cast(pa.string()))) <= 0))

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(doc_id, score, toxic) of every row; toxic where the score is above 0.

    Rows are scored one by one over their whole texts: repeated rows get equal scores, null
    and empty texts get the bias, null ids are kept, extra columns of any name aren't read.
    No labels: nothing is toxic. No rows: none.
    """
    model = train(docs, labels, id_col, text_col, **params)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = picked.mapInArrow(lean(_score(shared)), f"id {picked.dtypes[0][1]}, score double, toxic boolean")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without the rows that the classifier calls toxic, judged row by row as by classify().

    Repeated rows go or stay together; null and empty texts stay (their score is the bias, which
    is negative), rows with a null id are judged by their text. All columns pass, whatever their
    names. No labels: all rows stay. No rows: none.
    """
    model = train(docs, labels, id_col, text_col, **params)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lean(_clean(shared, docs.columns.index(text_col))), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
