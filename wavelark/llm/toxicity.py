"""Toxicity by classifier chains: categories in order, each linear model fed the probabilities of those before it."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

WORD = re.compile(r"[^\W\d_]+")
#: Beside each word, its first letters are a feature: they stand for its inflected forms.
STEM = 5
FOLDS = 5


def features(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class Chain:
    """One linear model for each category: weights of text features, of earlier categories, bias and threshold."""

    categories: list[str]
    index: dict[str, int]
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        """found: numbers of the features that a text has."""
        out = np.zeros(len(self.categories))
        sums = self.weights[:, found].sum(axis=1) + self.bias
        for c in range(len(out)):
            out[c] = sigmoid(sums[c] + self.earlier[c, :c] @ logit(out[:c]))
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_linear(rows: list[np.ndarray], n: int, extra: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 250) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on sparse 0/1 rows and dense extra columns, by accelerated gradient steps."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    m = max(1, len(rows))
    w, v, b = np.zeros(n), np.zeros(extra.shape[1]), logit(y.mean() if len(y) else 0.5)
    prior = (w, v, b)
    longest = max([1, *map(len, rows)])
    rate = 4 / (0.25 * m * (1 + min(longest, 60)) + ridge)
    for t in range(steps):
        beta = t / (t + 3)
        w2, v2, b2 = (x + beta * (x - p) for x, p in zip((w, v, b), prior, strict=True))
        z = np.bincount(of, w2[at], len(rows)) + extra @ v2 + b2
        r = sigmoid(z) - y
        prior = (w, v, b)
        w = w2 - rate * (np.bincount(at, r[of], n) + ridge * w2)
        v = v2 - rate * (extra.T @ r + ridge * v2)
        b = b2 - rate * r.sum()
    return w, v, float(b)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway between the out-of-fold probabilities around the cut of the best F1 score, 0.5 if a class is absent."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1  # no cut between equal probabilities
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = 12_000, max_features: int = 3000, min_found: int = 3) -> Chain:
    """Fit the chain on at most about ``max_rows`` labelled documents, drawn by a hash of their doc_id.

    Features are counted on the executors; the ``max_features`` that tell a category apart most significantly come to
    the driver, with the sample's rows in terms of them. A feature of fewer than ``min_found`` documents is none. Texts that are near copies of one another are kept once, as
    they would make chance words look telling. Rows with a null label in any category are left out.
    """
    known = labels.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*categories, "doc_id"])).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(f"_y{i}") for i, c in enumerate(categories)])
    n = known.count()
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(2**53)
    sample = known.filter(draw < min(1.0, max_rows / max(n, 1)))
    ys = [f"_y{i}" for i in range(len(categories))]
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", *ys)

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [sorted(features(t)) for t in b.column(1).to_pylist()]
        signs = [sign(s) for s in sets]
        return pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(signs, pa.int64()), pa.array(sets, pa.list_(pa.string()))], ["doc_id", *ys, "sign", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = arrow_map(texts, spread, f"doc_id {kind}, " + ", ".join(f"{y} int" for y in ys) + ", sign long, found array<string>").persist()
    single = F.broadcast(sets.groupBy("sign").agg(F.min("doc_id").alias("doc_id")))  # at most a row for each of the sample
    rows = sets.join(single, ["sign", "doc_id"]).dropDuplicates(["doc_id"])
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).first()
    counted = rows.select(*ys, F.explode("found").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys])
    # How far the share of a category among the feature's documents is from its share of all, in standard errors.
    scores = [F.abs(F.col(y) - F.col("n") * (share := totals[y] / max(totals["n"], 1))) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9)) for y in ys]
    top = counted.filter(F.col("n") >= min_found).select("feature", F.greatest(*scores, F.lit(0.0)).alias("z")).filter("z > 4").orderBy(F.desc("z"), "feature").limit(max_features)
    names = [r["feature"] for r in top.collect()]
    index = {name: i for i, name in enumerate(names)}

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(index[x] for x in s if x in index) for s in b.column(b.schema.get_field_index("found")).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("doc_id", *ys)] + [pa.array(found, pa.list_(pa.int32()))], ["doc_id", *ys, "found"])

    got = arrow_map(rows.select("doc_id", *ys, "found"), encode, f"doc_id {kind}, " + ", ".join(f"{y} int" for y in ys) + ", found array<int>").orderBy("doc_id").toArrow()
    sets.unpersist()
    ids, found = got.column("doc_id").to_pylist(), got.column("found").combine_chunks()
    flat, edges = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64), found.offsets.to_numpy()
    edges = edges - edges[0] if len(edges) else np.zeros(1, np.int64)
    y = np.array([got.column(y).to_numpy() for y in ys], float).T.reshape(len(ids), len(ys))
    return fit_chain(np.split(flat, edges[1:-1]) if len(ids) else [], y, [xxhash.xxh32_intdigest(str(i)) % FOLDS for i in ids], index, categories)


def sign(found: list[str]) -> int:
    """Near copies mostly share this: the least hashes of a text's features under three seeds."""
    if not found:
        return 0
    raw = [f.encode() for f in found]
    return xxhash.xxh64_intdigest(b"".join(min(xxhash.xxh64_digest(r, seed=s) for r in raw) for s in (1, 2, 3))) >> 1


def fit_chain(rows: list[np.ndarray], y: np.ndarray, folds: list[int], index: dict[str, int], categories: list[str]) -> Chain:
    """The chain's models; each later one is trained on out-of-fold probabilities of the earlier ones."""
    k, n, m = len(categories), len(index), len(rows)
    fold = np.array(folds, np.int64)
    out_of_fold = np.zeros((m, k))
    weights, earlier, bias, thresholds = np.zeros((k, n)), np.zeros((k, k)), np.zeros(k), np.full(k, 0.5)
    for c in range(k):
        extra = logit(out_of_fold[:, :c])
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(test) or not len(train):
                continue
            w, v, b = fit_linear([rows[i] for i in train], n, extra[train], y[train, c])
            out_of_fold[test, c] = [sigmoid(w[rows[i]].sum() + extra[i] @ v + b) for i in test]
        if m:
            weights[c], earlier[c, :c], bias[c] = fit_linear(rows, n, extra, y[:, c])
            thresholds[c] = best_threshold(out_of_fold[:, c], y[:, c])
        else:
            bias[c] = -30.0
    return Chain(list(categories), index, weights, earlier, bias, thresholds)


def score(docs: DataFrame, chain: Chain, keep: list[str]) -> DataFrame:
    """``keep`` and for each category its probability ``p_<category>`` and decision ``is_<category>``, of whole texts.

    A null or empty text has no features and gets what the models say of none. Each row is scored for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    inner = docs.select(F.struct(*keep).alias("_kept"), "text")
    names = [f"p_{c}" for c in chain.categories]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        model: Chain = shared.value
        get = model.index.get
        p = np.zeros((b.num_rows, len(names)))
        for i, text in enumerate(b.column(1).to_pylist()):
            p[i] = model.probabilities(np.array(sorted(x for f in features(text) if (x := get(f)) is not None), np.int64))
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, j]) for j in range(len(names))]], ["_kept", *names])

    out = arrow_map(inner, batch, f"_kept {inner.schema['_kept'].dataType.simpleString()}, " + ", ".join(f"`{x}` double" for x in names))
    return out.select(*[F.col("_kept")[c].alias(c) for c in keep], *names, *[(F.col(f"p_{c}") >= float(t)).alias(f"is_{c}") for c, t in zip(chain.categories, chain.thresholds, strict=True)])


#: The order of the chain on the table ``labels``: whether a text is of good quality, then whether it is toxic.
CATEGORIES = ["quality", "toxic"]


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], **limits: int) -> DataFrame:
    """Fit the chain on the labelled documents and score all: p_quality, is_quality, p_toxic, is_toxic beside ``keep``."""
    return score(docs, fit(docs, labels, CATEGORIES, **limits), keep)
