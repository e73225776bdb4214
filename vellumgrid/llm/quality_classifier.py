"""A quality classifier by positive-unlabelled learning.

The model is a logistic score over binned features of the whole text, fitted by minimising the non-negative unbiased
risk  prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1)):  when the second term turns negative, the step goes
back up its gradient instead. Trusted positives are rows with labels.quality = 1; the unlabelled text is any text; the
class prior is an input of train(), estimated where none is given by estimated_prior(). Only rows of the training folds
(crc32(doc_id) mod 4 <> 2) are used, for labels and text alike, and nothing but the text enters a score.

The fit is on samples bounded by two parameters of train(), max_positives and max_unlabelled, in rows and not in ids;
they are drawn from all rows by a hash of identity and text. Their features (some sixty numbers each) reach the driver;
scoring is one pass over all texts in Arrow batches.

Defined results: null and blank texts are scored by the features of an empty text; with no trusted positives (an
empty table of labels) every score is 0.5; several labels of one doc_id count as the smallest; labels other than 0 and
1 and rows with a null doc_id train nothing, the latter still get a score; rows equal in doc_id and text train once and
get the same score each; other columns are neither read nor lost, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from vellumgrid.llm._shared import identified, table

#: Rows that a fit reads at most: defaults of the parameters of train().
MAX_POSITIVES = MAX_UNLABELLED = 8_000
BINS, STEPS, RATE, DECAY = 12, 400, 0.05, 1e-4
THRESHOLD = 0.7
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text: its bytes, words, lines and their repetition."""
    b = (text or "").encode("utf-8", "replace")
    n = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    size = max(len(b), 1)
    words = b.split()
    k = max(len(words), 1)
    lines = [x for x in b.split(b"\n") if x.strip()]
    seen = Counter(words)
    triples = len(words) - 2
    upper, lower = int(n[65:91].sum()), int(n[97:123].sum())
    word_bytes = sum(map(len, words))
    out = [np.log1p(len(words)), np.log1p(len(lines)), word_bytes / k, len(seen) / k, (max(seen.values()) if seen else 0) / k]
    out += [len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples > 0 else 1.0, len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1)]
    out += [upper / size, lower / size, upper / max(upper + lower, 1), int(n[48:58].sum()) / size, int(n[128:].sum()) / size, int(n[:32].sum()) / size, int(n[32]) / size]
    out += [int(n[c]) / k for c in _PUNCTUATION]
    return np.array(out, np.float32)


@dataclass
class Model:
    cuts: np.ndarray  # (features, bins - 1)
    weights: np.ndarray  # (features, bins)
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, cut in enumerate(self.cuts):
            z += self.weights[j, np.searchsorted(cut, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _bins(cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each feature's bin among all features' bins."""
    wide = cuts.shape[1] + 1
    return np.stack([np.searchsorted(cut, x[:, j], side="right") + j * wide for j, cut in enumerate(cuts)], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def risk(w: np.ndarray, c: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positive part of the risk, the part that must not be negative, and the gradient to go down, by weights and bias: that of the whole risk, or, where the second part is negative, its own turned round. Logistic loss; p and u hold the places of each row's bins."""
    sp, su = sigmoid(w[p].sum(axis=1) + c), sigmoid(w[u].sum(axis=1) + c)
    positive = -prior * np.log(np.maximum(sp, 1e-12)).mean()
    negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()

    def spread(bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bincount(bins.ravel(), weights=np.repeat(rows, bins.shape[1]), minlength=len(w))

    # d/dz of l(z, +1) is s - 1, of l(z, -1) is s.
    gp, gu, gn = prior * (sp - 1) / len(p), su / len(u), prior * sp / len(p)
    down = np.append(spread(u, gu) - spread(p, gn), gu.sum() - gn.sum())
    if negative >= 0:
        return positive, negative, np.append(spread(p, gp), gp.sum()) + down
    return positive, negative, -down


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative risk with the logistic loss, by Adam over the full samples; deterministic."""
    both = np.concatenate([positive, unlabelled])
    cuts = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    # Rare values sit beyond the last quantile that isn't the mode; a cut in each tail tells them apart.
    tails = np.quantile(both, [0.02, 0.96, 0.98, 0.995], axis=0).T.astype(np.float32)
    cuts = np.sort(np.concatenate([cuts, tails], axis=1), axis=1)
    p, u = _bins(cuts, positive), _bins(cuts, unlabelled)
    w, c = np.zeros(cuts.size + len(cuts)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        g = risk(w, c, p, u, prior)[2]
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, c = w - step[:-1], c - step[-1]
    return Model(cuts, w.reshape(cuts.shape[0], -1), c)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 3) -> float:
    """The share of positives among unlabelled rows, from positives and unlabelled rows alone.

    A model is fitted on one half of each. On the other half the prior is the ratio of the unlabelled to the positive
    share above a threshold, at the threshold where it is least, both taken with their margins of error. Both halves
    take their turns, and the model of the next round has the prior of the last, beginning with a half: the better the
    model, the fewer negatives stand above its thresholds.
    """
    prior = 0.5
    error = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive) // 2) + 1 / np.sqrt(len(unlabelled) // 2))
    for _ in range(rounds):
        found = []
        for k in (0, 1):
            model = fit(positive[k::2], unlabelled[k::2], prior)
            sp, su = np.sort(model.score(positive[1 - k :: 2])), np.sort(model.score(unlabelled[1 - k :: 2]))
            at = np.unique(sp)
            above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
            best = np.argmin((above_u + error) / np.maximum(above_p, 1e-9))
            found.append(min(max(above_u[best] / above_p[best], 0.02), 0.98))
        prior = float(np.mean(found))
    return prior


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features_of(text: Column) -> Column:
    @arrow_udf("array<float>")
    def measured(text: pa.Array) -> pa.Array:
        return pa.array([features(t).tolist() for t in text.to_pylist()], pa.list_(pa.float32()))

    return measured(text)


def _drawn(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` rows (doc, mark) of ids, the least by hash. So few pass the first cut that one task can order them."""
    order, total = F.xxhash64("doc", "mark", F.lit("sample")), ids.count()
    share = min(1.0, 2 * most / max(total, 1))
    return ids.where(order.bitwiseAND(F.lit((1 << 62) - 1)) <= F.lit(int(share * ((1 << 62) - 1)))).orderBy(order, "doc", "mark").limit(most)


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model | None:
    """The model from docs (doc_id, text) and labels (doc_id, quality); None without positives or text to learn from. At most max_positives positive and max_unlabelled unlabelled rows are fitted."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min("quality").alias("quality"))
    rows = identified(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))).select("doc", "mark", "text")
    ids = rows.select("doc", "mark")
    pos = _drawn(ids.join(known.where("quality = 1"), "doc", "left_semi").distinct(), max_positives).withColumn("p", F.lit(True))
    unl = _drawn(ids.distinct(), max_unlabelled).withColumn("u", F.lit(True))
    # Both samples are of bounded size, so they can be broadcast, and rows equal to a sampled one are dropped before they are sent on.
    chosen = rows.join(F.broadcast(pos.join(unl, ["doc", "mark"], "full_outer")), ["doc", "mark"]).dropDuplicates(["doc", "mark"])
    found = chosen.select("doc", "mark", "p", "u", _features_of(F.col("text")).alias("x")).collect()
    found.sort(key=lambda r: (r.mark, r.doc))
    p, u = (np.array([r.x for r in found if r[k]], np.float32) for k in ("p", "u"))
    if min(len(p), len(u)) < 2:
        return None
    return fit(p, u, estimated_prior(p, u) if prior is None else prior)


def score_column(model: Model | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.5)

    @arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([features(t) for t in text.to_pylist()], np.float32)) if len(text) else [], pa.float64())

    return scored(text.cast("string"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents whose score is under THRESHOLD, all columns kept. With no model nothing is rejected."""
    model = train(docs, labels)
    if model is None:
        return docs
    return docs.select(F.struct("*").alias("row"), score_column(model, F.col("text")).alias("score")).where(F.col("score") >= THRESHOLD).select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
