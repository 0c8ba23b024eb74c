"""Quality classifier from positive and unlabelled documents.

A linear model on the shapes of a text (trigrams of character classes, shares of
distinct words and lines, of the corpus's frequent words) minimises the
non-negative unbiased risk of positive-unlabelled learning (Kiryo et al., 2017):
trusted positives, unlabelled texts and a class prior that is estimated from these
two (the risk takes a lower bound of it, ``Model.prior`` is the estimate). What remains supervised is the last step alone: labels of both classes give the
slope and the shift that turn the margin into a probability.

Fitting reads bounded samples (parameters below), of labelled rows and of unlabelled
ones: a model of some 500 weights does not gain from more. The frequent words are
counted over all documents; scoring reads every text whole.

Edge cases: a null text is the empty text; empty texts get a score like any other;
without labelled positives every score is the share of positive labels (0.5 without
labels); an id labelled both ways counts as unlabelled; repeated rows each get their
row; very long texts are read whole; a kept column named score is replaced by the
result, other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialseg.llm.columns import declared, fresh, without

#: Most rows, on average, that fitting reads of positives, of unlabelled rows and of labelled rows for calibration.
POSITIVES, UNLABELLED, CALIBRATION = 4000, 8000, 4000
FREQUENT_WORDS = 400
#: Character classes lower, upper, digit, blank, line end, sentence mark, other sign, beyond ASCII.
CLASS = np.full(256, 7, np.int64)
CLASS[:128] = 6
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[[9, 32]], CLASS[[10, 13]] = 3, 4
CLASS[[33, 34, 39, 44, 46, 58, 59, 63]] = 5
WIDTH = 512 + 6


def features(text: str | None, frequent: frozenset[bytes]) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float32)
    c = CLASS[np.frombuffer(raw, np.uint8)]
    if len(c) > 2:
        out[:512] = np.sqrt(np.bincount(c[:-2] * 64 + c[1:-1] * 8 + c[2:], minlength=512) / (len(c) - 2))
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x]
    n = max(1, len(words))
    # the share of distinct words falls with length in any text; it is taken over runs of 200 words
    runs = [words[i : i + 200] for i in range(0, len(words), 200)]
    distinct = sum(len(set(r)) for r in runs) / n
    hits = sum(w in frequent for w in words) / n
    out[512:] = (np.log1p(len(words)) / 10, distinct, len(set(lines)) / max(1, len(lines)), min(20.0, len(raw) / n) / 10, min(1.0, 4 * hits), 1.0 if words else 0.0)
    return out


@dataclass
class Model:
    frequent: frozenset[bytes]
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 60, step: float = 0.01, decay: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights that minimise the non-negative risk: pi * E_p[l(z)] + max(0, E_u[l(-z)] - pi * E_p[l(-z)]), logistic loss, Adam on minibatches."""
    rng = np.random.default_rng(seed)
    d = pos.shape[1]
    w, m, v, t = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1), 0
    pos, unl = np.hstack([pos, np.ones((len(pos), 1))]), np.hstack([unl, np.ones((len(unl), 1))])
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    batches = max(1, min(len(pos), len(unl)) // 256)
    for _ in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches), strict=True):
            xp, xu = pos[p], unl[u]
            zp, zu = xp @ w, xu @ w
            neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_neg = (sig(zu)[:, None] * xu).mean(axis=0) - prior * (sig(zp)[:, None] * xp).mean(axis=0)
            g_pos = -prior * (sig(-zp)[:, None] * xp).mean(axis=0)
            g = g_pos + g_neg if neg >= 0 else -g_neg
            g[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of ``y`` at margins ``z``, by Newton steps; the targets are drawn in by half a row."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h + 1e-9 * np.eye(2), g)
    return float(max(a, 1e-3)), float(b)


def thinned(df: DataFrame, key: str, most: int, rows: int, seed: int) -> DataFrame:
    """About ``most`` of ``rows`` rows, by a hash of their key; all of them if there are fewer."""
    return df if rows <= most else df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(most / rows * (1 << 30)))


def feature_rows(df: DataFrame, keep: list[str], frequent: frozenset[bytes]) -> DataFrame:
    keep, text = without(keep, ("x",)), fresh("text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py(), frequent) for t in b.column(text)]
            yield pa.record_batch([*(b.column(k) for k in keep), pa.array(x, pa.list_(pa.float32()))], names=[*keep, "x"])

    return df.select(*keep, F.col("text").alias(text)).mapInArrow(run, f"{declared(df, keep)}x array<float>")


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 9) -> tuple[float, float]:
    """Share of positives among unlabelled rows, and a lower bound of it, from positives and unlabelled rows alone (Blanchard et al., 2010): of all margins, the least ratio of unlabelled to positive rows above it, with a standard error added for the few rows of a tail; the bound takes two off there instead. The margins are fitted on one half of the rows and counted on the other."""
    rng = np.random.default_rng(seed)
    found = []
    p, u = (np.array_split(rng.permutation(len(x)), 2) for x in (pos, unl))
    for a, b in ((0, 1), (1, 0)):
        if not (len(p[a]) and len(p[b]) and len(u[a]) and len(u[b])):
            continue
        w, bias = fit_nnpu(pos[p[a]], unl[u[a]], 0.5, epochs=20)
        zp, zu = np.sort(pos[p[b]] @ w + bias), np.sort(unl[u[b]] @ w + bias)
        at = np.quantile(zp, np.linspace(0, 0.9, 46))
        above_p, above_u = 1 - np.searchsorted(zp, at) / len(zp), 1 - np.searchsorted(zu, at) / len(zu)
        error = np.sqrt(above_u * (1 - above_u) / len(zu)) + np.sqrt(above_p * (1 - above_p) / len(zp))
        best = np.argmin((above_u + error) / above_p)
        found.append([(above_u[best] + k * error[best]) / above_p[best] for k in (1, -2)])
    return tuple(np.clip(np.mean(found, axis=0), 0.02, 0.98).tolist()) if found else (0.5, 0.5)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from (id, text) ``docs`` and (id, 0 or 1) ``labels``, both of the training rows alone. An id that is labelled both ways counts as unlabelled."""
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("other")).where("y = other").drop("other")
    sizes = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg, n_docs = sizes.get(1, 0), sizes.get(0, 0), docs.count()
    # bounded samples of ids, small enough to be sent to the documents
    pos = thinned(labels.where("y = 1"), id_col, POSITIVES, n_pos, 1)
    neg = thinned(labels.where("y = 0"), id_col, CALIBRATION, n_neg, 2)
    marked = F.broadcast(pos.unionByName(neg))
    some = docs.where(F.col(id_col).isNotNull()).select(id_col, "text")
    known = some.join(marked, id_col)
    # an id may have many rows: then only some of its texts are fetched
    known = thinned(known, "text", 2 * (POSITIVES + CALIBRATION), some.select(id_col).join(marked, id_col).count(), 4)
    unl = thinned(some, id_col, UNLABELLED, n_docs, 3)
    unl = thinned(unl, "text", 2 * UNLABELLED, unl.select(id_col).count(), 5)
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))).alias("w")).where("w <> ''")
    frequent = frozenset(r["w"].encode() for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(FREQUENT_WORDS).collect())
    own = feature_rows(known, ["y"], frequent).toArrow()
    other = feature_rows(unl.withColumn("y", F.lit(-1)), ["y"], frequent).toArrow()
    wide = lambda t: t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)
    y, x, u = own.column("y").to_numpy(), wide(own), wide(other)
    if not (y == 1).any() or not len(u):
        prior = (n_pos + 1) / (n_pos + n_neg + 2)
        return Model(frequent, np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    mean, scale = u.mean(axis=0), u.std(axis=0) + 0.02
    good, all_of = (x[y == 1] - mean) / scale, (u - mean) / scale
    prior, least = class_prior(good, all_of)
    # a prior above the true one lets the risk of negatives fall below 0 and spoils the margins; one below costs little
    weight, bias = fit_nnpu(good, all_of, least)
    model = Model(frequent, mean, scale, weight, bias, prior=prior)
    z = model.margin(x)
    if (y == 0).any():
        # both classes as often as in all training labels
        again = np.concatenate([np.flatnonzero(y == 1), np.repeat(np.flatnonzero(y == 0), max(1, round(n_neg / max(1, (y == 0).sum()) * (y == 1).sum() / n_pos)))])
        model.slope, model.shift = fit_logistic(z[again], y[again].astype(float))
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and score, from the whole text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = without(keep, ("score",))
    text = fresh("text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.stack([features(t.as_py(), m.frequent) for t in part.column(text)])
                yield pa.record_batch([*(part.column(k) for k in keep), pa.array(m.score(x.astype(np.float64)), pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(run, f"{declared(docs, keep)}score double")
