"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled texts of quality 1, all texts are the unlabelled web; with the class prior pi the risk
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) is minimised with the logistic loss, whose minimiser estimates the probability of being
positive. With that loss the risk is convex where the second part is not negative, so it is minimised by Newton's steps, each one
pass over all unlabelled rows; a step that would take the second part below zero is halved until it doesn't. The prior comes from
positives and unlabelled rows alone: of a classifier of the ones against the others, the least ratio of the share of unlabelled rows
to the share of held-back positives that score above a threshold, each share with its confidence bound. Features describe the form of
a text: case, signs, word and line lengths, repetition; on top of them random cosine features let the model bend.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_train, cut_table, table

#: Labelled positives that are learned from at most, those with the least hashes of their ids.
POSITIVES = 8_000
#: Newton steps at most, and partial sums that come to the driver at once.
STEPS, PARTS = 30, 32
COSINES = 128
SIGNS = {name: np.frombuffer(chars.encode(), np.uint8) for name, chars in {"upper": string.ascii_uppercase, "lower": string.ascii_lowercase, "digit": string.digits, "stop": ".,;:", "cry": "!?", "odd": "#$%&*+/<=>@\\^_`{|}~", "quote": "\"'()-[]"}.items()}


@dataclass
class Model:
    """Of fixed size, whatever the data."""

    mean: np.ndarray
    spread: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray


def features(text: str | None) -> np.ndarray:
    """Form of a text, from the whole of it; an empty or null one has a vector too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k, m, letters = max(len(words), 1), max(len(lines), 1), None
    count = {name: int(histogram[at].sum()) for name, at in SIGNS.items()}
    letters = max(count["upper"] + count["lower"] + int(histogram[128:].sum()), 1)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], words[2:])))
    most = max(map(len, words), default=0)
    return np.array(
        [
            np.log1p(n), np.log1p(len(words)), n / k, most / (most + 30.0), count["upper"] / letters, count["digit"] / max(n, 1), count["stop"] / k, count["cry"] / k,
            count["odd"] / k, count["quote"] / k, int(histogram[128:].sum()) / max(n, 1), int(histogram[:32].sum()) / k, distinct / k**0.9, pairs / max(len(words) - 2, 1),
            len(set(lines)) / m, np.log1p(n / m), float(not words), np.sqrt(count["odd"] / k), np.sqrt(count["cry"] / k), np.sqrt(count["digit"] / max(n, 1)),
        ]
    )


def expanded(x: np.ndarray, m: Model) -> np.ndarray:
    z = np.clip((x - m.mean) / m.spread, -6, 6)
    return np.hstack([np.ones((len(z), 1)), z, np.cos(z @ m.turn + m.shift) * np.sqrt(2 / m.turn.shape[1])])


def vectors(batch: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(batch["x"]), np.float64).reshape(len(batch), -1)


def featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the features of every row, as float64 bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "x": [features(t).tobytes() for t in b["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInPandas(run, f"id {kind}, x binary")


def summed(rows: DataFrame, of) -> np.ndarray | None:
    """The sum of of(x) over all rows; what tasks have summed is summed again in PARTS groups before it comes to the driver."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                v = of(vectors(b))
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % PARTS], "v": [total.tobytes()]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.sum([np.frombuffer(v, np.float64) for v in sorted(group["v"])], axis=0).tobytes()]})

    got = rows.select("x").mapInPandas(part, "part int, v binary").groupBy("part").applyInPandas(whole, "v binary").collect()  # PARTS rows
    return np.sum([np.frombuffer(r["v"], np.float64) for r in sorted(got, key=lambda r: bytes(r["v"]))], axis=0) if got else None


def minimise(p: np.ndarray, rows: DataFrame, m: Model, prior: float | None, ridge: float = 2e-4) -> np.ndarray:
    """Weights of the least risk: the non-negative one with this prior, or, without one, of telling positives (p, expanded) from all rows."""
    k = p.shape[1]

    def look(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            z = expanded(x, m)
            f = np.clip(z @ w, -30, 30)
            s = 1 / (1 + np.exp(-f))
            return np.concatenate([[len(x), np.logaddexp(0, f).sum()], z.T @ s, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])

        v = summed(rows, of)
        v = v / v[0]
        f = np.clip(p @ w, -30, 30)
        s = 1 / (1 + np.exp(-f))
        hold, slope, curve = ridge / 2 * (w @ w), v[2 : 2 + k] + ridge * w, v[2 + k :].reshape(k, k) + ridge * np.eye(k)
        if prior is None:
            return hold + v[1] + np.logaddexp(0, -f).mean(), 0.0, slope - p.T @ (1 - s) / len(p), curve + (p * (s * (1 - s))[:, None]).T @ p / len(p)
        return hold + v[1] - prior * f.mean(), v[1] - prior * np.logaddexp(0, f).mean(), slope - prior * p.mean(axis=0), curve

    w, length = np.zeros(k), 1.0
    w[0] = 0.0 if prior is None else np.log(prior / (1 - prior))
    risk, _, slope, curve = look(w)
    step = np.linalg.solve(curve, slope)
    for _ in range(STEPS):
        new_risk, negative, new_slope, new_curve = look(w - length * step)
        if new_risk > risk + 1e-9 or negative < 0:
            length /= 2
            if length < 1e-3:
                break
            continue
        gained, w, risk = risk - new_risk, w - length * step, new_risk
        if gained < 1e-6:
            break
        step, length = np.linalg.solve(new_curve, new_slope), min(1.0, length * 2)
    return w


def estimated_prior(rows: DataFrame, m: Model, positive: np.ndarray, bins: int = 1000, doubt: float = 0.1) -> float:
    """The share of positives among all rows, by the best threshold of the model m; positive: features of positives held back from it."""
    at = lambda x: np.minimum((scores(x, m) * bins).astype(int), bins - 1)
    above = lambda counts: np.cumsum(counts[::-1])[::-1]
    u = above(summed(rows, lambda x: np.bincount(at(x), minlength=bins).astype(float)))
    p = above(np.bincount(at(positive), minlength=bins).astype(float))
    share_u, share_p = u / u[0], np.maximum(p / p[0], 1e-9)
    room = (np.sqrt(np.log(4 / doubt) / (2 * u[0])) + np.sqrt(np.log(4 / doubt) / (2 * p[0]))) * 1.01 / share_p
    best = int(np.argmin(share_u / share_p + room))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def scores(x: np.ndarray, m: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(expanded(x, m) @ m.weights, -30, 30)))


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", positives: int = POSITIVES, seed: int = 3) -> Model | None:
    """Learn from at most ``positives`` labelled rows of quality 1, whose labels may be learned from, and from all of ``rows`` (of
    featured()) without their labels. Of rows that share an id one stands for it as a positive. None without positives or rows."""
    usable = labels.where(crc_train(id_col) & (F.col(label_col) == 1)).select(F.col(id_col).alias("id")).distinct()
    usable = F.broadcast(usable.orderBy(F.xxhash64("id"), "id").limit(positives))  # bounded by positives
    known = rows.join(usable, "id").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").toPandas()  # bounded by positives
    if not len(known):
        return None
    moments = summed(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n, d, x = moments[0], (len(moments) - 1) // 2, vectors(known)
    mean = moments[1 : d + 1] / n
    spread, rng = np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 0)) + 1e-3, np.random.default_rng(seed)
    m = Model(mean, spread, rng.normal(size=(d, COSINES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, COSINES), np.zeros(0))
    held = rng.random(len(x)) < 1 / 3
    prior = 0.5
    if held.any() and not held.all():
        apart = replace(m, weights=minimise(expanded(x[~held], m), rows, m, None))
        prior = estimated_prior(rows, apart, x[held])
    return replace(m, weights=minimise(expanded(x, m), rows, m, prior))


def score_features(rows: DataFrame, model: Model | None) -> DataFrame:
    """(id, score) of rows of featured(): the higher, the likelier good; without a model 0.5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": scores(vectors(b), model) if model and len(b) else np.full(len(b), 0.5)})

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES) -> DataFrame:
    """(id, score) of every row of docs by a model that is learned from them and from the positives among labels.

    Null texts count as empty, and empty ones have a score too; every row gives a row, repeated or not, with a null id or not; texts
    of any length are read whole; without positives every score is 0.5; the empty table gives no rows; other columns are ignored,
    whatever their names. Features are written once, for training and scoring.
    """
    rows = cut_table(featured(docs, id_col, text_col))
    return score_features(rows, train(rows, labels, id_col, label_col, positives)).withColumnRenamed("id", id_col)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """quality() of documents: one row for each row."""
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~crc_train("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
