"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are scored by their log-odds between toxic and other labelled texts with an informative Dirichlet prior, the prior being all
labelled texts together; tokens whose log-odds are not significant get one small negative score. A linear-time scan finds all
maximal scoring segments of a text. A segment of score S in a text of n tokens has the extreme-value significance
x = lambda * S - ln(K * n), with lambda from the background frequencies of the scores and K from the best segments of texts that
are not toxic. A logistic curve, fitted to labelled texts that took no part in the scores, turns them into a score from 0 to 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_train, cut_table, drop_tables, release, table

#: Labelled texts that are learned from at most: those with the least hashes of their ids. Of 3 in a row, 2 go to the scores.
SAMPLE = 20_000
#: Strength of the prior in texts; the least size of a token's log-odds, its least z, and least number of toxic texts that hold it. The first
#: three are chosen by log loss over three folds of the rows whose labels may be learned from: the size among 0.75, 1.5 and 2.25, strength
#: and z among 15, 50, 150 and 2, 3, 4, 5 (0.0526 for these, which have the best area under the curve; from 0.0523 up to 0.1373).
PRIOR, LEAST_ODDS, LEAST_Z, LEAST_TEXTS = 50.0, 1.5, 4.0, 3
TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of word starts that are counted beside whole words, for inflected forms.
STARTS = (7, 6, 5, 4)


@dataclass
class Model:
    """Bounded by the significant tokens of the labelled sample."""

    scores: dict[str, float]
    other: float
    rate: float
    log_k: float
    curve: tuple[float, float, float]

    def __post_init__(self):
        self.words = WordScores(self.scores, self.other)


class WordScores(dict):
    """A word's score: its own, or else that of the longest of its starts that has one; words seen before are kept, up to a bound."""

    limit = 100_000

    def __init__(self, scores: dict[str, float], other: float):
        super().__init__()
        self.scores, self.other = scores, other

    def __reduce__(self):
        return WordScores, (self.scores, self.other)

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        got = self.scores.get(word)
        if got is None:
            got = next((v for k in STARTS if len(word) > k and (v := self.scores.get(word[:k] + "*")) is not None), self.other)
        self[word] = got
        return got


def terms(text: str | None) -> set[str]:
    """Distinct words and word starts of a text."""
    words = set(TOKEN.findall(text.lower())) if text else set()
    return words | {w[:k] + "*" for w in words for k in STARTS if len(w) > k}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, sum), from left to right, in linear time: the scan of Ruzzo and Tompa
    over the runs of positive scores."""
    if not len(scores):
        return []
    up = np.flatnonzero(np.diff(np.concatenate([[0], (scores > 0).astype(np.int8), [0]])))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum until, last one with a lower sum before
    for a, b in zip(up[::2].tolist(), up[1::2].tolist()):
        low, high = float(total[a]), float(total[b])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((a, b, low, high, j))
                break
            a, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def token_scores(text: str | None, model: Model) -> np.ndarray:
    words = TOKEN.findall(text.lower()) if text else []
    return np.fromiter(map(model.words.__getitem__, words), np.float64, len(words))


def evidence(s: np.ndarray, model: Model, significance: float = 0.0) -> tuple[float, float, list[tuple[int, int, float]]]:
    """The best segment's significance, the sum of all significant ones' beyond the best, and the significant segments."""
    if not len(s):
        return -10.0, 0.0, []
    log_n = np.log(len(s)) + model.log_k
    x = [(a, b, model.rate * v - log_n) for a, b, v in segments(s)]
    found = [y for y in x if y[2] > significance]
    best = max((y[2] for y in x), default=-10.0)
    return max(best, -10.0), min(sum(y[2] for y in found) - max(best, 0.0), 60.0), found


def score(s: np.ndarray, model: Model) -> float:
    """0 to 1; a text without tokens gets what the curve gives for no segment."""
    best, rest, _ = evidence(s, model)
    a, b, c = model.curve
    return float(1 / (1 + np.exp(-np.clip(a + b * min(best, 40.0) + c * rest, -30, 30))))


def decay(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * values)) = 1."""
    if values.max() <= 0 or (values * share).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (share * np.exp(high * values)).sum() < 1 and high < 100:
        high *= 2
    for _ in range(80):
        rate = (low + high) / 2
        low, high = (rate, high) if (share * np.exp(rate * values)).sum() < 1 else (low, rate)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic curve; ridge holds them when classes part cleanly."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hold = np.eye(len(w)) * ridge
        hold[0, 0] = 1e-3
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + hold, x.T @ (p - y) + hold @ w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled texts, of rows whose labels may be learned from. Without labels of both kinds the
    model has no token scores, and scores follow the share of toxic labels. Of rows that share an id one text counts, and any label of
    1; null ids, labels and texts teach nothing or an empty text."""
    chosen = labels.where(crc_train(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id").limit(sample))  # bounded by sample
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    # Rows that share an id are one text, that of the least: else a label could count for many.
    texts = rows.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    # Written: they are read for the counts, the segments and the curve.
    texts = cut_table(texts.withColumn("scores", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) < 2), scratch := [])

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, toxic = Counter(), Counter()
            for t, y in zip(b["text"], b["y"]):
                found = {""} | terms(t)
                texts.update(found)
                if y:
                    toxic.update(found)
            yield pd.DataFrame({"w": list(texts), "toxic": [toxic[w] for w in texts], "texts": list(texts.values())})
            del b, texts, toxic, found
            release()

    counts = texts.where("scores").select("text", "y").mapInPandas(tokens, "w string, toxic long, texts long")
    counts = counts.groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))
    whole = counts.where("w = ''").first()
    if whole is None or not 0 < whole["toxic"] < whole["texts"]:
        drop_tables(docs.sparkSession, scratch)
        share = (whole["toxic"] + 0.5) / (whole["texts"] + 1) if whole is not None else 0.5
        return Model({}, -1.0, 1.0, 0.0, (float(np.log(share / (1 - share))), 0.0, 0.0))
    n1, n = float(whole["toxic"]), float(whole["texts"])
    n0, share = n - n1, F.col("texts") / n
    a1, a0 = F.col("toxic") + share * PRIOR, F.col("texts") - F.col("toxic") + share * PRIOR
    odds = F.log(a1 / (n1 + PRIOR - a1 + 0.5)) - F.log(a0 / (n0 + PRIOR - a0 + 0.5))
    z = odds / F.sqrt(1 / a1 + 1 / a0)
    top = counts.where("w <> ''").select("w", "texts", odds.alias("odds"), z.alias("z"), "toxic").where((F.abs("z") >= LEAST_Z) & (F.abs("odds") >= LEAST_ODDS) & ((F.col("z") < 0) | (F.col("toxic") >= LEAST_TEXTS)))
    top = top.orderBy("w").collect()  # bounded by the sample's tokens
    scores = {r["w"]: float(np.clip(r["odds"], -3, 6)) for r in top}
    model = Model(scores, -0.25, 1.0, 0.0, (0.0, 1.0, 0.0))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, y in zip(b["text"], b["y"]):
                s = token_scores(text, model)
                kinds, times = np.unique(np.round(s, 1), return_counts=True)
                rows.append((int(y), len(s), kinds.tolist(), times.tolist(), max((v for _, _, v in segments(s)), default=0.0)))
            yield pd.DataFrame(rows, columns=["y", "n", "kinds", "times", "best"])

    rest = texts.where(~F.col("scores")).select("text", "y")
    seen = rest.mapInPandas(look, "y int, n long, kinds array<double>, times array<long>, best double").toPandas()  # bounded by sample
    clean = seen[(seen["y"] == 0) & (seen["n"] > 0)]
    if not len(clean) or not (seen["y"] == 1).any():
        drop_tables(docs.sparkSession, scratch)
        return Model(scores, model.other, 1.0, 0.0, (-3.0, 1.0, 0.0))
    background = pd.Series(np.concatenate(clean["times"].to_list())).groupby(np.concatenate(clean["kinds"].to_list())).sum()
    model.rate = decay(background.index.to_numpy(), (background / background.sum()).to_numpy())
    # With the rate known, the most likely K for best segments S: number of texts / sum of n * exp(-rate * S).
    model.log_k = float(np.log(len(clean) / (clean["n"].to_numpy() * np.exp(-model.rate * clean["best"].to_numpy())).sum()))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [evidence(token_scores(text, model), model)[:2] for text in b["text"]]
            yield pd.DataFrame({"best": [min(best, 40.0) for best, _ in found], "rest": [more for _, more in found], "y": b["y"]})

    x = rest.mapInPandas(weigh, "best double, rest double, y int").toPandas()  # bounded by sample
    model.curve = tuple(float(w) for w in logistic(x[["best", "rest"]].to_numpy(), x["y"].to_numpy(float)))
    drop_tables(docs.sparkSession, scratch)
    return model


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages): passages are the significant segments as start:end:significance in tokens, joined by commas.

    Null texts count as empty; every row gives a row, repeated or not, with a null id or not; texts of any length are read whole, in
    linear time; the empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                s = token_scores(text, model)
                rows.append((score(s, model), ",".join(f"{a}:{e}:{x:.2f}" for a, e, x in evidence(s, model)[2])))
            yield pd.DataFrame({"id": b["id"], "score": [r[0] for r in rows], "passages": [r[1] for r in rows]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInPandas(run, f"id {kind}, score double, passages string").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below ``least``, as they are: one pass, no join. Null and empty texts stay where the model
    takes them for clean; repeated rows, null ids and columns of any name pass; the empty table stays empty."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([score(token_scores(x, model), model) for x in t])
            del t
            release()

    return docs.where(scored(F.col(text_col)) < least)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """score_texts() of documents by a model of their labels: one row for each row."""
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~crc_train("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
