"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

1. Lexicon voters are found among words and word beginnings whose presence tells toxic training rows from clean ones;
   pattern voters look for insults by rule and for texts without any such word. Each votes toxic, clean or abstains.
2. The label model estimates, without labels, each voter's accuracy by expectation maximization, and
   the voters' correlations given the class. Correlated voters share their weight, as if they were fewer.
3. A logistic classifier over lexicon features is trained on the posteriors, then calibrated on training labels.

Fitting uses a bounded sample of labelled rows; scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, tidy

WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
CACHED = 150_000
#: A small seed lexicon of insults.
SEED = frozenset("idiot idiots moron morons loser losers scum trash stupid pathetic worthless disgusting clown clowns garbage dumb vermin hate kill".split())


class ToxicityModel(NamedTuple):
    features: dict[str, int]
    weights: np.ndarray  # by feature
    bias: float
    scale: float  # calibration of the margin
    shift: float
    voters: list[tuple[str, float]]  # name, accuracy
    correlations: np.ndarray
    rows: int = 0  # that it was fitted on


def word_features(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in STEMS if len(word) >= n)]


def pattern_votes(text: str, words: set[str], known: int) -> list[int]:
    """Votes of the patterns: 1 toxic, -1 clean, 0 abstains. known: how many lexicon features are present."""
    return [int(bool(words & SEED)), int(bool(words & SEED) and bool(INSULT.search(text.lower()))), 0 if known else -1]


#: Voters that correlate more than this, given the class, count as repeats of each other.
REDUNDANT = 0.7
PATTERNS = ("seed lexicon", "second person insult", "no lexicon word")
INSULT = re.compile(r"\b(?:you|your|he|she|they)(?: are| is|'re)? (?:an? |all |such )*(?:" + "|".join(sorted(SEED)) + r")\b")


def label_model(votes: np.ndarray, prior: float, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes (-1 clean, 0 abstains, 1 toxic); voters' accuracies; correlations.

    Expectation maximization over accuracies; abstaining is no evidence. Correlations are those of the votes given the
    class; voters that correlate share their weight, as one voter heard several times would.
    """
    n, m = votes.shape
    if not n or not m:
        return np.full(n, prior), np.full(m, 0.5), np.zeros((m, m))
    accuracy, weight, corr = np.full(m, 0.85), np.ones(m), np.eye(m)
    spoke = np.maximum(1, (votes != 0).sum(0))
    q = np.full(n, prior)
    for step in range(rounds):
        logit = np.log(prior / (1 - prior)) + votes @ (weight * np.log(accuracy / (1 - accuracy)))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        right = ((votes > 0) * q[:, None] + (votes < 0) * (1 - q)[:, None]).sum(0)
        accuracy = np.clip((right + 8) / (spoke + 10), 0.6, 0.995)
        if step >= rounds // 2:  # accuracies have settled; correlations follow the posteriors from here on
            means = [(votes * w[:, None]).sum(0) / max(1e-9, w.sum()) for w in (q, 1 - q)]
            centred = votes - q[:, None] * means[0] - (1 - q)[:, None] * means[1]
            sd = centred.std(0) + 1e-9
            corr = (centred.T @ centred) / n / np.outer(sd, sd)
            weight = 1 / np.maximum(1, np.where(corr > REDUNDANT, corr, 0).sum(1))
    return q, accuracy, corr


def fit_linear(rows: list[list[int]], target: np.ndarray, n_features: int, weight: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over sparse binary features, by gradient descent with momentum (Adam)."""
    index = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(n_features), -1.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[index], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.concatenate([np.bincount(index, g[owner], n_features) + l2 * w, [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 16_000, max_features: int = 4_000, voters: int = 160) -> ToxicityModel:
    """Fit on the labelled rows given (already without held-out ones).

    At most max_rows labelled rows are used, half of them toxic if there are so many, chosen by a hash of the id.
    Labels that repeat count once, toxic if any is; of several texts of an id the one with the smallest hash is used. Null ids, labels and texts are not used. With no labels the model
    rests on the seed lexicon.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y is not null")
    known = known.groupBy("_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.lit("toxicity"), F.col("_id")), F.col("_id")]
    sample = known.where("y > 0").orderBy(*order).limit(max_rows // 2).unionAll(known.where("y <= 0").orderBy(*order).limit(max_rows // 2)).collect()
    totals = {int(r.y > 0): r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen_ids = spark.createDataFrame([(r["_id"], int(r.y > 0)) for r in sample], f"_id {known.schema['_id'].dataType.simpleString()}, y int")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    # one pass over the corpus; at most max_rows ids are broadcast. An id that repeats gives one of its texts, so that there
    # are at most max_rows of them; tasks choose first. They are written for the two steps below
    one = F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")
    texts = cut(texts.join(F.broadcast(chosen_ids), "_id").groupBy("_id", "y").agg(one).select("y", "_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORDS.findall(text.lower()))
                by_class[y].update({f for w in words for f in word_features(w)})
        clean, toxic = by_class
        keys = list(clean.keys() | toxic.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([clean[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["feature", "clean", "toxic"])

    n = [sum(1 for r in sample if (r.y > 0) == c) for c in (False, True)]
    counts = texts.mapInArrow(tidy(count), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    gain = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    rare = max(3, n[1] // 1000)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))  # of gain
    top = counts.where(F.col("toxic") >= rare).withColumn("gain", gain).where(gain - 2 * error > 1).orderBy(F.desc(F.col("gain") * F.sqrt("toxic")), "feature").limit(max_features).collect()
    names = [r.feature for r in top] + sorted(SEED - {r.feature for r in top})
    features = {f: i for i, f in enumerate(names)}
    voting = [r.feature for r in top if r.gain > 2.5][:voters]
    chosen = spark.sparkContext.broadcast((features, voting))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, voting = chosen.value
        for batch in batches:
            out = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORDS.findall(text.lower()))
                present = {f for w in words for f in word_features(w)}
                found = sorted(features[f] for f in present & features.keys())
                out.append((y, found, [*pattern_votes(text, words, len(found)), *(1 if f in present else 0 for f in voting)]))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.int32()))], ["y", "features", "votes"])

    rows = texts.mapInArrow(tidy(describe), "y int, features array<int>, votes array<int>").collect()
    rows.sort(key=lambda r: (r.y, r.features, r.votes))
    y = np.array([r.y for r in rows], float)
    votes = np.array([r.votes for r in rows], float).reshape(len(rows), len(PATTERNS) + len(voting))
    share = (np.array([totals.get(0, 0), totals.get(1, 0)]) + 1) / (np.array(n) + 1)  # rows of a class that each sampled one stands for
    posterior, accuracy, corr = label_model(votes, (n[1] + 1) / (sum(n) + 2))
    if rows:
        weights, bias = fit_linear([r.features for r in rows], posterior, len(names), np.full(len(rows), 1 / len(rows)))
        margin = np.array([weights[r.features].sum() + bias if r.features else bias for r in rows])
        scale, shift = calibrate(margin, y, share[y.astype(int)])
    else:
        weights, bias, scale, shift = np.where([f in SEED for f in names], 4.0, 0.0), -2.0, 1.0, 0.0
    return ToxicityModel(features, weights, bias, scale, shift, list(zip([*PATTERNS, *voting], map(float, accuracy), strict=True)), corr, len(rows))


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """scale > 0 and shift of the logistic curve of y over margin (Platt), by Newton's method."""
    a, b = 1.0, 0.0
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * weight * margin).sum() + 1e-4 * (a - 1), ((p - y) * weight).sum()])
        h = p * (1 - p) * weight
        hess = np.array([[(h * margin**2).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = float(np.clip(a - np.clip(step[0], -1, 1), 0.05, 20)), float(b - np.clip(step[1], -2, 2))
    return a, b


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= threshold) to the columns in keep.

    Every whole text is read; a null text is scored as an empty one. Rows that repeat, and null ids, are scored like
    any other; columns outside keep are ignored, whatever their names. An empty table gives no rows.
    """
    picked = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("_text")]))
    width, at = len(keep), keep.index(text_col) if text_col in keep else len(keep)
    model_bc = docs.sparkSession.sparkContext.broadcast((model.features, model.weights))  # bounded by max_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = model_bc.value
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, value in enumerate(batch.column(at)):
                present: set[int] = set()
                for w in set(WORDS.findall((value.as_py() or "").lower())):
                    found = seen.get(w)
                    if found is None:
                        if len(seen) >= CACHED:
                            seen.clear()
                        found = seen[w] = tuple(features[f] for f in word_features(w) if f in features)
                    if found:
                        present.update(found)
                z = model.scale * (weights[sorted(present)].sum() + model.bias) + model.shift
                scores[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores), pa.array((scores >= threshold).astype("int32"))], [*keep, "score", "predicted"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:width])
    return picked.mapInArrow(tidy(run), f"{fields}score double, predicted int")
