"""Operator 10: graded toxicity by cumulative-link ordinal regression.

Grades run from 0 (clean) to 3. One weight vector over sparse text features (words and their first
four to six letters, counted) is shared by three ordered thresholds: P(grade <= j) =
1 / (1 + exp(score - threshold_j)). The expected severity is the sum of P(grade > j).

The labels say toxic or clean only. Toxic rows of the sample are graded by the terciles of how many
words with a toxic feature they hold. A row counts as toxic from the severity that parts the two kinds of the sample best. The model is fitted on a bounded sample of the
labelled rows (``most_toxic`` and ``most_clean`` of them, those of smallest hash); every row is
scored. Features are screened by their log-odds in the sample; the weights are fitted by
proximal gradient with an L1 penalty.

Null and empty texts have no features and score as clean. Labels without a document, and rows with
a null label or id are not used; a document with several labels counts as toxic if one says so.
Without labels of both kinds nothing is rejected. Repeated rows are scored each. A column of the documents
with the name of an added one gives way to it in ``score``; ``clean`` adds none and keeps all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import give_back, ship, sized_chunks, strings, tidy

GRADES = 3
MOST_TOXIC, MOST_CLEAN = 1500, 3000
MOST_FEATURES = 2000
ADDED = ("severity", "grade", "toxic")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its first four to six letters."""
    named = ["=" + word] + ["^" + word[:n] for n in (4, 5, 6) if len(word) >= n]
    return [xxhash.xxh3_64_intdigest(f) for f in named]


@dataclass
class SeverityModel:
    weights: dict[int, float]
    thresholds: np.ndarray
    reject: float  # expected severity from which a text counts as toxic

    def token_score(self, token: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for word in WORD.findall(token.lower()) for f in features(word))

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for every score and j from 0."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -500, 500)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, penalty: float = 1e-3, steps: int = 400):
    """Weights and thresholds of the cumulative-link model for sparse rows, by accelerated proximal gradient."""
    n = len(grades)
    passed = grades[:, None] > np.arange(GRADES)
    share = np.clip(passed.mean(axis=0), 1e-3, 1 - 1e-3)
    weights, thresholds = np.zeros(width), -np.log(share / (1 - share))
    balance = np.where(grades > 0, 0.5 / max((grades > 0).sum(), 1), 0.5 / max((grades == 0).sum(), 1))[:, None]
    norms = np.bincount(rows, values * values, minlength=n)
    step = 4.0 / (GRADES * (np.sum(balance[:, 0] * norms) + 1))
    ahead, old, t = weights.copy(), weights.copy(), 1.0
    for _ in range(steps):
        score = np.bincount(rows, values * ahead[cols], minlength=n)
        above = 1 / (1 + np.exp(np.clip(thresholds - score[:, None], -500, 500)))
        pull = (above - passed) * balance
        slope = np.bincount(cols, values * pull.sum(axis=1)[rows], minlength=width)
        weights = ahead - step * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * penalty, 0)
        thresholds = np.sort(thresholds + 4.0 / GRADES * pull.sum(axis=0))
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, old, t = weights + (t - 1) / faster * (weights - old), weights, faster
    return weights, thresholds


def train(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
    most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_features: int = MOST_FEATURES,
) -> SeverityModel:
    """Fit the model on at most ``most_toxic`` + ``most_clean`` labelled documents of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):  # a few documents at a time: features take more room than texts
                part = batch.slice(start, 100)
                hashes, counts = [], []
                for text in strings(part, "text"):
                    found: Counter[int] = Counter()
                    for word, n in Counter(WORD.findall(text.lower())).items():
                        for f in features(word):
                            found[f - 2**63] += n
                    hashes.append(np.fromiter(found, np.int64, len(found)))
                    counts.append(np.fromiter(found.values(), np.int32, len(found)))
                arrays = [part.column("_toxic"), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["toxic", "features", "counts"])

    ship(docs.sparkSession)
    marks = (
        labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_toxic")).dropna()
        .groupBy("_id").agg((F.max("_toxic") > 0).cast("int").alias("_toxic"))
    )
    sample = [marks.where(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in ((1, most_toxic), (0, most_clean))]
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text"))
    chosen = texts.join(F.broadcast(sample[0].unionByName(sample[1])), "_id").select("_toxic", "text")
    try:
        return _fitted(chosen.mapInArrow(tidy(run), "toxic int, features array<bigint>, counts array<int>").toArrow(), most_features)
    finally:
        give_back()


def _fitted(got: pa.Table, most_features: int) -> SeverityModel:
    """The model of a sample with its features."""
    toxic = got.column("toxic").to_numpy()
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return SeverityModel({}, np.full(GRADES, np.inf), np.inf)
    # features of enough toxic rows, then how many clean rows have them
    in_toxic = got.filter(pc.equal(got.column("toxic"), 1)).column("features").combine_chunks().flatten().to_numpy()
    known, with_toxic = np.unique(in_toxic, return_counts=True)
    often = with_toxic >= max(5, 0.008 * n1)
    known, with_toxic = known[often], with_toxic[often]
    if not len(known):
        return SeverityModel({}, np.full(GRADES, np.inf), np.inf)
    rows, cols, values = [], [], []
    for i, (own, n) in enumerate(zip(got.column("features"), got.column("counts"), strict=True)):
        own = own.values.to_numpy()
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        used = known[at] == own
        rows.append(np.full(used.sum(), i))
        cols.append(at[used])
        values.append(n.values.to_numpy()[used].astype(float))
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    with_clean = np.bincount(cols, 1 - toxic[rows], minlength=len(known))
    odds = np.log((with_toxic + 0.5) / (n1 + 1)) - np.log((with_clean + 0.5) / (n0 + 1))
    strong = np.flatnonzero(odds > 3)
    strong = strong[np.lexsort((known[strong], -(odds * with_toxic)[strong]))][:most_features]
    place = np.full(len(known), -1)
    place[strong] = np.arange(len(strong))
    used = place[cols] >= 0
    rows, cols, values = rows[used], place[cols[used]], values[used]
    hits = np.bincount(rows, values, minlength=len(toxic))
    cuts = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (hits > cuts[0]) + (hits > cuts[1]), 0)
    weights, thresholds = fit(rows, cols, values, grades, len(strong))
    kept = weights != 0
    table = dict(zip(((known[strong][kept]).astype(object) + 2**63).tolist(), weights[kept].tolist(), strict=True))
    model = SeverityModel(table, thresholds, np.inf)
    severity = model.above(np.bincount(rows, values * weights[cols], minlength=len(toxic))).sum(axis=1)
    model.reject = border(severity, toxic)
    return model


def border(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The severity that parts toxic from clean rows with the least sum of both error rates; the middle of the gap there."""
    order = np.argsort(severity, kind="stable")
    values, marks = severity[order], toxic[order]
    missed = np.cumsum(marks) / max(marks.sum(), 1)
    alarms = 1 - np.cumsum(1 - marks) / max((1 - marks).sum(), 1)
    error = np.where(np.r_[values[1:] > values[:-1], True], missed + alarms, np.inf)
    at = len(error) - 1 - int(np.argmin(error[::-1]))
    return float((values[at] + values[at + 1]) / 2) if at + 1 < len(values) else np.inf


def score(docs: DataFrame, model: SeverityModel, text_col="text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (thresholds passed with even odds) and ``toxic`` (severity at the model's border)."""
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ADDED]
    return _scored(docs, model, text_col).select(*own, *ADDED)


def clean(docs: DataFrame, model: SeverityModel, text_col="text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return _scored(docs, model, text_col).where("NOT toxic").select(*own)


def _scored(docs: DataFrame, model: SeverityModel, text_col: str, most_tokens: int = 200_000) -> DataFrame:
    """The columns of ``docs`` by their place, ``_0`` and so on, and the added ones."""
    ship(docs.sparkSession)
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known: dict[str, float] = {}
        for batch in batches:
            scores = []
            texts = strings(batch, text)
            for a, b in sized_chunks(texts, 3_000_000):
                tokens = pc.utf8_split_whitespace(pa.array(texts[a:b], pa.string()))
                coded = tokens.flatten().dictionary_encode()
                if len(known) > most_tokens:
                    known.clear()
                unique = coded.dictionary.to_pylist()
                for token in unique:
                    if token not in known:
                        known[token] = model.token_score(token)
                own = np.fromiter(map(known.__getitem__, unique), float, len(unique))[coded.indices.to_numpy()]
                ends = np.concatenate(([0], np.cumsum(pc.list_value_length(tokens).to_numpy())))
                sums = np.concatenate(([0.0], np.cumsum(own)))
                scores.append(sums[ends[1:]] - sums[ends[:-1]])
            above = model.above(np.concatenate(scores) if scores else np.empty(0))
            grade = (above >= 0.5).sum(axis=1)
            arrays = list(batch.columns) + [pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above.sum(axis=1) >= model.reject)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *ADDED])

    renamed = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)])
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(docs.columns, names, strict=True))
    return renamed.mapInArrow(tidy(run), f"{kinds}, severity double, grade int, toxic boolean")
