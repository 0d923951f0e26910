"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score). The score is one linear function of hashed text, shared by all grades;
the thresholds are ordered by construction (a first one and positive steps). From them come the
expected grade and the tail probability P(grade >= k) that a selection cuts at.

A text's features are its words (runs of anything but space and U+0009..U+000D, in lower case, marks at both ends
off) hashed to ``BITS`` bits. Of n different words each weighs n ** -1/4, so that one telling word still shows in a long
text. A few further features hold its form (shares of symbols, marks, repeated words, lines). Whole texts are read.

The model is fitted on a bounded sample: the ``sample`` labelled documents with the least hash of doc_id. Their features are made where
the rows are; the fit, a gradient over the sample a pass (Adam), runs in one task on that bounded table. Words in fewer than ``MIN_DOCS``
of them get no weight. All documents are scored, each task with the weights (2**BITS floats) sent once.

Grades of the given labels: 0 toxic, 1 not toxic but of low quality, 2 good. A document is selected where the tail
probability of grade 2 reaches ``FLOOR``.

Defined cases: null or empty texts have no word features and get the score of the bias and form; unlabelled and
null-id documents are scored; null ratings and labels of unknown documents are no examples; a doc_id that
repeats is an example with each of its texts; without any example every score is 0 and the thresholds are the
initial ones; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, rows_of

BITS = 18
#: Documents of the fit (a bound, whatever the corpus), passes over them, step, and pull towards zero.
SAMPLE, PASSES, RATE, DECAY = 8000, 400, 0.05, 1e-4
#: Documents of the sample that a feature must be in.
MIN_DOCS = 5
GRADES, SELECTED, FLOOR = 3, 2, 0.65
FORM = 6
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's features; the last ``FORM`` places are those of form."""
    text = text or ""
    words = _WORD.findall(text)
    counts = Counter(w.strip(_MARKS).lower() for w in words)
    marks = counts.pop("", 0)
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "#*$%&|<>"))
    form = [1.0, min(1.0, symbols / n), marks / n, 1 - len(counts) / n, min(1.0, len(lines) / n), min(1.0, np.log1p(len(words)) / 10)]
    size = 1 << bits
    places = np.fromiter((zlib.crc32(w.encode()) & (size - 1) for w in counts), np.int64, len(counts))
    values = np.full(len(counts), max(1, len(counts)) ** -0.25)
    return np.concatenate([places, size + np.arange(FORM)]), np.concatenate([values, form])


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def score(self, text: str | None) -> float:
        places, values = features(text, self.bits)
        return float(self.weights[places] @ values)

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_arrays(rows: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, bits: int = BITS, passes: int = PASSES, rate: float = RATE, decay: float = DECAY) -> Model:
    """Maximum likelihood by Adam over sparse features (row, place, value)."""
    keep = np.bincount(places, minlength=(1 << bits) + FORM)[places] >= MIN_DOCS  # a text has a word once
    rows, places, values = rows[keep], places[keep], values[keep]
    used, place = np.unique(places, return_inverse=True)
    width, n, cuts = len(used), len(grades), GRADES - 1
    x = np.zeros(width + cuts)  # weights, first threshold, logs of the steps
    if n:
        share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
        first = np.log(share / (1 - share))
        x[width] = first[0]
        x[width + 1 :] = np.log(np.maximum(np.diff(first), 1e-2))
    else:
        x[width + 1 :] = 0.0
    one, two = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, passes + 1 if n else 0):
        steps = np.exp(x[width + 1 :])
        cut = x[width] + np.concatenate([[0], np.cumsum(steps)])
        score = np.bincount(rows, x[place] * values, n)
        low = np.where(grades > 0, _sigmoid(cut[np.maximum(grades - 1, 0)] - score), 0.0)
        high = np.where(grades < cuts, _sigmoid(cut[np.minimum(grades, cuts - 1)] - score), 1.0)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        slope = (dh - dl) / n  # of minus the log likelihood, by the score
        grad = np.empty_like(x)
        grad[:width] = np.bincount(place, slope[rows] * values, width) + decay * x[:width]
        by_cut = np.array([(np.where(grades == k + 1, dl, 0) - np.where(grades == k, dh, 0)).sum() / n for k in range(cuts)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad[width] = tail[0]
        grad[width + 1 :] = tail[1:] * steps
        one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad * grad
        x -= rate * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros((1 << bits) + FORM, np.float32)
    weights[used] = x[:width]
    return Model(weights, x[width] + np.concatenate([[0], np.cumsum(np.exp(x[width + 1 :]))]), bits)


def grade_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the labels quality and toxic."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("grade is not null and doc_id is not null")


def bounded_sample(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, grade) of at most ``sample`` labelled rows, those with the least hash of doc_id."""
    some = grades.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    # At most `sample` rows of two numbers, so sending them to every task has a proven bound and spares shuffling the texts.
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "grade", F.xxhash64("text")).limit(sample)


def fit(examples: DataFrame, bits: int = BITS, passes: int = PASSES) -> Model:
    """Fit on ``examples`` (doc_id, text, grade), a bounded table: features are made where the rows are, the fit runs in one task."""
    schema = pa.schema([("grade", pa.int32()), ("places", pa.binary()), ("values", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((g, *features(t, bits)) for t, g in rows_of(batches, "text", "grade"))
        return batched(((g, p.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()) for g, p, v in made), schema)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        places = [np.frombuffer(p, np.int32) for p in pdf["places"]]
        rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
        values = np.concatenate([np.frombuffer(v, np.float32) for v in pdf["values"]]).astype(np.float64)
        model = fit_arrays(rows, np.concatenate(places).astype(np.int64), values, pdf["grade"].to_numpy(np.int64), bits, passes)
        return pd.DataFrame({"weights": [zlib.compress(model.weights.tobytes())], "thresholds": [model.thresholds.tobytes()]})

    featured = examples.mapInArrow(make, "grade int, places binary, values binary").withColumn("sample", F.lit(True))
    found = featured.groupBy("sample").applyInPandas(train, "weights binary, thresholds binary").first()
    if found is None:
        empty = np.empty(0, np.int64)
        return fit_arrays(empty, empty, empty.astype(float), empty, bits)
    return Model(np.frombuffer(zlib.decompress(bytes(found.weights)), np.float32), np.frombuffer(bytes(found.thresholds), np.float64), bits)


SCORES = "doc_id long, score double, expected_grade double, p_clean double, p_good double, selected boolean"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("expected_grade", pa.float64()), ("p_clean", pa.float64()), ("p_good", pa.float64()), ("selected", pa.bool_())])


def score(docs: DataFrame, model: Model, at_least: int = SELECTED, floor: float = FLOOR) -> DataFrame:
    """Expected grade and tail probabilities of each row; selected where P(grade >= ``at_least``) reaches ``floor``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                s = model.score(text)
                tails = model.tails(s)
                yield doc_id, s, float(tails.sum()), float(tails[0]), float(tails[-1]), bool(tails[at_least - 1] >= floor)

        return batched(rows(), _SCORES_ARROW, 8192)

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)
