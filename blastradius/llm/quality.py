"""A quality classifier that learns from heuristics instead of labels.

Heuristic labellers vote good, bad or nothing on every document.  How often each
pattern of votes occurs, a small table whatever the corpus, is all that expectation
maximisation needs to estimate each labeller's accuracy.  The posterior of a pattern
labels a bounded sample of documents, and a linear model over hashed n-grams and the
measures that the labellers look at is trained on it and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blastradius.llm.common import ship
from blastradius.llm.features import PLAIN, SIZE, scores, slices, vector

#: Documents the scorer is trained on at most.
TRAIN_ROWS = 4000
#: A document with at least this score stays.
KEEP = 0.5
ITERATIONS, EPOCHS = 50, 6
#: Words that running text of the languages at hand is held together by.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for as with was on be by he at from or an are this have not you which "
    "der die das und ist in den von zu mit sich auf für nicht ein eine als auch im dem des er sie es an bei "
    "le la les de des et en un une du est que qui dans pour par sur au pas plus ce il ne se avec sont "
    "el los las y un una por con para no del al lo como más pero sus su o si".split()
)
MEASURES = ("symbols", "bars", "upper", "variety", "repeats", "function", "ends", "shouts", "length")


def measures(raw: bytes, text: str) -> tuple[int, list[float]]:
    """(words, one share a measure) of a text."""
    words = text.split()
    n = max(1, len(words))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[128:].sum()))
    plain = int(count[9:14].sum() + count[32:35].sum() + count[39:42].sum() + count[44:60].sum() + count[63])
    symbols = len(raw) - letters - plain
    lower = text.lower().split()
    repeats = sum(map(str.__eq__, lower[1:], lower))
    known = sum(map(FUNCTION_WORDS.__contains__, lower))
    stops = int(count[44] + count[46] + count[63])
    return len(words), [
        symbols / max(1, len(raw)), count[124] / n, int(count[65:91].sum()) / letters, len(set(lower)) / n ** 0.8,
        repeats / n, known / n, stops / n, count[33] / n, len(text) / n,
    ]


#: (measure, bad at least, good at most) or the other way round: the labellers. What lies between has no vote.
LABELLERS = (
    ("symbols", 0.04, 0.01, 1), ("bars", 0.2, 0.01, 1), ("upper", 0.4, 0.15, 1), ("variety", 0.3, 0.7, -1),
    ("repeats", 0.2, 0.05, 1), ("function", 0.05, 0.12, -1), ("ends", 0.02, 0.05, -1), ("shouts", 0.2, 0.02, 1), ("length", 12.0, 9.0, 1),
)
#: Words below which only the symbols, bars, upper case and shouts are judged.
FEW_WORDS = 20
_ALWAYS = ("symbols", "bars", "upper", "shouts")


def votes(words: int, found: list[float]) -> list[int]:
    """1 good, -1 bad, 0 nothing, of each labeller. A text without words is bad to all."""
    if not words:
        return [-1] * len(LABELLERS)
    out = []
    for (name, bad, good, way), value in zip(LABELLERS, found, strict=True):
        judged = words >= FEW_WORDS or name in _ALWAYS
        out.append(0 if not judged else -1 if way * value >= way * bad else 1 if way * value <= way * good else 0)
    return out


def accuracies(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, P(vote | class) by labeller, share of good): expectation maximisation.

    A labeller that doesn't vote tells nothing.  A document starts as bad if
    any labeller says so, for each of them sees another fault; a few made-up counts keep the classes apart.
    """
    share = np.where((patterns == -1).any(1), 0.1, 0.95)
    total, table, good = counts.sum(), np.zeros((patterns.shape[1], 2, 3)), 0.8
    prior = 0.001 * total * np.array([[0.7, 0.0, 0.3], [0.05, 0.0, 0.95]])
    voting = patterns != 0
    for _ in range(ITERATIONS):
        for j in range(patterns.shape[1]):
            for v in (-1, 1):
                hit = counts * (patterns[:, j] == v)
                table[j, 0, v + 1], table[j, 1, v + 1] = (hit * (1 - share)).sum(), (hit * share).sum()
        table += prior
        table /= table.sum(2, keepdims=True)
        good = np.clip((counts * share).sum() / total, 0.05, 0.95)
        log = np.full(len(counts), np.log(good / (1 - good)))
        for j in range(patterns.shape[1]):
            k = patterns[:, j] + 1
            log += np.where(voting[:, j], np.log(np.maximum(table[j, 1, k], 1e-9) / np.maximum(table[j, 0, k], 1e-9)), 0.0)
        share = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return share, table, float(good)


def voted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text and its pattern of votes, one character a labeller."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                t = text.as_py() or ""
                found.append("".join("-0+"[v + 1] for v in votes(*measures(t.encode(), t))))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["pattern"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "pattern string")


class Model:
    """A linear scorer over hashed n-grams, the measures in steps, and the votes' own words."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        self.grams, self.steps, self.bias = np.zeros(SIZE), np.zeros((len(LABELLERS), 4)), 0.0
        rows = [vector(t, PLAIN) for t in texts]
        seen = [self.stepped(t.encode(), t) for t in texts]
        t, rng, columns = 0, np.random.default_rng(7), np.arange(len(LABELLERS))
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                t += 1
                slots, values = rows[i]
                z = self.grams[slots] @ values + self.steps[columns, seen[i]].sum() + self.bias
                slope = labels[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                rate = 1 / (1 + t / len(rows))
                self.grams[slots] += 20 * rate * slope * values
                self.steps[columns, seen[i]] += 0.1 * rate * slope
                self.bias += 0.1 * rate * slope

    @staticmethod
    def stepped(raw: bytes, text: str) -> np.ndarray:
        """A step a measure: by its vote, or 3 where there are no words."""
        words, found = measures(raw, text)
        return np.array(votes(words, found)) + 1 if words else np.full(len(LABELLERS), 3)

    def score(self, held: list[bytes]) -> np.ndarray:
        columns = np.arange(len(LABELLERS))
        z = scores(held, [self.grams], PLAIN)[:, 0] + self.bias
        z += [self.steps[columns, self.stepped(x, x.decode())].sum() for x in held]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> Model | None:
    """Votes of all documents, accuracies, posterior labels of a sample, scorer. None for an empty table."""
    table = voted(docs, text_col).groupBy("pattern").count().collect()  # at most 3 ^ 9 rows
    if not table:
        return None
    patterns = np.array([["-0+".index(c) - 1 for c in r.pattern] for r in table])
    counts = np.array([r["count"] for r in table], float)
    share, _, _ = accuracies(patterns, counts)
    by = dict(zip([r.pattern for r in table], share, strict=True))
    n = int(counts.sum())
    part = docs.select(F.col(text_col).alias("_text"))
    texts = [r[0] or "" for r in (part if n <= rows else part.sample(min(1.0, 1.1 * rows / n), seed=7).limit(rows)).collect()]
    labels = np.array([by.get("".join("-0+"[v + 1] for v in votes(*measures(t.encode(), t))), 0.5) for t in texts])
    return Model(texts, labels)


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` and the score, 0 to 1. Null text is empty; empty text scores 0."""
    ship(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[float] = []
            for _, held in slices(batch.column(1)):
                values = send.value.score(held) if send.value else np.zeros(len(held))
                out += [float(v) if x.strip() else 0.0 for v, x in zip(values, held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["_row", "_score"])

    sent = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    out = sent.mapInArrow(run, T.StructType([sent.schema["_row"], T.StructField("_score", T.DoubleType())]))
    return out.select("_row.*", F.col("_score").alias(score_col))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """Per row: doc_id, quality_score, kept. Repeated rows are alike; a null id is carried."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, fit(docs, text_col)).select("doc_id", "quality_score", (F.col("quality_score") >= keep).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    name = "_quality_score"
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    return scored(rows, fit(docs, text_col), "_text", name).filter(F.col(name) >= keep).select("_row.*")
