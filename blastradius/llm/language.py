"""Language identification in two steps: the family, then pairs of languages inside it.

A text is the mean of its hashed byte n-grams.  Linear support vector machines, one
a family against the rest, choose the family; inside it one machine a pair of its
languages votes.  They are trained on a bounded sample of labelled rows and applied
to every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blastradius.llm.common import ship
from blastradius.llm.features import FOLDED, SIZE, scores, slices, vector

#: Labelled rows the driver trains on at most.
TRAIN_ROWS = 4000
#: Families of languages by code; a language of no family here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne gu pa",
    "semitic": "ar he mt",
    "baltic": "lt lv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
EPOCHS, PENALTY = 6, 1e-5


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def machine(rows: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray) -> np.ndarray:
    """Weights of a linear support vector machine: averaged stochastic steps on the hinge loss. side: 1 or -1."""
    share = max(1, int((side > 0).sum())), max(1, int((side < 0).sum()))
    cost = {1: len(side) / (2 * share[0]), -1: len(side) / (2 * share[1])}
    w, total, rng, t = np.zeros(SIZE), np.zeros(SIZE), np.random.default_rng(7), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            t += 1
            slots, values = rows[i]
            y = int(side[i])
            if y * (w[slots] @ values) < 1:
                step = 20.0 / (1 + t / len(rows)) * cost[y] * y * values
                w[slots] += step
                total[slots] += step * t
    return (w - total / (t + 1)) * (1 - PENALTY)


class Model:
    """Machines by family and by pair of languages of a family."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(x) for x in self.langs})
        self.of = {f: [x for x in self.langs if family_of(x) == f] for f in self.families}
        rows = [vector(t, FOLDED) for t in texts]
        fam = np.array([family_of(x) for x in langs])
        one = np.array(langs)
        self.weights: list[np.ndarray] = []
        for f in self.families if len(self.families) > 1 else []:
            self.weights.append(machine(rows, np.where(fam == f, 1, -1)))
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.of[f], 2):
                own = [i for i in range(len(rows)) if one[i] in (a, b)]
                self.pairs[a, b] = len(self.weights)
                self.weights.append(machine([rows[i] for i in own], np.where(one[own] == a, 1, -1)))

    def predict(self, margins: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1) of rows of machine outputs."""
        squash = lambda x: 1 / (1 + np.exp(-np.clip(3 * x, -30, 30)))
        langs, sure = [], []
        for row in margins:
            many = len(self.families) > 1
            f = self.families[int(np.argmax(row[: len(self.families)]))] if many else self.families[0]
            score = float(squash(row[self.families.index(f)])) if many else 1.0
            votes = dict.fromkeys(self.of[f], 0.0)
            for (a, b), j in self.pairs.items():
                if a in votes:
                    p = float(squash(row[j]))
                    votes[a] += p
                    votes[b] += 1 - p
            best = max(votes, key=lambda x: (votes[x], x))
            langs.append(best)
            sure.append(score * (votes[best] / (len(votes) - 1) if len(votes) > 1 else 1.0))
        return langs, sure


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """A model of a random sample of at most ``rows`` rows with text and language; None if there is none."""
    known = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    n = known.count()
    part = known if n <= rows else known.sample(min(1.0, 1.1 * rows / n), seed=7).limit(rows)
    found = part.collect()
    return Model([r.text for r in found], [r.lang for r in found]) if found else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. ``und`` with 0 where the text is null or has no letter, or nothing was learned."""
    ship(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of machines of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = send.value
        for batch in batches:
            langs: list[str] = []
            sure: list[float] = []
            texts, lettered = batch.column(1), batch.column(2).to_pylist()
            for _, held in slices(texts):
                if model is None:
                    a, b = ["und"] * len(held), [0.0] * len(held)
                else:
                    a, b = model.predict(scores(held, model.weights, FOLDED) if model.weights else np.zeros((len(held), 0)))
                langs += a
                sure += b
            langs = [x if ok else "und" for x, ok in zip(langs, lettered, strict=True)]
            sure = [x if ok else 0.0 for x, ok in zip(sure, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], ["_row", "lang_pred", "score"])

    kept = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(1).alias("_one"))
    sent = docs.select(row.alias("_row"), F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_lettered"))
    out = sent.mapInArrow(run, f"_row {sent.schema['_row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "lang_pred", "score")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from rows that are not held out.

    Held out are rows whose crc32 of the id as text leaves 1 by 3.  Rows with a
    null id are neither held out nor learned from.  Repeated rows are alike.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.filter(F.col(id_col).isNotNull() & ~held_out), text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model)
