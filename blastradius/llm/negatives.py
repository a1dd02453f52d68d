"""Hard negatives of anchors by the threshold algorithm over sorted lists.

Rows become integer vectors; a score is an inner product.  Candidates are dealt to
blocks of bounded size.  A block keeps, for each dimension, a list of its rows sorted
by that component.  For an anchor, each list is read from its large end where the
anchor's component is positive and from its small end where it is negative: what is
met is scored in full by random access.  No row that has not been met can score
above the threshold, the sum of the components at which the lists stand times the
anchor's.  Reading stops once the threshold lies strictly below the k-th score of
every window asked for, so ties are always met, or below the window itself.

Two passes share this: first the nearest rows of the anchor's own label, where the
blocks hold one label each, then, for each of these positives, the best rows of
other labels inside the window that the positive's score sets.  Blocks give their own
best rows only, a bounded number an anchor, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blastradius.llm.common import partitions, ship, workspace

SCALE, EVERY, POSITIVES, NEGATIVES, WINDOW = 256, 50, 5, 3, (50, 95)
#: Rows of a task's lists, and rows of one set of lists in it: the task holds the first, the processor's cache the second.
BLOCK, LISTS = 131_072, 8_192
#: Least rows of a block while there are fewer blocks than would keep the cluster busy.
SMALL_BLOCK = 4_096
#: Sums below these are exact in the arithmetic of float32 and float64; larger ones are taken in whole numbers.
_EXACT_32, _EXACT_64 = float(1 << 24), float(1 << 53)
_LONG = 1 << 63


def _long(x: int) -> int:
    return min(max(x, -_LONG), _LONG - 1)


class Asked:
    """The best ``k`` rows with a score from ``low`` to ``high``, as far as they have been met."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.best: list[tuple[int, int]] = []  # (score, id), best first

    def done(self, threshold: float | int) -> bool:
        if self.low is not None and threshold < self.low or self.high is not None and self.low is not None and self.low > self.high:
            return True
        return len(self.best) == self.k and self.best[-1][0] > threshold

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = np.ones(len(scores), bool)
        if self.high is not None:
            fit = scores <= self.high
        floor = self.best[-1][0] if len(self.best) == self.k else self.low
        if floor is not None:
            fit = fit & (scores >= floor)
        at = np.flatnonzero(fit)
        if not len(at):
            return
        if len(at) > self.k and scores.dtype != object:  # all ties of the k-th stay
            found = scores[at]
            at = at[found >= np.partition(found, len(at) - self.k)[len(at) - self.k]]
        if len(at) > self.k:  # of the ties the smallest ids
            at = at[sorted(range(len(at)), key=lambda i: (-scores[at[i]], ids[at[i]]))[: self.k]]
        both = self.best + [(int(scores[i]), int(ids[i])) for i in at]
        self.best = sorted(both, key=lambda x: (-x[0], x[1]))[: self.k]


class SortedLists:
    """Rows of one block, sorted along each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.most = np.abs(x).max(0) if len(x) else np.zeros(x.shape[1])
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(x.T, self.order, 1))
        with np.errstate(over="ignore"):  # not read where it would not be exact
            self.single = x.astype(np.float32)
        self.seen = np.zeros(len(x), bool)
        self._whole: np.ndarray | None = None

    def whole(self) -> np.ndarray:
        if self._whole is None:
            self._whole = np.array([[int(v) for v in row] for row in self.x], object).reshape(self.x.shape)
        return self._whole

    def search(self, a: np.ndarray, own_id: int, own_label: int, same: bool, asked: Sequence[Asked]) -> None:
        """Reads the lists until every window of ``asked`` is settled."""
        n = len(self.ids)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        bound = float(np.abs(a) @ self.most)
        rows, anchor = (self.single, a.astype(np.float32)) if bound < _EXACT_32 else (self.x, a)
        if not bound < _EXACT_64:
            rows, anchor = self.whole(), np.array([int(v) for v in a], object)

        def threshold(depth: int) -> float | int:
            at_up, at_down = self.sorted[up, n - 1 - depth], self.sorted[down, depth]
            if anchor.dtype == object:
                heads = zip([*at_up, *at_down], [*anchor[up], *anchor[down]], strict=True)
                return _long(sum(int(v) * w for v, w in heads))
            return float(at_up @ a[up] + at_down @ a[down])

        self.seen[:] = False
        depth, step = 0, max(1, n // 8)
        # Before the first access no row is above the sum of the lists' heads.
        if all(w.done(threshold(0)) for w in asked):
            return
        while depth < n:
            deeper = min(n, depth + step)
            before = self.seen.copy()
            self.seen[self.order[up, n - deeper : n - depth]] = True
            self.seen[self.order[down, depth:deeper]] = True
            if not len(up) and not len(down):
                self.seen[:] = True
                deeper = n
            met = np.flatnonzero(self.seen & ~before)
            met = met[(self.labels[met] == own_label) & (self.ids[met] != own_id) if same else self.labels[met] != own_label]
            scores = rows[met] @ anchor
            if anchor.dtype == object:
                scores = np.array([_long(int(v)) for v in scores], object)
            for w in asked:
                w.take(scores, self.ids[met])
            depth, step = deeper, deeper
            if depth == n or all(w.done(threshold(depth - 1)) for w in asked):
                return


def matrix(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component; a shorter vector counts as if it went on with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.floor(scale * flat)
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _window(score: int, share: tuple[int, int]) -> tuple[int, int]:
    return -(-share[0] * score // 100), share[1] * score // 100


def _searched(rows: DataFrame, same: bool, k: int, scale: int, share: tuple[int, int]) -> DataFrame:
    """Best rows of each block for each anchor.

    rows: (task, anchor, id, label, v, positives); a task's candidates come before
    its anchors, which stream through.  Without positives one window takes all scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lists = None, [], []
        for batch in batches:
            task, anchor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ids, labels = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = np.flatnonzero((task[1:] != task[:-1]) | (anchor[1:] != anchor[:-1])) + 1
            out: list[list] = [[], [], [], [], []]
            for begin, end in zip([0, *cuts], [*cuts, len(task)], strict=True):
                if begin == end:
                    continue
                if task[begin] != now:
                    now, held, lists = task[begin], [], []
                x = matrix(batch.column(4).slice(begin, end - begin), scale)
                if not anchor[begin]:
                    held.append((ids[begin:end], labels[begin:end], x))
                    continue
                if held:
                    width = max(part.shape[1] for *_, part in held)
                    own, kinds, all_x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([_widened(h[2], width) for h in held])
                    lists = [SortedLists(own[i : i + LISTS], kinds[i : i + LISTS], all_x[i : i + LISTS]) for i in range(0, len(own), LISTS)]
                    held = []
                width = lists[0].x.shape[1] if lists else 0
                asked_for = batch.column(5).slice(begin, end - begin).to_pylist()
                for i in range(end - begin):
                    a = _widened(x[i : i + 1, :width], width)[0]
                    positives = [(p["id"], p["score"]) for p in asked_for[i] or []]
                    asked = [Asked(k, *_window(score, share)) for _, score in positives] if not same else [Asked(k)]
                    for block in lists:
                        block.search(a, int(ids[begin + i]), int(labels[begin + i]), same, asked)
                    for w, (positive, score) in zip(asked, positives if not same else [(None, None)], strict=True):
                        for found, other in w.best:
                            for column, value in zip(out, (int(ids[begin + i]), positive, score, other, found), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor_id", "positive_id", "positive_score", "id", "score"])

    dealt = rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task", "anchor", "id")
    return dealt.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, id long, score long")


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark keeps ``k`` a group before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    *, scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides.  Higher scores come first, of
    equal ones the smaller id.  A negative n of a positive p has
    window[0] * p <= 100 * n <= window[1] * p, so a positive below zero has none.

    Rows with a null id, label or vector, or with a null, NaN or infinite component
    take no part.  Of rows with one id, the one with the smallest (label, vector)
    does.  A shorter vector counts as if it went on with zeros; an empty one scores
    0 with all.  Scores are exact; one beyond a long counts as the nearest long.
    An empty table, and one without anchors, gives no rows.  Other columns are not read.
    """
    spark = embeddings.sparkSession
    ship(spark)
    ws = workspace(spark)
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    valid = embeddings.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    one = valid.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.struct(F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))).alias("r"))
    rows, n = ws.save_counted(one.select("id", "r.label", "r.v"), "vectors")
    block = min(BLOCK, max(SMALL_BLOCK, n // (2 * partitions(spark))))
    no_positives = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives")
    is_anchor = F.col("id") % every == 0

    # Own label: (label, block) is a task; an anchor goes to the blocks of its label.
    labels = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    labelled = rows.join(labels, "label")
    task = lambda k: F.xxhash64("label", k).alias("task")
    candidates = labelled.select(task(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), F.lit(False).alias("anchor"), "id", "label", "v", no_positives)
    anchors = labelled.filter(is_anchor).select("id", "label", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    anchors = anchors.select(task(F.col("k")), F.lit(True).alias("anchor"), "id", "label", "v", no_positives)
    near = _first(_searched(candidates.unionByName(anchors), True, positives, scale, window), positives, "anchor_id")
    near = ws.save(near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("positives")), "positives")

    # Other labels: blocks hold all labels, and every anchor goes to every block.
    blocks = max(1, -(-n // block))
    candidates = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("task"), F.lit(False).alias("anchor"), "id", "label", "v", no_positives)
    anchors = rows.filter(is_anchor).join(near, "id").select("id", "label", "v", "positives", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("task"))
    anchors = anchors.select("task", F.lit(True).alias("anchor"), "id", "label", "v", "positives")
    found = _first(_searched(candidates.unionByName(anchors), False, negatives, scale, window), negatives, "anchor_id", "positive_id")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
