"""Exact Jaccard join of documents over word shingles, as a join in a metric space.

Two sets link when their Jaccard similarity is at least a share t, so their symmetric
difference, a metric, has at most (n + m) (1 - t) / (1 + t) members: (n + m) / 19 of 9/10.  Documents are far from all
others but their own few near copies, so the distance to a document tells nothing
about most of the others, and regions round sampled documents would hold everything.
The first regions are therefore taken in a small part of the space: the shingles are
dealt by hash to more classes than the allowed difference, distances in the classes
add up to the distance, and so two linked sets are at distance 0 in some class.  They
are so in more than one: with f classes filled and a difference of at most d, in f - d.
So a set needs to be met only in the d + 1 classes where it has the fewest neighbours:
of the classes that two linked sets share, the least crowded one is among these for
both.  A passage that many documents hold makes a few crowded classes, which go, and
sets that share no more than these never meet.  Sets of up to 1 / t times the size meet
as each size class is also dealt with its neighbour's classes.

Documents that meet make regions.  All members of a region are near one another, so
inside it the triangle inequality does work:

* a small region is joined recursively in one task: pivots make Voronoi cells, a
  member is also copied to each cell whose pivot is at most twice the threshold
  farther than its own, cells of one component are dropped, and what doesn't get
  smaller is compared within the inequality's window;
* a large region is first compared with a few pivots, chunk by chunk.  What links to
  them makes components; then blocks of the documents outside the largest component
  meet one another and the blocks of that component, each meeting a task.

Equal sets are one point from the start, and only links between components are made,
so a group of thousands of near copies never becomes all its pairs.  No link is lost:
each pair of sets of a region is in one component, or compared, or ruled out by the
inequality.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blastradius.llm.common import Tables, partitions, ship
from blastradius.llm.components import components

#: Words of a shingle and least similarity unless the caller names others: sets link when
#: share[1] * intersection >= share[0] * union.
WORDS, SHARE = 3, (90, 100)
#: Weight (shingles and ``DOCUMENT`` for each set) of a region that one task joins, and of a block of a larger one;
#: a region of very many blocks has fewer and larger ones, enough for all tasks of the cluster.
BLOCK, DOCUMENT = 25_000, 100
PIVOTS = 8
_MEMORY = 200_000
_SMALL, _CELLS = 24, 4
DEALS = 3
#: More than the deals of a set, over both size classes.
SPARE = 8
#: Sets drawn to find classes that are shared by very many, and the share of them that makes one so.
DRAWN, HOT = 20_000, 100


class _Hashes(dict):
    """word -> hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def _factor(place: int) -> np.uint64:
    """An odd number of its own for each place of a shingle."""
    return np.uint64(0x9E3779B97F4A7C15 * (2 * place + 1) % (1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D) ^ (x >> np.uint64(33))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z in lower case; words are apart by ASCII white space."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array([_hashes[w] for w in found], np.uint64)
    if len(h) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))], np.uint64)
    n = len(h) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total = _mixed(total + h[i : i + n] * _factor(i))
    return np.unique(total)


def size_class(n: int, share: tuple[int, int] = SHARE) -> tuple[int, int, int, int]:
    """(number of n's class, most difference when it meets its own and the next class, the class before, that with it)."""
    edges = _size_edges.setdefault(share, [1])
    while len(edges) < 3 or edges[-3] <= n:
        edges.append(edges[-1] * share[1] // share[0] + 1)
    j = int(np.searchsorted(edges, n, "right")) - 1
    slack, whole = share[1] - share[0], share[1] + share[0]
    most = lambda k: 2 * (edges[k + 2] - 1) * slack // whole
    return j, most(j), j - 1, most(j - 1) if j else -1


_size_edges: dict[tuple[int, int], list[int]] = {}


@cache
def _parts(most: int, least: int) -> int:
    """Parts to deal a set of ``least`` members to, so that more than ``most`` of them are hardly ever not filled."""
    for k in range(most + 1, 2 * most + 1):
        empty, both = (1 - 1 / k) ** least, max(0.0, 1 - 2 / k) ** least
        spread = max(0.0, k * empty + k * (k - 1) * both - (k * empty) ** 2) ** 0.5
        if k * (1 - empty) - 2.5 * spread > most:
            return k
    return max(1, 2 * most)


def part_keys(s: np.ndarray, share: tuple[int, int] = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each part of a set, for its own size class and the one before; ``SPARE`` times the parts that the set can spare, and the number of its deal).

    A set can spare all but as many of a deal's parts as the allowed difference and one more.

    Parts that are empty are alike in all sets and don't count.  A set that fills more
    parts than the allowed difference has one of them in common with each set it links
    to.  One that doesn't is dealt anew by another hash, up to ``DEALS`` times; only the
    last deal's empty parts count.  Of two linked sets both are dealt anew or one fills enough.
    """
    out, spare = [], []
    j, own, before, fewer = size_class(len(s), share)
    edges = _size_edges[share]
    for place, (number, most) in enumerate(((j, own), (before, fewer))):
        for deal in range(DEALS if most >= 0 else 0):
            # The same number for all that meet in the class; one part is the whole set.
            k = _parts(most, edges[number])
            h = _mixed(s + np.uint64(deal))
            sums = np.zeros(k, np.uint64)
            part = (h % np.uint64(k)).astype(np.int64)
            np.add.at(sums, part, h)
            filled = np.bincount(part, minlength=k) > 0
            key = _mixed(_mixed(sums + np.uint64(number * DEALS + deal)) + np.arange(k, dtype=np.uint64))
            enough = filled.sum() > most
            out.append(key if deal == DEALS - 1 and not enough else key[filled])
            spare.append(np.full(len(out[-1]), max(0, len(out[-1]) - most - 1) * SPARE + place * DEALS + deal, np.int64))
            if enough:
                break
    return np.concatenate(out).view(np.int64), np.concatenate(spare)


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _links(inter: np.ndarray, n: np.ndarray, m: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    return share[1] * inter >= share[0] * (n + m - inter)


class _Region:
    """Members of a region in one task; finds links between their components."""

    def __init__(self, sets: list[np.ndarray], component: list[int], share: tuple[int, int] = SHARE):
        self.share = share
        self.n = np.array([len(s) for s in sets])
        self.ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.seen = np.zeros(int(self.ids.max()) + 1, bool)
        names = {c: i for i, c in enumerate(dict.fromkeys(component))}
        self.of = np.array([names[c] for c in component])
        self.found: list[tuple[int, int]] = []

    def shared(self, x: int, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``x`` with the members."""
        own = self.ids[self.at[x] : self.at[x + 1]]
        self.seen[own] = True
        sizes = self.n[members]
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1]) + np.repeat(self.at[members] - (ends - sizes), sizes)
        out = np.add.reduceat(self.seen[self.ids[flat]].astype(np.int32), ends - sizes)
        self.seen[own] = False
        return out

    def compare(self, x: int, members: np.ndarray) -> np.ndarray:
        """Distances of ``x`` to the members; those that link become one component with it."""
        inter = self.shared(x, members)
        for y in members[_links(inter, self.n[x], self.n[members], self.share)]:
            if self.of[x] != self.of[y]:
                self.found.append((x, int(y)))
                self.of[self.of == self.of[y]] = self.of[x]
        return 1 - inter / (self.n[x] + self.n[members] - inter)

    def join(self, members: np.ndarray) -> None:
        """All links between components among the members."""
        if len(members) < 2 or (self.of[members] == self.of[members[0]]).all():
            return
        if len(members) <= _SMALL:
            self.scan(members, np.zeros((0, len(members))))
            return
        pivots, distances = [], []
        far = np.full(len(members), np.inf)
        at = 0
        for _ in range(_CELLS):
            pivots.append(at)
            distances.append(self.compare(int(members[at]), members))
            far = np.minimum(far, distances[-1])
            at = int(far.argmax())
        d = np.array(distances)
        reach = d <= d.min(0) + 2 * (1 - self.share[0] / self.share[1]) + 1e-9
        reach[:, pivots] = False  # already compared with all
        if reach.sum(1).max() > 0.8 * len(members) or reach.sum() > 2 * len(members):
            self.scan(members, d)
            return
        for cell in reach:
            self.join(members[cell])

    def scan(self, members: np.ndarray, d: np.ndarray) -> None:
        """Each member outside the largest component against all others that the pivots' distances don't rule out."""
        names, counts = np.unique(self.of[members], return_counts=True)
        least, whole = self.share
        window = 1 - least / whole + 1e-9
        for i in np.flatnonzero(self.of[members] != names[counts.argmax()]):
            x = int(members[i])
            near = (np.abs(d - d[:, i : i + 1]) <= window).all(0) & (self.of[members] != self.of[x])
            near &= (self.n[members] * least <= self.n[x] * whole) & (self.n[x] * least <= self.n[members] * whole)
            if near.any():
                self.compare(x, members[near])


def _points(docs: DataFrame, id_col: str, text_col: str, words: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, n, point (hash of the set), its parts and what it can spare of them, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, point, parts, spare = [], [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py() or "", words)
                    n.append(len(s))
                    point.append(_set_id(s) if len(s) else None)
                    keys, more = part_keys(s, share) if len(s) else (np.zeros(0, np.int64),) * 2
                    parts.append(keys)
                    spare.append(more)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind)) for x, kind in ((parts, pa.int64()), (spare, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(point, pa.int64()), *lists], ["doc_id", "n", "point", "parts", "spare"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, point long, parts array<long>, spare array<int>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(point, n, s) of the wanted (doc_id, point)s, from the documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                points, sets = [], []
                for point, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    s = shingles(text.as_py() or "", words)
                    if len(s) and _set_id(s) == point:  # rows of one id may differ
                        points.append(point)
                        sets.append(s)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(points, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["point", "n", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).alias("text"))
    # The wanted ids grow with the corpus: they meet the texts by a shuffle at every size.
    rows = texts.join(wanted.hint("merge"), texts["_d"].eqNullSafe(wanted["doc_id"])).select("point", "text")
    return rows.mapInArrow(run, "point long, n long, s array<long>").dropDuplicates(["point"])


def _tasks(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links in each task. rows: (region, task, point, component, pivot, s).

    With pivots, of the pivots to the members; without, of all members of different
    components.  Tasks stream through a worker one after the other, in order.
    """

    def links(ids: list[int], component: list[int], pivot: list[bool], sets: list[np.ndarray]) -> pa.RecordBatch:
        region = _Region(sets, component, share)
        everyone = np.arange(len(ids))
        for x in np.flatnonzero(pivot):
            region.compare(int(x), everyone)
        if not any(pivot):
            region.join(everyone)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in region.found], pa.int64()), pa.array([ids[j] for _, j in region.found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])
        for batch in batches:
            for region, task, point, component, pivot, s in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                if (region, task) != now:
                    if held[0]:
                        yield links(*held)
                    now, held = (region, task), ([], [], [], [])
                for column, value in zip(held, (point, component, pivot, s.values.to_numpy(zero_copy_only=False).view(np.uint64)), strict=True):
                    column.append(value)
        if held[0]:
            yield links(*held)

    dealt = rows.select("region", F.col("task").cast("string").alias("task"), "point", "component", "pivot", "s")
    return dealt.repartition(partitions(rows.sparkSession), "region", "task").sortWithinPartitions("region", "task").mapInArrow(run, "a long, b long")


def _meetings(base: DataFrame, ws: Tables) -> DataFrame:
    """(a, b): points that are in one part which both can't spare; each to the smallest point there."""
    spark = base.sparkSession
    keyed = base.filter("point is not null").select("point", F.explode(F.arrays_zip("parts", "spare")).alias("x")).select("point", F.col("x.parts").alias("key"), F.col("x.spare").alias("spare"))
    # Parts of very many rows are few, which the draw bounds; they are counted before they are shuffled.
    rows = base.count()
    drawn = keyed if rows <= DRAWN else base.sample(DRAWN / rows, seed=7).filter("point is not null").select(F.explode("parts").alias("key"))
    hot = drawn.groupBy("key").count().filter(F.col("count") > min(rows, DRAWN) / HOT).select("key").collect()
    hot = F.broadcast(spark.createDataFrame(hot, "key long"))
    key = Window.partitionBy("key")
    few = keyed.join(hot, "key", "left_anti").select("key", "point", "spare", F.count(F.lit(1)).over(key).alias("crowd"), F.min("point").over(key).alias("lo"), F.max("point").over(key).alias("hi"))
    many = ws.save(keyed.join(hot, "key", "left_semi").select("key", "point", "spare").distinct(), "hot")
    counts = many.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"), F.min("point").alias("lo"), F.max("point").alias("hi"))
    many = many.join(F.broadcast(counts), "key").select("key", "point", "spare", "crowd", "lo", "hi")
    crowded = ws.save(few.unionByName(many).filter("lo <> hi").select("key", "point", "spare", "crowd").distinct(), "crowded")
    # Any order of the parts will do that is the same for all sets; the most crowded ones go.
    order = Window.partitionBy("point", "spare").orderBy(F.col("crowd").desc(), "key")
    kept = crowded.withColumn("at", F.row_number().over(order)).filter(F.col("at") > F.floor(F.col("spare") / SPARE)).select("key", "point")
    kept = ws.save(kept.distinct(), "kept")
    least = kept.groupBy("key").agg(F.min("point").alias("b"))
    edges = ws.save(kept.join(least, "key").filter("point <> b").select(F.col("point").alias("a"), "b").distinct(), "meetings")
    ws.release(crowded, kept)
    return edges


def _weight() -> Column:
    return F.sum(F.col("n") + DOCUMENT)


def _pivot_links(members: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links to a few pivots of each region. members: (region, point, n)."""
    tasks = 4 * partitions(members.sparkSession)
    size = F.greatest(F.lit(BLOCK), F.col("w") / tasks)
    picked = F.array(*[F.min_by("point", F.xxhash64("point", F.lit(i))) for i in range(PIVOTS)])
    regions = members.groupBy("region").agg(_weight().alias("w"), picked.alias("picked")).select("region", "picked", F.ceil(F.col("w") / size).cast("int").alias("chunks"))
    rows = members.join(regions, "region").select("region", "point", F.pmod(F.xxhash64("point"), "chunks").cast("int").alias("task"), F.lit(False).alias("pivot"))
    own = regions.select("region", F.explode(F.array_distinct("picked")).alias("point"), "chunks")
    own = own.select("region", "point", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("task"), F.lit(True).alias("pivot"))
    both = rows.unionByName(own).groupBy("region", "point", "task").agg(F.max("pivot").alias("pivot"))
    dealt = both.join(sets, "point").withColumn("component", F.col("point"))
    return _tasks(dealt, share)


def _block_links(members: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links between components of a region. members: (region, point, n, component)."""
    side = int(np.ceil(np.sqrt(2 * partitions(members.sparkSession))))
    weights = members.groupBy("region", "component").agg(_weight().alias("w"))
    sizes = weights.groupBy("region").agg(F.max_by("component", "w").alias("main"), F.max("w").alias("in_main"), F.sum("w").alias("w"))
    size = F.greatest(F.lit(BLOCK), F.col("w") / side)
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / size)).cast("int")
    sizes = sizes.select("region", "main", blocks(F.col("in_main")).alias("nc"), blocks(F.col("w") - F.col("in_main")).alias("nr"))
    rows = members.join(sizes, "region").withColumn("rest", F.col("component") != F.col("main"))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("point"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nc"))).cast("int"))
    # A block of the rest meets every block of the rest and of the main component.
    each = lambda n, kind, name: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda o: F.concat_ws(":", F.lit(kind), *name(o)))
    text = lambda c: c.cast("string")
    among = each("nr", "r", lambda o: (text(F.least("k", o)), text(F.greatest("k", o))))
    to_main = each("nc", "c", lambda o: (text(F.col("k")), text(o)))
    to_rest = each("nr", "c", lambda o: (text(o), text(F.col("k"))))
    none = F.array().cast("array<string>")
    tasks = F.when(F.col("rest"), F.concat(F.when(F.col("nr") > 1, among).otherwise(none), to_main)).otherwise(to_rest)
    dealt = rows.select("region", F.explode(F.array_distinct(tasks)).alias("task"), "point", "component").join(sets, "point")
    return _tasks(dealt.withColumn("pivot", F.lit(False)), share)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Sets of shingles of ``words`` words link from a similarity of share[0] / share[1] on.
    A document with fewer words than a shingle has one shingle of all of them; one
    without words or text has none and links with nothing, and its component is its
    own id.  Rows with equal sets are linked.  A null id is smaller than none; a
    component of null ids only has a null id.  An empty table gives no rows.
    """
    ship(docs.sparkSession)
    ws = Tables(docs.sparkSession)
    parted = ws.save(_points(docs, id_col, text_col, words, share), "points")
    meetings = _meetings(parted, ws)
    base = ws.save(parted.select("doc_id", "n", "point"), "rows")
    ws.release(parted)
    regions = components(meetings, ws)
    ws.release(meetings)
    ids = base.filter("point is not null").groupBy("point").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    members = ws.save(regions.join(ids, regions["node"] == ids["point"]).select("point", "doc_id", "n", F.col("component").alias("region")), "members")
    sets = ws.save(_sets(docs, members.select("doc_id", "point"), id_col, text_col, words), "sets").select("point", "s").hint("merge")
    weights = members.groupBy("region").agg(_weight().alias("w"))
    small = members.join(weights.filter(F.col("w") <= BLOCK), "region", "left_semi")
    large = members.join(weights.filter(F.col("w") > BLOCK), "region", "left_semi").select("region", "point", "n")
    alone = _tasks(small.select("region", F.lit("").alias("task"), "point", F.col("point").alias("component"), F.lit(False).alias("pivot")).join(sets, "point"), share)
    links = ws.save(alone, "links")
    near = ws.save(_pivot_links(large, sets, share), "pivot-links")
    found = components(near, ws)
    named = ws.save(large.join(found, large["point"] == found["node"], "left").select("region", "point", "n", F.coalesce("component", "point").alias("component")), "named")
    open_ = named.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("region")
    more = _block_links(named.join(open_, "region", "left_semi"), sets, share)
    final = ws.save(components(links.unionByName(near).unionByName(more), ws), "components")
    rows = base.select("doc_id", "n", "point").join(final, base["point"] == final["node"], "left").select("doc_id", "n", F.coalesce("component", "point").alias("c"))
    # Written, so that the join has plain shuffles on both sides and a large component is split; by a shuffle at every size.
    least = ws.save(rows.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("least")), "least")
    out = rows.join(least.hint("merge"), "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all columns.

    Rows of one id stay or go together; rows with a null id stay only if no row of
    their component has one.
    """
    found = linked(docs, id_col, text_col, words, share)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"))
    return rows.join(stays, F.col("_id").eqNullSafe(F.col("_stays")), "left_semi").select("_row.*")
