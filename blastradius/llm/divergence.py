"""How far the sources of a language lie apart, term by term.

The counts of a language's terms in its sources are a matrix, one row a source and
one column a kept term, mostly zero.  Its columns are cut into blocks, and over each
block lies a k^2-tree: every node tells whether its quadrant holds anything at all.
Two sources are compared by walking their rows down the tree together.  A quadrant
that is empty for both ends the walk: there each share is what smoothing alone
gives it, so all its columns are priced at once, as number of columns times one
value.  Leaves that are not empty are priced one by one.  Blocks give one sum and one
number of priced columns a pair, and the rest of the columns follows from the number
of terms, so an empty block is never made.

Shares are whole numbers, parts of ``SCALE``; all arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blastradius.llm.common import ship, whole, workspace

#: A term is kept in a language where it is in so many documents.
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: Columns of a block and rows of a tile, both powers of two: a task holds two tiles of one block.
WIDTH, TILE = 4096, 64
#: Bytes of text a worker counts at once (a longer text is counted alone), and rows of a batch it hands on.
_BYTES, _ROWS = 16 << 20, 50_000
#: Letters of terms: A-Z as a-z, all bytes of longer characters; the rest is space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the number of the text each stands in."""
    raw = np.frombuffer(b" ".join(texts).translate(_LETTERS) + b" ", np.uint8)
    letter = raw != 32
    step = np.diff(letter.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[letter])])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return terms, np.searchsorted(begins, starts, "right") - 1


def _tallies(groups: list[tuple[str, str]], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The counts of some texts: terms and texts become numbers, equal pairs of them are counted by sorting."""
    terms, text = _terms(texts)
    if not len(terms):
        return
    coded = terms.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    seen, n = np.unique(text * len(names) + code, return_counts=True)  # one entry a text and term
    number = {group: i for i, group in enumerate(dict.fromkeys(groups))}
    group = np.array([number[g] for g in groups])[seen // len(names)]
    cell, at, docs = np.unique(group * len(names) + seen % len(names), return_inverse=True, return_counts=True)
    total = np.bincount(at, n, len(cell)).astype(np.int64)
    bounds = np.searchsorted(cell, np.arange(len(number) + 1) * len(names))
    for (lang, source), low, high in zip(number, bounds[:-1], bounds[1:], strict=True):
        part = names.take(pa.array(cell[low:high] % len(names)))
        step = max(1, min(_ROWS, len(part) * _BYTES // max(1, part.nbytes)))  # a batch holds about so many bytes
        for i in range(low, high, step):
            j = min(i + step, high)
            same = [pa.repeat(pa.scalar(name, pa.string()), j - i) for name in (lang, source)]
            item = part.slice(i - low, j - i).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*same, item, pa.array(total[i:j]), pa.array(docs[i:j], pa.int64())], ["lang", "source", "term", "n", "docs"])


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, counted in parts of about ``_BYTES`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, texts, size = [], [], 0
        for part in batches:
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                groups.append((lang, source))
                texts.append(text.as_py().encode())
                size += len(texts[-1])
                if size >= _BYTES:
                    yield from _tallies(groups, texts)
                    groups, texts, size = [], [], 0
        yield from _tallies(groups, texts)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), in decimals wide enough for any count."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div nullif(cast({total} + 2 * {terms} as decimal(21,0)), 0)").cast("long")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


class Quadtree:
    """Which quadrants of a matrix of shares hold anything; 0 in the matrix is a count of zero.

    Level 0 has a node a cell, each further level one for two by two nodes of the one
    below, until one row is left; from there on nodes only grow wider.
    """

    def __init__(self, shares: np.ndarray):
        rows = 1 << max(0, len(shares) - 1).bit_length()
        full = np.zeros((rows, shares.shape[1]), bool)
        full[: len(shares)] = shares > 0
        self.levels, self.rows = [full], len(shares)
        while len(full) > 1:
            full = full[::2] | full[1::2]
            full = full[:, ::2] | full[:, 1::2]
            self.levels.append(full)

    def pairs(self, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, later row, column) of all leaves below column ``c`` of the top that hold anything for one of the two rows."""
        a = b = np.zeros(1, np.int64)
        at = np.array([c])
        keep = self.levels[-1][0, at]
        a, b, at = a[keep], b[keep], at[keep]
        for full in self.levels[-2::-1]:
            a, b, at = (np.add.outer(2 * x, child).ravel() for x, child in zip((a, b, at), _CHILDREN, strict=True))
            keep = (a <= b) & (full[a, at] | full[b, at])
            a, b, at = a[keep], b[keep], at[keep]
        apart = (a < b) & (b < self.rows)
        return a[apart], b[apart], at[apart]


#: The eight ways to step down: either half of the first row's node, of the second's, of the column's.
_CHILDREN = np.array([[i >> 2, i >> 1 & 1, i & 1] for i in range(8)]).T


def _priced(width: int, tile: int) -> Callable[[pa.Table], pa.Table]:
    """(lang, a, b, value, priced) of the pairs of one task: two tiles of sources in one block of columns."""

    def run(table: pa.Table) -> pa.Table:
        g, col, p = (table.column(name).to_numpy() for name in ("g", "col", "p"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        bare = col < 0
        groups, first = np.unique(g[bare], return_index=True)
        smoothed = p[bare][first]
        shares = np.zeros((len(groups), width), np.int64)
        shares[np.searchsorted(groups, g[~bare]), col[~bare]] = p[~bare]
        tree = Quadtree(shares)
        n = len(groups)
        value, priced = np.zeros(n * n), np.zeros(n * n, np.int64)
        for c in range(tree.levels[-1].shape[1]):
            a, b, at = tree.pairs(c)
            if low != high:
                across = (groups[a] // tile == low) & (groups[b] // tile == high)
                a, b, at = a[across], b[across], at[across]
            x, y = shares[a, at], shares[b, at]
            x, y = np.where(x > 0, x, smoothed[a]), np.where(y > 0, y, smoothed[b])
            # Sums stay far below 2^53: the shares of a source add up to SCALE and a little.
            value += np.bincount(a * n + b, (x - y) ** 2 // (x + y), n * n)
            priced += np.bincount(a * n + b, minlength=n * n)
        some = np.flatnonzero(priced)
        lang = pa.array([table.column("lang")[0].as_py()] * len(some), pa.string())
        numbers = [groups[some // n], groups[some % n], value[some].astype(np.int64), priced[some]]
        return pa.Table.from_arrays([lang, *[pa.array(x, pa.int64()) for x in numbers]], ["lang", "a", "b", "value", "priced"])

    return run


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    *, min_docs: int = MIN_DOCS, top: int = TOP, width: int = WIDTH, tile: int = TILE,
) -> DataFrame:
    """Per language and source: lang, source, part, item, value, rank.

    Part ``pair`` has each other source of the language and the sum over all kept
    terms; part ``term`` the ``top`` terms that the source uses more than its language
    does.  Larger values come first, of equal ones the smaller item by its bytes.

    Null text, language and source are empty strings.  A term is a run of ASCII
    letters and characters beyond ASCII, A-Z in lower case, of any length.  Repeated
    rows each count.  A source without terms has pairs; a language without kept terms
    has pairs of value 0 and no terms; one with a single source has no pairs.  An
    empty table gives no rows.  Other columns are not read.
    """
    ship(docs.sparkSession)
    ws = workspace(docs.sparkSession)
    texts = docs.select(whole(lang_col).alias("lang"), whole(source_col).alias("source"), whole(text_col).alias("text"))
    # Counts meet once, by term: a term has at most one row a part and source. Rare terms, the bulk of the rows, go in that stage.
    cells = _counted(texts).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = Window.partitionBy("lang", "term")
    cells = cells.select("lang", "source", "term", "n", F.sum("n").over(everywhere).alias("all_n"), F.sum("docs").over(everywhere).alias("docs"))
    cells = ws.save(cells.filter(F.col("docs") >= min_docs).drop("docs"), "cells")
    kept = cells.groupBy("lang", "term").agg(F.first("all_n").alias("all_n"))
    kept = ws.save(kept.sortWithinPartitions("lang", "term").select("lang", "term", "all_n", F.monotonically_increasing_id().alias("id")), "terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_n"))
    held = ws.save(cells.join(kept.select("lang", "term", "id"), ["lang", "term"]), "kept-cells")
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = texts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("source_n", "terms", "lang_n")], numbered.cast("long").alias("g"))
    groups = ws.save(groups.withColumn("smoothed", _share("cast(0 as bigint)", "source_n", "terms")), "groups")

    priced = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "id", "g", _share("n", "source_n", "terms").alias("p"), _share("all_n", "lang_n", "terms").alias("q"))
    over = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    # A cell meets every tile of its language's sources, and each task also gets what smoothing gives its sources.
    cell = priced.select("lang", (F.shiftright("id", width.bit_length() - 1)).alias("block"), "g", (F.col("id") % width).alias("col"), "p")
    blocks = kept.select("lang", F.shiftright("id", width.bit_length() - 1).alias("block")).distinct()
    bare = blocks.join(groups, "lang").select("lang", "block", "g", F.lit(-1).cast("long").alias("col"), F.col("smoothed").alias("p"))
    own = F.floor(F.col("g") / tile)
    tiles = groups.groupBy("lang").agg(F.max(own).alias("last"))
    dealt = cell.unionByName(bare).join(tiles, "lang").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other"))
    dealt = dealt.select("lang", "block", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), "g", "col", "p")
    sums = dealt.groupBy("lang", "block", "low", "high").applyInArrow(_priced(width, tile), "lang string, a long, b long, value long, priced long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("priced").alias("priced"))

    one = groups.select("lang", "source", "terms", F.col("g").alias("x"), F.col("smoothed").alias("p"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("y"), F.col("smoothed").alias("q"))
    pairs = one.join(two, "lang").filter("x <> y").withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y")).join(sums, ["lang", "a", "b"], "left")
    none = F.lit(0).cast("long")
    value = F.coalesce("value", none) + F.coalesce(_apart("p", "q") * (F.col("terms") - F.coalesce("priced", none)), none)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
