"""Packing documents into sequences of bounded length.

Documents become token ids, and pieces where they are longer than a sequence.
Pieces are dealt at random to partitions of bounded size, each packed best-fit
decreasing.  Dual feasible functions give a lower bound of a partition's bins.  A
partition that meets it is settled but for its emptiest bin; one with a gap keeps
its full bins only.  What is not settled is exchanged: dealt anew and packed
again, until it fits one partition or the rounds are over.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blastradius.llm.bpe import WordIds
from blastradius.llm.common import ship, workspace

CAPACITY, END_ID = 2048, 0
#: Pieces a partition holds on average; one task packs them in memory.
PER_PARTITION = 50_000
ROUNDS = 6
#: Words a worker remembers before it starts anew.
MEMORY = 500_000
#: Bytes of text whose distinct words are looked up together.
CHUNK = 4 << 20
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path, MEMORY)
    return _words[path]


def token_ids(words: WordIds, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each text's followed by ``END_ID``; where each text's ids begin, and the end).

    Each distinct word of the texts is looked up once.
    """
    apart = pc.ascii_split_whitespace(texts)
    bounds = apart.offsets.to_numpy().astype(np.int64) - apart.offsets[0].as_py()
    coded = apart.flatten().dictionary_encode()
    found = words.of(coded.dictionary.to_pylist())
    found.append(np.array([END_ID], "<u4").tobytes())
    sizes = np.array([len(w) for w in found], np.int64) // 4
    flat, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
    each = np.insert(coded.indices.to_numpy().astype(np.int64), bounds[1:], len(found) - 1)
    counts = sizes[each]
    ends = np.cumsum(counts)
    ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[each] - (ends - counts), counts)]
    starts = np.concatenate([[0], ends[bounds[1:] + np.arange(len(texts))]]) if len(texts) else np.zeros(1, np.int64)
    return ids, starts


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of texts of about ``CHUNK`` bytes; a longer text comes alone, whole."""
    begin, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > begin and size + n > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a document's ids end with ``END_ID``."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for begin, end in _runs(texts):
                out: list[list] = [[], [], [], [], []]
                ids, starts = token_ids(words, texts.slice(begin, end - begin))
                raw = memoryview(ids.tobytes())
                for doc, low, high in zip(batch.column(0).slice(begin, end - begin).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    for n, at in enumerate(range(low, high, capacity)):
                        stop = min(high, at + capacity)
                        for column, value in zip(out, (doc, n, at - low, stop - at, zlib.crc32(raw[4 * at : 4 * stop])), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, _ITEM)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, the largest of two families of dual feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    n, w = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * sizes)])  # of lengths below
    best = math.ceil(w[-1] / capacity)
    half = capacity // 2
    for k in range(1, half + 1):  # above capacity - k counts as 1, below k as 0
        large = n[-1] - n[capacity - k + 1]
        middle, middle_w = n[capacity - k + 1] - n[half + 1], w[capacity - k + 1] - w[half + 1]
        rest = w[half + 1] - w[k] - (middle * capacity - middle_w)
        best = max(best, large + middle + max(0, math.ceil(rest / capacity)))
    for k in range(1, 32):  # rounds down to k-ths, but keeps what divides evenly
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, math.ceil((count * value).sum() / (k * capacity)))
    return int(best)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the fill of each bin: longest first, each to the fullest bin that takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if room > size:
            with_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, np.int64)


def _packer(number: int, final: bool, capacity: int) -> Callable[[pa.Table], pa.Table]:
    """Packs one partition of a round and tells which sequences stay."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        certified = len(fill) <= lower_bound(lengths, capacity)
        stays = np.ones(len(fill), bool)
        if not final and not certified:
            stays = fill == capacity
        elif not final:
            stays[fill.argmin()] = fill.min() == capacity
        part = table.column("part")[0].as_py()
        out = table.select(_COLUMNS)
        for name, values, kind in (
            ("sequence_id", (number << 56) + (part << 24) + bins, pa.int64()), ("offset", offsets, pa.int64()),
            ("certified", np.full(len(bins), certified), pa.bool_()), ("stays", stays[bins], pa.bool_()),
        ):
            out = out.append_column(name, pa.array(values, kind))
        return out

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``pieces`` with sequence_id, offset and certified: the partition it was packed in met its lower bound.

    Every piece is packed; lengths are 1 to ``capacity``.  An empty table gives
    no rows.  Sequences never hold pieces of two rounds.
    """
    ship(items.sparkSession)
    ws = workspace(items.sparkSession)
    loose, left = ws.save_counted(items.select(*_COLUMNS), "pieces")
    settled: list[DataFrame] = []
    for number in range(rounds):
        parts = max(1, math.ceil(left / per_partition))
        final = parts == 1 or number == rounds - 1
        dealt = loose.withColumn("part", F.pmod(F.xxhash64(F.lit(number), "doc_id", "piece", "start", F.monotonically_increasing_id()), F.lit(parts)))
        packed = ws.save(dealt.groupBy("part").applyInArrow(_packer(number, final, capacity), _ITEM + ", sequence_id long, offset long, certified boolean, stays boolean"), f"packed-{number}")
        settled.append(packed.filter("stays").drop("stays"))
        if final:
            break
        loose = packed.filter("not stays").select(*_COLUMNS)
        left = loose.count()
        if not left:
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def packed_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``pack`` of the ``pieces`` of documents: null text is empty and gives the end id alone; each row of a repeated id is packed."""
    return pack(pieces(docs, path, id_col, text_col, capacity), capacity)
