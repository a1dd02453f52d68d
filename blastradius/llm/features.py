"""Hashed byte n-grams of many texts at once, and linear models over their mean."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BITS = 17
SIZE = 1 << BITS
#: Bytes of text worked on at once; a longer text is taken in several pieces.
SLICE_BYTES = 2 << 20
_MULTIPLIER = np.uint32(2654435761)


def folded() -> np.ndarray:
    """A table of bytes: A-Z as a-z, what is neither letter nor part of one as space."""
    out = np.arange(256, dtype=np.uint8)
    out[:65] = out[91:97] = out[123:128] = 32
    out[65:91] += 32
    return out


FOLDED, PLAIN = folded(), np.arange(256, dtype=np.uint8)


def grams(raw: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Slot of the three bytes that begin at each byte but the last two."""
    b = fold[raw].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * _MULTIPLIER) >> np.uint32(32 - BITS)).astype(np.int32)


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first, pieces of texts in UTF-8) of about ``SLICE_BYTES``; a long text comes alone, whole."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text.as_py() or "").encode()
        if held and size + len(raw) > SLICE_BYTES:
            yield first, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def scores(held: list[bytes], weights: list[np.ndarray], fold: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams, a row a text and a column a model; every byte of every text counts."""
    out = np.zeros((len(held), len(weights)))
    if len(held) == 1 and len(held[0]) > SLICE_BYTES:
        raw, total = b" " + held[0] + b" ", 0
        for at in range(0, len(raw) - 2, SLICE_BYTES):
            index = grams(np.frombuffer(raw[at : at + SLICE_BYTES + 2], np.uint8), fold)
            out[0] += [w[index].sum() for w in weights]
            total += len(index)
        return out / total
    raw = np.frombuffer(b" " + b"  ".join(held) + b"  ", np.uint8)
    index = grams(raw, fold)
    # A text of n bytes with a space on either side has n grams; an empty one gets the one of its spaces.
    sizes = np.array([len(x) for x in held])
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    counts = np.maximum(sizes, 1)
    edges = np.stack([starts, starts + counts], 1).ravel()
    for j, w in enumerate(weights):
        out[:, j] = np.add.reduceat(np.append(w[index], [0.0, 0.0]), edges)[::2] / counts
    return out


def vector(text: str, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, share of the n-grams in each) of one text."""
    raw = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
    slots, counts = np.unique(grams(raw, fold), return_counts=True) if len(raw) > 2 else (np.zeros(0, np.int32), np.zeros(0))
    return slots, counts / max(1, counts.sum())
