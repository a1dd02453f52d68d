"""Encoding and decoding with a merge-type sentence-piece model, by a table of last tokens.

For a text's every prefix the encoding's last token is unique.  An automaton over
the pieces gives the candidates that end at a place; the right one is the one that
may stand after the last token of the prefix before it: the two, put together and
merged by score, come out as the same two.  Such pair tests are remembered.  The
ids are read off backwards.  Work grows with the text's length, not with its merges.

A piece begins with its white space and holds no line end, so a text falls into
words that are encoded by themselves; each worker remembers a bounded number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from blastradius.llm.common import ship

SPACE = "▁"
#: Words and pairs a worker remembers before it starts anew.
MEMORY = 600_000


class _Remembered(dict):
    """key -> make(key), bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        value = self[key] = self.make(key)
        return value


class PieceTable:
    """Encoder and decoder of one model file."""

    def __init__(self, model_path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        self.ids = {m.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = {p: m.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b"" if s else m.id_to_piece(i).replace(SPACE, " ").encode() for i, s in enumerate(special)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.ends = ahocorasick.Automaton()
        for p in self.ids:
            self.ends.add_word(p, p)
        self.ends.make_automaton()
        self.fits = _Remembered(lambda pair: self._merged(pair[0] + pair[1]) == [*pair])
        self.whole = _Remembered(lambda p: self._merged(p) == [p])
        self.word = _Remembered(lambda w: np.array(self._ids(w), "<u4").tobytes())
        #: Where no piece can reach across. Words end before white space only if no piece holds it later on.
        apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.words = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if apart else r"(?s).+")

    def _merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours whose union scores best, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _ids(self, word: str) -> list[int]:
        last: list[str | None] = [None] * (len(word) + 1)
        fits, whole = self.fits, self.whole
        for end, piece in self.ends.iter(word):
            end += 1
            if last[end] is None:
                start = end - len(piece)
                if fits[last[start] or word[start - 1], piece] if start else whole[piece]:
                    last[end] = piece
        # Where nothing fits, a character of no piece stands for itself.
        out: list[int] = []
        end = len(word)
        while end:
            piece = last[end] or word[end - 1]
            known = self.ids.get(piece)
            out += [known] if known is not None else [self.byte_ids[b] for b in reversed(piece.encode())]
            end -= len(piece)
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids without begin and end."""
        words = self.words.findall((SPACE + text).replace(" ", SPACE)) if text else []
        return np.frombuffer(b"".join(map(self.word.__getitem__, words)), "<u4")

    def decode(self, ids: list[int]) -> str:
        """The text; as the library gives it where bytes are no UTF-8."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            return raw.decode().removeprefix(" ")
        except UnicodeDecodeError:
            return self.model.decode(ids)


_tables: dict[str, PieceTable] = {}


def piece_table(model_path: str) -> PieceTable:
    """One table a worker process."""
    if model_path not in _tables:
        _tables[model_path] = PieceTable(model_path)
    return _tables[model_path]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, with ``keep_ids`` also ids and decoded.

    Ids have the begin and end id.  Null text is empty text and gives these two
    alone.  Ids of rows may be null or repeated; each row gives one row.
    """
    ship(docs.sparkSession)
    small = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path)
        first, final = table.model.bos_id(), table.model.eos_id()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = np.concatenate([[first], table.encode(text.as_py() or ""), [final]]).astype("<u4")
                listed = ids.tolist()
                back = table.decode(listed)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), *([listed, back] if keep_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (5 if keep_ids else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int64()), pa.string()] if keep_ids else [])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    chosen = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return chosen.mapInArrow(run, small + (", ids array<long>, decoded string" if keep_ids else ""))
