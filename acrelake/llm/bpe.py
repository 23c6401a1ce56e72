"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` turns whole texts into ids, ``decode`` turns ids into raw bytes. A long text is first cut at
places where the pre-splitting pattern can't match across: between a word character and a plain space.
No alternative of the pattern has a space after another kind of character, and the look-ahead of
white space runs only asks what follows such a run, so the pieces give the ids of the whole text.

Defined results: a null or empty text has no ids; ids that are null decode to no bytes; extra columns are
dropped, whatever their names; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: Between a word character and a plain space.
_SAFE = re.compile(r"(?<=\w)(?= )")
#: A piece holds at least so many characters; the value only bounds the encoder's memory.
PIECE_CHARS = 1 << 16
#: Workers hand on their results in parts made from about so many bytes.
PART_BYTES = 1 << 20


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file (lines of a base64 token and its rank), without special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str | None, size: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, size) for i in enc.encode_ordinary(piece)]


def _parts(batch: pa.RecordBatch, column: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of ``column``, one row at least, so that what a worker holds is bounded."""
    offsets = batch.column(column).offsets if pa.types.is_list(batch.column(column).type) else None
    sizes = np.diff(offsets.to_numpy()) * 4 if offsets is not None else np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)])
    start, total = 0, 0
    for row, n in enumerate(sizes.tolist()):
        if row > start and total + n > most:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += n
    if len(sizes):
        yield batch.slice(start)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in _parts(batch, 1):
                rows = [np.array(encode_text(enc, t.as_py()), np.int32) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    rows = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, ids array<int>")


def decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, ids, raw binary): the bytes of every id in turn, which need not be valid UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in _parts(batch, 1):
                raw = pa.array([enc.decode_bytes(i.as_py() or []) for i in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), raw], [id_col, "ids", "raw"])

    rows = tokens.select(id_col, tokens[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, ids array<int>, raw binary")
