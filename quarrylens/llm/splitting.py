"""Cutting oversized values into overlapping pieces at natural boundaries.

A value is tokenised once; the running sum of token lengths gives every token's end offset, and the offsets that end a
block, a line, a statement or a word form sorted boundary arrays. Each cut is a binary search for the last boundary
within the limit, the strongest kind first; where none lies far enough past the overlap, the cut is hard. The next
piece starts ``overlap`` characters before the cut, so consecutive pieces share exactly that many characters and the
pieces cover the value.

Only values above their limit reach Python: lengths are compared in the JVM, in code points. There is no shuffle;
the limits are one row a table and their number is bounded by the number of tables given.

Edge cases: null, empty and short values give no piece from ``split_oversized`` with ``keep_whole=False`` and one
piece (empty text for empty values, none for null) otherwise; a table without a limit isn't split; a limit of at
most the overlap is an error; CRLF is never cut in two; repeated rows are cut alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\r\n|[\r\n]|[^\S\r\n]+|\w+|[^\w\s]")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted end offsets of blocks (before a blank or unindented line), lines, statements and tokens."""
    tokens = _TOKEN.findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
    kind = np.zeros(len(tokens), dtype=np.int8)
    for i, t in enumerate(tokens):
        if t[0] in "\r\n":
            kind[i] = 2
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            if after[:1] in ("\r", "\n") or after and not after[0].isspace() and after[0] not in "})]":
                kind[i] = 3
        elif t in ";{}" or t == "," or t.isspace():
            kind[i] = 1
    return ends[kind == 3], ends[kind >= 2], ends[kind >= 1], ends


def cut_points(text: str, limit: int, overlap: int, fill: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of the pieces. A block boundary counts only past ``fill`` of the limit, so pieces stay large."""
    if limit <= overlap:
        raise ValueError("the limit must exceed the overlap")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    arrays = boundaries(text)
    spans, start = [], 0
    while n - start > limit:
        floor, end = start + overlap, 0  # a piece must end past the overlap, or the next one wouldn't move on
        for rank, ends in enumerate(arrays):
            at = int(np.searchsorted(ends, start + limit, side="right")) - 1
            least = max(floor + 1, start + int(limit * fill)) if rank < 3 else floor + 1
            if at >= 0 and ends[at] >= least:
                end = int(ends[at])
                break
        if not end:
            end = start + limit
            if text[end - 1] == "\r" and text[end : end + 1] == "\n" and end - 1 > floor:
                end -= 1
        spans.append((start, end))
        start = end - overlap
    spans.append((start, n))
    return spans


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for tbl, row, text, limit, overlap in zip(pdf["tbl"], pdf["row_id"], pdf["text"], pdf["max_chars"], pdf["overlap_chars"]):
            for no, (a, b) in enumerate(cut_points(text, limit, overlap)):
                rows.append((tbl, row, no, a, b, text[a:b]))
        yield pd.DataFrame(rows, columns=["tbl", "row_id", "piece_no", "start_char", "end_char", "piece"])


def split_oversized(values: DataFrame, limits: DataFrame, keep_whole: bool = False) -> DataFrame:
    """Pieces of ``values`` (tbl, row_id, text) under ``limits`` (tbl, max_chars, overlap_chars)."""
    rows = values.select("tbl", F.col("row_id").cast("long").alias("row_id"), "text").join(
        limits.select("tbl", "max_chars", "overlap_chars"), "tbl"
    )
    schema = "tbl string, row_id long, piece_no int, start_char int, end_char int, piece string"
    large = rows.where(F.length("text") > F.col("max_chars")).mapInPandas(_pieces, schema)
    if not keep_whole:
        return large
    whole = rows.where(F.length("text") <= F.col("max_chars")).select(
        "tbl", "row_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_char"),
        F.length("text").alias("end_char"), F.col("text").alias("piece"),
    )
    return large.unionByName(whole)
