"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Defined cases: a null text is the empty text, which has no ids; a null id column decodes to no bytes. Repeated
rows are encoded alike, other columns pass through, and a column bearing an output's name is replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType

from tessera.llm.common import map_rows

#: Texts above this many characters are cut at safe boundaries first.
LONG_TEXT = 1 << 16


def load_encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_cuts(text: str, target: int = LONG_TEXT) -> list[str]:
    """Pieces of about target characters whose encodings, joined, are the encoding of text.

    Each cut stands before a blank that follows a character which isn't white space. No match of the pattern
    spans that place (white space begins a match or is a match of its own) and none that ends there looks beyond it.
    """
    pieces, start = [], 0
    while len(text) - start > target:
        at = text.find(" ", start + target)
        while at > 0 and text[at - 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        pieces.append(text[start:at])
        start = at
    pieces.append(text[start:])
    return pieces


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Appends the ids of the text as packed little-endian unsigned 32-bit integers; special tokens' strings are ordinary text."""

    def make():
        encoding = load_encoding(rank_path, pattern)

        def ids(text: str | None) -> bytes:
            return b"".join(np.asarray(encoding.encode_ordinary(piece), "<u4").tobytes() for piece in safe_cuts(text or ""))

        return lambda rows: [(ids(text),) for (text,) in rows]

    return map_rows(df, [text_col], [(out, BinaryType())], make)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Appends the bytes that the packed ids stand for. They are raw bytes: a cut id sequence need not be UTF-8."""

    def make():
        encoding = load_encoding(rank_path, pattern)
        return lambda rows: [(encoding.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist()),) for (ids,) in rows]

    return map_rows(df, [ids_col], [(out, BinaryType())], make)
