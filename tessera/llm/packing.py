"""Packing by power-of-two decomposition: no sequence crosses documents and none needs padding.

A document of n tokens becomes n // max_length pieces of max_length and one piece for each binary digit of the
rest, longest first. Pieces of equal length form a bucket; each piece is a sequence of its bucket.

Defined cases: a null or empty text holds the end-of-document id alone; repeated rows and repeated doc_ids are
packed each by itself; an empty table gives no pieces; columns other than the id and the text are dropped.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.bpe import safe_cuts
from tessera.llm.common import SLICE_ROWS, gapless_index, materialize

#: Distinct words of a generation; a worker keeps the ids of two.
CACHED_WORDS = 250_000
#: Characters that are tokenized together.
CHUNK_CHARS = 1 << 20
#: Rows numbered by one window at about.
CELL_ROWS = 4096

#: A word of Latin letters, with its blank, and sentence marks after it: two matches of the pre-tokenizer's pattern.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,!?;:]*)")
#: White space before a blank: there a match of the pre-tokenizer may span two words.
BEFORE_BLANK = tuple(f"{c} " for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
UNSAFE = re.compile("[\x80-\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff] ")


def pieces_of(n: int, max_length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out = [(at, max_length) for at in range(0, n - max_length + 1, max_length)]
    at, length = len(out) * max_length, max_length >> 1
    while length:
        if n & length:
            out.append((at, length))
            at += length
        length >>= 1
    return out


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: its own where it has one, else the next above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts with the BPE model of a tokenizer file, each distinct word once.

    A word starts at a blank that follows no white space, where byte-level pre-tokenization always splits, so
    the ids of the words are the ids of the text. Texts with other white space before a blank, or with several
    blanks together, are pre-tokenized whole. Special tokens' strings are ordinary text.
    """

    def __init__(self, tokenizer_path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_path).model
        self.split = regex.compile(pattern).findall
        self.byte = byte_characters()
        #: Ids by word, without its blank: of late and of before that.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _parts(self, unit: str) -> list[str]:
        m = PLAIN.fullmatch(unit)
        return [x for x in m.groups() if x] if m else self.split(unit)

    def _ids(self, parts: Iterable[str]) -> dict[str, bytes]:
        tokens, byte = self.model.tokenize, self.byte
        return {x: array("I", [t.id for t in tokens(x.encode().decode("latin-1").translate(byte))]).tobytes() for x in parts}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        heads, words = [], []
        for t in texts:
            plain = "  " not in t and t[-1:] != " " and not any(x in t for x in BEFORE_BLANK) and (t.isascii() or not UNSAFE.search(t))
            first, *rest = t.split(" ") if plain else [t]
            heads.append(self._parts(first) if first else [])
            words.append(rest)
        new: set[str] = set()
        for w in words:
            new.update(w)
        new.difference_update(self.known)
        self.known.update({w: self.older[w] for w in new & self.older.keys()})
        split = {w: self._parts(f" {w}") for w in new if w not in self.known}
        ids = self._ids({x for parts in (*split.values(), *heads) for x in parts})
        self.known.update({w: b"".join([ids[x] for x in parts]) for w, parts in split.items()})
        get = self.known.__getitem__
        return [b"".join([ids[x] for x in head]) + b"".join(map(get, w)) for head, w in zip(heads, words, strict=True)]


@lru_cache(4)
def rank_encoding(tokenizer_path: str, pattern: str):
    """A tiktoken encoding from the tokenizer file's own vocabulary if it must give the tokenizer's ids, else None.

    tiktoken merges the neighbours whose joint token has the least id, the tokenizer those whose merge is listed
    first. What happens within the span of a token that is about to arise is what happens to its bytes alone, as
    no merge has crossed its ends. So the two agree if ids rise with the places of merges and if the bytes of each
    token alone become that token; both are checked here for the whole vocabulary.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    byte = {c: b for b, c in byte_characters().items()}
    joint = [vocab.get(a + b) for a, b in merges]
    made = set(joint)
    tokens = [t for t in vocab if all(c in byte for c in t) and (len(t) == 1 or vocab[t] in made)]
    bpe = Tokenizer.from_file(tokenizer_path).model
    rising = all(x is not None for x in joint) and all(x < y for x, y in pairwise(joint)) and len(joint) + 256 == len(tokens)
    if not rising or max(vocab[t] for t in tokens if len(t) == 1) > joint[0] or any([x.id for x in bpe.tokenize(t)] != [vocab[t]] for t in tokens):
        return None
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={bytes(byte[c] for c in t): vocab[t] for t in tokens}, special_tokens={})


def with_added_tokens(encode: Callable[[list[str]], list[bytes]], tokenizer_path: str) -> Callable[[list[str]], list[bytes]]:
    """encode, but with the tokenizer file's added tokens found in the texts first, as the tokenizer does by default."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        data = json.load(f)
    tokens = data.get("added_tokens") or []
    if not tokens:
        return encode
    if data.get("normalizer") or any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
        # Where such a token matches depends on its neighbours; the tokenizer itself knows.
        whole = Tokenizer.from_file(tokenizer_path)
        return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    ids = {t["content"]: t["id"].to_bytes(4, "little") for t in tokens}
    split = re.compile(f"({'|'.join(re.escape(t) for t in sorted(ids, key=len, reverse=True))})").split

    def run(texts: list[str]) -> list[bytes]:
        parts = [split(t) for t in texts]  # text, token, text, ...
        made = iter(encode([x for p in parts for x in p[::2]]))
        return [b"".join([ids[x] if i % 2 else next(made) for i, x in enumerate(p)]) for p in parts]

    return run


@lru_cache(2)
def _encoder(tokenizer_path: str, pattern: str, added: bool = False):
    """texts -> packed ids, by the quicker of two equal ways; added: the file's added tokens keep their ids."""
    if added:
        return with_added_tokens(_encoder(tokenizer_path, pattern), tokenizer_path)
    encoding = rank_encoding(tokenizer_path, pattern)
    if encoding is None:
        return WordEncoder(tokenizer_path, pattern).encode
    one = lambda t: b"".join(np.asarray(encoding.encode_ordinary(x), "<u4").tobytes() for x in safe_cuts(t))
    return lambda texts: [one(t) for t in texts]


def tokenized_pieces(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int, max_length: int, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece. added: strings of the file's added tokens get these tokens' ids, else they are ordinary text."""
    schema = StructType([StructField("doc_id", df.schema[id_col].dataType), *[StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]])
    arrow, end = to_arrow_schema(schema), end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, pattern, added)

        def rows(docs: list, texts: list[str]) -> Iterator[tuple]:
            for doc, ids in zip(docs, encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in pieces_of(n, max_length):
                    yield doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n

        def batch_of(docs: list, texts: list[str]) -> pa.RecordBatch:
            cols = list(zip(*rows(docs, texts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            docs, texts, size = [], [], 0
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    docs.append(doc)
                    texts.append(text or "")
                    size += len(texts[-1])
                    if size > CHUNK_CHARS:
                        yield batch_of(docs, texts)
                        docs, texts, size = [], [], 0
            if docs:
                yield batch_of(docs, texts)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, max_length: int = 2048, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset. Sequences are numbered from 0 without gaps, bucket by bucket, the longest first."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    pieces = materialize(tokenized_pieces(df, tokenizer_path, pattern, end_id, max_length, id_col, text_col, added), "pieces")
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each power of two at most
    first, at = {}, 0
    for r in sorted(sizes, key=lambda r: -r["length"]):
        first[r["length"]] = at
        at += r["n"]
    # A cell deals with about CELL_ROWS of the most frequent length.
    cells = max(1, -(-max((r["n"] for r in sizes), default=0) // CELL_ROWS))
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells))
    placed = gapless_index(pieces, ["length"], salt, ["doc_id", "start", "ids_crc32", "doc_tokens"], "in_bucket")
    base = F.element_at(F.create_map(*[F.lit(x) for k, v in first.items() for x in (k, v)]), F.col("length")) if first else F.lit(0)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (base.cast("long") + F.col("in_bucket")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
