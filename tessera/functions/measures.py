"""Measures of whole texts as Arrow UDFs, a slice of a batch at a time: the patterns pass over each text in Python, which is several times faster than in the JVM.

Words are runs of letters, digits and underscores of any script, white space is Unicode's; both are what \\w and \\s of Python are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Texts of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 64

WORD, LONG_WORD = re.compile(r"\w+"), re.compile(r"\w{3,}")
#: Of all files that a measure knows.
EXTENSION = re.compile(r"\.(?:py|rs|js|ts|json|md|sql|yml|yaml|c|cpp|h|sh|db)\b")
ASCII_WORD, SMALL_WORD = re.compile(r"\b[a-zA-Z0-9_-]+\b"), re.compile(r"\b[a-z0-9_-]+\b")
SENTENCE_END = re.compile("[.!?]+")
FENCED, QUOTED, ADDRESS = re.compile(r"```[\s\S]*?```"), re.compile(r"`[^`\n]+`"), re.compile(r"https?://\S+")
IDENTIFIER = re.compile(r"(?<!\w)(?:[a-z0-9_]+[A-Z0-9_.][a-zA-Z0-9_]*\b|[A-Z0-9_]{2,}(?!\w)|\w+\.(?:py|js|ts|json|md|rs|go|c|cpp|h|yml|yaml|sql|sh|db)(?!\w))")


def arrow_column(kind: DataType, f: Callable[[str | None], object]) -> Callable[[Column], Column]:
    """f for each text of a column."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = [pa.array([f(t) for t in texts.slice(at, SLICE_ROWS).to_pylist()], arrow) for at in range(0, len(texts), SLICE_ROWS)]
            yield pa.concat_arrays(made) if made else pa.array([], arrow)

    return run


def word_set(t: str | None) -> list[str] | None:
    """Words of three characters or more, each once, sorted."""
    return None if t is None else sorted(set(LONG_WORD.findall(t)))


def entropy(t: str | None) -> float:
    """In bits a character, 0 for an empty text."""
    if not t:
        return 0.0
    _, counts = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    shares = counts / len(t)
    return float(0.0 - sum((shares * np.log2(shares)).tolist()))


def symbol_ratio(t: str | None) -> float:
    return _symbols(t, sum(map(len, WORD.findall(t)))) if t else 0.0


def _symbols(t: str, in_words: int) -> float:
    alnum = in_words - t.count("_")
    return (sum(map(len, t.split())) - alnum) / alnum if alnum else 1.0


def n_identifiers(t: str) -> int:
    return sum(1 for _ in IDENTIFIER.finditer(t))


def specificity(t: str | None) -> float:
    n = len(WORD.findall(t or ""))
    return n_identifiers(t) / n if n else 0.0


def duplicate_ratio(w: list[str], n: int) -> float:
    total = len(w) - (n - 1)
    return 1 - len(set(zip(*[w[i:] for i in range(n)], strict=False))) / total if total > 0 else 0.0


def prose(t: str | None, path: re.Pattern) -> str | None:
    if t is None:
        return None
    if "`" in t:
        t = QUOTED.sub(" ", FENCED.sub(" ", t))
    if "://" in t:
        t = ADDRESS.sub(" ", t)
    if EXTENSION.search(t):
        t = path.sub(" ", t)
    return " ".join(t.split())


def coleman_liau(p: str | None) -> float:
    """Not rounded yet."""
    return _coleman_liau(p or "", ASCII_WORD.findall(p or ""))


def _coleman_liau(p: str, w: list[str]) -> float:
    if not w:
        return 0.0
    n, letters = len(w), sum(map(len, w))
    sentences = max(1, sum(1 for x in SENTENCE_END.split(p) if x and not x.isspace()))
    return 0.0588 * (letters / n * 100) - 0.296 * (sentences / n * 100) - 15.8


def bigram_validity(p: str | None, function_words: frozenset[str], lexicon: frozenset[str]) -> float:
    """Not rounded yet."""
    return _bigrams(SMALL_WORD.findall((p or "").lower()), function_words, lexicon)


def _bigrams(w: list[str], function_words: frozenset[str], lexicon: frozenset[str]) -> float:
    if len(w) < 2:
        return 1.0
    good, pairs = 0, lexicon_pairs(lexicon)
    for pair in zip(w, w[1:], strict=False):
        a, b = pair
        good += (a in function_words or b in function_words) and len(a) > 2 and len(b) > 2 or pair in pairs
    return good / (len(w) - 1)


@lru_cache(4)
def lexicon_pairs(lexicon: frozenset[str]) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(x.split(" ")) for x in lexicon)


PROSE_MEASURES = "n long, cli double, big double"


def of_prose(p: str | None, function_words: frozenset[str], lexicon: frozenset[str]) -> dict:
    p = p or ""
    w = ASCII_WORD.findall(p)
    small = [x.lower() for x in w] if p.isascii() else SMALL_WORD.findall(p.lower())
    return {"n": len(w), "cli": _coleman_liau(p, w), "big": _bigrams(small, function_words, lexicon)}


def ascii_words(p: str | None) -> int | None:
    return None if p is None else len(ASCII_WORD.findall(p))


def has_identifier(t: str | None, pattern: re.Pattern) -> bool | None:
    """pattern finds nothing without an underscore or a file's extension."""
    return None if t is None else ("_" in t or EXTENSION.search(t) is not None) and pattern.search(t) is not None


WORD_MEASURES = "n long, n_lower long, d3 double, d5 double, ttr double, sym double, spec double"


def of_words(t: str | None) -> dict:
    """Words as they are and in lower case, repeats of 3 and 5 of the latter in a row, the share of different ones, symbols and identifiers."""
    t = t or ""
    own = WORD.findall(t)
    w = [x.lower() for x in own] if t.isascii() else WORD.findall(t.lower())
    d3 = duplicate_ratio(w, 3)
    return {
        "n": len(own), "n_lower": len(w), "d3": d3, "d5": duplicate_ratio(w, 5) if d3 else 0.0, "ttr": len(set(w)) / len(w) if w else 0.0,
        "sym": _symbols(t, sum(map(len, own))) if t else 0.0, "spec": n_identifiers(t) / len(own) if own else 0.0,
    }


def content_tokens(t: str | None, pattern: re.Pattern, stop: frozenset[str], suffixes: tuple[str, ...]) -> list[str] | None:
    """The set of stems of the words that aren't stop words, sorted."""
    if t is None:
        return None
    found = set(pattern.findall(t.lower())) - stop
    return sorted({next((w[: -len(s)] for s in suffixes if w.endswith(s) and len(w) > len(s) + 3), w) if w.endswith(suffixes) else w for w in found})
