"""Full-text tokens: letters and digits, case and diacritics folded, Porter stems. An Arrow UDF: the stemmer is imperative."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Texts of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 64
RUN = re.compile(r"[^\W_]+")

#: The suffix rules of M. F. Porter, An algorithm for suffix stripping (1980), steps 2, 3 and 4.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log", bli="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(100_000)
def porter(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (cut := next((len(s) for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), 0)) and w[:-cut]:
        w = w[:-cut]
        if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short(w)):
            w += "e"
        elif w[-2:-1] == w[-1:] and w[-1] not in "lsz" and _shape(w)[-1] == "c":
            w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = max((s for s in table if w.endswith(s)), key=len, default="")
        if s and _measure(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    s = max((s for s in STEP4 if w.endswith(s)), key=len, default="")
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fts_tokens(text: str | None) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    return [porter(w) for w in RUN.findall(plain)]


@F.arrow_udf(ArrayType(StringType()))
def fts_tokens_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        # Only a slice's tokens are Python objects at a time; Arrow holds the batch's others.
        made = [pa.array([fts_tokens(t) for t in texts.slice(at, SLICE_ROWS).to_pylist()], pa.list_(pa.string())) for at in range(0, len(texts), SLICE_ROWS)]
        yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))
