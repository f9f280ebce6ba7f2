"""Text scalars, each a Column of JVM-side functions or, where patterns pass over whole texts again and again, of an Arrow UDF (measures.py). Words are runs of [\\p{L}\\p{N}_], the same in Java and RE2."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructType

from tessera.functions import measures
from tessera.functions.lexicon import BIGRAMS

_W = r"[\p{L}\p{N}_]"
WORD = _W + "+"
#: Between a character of a word and one that is none, or an end of the text. Java's own \b doesn't know letters outside ASCII in every version.
EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
#: What stands in a class for white space: all of Unicode's, with the four separators of ASCII.
SPACE = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: A run of it; most characters are told by the first, short test.
SPACES = f"(?![!-~])[{SPACE}]+"

#: Words that carry no content.
STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could did do does doing don't down during each few for from"
    " further had has have having he her here hers him his how i if in into is it its itself just me more most my myself no nor not of off on once only or other our ours out over own same she should so some such"
    " than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why with would you your yours yourself yourselves"
).split()

#: Suffixes in the order in which they are tried.
SUFFIXES = ("ing", "edly", "ed", "es", "s", "ly", "ment", "tion", "ness", "ity", "al")

#: Function words that make a pair of words plausible.
FUNCTION_WORDS = "the a an in on at for to of with by and or is are".split()

#: File extensions of paths in prose.
PATH_EXTENSIONS = "py|rs|js|ts|json|md|sql|yml|yaml|c|cpp|h|sh|db"
PATH = re.compile(rf"\b[\w/-]++\.(?:{PATH_EXTENSIONS})\b")

#: Acknowledgements that are no content.
FLUFF = r"(?i)^(?:ok|done|thanks|got it|i have|modified the file|sure|completed|consolidated these files|consolidated|consolidated notes|merged summary)[.!]?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: what a lambda reads from outside is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACES}|{SPACES}\z", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def word_set(c: Column) -> Column:
    """The set of words of three characters or more, sorted."""
    return measures.arrow_column(ArrayType(StringType()), measures.word_set)(c)


def stem(w: Column) -> Column:
    """The first suffix that leaves more than three letters is cut, once."""
    return F.coalesce(*[F.when(w.endswith(s) & (F.length(w) > len(s) + 3), w.substr(F.lit(1), F.length(w) - len(s))) for s in SUFFIXES], w)


def content_tokens(c: Column, pattern: str = r"\b[a-zA-Z0-9_-]{3,}\b") -> Column:
    """The set of stems of the words that aren't stop words, sorted. Hyphens count inside a word, not at its ends."""
    made = partial(measures.content_tokens, pattern=re.compile(pattern), stop=frozenset(STOP_WORDS), suffixes=SUFFIXES)
    return measures.arrow_column(ArrayType(StringType()), made)(c)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits a character, 0 for an empty text."""
    return measures.arrow_column(DoubleType(), measures.entropy)(c)


def ttr(c: Column) -> Column:
    return ttr_of(words(F.lower(c)))


def ttr_of(w: Column) -> Column:
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0))


def symbol_ratio(c: Column) -> Column:
    """Characters that are neither letters, digits nor white space, to letters and digits."""
    return measures.arrow_column(DoubleType(), measures.symbol_ratio)(c)


def specificity(c: Column) -> Column:
    """Identifiers with inner capitals, digits or dots, words in capitals and file names, to words."""
    return measures.arrow_column(DoubleType(), measures.specificity)(c)


def ngrams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def duplicate_ratio(c: Column, n: int) -> Column:
    """The share of word n-grams that repeat an earlier one."""
    return let(words(F.lower(c)), lambda w: duplicate_ratio_of(w, n))


def duplicate_ratio_of(w: Column, n: int) -> Column:
    total = F.size(w) - (n - 1)
    return F.when(total > 0, 1 - F.size(F.array_distinct(ngrams(w, n))) / total).otherwise(F.lit(0.0))


def prose(c: Column) -> Column:
    """The text without code, addresses and paths, in single blanks."""
    return measures.arrow_column(StringType(), partial(measures.prose, path=PATH))(c)


def word_measures(c: Column) -> Column:
    """n (words), n_lower (words in lower case), d3, d5 and ttr of these, sym and spec, as a struct: one pass for all."""
    return measures.arrow_column(StructType.fromDDL(measures.WORD_MEASURES), measures.of_words)(c)


def prose_measures(p: Column, lexicon: list[str] | None = BIGRAMS) -> Column:
    """n (ASCII words), cli and big, as a struct; the two are not rounded."""
    return measures.arrow_column(StructType.fromDDL(measures.PROSE_MEASURES), partial(measures.of_prose, **_plausible(lexicon)))(p)


def n_ascii_words(p: Column) -> Column:
    return measures.arrow_column(LongType(), measures.ascii_words)(p)


def has_identifier(c: Column, pattern: re.Pattern) -> Column:
    return measures.arrow_column(BooleanType(), partial(measures.has_identifier, pattern=pattern))(c)


def _plausible(lexicon: list[str] | None) -> dict[str, frozenset[str]]:
    return {"function_words": frozenset(FUNCTION_WORDS), "lexicon": frozenset(lexicon or [])}


ASCII_WORD = f"{EDGE}[a-zA-Z0-9_-]+{EDGE}"


def coleman_liau(p: Column) -> Column:
    return F.round(measures.arrow_column(DoubleType(), measures.coleman_liau)(p), 2)


def bigram_validity(p: Column, lexicon: list[str] | None = BIGRAMS) -> Column:
    """The share of plausible word pairs: in the lexicon ("a b"), or of longer words one of which is a function word."""
    return F.round(measures.arrow_column(DoubleType(), partial(measures.bigram_validity, **_plausible(lexicon)))(p), 3)


def content_hash(c: Column) -> Column:
    """SHA-256 of the stripped text in lower case; empty for none."""
    return F.when(F.length(c) > 0, F.sha2(F.lower(strip(c)), 256)).otherwise(F.lit(""))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r]"), strip), lambda x: x != "")


def title(c: Column) -> Column:
    """The first heading, else the first line cut to 60 characters."""
    all_lines = lines(c)
    first, head = F.get(all_lines, F.lit(0)), F.get(F.filter(all_lines, lambda x: x.startswith("#")), F.lit(0))
    heading = F.when(head.isNotNull(), strip(F.regexp_replace(head, "^#+", "")))
    cut = F.when(F.length(first) > 60, F.concat(F.substring(first, 1, 57), F.lit("..."))).otherwise(first)
    return F.coalesce(heading, cut, F.lit("Untitled"))


def snippet(c: Column) -> Column:
    """The first three lines that aren't headings, cut to 150 characters."""
    s = F.concat_ws(" ", F.slice(F.filter(lines(c), lambda x: ~x.startswith("#")), 1, 3))
    return F.when(F.length(s) > 150, F.concat(F.substring(s, 1, 147), F.lit("..."))).otherwise(F.coalesce(s, F.lit("")))


UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def uuid_in(c: Column) -> Column:
    found = F.regexp_extract(c, UUID, 0)
    return F.when(found != "", found)


def tag_key(c: Column) -> Column:
    """How tags are compared when written or searched for."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "^#+", ""), r"[-_\s]+", "")


def tag_merge_key(c: Column) -> Column:
    """How tags are compared when merged: inner blanks count."""
    return F.translate(strip(F.lower(c)), "-_#", "")


def tag_name(c: Column) -> Column:
    """A tag with its # in front."""
    return F.when(c.startswith("#"), c).otherwise(F.concat(F.lit("#"), c))


def normalize_query(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}_{SPACE}]", " "), f"[{SPACE}]+", " "))


def clip(c: Column, n: int = 22) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
