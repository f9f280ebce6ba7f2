"""Full-text search: postings, BM25, prefix terms, AND with fallback to OR, query sanitising and explanation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.porter import fts_tokens, fts_tokens_udf

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

#: Words that a query loses, unless it has no others.
QUERY_STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with what my when i type did how does or which who whom this these those".split()

#: Weights of title, content and aliases: as documented, and as the positional weights worked out in effect.
DOCUMENTED_WEIGHTS = {"title": 10.0, "content": 1.0, "aliases": 5.0}
EFFECTIVE_WEIGHTS = {"title": 1.0, "content": 5.0, "aliases": 1.0}


def sanitize_query(query: str | None) -> str:
    """The query without operators; quotes go too if they don't pair."""
    q = query or ""
    if q.count('"') % 2:
        q = q.replace('"', " ")
    return " ".join(re.sub(r"[-+<>:/*\\?^$|#@`~!%&(){}\[\]]", " ", q).split())


def query_terms(query: str | None) -> list[str]:
    raw = sanitize_query(query).replace('"', " ").split()
    return [t for t in raw if t.lower() not in QUERY_STOP_WORDS] or raw


def plain_tokens(text: str | None) -> list[str]:
    """The words of a query as the plain index has them."""
    return [w.lower() for w in re.findall(r"\w+", text or "")]


def tokens_of(c: Column, stemmed: bool) -> Column:
    return fts_tokens_udf(F.coalesce(c, F.lit(""))) if stemmed else X.words(F.lower(F.coalesce(c, F.lit(""))))


def token_counts(docs: DataFrame, id_col: str, fields: dict[str, Column], stemmed: bool = False) -> DataFrame:
    """(id, len) of every row: its tokens in all fields, without a shuffle."""
    total = F.lit(0)
    for c in fields.values():
        total = total + F.size(tokens_of(c, stemmed))
    return docs.select(F.col(id_col).alias("id"), total.alias("len"))


def postings(docs: DataFrame, id_col: str, fields: dict[str, Column], stemmed: bool = False, starts: list[str] | None = None) -> DataFrame:
    """(id, field, term, tf): terms by field with their frequencies. stemmed: Porter stems without diacritics, else plain lower-case words.

    starts: only terms that begin with one of these, dropped before anything is exploded or shuffled.
    """
    parts = []
    for name, c in fields.items():
        tokens = tokens_of(c, stemmed)
        if starts is not None:
            tokens = F.filter(tokens, lambda t: reduce(lambda a, b: a | b, [t.startswith(s) for s in starts], F.lit(False)))
        parts.append(F.struct(F.lit(name).alias("field"), tokens.alias("tokens")))
    each = docs.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("f"))
    return each.select("id", F.col("f.field").alias("field"), F.explode("f.tokens").alias("term")).groupBy("id", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def matches(index: DataFrame, terms: list[list[str]], prefix: bool = True) -> DataFrame:
    """(id, field, q, tf, and len if index has it): how often each field of a row holds term q.

    A term is a list of tokens. Of one token: equal to it, or by prefix beginning with it. Of several: all of them in a row, the last one
    by prefix; index must have positions then. Positions are shifted by the token's place and intersected: a phrase begins where all of its tokens agree.
    """
    keep = ["id", "field", *(["len"] if "len" in index.columns else [])]

    def is_token(t: str, last: bool) -> Column:
        return F.col("term").startswith(t) if prefix and last else F.col("term") == t

    single = [F.when(is_token(t[0], True), F.lit(q)) for q, t in enumerate(terms) if len(t) == 1]
    out = None
    if single:
        out = index.select(*keep, "tf", F.explode(F.array_compact(F.array(*single))).alias("q")).groupBy(*keep, "q").agg(F.sum("tf").alias("tf"))
    places = [F.when(is_token(x, i + 1 == len(t)), F.struct(F.lit(q).alias("q"), F.lit(i).alias("i"))) for q, t in enumerate(terms) if len(t) > 1 for i, x in enumerate(t)]
    if places:
        each = index.select(*keep, "positions", F.explode(F.array_compact(F.array(*places))).alias("t")).select(*keep, "t.q", "t.i", F.explode("positions").alias("at"))
        starts = each.groupBy(*keep, "q", (F.col("at") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n"))
        whole = F.get(F.array(*[F.lit(len(t)) for t in terms]), F.col("q"))
        phrases = starts.where(F.col("n") == whole).groupBy(*keep, "q").agg(F.count(F.lit(1)).alias("tf"))
        out = phrases if out is None else out.unionByName(phrases)
    return index.limit(0).select(*keep, F.lit(0).alias("q"), F.lit(0).cast("long").alias("tf")) if out is None else out


def scored(found: DataFrame, weights: dict[str, float] | None = None, corpus: DataFrame | None = None, totals: tuple[int, int] | None = None) -> DataFrame:
    """(id, score, n_terms) by BM25 of matches: higher is better; n_terms says how many of the terms the row has.

    corpus: (id, len) of every indexed row, or, where found has the rows' len, totals: the number of rows and of their tokens.
    """
    weight = F.lit(1.0)
    for field, w in (weights or {}).items():
        weight = F.when(F.col("field") == field, F.lit(w)).otherwise(weight)
    keys = ["id", "q", *(["len"] if totals else [])]
    per = found.groupBy(*keys).agg(F.sum(F.col("tf") * weight).alias("f"))
    df = per.groupBy("q").agg(F.count(F.lit(1)).alias("df"))  # a row for each query term
    if totals:
        df = df.withColumns({"n_docs": F.lit(totals[0]), "avg_len": F.lit(totals[1] / max(1, totals[0]))})
    else:
        df = df.join(F.broadcast(corpus.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))))  # a single row
        per = per.join(corpus, "id")
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.select("q", "avg_len", F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF)).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return per.join(F.broadcast(idf), "q").groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n_terms"))


def bm25(index: DataFrame, corpus: DataFrame, terms: list[str], weights: dict[str, float] | None = None, prefix: bool = True) -> DataFrame:
    """(id, score, n_terms) of rows with some of the terms, of one token each.

    index: postings; corpus: (id, len), the tokens of every indexed row, also of those without a hit. Only postings
    that match a term are shuffled, by row.
    """
    return scored(matches(index, [[t] for t in terms], prefix), weights, corpus)


def lengths(index: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """(id, len) of every row of docs."""
    n = index.groupBy("id").agg(F.sum("tf").alias("len"))
    return docs.select(F.col(id_col).alias("id")).join(n, "id", "left").select("id", F.coalesce("len", F.lit(0)).alias("len"))


def match_and_or(hits: DataFrame, n_terms: int) -> DataFrame:
    """Rows with all terms; if there are none, rows with any."""
    full = hits.withColumn("all", F.col("n_terms") == n_terms)
    some = full.agg(F.max("all").alias("any_all"))
    return full.join(F.broadcast(some)).where(F.col("all") | ~F.col("any_all")).drop("all", "any_all")


def found_terms(index: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """(term, found): whether some row has the tokens of each term, in a row and the last one by prefix.

    Terms of one token are told in one pass over the postings, a flag for each: the vocabulary is neither shuffled nor broadcast.
    """
    spark, one = index.sparkSession, {t: x[0] for t, x in terms.items() if len(x) == 1}
    out = spark.createDataFrame([(t, False) for t, x in terms.items() if not x], "term string, found boolean")
    if one:
        flags = index.agg(*[F.coalesce(F.max(F.col("term").startswith(x)), F.lit(False)).alias(f"f{i}") for i, x in enumerate(one.values())])
        out = out.unionByName(flags.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"f{i}").alias("found")) for i, t in enumerate(one)]))))
    several = {t: x for t, x in terms.items() if len(x) > 1}
    if several:
        hit = matches(index, list(several.values())).select("q").distinct()  # a row for each term at most
        asked = spark.createDataFrame([(i, t) for i, t in enumerate(several)], "n int, term string")
        out = out.unionByName(asked.join(hit, F.col("n") == F.col("q"), "left").select("term", F.col("q").isNotNull().alias("found")))
    return out


def unknown_tags(known_tags: DataFrame, tags: list[str]) -> DataFrame:
    """(term, found) of the tags that aren't known, found being false."""
    want = known_tags.sparkSession.createDataFrame([(t,) for t in tags], "term string")
    have = known_tags.select(X.tag_key(F.col("name")).alias("k"))
    return want.join(have, X.tag_key(F.col("term")) == F.col("k"), "left_anti").select("term", F.lit(False).alias("found"))


def explain(index: DataFrame, query: str, known_tags: DataFrame | None = None, tags: list[str] | None = None, stemmed: bool = False) -> DataFrame:
    """(term, found) of the words of the cleaned query, and of unknown tags as (tag, false). stemmed: whether index is; words are then stemmed as the search does."""
    words = list(dict.fromkeys(sanitize_query(query).replace('"', " ").split()))
    out = found_terms(index, {w: fts_tokens(w) if stemmed else plain_tokens(w) for w in words})
    return out.unionByName(unknown_tags(known_tags, tags)) if known_tags is not None and tags else out
