"""The text-quality gate: a cascade of tests, the first that fails rejects; texts that pass all get a score."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.lexicon import BIGRAMS

FENCE = r"(?m)^```"
HEADER = r"(?m)^(#{1,6})\s+(.+)$"
LIST = r"(?m)^\s*[-*\d.]+\s+(.+)$"


def _all(c: Column, p: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(p), F.lit(group))


def structure(c: Column, n: Column | None = None) -> Column:
    """valid, headers, header_skip, untyped and msdi of a Markdown text. n: its words, if they are counted already. Texts without a mark aren't searched for what begins with it."""
    none = F.array().cast("array<string>")
    having = lambda mark, found: F.when(c.contains(mark), found).otherwise(none)
    rows = F.filter(having("|", X.lines(c)), lambda r: r.startswith("|") & r.endswith("|"))
    short = F.exists(rows, lambda r: F.length(r) - F.length(F.replace(r, F.lit("|"), F.lit(""))) < 3)
    levels = F.transform(having("#", _all(c, HEADER, 1)), F.length)
    skip = X.let(levels, lambda v: F.exists(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: F.coalesce(F.get(v, i) > F.get(v, i - 1) + 1, F.lit(False))))
    fences = having("```", _all(c, r"(?m)^```([\p{L}\p{N}_]*)", 1))
    untyped = F.size(F.filter(fences, lambda x, i: (i % 2 == 0) & (x == "")))
    count = lambda parts: F.size(X.words(F.array_join(parts, "\n")))
    inside = count(having("#", _all(c, HEADER, 2))) + count(_all(c, LIST, 1)) + count(having("```", _all(c, r"```[\s\S]*?```", 0)))
    n = F.size(X.words(c)) if n is None else n
    msdi = F.when(n > 0, F.round(inside / n, 3)).otherwise(F.lit(0.0))
    valid = (F.size(fences) % 2 == 0) & ~short
    return F.struct(valid.alias("valid"), F.size(levels).alias("headers"), skip.alias("header_skip"), untyped.alias("untyped"), msdi.alias("msdi"))


IDENTIFIERS = rf"{X.EDGE}[\p{{L}}\p{{N}}_/-]++\.(?:py|rs|js|ts|json|md|sql|yml|yaml|c|cpp|h|sh){X.EDGE}|{X.EDGE}[a-z0-9_]+_[a-z0-9_]+{X.EDGE}"
#: The same in Python.
HAS_IDENTIFIER = re.compile(IDENTIFIERS.replace(X.EDGE, r"\b").replace(r"\p{L}\p{N}_", r"\w"))


def gate(df: DataFrame, text_col: str, lexicon: list[str] | None = BIGRAMS) -> DataFrame:
    """Appends quality_status (ACCEPT, WARN or REJECT), quality_score and quality_flags.

    Each measure is a column of its own, so it is computed once though several tests read it. Their names begin with _; columns of df that do are renamed meanwhile.
    """
    aside = {c: f"{i}{c}" for i, c in enumerate(df.columns) if c.startswith("_")}
    if aside:
        back = {v: k for k, v in aside.items()}
        return gate(df.withColumnsRenamed(aside), aside.get(text_col, text_col), lexicon).withColumnsRenamed(back)
    t = F.col("_t")
    m = df.withColumn("_t", X.strip(F.coalesce(F.col(text_col), F.lit("")))).withColumns({"_w": X.word_measures(t), "_p": X.prose_measures(X.prose(t), lexicon)}).withColumn("_md", structure(t, F.col("_w.n")))
    m = m.withColumns({
        "_n": F.length(t), "_nw": F.col("_w.n_lower"), "_sym": F.col("_w.sym"), "_h": X.entropy(t), "_d3": F.col("_w.d3"), "_d5": F.col("_w.d5"), "_ttr": F.col("_w.ttr"),
        "_np": F.col("_p.n"), "_ident": X.has_identifier(t, HAS_IDENTIFIER), "_big": F.round("_p.big", 3), "_cli": F.round("_p.cli", 2), "_spec": F.col("_w.spec"),
    })
    c = F.col
    md = lambda k: F.col("_md")[k]
    big_text, wild = c("_n") > 8000, c("_h") > 5.3
    rejects = [
        (c("_n") < 20, 0.0, "SHORT_LENGTH"), (t.rlike(X.FLUFF), 0.0, "CONVERSATIONAL_FLUFF"), (c("_sym") > 0.35, 0.05, "HIGH_SYMBOL_RATIO"), (~md("valid"), 0.0, "BROKEN_MARKDOWN_SYNTAX"), (c("_h") < 2.5, 0.10, "LOW_ENTROPY"),
        ((c("_nw") >= 20) & (c("_d3") > 0.30), 0.10, "HIGH_3GRAM_REPETITION"), ((c("_nw") >= 20) & (c("_d5") > 0.20), 0.10, "HIGH_5GRAM_REPETITION"), ((c("_nw") > 30) & (c("_ttr") < 0.35), 0.15, "LOW_TTR"),
        ((c("_np") > 25) & (c("_big") < 0.15), 0.10, "WORD_SALAD_PERPLEXITY"), ((c("_np") > 30) & ((c("_cli") < 2) | (c("_cli") > 26)), 0.15, "EXTREME_READABILITY_BOUNDS"),
    ]
    first, score = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i, (test, s, _) in reversed(list(enumerate(rejects))):
        first, score = F.when(test, F.lit(i)).otherwise(first), F.when(test, F.lit(s)).otherwise(score)
    m = m.withColumn("_r", first)
    r = c("_r")
    early = [F.when(big_text & (r.isNull() | (r > 2)), F.lit("OVERSIZED_PAYLOAD")), F.when(wild & (r.isNull() | (r > 4)), F.lit("HIGH_ENTROPY"))]
    reason = F.element_at(F.array(*[F.lit(x) for *_, x in rejects]), F.coalesce(r, F.lit(0)) + 1)
    wall = (md("msdi") < 0.35) & (c("_nw") > 80) & (md("msdi") < 0.10)
    points = [
        (md("headers") > 0, 0.15, "HAS_HEADERS"), (t.contains("`"), 0.15, "HAS_CODE"), (t.rlike(r"(?m)^\s*[-*\d.]+\s+"), 0.10, "HAS_LIST"), (c("_ident"), 0.10, "HAS_PATHS_OR_IDENTIFIERS"),
        (md("msdi") >= 0.35, 0.15, "HIGH_MSDI"), (wall, -0.15, "MONOLITHIC_TEXT_WALL"), (md("untyped") > 0, -0.10, "UNANNOTATED_CODE_BLOCKS"), (md("header_skip"), -0.10, "NON_HIERARCHICAL_HEADERS"),
        ((c("_nw") > 25) & (c("_spec") < 0.02), -0.15, "LOW_SPECIFICITY"),
    ]
    total = F.lit(0.5)
    for test, s, _ in points:
        total = total + F.when(test, F.lit(s)).otherwise(F.lit(0.0))
    passed = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2)
    flags = [*early, F.when(r.isNotNull(), reason), *[F.when(r.isNull() & test, F.lit(f)) for test, _, f in points]]
    return m.withColumns({
        "quality_status": F.when(r.isNotNull(), "REJECT").when(big_text | wild, "WARN").otherwise("ACCEPT"),
        "quality_score": F.coalesce(score, passed), "quality_flags": F.array_compact(F.array(*flags)),
    }).select(*df.columns, "quality_status", "quality_score", "quality_flags")
