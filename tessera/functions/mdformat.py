"""Markdown formatting: a state machine over lines, so a pandas UDF (Arrow batches), not a built-in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What tells the language of an untyped block, tried in this order.
PYTHON = re.compile(r"\b(?:def|import|from|class|elif|self|print)\b")
SQL = re.compile(r"\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE TABLE|FROM|WHERE)\b", re.I)
JSON = re.compile(r"\A\s*[{\[]")
JAVASCRIPT = re.compile(r"\b(?:function|const|let|var|console\.log|export|import)\b")


def language(code: str) -> str:
    if PYTHON.search(code):
        return "python"
    if SQL.search(code):
        return "sql"
    if JSON.match(code) and ('"' in code or ":" in code):
        return "json"
    return "javascript" if JAVASCRIPT.search(code) else ""


def format_markdown(text: str | None) -> str:
    """Unix line ends, no blanks at line ends, fences closed plainly and typed by their code, two line ends together at most; idempotent."""
    if not text:
        return ""
    rows = [r.rstrip() for r in text.replace("\r\n", "\n").splitlines()]
    out: list[str] = []
    at = 0
    while at < len(rows):
        if not rows[at].startswith("```"):
            out.append(rows[at])
            at += 1
            continue
        kind = rows[at][3:].strip()
        end = next((i for i in range(at + 1, len(rows)) if rows[i].startswith("```")), None)
        body = rows[at + 1 : end]
        if end is not None:
            out += [f"```{kind or language(chr(10).join(body))}", *body, "```"]
            at = end + 1
        else:  # an open fence stays open
            out += [f"```{kind}", *body]
            at = len(rows)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


@F.pandas_udf(StringType())
def format_markdown_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(format_markdown)
