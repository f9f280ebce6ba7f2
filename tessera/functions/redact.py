"""Secret redaction by patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.measures import arrow_column

#: Shapes of provider keys.
SECRET_PATTERNS = (
    r"\bghp_[a-zA-Z0-9]{36,}\b",
    r"\bgithub_pat_[a-zA-Z0-9_]{82,}\b",
    r"\bsk-ant-sid01-[a-zA-Z0-9_-]{20,}\b",
    r"\bsk-ant-[a-zA-Z0-9_-]{20,}\b",
    r"\bsk-[a-zA-Z0-9_-]{48,}\b",
    r"\bsk-proj-[a-zA-Z0-9_-]{20,}\b",
    r"\b[a-zA-Z0-9_]{20,}:[a-zA-Z0-9_]{40,}\b",
    r"\bAKIA[A-Z0-9]{16}\b",
    r"\b[M-Q][a-zA-Z0-9_\-]{23}\.[a-zA-Z0-9_\-]{6}\.[a-zA-Z0-9_\-]{27}\b",
)
#: What the compatible switch looks for first.
PREFIXES = ("ghp_", "github_pat_", "sk-ant-", "sk-proj-", "sk-", "AKIA")
MARK, BOUND = "[REDACTED_SECRET]", r"\b"
#: The same patterns, whose letters are ASCII's in either case. Each begins with LEAST characters of a run, so it can match only where one begins that is as long.
SECRET = re.compile("|".join(rf"\b(?ai:{p.removeprefix(BOUND).removesuffix(BOUND)})\b" for p in SECRET_PATTERNS))
LEAST = 20
IN_RUN = bytes(ord("x") if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "_-") else ord(" ") for i in range(256))


def without_secrets(t: str | None) -> str | None:
    if t is None:
        return None
    runs, out, done, at = t.encode("ascii", "replace").translate(IN_RUN), [], 0, 0  # a byte a character
    long = b"x" * LEAST
    while (at := runs.find(long, at)) >= 0:
        if found := SECRET.match(t, at):
            out += [t[done:at], MARK]
            done = at = found.end()
        else:
            at += 1
    return "".join([*out, t[done:]]) if out else t


def checked_rules(spark: SparkSession, lines: Iterable[str]) -> tuple[list[str], dict[str, str]]:
    """(kept, refused with the reason) of rules given as lines; blank lines and # comments are neither. A rule is what the engine that runs it can compile."""
    kept, refused = [], {}
    for rule in dict.fromkeys(x.strip() for x in lines):
        if not rule or rule[0] == "#":
            continue
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(rule)
        except IllegalArgumentException as e:  # as which a PatternSyntaxException arrives
            refused[rule] = str(e).partition("\n")[0]
        else:
            kept.append(rule)
    return kept, refused


def redact(c: Column, rules: list[str] | None = None, only_with_prefix: bool = False) -> Column:
    """c with secrets replaced. only_with_prefix: texts without a provider's prefix stay as they are, unless there are rules."""
    done = arrow_column(StringType(), without_secrets)(c)
    for rule in rules or []:  # each by itself, so a rule's groups and flags are its own
        done = F.regexp_replace(done, f"(?i){rule}", F.lit(MARK))
    if not only_with_prefix or rules:
        return done
    has = c.contains(PREFIXES[0])
    for p in PREFIXES[1:]:
        has = has | c.contains(p)
    return F.when(has, done).otherwise(c)
