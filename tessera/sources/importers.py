"""Importers of Markdown collections, session logs and catalog tables, as DataFrame expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Labels of log lines and the event types they stand for; other labels are attempts.
LABELS = {"DECISION": "decision", "ISSUE": "issue", "RESOLUTION": "fix", "FACT": "attempt", "STATUS": "attempt", "OPEN": "attempt", "IDEA": "attempt"}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sections(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, pos, title, content) of the ## and ### sections of each text; blank ones are left out."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n", "\n")), r"\n(?=###?\s)")
    each = files.select(F.col(id_col), F.posexplode(F.filter(parts, lambda p: p.rlike(r"^###?\s"))).alias("pos", "part"))
    return each.select(id_col, "pos", F.regexp_extract("part", r"^###?\s+([^\n]*)", 1).alias("title"), X.strip(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("content")).where("content <> ''")


def section_paths(files: DataFrame, id_col: str = "path", levels: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(id, pos, level, title, headers, content) of the sections of each text that aren't blank; headers: the open header of each level down to the section's own.

    The last header of each level is carried over the lines; a header ends those of deeper levels. Lines between ``` fences are content, whatever they begin with.
    """
    each = files.select(F.col(id_col), F.posexplode(F.split("text", r"\r\n|\n")).alias("line", "row"))
    so_far = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("row").startswith("```")
    each = each.withColumn("fenced", fence | (F.sum(fence.cast("int")).over(so_far) % 2 == 1))
    level = F.length(F.regexp_extract("row", r"^(#{1,6})\s+\S", 1))
    each = each.withColumn("level", F.when(~F.col("fenced") & level.isin(*levels), level).otherwise(0)).withColumn("name", X.strip(F.regexp_replace("row", r"^#+\s+", "")))
    each = each.withColumn("pos", F.sum((F.col("level") > 0).cast("int")).over(so_far))
    for n in levels:  # where the last header of each level stands, and what it says
        each = each.withColumn(f"h{n}", F.last(F.when(F.col("level") == n, F.struct("line", "name")), ignorenulls=True).over(so_far))
    open_, above = [], []
    for n in levels:
        ended = F.greatest(*[F.coalesce(F.col(f"h{m}.line"), F.lit(-1)) for m in above], F.lit(-1), F.lit(-1)) > F.col(f"h{n}.line")
        open_.append(F.when(~ended, F.col(f"h{n}.name")))
        above.append(n)
    each = each.withColumn("headers", F.array_compact(F.array(*open_)))
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line", "row")))), lambda x: x["row"])
    made = each.where("pos > 0").groupBy(id_col, "pos").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.col("name"))).alias("title"), F.max_by("headers", "level").alias("headers"), X.strip(F.array_join(rows, "\n")).alias("content"))
    return made.where("content <> ''")


def section_tags(rules: list[tuple[str, str, str, list[str]]], default: str = "general") -> Column:
    """The tags of a section by its headers: a label in brackets in its title, else the rule's default, with the rule's ending, and the rule's other tags.

    rules: (what one of the headers contains, default tag, ending, other tags), of which the first that fits counts.
    """
    label = F.nullif(F.regexp_extract(F.element_at("headers", -1), r"\[([\p{L}\p{N}_-]+)\]", 1), F.lit(""))
    tag = lambda name, ending: F.concat(F.lit("#"), F.coalesce(label, F.lit(name)), F.lit(ending if ending else ""))
    out = F.array(tag(default, ""))
    for contains, name, ending, more in reversed(rules):
        fits = F.contains(F.lower(F.array_join("headers", "\n")), F.lit(contains.lower()))
        out = F.when(fits, F.array(tag(name, ending), *[F.lit(f"#{m}") for m in more])).otherwise(out)
    return out


def log_events(files: DataFrame, id_col: str = "path", phrases: list[str] | None = None) -> DataFrame:
    """(id, line, type, content) of labelled lines ("- [DECISION] text"); those with one of the phrases are left out."""
    each = files.select(F.col(id_col), F.posexplode(F.split("text", r"\r\n|\n")).alias("line", "row"))
    pattern = rf"(?i)^\s*(?:[-*]\s+)?\[({'|'.join(LABELS)})\]\s*:?\s*(.+?)\s*$"
    found = each.select(id_col, "line", F.upper(F.regexp_extract("row", pattern, 1)).alias("label"), F.regexp_extract("row", pattern, 2).alias("content")).where("label <> ''")
    for p in phrases or []:
        found = found.where(~F.lower("content").contains(p.lower()))
    kind = F.lit("attempt")
    for label, name in LABELS.items():
        kind = F.when(F.col("label") == label, F.lit(name)).otherwise(kind)
    return found.select(id_col, "line", kind.alias("type"), "content")


def catalog_rows(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, file, date) of table rows whose first cell is a Markdown file and whose second an ISO date."""
    each = files.select(F.col(id_col), F.explode(F.split("text", r"\r\n|\n")).alias("row"))
    pattern = r"^\|\s*`?([^|`\s]+\.md)`?\s*\|\s*(\d{4}-\d{2}-\d{2})\s*\|"
    return each.select(id_col, F.regexp_extract("row", pattern, 1).alias("file"), F.regexp_extract("row", pattern, 2).alias("date")).where("file <> ''")
