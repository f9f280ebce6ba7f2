"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every distinct shingle hash that lies below a fixed fraction of the range of hashes, so its size follows the
text's, the sketch of texts together is the union of theirs, and the share of a sketch that another holds estimates the share of the text that
the other contains, however unequal they are. A text none of whose hashes is below the threshold keeps its least one
instead, so that only a text without words has an empty sketch; when sketches are merged, such a one gives way to hashes below
the threshold. Sketches are thus the same however texts are merged.

A word's hash is XXH64 of its bytes; a shingle's mixes those of its words, a block of shingles at a time.

with_next pairs each row with the next one in the order of ids (ties: by text) and needs one shuffle of the rows: they are dealt by ranges of
ids whose starts are drawn from a bounded sample of ids, sorted, and read in order; the rows at a range's start are sent to the range before as well. The
sample decides where ranges begin, never what a row's neighbour is. Rows of one id stay together.

Defined cases: a null text is the empty text; texts of fewer words than a shingle are one shingle; texts without words are like each other (1) and unlike all others (0);
a row without an id comes before all others; a table of one row is its own next; repeated rows are neighbours; equal texts have equal sketches; an empty table gives no rows;
other columns pass through, and one that bears an output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.llm.common import SLICE_ROWS, fresh, map_rows

WORDS, SEED = 5, 42
#: The share of hashes that a sketch keeps.
FRACTION = 0.25
#: Shingles whose hashes are mixed at a time.
BLOCK = 1 << 16
#: Rows of a range, about; the most ranges; sampled ids for each range; rows of a task, which reads several ranges, so that tasks are even.
RANGE_ROWS, MOST_RANGES, PER_RANGE, TASK_ROWS = 1 << 10, 1 << 16, 16, 1 << 13

MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LEAST = -(1 << 63)


def threshold(fraction: float = FRACTION) -> int:
    """Hashes are signed; those below this are kept."""
    return LEAST + int(fraction * (1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, words: int = WORDS) -> Iterator[np.ndarray]:
    """Signed hashes of the word shingles, a block at a time. ASCII capitals count as small letters."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in found), np.uint64, len(found))
    n = max(1, len(each) - words + 1)
    width = min(words, len(each))
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        h = np.full(stop - at, width, np.uint64)
        for i in range(width):
            h = _mixed(h * MIX[0] + each[at + i : stop + i])
        yield h.view(np.int64)


def sketch(text: str | None, fraction: float = FRACTION, words: int = WORDS) -> np.ndarray:
    """The sketch of a text, in ascending order."""
    limit, kept, least = threshold(fraction), [], None
    for h in shingle_hashes(text or "", words):
        kept.append(np.unique(h[h < limit]))
        low = h.min()
        least = low if least is None else min(least, low)
    if least is None:
        return np.zeros(0, np.int64)
    return np.unique(np.concatenate(kept)) if least < limit else np.array([least], np.int64)


# On columns -------------------------------------------------------------------------------------------------------


def with_sketch(df: DataFrame, text_col: str = "text", out: str = "sketch", fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """Appends the sketch of the text, an ascending array of longs."""
    return map_rows(df, [text_col], [(out, ArrayType(LongType()))], lambda: lambda rows: [(sketch(t, fraction, words),) for (t,) in rows])


def containment(a: Column, b: Column) -> Column:
    """The share of sketch a that sketch b holds: an estimate of the share of a's text that b's contains."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the other holds."""
    return F.greatest(containment(a, b), containment(b, a))


def hex_digits(c: Column) -> Column:
    """A sketch as text: 16 digits a hash, in the order of hashes."""
    return F.array_join(F.transform(c, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merged(df: DataFrame, by: list[str], sketch_col: str = "sketch", fraction: float = FRACTION) -> DataFrame:
    """The sketches of groups of texts: distinct hashes are found by shuffling hashes, so no task holds the rows of a group; a group's own sketch, which is a row, is gathered last."""
    keys, limit = [F.col(f"`{c}`") for c in by], F.lit(threshold(fraction))
    each = df.select(*keys, F.explode_outer(sketch_col).alias("h"))
    low = each.where(F.col("h").isNull() | (F.col("h") >= limit)).groupBy(*by).agg(F.min("h").alias("h"))  # of texts without a hash below, the least
    all_ = each.where(F.col("h") < limit).distinct().unionByName(low)
    held = all_.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias("s"))
    return held.select(*by, F.when(F.get("s", F.lit(0)) < limit, F.filter("s", lambda h: h < limit)).otherwise(F.col("s")).alias(sketch_col))


# The next row -----------------------------------------------------------------------------------------------------


def edited_text(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_starts(df: DataFrame, id_col: str, rows: int) -> list[int]:
    """The ids, in ascending order, at which ranges of about RANGE_ROWS rows begin: of a bounded sample of the ids, for the plan alone."""
    ranges = min(MOST_RANGES, rows // RANGE_ROWS)
    if ranges < 2:
        return []
    share = max(1, rows // (ranges * PER_RANGE))
    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("i")).where("i is not null")
    sample = sorted(r["i"] for r in ids.where(F.pmod(F.xxhash64("i"), F.lit(share)) == 0).distinct().collect())
    return sample[PER_RANGE::PER_RANGE]


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """Appends edited (the text edited with the next row's), sketch, edited_sketch and next_sketch. Ids are integers."""
    longs = ArrayType(LongType())
    outputs = [("edited", StringType()), ("sketch", longs), ("edited_sketch", longs), ("next_sketch", longs)]
    new = {n for n, _ in outputs}
    columns = [f for f in df.schema.fields if f.name.lower() not in new]
    range_, tail, row_id, row_text, target = fresh(df, "range_number", "is_tail", "its_id", "its_text", "target")
    the_id = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LEAST))
    all_rows = df.agg(F.count(F.lit(1)).alias("n"), F.min(the_id).alias("least")).first()
    starts = np.array(range_starts(df, id_col, all_rows["n"]), np.int64)
    last = len(starts)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, ids.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("boolean")
    def begins(ids: pd.Series) -> pd.Series:
        return pd.Series(np.isin(ids.to_numpy(), starts))

    # All other columns travel as they are; the text, which orders ties, is read from among them.
    text_at = next((i for i, f in enumerate(columns) if f.name.lower() == text_col.lower()), len(columns))
    dealt = df.select(*[F.col(f"`{f.name}`") for f in columns], *([F.col(f"`{text_col}`").alias(row_text)] if text_at == len(columns) else []), the_id.alias(row_id))
    dealt = dealt.withColumn(range_, number(row_id))
    to = lambda r, t: F.struct(r.alias("r"), F.lit(t).alias("t"))
    ahead = F.when(begins(row_id), to(F.col(range_) - 1, 1))
    around = F.when(F.col(row_id) == all_rows["least"], to(F.lit(last), 1))
    dealt = dealt.withColumn(target, F.explode(F.array_compact(F.array(to(F.col(range_), 0), ahead, around))))
    dealt = dealt.withColumns({range_: F.col(f"{target}.r"), tail: F.col(f"{target}.t")}).drop(target)
    tasks = max(1, min(last + 1, all_rows["n"] // TASK_ROWS))
    sent = dealt.repartition(tasks, range_).sortWithinPartitions(range_, tail, row_id, F.col(f"`{dealt.columns[text_at]}`"))
    range_at, tail_at = sent.columns.index(range_), sent.columns.index(tail)
    schema = StructType([*columns, *[StructField(n, t) for n, t in outputs]])
    arrow, kept = to_arrow_schema(schema), len(columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_sketch = None, None  # the row whose next one hasn't come yet
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                if held is not None:
                    part = pa.concat_batches([held, part])
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                ranges, tails = part.column(range_at).to_pylist(), part.column(tail_at).to_pylist()
                done, made, open_ = [], [], None
                for i, text in enumerate(texts):
                    follows = open_ is not None and ranges[i] == ranges[open_]
                    if tails[i] and not follows:
                        continue  # another row of the id at which the range after begins
                    own = held_sketch if i == 0 and held is not None else sketch(text, fraction, words)
                    if follows:
                        edited = edited_text(texts[open_], text)
                        done.append(open_)
                        made.append((edited, open_sketch, sketch(edited, fraction, words), own))
                    open_, open_sketch = (None, None) if tails[i] else (i, own)
                held, held_sketch = (None, None) if open_ is None else (part.slice(open_, 1), open_sketch)
                if done:
                    rows = part.take(pa.array(done))
                    cols = [pa.array(c, type=arrow.field(kept + i).type) for i, c in enumerate(zip(*made, strict=True))]
                    yield pa.RecordBatch.from_arrays([*[rows.column(i).cast(arrow.field(i).type) for i in range(kept)], *cols], schema=arrow)

    return sent.mapInArrow(run, schema)
