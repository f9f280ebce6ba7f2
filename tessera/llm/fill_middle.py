"""Fill-in-middle: a text is cut at two of its units, and its parts are put in another order between marks.

A streaming matcher reads a text twice: the first pass counts the units, the second advances a lazy iterator of matches
to the two ranks at which the text is cut. No list of units is held, so besides the text and its output a task needs
a few numbers, however many units there are.

The ranks and the form follow from a hash of a seed and the row's id alone. A text is left as it is (form plain) if it is empty, holds
one of the marks, or is not among the share that is transformed; so the output and its form give the text back.

Defined cases: a null text is the empty text; a null id counts as the word null in the hash; matches of no characters are no units;
what no unit matches stays with the part that it stands in; repeated rows come out alike; other columns pass through, and one
that bears an output's name is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tessera.llm.common import map_rows

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUTPUTS = [("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType())]


def unit_ends(unit: re.Pattern, text: str) -> Iterator[int]:
    """Where the units of the text end, one after the other."""
    return (m.end() for m in unit.finditer(text) if m.end() > m.start())


def cuts(unit: re.Pattern, text: str, ranks: tuple[int, int]) -> tuple[int, int]:
    """The places after as many units as each rank says; ranks ascend."""
    ends, done, at, out = unit_ends(unit, text), 0, 0, []
    for rank in ranks:
        for at in islice(ends, rank - done):  # noqa: B020  the last one stays
            pass
        done = rank
        out.append(at)
    return out[0], out[1]


def draws(seed: int, row_id: object) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'null' if row_id is None else row_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(unit: re.Pattern, text: str, row_id: object, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    n = sum(1 for _ in unit_ends(unit, text))
    h1, h2, h3, h4 = draws(seed, row_id)
    if not text or h3 % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = cuts(unit, text, tuple(sorted((h1 % (n + 1), h2 % (n + 1)))))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    prefix, suffix = (PREFIX, text[:a]), (SUFFIX, text[b:])
    parts = (*suffix, *prefix) if form == "spm" else (*prefix, *suffix)
    return n, form, a, b - a, "".join((*parts, MIDDLE, text[a:b]))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """Appends n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""

    def make():
        pattern = re.compile(unit)
        return lambda rows: [transformed(pattern, text or "", row_id, seed, percent, spm_percent) for row_id, text in rows]

    return map_rows(df, [id_col, text_col], OUTPUTS, make)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. Each mark occurs once: no mark begins within another."""
    first, second = F.when(form == "spm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    one = F.split_part(F.split_part(output, first, F.lit(2)), second, F.lit(1))
    two = F.split_part(F.split_part(output, second, F.lit(2)), F.lit(MIDDLE), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
