"""What is compared across the components of a bucket."""

from __future__ import annotations

from tessera.llm import minhash


def test_only_rows_outside_the_largest_component_are_compared_with_all(spark):
    one = [(1, t, 10, 10, 100) for t in range(500)] + [(1, 900 + t, 10, 10, 200 + t) for t in range(3)]
    whole = [(2, t, 10, 10, 100) for t in range(500)]
    rows = spark.createDataFrame(one + whole, "b long, t long, n long, can long, root long")
    found = minhash.mixed_buckets(rows).collect()
    assert len(found) == 503 and {r["b"] for r in found} == {1}  # a bucket of one component is done
    assert {r["top"] for r in found} == {100}
    assert sorted(r["t"] for r in found if r["root"] != r["top"]) == [900, 901, 902]  # not 503 rows on either side
