"""A stored full-text index with upkeep: postings with positions, lengths and totals, in segments.

A segment holds the postings of the rows that were added or changed together in order of terms, the first segment in folders by bucket of the terms' first two
characters, later ones, which are small, in one; and the list of these rows with their lengths; rows that went are listed without. Rows are gathered in chunks:
a posting tells for a term the rows of a chunk that have it, by their places there, and the term's positions in each, so there is no line for each row and
term, and which rows of a chunk are live is told once for all of its terms. A row counts as its last segment has it, so nothing
is rewritten when rows change: a posting is live where its row's last place is the posting's own. A search reads the
buckets of its terms alone, of all segments, and no text. Totals are kept with the commit that names the segments, so a
segment and its totals count together or not at all. compact() writes all live rows as one segment.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tessera.functions import measures
from tessera.functions import text as X
from tessera.functions.porter import fts_tokens
from tessera.operators import lexical
from tessera.session import spread
from tessera.sources.commits import Commits, delete

BUCKETS, MOST_SALTS = 128, 8
#: Rows of a chunk, and tokens of its texts from which it takes no more.
CHUNK, CHUNK_TOKENS = 1 << 12, 1 << 22
#: Token lists of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 64
#: The folders of a later segment's postings and of the lists of chunks' rows.
ALL, ROWS = -1, -2
#: Segments beside the first from which an update compacts.
MOST_SEGMENTS = 16
POST = StructType([StructField("at", IntegerType()), StructField("positions", ArrayType(IntegerType()))])
#: Of a chunk, which has its number c in the segment g that it came with: a term's postings, or (without term) its rows' ids and lengths.
PACKED = StructType([StructField("field", StringType()), StructField("term", StringType()), StructField("c", LongType()), StructField("posts", ArrayType(POST)), StructField("ids", ArrayType(StringType())), StructField("lens", ArrayType(LongType()))])
POSTINGS = StructType([*PACKED.fields, StructField("g", LongType()), StructField("s", LongType()), StructField("b", IntegerType())])
DOCS = StructType([StructField("id", StringType()), StructField("alive", BooleanType()), StructField("len", LongType()), StructField("g", LongType()), StructField("c", LongType()), StructField("o", IntegerType()), StructField("s", LongType())])
#: The live rows of a chunk by place: ids and lengths, null where none is live, and bits.
LIVE = "g long, c long, ids array<string>, lens array<long>, live array<long>"


PLACES = StructType([StructField("term", StringType()), StructField("positions", ArrayType(IntegerType()))])


@F.arrow_udf(ArrayType(PLACES))
def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each token of a list once, with its places in ascending order."""
    kind = to_arrow_type(ArrayType(PLACES))

    def one(tokens: list[str] | None) -> list[dict]:
        at: dict[str, list[int]] = {}
        for i, t in enumerate(tokens or []):
            at.setdefault(t, []).append(i)
        return [{"term": t, "positions": p} for t, p in at.items()]

    for lists in batches:
        made = [pa.array([one(x) for x in lists.slice(at, SLICE_ROWS).to_pylist()], kind) for at in range(0, len(lists), SLICE_ROWS)]
        yield pa.concat_arrays(made) if made else pa.array([], kind)


class Chunk:
    """Rows whose postings are gathered: ids, lengths, and of each field its tokens with their rows' places and positions."""

    def __init__(self, fields: list[str], number: int):
        self.fields, self.number, self.ids, self.lens = fields, number, [], []
        self.words, self.of, self.at, self.n = [[] for _ in fields], [[] for _ in fields], [[] for _ in fields], 0

    def full(self) -> bool:
        return len(self.ids) > CHUNK - SLICE_ROWS or self.n > CHUNK_TOKENS

    def add(self, ids: list[str | None], columns: list[pa.Array], cut: Callable[[str], list[str]] | None) -> None:
        """Rows of one id that follow each other count as one."""
        places = []
        for x in ids:
            if not self.ids or self.ids[-1] != x:
                self.ids.append(x)
                self.lens.append(0)
            places.append(len(self.ids) - 1)
        for k, column in enumerate(columns):
            if cut:
                lists = [cut(t) for t in column.to_pylist()]
                words, sizes = pa.array(chain.from_iterable(lists), pa.string()), np.array([len(x) for x in lists], np.int64)
            else:
                words, sizes = column.flatten().cast(pa.string()), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            self.words[k].append(words)
            self.of[k].append(np.repeat(np.array(places, np.int32), sizes))
            self.at[k].append((np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)).astype(np.int32))
            self.n += len(words)
            for place, size in zip(places, sizes.tolist(), strict=True):
                self.lens[place] += size if self.ids[place] is not None else 0

    def made(self) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(PACKED)

        def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)

        for field, words, of, at in zip(self.fields, self.words, self.of, self.at, strict=True):
            encoded = pa.concat_arrays(words).dictionary_encode()
            if not len(encoded):
                continue
            term, of, at = encoded.indices.to_numpy().astype(np.int64), np.concatenate(of), np.concatenate(at)
            if len(encoded.dictionary) < 1 << 20:
                # A position has 31 bits, a row's place 12.
                key = (term << 43) | (of.astype(np.int64) << 31) | at
                key.sort()
                term, of, at = key >> 43, (key >> 31) & (CHUNK - 1), key & ((1 << 31) - 1)
            else:
                order = np.lexsort((at, of, term))
                term, of, at = term[order], of[order], at[order]
            new = np.r_[True, (term[1:] != term[:-1]) | (of[1:] != of[:-1])]
            post = np.flatnonzero(new)
            line = np.flatnonzero(np.r_[True, term[post][1:] != term[post][:-1]])
            ints = lambda x: pa.array(x.astype(np.int32))
            places = pa.ListArray.from_arrays(ints(np.r_[post, len(at)]), ints(at))
            posts = pa.StructArray.from_arrays([ints(of[post]), places], ["at", "positions"])
            lists = pa.ListArray.from_arrays(ints(np.r_[line, len(post)]), posts)
            n = len(line)
            yield batch(n, field=pa.array([field] * n), term=encoded.dictionary.take(pa.array(term[post][line])), c=pa.array(np.full(n, self.number)), posts=lists)
        yield batch(1, c=pa.array([self.number]), ids=pa.array([self.ids], pa.list_(pa.string())), lens=pa.array([self.lens], pa.list_(pa.int64())))


def packed(fields: list[str], cut: Callable[[str], list[str]] | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, texts or lists of tokens by field), in order of id, as PACKED."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(fields, number)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, SLICE_ROWS)
                ids = some.column(0).to_pylist()
                if chunk.full():
                    same = next((i for i, x in enumerate(ids) if x != chunk.ids[-1]), len(ids))  # these belong to the last row yet
                    if same == 0:
                        yield from chunk.made()
                        number += 1
                        chunk = Chunk(fields, number)
                    else:
                        some, ids = some.slice(0, same), ids[:same]
                chunk.add(ids, some.columns[1:], cut)
                at += len(ids)
        if chunk.ids:
            yield from chunk.made()

    return run


def placed(rows: pa.Table) -> pa.Table:
    """LIVE of one chunk, from its live rows (g, c, o, id, len)."""
    o = rows["o"].to_numpy()
    at = np.full(int(o.max()) // 64 * 64 + 64, -1)
    at[o] = np.arange(len(o))
    here = pa.array(at, mask=at < 0)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    bits = pa.array(np.packbits(at >= 0, bitorder="little").view(np.int64))
    return pa.table({"g": rows["g"][:1], "c": rows["c"][:1], "ids": one(rows["id"].combine_chunks().take(here)), "lens": one(rows["len"].combine_chunks().take(here)), "live": one(bits)})


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


#: How texts and queries are cut into tokens: Porter stems, plain words, and the set of content words, which has no queries. Plain words are cut where a text's postings are gathered.
STEMMED = (lambda c: lexical.tokens_of(c, True), fts_tokens)
PLAIN = (lambda c: lexical.tokens_of(c, False), lexical.plain_tokens)
CONTENT = (X.content_tokens, None)


class TextIndex:
    """state: what gives the index's state where it is committed with something else; else the index has commits of its own."""

    def __init__(self, spark: SparkSession, root: str, tokens: tuple[Callable[[Column], Column], Callable[[str], list[str]] | None] = STEMMED, state: Callable[[], dict] | None = None):
        self.spark, self.root, (self.tokens, self.split) = spark, root, tokens
        self.commits = Commits(spark, f"{root}/commits")
        self.state = state or (lambda: self.commits.last()[1])

    # Upkeep
    def prepared(self, docs: DataFrame, fields: dict[str, Column], gone: DataFrame | None = None) -> dict:
        """The state after the rows of docs (id and what fields read) are in place of those of their ids and the ids of gone are out. It counts once it is committed."""
        state = self.state()
        segments = state.get("segments", [])
        at = max([time.time_ns(), *[n + 1 for n in segments]])  # no other writer's
        row = F.col("id").cast("string").alias("id")
        each = spread(docs, "id")
        if not docs.groupBy(row).agg(F.count(F.lit(1)).alias("c")).where("c > 1 and id is not null").isEmpty():  # rows of one id count as one
            each = docs.repartition(row)
        plain = self.split is lexical.plain_tokens
        texts = [(F.lower(F.coalesce(c, F.lit(""))) if plain else self.tokens(c)).alias(f"f{i}") for i, c in enumerate(fields.values())]
        # Postings are gathered where texts lie, so what moves has a row for each term of a chunk.
        each = each.select(row, *texts).sortWithinPartitions("id").mapInArrow(packed(list(fields), measures.WORD.findall if plain else None), PACKED).withColumn("g", F.lit(at))
        folder = F.lit(ALL) if segments else bucket(F.col("term"))
        each = each.withColumn("b", F.when(F.col("term").isNull(), F.lit(ROWS)).otherwise(folder))
        if not segments:
            # Dealt by bucket (large ones to several tasks) once; the write needs no second time.
            each = each.repartition("b", self._salt(docs))
        self._write_postings(each, at)
        listed = self._postings([at]).where(F.col("b") == ROWS).select("g", "c", F.posexplode(F.arrays_zip("ids", "lens")).alias("o", "x"))
        listed = listed.select(F.col("x.ids").alias("id"), F.lit(True).alias("alive"), F.col("x.lens").alias("len"), "g", "c", "o")
        rows = listed.where("id is not null").unionByName(listed.where("id is null").limit(1))
        if gone is not None:
            rows = rows.unionByName(gone.select(F.col("id").cast("string").alias("id")).distinct().join(rows.select("id"), "id", "left_anti").select("id", F.lit(False).alias("alive"), F.lit(0).cast("long").alias("len")), allowMissingColumns=True)
        rows.write.parquet(f"{self.root}/docs/s={at}")
        new = self._docs([at])
        count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
        added, lost = count(new.where("alive")), count(self.rows(state).join(new.select("id"), "id", "left_semi")) if segments else {"n": 0, "len": 0}
        after = {"segments": [*segments, at], "rows": state.get("rows", 0) + added["n"] - lost["n"], "len": state.get("len", 0) + added["len"] - lost["len"]}
        return self.compacted(after) if len(segments) > MOST_SEGMENTS else after

    def compacted(self, state: dict | None = None) -> dict:
        """The state with all live rows as one segment; a search reads the same before and after."""
        state = state or self.state()
        at, live = max([time.time_ns(), *[n + 1 for n in state["segments"]]]), self.rows(state)
        held = self._postings(state["segments"]).where(F.col("b") != ROWS).join(self._chunks(live).select("g", "c", "live"), ["g", "c"])
        is_live = lambda x: F.getbit(F.get("live", F.shiftright(x["at"], 6)), x["at"].bitwiseAND(63)) == 1
        held = held.select("field", "term", "c", F.filter("posts", is_live).alias("posts"), "g", bucket(F.col("term")).alias("b")).where(F.size("posts") > 0)
        self._write_postings(held.repartition("b", self._salt(self._postings(state["segments"]))), at)
        live.select("id", F.lit(True).alias("alive"), "len", "g", "c", "o").write.parquet(f"{self.root}/docs/s={at}")
        return {**state, "segments": [at]}

    def _commit(self, make: Callable[[], dict]) -> int:
        number, before = self.commits.last()
        after = make()
        if not self.commits.commit(number + 1, after):
            raise RuntimeError("another writer has changed the index meanwhile")
        for n in set(before.get("segments", [])) - set(after["segments"]):  # of what was compacted nothing is read any more
            for kind in ("postings", "docs"):
                delete(self.spark, f"{self.root}/{kind}/s={n}")
        return number + 1

    def update(self, docs: DataFrame, fields: dict[str, Column], gone: DataFrame | None = None) -> int:
        """The number of the commit."""
        return self._commit(lambda: self.prepared(docs, fields, gone))

    def compact(self) -> int:
        return self._commit(self.compacted)

    @staticmethod
    def _salt(df: DataFrame) -> Column:
        """By which a bucket's postings are dealt to several tasks, those of a chunk to one."""
        return F.pmod(F.xxhash64("g", "c"), F.lit(min(MOST_SALTS, max(1, df.rdd.getNumPartitions()))))

    def _write_postings(self, posts: DataFrame, at: int) -> None:
        posts.sortWithinPartitions("b", "term", "g", "c").write.partitionBy("b").parquet(f"{self.root}/postings/s={at}")

    # Reading
    def _postings(self, segments: list[int]) -> DataFrame:
        return self.spark.read.schema(POSTINGS).option("basePath", f"{self.root}/postings").parquet(*[f"{self.root}/postings/s={n}" for n in segments])

    def _docs(self, segments: list[int]) -> DataFrame:
        return self.spark.read.schema(DOCS).option("basePath", f"{self.root}/docs").parquet(*[f"{self.root}/docs/s={n}" for n in segments])

    def rows(self, state: dict | None = None) -> DataFrame:
        """(id, len, g, c, o) of the live rows, the last three their place: those of the first segment that no later one has, and the last state of the later ones' rows."""
        segments = (self.state() if state is None else state).get("segments", [])
        if not segments:
            return self.spark.createDataFrame([], DOCS).select("id", "len", "g", "c", "o")
        first = self._docs(segments[:1])
        if segments[1:]:
            later = self._docs(segments[1:]).groupBy("id").agg(F.max_by(F.struct("alive", "len", "g", "c", "o"), "s").alias("x")).select("id", "x.*")
            first = first.join(later.select("id"), "id", "left_anti").unionByName(later, allowMissingColumns=True)
        return first.where("alive").select("id", "len", "g", "c", "o")

    @staticmethod
    def _chunks(rows: DataFrame) -> DataFrame:
        """LIVE of each chunk that has a live row."""
        return rows.where("c is not null and id is not null").groupBy("g", "c").applyInArrow(placed, LIVE)

    def postings(self, starts: list[str] | None = None) -> DataFrame:
        """(id, field, term, positions, tf, len) of live rows; starts: only terms that begin with one of these, of whose buckets alone files are read."""
        state = self.state()
        segments = state.get("segments", [])
        found = self._postings(segments) if segments else self.spark.createDataFrame([], POSTINGS)
        if starts is not None:
            found = found.where(reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in starts], F.lit(False)))
            if starts and min(map(len, starts)) >= 2:
                wanted = self.spark.range(1).select(*[bucket(F.lit(t)).alias(f"b{i}") for i, t in enumerate(starts)]).first()
                found = found.where(F.col("b").isin(sorted({ALL, *wanted})))
        found = found.where(F.col("b") != ROWS).select("g", "c", "field", "term", "posts").join(self._chunks(self.rows(state)), ["g", "c"])
        each = found.select("field", "term", "ids", "lens", F.inline("posts")).select(F.get("ids", "at").alias("id"), "field", "term", "positions", F.size("positions").cast("long").alias("tf"), F.get("lens", "at").alias("len"))
        return each.where("id is not null")

    def terms_of(self, query: str | None) -> list[list[str]]:
        """The tokens of each term of a query; a term of several is a phrase."""
        return [t for t in map(self.split, lexical.query_terms(query)) if t]

    def search(self, query: str | None, weights: dict[str, float] | None = lexical.DOCUMENTED_WEIGHTS) -> tuple[DataFrame, int]:
        """((id, score, n_terms), number of terms) of rows with some term of the query, each by prefix, phrases in a row."""
        terms = self.terms_of(query)
        found = lexical.matches(self.postings([t for term in terms for t in term]), terms)
        state = self.state()
        return lexical.scored(found, weights, totals=(state.get("rows", 0), state.get("len", 0))), len(terms)

    def explain(self, query: str | None) -> DataFrame:
        """(term, found) of the words of the cleaned query."""
        words = list(dict.fromkeys(lexical.sanitize_query(query).replace('"', " ").split()))
        return lexical.found_terms(self.postings([t for w in words for t in self.split(w)]), {w: self.split(w) for w in words})

    def overlaps(self, new: DataFrame, least: float) -> DataFrame:
        """(a, b, similarity) of new rows (id, tokens: a set) and indexed rows whose sets have Jaccard similarity of at least least. Of a CONTENT index.

        Shared tokens are counted where they are joined; both sets' sizes are known, so no text is read. The join is by bucket too, by which files are pruned.
        """
        state = self.state()
        segments = state.get("segments", [])
        held = (self._postings(segments) if segments else self.spark.createDataFrame([], POSTINGS)).where(F.col("b") != ROWS).drop("ids", "lens")
        asked = new.select(F.col("id").alias("a"), F.size("tokens").alias("n"), F.explode("tokens").alias("term")).withColumn("b", bucket(F.col("term")))
        met = held.where(F.col("b") != ALL).join(asked, ["b", "term"]).unionByName(held.where(F.col("b") == ALL).drop("b").join(asked, "term"))
        met = met.select("a", "n", "g", "c", F.inline("posts")).withColumnRenamed("at", "o").join(self.rows(state), ["g", "c", "o"]).groupBy("a", "id").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("len").alias("len"))
        return met.select("a", F.col("id").alias("b"), (F.col("c") / (F.col("n") + F.col("len") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= least)
