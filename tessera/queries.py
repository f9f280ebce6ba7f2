"""Every query by name, with equivalent DuckDB SQL where SQL can express it. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import lens
from tessera.functions import quality
from tessera.functions import text as X
from tessera.functions.embed import backfill, hashing_embedder
from tessera.functions.lexicon import BIGRAMS
from tessera.functions.mdformat import format_markdown_udf
from tessera.functions.redact import MARK, SECRET_PATTERNS, redact
from tessera.operators import dedup, events, graph, hybrid, lexical, report, scd, vector
from tessera.operators import tags as tagging
from tessera.plans import consolidation, librarian
from tessera.plans import store as storing
from tessera.schema import TABLES, migrate
from tessera.session import scratch, spread
from tessera.sources import importers, index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2024-03-01 00:00:00"
TERMS = ["attion", "hable"]

# What the SQL below shares: the same mapping as in lens.
ENT = """ent as (select cast(doc_id as varchar) id, doc_id, text full_content, source owner_id, lang context_id, case when doc_id % 5 = 0 then 'private' else 'shared' end scope, doc_id % 50 = 0 is_core,
 cast(1 + doc_id % 5 as integer) weight, case when doc_id % 10 = 9 then 'archived' when doc_id % 10 = 8 then 'consolidated' else 'raw' end status,
 timestamp '2024-01-01' + to_minutes(doc_id) created_at, timestamp '2024-01-01' + to_minutes((doc_id * 7) % 1000) updated_at, 'doc ' || doc_id title,
 case when doc_id % 10 = 9 then 'archived' when doc_id in (select vec_id from embeddings) then 'ready' else 'pending' end embedding_status from documents)"""
REL = """rel as (select doc_id || '>derived_from>' || doc_id // 2 id, cast(doc_id as varchar) source_id, cast(doc_id // 2 as varchar) target_id, 'derived_from' predicate, timestamp '2024-01-01' + to_minutes(doc_id) created_at,
 case when doc_id % 11 = 0 then timestamp '2024-01-02' end valid_to from documents where doc_id >= 1 and doc_id % 7 <> 0
 union all select doc_id || '>links_to>' || t, cast(doc_id as varchar), cast(t as varchar), 'links_to', timestamp '2024-01-01' + to_minutes(doc_id), null
 from (select doc_id, (doc_id * 7 + 3) % (select count(*) from documents) t from documents where doc_id % 30 = 0) where doc_id <> t)"""
TAG = """tag as (select name id, name, case when name in ('#Src_0', '#src-0') then 2 else 1 end made from (select '#' || lang as name from documents union select '#' || source from documents union values ('#toxic'), ('#lowq'), ('#Src_0'), ('#src-0'))),
 et as (select cast(doc_id as varchar) entity_id, '#' || lang tag_id from documents union select cast(doc_id as varchar), '#' || source from documents union select cast(doc_id as varchar), '#toxic' from labels where toxic = 1
 union select cast(doc_id as varchar), '#lowq' from labels where quality = 0 union select cast(doc_id as varchar), '#Src_0' from documents where doc_id % 40 = 0 union select cast(doc_id as varchar), '#src-0' from documents where doc_id % 40 = 1)"""
W = r"[\p{L}\p{N}_]+"
NOW_SQL = f"timestamp '{AS_OF}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit(AS_OF).cast("timestamp")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# Full text ------------------------------------------------------------------------------------------------------


def _index(s, d, starts=None):
    docs, fields = _texts(s, d), {"content": F.col("text")}
    return lexical.postings(docs, "doc_id", fields, starts=starts), lexical.token_counts(docs, "doc_id", fields)


def _hits(s, d, terms=None, prefix=False):
    posts, n = _index(s, d, terms or TERMS)
    return lexical.bm25(posts, n, terms or TERMS, prefix=prefix)


def _bm25_sql(terms: list[str], prefix: bool = False, cond: str = "true") -> str:
    match = " or ".join(f"starts_with(term, '{t}')" if prefix else f"term = '{t}'" for t in terms)
    which = "case " + " ".join(f"when {f'starts_with(term, {chr(39)}{t}{chr(39)})' if prefix else f'term = {chr(39)}{t}{chr(39)}'} then {i}" for i, t in enumerate(terms)) + " end"
    return f"""tok as (select doc_id id, unnest(regexp_extract_all(lower(text), '{W}')) term from documents), dl as (select d.doc_id id, coalesce(n, 0) len from documents d left join (select id, count(*) n from tok group by 1) t on t.id = d.doc_id),
 st as (select count(*) nd, avg(len) av from dl), per as (select id, {which} q, count(*) f from tok where {match} group by 1, 2), dfs as (select q, count(*) df from per group by 1),
 idf as (select q, case when ln((nd - df + 0.5) / (df + 0.5)) > 0 then ln((nd - df + 0.5) / (df + 0.5)) else 1e-6 end idf, av from dfs, st),
 hits as (select id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))) score, count(*) n_terms from per join idf using (q) join dl using (id) group by 1)"""


@query(f"with {_bm25_sql(TERMS)} select id, round(score, 6) score from hits where n_terms = 2")
def bm25_and(s, d):
    return _hits(s, d).where("n_terms = 2").select("id", F.round("score", 6).alias("score"))


@query(f"with {_bm25_sql(TERMS)} select id, round(score, 6) score from hits")
def bm25_or(s, d):
    return _hits(s, d).select("id", F.round("score", 6).alias("score"))


@query(f"with {_bm25_sql(TERMS)} select id, round(score, 6) score from hits order by score desc, id limit 10")
def bm25_topk(s, d):
    return _hits(s, d).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"with {_bm25_sql(['attion', 'zzzz'])} select id, round(score, 6) score from hits where n_terms = 2 or not exists (select 1 from hits where n_terms = 2)")
def bm25_fallback(s, d):
    return lexical.match_and_or(_hits(s, d, ["attion", "zzzz"]), 2).select("id", F.round("score", 6).alias("score"))


@query(f"with {_bm25_sql(['atti', 'schei'], True)} select id, round(score, 6) score from hits")
def bm25_prefix(s, d):
    return _hits(s, d, ["atti", "schei"], prefix=True).select("id", F.round("score", 6).alias("score"))


@query(f"""with {ENT}, {REL}, {_bm25_sql(TERMS)}, deg as (select target_id id, count(*) degree from rel where timestamp '2024-01-01' <= {NOW_SQL} and (valid_to is null or valid_to > {NOW_SQL}) group by 1)
 select e.id, round(-score * weight - 0.1 * coalesce(degree, 0), 6) as ordering from hits join ent e on e.doc_id = hits.id left join deg on deg.id = e.id where status <> 'archived' order by 2, updated_at desc, e.id limit 20""")
def bm25_weighted_rank(s, d):
    ent = lens.entities(s, d).where(hybrid.active())
    hits = _hits(s, d).withColumn("id", F.col("id").cast("string"))
    out = hybrid.lexical_order(hits, ent, hybrid.in_degree(lens.relations(s, d), _now()))
    return out.withColumn("ordering", F.round("ordering", 6)).orderBy("ordering", F.desc("updated_at"), "id").limit(20).select("id", "ordering")


@query()
def fts_porter(s, d):
    """Stemmed search over title and content with documented weights; the stemmer is a UDF."""
    ent = lens.entities(s, d).where(hybrid.active())
    posts = lexical.postings(ent, "id", {"title": F.col("title"), "content": F.col("full_content")}, stemmed=True)
    from tessera.functions.porter import porter

    return lexical.bm25(posts, lexical.lengths(posts, ent, "id"), [porter(t) for t in lexical.query_terms("the nations and rethings")], lexical.DOCUMENTED_WEIGHTS).select("id", F.round("score", 6).alias("score"))


@query(f"""with tok as (select distinct unnest(regexp_extract_all(lower(text), '{W}')) term from documents), q as (select unnest(['the', 'attion', 'hable', 'zzzz']) term)
 select term, exists (select 1 from tok where starts_with(tok.term, q.term)) found from q""")
def search_explain(s, d):
    return lexical.explain(_index(s, d)[0], "the attion + (hable) zzzz*")


def _kept_index(s, d) -> index.TextIndex:
    """An index of the documents as upkeep leaves it: all texts as they were first stored, then most of them as they are now, some archived, some changed again, in several segments."""
    docs = s.read.parquet(f"{d}/documents.parquet").withColumn("id", F.col("doc_id").cast("string"))
    out = index.TextIndex(s, scratch(s, "text-index"), index.PLAIN)
    fields = {"title": F.col("lang"), "content": F.col("text")}
    out.update(docs, {"title": F.col("lang"), "content": F.concat_ws(" ", F.lit("draft of"), "source", "text")})
    out.update(docs.where("lang <> 'en'"), fields, gone=docs.where("lang = 'en' and source = 'src1'").select("id"))
    out.compact()
    out.update(docs.where("lang = 'en' and source <> 'src1'"), fields, gone=docs.where("lang = 'fr'").select("id"))
    return out


KEPT_SQL = f"""live as (select * from documents where lang <> 'fr' and not (lang = 'en' and source = 'src1')),
 arr as (select doc_id id, 'title' field, regexp_extract_all(lower(lang), '{W}') w from live union all select doc_id, 'content', regexp_extract_all(lower(text), '{W}') from live),
 tok as (select id, field, unnest(w) term, generate_subscripts(w, 1) p from arr)"""


@query(f"with {KEPT_SQL} select term, field, count(distinct id) n_rows, count(*) n, sum(p - 1)::bigint places from tok group by 1, 2")
def index_upkeep(s, d):
    """All that the index holds after upkeep, by term and field, against the texts read anew."""
    posts = _kept_index(s, d).postings()
    return posts.groupBy("term", "field").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tf").alias("n"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)).alias("places"))


PHRASE = ["the", "an"]


def _stored_bm25_sql(terms: str) -> str:
    """BM25 over all fields with the documented weights; terms: (id, field, q, tf)."""
    return f"""{KEPT_SQL}, dl as (select id, sum(len(w)) len from arr group by 1), st as (select count(*) nd, avg(len) av from dl), m as ({terms}), per as (select id, q, sum(tf * case field when 'title' then 10.0 else 1.0 end) f from m group by 1, 2),
 dfs as (select q, count(*) df from per group by 1), idf as (select q, case when (nd - df + 0.5) / (df + 0.5) > 1 then ln((nd - df + 0.5) / (df + 0.5)) else 1e-6 end idf, av from dfs, st)
 select id::varchar id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))), 6) score, count(*) n_terms from per join idf using (q) join dl using (id) group by 1"""


@query("with " + _stored_bm25_sql("select id, field, case when starts_with(term, 'attion') then 0 else 1 end q, count(*) tf from tok where starts_with(term, 'attion') or starts_with(term, 'hable') group by all"))
def index_search(s, d):
    """A search of the stored index reads the buckets of its terms alone."""
    return _kept_index(s, d).search("attion hable")[0].withColumn("score", F.round("score", 6))


@query("with " + _stored_bm25_sql(f"select a.id, a.field, 0 q, count(distinct a.p) tf from tok a join tok b on a.id = b.id and a.field = b.field and b.p = a.p + 1 where a.term = '{PHRASE[0]}' and starts_with(b.term, '{PHRASE[1]}') group by all"))
def phrase_prefix(s, d):
    """A query term of several tokens is a phrase whose last token is a prefix."""
    return _kept_index(s, d).search(".".join(PHRASE))[0].withColumn("score", F.round("score", 6))


# Vectors and fusion ---------------------------------------------------------------------------------------------

Q0 = "(select embedding from embeddings where vec_id = 0)"
COS = "1 - list_dot_product(cast(e.embedding as double[]), cast(q.embedding as double[])) / (sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[]))) * sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))))"


def _query_vector(s, d):
    row = lens.vectors(s, d).where("id = 0").select("embedding").first()
    return list(row[0])


@query(f"select e.vec_id id, round({COS}, 6) + 0 distance from embeddings e, {Q0} q order by {COS}, e.vec_id limit 10")
def knn_topk(s, d):
    return vector.knn(lens.vectors(s, d), _query_vector(s, d), 10).select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"select e.vec_id id, round({COS}, 6) + 0 distance from embeddings e, {Q0} q where e.label = 3 order by {COS}, e.vec_id limit 10")
def knn_filtered(s, d):
    return vector.knn(lens.vectors(s, d).where("label = 3"), _query_vector(s, d), 10).select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"select e.vec_id a, q.vec_id b, round({COS}, 6) + 0 distance from embeddings e join embeddings q on e.vec_id < q.vec_id where {COS} <= 0.6")
def knn_pairs(s, d):
    v = lens.vectors(s, d)
    return vector.pairs_among(v, 0.6).select("a", "b", (F.round("distance", 6) + 0.0).alias("distance"))


NEAR_SQL = f"""near as (select a.id, list_sort(list(b.id)) n from (select ent.id, embedding from ent join embeddings on vec_id = doc_id where status = 'raw') a, (select ent.id, embedding from ent join embeddings on vec_id = doc_id where status = 'raw') b
 where a.id = b.id or {COS.replace("e.embedding", "a.embedding").replace("q.embedding", "b.embedding")} <= 0.6 group by 1)"""


@query(f"""with recursive {ENT}, {NEAR_SQL}, o as materialized (select id, n, row_number() over (order by id) i from near),
 r as (select 0::bigint i, []::varchar[] taken, null::varchar seed union all select o.i, case when len(o.n) >= 3 and not list_contains(taken, o.id) then list_concat(taken, o.n) else taken end,
 case when len(o.n) >= 3 and not list_contains(taken, o.id) then o.id end from r join o on o.i = r.i + 1) select seed, n members from r join o on o.id = r.seed""")
def vector_clusters(s, d):
    ent = lens.entities(s, d)
    emb = lens.vectors(s, d).select(F.col("id").cast("string").alias("entity_id"), "embedding")
    return librarian.vector_clusters(ent, emb, 0.6)


@query(f"""with {ENT} select o.id, list_sort(list(n.id)) members from ent o join embeddings q on q.vec_id = o.doc_id join ent n on n.created_at > o.created_at join embeddings e on e.vec_id = n.doc_id
 where o.status = 'consolidated' and n.status = 'raw' and {COS} <= 0.7 group by 1 having count(*) >= 3""")
def supersession_scout(s, d):
    ent = lens.entities(s, d).withColumn("valid_from", F.lit(None).cast("timestamp"))
    emb = lens.vectors(s, d).select(F.col("id").cast("string").alias("entity_id"), "embedding")
    return librarian.superseding(ent, emb, 0.7)


def _lists(s, d):
    lex = hybrid.ranked(_hits(s, d).select("id", F.round("score", 6).alias("score")), [F.desc("score"), F.col("id")], 20)
    return lex, hybrid.ranked(vector.knn(lens.vectors(s, d), _query_vector(s, d), 20), [F.col("distance"), F.col("id")], 20)


FUSED = f"""{_bm25_sql(TERMS)}, l as (select id, row_number() over (order by round(score, 6) desc, id) r from hits qualify r <= 20), v as (select e.vec_id id, row_number() over (order by {COS}, e.vec_id) r from embeddings e, {Q0} q qualify r <= 20),
 fused as (select id, coalesce(1 / (60 + l.r), 0) + coalesce(1 / (60 + v.r), 0) rrf, l.r lr, v.r vr from l full join v using (id) order by rrf desc, lr nulls last, vr nulls last, id limit 10)"""


@query(f"with {FUSED} select id, round(rrf, 9) rrf from fused")
def rrf_fusion(s, d):
    return hybrid.fuse(*_lists(s, d), 10).select("id", F.round("rrf", 9).alias("rrf"))


@query(f"with {ENT}, {FUSED} select e.id, round(rrf, 9) score, weight, is_core from fused join ent e on e.doc_id = fused.id where status <> 'archived'")
def hybrid_search(s, d):
    top = hybrid.fuse(*_lists(s, d), 10).select(F.col("id").cast("string").alias("id"), "rrf")
    return lens.entities(s, d).where(hybrid.active()).join(F.broadcast(top), "id").select("id", F.round("rrf", 9).alias("score"), "weight", "is_core")  # ten rows


@query(f"""with {ENT}, {REL}, ends as (select source_id id, target_id other, predicate, id edge from rel union all select target_id, source_id, predicate, id from rel),
 hit as (select id from ent where owner_id = 'src0'), near as (select ends.*, row_number() over (partition by ends.id order by edge, other) nth from ends join hit using (id) join ent o on o.id = other where o.status <> 'archived' and other not in (select id from hit))
 select id, string_agg(other, ',' order by nth) related from near where nth <= 5 group by 1""")
def neighbours_top5(s, d):
    ent = lens.entities(s, d)
    out = hybrid.neighbours(ent.where("owner_id = 'src0'").select("id"), lens.relations(s, d), ent)
    return out.select("id", F.array_join(F.col("related.id"), ",").alias("related"))


# Scalars and quality --------------------------------------------------------------------------------------------


def _docs(s, d):
    return lens.read(s, d, "documents")


def _texts(s, d):
    """doc_id and text, for measures that work on every character."""
    return spread(_docs(s, d).select("doc_id", "text"), "doc_id")


@query("select doc_id, round(-sum(n / t * log2(n / t)), 6) entropy from (select doc_id, ch, count(*)::double n, sum(count(*)) over (partition by doc_id)::double t from (select doc_id, unnest(string_split(text, '')) ch from documents) group by 1, 2) group by 1")
def entropy(s, d):
    return _texts(s, d).select("doc_id", F.round(X.entropy(F.col("text")), 6).alias("entropy"))


@query(f"select doc_id, round(case when len(w) > 0 then len(list_distinct(w)) / len(w) else 0 end, 6) ttr from (select doc_id, regexp_extract_all(lower(text), '{W}') w from documents)")
def ttr(s, d):
    return _texts(s, d).select("doc_id", F.round(X.ttr(F.col("text")), 6).alias("ttr"))


def _ngram_sql(n: int) -> str:
    grams = f"list_transform(range(1, len(w) - {n - 2}), lambda i: list_aggregate(w[i:i + {n - 1}], 'string_agg', ' '))"
    return f"select doc_id, round(case when len(w) >= {n} then 1 - len(list_distinct({grams})) / (len(w) - {n - 1}) else 0 end, 6) ratio from (select doc_id, regexp_extract_all(lower(text), '{W}') w from documents)"


@query(_ngram_sql(3))
def ngram3_dup(s, d):
    return _texts(s, d).select("doc_id", F.round(X.duplicate_ratio(F.col("text"), 3), 6).alias("ratio"))


@query(_ngram_sql(5))
def ngram5_dup(s, d):
    return _texts(s, d).select("doc_id", F.round(X.duplicate_ratio(F.col("text"), 5), 6).alias("ratio"))


SYM = r"case when length(regexp_replace({c}, '[^\p{{L}}\p{{N}}]', '', 'g')) > 0 then length(regexp_replace({c}, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(regexp_replace({c}, '[^\p{{L}}\p{{N}}]', '', 'g')) when length({c}) > 0 then 1 else 0 end"


@query(f"select doc_id, round({SYM.format(c='text')}, 6) ratio from documents")
def symbol_ratio(s, d):
    return _texts(s, d).select("doc_id", F.round(X.symbol_ratio(F.col("text")), 6).alias("ratio"))


# RE2 has no look-around and its \b knows ASCII only. So words get marks at their ends before paths are cut out, and for ASCII words a letter outside ASCII
# becomes Z, which is a letter but in no class below.
BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PROSE = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```[\s\S]*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g'), 'https?://[^{BLANK[1:-1]}]+', ' ', 'g'),
 '({W})', chr(1) || '\1' || chr(2) || chr(3), 'g'), '[\x01\x03][\p{{L}}\p{{N}}_/\x01\x02\x03-]+\.\x01(?:{X.PATH_EXTENSIONS})\x02', ' ', 'g'), '[\x01-\x03]', '', 'g'), '{BLANK}+', ' ', 'g'))"""


def _ascii_words_sql(c: str, least: str = "+") -> str:
    """The words of ASCII letters, digits, underscores and inner hyphens of c, in lower case."""
    small = f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all(regexp_replace(regexp_replace({small}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', 'Z', 'g'), '\b[a-z0-9_-]{least}\b')"


CLI = """round(case when len(w) > 0 then 0.0588::double * (length(array_to_string(w, '')) / len(w) * 100) - 0.296::double * (greatest(1, len(list_filter(regexp_split_to_array(p, '[.!?]+'), lambda x: trim(x) <> ''))) / len(w) * 100) - 15.8::double else 0 end, 2)"""


@query(f"select doc_id, {CLI} cli from (select doc_id, p, {_ascii_words_sql('p')} w from (select doc_id, {PROSE} p from documents))")
def readability(s, d):
    return _texts(s, d).select("doc_id", X.prose(F.col("text")).alias("p")).select("doc_id", X.coleman_liau(F.col("p")).alias("cli"))


FW = "['the','a','an','in','on','at','for','to','of','with','by','and','or','is','are']"
LEX = "[" + ",".join(f"'{x}'" for x in BIGRAMS) + "]"
BIG = f"round(case when len(w) > 1 then len(list_filter(range(1, len(w)), lambda i: length(w[i]) > 2 and length(w[i + 1]) > 2 and (list_contains({FW}, w[i]) or list_contains({FW}, w[i + 1])) or list_contains({LEX}, w[i] || ' ' || w[i + 1]))) / (len(w) - 1) else 1 end, 3)"


@query(f"select doc_id, {BIG} validity from (select doc_id, {_ascii_words_sql(f'lower({PROSE})')} w from documents)")
def bigram_validity(s, d):
    return _texts(s, d).select("doc_id", X.prose(F.col("text")).alias("p")).select("doc_id", X.bigram_validity(F.col("p")).alias("validity"))


@query(r"select doc_id, case when length(text) > 0 then sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) else '' end hash from documents")
def content_hash(s, d):
    return _docs(s, d).select("doc_id", X.content_hash(F.col("text")).alias("hash"))


LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"""select doc_id, case when len(l) = 0 then 'Untitled' when length(l[1]) > 60 then left(l[1], 57) || '...' else l[1] end title, case when length(s) > 150 then left(s, 147) || '...' else s end snippet
 from (select doc_id, l, array_to_string(list_filter(l, lambda x: not starts_with(x, '#'))[1:3], ' ') s from (select doc_id, {LINES} l from documents))""")
def title_snippet(s, d):
    return _texts(s, d).select("doc_id", X.title(F.col("text")).alias("title"), X.snippet(F.col("text")).alias("snippet"))


TOKEN_RULE = 'token = "[0-9a-f]{40}"'


@query(f"select doc_id, sha256(regexp_replace(text, '{TOKEN_RULE}|AKIA[A-Za-z0-9]{{16}}', '[REDACTED_SECRET]', 'gi')) hash from documents")
def redact_custom(s, d):
    return _texts(s, d).select("doc_id", F.sha2(redact(F.col("text"), [TOKEN_RULE]), 256).alias("hash"))


#: One key of every shape, made of a row's hashes h (128 hexadecimal digits); and what is none: too short, or within a longer word.
KEYS = ["'ghp_' || left(h, 40)", "'github_pat_' || left(h, 90)", "'sk-ant-sid01-' || left(h, 24)", "'sk-ant-' || left(h, 24)", "'sk-' || left(h, 50)", "'sk-proj-' || left(h, 24)", "left(h, 22) || ':' || left(h, 44)", "'AKIA' || upper(left(h, 16))", "'M' || left(h, 23) || '.' || left(h, 6) || '.' || left(h, 27)", "'ghp_' || left(h, 30)", "'xAKIA' || left(h, 16)"]


@query(rf"""select doc_id, k::int k, sha256(regexp_replace('set ' || key || ', then ' || text || ' (' || key || ')', '{"|".join(SECRET_PATTERNS)}', '{MARK}', 'gi')) hash
 from (select doc_id, text, unnest([{", ".join(KEYS)}]) key, unnest(range({len(KEYS)})) k from (select doc_id, text, sha256(text) || sha256(source || text) h from documents))""")
def redact_keys(s, d):
    """Every document with a key of each shape, and with what only looks like one."""
    t = _texts(s, d).join(_docs(s, d).select("doc_id", "source"), "doc_id").withColumn("h", F.concat(F.sha2("text", 256), F.sha2(F.concat("source", "text"), 256)))
    each = t.select("doc_id", "text", F.posexplode(F.array(*[F.expr(k) for k in KEYS])).alias("k", "key"))
    return each.select("doc_id", "k", F.sha2(redact(F.concat(F.lit("set "), "key", F.lit(", then "), "text", F.lit(" ("), "key", F.lit(")"))), 256).alias("hash"))


GATE = rf"""with b as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') text from documents),
 h as (select doc_id, -sum(n / t * log2(n / t)) h from (select doc_id, ch, count(*)::double n, sum(count(*)) over (partition by doc_id)::double t from (select doc_id, unnest(string_split(text, '')) ch from b) group by 1, 2) group by 1),
 m as (select doc_id, text t, regexp_extract_all(lower(text), '{W}') w, {PROSE} p, {SYM.format(c="text")} sym from b),
 g as (select m.*, h, len(w) nw, case when len(w) >= 3 then 1 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: list_aggregate(w[i:i + 2], 'string_agg', ' ')))) / (len(w) - 2) else 0 end d3,
 case when len(w) >= 5 then 1 - len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')))) / (len(w) - 4) else 0 end d5,
 case when len(w) > 0 then len(list_distinct(w)) / len(w) else 0 end ttr from m join h using (doc_id)),
 q as (select g.* exclude (w), {CLI} cli, len(w) np from (select g.* exclude (w), {_ascii_words_sql('p')} w from g) g),
 r as (select q.*, {BIG} big from (select q.*, {_ascii_words_sql('lower(p)')} w from q) q)
 select doc_id, case when length(t) < 20 then 'SHORT_LENGTH' when sym > 0.35 then 'HIGH_SYMBOL_RATIO' when h < 2.5 then 'LOW_ENTROPY' when nw >= 20 and d3 > 0.3 then 'HIGH_3GRAM_REPETITION' when nw >= 20 and d5 > 0.2 then 'HIGH_5GRAM_REPETITION'
 when nw > 30 and ttr < 0.35 then 'LOW_TTR' when np > 25 and big < 0.15 then 'WORD_SALAD_PERPLEXITY' when np > 30 and (cli < 2 or cli > 26) then 'EXTREME_READABILITY_BOUNDS' when length(t) > 8000 or h > 5.3 then 'WARN' else 'ACCEPT' end verdict from r"""


@query(GATE)
def quality_gate(s, d):
    out = quality.gate(_texts(s, d), "text")
    last = F.element_at("quality_flags", -1)
    return out.select("doc_id", F.when(F.col("quality_status") == "REJECT", last).otherwise(F.col("quality_status")).alias("verdict"))


@query(f"select quality, verdict, count(*) n from ({GATE}) join labels using (doc_id) group by 1, 2")
def quality_vs_label(s, d):
    return quality_gate(s, d).join(lens.read(s, d, "labels"), "doc_id").groupBy("quality", "verdict").agg(F.count(F.lit(1)).alias("n"))


# Duplicates -----------------------------------------------------------------------------------------------------

TOKENS = r"toks as (select doc_id id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')) w from documents)"
PAIRS = f"""{TOKENS}, e as (select id, len(w) n, unnest(w) t from toks), sim as (select a.id a, b.id b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) similarity from e a join e b on a.t = b.t and a.id < b.id group by 1, 2)"""


def _pairs(s, d):
    t = lens.tokens(s, d)
    return dedup.token_pairs(t, t, same=F.col("a") < F.col("b"))


@query(f"with {PAIRS} select a, b, round(similarity, 6) similarity from sim where similarity >= 0.25")
def jaccard_pairs_025(s, d):
    return _pairs(s, d).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"with {PAIRS} select a, b, round(similarity, 6) similarity, case when similarity >= 0.88 then 'supersede' else 'warn' end as action from sim where similarity >= 0.25 qualify row_number() over (partition by a order by similarity desc, b) = 1")
def supersede_088(s, d):
    return dedup.route(_pairs(s, d)).select("a", "b", F.round("similarity", 6).alias("similarity"), "action")


@query(r"select source owner_id, sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) hash, count(*) n, min(doc_id) first_id from documents group by 1, 2 having count(*) > 1")
def dup_exact(s, d):
    return _docs(s, d).groupBy(F.col("source").alias("owner_id"), X.content_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# Lists, filters, tags -------------------------------------------------------------------------------------------

ENT_COLS = "id, owner_id, scope, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') updated_at"


def _ent_cols(df):
    return df.select("id", "owner_id", "scope", "status", _stamp("updated_at"))


@query(f"with {ENT} select {ENT_COLS} from ent where (owner_id = 'src3' or scope = 'shared') and status <> 'archived' order by ent.updated_at desc, id limit 20 offset 20")
def visible_page(s, d):
    rows = lens.entities(s, d).where(hybrid.visible("src3") & hybrid.active())
    return _ent_cols(hybrid.page(rows, [F.desc("updated_at"), F.col("id")], 20, hybrid.decode_cursor("offset:20")))


@query(f"with {ENT} select {ENT_COLS} from ent where status = 'consolidated' and context_id = 'fr' order by ent.updated_at desc, id limit 50")
def scan_page(s, d):
    rows = lens.entities(s, d).where(report.entity_filter(status="consolidated", context="fr"))
    return _ent_cols(report.page(rows, [F.desc("updated_at"), F.col("id")]))


@query(f"with {ENT} select {ENT_COLS} from ent where status <> 'archived' order by is_core desc, ent.updated_at desc, id limit 5")
def core_first_page(s, d):
    return _ent_cols(hybrid.page(lens.entities(s, d).where(hybrid.active()), [F.desc("is_core"), F.desc("updated_at"), F.col("id")], 5))


@query("select event_id from events where json_extract_string(props, '$.k') = '7'")
def metadata_filter(s, d):
    return lens.read(s, d, "events").where(hybrid.metadata_is({"k": 7}, "props")).select("event_id")


@query(f"with {TAG} select distinct entity_id id from et where tag_id in ('#fr', '#toxic')")
def tag_filter_or(s, d):
    return hybrid.with_tags(lens.entity_tags(s, d), lens.tags(s, d), ["fr", "#Toxic"])


@query(f"with {TAG} select entity_id id from et where tag_id in ('#fr', '#toxic') group by 1 having count(distinct tag_id) = 2")
def tag_filter_and(s, d):
    return hybrid.with_tags(lens.entity_tags(s, d), lens.tags(s, d), ["fr", "#toxic"], "AND")


@query(f"with {TAG} select name, count(entity_id) n from tag left join et on tag_id = id group by 1")
def tag_usage(s, d):
    return tagging.usage(lens.tags(s, d), lens.entity_tags(s, d)).select("name", "n")


ROOT = "(select id, first_value(id) over (partition by lower(replace(replace(replace(name, '-', ''), '_', ''), '#', '')) order by made, id) root from tag)"


@query(f"with {TAG}, r as {ROOT} select root, count(distinct entity_id) n from et join r on tag_id = r.id group by 1")
def tag_canonical(s, d):
    _, links = tagging.merge(lens.tags(s, d), lens.entity_tags(s, d))
    return links.groupBy(F.col("tag_id").alias("root")).agg(F.count(F.lit(1)).alias("n"))


#: Parts of so many ids in the queries below, so that groups of the smallest tables have several.
PART = 20


def _parts_sql(rows: str, keys: str) -> str:
    return f"""r as ({rows}), n as (select {keys}, count(*) n from r group by all having count(*) >= 5), h as (select r.*, ('0x' || left(md5(id), 8))::bigint h from r)
 select {keys}, n, (h // {librarian.SALTS}) % ceil(n / {PART})::bigint part, string_agg(id, ',' order by id) ids from h join n using ({keys}) group by all"""


@query(f"with {ENT}, {TAG}, {_parts_sql('select id, tag_id tag_name, owner_id from et join ent on ent.id = entity_id where status = ' + chr(39) + 'raw' + chr(39), 'tag_name, owner_id')}")
def tag_clutter(s, d):
    """Dense tags of an owner, their ids in parts."""
    return librarian.dense_tags(lens.entities(s, d), lens.tags(s, d), lens.entity_tags(s, d), PART).withColumn("ids", F.array_join("entity_ids", ",")).drop("entity_ids")


@query(f"with {ENT}, {_parts_sql('select id, owner_id, scope from ent where status = ' + chr(39) + 'raw' + chr(39), 'owner_id, scope')}")
def owner_scope_accum(s, d):
    return librarian.accumulated(lens.entities(s, d), size=PART).withColumn("ids", F.array_join("entity_ids", ",")).drop("entity_ids")


@query(f"with {TAG} select name from tag where name ilike '%src%'")
def tag_listing(s, d):
    return tagging.canonical(lens.tags(s, d), "SRC").select("name")


# Events ---------------------------------------------------------------------------------------------------------


@query("select event_id id, user_id agent_id, event_type as type, props as content from events where event_type = (select min(event_type) from events) order by ts desc, event_id desc limit 20")
def recent_events(s, d):
    e = lens.ledger(s, d)
    kind = e.agg(F.min("type")).first()[0]
    return events.recent(e, kind=kind).select("id", "agent_id", "type", "content")


@query("select user_id || '-' || strftime(ts, '%Y-%m-%d') session_id, count(*) n, min(event_id) first_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_at from events group by 1")
def session_summary(s, d):
    return lens.ledger(s, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("select doc_id, length(c) n, sha256(c) hash from (select doc_id, case when length(text) > 1000 then left(text, 1000) || ' [TRUNCATED]' else text end c from documents)")
def event_truncate(s, d):
    c = events.shortened(F.col("text"), F.lit("decision"))
    return _docs(s, d).select("doc_id", c.alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("hash"))


@query(f"with {ENT} select cast(doc_id as varchar) id, case when exists (select 1 from ent e where e.doc_id in (d.doc_id, d.doc_id + 1) and e.status = 'raw') then 'pending' else 'resolved' end status from documents d")
def request_status(s, d):
    ids = F.array(F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")).alias("entity_ids")
    asked = _docs(s, d).select(F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct(F.lit("general").alias("target"), ids)).alias("content"))
    return events.request_status(asked, lens.entities(s, d))


@query("select event_type, date_trunc('hour', ts)::varchar as hour, count(*) n, round(avg(value), 6) mean from events group by 1, 2")
def event_hours(s, d):
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour")
    return lens.read(s, d, "events").groupBy("event_type", hour).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# Reports --------------------------------------------------------------------------------------------------------


@query(f"""with {ENT}, {REL}, {TAG} select count(*) filter (status = 'raw') raw, count(*) filter (status = 'consolidated') consolidated, count(*) filter (status = 'archived') archived, count(*) filter (status <> 'archived' and scope = 'private') private,
 count(*) filter (status <> 'archived' and scope = 'shared') shared, count(*) filter (status <> 'archived' and embedding_status = 'ready') ready, count(*) filter (status <> 'archived' and embedding_status = 'pending') pending, 0::bigint failed,
 (select count(*) from events) events, (select count(*) from rel) relations, (select count(*) from tag) tags from ent""")
def stats(s, d):
    return report.stats(lens.entities(s, d), lens.ledger(s, d), lens.relations(s, d), lens.tags(s, d))


@query(f"with {ENT} select count(*) filter (embedding_status = 'pending') pending, count(*) filter (embedding_status = 'ready') ready, 0::bigint failed, count(*) filter (embedding_status = 'archived') archived, 0::bigint unset, count(*) filter (status <> 'archived') active, round(100.0 * count(*) filter (embedding_status = 'ready') / greatest(1, count(*) filter (status <> 'archived')))::bigint ready_percent from ent")
def embedding_stats(s, d):
    return report.embedding_stats(lens.entities(s, d))


@query(f"with {REL} select count(*) total, ceil(count(*) / 200)::bigint total_pages from rel")
def page_counts(s, d):
    return report.page_totals(lens.relations(s, d), report.RELATIONS_PAGE)


@query(f"with {ENT} select status, count(*) n from ent group by 1")
def status_counts(s, d):
    return report.status_counts(lens.entities(s, d))


@query(f"""with {ENT}, {TAG}, hit as (select ent.* from ent where context_id = 'en' and id in (select entity_id from et where tag_id = '#src1')), n as (select count(*) total, ceil(count(*) / 50)::bigint total_pages from hit),
 p as (select * from hit order by updated_at desc, id limit 50) select id, owner_id, status, embedding_status, (select string_agg(tag_id, ',' order by tag_id) from et where entity_id = p.id) tags, total, total_pages from p, n""")
def entity_list(s, d):
    """A page of the list by context and exact tag, with display status, tags and totals."""
    rows, n = report.entity_list(lens.entities(s, d), lens.entity_tags(s, d), lens.tags(s, d), tag="#src1", context="en")
    return rows.select("id", "owner_id", "status", "embedding_status", F.array_join("tags", ",").alias("tags")).join(F.broadcast(n))  # a single row


@query(f"""with {ENT}, {REL}, hit as (select * from rel where predicate = 'derived_from'), n as (select count(*) total, ceil(count(*) / 200)::bigint total_pages from hit), p as (select * from hit order by created_at desc, id limit 200)
 select p.id, coalesce(s.title, source_id) source_title, coalesce(t.title, target_id) target_title, total, total_pages from p left join ent s on s.id = source_id left join ent t on t.id = target_id, n""")
def relation_list(s, d):
    """The first page of relations of one predicate with titles and totals."""
    rows, n = report.relation_list(lens.relations(s, d), lens.entities(s, d), predicate="derived_from")
    return rows.select("id", "source_title", "target_title").join(F.broadcast(n))  # a single row


@query(f"""with {ENT}, {REL}, top as (select title, weight, round(score, 4) score, row_number() over (order by score desc, id) place from (select ent.id, title, weight, score from hits join ent on ent.doc_id = hits.id where status <> 'archived') qualify place <= 3),
 last as (select *, row_number() over (order by ts desc, event_id desc) place from events qualify place <= 5)
 select 'status' section, count(*) place, upper(status) as label, null::varchar detail from ent group by status union all select 'core', weight, title, id from ent where is_core and status <> 'archived'
 union all select 'event', place, user_id || ' ' || upper(event_type), case when json_extract_string(props, '$.target') is null then case when length(props) > 80 then left(props, 80) || '...' else props end end from last
 union all select 'search', place, title, printf('%.4f', score) || ' ' || weight from top""".replace("with ", f"with {_bm25_sql(TERMS[:1])}, ", 1))
def store_overview(s, d):
    """What a reader of the store looks at first."""
    hits = _hits(s, d, TERMS[:1]).withColumn("id", F.col("id").cast("string"))
    return report.overview(lens.entities(s, d), lens.ledger(s, d), hits)


# Graph ----------------------------------------------------------------------------------------------------------

VALID = f"(valid_to is null or valid_to > {NOW_SQL})"


@query(f"""with recursive {REL}, edge as (select source_id, target_id, predicate from rel where {VALID}), walk as (select source_id, target_id, predicate, 1 depth, [source_id, target_id] path from edge where source_id = '60' and target_id <> '60'
 union all select e.source_id, e.target_id, e.predicate, depth + 1, list_append(path, e.target_id) from walk w join edge e on e.source_id = w.target_id where depth < 5 and not list_contains(path, e.target_id))
 select source_id, target_id, predicate, depth, array_to_string(path, '>') path from walk""")
def closure_paths(s, d):
    return graph.closure(lens.relations(s, d), "60", _now()).withColumn("path", F.array_join("path", ">"))


@query(f"""with recursive {ENT}, par as (select id, unnest([cast(doc_id - 1 as varchar), cast(doc_id - 2 as varchar)]) parent from ent where status = 'consolidated'), walk as (select '18' id, 0 depth union all select parent, depth + 1 from walk join par using (id) where depth < 10)
 select id, depth from walk where id in (select id from ent)""")
def lineage(s, d):
    return graph.lineage_by_parents(lens.entities(s, d), "18")


@query(f"with {REL} select id, count(*) degree from (select source_id id from rel union all select target_id from rel) group by 1")
def degree(s, d):
    return graph.degrees(lens.relations(s, d))


@query(f"""with {ENT}, {REL} select rel.id, s.title source_title, t.title target_title, predicate from rel join ent s on s.id = source_id join ent t on t.id = target_id where s.status <> 'archived' and t.status <> 'archived' order by rel.created_at desc, rel.id limit 250""")
def topology(s, d):
    return graph.topology(lens.relations(s, d), lens.entities(s, d)).select("id", "source_title", "target_title", "predicate")


@query(f"with {ENT}, {REL} select id, owner_id from ent where status = 'raw' and id not in (select source_id from rel union select target_id from rel)")
def orphans(s, d):
    return graph.orphans(lens.entities(s, d), lens.relations(s, d)).select("id", "owner_id")


@query(f"""with {ENT}, {REL}, {TAG} select id, (select string_agg(tag_id, ',' order by tag_id) from et where entity_id = '60') tags, (select count(*) from rel where source_id = '60') outgoing, (select count(*) from rel where target_id = '60') incoming from ent where id = '60'""")
def entity_detail(s, d):
    out = graph.detail(lens.entities(s, d), lens.relations(s, d), lens.entity_tags(s, d), lens.tags(s, d), "60")
    return out.select("id", F.array_join("tags", ",").alias("tags"), F.size("outgoing").cast("long").alias("outgoing"), F.size("incoming").cast("long").alias("incoming"))


@query(f"with {ENT} select id as input, id from ent union all select title, case when status <> 'archived' then id else title end from ent union all values ('none', 'none')")
def resolve_ids(s, d):
    """Every id and every title; titles of archived rows lead nowhere."""
    ent = lens.entities(s, d)
    return graph.resolve_ids(ent.select(F.col("id").alias("input")).union(ent.select("title")).union(s.createDataFrame([("none",)], "input string")), ent)


# Versions -------------------------------------------------------------------------------------------------------

FEED = "select user_id, event_id, row_number() over w as version, strftime(ts, '%Y-%m-%d %H:%M:%S') valid_from, strftime(lead(ts) over w, '%Y-%m-%d %H:%M:%S') valid_to from events window w as (partition by user_id order by ts, event_id)"


def _feed(s, d):
    out = scd.history(lens.read(s, d, "events"), "user_id", ["ts", "event_id"], "ts")
    return out.select("user_id", "event_id", F.col("version").cast("long").alias("version"), _stamp("valid_from"), _stamp("valid_to"))


@query(FEED)
def scd2_history(s, d):
    return _feed(s, d)


@query(f"select * from ({FEED}) where valid_to is null")
def scd2_current(s, d):
    return _feed(s, d).where("valid_to is null")


@query(f"""with {ENT}, {REL}, moved as (select cast(doc_id - 1 as varchar) parent, 'new' || doc_id as id from ent where status = 'consolidated'),
 e as (select coalesce(s.id, source_id) source_id, coalesce(t.id, target_id) target_id, predicate from rel left join moved s on s.parent = source_id left join moved t on t.parent = target_id)
 select * from e where source_id <> target_id""")
def consolidate_repoint(s, d):
    moved = lens.entities(s, d).where("status = 'consolidated'").select((F.col("doc_id") - 1).cast("string").alias("parent"), F.concat(F.lit("new"), "id").alias("id"))
    return scd.repoint(lens.relations(s, d), moved).select("source_id", "target_id", "predicate")


@query(f"""with {ENT} select id, round(weight * 0.5::double * exp(-0.05::double * (epoch_us({NOW_SQL}) - epoch_us(updated_at)) / 86400000000), 6) score from ent where status <> 'archived' and not is_core
 and weight * 0.5::double * exp(-0.05::double * (epoch_us({NOW_SQL}) - epoch_us(updated_at)) / 86400000000) < 0.1""")
def decay(s, d):
    ent = lens.entities(s, d).withColumns({"last_accessed_at": F.lit(None).cast("timestamp"), "quality_score": F.lit(None).cast("double"), "metadata": F.lit(None).cast("string")})
    return librarian.decayed(ent, _now(), floor=0.1).select("id", F.round("score", 6).alias("score"))


@query(f"""with {ENT} select doc_id id, case when doc_id % 4 = 3 then 'not found' when status = 'archived' then 'already archived' when doc_id % 4 = 1 and owner_id <> 'src1' then 'not the owner' else 'archived' end result from ent""")
def archive_results(s, d):
    ent = lens.entities(s, d)
    asked = ent.select(F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), F.when(F.col("doc_id") % 4 == 1, "src1").alias("owner_id"))
    _, result = scd.archive(ent, asked, _now())
    return result.select(F.regexp_replace("id", "^x", "").cast("long").alias("id"), "result")


# Importers ------------------------------------------------------------------------------------------------------


@query(r"select doc_id, pos::integer pos, line from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents) where regexp_matches(line, '^Licensed ')")
def importer_lines(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike("^Licensed "))


@query(r"""select doc_id, 0 as pos, 'Part ' || doc_id as title, text as content from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from documents) where text <> ''
 union all select doc_id, 1, 'Inner ' || source, 'of ' || lang from documents union all select doc_id, 3, 'Last', 'end' from documents""")
def importer_sections(s, d):
    """Sections of both levels, a blank one, a heading of a third level and line ends of both kinds."""
    parts = [F.lit("intro\n# Top\n## Part "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n### Inner "), F.col("source"), F.lit("\r\nof "), F.col("lang"), F.lit("\n## Blank\n \n## Last\r\n\r\nend\n")]
    return importers.sections(_docs(s, d).select("doc_id", F.concat(*parts).alias("text")), "doc_id")


@query("""select doc_id, unnest([0, 1, 3, 5]) as line, unnest(['decision', 'fix', 'attempt', 'issue']) as type, unnest(['keep ' || source, 'in ' || lang, 'number ' || doc_id, 'none']) as content from documents""")
def importer_events(s, d):
    """Labelled lines with and without bullets, colons and capitals; a line of an unknown label, one of a phrase to leave out and a plain one."""
    i = F.col("doc_id").cast("string")
    rows = [F.concat(F.lit("- [DECISION] keep "), "source"), F.concat(F.lit("* [Resolution]: in "), "lang", F.lit("  ")), F.lit("[OTHER] no"), F.concat(F.lit("  [fact] number "), i), F.lit("- [IDEA] Not To Be Kept"), F.lit("[ISSUE]none"), F.lit("see [OPEN] x")]
    return importers.log_events(_docs(s, d).select("doc_id", F.concat_ws("\n", *rows).alias("text")), "doc_id", ["to be kept"])


@query("select doc_id, unnest([source || '.md', lang || '.md']) file, unnest(['2024-01-02', '2025-11-30']) as date from documents")
def importer_catalog(s, d):
    rows = [F.lit("| File | Date |\n|---|---|"), F.concat(F.lit("| `"), "source", F.lit(".md` | 2024-01-02 | x |")), F.concat(F.lit("|"), "lang", F.lit(".md|2025-11-30|")), F.lit("| a.txt | 2024-01-02 |\n| b.md | soon |")]
    return importers.catalog_rows(_docs(s, d).select("doc_id", F.concat_ws("\n", *rows).alias("text")), "doc_id")


# The same operators at larger volume ----------------------------------------------------------------------------


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderstatus = 'P')")
def star_orphans(s, d):
    """Customers without a pending order."""
    return lens.read(s, d, "customer").join(lens.read(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def star_topology(s, d):
    c, n, r = (lens.read(s, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("select o_orderstatus, count(*) n from orders group by 1")
def star_status_counts(s, d):
    return report.status_counts(lens.read(s, d, "orders"), "o_orderstatus")


@query("select p_partkey, p_name, count(l_partkey) n from part left join lineitem on p_partkey = l_partkey group by 1, 2")
def star_usage(s, d):
    n = lens.read(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return lens.read(s, d, "part").join(n, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("select o_orderkey, o_totalprice from orders order by o_orderdate desc, o_orderkey limit 50 offset 100")
def star_page(s, d):
    return report.page(lens.read(s, d, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_orderkey", "o_totalprice")


# Further operators ----------------------------------------------------------------------------------------------


@query(f"select doc_id, sha256({PROSE}) hash from documents")
def prose(s, d):
    return _texts(s, d).select("doc_id", F.sha2(X.prose(F.col("text")), 256).alias("hash"))


@query(r"""with m as (select doc_id, text t, list_transform(regexp_extract_all(text, '(?m)^(#{1,6})\s+(.+)$', 1), lambda x: length(x)) v, regexp_extract_all(text, '(?m)^```([\p{L}\p{N}_]*)', 1) f,
 list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: starts_with(x, '|') and ends_with(x, '|')) r,
 array_to_string(regexp_extract_all(text, '(?m)^(#{1,6})\s+(.+)$', 2), chr(10)) hw, array_to_string(regexp_extract_all(text, '(?m)^\s*[-*\d.]+\s+(.+)$', 1), chr(10)) lw, array_to_string(regexp_extract_all(text, '```[\s\S]*?```'), chr(10)) cw from documents)
 select doc_id, len(f) % 2 = 0 and len(list_filter(r, lambda x: length(x) - length(replace(x, '|', '')) < 3)) = 0 as valid, len(v)::int headers, len(list_filter(range(2, len(v) + 1), lambda i: v[i] > v[i - 1] + 1)) > 0 header_skip,
 len(list_filter(range(1, len(f) + 1), lambda i: i % 2 = 1 and f[i] = ''))::int untyped,
 case when len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) > 0 then round((len(regexp_extract_all(hw, '[\p{L}\p{N}_]+')) + len(regexp_extract_all(lw, '[\p{L}\p{N}_]+')) + len(regexp_extract_all(cw, '[\p{L}\p{N}_]+'))) / len(regexp_extract_all(t, '[\p{L}\p{N}_]+')), 3) else 0 end msdi from m""")
def markdown_structure(s, d):
    return _texts(s, d).select("doc_id", quality.structure(F.col("text")).alias("m")).select("doc_id", "m.*")


STEM = "case " + " ".join(f"when ends_with(x, '{e}') and length(x) > {len(e) + 3} then left(x, length(x) - {len(e)})" for e in X.SUFFIXES) + " else x end"
STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS) + "]"


def _mixed(s, d):
    """doc_id and text: documents among what the measures must tell apart: fences, code, addresses, paths, loose hyphens, letters outside ASCII."""
    parts = [F.lit("# Caf\u00e9 notes - on the "), F.col("text"), F.lit("\n- see /src/"), F.col("source"), F.lit(".py/next.md and a.b\u00e9 --flag- of the `word "), F.col("lang"), F.lit("` at https://x.y/z.md\u00a0end of it.\n```\ncode "), F.col("text"), F.lit("\n```\nDone - word caf\u00e9-bar. Yes!")]
    return spread(_docs(s, d).select("doc_id", F.concat(*parts).alias("text")), "doc_id")


MIXED = "(select doc_id, '# Caf\u00e9 notes - on the ' || text || chr(10) || '- see /src/' || source || '.py/next.md and a.b\u00e9 --flag- of the `word ' || lang || '` at https://x.y/z.md\u00a0end of it.' || chr(10) || '```' || chr(10) || 'code ' || text || chr(10) || '```' || chr(10) || 'Done - word caf\u00e9-bar. Yes!' as text from documents)"


@query(f"""select m.doc_id, sha256(m.p) prose, {CLI} cli, {BIG} validity, len(w) n_words, tokens from (select doc_id, p, {_ascii_words_sql('lower(p)')} w from (select doc_id, {PROSE} p from {MIXED})) m join
 (select doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(w, lambda x: not list_contains({STOP}, x)), lambda x: {STEM}))), ' ') tokens from (select doc_id, {_ascii_words_sql("lower(text)", "{3,}")} w from {MIXED})) t using (doc_id)""")
def text_measures(s, d):
    """Prose and what is measured of it, and content words, of documents among code, paths and hyphens."""
    m = _mixed(s, d).withColumn("p", X.prose(F.col("text")))
    m = m.withColumn("of", X.prose_measures(F.col("p")))
    return m.select("doc_id", F.sha2("p", 256).alias("prose"), F.round("of.cli", 2).alias("cli"), F.round("of.big", 3).alias("validity"), F.col("of.n").alias("n_words"), F.array_join(X.content_tokens(F.col("text")), " ").alias("tokens"))


@query()
def specificity(s, d):
    """No SQL: DuckDB's patterns have no look-around."""
    return _texts(s, d).select("doc_id", F.round(X.specificity(F.col("text")), 6).alias("ratio"))


@query(rf"""select doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(w, lambda x: not list_contains({STOP}, x)), lambda x: {STEM}))), ' ') tokens from (select doc_id, {_ascii_words_sql("lower(text)", "{3,}")} w from documents)""")
def content_tokens(s, d):
    return _texts(s, d).select("doc_id", F.array_join(X.content_tokens(F.col("text")), " ").alias("tokens"))


@query()
def markdown_format(s, d):
    """No SQL: the formatter follows fences from line to line."""
    return _texts(s, d).select("doc_id", format_markdown_udf("text").alias("t")).select("doc_id", F.sha2("t", 256).alias("hash"))


@query(f"""with {REL}, deg as (select id from (select source_id id from rel union all select target_id from rel) group by 1 having count(*) >= 3) select id, source_id, target_id from rel where source_id in (select id from deg) and target_id in (select id from deg)""")
def degree_filter(s, d):
    return graph.with_least_degree(lens.relations(s, d), 3).select("id", "source_id", "target_id")


@query(f"""with {ENT}, {TAG} select entity_id id, string_agg(distinct tag_id, ',' order by tag_id) tags from et group by 1""")
def tag_names(s, d):
    return tagging.names_by_entity(lens.entity_tags(s, d), lens.tags(s, d)).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"with {REL} select distinct predicate from rel")
def predicates(s, d):
    return lens.relations(s, d).select("predicate").distinct()


@query(f"with {REL} select id from rel where valid_to is null or valid_to > timestamp '2024-01-01 12:00:00'")
def relations_as_of(s, d):
    return lens.relations(s, d).where(hybrid.valid_at(F.lit("2024-01-01 12:00:00").cast("timestamp"))).select("id")


@query(f"with {ENT} select id, title, status from ent where id = 'OC 12' or starts_with(id, 'OC 12') or title = 'OC 12' or contains(lower(title), 'oc 12') order by status, id limit 1")
def fuzzy_match(s, d):
    return graph.fuzzy(lens.entities(s, d), "OC 12").select("id", "title", "status")


SCORES = "nullif(l_linenumber % 6, 0)", "nullif(l_suppkey % 6, 0)", "nullif(l_partkey % 6, 0)", "nullif(l_orderkey % 6, 0)"


@query(f"select w weight, count(*) n from (select case when coalesce({', '.join(SCORES)}) is null then 1 else greatest(1, least(5, ({' + '.join(f'coalesce({x}, 3)' for x in SCORES)}) // 4)) end::int w from lineitem) group by 1")
def weight_scores(s, d):
    w = scd.weight_from_scores(*[F.expr(x) for x in SCORES], F.lit(1))
    return lens.read(s, d, "lineitem").select(w.cast("int").alias("weight")).groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


@query(r"""select doc_id, case when doc_id % 17 = 0 then 'owner_id is missing' when coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') = '' then 'content is blank' when doc_id % 13 = 0 then 'scope is unknown' when doc_id % 11 = 0 then 'title is blank'
 when doc_id % 7 = 0 then 'title begins with a file name' when doc_id % 5 = 0 then 'source_path is absolute' end error from documents""")
def input_errors(s, d):
    i, when = F.col("doc_id"), lambda n, a, b: F.when(F.col("doc_id") % n == 0, a).otherwise(b)
    asked = _docs(s, d).select(
        i, when(17, F.lit(" "), F.col("source")).alias("owner_id"), when(13, F.lit("public"), F.lit("shared")).alias("scope"), when(11, F.lit(""), when(7, F.lit("notes.md - plan"), F.lit("plan"))).alias("title"),
        F.col("text").alias("full_content"), when(5, F.lit('{"source_path": "/etc/a.conf"}'), F.lit('{"source_path": "etc/a.conf"}')).alias("metadata"),
    )
    return asked.select("doc_id", scd.input_error(asked).alias("error"))


@query(f"""with {ENT} select doc_id id, case when doc_id % 7 = 0 then 'title or content is missing' when doc_id % 5 = 0 then 'no parent found' when doc_id % 3 = 0 then 'quality: CONVERSATIONAL_FLUFF' else 'stored' end result,
 case when doc_id % 7 > 0 and doc_id % 5 > 0 and doc_id % 3 > 0 then 'consolidated' end status, case when doc_id % 7 > 0 and doc_id % 5 > 0 and doc_id % 3 > 0 then (doc_id - 1)::varchar || ',' || (doc_id - 2)::varchar end parents from ent where status = 'consolidated'""")
def consolidate_checked(s, d):
    """Requests over every consolidated row's two predecessors, of which some are refused; parents come by id and by title."""
    ent = lens.entities(s, d)
    i = F.col("doc_id")
    text = F.concat(F.lit("Notes on the release of unit "), F.col("id"), F.lit(" and how its results are kept for the next review of all the parts."))
    parents = F.when(i % 5 == 0, F.array(F.lit("none"))).otherwise(F.array((i - 1).cast("string"), F.concat(F.lit("doc "), (i - 2).cast("string"))))
    asked = ent.where("status = 'consolidated'").select(
        i.alias("seq"), parents.alias("parent_ids"), F.when(i % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Joint "), "id")).alias("title"), F.when(i % 3 == 0, F.lit("consolidated these files.")).otherwise(text).alias("full_content"),
        "owner_id", "scope", "weight", "context_id",
    )
    after, _, result = consolidation.consolidate(migrate(ent, "entities"), migrate(lens.relations(s, d), "relations"), asked, _now(), warn=0.9)
    made = after.select("id", "status", F.array_join(F.reverse(F.array_sort(F.transform("parent_ids", lambda p: p.cast("long")))), ",").alias("parents"))
    return result.join(made, "id", "left").select(F.col("seq").alias("id"), "result", "status", "parents")


@query(f"select e.vec_id id, round(case when e.vec_id % 10 = 0 then 1 else {COS} end, 6) + 0 distance from embeddings e, {Q0} q")
def cosine_with_zero_vectors(s, d):
    """Every tenth vector is set to zero."""
    v = lens.vectors(s, d).withColumn("embedding", F.when(F.col("id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    q = F.array(*[F.lit(float(x)) for x in _query_vector(s, d)])
    return v.select("id", (F.round(vector.cosine_distance(F.col("embedding"), q), 6) + 0.0).alias("distance"))


# The write path --------------------------------------------------------------------------------------------------


def _state(s, d):
    return migrate(lens.entities(s, d), "entities")


@query(f"""with {ENT}, asked as (select * from ent where doc_id % 3 = 0)
 select id, title, owner_id, context_id, status, weight, embedding_status, strftime(created_at, '%Y-%m-%d %H:%M:%S') created_at, null valid_from, null valid_to from ent where doc_id % 3 <> 0
 union all select id, 'new ' || id, case when doc_id % 2 = 0 then 'me' else owner_id end, context_id, 'raw', 5, embedding_status, strftime(created_at, '%Y-%m-%d %H:%M:%S'), '{AS_OF}', null from asked
 union all select id || '_h_' || left(sha256(id || '|' || strftime(updated_at, '%Y-%m-%d %H:%M:%S')), 8), title, owner_id, context_id, 'archived', weight, 'archived', strftime(created_at, '%Y-%m-%d %H:%M:%S'), strftime(created_at, '%Y-%m-%d %H:%M:%S'), '{AS_OF}' from asked
 union all select 'n' || id, 'made', 'me', null, 'raw', 5, 'pending', '{AS_OF}', '{AS_OF}', null from asked""")
def scd2_upsert(s, d):
    """Every third entity is stored again, and a new one beside each: current rows, closed versions and untouched rows."""
    state, even = _state(s, d), F.col("id").cast("long") % 2 == 0
    again = lens.entities(s, d).where("doc_id % 3 = 0").select("id", F.concat(F.lit("new "), "id").alias("title"), F.when(even, "me").alias("owner_id"), F.lit(5).alias("weight"), F.lit("x").alias("full_content"))
    fresh = again.select(F.concat(F.lit("n"), "id").alias("id"), F.lit("made").alias("title"), F.lit("me").alias("owner_id"), "weight", "full_content")
    out = scd.upsert(state, migrate(again.unionByName(fresh), "entities"), _now())
    return out.select("id", "title", "owner_id", "context_id", "status", "weight", "embedding_status", _stamp("created_at"), _stamp("valid_from"), _stamp("valid_to"))


@query(f"""with {ENT}, gone as (select *, doc_id % 4 <> 3 and status <> 'archived' and (doc_id % 4 <> 1 or owner_id = 'src1') hit from ent)
 select id, case when hit then 'archived' else status end status, case when hit then 'archived' else embedding_status end embedding_status, case when hit then '{AS_OF}' end valid_to, case when hit then '{AS_OF}' else strftime(updated_at, '%Y-%m-%d %H:%M:%S') end updated_at from gone""")
def archive_table(s, d):
    """The table after archive_results' requests, each made twice."""
    asked = lens.entities(s, d).select(F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), F.when(F.col("doc_id") % 4 == 1, "src1").alias("owner_id"))
    after, _ = scd.archive(_state(s, d), asked.unionByName(asked), _now())
    return after.select("id", "status", "embedding_status", _stamp("valid_to"), _stamp("updated_at"))


@query(f"""with {REL}, n as (select count(*) n from documents), asked as (select doc_id seq, case when doc_id % 7 = 0 then 'x' || doc_id else doc_id::varchar end source_id, case when doc_id % 5 = 0 then 'y' || doc_id else (doc_id * 3 % n)::varchar end target_id, case when doc_id % 11 = 0 then '' else 'cites' end predicate from documents, n),
 done as (select *, case when source_id = target_id then 'self-loop' when seq % 7 = 0 then 'no source' when seq % 5 = 0 then 'no target' when predicate = '' then 'no predicate' else 'stored' end result from asked)
 select seq, result, case when result = 'stored' then source_id || '>' || target_id end edge, (select count(*) from rel) + (select count(*) from done where result = 'stored') total from done""")
def add_relations(s, d):
    n = _docs(s, d).count()
    i = F.col("doc_id")
    asked = _docs(s, d).select(
        i.alias("seq"), F.when(i % 7 == 0, F.concat(F.lit("x"), i)).otherwise(i.cast("string")).alias("source_id"), F.when(i % 5 == 0, F.concat(F.lit("y"), i)).otherwise((i * 3 % n).cast("string")).alias("target_id"),
        F.when(i % 11 == 0, "").otherwise("cites").alias("predicate"),
    )
    after, result = scd.add_relations(lens.relations(s, d), lens.entities(s, d), asked, _now())
    edges = after.where("predicate = 'cites'").select(F.col("source_id").try_cast("long").alias("seq"), F.concat_ws(">", "source_id", "target_id").alias("edge"))
    return result.join(edges, "seq", "left").join(F.broadcast(after.agg(F.count(F.lit(1)).alias("total"))))  # a single row


@query(f"""with {TAG}, loose as (select lower(replace(replace(replace(name, '-', ''), '_', ''), '#', '')) k, arg_min(id, made::varchar || id) id from tag group by 1),
 asked as (select doc_id::varchar entity_id, case doc_id % 4 when 0 then '#toxic' when 1 then 'SRC ' || doc_id % 3 when 2 then 'New Topic ' || doc_id % 7 else '#new_topic-' || doc_id % 7 end as name from documents),
 made as (select entity_id, case when name = '#toxic' then name when starts_with(name, 'SRC') then coalesce((select id from loose where k = 'src' || right(name, 1)), '?') else sha256('tag|newtopic' || right(name, 1)) end tag_id from asked)
 select entity_id, tag_id from et union select entity_id, tag_id from made""")
def tag_link(s, d):
    """Tags by their exact name, by another spelling, and new ones in two spellings."""
    i = F.col("doc_id")
    seven = (i % 7).cast("string")
    name = F.when(i % 4 == 0, F.lit("#toxic")).when(i % 4 == 1, F.concat(F.lit("SRC "), (i % 3).cast("string"))).when(i % 4 == 2, F.concat(F.lit("New Topic "), seven)).otherwise(F.concat(F.lit("#new_topic-"), seven))
    _, links = tagging.link(lens.tags(s, d), lens.entity_tags(s, d), _docs(s, d).select(i.cast("string").alias("entity_id"), name.alias("name")))
    return links


@query("""with e as (select *, user_id || '-' || strftime(ts, '%Y-%m-%d') session_id from events) select event_id id, event_type as type, props as content, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp
 from e where session_id = (select min(session_id) from e) order by ts, event_id""")
def session_events(s, d):
    e = lens.ledger(s, d)
    return events.session(e, e.agg(F.min("session_id")).first()[0]).select("id", "type", "content", _stamp("timestamp"))


SECRET = "AKIA" + "Q7" * 8


@query(f"""select sha256(doc_id || '|{AS_OF}|' || source || '|event|' || lang || ' {SECRET} end|||') id, '{AS_OF}' as timestamp, source agent_id, 'event' as type, lang || ' [REDACTED_SECRET] end' as content, null::varchar session_id from documents""")
def log_events(s, d):
    """Rows to append for a batch that gives neither types nor sessions; secrets go."""
    asked = _docs(s, d).select(F.col("doc_id").alias("seq"), F.col("source").alias("agent_id"), F.concat("lang", F.lit(f" {SECRET} end")).alias("content"))
    return events.event(asked, _now()).select("id", _stamp("timestamp"), "agent_id", "type", "content", "session_id")


@query(f"""with {ENT}, r as (select *, status <> 'archived' live, case doc_id % 6 when 0 then 'exact duplicate' when 1 then 'updated' when 2 then 'content is blank' when 3 then 'stored' when 4 then 'supersedes' else 'quality: CONVERSATIONAL_FLUFF' end want from ent),
 q as (select *, case when not live and doc_id % 6 in (0, 1, 4) then 'stored' else want end result from r)
 select doc_id seq, result, case when result = 'updated' then 'doc ' || id when result in ('stored', 'supersedes') then case when doc_id % 6 in (1, 4) then 'doc ' || id else 'Fresh ' || id end end title, case when result in ('stored', 'supersedes', 'updated') then 4 end weight,
 case when result = 'supersedes' then 1 when result = 'updated' then 4 else weight end old_weight, case when result = 'supersedes' then 1 else 0 end::bigint edges, case when result = 'updated' then 1 else 0 end::bigint versions from q""")
def store_batch(s, d):
    """A request about every entity: its own text, its title with a new text, a blank text, a new one, a text little changed, an acknowledgement."""
    i = F.col("doc_id")
    six, h = i % 6, F.sha2(F.col("id"), 512)

    def text(at: int):
        part = [F.substring(h, at + 8 * k, 8) for k in range(6)]
        return F.concat_ws(" ", F.lit("Report of the unit"), part[0], F.lit("and the plan for"), part[1], F.lit("with the list of"), part[2], F.lit("in the area of"), part[3], F.lit("to the end by"), part[4], F.lit("or"), part[5])

    ent = lens.entities(s, d).withColumn("full_content", text(1))
    known = ent.withColumn("content_hash", X.content_hash(F.col("full_content")))
    asked = ent.select(
        i.alias("seq"), "owner_id", F.when(six == 4, F.when(F.col("scope") == "shared", "private").otherwise("shared")).otherwise(F.col("scope")).alias("scope"), F.when(six.isin(1, 4), F.col("title")).otherwise(F.concat(F.lit("Fresh "), "id")).alias("title"),
        F.when(six == 0, F.col("full_content")).when(six.isin(1, 3), text(65)).when(six == 2, " ").when(six == 4, F.concat("full_content", F.lit(" again amended"))).otherwise("Consolidated these files.").alias("full_content"), F.lit(4).alias("weight"),
    )
    after, rel, result = storing.store(migrate(known, "entities"), migrate(lens.relations(s, d), "relations"), asked, _now(), warn=0.8, supersede=0.85)
    made = after.where("status <> 'archived'").select(F.col("id").alias("m"), "title", "weight")
    old = after.select(F.col("id").alias("o"), F.col("weight").alias("old_weight"))
    edges = rel.where("predicate = 'supersedes'").groupBy(F.col("target_id").alias("o")).agg(F.count(F.lit(1)).alias("edges"))
    past = after.where(F.col("id").contains("_h_")).groupBy(F.regexp_extract("id", "^(.*)_h_", 1).alias("o")).agg(F.count(F.lit(1)).alias("versions"))
    out = result.withColumn("o", F.col("seq").cast("string")).withColumn("m", F.when(F.col("result").isin("stored", "updated", "supersedes"), F.col("id"))).drop("id")
    out = out.join(made, "m", "left").join(old, "o").join(edges, "o", "left").join(past, "o", "left")
    return out.select("seq", "result", "title", "weight", "old_weight", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("versions", F.lit(0)).alias("versions"))


@query(f"""with recursive {ENT}, {REL}, edge as (select source_id, target_id from rel where {VALID}), walk as (select target_id id, 1 depth, [source_id, target_id] path from edge where source_id = '60' and target_id <> '60'
 union all select e.target_id, depth + 1, list_append(path, e.target_id) from walk w join edge e on e.source_id = w.id where depth < 5 and not list_contains(path, e.target_id))
 select id, title, min(depth) depth from walk join ent using (id) group by 1, 2""")
def dependency_depths(s, d):
    return graph.depths(lens.relations(s, d), "60", _now()).join(lens.entities(s, d).select("id", "title"), "id").select("id", "title", "depth")


@query(f"""with recursive {REL}, walk as (select '150' id, 0 depth union select target_id, depth + 1 from walk join rel on source_id = walk.id and predicate = 'derived_from' where depth < 10) select id, depth from walk""")
def lineage_edges(s, d):
    return graph.lineage_by_edges(lens.relations(s, d), "150", "derived_from")


LINEAGE = "walk as (select '150' id, 0 depth union select target_id, depth + 1 from walk join rel on source_id = walk.id and predicate = 'derived_from' where depth < 10)"


@query(f"""with recursive {ENT}, {REL}, {LINEAGE} select id, depth, title, status, null source_id, null target_id from walk join ent using (id)
 union all select null, null, null, null, source_id, target_id from rel where predicate = 'derived_from' and (source_id in (select id from walk) or target_id in (select id from walk))""")
def lineage_graph(s, d):
    """The nodes of a lineage, and all its edges that touch them."""
    nodes, edges = graph.lineage_graph(lens.entities(s, d), lens.relations(s, d), "150", "derived_from")
    return nodes.select("id", "depth", "title", "status").unionByName(edges.select("source_id", "target_id"), allowMissingColumns=True)


@query(f"""with {ENT}, {REL} select distinct e.id, case when k = 0 then e.id when k = 1 then t.target_id else u.source_id end near from ent e cross join range(3) k(k) left join rel t on t.source_id = e.id and k = 1
 left join rel u on u.target_id = e.id and k = 2 where status = 'consolidated' and near is not null""")
def one_hop(s, d):
    """Every consolidated row with the other ends of its edges."""
    return graph.one_hop(lens.relations(s, d), lens.entities(s, d).where("status = 'consolidated'"))


def _failing_embedder():
    """Raises for a batch with a certain word, as a model may for a text that it can't read."""
    plain = hashing_embedder(8)

    def embed(texts):
        if any("attion" in t for t in texts):
            raise ValueError("unreadable")
        return plain(texts)

    return embed


@query(f"""with {ENT} select case when status <> 'archived' and contains(full_content, 'attion') then 'failed' when status <> 'archived' then 'ready' else 'archived' end embedding_status, count(*) n,
 count(*) filter (where status <> 'archived' and not contains(full_content, 'attion')) n_vectors from ent group by 1""")
def embedding_failures(s, d):
    """Texts that the embedder can't read fail alone, however they are batched."""
    ent = lens.entities(s, d).withColumn("embedding_status", F.when(F.col("status") == "archived", "archived").otherwise("pending"))
    none = s.createDataFrame([], TABLES["embeddings"])
    after, vectors = backfill(ent, none, _failing_embedder)
    held = after.join(vectors.select("entity_id"), F.col("id") == F.col("entity_id"), "left")
    return held.groupBy("embedding_status").agg(F.count(F.lit(1)).alias("n"), F.count("entity_id").alias("n_vectors"))


@query(f"with {ENT} select id, case when status = 'archived' then embedding_status else 'ready' end embedding_status, status <> 'archived' and embedding_status = 'pending' or doc_id in (select vec_id from embeddings) has_vector from ent")
def embedding_backfill(s, d):
    """Pending rows get vectors and become ready; those of others stay."""
    ent = lens.entities(s, d)
    emb = lens.vectors(s, d).select(F.col("id").cast("string").alias("entity_id"), "embedding")
    after, vectors = backfill(ent, emb)
    have = vectors.select(F.col("entity_id").alias("v")).distinct()
    return after.join(have, F.col("id") == F.col("v"), "left").select("id", "embedding_status", F.col("v").isNotNull().alias("has_vector"))
