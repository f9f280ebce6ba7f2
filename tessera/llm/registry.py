"""The queries of this subpackage, as opN_<name>, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audio, bpe, fill_middle, hamerly, line_crf, ngram_lm, packing, pii, scaled_sketch, sharding, simhash, warc, wrapper
from tessera.llm.common import table

BPE_JSON, BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: A caller with real data passes a secret of its own.
PII_KEY = "public example key"
CLUSTERS, ROUNDS = 8, 10


def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = ngram_lm.classify(docs, ngram_lm.trusted_ids(table(spark, sf_dir, "labels")))
    return out.withColumn("perplexity", F.round("perplexity", 6)).withColumn("mean_cost", F.round("mean_cost", 6))


def op3_line_crf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.apply_rules(docs, chain).drop("text")


def op4_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count_col="n_entities")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.deduplicated(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_JSON), public_tokenizers.PATTERN, end_id=1, max_length=2048, added=True)


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    stored = audio.store_wav(docs.select("doc_id", n.alias("n_bytes"), audio.padded_payload(F.col("text")).alias("payload")), "payload").drop("payload")
    read = audio.audio_features(stored)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"), F.octet_length("wav").cast("long").alias("media_bytes"), F.sha2("wav", 256).alias("media_sha256"), audio.feature_digest().alias("feature"),
    )


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    out = bpe.decode(ids, ranks, pattern)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hamerly.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), clusters=CLUSTERS, rounds=ROUNDS)
    return out.drop("embedding")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaled_sketch.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return out.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), scaled_sketch.hex_digits(own).alias("fingerprint"), scaled_sketch.hex_digits(edited).alias("edited_fingerprint"),
        scaled_sketch.likeness(own, edited).alias("near_edited"), scaled_sketch.likeness(own, following).alias("near_next"),
    )


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 counts in every document before its labels are drawn on."""
    none = line_crf.Chain(np.zeros(line_crf.N_FEATURES), np.zeros((2, 2)))
    return line_crf.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), none).select("doc_id", *[n for n, _ in line_crf.RULES[:6]])


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 stores and reads back of every document: its payload."""
    return op9_audio_features(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7's shards: rows, bytes, and whether slots are gapless and equal texts together; and whether no shard is above an even share by more than its largest group."""
    out = op7_minimax_shards(spark, sf_dir)
    whole = out.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("shards")).agg(F.max("shards").alias("most"))
    each = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"))
    return each.agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("rows"), F.sum((F.col("slots") == F.col("n")).cast("long")).alias("distinct_slots"), F.sum((F.col("last") + 1 == F.col("n")).cast("long")).alias("gapless")).join(F.broadcast(whole.select(F.col("most").cast("long").alias("shards_of_a_text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_components, op2_kneser_ney_quality, op3_line_crf_rules, op4_wrapper_text, op5_pii_surrogates, op6_warc_revisits, op7_minimax_shards, op8_pow2_packing, op9_audio_features, op10_bpe_roundtrip, op11_hamerly_clusters, op12_fill_middle, op13_scaled_sketches, line_counts, media_payloads, shard_sizes)
}


def _cluster_sql() -> str:
    """Plain rounds, each a table: every vector against every centroid."""
    near = "select v.vec_id, v.x, arg_min(struct_pack(k := c.k, d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.k)) s from v, c{i} c group by v.vec_id, v.x"
    steps = [
        "v as materialized (select vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::hugeint) x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 k, x from (select * from v order by sha256('3:' || vec_id) limit {CLUSTERS}))",
    ]
    for i in range(ROUNDS):
        steps.append(f"a{i} as materialized ({near.format(i=i)})")
        mean = f"select k, list(floor_div order by i) x from (select s.k k, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::hugeint floor_div from a{i}, range(1, 65) r(i) group by all) group by k"
        steps.append(f"c{i + 1} as materialized (select c.k, coalesce(m.x, c.x) x from c{i} c left join ({mean}) m on m.k = c.k)")
    steps.append(f"a as materialized ({near.format(i=ROUNDS)})")
    return "with " + ",\n ".join(steps) + f"""
 select vec_id, s.k::int as "cluster", s.d::bigint as distance, (sum(s.d) over (partition by s.k))::bigint cluster_inertia, (sum(s.d) over ())::bigint inertia, sha256(array_to_string(list_transform(c.x, lambda e: e::varchar), ',')) centroid_sha256
 from a join c{ROUNDS} c on c.k = a.s.k"""


#: The others need XXH64, trained models, tokenizers, audio, wrappers, surrogates or a search for the least capacity; tests
#: hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_warc_revisits": """with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) h, max(page_id) over (partition by coalesce(html, '')) kept from pages)
 select page_id, n::bigint payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i // 4 * 5 + 1, 5))::bigint >> (15 - i % 4 * 5)) & 31) + 1, 1)), '') payload_digest,
 case when page_id = kept then 'response' else 'revisit' end record_type, case when page_id <> kept then kept end refers_to from p""",
    "line_counts": r"""with t as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, string_split(coalesce(text, ''), chr(10)) l from documents),
 g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') s from t, unnest(range(1, greatest(len(w) - 3, 1))) u(i)), d as (select doc_id, i, count(*) over (partition by doc_id, s) c from g),
 r as (select doc_id, count(distinct i + k) n from d, range(5) x(k) where c > 1 group by 1),
 n as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) k from t)
 select doc_id, n_words, word_chars, n_symbols, (len(k) - len(list_distinct(k)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, n_words < 10 or 100 * coalesce(r.n, 0) > 20 * n_words base_failed from n left join r using (doc_id)""",
    "media_payloads": """with t as (select doc_id, coalesce(text, '') t, octet_length(encode(coalesce(text, ''))) n from documents), p as (select *, greatest(1, (n + 191) // 192) * 192 m from t)
 select doc_id, n::bigint n_bytes, m::bigint payload_bytes, sha256(t || repeat(' ', m - n)) payload_sha256 from p""",
    "shard_sizes": "select 24::bigint shards, count(*)::bigint as \"rows\", 24::bigint distinct_slots, 24::bigint gapless, 1::bigint shards_of_a_text from documents",
    "op11_hamerly_clusters": _cluster_sql(),
    "op12_fill_middle": """with t as (select doc_id, coalesce(text, '') t, string_split(coalesce(text, ''), chr(10)) l, sha256('7:' || doc_id) h from documents),
 u as (select *, len(l) - case when t = '' or t like '%' || chr(10) then 1 else 0 end n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, 1 + 8 * i, 8))::bigint) r from t),
 w as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) i, greatest(r[1] % (n + 1), r[2] % (n + 1)) j, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end form from u),
 c as (select *, case when i = 0 then 0 else least(length(t), list_sum(list_transform(l[1:i], lambda x: length(x) + 1))) end::bigint a, case when j = 0 then 0 else least(length(t), list_sum(list_transform(l[1:j], lambda x: length(x) + 1))) end::bigint b from w),
 p as (select *, substr(t, 1, a) p, substr(t, a + 1, b - a) m, substr(t, b + 1) s from c)
 select doc_id, n::bigint n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from p""",
}
