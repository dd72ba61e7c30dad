"""Registered queries of this subpackage and their SQL, keyed op1 to op13."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tallybook.llm import byte_bpe, fingerprints, hard_negatives, licenses, ngram_jaccard, packing, prefix_trie, quality, secret_scan, token_files, topk, url_rules, warc

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_jaccard_query(spark, sf_dir):
    """Three-word shingles, Jaccard of 0.9 or more."""
    return ngram_jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def fingerprint_query(spark, sf_dir):
    return fingerprints.neighbour_likeness(_table(spark, sf_dir, "documents"))


def packing_query(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), capacity=2048, end_id=0)


def quality_query(spark, sf_dir):
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def topk_query(spark, sf_dir):
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, scale=64.0)


def license_query(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def byte_bpe_query(spark, sf_dir):
    return byte_bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def secret_query(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, secret_scan.fit_secrets(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind, *_ in secret_scan.BASE], F.sha2(secret_scan.span_text("base_spans"), 256).alias("base_sha256"), secret_scan.span_text("all_spans").alias("spans"))


def token_file_query(spark, sf_dir):
    folder, manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)
    return token_files.read_token_digests(folder, manifest)


def url_query(spark, sf_dir):
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), rules)


def warc_query(spark, sf_dir):
    return warc.archived_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def prefix_trie_query(spark, sf_dir):
    """Conversations share heads of up to five turns with the first conversation of their hundred."""
    turns = prefix_trie.saved(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations")), "ordered")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(turns, 100, head, most=5))


def hard_negative_query(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", label=label)


QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard_query,
    "op2_fingerprints": fingerprint_query,
    "op3_packing": packing_query,
    "op4_quality": quality_query,
    "op5_top_k": topk_query,
    "op6_licenses": license_query,
    "op7_byte_bpe": byte_bpe_query,
    "op8_secrets": secret_query,
    "op9_token_files": token_file_query,
    "op10_url_rules": url_query,
    "op11_warc": warc_query,
    "op12_prefix_trie": prefix_trie_query,
    "op13_hard_negatives": hard_negative_query,
}

_TOP_K = """
with v as (
  select row_number() over () uid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) e
  from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id query_id, q.uid quid, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) score
  from v q join v c on q.uid <> c.uid and len(q.e) = len(c.e) where q.vec_id % 20 = 0
)
select query_id, cast(row_number() over (partition by quid order by score desc, vec_id nulls last) as integer) rank, vec_id, score from s
qualify row_number() over (partition by quid order by score desc, vec_id nulls last) <= 20"""

_URLS = """
with p as (
  select row_number() over () r, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) path from pages
), rules(rule_host, rule_path, rule_verdict) as (values {rules})
select page_id, host, path, rule_host || rule_path rule, coalesce(rule_verdict, 'allow') verdict from p
left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
qualify row_number() over (partition by r order by length(rule_host || rule_path) desc, length(rule_host) desc, rule_host || rule_path desc) = 1""".format(
    rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_rules.RULES))

_WARC = """
with p as (select row_number() over () r, page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d from pages
), f as (select d, min(page_id) first from p where n >= 100 group by d)
select page_id, n payload_bytes, p.d payload_digest, case when first is distinct from page_id and first is not null then 'revisit' else 'response' end record_type,
  case when first is distinct from page_id then first end refers_to
from p left join f using (d)"""

_TRIE = """
with recursive t as (
  select conv_id c, row_number() over (partition by conv_id order by turn nulls first) pos, coalesce(role, '') r, coalesce(text, '') t
  from conversations where conv_id is not null
), code(c, crc, left_over) as (
  select c, 4294967295::bigint, cast(c as varchar) from (select distinct c from t)
  union all
  select c, list_reduce(list_prepend(xor(crc, ascii(left_over)::bigint), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, z: xor(v >> 1, case when v % 2 = 1 then 3988292384 else 0 end)), substr(left_over, 2) from code where left_over <> ''
), h as (select c, xor(crc, 4294967295) % 6 h, c - c % 100 b from code where left_over = ''
), rows_ as (
  select h.c, t.pos, r, t from h join t on t.c = h.b where t.pos <= h
  union all select h.c, t.pos + 1000000, r, t from h join t on t.c = h.c where t.pos > h
), seq as (select c, row_number() over (partition by c order by pos) d, md5(length(r) || ':' || r || t) k, length(t) n from rows_
), pre as (
  select c, d, n, md5(string_agg(k, '') over (partition by c order by d rows unbounded preceding)) k from seq
  union all select c, 0, 0, '' from h
), node as (select k, d, min(c) c, count(*) n_convs, (count(*) - 1) * max(n) saved from pre group by k, d
), parent as (select node.*, up.k up from node left join pre up on up.c = node.c and up.d = node.d - 1
), kids as (select up k, count(*) n from parent where up is not null group by up
), own as (select parent.*, coalesce(kids.n, 0) n_children from parent left join kids using (k)
), total as (
  select pre.k, cast(sum((own.n_children = 0)::int) as bigint) n_leaves, cast(sum(own.saved) as bigint) saved_tokens
  from own join pre on pre.c = own.c and pre.d <= own.d group by pre.k
), ends as (
  select pre.k, sha256(string_agg(cast(c as varchar), ',' order by c)) e from pre join (select c, max(d) d from pre group by c) using (c, d) group by pre.k
)
select own.c conv_id, own.d depth, p.c parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, coalesce(e, sha256('')) ends_sha256
from own join total using (k) left join ends using (k) left join node p on p.k = own.up"""

_NEGATIVES = """
with v as (
  select row_number() over () uid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
    list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.uid, a.vec_id anchor_id, c.uid cuid, c.vec_id, a.label = c.label same, cast(coalesce(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])), 0) as bigint) score
  from v a join v c on a.uid <> c.uid and len(a.e) = len(c.e) where a.vec_id % 100 = 0
), p as (select * from s where same qualify row_number() over (partition by uid order by score desc, vec_id nulls last) <= 5)
select p.anchor_id, p.vec_id positive_id, cast(row_number() over w as integer) rank, n.vec_id negative_id, p.score positive_score, n.score negative_score
from p join s n on n.uid = p.uid and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
window w as (partition by p.uid, p.cuid order by n.score desc, n.vec_id nulls last) qualify row_number() over w <= 5"""

ORACLES = {"op13_hard_negatives": _NEGATIVES, "op11_warc": _WARC, "op12_prefix_trie": _TRIE, "op5_top_k": _TOP_K, "op6_licenses": licenses.oracle(), "op10_url_rules": _URLS}
