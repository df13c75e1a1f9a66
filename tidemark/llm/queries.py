"""The registered queries of this package, and their SQL."""

from __future__ import annotations

import public_tokenizers

from tidemark.llm import (
    jaccard,
    merkle,
    mixing,
    packing,
    pseudo_lm,
    recipes,
    repeats,
    sharding,
    toxicity,
    url_filter,
    variants,
    warc,
    winnow,
)
from tidemark.llm.common import table
from tidemark.llm.url_labels import labelled_urls
from tidemark.session import ship_package

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES = {}
ORACLE = {}


def register(fn):
    def run(spark, folder):
        return fn(ship_package(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


@register
def op1_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), TOKENIZER)


@register
def op2_sharding(spark, folder):
    return sharding.deal_shards(table(spark, folder, "documents"))


@register
def op3_toxicity(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op4_exact_dedup(spark, folder):
    return recipes.exact_groups(table(spark, folder, "documents")).drop("row")


ORACLE["op4_exact_dedup"] = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


@register
def op5_fingerprints(spark, folder):
    return winnow.fingerprints(table(spark, folder, "documents"))


@register
def op6_lm_scoring(spark, folder):
    return pseudo_lm.score_documents(table(spark, folder, "documents"))


@register
def op7_ngram_jaccard(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents")).drop("row", "root")


@register
def op8_source_mix(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents"))


@register
def op9_substring_dedup(spark, folder):
    return repeats.remove_repeats(table(spark, folder, "documents"))


ORACLE["op9_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, unnest(range(1, len(words) - 33)) as i, words from w where len(words) >= 35),
h as (select doc_id, i, array_to_string(words[i:i + 34], ' ') as passage from s),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by passage) as n from h) where n > 1),
c as (select distinct doc_id, unnest(range(i, i + 35)) as j from r),
k as (select doc_id, list(j) as gone from c group by doc_id),
f as (select w.doc_id, words,
             list_filter(range(1, len(words) + 1), lambda j: not list_contains(coalesce(gone, []), j)) as kept
      from w left join k using (doc_id))
select doc_id, len(words)::bigint as n_words, (len(words) - len(kept))::bigint as n_removed,
       sha256(coalesce(array_to_string(list_select(words, kept), ' '), '')) as kept_sha256
from f
"""


@register
def op10_warc_index(spark, folder):
    return warc.archive_pages(table(spark, folder, "pages"))


ORACLE["op10_warc_index"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as hex,
             max(page_id) over (partition by html) as last from p)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(hex, ((i // 8) * 10 + 1)::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31))::int, 1)), '')
         as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type,
       case when page_id <> last then last end as refers_to
from d
"""


#: (action, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@register
def op11_url_filter(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.judge_urls(table(spark, folder, "pages"), rules, labelled_urls(spark))


@register
def op12_spelling_variants(spark, folder):
    return variants.group_variants(table(spark, folder, "documents"))


@register
def op13_merkle_manifest(spark, folder):
    return merkle.prove_rows(table(spark, folder, "documents"))
