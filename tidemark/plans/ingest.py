"""Registered queries of ingestion, stored tables and orders, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import meta as M
from tidemark.functions import scope as S
from tidemark.functions import text as T
from tidemark.functions import workflow as W
from tidemark.operators import automaton as A
from tidemark.operators import chunk as K
from tidemark.operators import corpus as C
from tidemark.operators import crm
from tidemark.operators import layout as LY
from tidemark.operators import library as LB
from tidemark.operators import rules as R
from tidemark.operators import trends as TR
from tidemark.operators.keyed import number_rows
from tidemark.plans import inputs as I
from tidemark.plans import oracle as O
from tidemark.plans import queries as Q
from tidemark.plans import review as V
from tidemark.plans.oracle import ORACLE, strip, text
from tidemark.plans.queries import query
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import readers, writers
from tidemark.sources.readers import spread, table, token_documents
from tidemark.sources.writers import VersionedTable
from tidemark.streaming import jobs

ID = "CAST(doc_id AS VARCHAR(20))"

# --- stored files -------------------------------------------------------------------------

FILES = [
    "doc_id",
    f"CASE WHEN doc_id % 10 = 9 THEN 'README' ELSE 'doc_' || {ID} END AS stem",
    f"'kb/' || CASE WHEN doc_id % 10 = 9 THEN 'README' ELSE 'doc_' || {ID} END || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END AS path",
    f"{I.pick('doc_id', ['Market_Law', 'technical_reference', 'brand_policy'])} AS category",
    f"""CASE doc_id % 4
      WHEN 0 THEN '```json' || chr(10) || '{{"doc_id": "d' || {ID} || '", "title": "T ' || {ID} || '", "source_category": "' || {I.pick('doc_id', ['Market_Law', 'technical_reference', 'brand_policy'])}
        || '", "region": "us", "is_global_fallback": "Yes"}}' || chr(10) || '```' || chr(10) || chr(10) || text
      WHEN 1 THEN '---' || chr(10) || 'doc_id: f' || {ID} || chr(10) || 'title:  Front: ' || {ID} || chr(10) || 'no field' || chr(10) || 'region: eu' || chr(10) || '---' || chr(10) || text
      WHEN 2 THEN text
      ELSE '```json {{broken' || chr(10) || text END AS content""",
    "text AS inner_text",
]
_FILES = f"files AS ({I.sql(FILES, 'documents')})"


def _files(spark, folder):
    return I.rows(spark, folder, "documents", FILES).withColumn("text", F.col("content"))


@query
def source_documents(spark, folder):
    """Stored files as normalised source documents: header, defaults, allow-list."""
    docs = C.source_documents(_files(spark, folder).select("path", "text"))
    return docs.select("path", "doc_id", "source_title", "source_category", "country_code", "is_global_fallback", F.md5("body").alias("digest"))


ORACLE["source_documents"] = f"""WITH {_FILES}
SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'd' || doc_id ELSE stem END AS doc_id, CASE WHEN doc_id % 4 = 0 THEN 'T ' || doc_id ELSE stem END AS source_title,
  CASE WHEN doc_id % 4 = 0 THEN lower(category) ELSE 'platform_policy' END AS source_category, CASE WHEN doc_id % 4 = 0 THEN 'US' ELSE 'GLOBAL' END AS country_code,
  doc_id % 4 = 0 AS is_global_fallback, md5(CASE WHEN doc_id % 4 = 0 THEN {strip('inner_text')} ELSE {strip('content')} END) AS digest
FROM files WHERE stem <> 'README' AND {strip("CASE WHEN doc_id % 4 = 0 THEN inner_text ELSE content END")} <> ''
  AND (doc_id % 4 <> 0 OR lower(category) IN ({', '.join(text(c) for c in fixed.RELEVANT_CATEGORIES)}))"""


@query
def knowledge_files(spark, folder):
    """Stored files of the lexical path: front matter or JSON header, and the token set."""
    docs = C.knowledge_documents(_files(spark, folder).select("path", "text"))
    return docs.select("path", "doc_id", "source_title", "country_code", F.size("tokens").alias("tokens"))


_BODY = f"CASE WHEN doc_id % 4 < 2 THEN {strip('inner_text')} ELSE content END"
ORACLE["knowledge_files"] = f"""WITH {_FILES}
SELECT path, CASE doc_id % 4 WHEN 0 THEN 'd' || doc_id WHEN 1 THEN 'f' || doc_id ELSE stem END AS doc_id,
  CASE doc_id % 4 WHEN 0 THEN 'T ' || doc_id WHEN 1 THEN 'Front: ' || doc_id ELSE 'Doc ' || doc_id END AS source_title,
  CASE doc_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'EU' ELSE '' END AS country_code, len(list_distinct({O.TOKENS.format(_BODY)})) AS tokens
FROM files WHERE stem <> 'README' AND {_BODY} <> ''"""


@query
def document_tokens(spark, folder):
    """Distinct tokens of every document."""
    return token_documents(spread(table(spark, folder, "documents"))).select("doc_id", F.size("tokens").alias("tokens"))


ORACLE["document_tokens"] = f"SELECT doc_id, len(list_distinct({O.TOKENS.format('text')})) AS tokens FROM documents"


@query
def stored_round_trip(spark, folder):
    """Documents in their stored text form, read back."""
    docs = spread(table(spark, folder, "documents"))
    title = F.concat(F.lit('T "'), F.col("doc_id").cast("string"), F.lit('" \\ é'))
    meta = F.struct(title.alias("title"), F.col("lang").alias("language"), F.col("doc_id").alias("n"))
    kept = docs.select("doc_id", M.json_header(M.document_file(meta, F.col("text"))).alias("h"))
    m = F.col("h.metadata")
    return kept.select("doc_id", m["title"].alias("title"), m["language"].alias("language"), m["n"].alias("n"), F.md5("h.body").alias("digest"))


ORACLE["stored_round_trip"] = f"""SELECT doc_id, 'T "' || doc_id || '" \\ é' AS title, lang AS language, CAST(doc_id AS VARCHAR) AS n,
  md5({strip('text')}) AS digest FROM documents"""



def _folder(spark, name):
    """A new folder in the one that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def document_files(spark, folder):
    """Documents written as markdown files with sidecars, and read back from both."""
    rows = I.rows(spark, folder, "documents", DIRECT)
    names = ["title", "category", "market", "region", "platform", "language", "priority", "notes", "source_url"]
    key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    docs = rows.select(key.alias("source_id"), M.upload_metadata({n: F.col(n) for n in names}, key, F.lit("2024-01-01")).alias("metadata"), "body")
    path = _folder(spark, "files")
    names = writers.document_files(docs, path)
    texts = C.source_documents(readers.markdown_sources(spark, path, names=names))
    side = readers.metadata_files(spark, path, names).select("source_id", F.col("title").alias("side_title"), "region", "priority")
    return texts.join(side, F.col("doc_id") == F.col("source_id")).select(
        "doc_id", "source_title", "side_title", "source_category", "platform", "region", side["priority"], F.md5("body").alias("digest")
    )


_CATEGORIES = ", ".join(text(c) for c in fixed.RELEVANT_CATEGORIES)


@query
def raw_file_pages(spark, folder):
    """Raw html files, written and read as bytes: their pages, and the size of each file."""
    path = _folder(spark, "raw")
    pages = spread(table(spark, folder, "pages")).select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    named = pages.select(F.concat(F.lit("page_"), "page_id", F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    files = readers.raw_files(spark, path, writers.raw_files(named, path))
    return readers.raw_pages(files, "suffix", "size").select("source_id", "suffix", "size", F.md5("html").alias("digest"))


ORACLE["raw_file_pages"] = """SELECT 'page_' || page_id AS source_id, '.html' AS suffix, octet_length(encode(coalesce(html, ''))) AS size,
  md5(coalesce(html, '')) AS digest FROM pages"""

# --- uploads ------------------------------------------------------------------------------

UPLOADS = [
    "doc_id",
    f"'f' || {ID} || {I.pick('doc_id', ['.md', '.TXT', '.html', '.exe', '', '.markdown', '.pdf'])} AS filename",
    "CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN '  ' ELSE text END AS content_text",
    "CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS latin",
]


def _uploads(spark, folder):
    rows = I.rows(spark, folder, "documents", UPLOADS)
    plain = F.col("content_text").rlike(r"^[\x00-\x7f]+$")
    # a byte that is no UTF-8 before an ASCII text
    content = F.encode("content_text", "UTF-8")
    content = F.when((F.col("latin") == 1) & plain, F.concat(F.unhex(F.lit("E9")), content)).otherwise(content)
    return rows.select(F.col("doc_id").alias("upload_no"), "filename", content.alias("content"))


@query
def upload_checks(spark, folder):
    """Accepted uploads with their decoded text, refused ones with the reason."""
    accepted, refused = LB.check_uploads(_uploads(spark, folder))
    kept = accepted.select("upload_no", "suffix", F.lit("").alias("error"), F.md5(T.decode_bytes("content")).alias("digest"))
    return kept.unionByName(refused.select("upload_no", M.file_suffix(F.col("filename")).alias("suffix"), "error", F.lit("").alias("digest")))


ORACLE["upload_checks"] = f"""WITH uploads AS ({I.sql(UPLOADS, 'documents')}),
shaped AS (SELECT doc_id AS upload_no, lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) AS suffix, content_text,
  CASE WHEN latin = 1 AND regexp_full_match(content_text, '[\\x00-\\x7f]+') THEN 'é' || content_text ELSE content_text END AS body FROM uploads),
judged AS (SELECT *, CASE WHEN body = '' THEN {text(fixed.UPLOAD_EMPTY)} WHEN suffix NOT IN ({', '.join(text(s) for s in fixed.RAW_SUFFIXES + fixed.DIRECT_SUFFIXES)}) THEN {text(fixed.UPLOAD_SUFFIX)}
  WHEN suffix IN ({', '.join(text(s) for s in fixed.DIRECT_SUFFIXES)}) AND {strip('body')} = '' THEN {text(fixed.UPLOAD_BLANK)} ELSE '' END AS error FROM shaped)
SELECT upload_no, suffix, error, CASE WHEN error = '' THEN md5(body) ELSE '' END AS digest FROM judged"""

DIRECT = [
    "doc_id",
    f"'Title ' || {ID} AS title",
    f"{I.pick('doc_id', ['market_law', 'brand_policy', 'platform_policy'])} AS category",
    f"{I.pick('doc_id', ['us', 'EU', '', 'global', 'uk'])} AS market",
    f"{I.pick('doc_id', ['', 'amer', 'EU', 'x'])} AS region",
    f"{I.pick('doc_id', ['TikTok', '', 'ALL'])} AS platform",
    "lang AS language",
    f"{I.pick('doc_id', ['', 'p0', 'P1', 'p3'])} AS priority",
    "source AS notes",
    "'' AS source_url",
    "CASE WHEN doc_id % 3 = 0 THEN '  # Own heading' || chr(10) || text ELSE chr(10) || text END AS body",
]


@query
def upload_metadata(spark, folder):
    """Metadata and titled body of direct uploads."""
    rows = I.rows(spark, folder, "documents", DIRECT)
    names = ["title", "category", "market", "region", "platform", "language", "priority", "notes", "source_url"]
    meta = M.upload_metadata({n: F.col(n) for n in names}, F.col("doc_id").cast("string"), F.lit("2024-01-01"))
    got = rows.withColumns({"m": meta, "titled": M.add_title(F.col("body"), F.col("title"))})
    shown = ["source_id", "platform", "region", "region_pack", "document_type", "language", "priority", "source_type", "country_code", "is_global_fallback"]
    return got.select("doc_id", *[F.col(f"m.{n}").alias(n) for n in shown], F.md5("titled").alias("digest"))


ORACLE["upload_metadata"] = f"""WITH u AS ({I.sql(DIRECT, 'documents')})
SELECT doc_id, CAST(doc_id AS VARCHAR) AS source_id, CASE platform WHEN '' THEN 'all' ELSE lower(platform) END AS platform, CASE market WHEN '' THEN 'GLOBAL' ELSE upper(market) END AS region,
  CASE region WHEN '' THEN 'GLOBAL' ELSE upper(region) END AS region_pack, category AS document_type, CASE language WHEN '' THEN 'en' ELSE lower(language) END AS language,
  CASE priority WHEN '' THEN 'P2' ELSE upper(priority) END AS priority, CASE category WHEN 'market_law' THEN 'law' ELSE 'policy' END AS source_type,
  CASE upper(market) WHEN '' THEN '' WHEN 'GLOBAL' THEN '' WHEN 'EU' THEN '' WHEN 'UK' THEN 'GB' ELSE upper(market) END AS country_code, upper(market) IN ('GLOBAL', 'EU') AS is_global_fallback,
  md5(CASE WHEN doc_id % 3 = 0 THEN body ELSE '# ' || title || chr(10) || chr(10) || regexp_replace(body, '^\\s+', '') END) AS digest FROM u"""

ORACLE["document_files"] = f"""WITH u AS ({I.sql(DIRECT, 'documents')})
SELECT 'doc_' || doc_id AS doc_id, title AS source_title, title AS side_title, CASE category WHEN '' THEN 'platform_policy' ELSE lower(category) END AS source_category,
  CASE platform WHEN '' THEN 'all' ELSE lower(platform) END AS platform, CASE market WHEN '' THEN 'GLOBAL' ELSE upper(market) END AS region,
  CASE priority WHEN '' THEN 'P2' ELSE upper(priority) END AS priority, md5({strip('body')}) AS digest
FROM u WHERE {strip('body')} <> '' AND (category = '' OR lower(category) IN ({_CATEGORIES}))"""

# --- catalog, index, snapshots ------------------------------------------------------------

RAW = [
    f"'raw/doc_' || CAST(doc_id * 2 AS VARCHAR(20)) || {I.pick('doc_id', ['.html', '.PDF'])} AS path",
    "text AS markdown",
]


@query
def raw_documents(spark, folder):
    """Raw files with their catalog entry; a file without one is an error row."""
    raw = I.rows(spark, folder, "documents", RAW).withColumn("extra", F.create_map().cast("map<string,string>"))
    docs, errors = C.normalise_raw(raw, I.rows(spark, folder, "documents", I.CATALOG), F.lit("2024-01-01"))
    m = F.col("metadata")
    kept = docs.select("source_id", m["title"].alias("title"), m["country_code"].alias("country_code"), m["source_type"].alias("source_type"), F.lit("").alias("error"))
    none = F.lit(None).cast("string")
    return kept.unionByName(errors.select("source_id", none.alias("title"), none.alias("country_code"), none.alias("source_type"), "error"))


ORACLE["raw_documents"] = f"""WITH catalog AS ({I.sql(I.CATALOG, 'documents')}), raw AS (SELECT 'doc_' || (doc_id * 2) AS source_id FROM documents)
SELECT r.source_id, c.title, CASE WHEN c.id IS NULL THEN NULL WHEN c.market IN ('GLOBAL', 'EU', 'INTERNAL') THEN '' WHEN c.market = 'UK' THEN 'GB' ELSE c.market END AS country_code,
  CASE WHEN c.id IS NULL THEN NULL WHEN {O.lookup('c.category', fixed.DOCUMENT_TYPES, 'c.category')} = 'market_law' THEN 'law' ELSE 'policy' END AS source_type,
  CASE WHEN c.id IS NULL THEN 'Missing source catalog entry for ' || r.source_id ELSE '' END AS error
FROM raw r LEFT JOIN catalog c ON c.id = r.source_id"""


@query
def catalog_upsert(spark, folder):
    """The catalog after new entries, of which the last of each id counts."""
    base = I.rows(spark, folder, "documents", I.CATALOG)
    fresh = table(spark, folder, "labels").select(
        F.concat(F.lit("doc_"), (F.col("doc_id") % 50 * 9).cast("string")).alias("id"),
        F.concat(F.lit("New "), F.col("doc_id").cast("string")).alias("title"), "doc_id",
        *[F.lit("x").alias(c) for c in LB.CATALOG_FIELDS if c not in ("id", "title")],
    )
    return LB.upsert_catalog(base, LB.catalog_by_id(fresh, "doc_id")).select("id", "title", "category")


ORACLE["catalog_upsert"] = f"""WITH base AS ({I.sql(I.CATALOG, 'documents')}),
fresh AS (SELECT 'doc_' || (doc_id % 50 * 9) AS id, 'New ' || max(doc_id) AS title, 'x' AS category FROM labels GROUP BY 1)
SELECT id, title, category FROM fresh UNION ALL SELECT id, title, category FROM base WHERE id NOT IN (SELECT id FROM fresh)"""


@query
def index_write(spark, folder):
    """The chunk index as it is read back after a write."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    writers.index(K.chunk_documents(I.knowledge(spark, folder)), path, "2024-01-01")
    return writers.read_index(spark, path).select("chunk_id", "doc_id", "source_category", "built_at", F.md5("text").alias("digest"))


ORACLE["index_write"] = f"""WITH {O.CHUNKS} SELECT chunk_id, doc_id, source_category, '2024-01-01' AS built_at, md5(text) AS digest FROM chunks"""


@query
def incremental_index(spark, folder):
    """The index after two batches of its stream job: all documents, some still without text, then all as they are now."""
    docs = I.knowledge(spark, folder).withColumn("no", F.col("doc_id").cast("bigint"))
    late = F.col("no") % 7 == 0
    first = docs.withColumns({"body": F.when(late, F.lit("To be written.")).otherwise(F.col("body")), "mtime": F.lit(0)})
    second = docs.withColumn("mtime", F.when(late, 1).otherwise(0))
    chunks = VersionedTable(spark, _folder(spark, "versions"), ["doc_id"])
    job = jobs.index_job(chunks, Q.MD5)
    for batch, rows in enumerate((first, second)):
        job(rows.withColumn("size", F.length("body").cast("bigint")).drop("no"), batch)
    return chunks.read().select("chunk_id", "doc_id", "mtime", "size", F.md5("text").alias("digest"))


ORACLE["incremental_index"] = f"""WITH {O.CHUNKS}, k AS ({I.sql(I.KNOWLEDGE, 'documents')})
SELECT chunk_id, doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS mtime, length(k.body) AS size, md5(text) AS digest
FROM chunks JOIN k USING (doc_id)"""


def review_inputs(spark, folder):
    """(requests, index, users): every document as a script, against the chunks of all."""
    scripts = spread(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("script"), (F.col("doc_id") % 40 + 100001).alias("user_id"),
        F.expr(I.pick("doc_id", ["tiktok", "instagram", "youtube"])).alias("target_platform"),
    )
    return scripts, V.build_index(I.knowledge(spark, folder), Q.MD5), I.rows(spark, folder, "customer", I.USERS)


@query
def continuous_review(spark, folder):
    """Every document reviewed as a script that arrives in a stream of files, against the index of its batch."""
    scripts, index, users = review_inputs(spark, folder)
    arriving, chunks, out = _folder(spark, "scripts"), VersionedTable(spark, _folder(spark, "versions")), _folder(spark, "reports")
    # an excerpt is the front of its text, and made of it where it is read
    chunks.replace(index.drop("excerpt"))
    scripts.write.option("compression", "zstd").parquet(arriving)
    stream = spark.readStream.schema(scripts.schema).parquet(arriving)
    jobs.start(stream, jobs.review_job(chunks, users, out, Q.MD5), _folder(spark, "stream")).awaitTermination()
    return review_outcome(spark.read.parquet(out))


def review_outcome(reports):
    listed = F.transform("report_issues", lambda i: F.concat_ws("|", i["issue_type"], i["risk_level"], i["excerpt"]))
    return reports.select(
        "request_id", "overall_status", "evidence_count", "route", F.size("report_issues").alias("issues"),
        F.md5(F.array_join(listed, "\n")).alias("digest"),
    )


@query
def snapshot_upsert(spark, folder):
    """Snapshots after the fresh ones came in: the newest of each key."""
    rows = I.rows(spark, folder, "events", [*I.SNAPSHOTS, "event_type"])
    old, fresh = (rows.filter(c).drop("event_id", "event_type") for c in ("event_type <> 'click'", "event_type = 'click'"))
    got = TR.upsert_snapshots(old, fresh)
    return got.select("module_name", "scope_key", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_at"), F.md5("payload").alias("digest"))


ORACLE["snapshot_upsert"] = f"""WITH rows AS ({I.sql([*I.SNAPSHOTS, 'event_type'], 'events')})
SELECT module_name, scope_key, epoch_us(updated_at) AS updated_at, md5(payload) AS digest FROM rows
QUALIFY row_number() OVER (PARTITION BY module_name, scope_key ORDER BY updated_at DESC, event_type = 'click' DESC) = 1"""


@query
def snapshot_lookup(spark, folder):
    """Requests with the newest snapshot of their key, where there is one."""
    rows = I.rows(spark, folder, "events", I.SNAPSHOTS).drop("event_id")
    none = spark.createDataFrame([], rows.schema)
    asked = I.rows(spark, folder, "events", I.SERVED)
    got = TR.find_snapshots(asked, TR.upsert_snapshots(none, rows))
    return got.select("request_id", "module_name", "scope_key", F.md5("payload").alias("digest"))


ORACLE["snapshot_lookup"] = f"""WITH rows AS ({I.sql(I.SNAPSHOTS, 'events')}),
newest AS (SELECT module_name, scope_key, payload FROM rows QUALIFY row_number() OVER (PARTITION BY module_name, scope_key ORDER BY updated_at DESC) = 1)
SELECT request_id, module_name, scope_key, md5(payload) AS digest FROM ({I.sql(I.SERVED, 'events')}) LEFT JOIN newest USING (module_name, scope_key)"""

# --- orders and small functions -----------------------------------------------------------


@query
def talent_order(spark, folder):
    """Creators in id order, with their place."""
    return number_rows(crm.in_id_order(Q._talents(spark, folder)), "id", "place").select("id", "name", "place")


ORACLE["talent_order"] = f"WITH {O.TALENTS} SELECT id, name, row_number() OVER (ORDER BY id) AS place FROM talents"


@query
def library_order(spark, folder):
    """Library rows, newest first, with their place."""
    rows = Q.QUERIES["library_listing"](spark, folder).select("source_id", "updated_at")
    return LB.newest_first(rows).select("source_id", "updated_at", "place")


ORACLE["library_order"] = f"""WITH listed AS ({ORACLE['library_listing']})
SELECT source_id, updated_at, row_number() OVER (ORDER BY updated_at DESC, source_id) AS place FROM listed"""


@query
def urgent_todos(spark, folder):
    """The ten most urgent steps."""
    return crm.top_todos(Q._talents(spark, folder))


ORACLE["urgent_todos"] = f"""WITH {O.TODOS}
SELECT talent_id, talent_name, priority, text, priority_order FROM ordered ORDER BY priority_order, talent_name, talent_id LIMIT 10"""

COERCED = ["event_id", f"{I.pick('event_id', ['', 'x', '[1] '])} || CASE WHEN event_id % 7 = 0 THEN '' ELSE props END AS raw"]


@query
def json_objects(spark, folder):
    """Texts that are JSON objects as they are, others as an empty one."""
    return I.rows(spark, folder, "events", COERCED).select("event_id", M.json_object_or_empty("raw").alias("value"))


ORACLE["json_objects"] = f"""SELECT event_id, CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) = 'OBJECT' THEN raw ELSE '{{}}' END AS value
FROM ({I.sql(COERCED, 'events')})"""


@query
def user_import(spark, folder):
    """Users after an import: merged by id, blank texts filled."""
    users = Q._users(spark, folder)
    rows = users.select(
        (F.col("id") * 2 - 100000).alias("id"), "name", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("style_prompt")).alias("style_prompt"), "few_shot"
    )
    return crm.import_rows(users, rows, ["id"], {"style_prompt": "plain", "few_shot": ""})


ORACLE["user_import"] = f"""WITH {O.USERS}, rows AS (SELECT id * 2 - 100000 AS id, name, CASE WHEN id % 2 = 0 THEN '' ELSE style_prompt END AS style_prompt, few_shot FROM users)
SELECT id, name, coalesce(nullif(style_prompt, ''), 'plain') AS style_prompt, coalesce(few_shot, '') AS few_shot FROM rows
UNION ALL SELECT id, name, style_prompt, few_shot FROM users WHERE id NOT IN (SELECT id FROM rows)"""

#: Names of several scripts, told apart by their letters without accents, and their order for readers of Chinese.
LOCAL_NAMES = ["Zoë", "阿里", "abel", "张伟", "Änne", "李娜", "émile", "王芳", "Chloé"]
LOCAL_ORDER = ["阿里", "李娜", "王芳", "张伟", "abel", "Änne", "Chloé", "émile", "Zoë"]


@query
def localized_todos(spark, folder):
    """The ten most urgent steps of each nation, for creators with names of several scripts."""
    local = F.expr(I.pick(I.whole("id", 7), LOCAL_NAMES))
    talents = Q._talents(spark, folder).withColumn("name", F.concat(local, F.lit(" "), "name"))
    return crm.recent_todos_by(talents, "nation").select("nation", "rank", "talent_id", "talent_name", "priority")


_LOCAL = I.pick(I.whole("talent_id", 7), LOCAL_NAMES)
_PLACE = "CASE " + _LOCAL + " " + " ".join(f"WHEN {text(n)} THEN {i}" for i, n in enumerate(LOCAL_ORDER)) + " END"
ORACLE["localized_todos"] = f"""WITH {O.TODOS}
SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY priority_order, {_PLACE}, talent_name, talent_id) AS rank, talent_id, {_LOCAL} || ' ' || talent_name AS talent_name, priority
FROM ordered QUALIFY rank <= 10"""

_DAY = "lpad(CAST(event_id % 28 + 1 AS VARCHAR(20)), 2, '0')"
IMPORTED = [
    "event_id",
    f"{I.pick('event_id', I.MODULES)} AS module_name",
    "CASE WHEN event_id % 31 = 0 THEN '' ELSE 'scope ' || CAST(user_id AS VARCHAR(20)) END AS scope_key",
    f"{I.pick('event_id', ['', 'x', '[1] '])} || CASE WHEN event_id % 7 = 0 THEN '' ELSE props END AS filters_json",
    "props AS payload_json",
    f"CASE event_id % 4 WHEN 0 THEN '2024-01-' || {_DAY} || 'T10:00:00Z' WHEN 1 THEN '2024-13-' || {_DAY} WHEN 2 THEN ' ' ELSE '2024-02-' || {_DAY} || ' 11:30:00' END AS updated_at",
    "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'many' ELSE CAST(user_id AS VARCHAR(20)) END AS views",
]
IMPORT_BASE = [
    "'videos' AS module_name",
    "'scope ' || CAST(user_id * 2 AS VARCHAR(20)) AS scope_key",
    "'{}' AS filters_json",
    "'{\"old\": 1}' AS payload_json",
    "CAST('2020-01-01 00:00:00' AS TIMESTAMP) AS updated_at",
    "CAST(7 AS BIGINT) AS views",
]


def _imported(spark, folder):
    base = I.rows(spark, folder, "events", IMPORT_BASE).distinct()
    rows = I.rows(spark, folder, "events", IMPORTED)
    return crm.import_typed(base, rows, ["module_name", "scope_key"], "event_id", {"views": "0"}, json=["filters_json", "payload_json"])


@query
def table_import(spark, folder):
    """Snapshots after an import of texts, each read by the type of its column."""
    merged, _ = _imported(spark, folder)
    return merged.select(
        "module_name", "scope_key", "filters_json", "payload_json", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at_us"), "views"
    )


@query
def import_problems(spark, folder):
    """Values of the import that could not be read, with the reason."""
    _, problems = _imported(spark, folder)
    return problems


_OBJECT = "json_valid({0}) AND json_type(CASE WHEN json_valid({0}) THEN {0} ELSE 'null' END) = 'OBJECT'"
_TIME = "CASE event_id % 4 WHEN 0 THEN CAST(replace(replace(updated_at, 'T', ' '), 'Z', '') AS TIMESTAMP) WHEN 3 THEN CAST(updated_at AS TIMESTAMP) END"
ORACLE["table_import"] = f"""WITH rows AS ({I.sql(IMPORTED, 'events')}), base AS (SELECT DISTINCT * FROM ({I.sql(IMPORT_BASE, 'events')})),
good AS (SELECT module_name, scope_key, CASE WHEN {_OBJECT.format('filters_json')} THEN filters_json ELSE '{{}}' END AS filters_json,
  CASE WHEN {_OBJECT.format('payload_json')} THEN payload_json ELSE '{{}}' END AS payload_json, epoch_us({_TIME}) AS at_us, coalesce(TRY_CAST(views AS BIGINT), 0) AS views
  FROM rows WHERE scope_key <> '' QUALIFY row_number() OVER (PARTITION BY module_name, scope_key ORDER BY event_id DESC) = 1)
SELECT * FROM good UNION ALL SELECT module_name, scope_key, filters_json, payload_json, epoch_us(updated_at), views FROM base
WHERE (module_name, scope_key) NOT IN (SELECT (module_name, scope_key) FROM good)"""
ORACLE["import_problems"] = f"""WITH rows AS ({I.sql(IMPORTED, 'events')})
SELECT event_id AS row_no, 'scope_key' AS "column", scope_key AS value, 'no key' AS reason FROM rows WHERE scope_key = ''
UNION ALL SELECT event_id, 'filters_json', filters_json, 'no JSON object' FROM rows WHERE trim(filters_json) <> '' AND NOT ({_OBJECT.format('filters_json')})
UNION ALL SELECT event_id, 'payload_json', payload_json, 'no JSON object' FROM rows WHERE trim(payload_json) <> '' AND NOT ({_OBJECT.format('payload_json')})
UNION ALL SELECT event_id, 'updated_at', updated_at, 'no time' FROM rows WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 'views', views, 'no bigint' FROM rows WHERE views = 'many'"""

CITED = [
    "doc_id",
    f"CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Doc ' || {ID} END AS source_title",
    f"{I.pick('doc_id', ['US', '', 'DE'])} AS country_code",
    f"{I.pick('doc_id', ['', '12'])} AS page_num",
    "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS heading_path",
]


@query
def citation_labels(spark, folder):
    """Citations as text."""
    rows = I.rows(spark, folder, "documents", CITED)
    return rows.select("doc_id", W.citation_label(F.struct("source_title", "country_code", "page_num", "heading_path")).alias("label"))


ORACLE["citation_labels"] = f"""SELECT doc_id, coalesce(source_title, 'Untitled source') || ' · ' || coalesce(nullif(country_code, ''), 'GLOBAL') || ' · p.'
  || coalesce(nullif(page_num, ''), 'N/A') || ' · ' || coalesce(nullif(heading_path, ''), 'N/A') AS label FROM ({I.sql(CITED, 'documents')})"""


QUERY_PARTS = [
    "doc_id", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS topic", "text AS final_script",
    "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS style_prompt", f"{I.pick('doc_id', fixed.PRODUCT_CATEGORIES)} AS product_category",
]


@query
def query_texts(spark, folder):
    """Search texts of requests."""
    return I.rows(spark, folder, "documents", QUERY_PARTS).select("doc_id", F.md5(S.query_text()).alias("digest"))


ORACLE["query_texts"] = f"""SELECT doc_id, md5(coalesce(topic, '') || chr(10) || coalesce(final_script, '') || chr(10) || coalesce(style_prompt, '') || chr(10) || product_category) AS digest
FROM ({I.sql(QUERY_PARTS, 'documents')})"""

FLAGS = ["doc_id", f"{I.pick('doc_id', [' TRUE', '1', 'yes ', 'Y', 'no', '', '0', 'on', 'truely'])} || CASE WHEN doc_id % 11 = 0 THEN source ELSE '' END AS flag"]


@query
def true_texts(spark, folder):
    """Texts that mean true."""
    return I.rows(spark, folder, "documents", FLAGS).select("doc_id", T.is_true_text("flag").alias("is_true"))


ORACLE["true_texts"] = f"SELECT doc_id, lower({strip('flag')}) IN ('1', 'true', 'yes', 'y') AS is_true FROM ({I.sql(FLAGS, 'documents')})"


@query
def rule_hits(spark, folder):
    """Scripts hit by each rule of a rule set that was kept as a table."""
    rows = R.issue_rows(A.rule_issues(I.scripts(spark, folder), R.rules_table(spark)), "doc_id")
    return rows.groupBy("rule_no").agg(F.count("*").alias("scripts"), F.min("doc_id").alias("first"))


ORACLE["rule_hits"] = f"""WITH scripts AS ({O.SCRIPTS}), {O.issues_sql()}
SELECT rule_no, count(*) AS scripts, min(doc_id) AS first FROM issues GROUP BY rule_no"""

PARAGRAPHS = ["doc_id", f"replace(text, '. ', '.' || chr(10) || {I.pick('doc_id', ['', '- ', '1. ', '  '])}) AS body"]


@query
def merged_paragraphs(spark, folder):
    """Lines of a text block joined to paragraphs."""
    rows = I.rows(spark, folder, "documents", PARAGRAPHS)
    return rows.select("doc_id", F.md5(LY.merged_paragraph(T.split_lines("body"))).alias("digest"))


_PARTS = f"list_filter(list_transform(string_split(body, chr(10)), lambda s: {O.clean_line('s')}), lambda s: s <> '')"
ORACLE["merged_paragraphs"] = f"""SELECT doc_id, md5(coalesce(list_reduce({_PARTS}, lambda a, s: CASE WHEN regexp_matches(s, {text(fixed.LIST_MARK_PATTERN)}) THEN a || chr(10) || s
  ELSE regexp_replace(a, '-+$', '') || CASE WHEN regexp_matches(a, '[/(\\[\\-]$') THEN '' ELSE ' ' END || s END), '')) AS digest FROM ({I.sql(PARAGRAPHS, 'documents')})"""


@query
def relevant_documents(spark, folder):
    """Documents per category that pass the allow-list; a blank category passes."""
    rows = _files(spark, folder).withColumn("kind", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.lower("category")))
    return rows.filter(S.relevant_category("kind")).groupBy("kind").agg(F.count("*").alias("documents"))


ORACLE["relevant_documents"] = f"""WITH {_FILES}, kinds AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '' ELSE lower(category) END AS kind FROM files)
SELECT kind, count(*) AS documents FROM kinds WHERE kind = '' OR kind IN ({', '.join(text(c) for c in fixed.RELEVANT_CATEGORIES)}) GROUP BY kind"""


@query
def chunk_function(spark, folder):
    """Chunks by the table function for SQL users."""
    K.register_sql(spark)
    docs = I.knowledge(spark, folder).select("doc_id", "source_title", "body")
    rows = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_document(d.source_title, d.body) c", docs=docs)
    return rows.select("doc_id", "chunk_index", "heading_path", F.md5("text").alias("digest"))


ORACLE["chunk_function"] = f"WITH {O.CHUNKS} SELECT doc_id, chunk_index, heading_path, md5(text) AS digest FROM chunks"
