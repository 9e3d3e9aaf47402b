"""Registered queries of the catalogue and search operators, with their SQL oracles.

Each query runs over whole tables. SQL is independent of the Spark plans: it works
from the same definitions with window functions and recursive queries.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import catalog as C
from corvane.functions import crypto
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import components, duplicates, hierarchy, search, semantic, upkeep, validation
from corvane.operators.changefeed import current_rows
from corvane.session import stage, table

QUERIES: dict = {}
SQL: dict = {}

QUERY = "monthly workflow report"
MODEL, VERSION, DIM = "multi-embed-b", "3", 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- shared inputs ------------------------------------------------------------------------------

def _docs(spark, d):
    return search.current_documents(table(spark, d, "documents"))


def _files(spark, d):
    return current_rows(table(spark, d, "files"))


def _vectors(spark, d):
    return search.valid_vectors(table(spark, d, "vectors"), MODEL, VERSION, DIM)


def _latest_vectors(spark, d):
    """Valid vectors, one row per id: the latest, ties by row content."""
    v = _vectors(spark, d).withColumn("corpus_key", F.coalesce("corpus_key", F.lit("user")))
    w = W.partitionBy("id").orderBy(F.desc("indexed_at"), F.col("content_hash"), F.col("text"))
    return v.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _query_vector(spark, d, nth: int = 0):
    """The embedding of the (nth + 1)-th smallest vector id: a stated query."""
    return _latest_vectors(spark, d).orderBy("id").select("embedding").limit(nth + 1).collect()[nth][0]


_SPACE = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_DOCS = f"""
WITH RECURSIVE cur AS (SELECT *, coalesce(corpus_key, 'user') AS ck FROM documents WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY TRY_CAST(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST, doc_id DESC) = 1),
flat AS (SELECT id, ck, trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS t FROM cur),
cut AS (SELECT id, ck, t, unnest(range(0, CASE WHEN length(t) = 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((length(t) - 800) / 680.0) AS BIGINT)) END)) AS i FROM flat),
ch AS (SELECT id AS file_id, ck, i AS idx, substr(t, i * 680 + 1, 800) AS text FROM cut),
tok AS (SELECT file_id, ck, idx, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: length(x) >= 2)) AS term FROM ch),
tf AS (SELECT file_id, ck, term, idx, count(*) AS n FROM tok GROUP BY ALL),
post AS (SELECT file_id, ck, term, n AS tf, idx AS best FROM tf QUALIFY row_number() OVER (PARTITION BY file_id, term ORDER BY n DESC, idx) = 1)
"""
_FILES = "WITH cur AS (SELECT * FROM files WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_at DESC NULLS LAST) = 1)\n"
_VEC = f"""
WITH valid AS (SELECT *, coalesce(corpus_key, 'user') AS ck FROM vectors WHERE embedding_model = '{MODEL}' AND embedding_version = '{VERSION}' AND dimension = {DIM} AND len(embedding) = {DIM}
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
lat AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, content_hash, text) = 1),
q AS (SELECT embedding AS q, row_number() OVER (ORDER BY id) - 1 AS nth FROM lat ORDER BY id LIMIT 3),
sim AS (SELECT nth, id, ck, file_id, idx, text, coalesce(nullif(list_cosine_similarity(embedding, q), 'nan'::DOUBLE), 0) AS s FROM lat, q)
"""


def _bm25_sql(text: str, corpus: str | None = None) -> str:
    terms = T.query_terms(text)
    rows = ", ".join(f"('{t}', {i})" for i, t in enumerate(terms))
    where = f"WHERE ck = '{corpus}'" if corpus else ""
    return f""",
asked(term, pos) AS (VALUES {rows}),
hit AS (SELECT p.*, a.pos FROM (SELECT * FROM post {where}) p JOIN asked a USING (term)),
df AS (SELECT term, count(DISTINCT file_id) AS df FROM hit GROUP BY term),
nn AS (SELECT greatest(count(*), 1) AS n FROM cur {where}),
bm AS (SELECT file_id, sum(tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) / (tf + 1.2::DOUBLE)) AS score, min(pos) AS first,
  arg_min(best, struct_pack(a := -tf, b := pos)) AS best FROM hit JOIN df USING (term), nn GROUP BY file_id),
top AS (SELECT * FROM bm ORDER BY score DESC, first, file_id LIMIT 200)"""


def _meta_sql(text: str) -> str:
    terms, q = T.expand_terms(text), text.lower().strip()
    esc = lambda s: s.replace("'", "''")
    name, summ, tags = "lower(coalesce(name, ''))", "lower(coalesce(semantic_summary, ''))", "lower(coalesce(array_to_string(tags, ' '), ''))"
    point = lambda t: f"CASE WHEN contains({name}, '{esc(t)}') THEN 25 " + ("" if t in T.STOPWORDS else f"WHEN contains({summ}, '{esc(t)}') THEN 15 WHEN contains({tags}, '{esc(t)}') THEN 10 ") + "ELSE 0 END"
    total = " + ".join(point(t) for t in terms)
    hits = " + ".join(f"(({point(t)}) > 0)::INT" for t in terms)
    exact = f"({name} = '{esc(q)}' OR regexp_replace({name}, '\\.[a-z0-9]{{1,8}}$', '') = '{esc(q)}')"
    phrase = f"({'true' if len(terms) > 1 else 'false'} AND (contains({name}, '{esc(q)}') OR contains({summ}, '{esc(q)}')))"
    return f"least(100, CASE WHEN {exact} THEN 50 WHEN {phrase} THEN 45 ELSE 0 END + {total} + CASE WHEN coalesce(starred, false) AND (({hits}) > 0 OR {exact} OR {phrase}) THEN 5 ELSE 0 END)"


# -- text and index -----------------------------------------------------------------------------

@query(_DOCS + "SELECT term, count(*) AS n, count(DISTINCT file_id) AS files FROM tok GROUP BY term")
def tokenize_terms(spark, d):
    t = search.chunk_rows(_docs(spark, d)).select("file_id", F.explode(T.tokenize("text")).alias("term"))
    return t.groupBy("file_id", "term").agg(F.count("*").alias("c")).groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("files"))


@query(_DOCS + "SELECT file_id, idx, length(text) AS n_chars, md5(text) AS h FROM ch")
def chunk_documents(spark, d):
    return search.chunk_rows(_docs(spark, d)).select("file_id", F.col("idx").cast("bigint").alias("idx"), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("h"))


@query(_DOCS + "SELECT term, file_id, tf, best AS best_chunk_idx FROM post")
def build_postings(spark, d):
    return search.postings(search.chunk_rows(_docs(spark, d))).withColumn("best_chunk_idx", F.col("best_chunk_idx").cast("bigint"))


@query(_DOCS + "SELECT ck AS corpus_key, term, count(*) AS df FROM post GROUP BY ck, term")
def document_frequency(spark, d):
    docs = _docs(spark, d)
    p = search.postings(search.chunk_rows(docs))
    return p.join(docs.select(F.col("id").alias("file_id"), "corpus_key"), "file_id").groupBy("corpus_key", "term").agg(F.count("*").alias("df"))


@query(_DOCS + _bm25_sql(QUERY) + " SELECT file_id, round(score, 6) AS score, best AS best_chunk_idx FROM top")
def bm25_search(spark, d):
    return search.bm25(_docs(spark, d), QUERY).select("file_id", F.round("score", 6).alias("score"), F.col("best_chunk_idx").cast("bigint").alias("best_chunk_idx"))


@query(_DOCS + _bm25_sql(QUERY) + " SELECT top.file_id, trim(substr(coalesce(ch.text, ''), 1, 160)) AS snippet FROM top LEFT JOIN ch ON ch.file_id = top.file_id AND ch.idx = top.best")
def bm25_snippets(spark, d):
    docs = _docs(spark, d)
    return search.with_snippets(search.bm25(docs, QUERY), docs).select("file_id", "snippet")


@query(_DOCS + _bm25_sql(QUERY, "user") + " SELECT file_id, round(score, 6) AS score FROM top")
def bm25_corpus_scoped(spark, d):
    return search.bm25(_docs(spark, d), QUERY, "user").select("file_id", F.round("score", 6).alias("score"))


def _expand_sql() -> str:
    pairs: dict[str, list[str]] = {}
    for a, b in T.SYNONYMS:
        pairs.setdefault(a, []).append(b)
        pairs.setdefault(b, []).append(a)
    table_ = "map {" + ", ".join(f"'{k}': {v}" for k, v in pairs.items()) + "}"
    raw = f"list_filter(list_transform(regexp_split_to_array(lower(coalesce(name, '')), '{_SPACE}'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{M}}\\p{{N}}_-]', '', 'g')), lambda w: length(w) >= 2)"
    return _FILES + f"""SELECT id, array_to_string(list_filter(list_concat(raw, more), lambda x, i: list_position(list_concat(raw, more), x) = i), '|') AS terms
FROM (SELECT id, raw, flatten(list_transform(raw, lambda w: coalesce({table_}[w], []))) AS more FROM (SELECT id, {raw} AS raw FROM cur))"""


@query(_expand_sql())
def expand_terms(spark, d):
    return _files(spark, d).select("id", F.array_join(T.expand_terms_column("name"), "|").alias("terms"))


@query("""SELECT * FROM (VALUES ('cannabis report', 'cannabis report', CAST(0 AS BIGINT)), ('cannabis report', 'hemp report', 1), ('cannabis report', 'भांग report', 2),
 ('Hemp video', 'Hemp video', 0), ('Hemp video', 'hemp video', 1), ('Hemp video', 'cannabis video', 2), ('monthly workflow report', 'monthly workflow report', 0)) t(query, variant, pos)""")
def semantic_variants(spark, d):
    return spark.createDataFrame([(q, v, i) for q in ("cannabis report", "Hemp video", QUERY) for i, v in enumerate(T.semantic_variants(q))], "query string, variant string, pos int")


@query(_FILES + r"""SELECT id, array_to_string(list_transform(p, lambda x: CASE WHEN lower(x) IN ('report', 'budget') THEN '[' || x || ']' ELSE x END), '') AS marked
FROM (SELECT id, list_filter(regexp_split_to_array(regexp_replace(coalesce(semantic_summary, ''), '(?i)(report|budget)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM cur)""")
def highlight_segments(spark, d):
    s = T.highlight("semantic_summary", "report Budget a")
    return _files(spark, d).select("id", F.array_join(F.transform(s, lambda x: F.when(x["match"], F.concat(F.lit("["), x["text"], F.lit("]"))).otherwise(x["text"])), "").alias("marked"))


@query(r"""SELECT doc_id, md5(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'ya29\.[A-Za-z0-9._~\-]+', '[token]', 'g'),
 'AIza[A-Za-z0-9_\-]+', '[key]', 'g'), '(?i)Bearer\s+\S+', 'Bearer [redacted]', 'g'), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[email]', 'g'), 1, 500)) AS h FROM documents""")
def redact_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact("text")).alias("h"))


@query(_FILES + """SELECT id, CASE WHEN size IS NULL OR size <= 0 THEN 'Size unknown' ELSE regexp_replace(regexp_replace(printf('%.6f', round(size / pow(1024.0::DOUBLE, u), 1)), '0+$', ''), '\\.$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][u + 1] END AS shown
FROM (SELECT id, size, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 WHEN size < 1099511627776 THEN 3 ELSE 4 END AS u FROM cur)""")
def format_bytes(spark, d):
    return _files(spark, d).select("id", T.format_bytes("size").alias("shown"))


@query(_DOCS + r"SELECT id, length(t) < 45 OR len(list_filter(string_split(t, ' '), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))) < 6 AS sparse FROM flat")
def sparse_text(spark, d):
    return _docs(spark, d).select("id", T.is_sparse("text").alias("sparse"))


def _pages_sql(expanded: bool) -> str:
    more = "list_transform(range(1, least(5, n - 10) + 1), lambda i: CAST(floor(i * (n - 9) / (least(5, n - 10) + 1)::DOUBLE + 0.5) AS BIGINT) + 5)" if expanded else "[]"
    return f"""SELECT doc_id, array_to_string(CASE WHEN n <= 0 THEN [] WHEN n <= 10 THEN range(1, n + 1)
 ELSE list_sort(list_distinct(list_concat(list_concat(range(1, 6), range(n - 4, n + 1)), {more}))) END, ',') AS pages
FROM (SELECT doc_id, CAST(coalesce(pdf_coverage.total_pages, 0) * 7 AS BIGINT) AS n FROM documents)"""


@query(_pages_sql(False))
def pdf_page_sampling(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.sample_pages(F.col("pdf_coverage.total_pages") * 7).cast("array<string>"), ",").alias("pages"))


@query(_pages_sql(True))
def pdf_page_sampling_expanded(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.sample_pages(F.col("pdf_coverage.total_pages") * 7, True).cast("array<string>"), ",").alias("pages"))


@query("SELECT doc_id, length(substr(coalesce(text, ''), 1, 500000)) AS kept, length(coalesce(text, '')) > 500000 AS truncated FROM documents")
def capped_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cap_text("text").alias("t")).select("doc_id", F.length("t.text").cast("bigint").alias("kept"), "t.truncated")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS h FROM documents""")
def page_text(spark, d):
    """Texts wrapped as WordprocessingML and read back."""
    x = F.concat(F.lit("<w:p>"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("<w:br/>")), F.lit("</w:p>"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.xml_text(x)).alias("h"))


# -- metadata -----------------------------------------------------------------------------------

@query(_FILES + f"SELECT id AS file_id, {_meta_sql(QUERY)} AS score FROM cur WHERE {_meta_sql(QUERY)} > 0")
def metadata_search(spark, d):
    return search.metadata_search(_files(spark, d), QUERY).select("file_id", F.col("score").cast("int").alias("score"))


@query(_FILES + "SELECT id AS file_id, 0 AS score, CASE WHEN coalesce(semantic_summary, '') <> '' THEN semantic_summary ELSE name END AS snippet FROM cur")
def browse_mode(spark, d):
    return search.metadata_search(_files(spark, d), "  ").select("file_id", "score", "snippet")


@query(_FILES + r"""SELECT category, is_drive_item AS drive, count(*) AS n,
 count(*) FILTER (NOT (c = 'image' OR starts_with(m, 'image/') OR regexp_matches(n0, '\.(png|jpe?g|webp|bmp|gif|tiff?)$')) AND (c = 'document' OR contains(m, 'wordprocessingml') OR m IN ('application/msword', 'application/vnd.google-apps.document')
  OR m = 'application/pdf' OR ends_with(n0, '.pdf') OR starts_with(m, 'text/') OR regexp_matches(n0, '\.(txt|md|rtf|docx?)$')
  OR (c = 'other' AND (regexp_matches(n0, '\.(txt|md|csv|json|xml|html|log|pdf|docx|docm|xlsx|xlsm|pptx|pptm)$') OR m IN ('application/json', 'application/xml', 'application/vnd.google-apps.spreadsheet', 'application/vnd.google-apps.presentation',
     'application/vnd.ms-word.document.macroenabled.12', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'application/vnd.openxmlformats-officedocument.presentationml.presentation', 'application/vnd.ms-powerpoint.presentation.macroenabled.12'))))) AS document,
 count(*) FILTER (c = 'spreadsheet' OR m = 'application/vnd.google-apps.spreadsheet' OR contains(m, 'spreadsheetml') OR regexp_matches(n0, '\.(xlsx?|csv)$')) AS spreadsheet,
 count(*) FILTER (m = 'application/vnd.google-apps.presentation' OR contains(m, 'presentationml') OR regexp_matches(n0, '\.(pptx?|odp)$')) AS presentation,
 count(*) FILTER (m = 'application/pdf' OR ends_with(n0, '.pdf')) AS pdf,
 count(*) FILTER (c = 'image' OR starts_with(m, 'image/') OR regexp_matches(n0, '\.(png|jpe?g|webp|bmp|gif|tiff?)$')) AS image
FROM (SELECT *, coalesce(category, '') AS c, lower(coalesce(mime_type, '')) AS m, lower(coalesce(name, '')) AS n0 FROM cur) GROUP BY category, is_drive_item""")
def category_filter(spark, d):
    kinds = ("document", "spreadsheet", "presentation", "pdf", "image")
    return _files(spark, d).groupBy("category", F.col("is_drive_item").alias("drive")).agg(F.count("*").alias("n"), *[F.count_if(validation.matches_category(k)).alias(k) for k in kinds])


@query(_FILES + """SELECT id, CASE WHEN starts_with(m, 'image/') THEN 'image' WHEN starts_with(m, 'audio/') THEN 'audio' WHEN starts_with(m, 'video/') THEN 'video'
 WHEN contains(m, 'pdf') OR contains(m, 'document') OR contains(m, 'text/plain') THEN 'document'
 WHEN contains(m, 'sheet') OR contains(m, 'csv') OR ends_with(n, '.xlsx') THEN 'spreadsheet'
 WHEN contains(m, 'zip') OR contains(m, 'tar') OR contains(m, 'gzip') THEN 'archive'
 WHEN contains(m, 'javascript') OR contains(m, 'typescript') OR ends_with(n, '.ts') OR ends_with(n, '.tsx') OR ends_with(n, '.json') THEN 'code' ELSE 'other' END AS kind
FROM (SELECT id, coalesce(mime_type, '') AS m, coalesce(name, '') AS n FROM cur)""")
def mime_category(spark, d):
    return _files(spark, d).select("id", C.mime_category(F.col("mime_type"), F.col("name")).alias("kind"))


@query(_FILES + "SELECT id FROM cur WHERE mime_type <> 'application/vnd.google-apps.shortcut' AND mime_type IN ('application/vnd.ms-excel', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'application/vnd.google-apps.spreadsheet', 'text/csv')")
def listing_filter(spark, d):
    return _files(spark, d).where(validation.listing_filter("spreadsheets")).select("id")


@query(_FILES + r"""SELECT id FROM cur WHERE coalesce(is_drive_item, false) AND (starts_with(mime_type, 'text/') OR mime_type IN ('application/json', 'application/xml', 'application/vnd.google-apps.document', 'application/vnd.google-apps.spreadsheet', 'application/vnd.google-apps.presentation',
 'application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/vnd.ms-word.document.macroEnabled.12', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'application/vnd.openxmlformats-officedocument.presentationml.presentation',
 'application/vnd.ms-powerpoint.presentation.macroEnabled.12', 'image/png', 'image/jpeg', 'image/webp', 'image/bmp', 'image/gif', 'image/tiff')
 OR regexp_matches(lower(coalesce(name, '')), '\.(txt|md|csv|json|xml|html|log|pdf|docx|docm|xlsx|xlsm|pptx|pptm|png|jpe?g|webp|bmp|gif|tiff?)$'))""")
def index_scope(spark, d):
    return _files(spark, d).where(F.coalesce("is_drive_item", F.lit(False)) & validation.can_extract()).select("id")


_ROUTES = r"""
SELECT CASE WHEN m IN ('application/vnd.google-apps.document', 'application/vnd.google-apps.spreadsheet', 'application/vnd.google-apps.presentation') THEN 'export'
  WHEN m = 'application/pdf' OR ends_with(n, '.pdf') THEN 'pdf'
  WHEN m IN ('application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/vnd.ms-word.document.macroEnabled.12') OR regexp_matches(n, '\\.doc[xm]$') THEN 'docx'
  WHEN m = 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' OR regexp_matches(n, '\\.xls[xm]$') THEN 'xlsx'
  WHEN m IN ('application/vnd.openxmlformats-officedocument.presentationml.presentation', 'application/vnd.ms-powerpoint.presentation.macroEnabled.12') OR regexp_matches(n, '\\.ppt[xm]$') THEN 'pptx'
  WHEN m IN ('image/png', 'image/jpeg', 'image/webp', 'image/bmp', 'image/gif', 'image/tiff') OR regexp_matches(n, '\\.(png|jpe?g|webp|bmp|gif|tiff?)$') THEN 'image'
  WHEN starts_with(m, 'text/') OR m IN ('application/json', 'application/xml') OR regexp_matches(n, '\\.(txt|md|csv|json|xml|html|log)$') THEN 'text' ELSE 'none' END AS route,
 CASE WHEN starts_with(m, 'image/') THEN 'image' WHEN starts_with(m, 'video/') THEN 'video' WHEN starts_with(m, 'audio/') THEN 'audio' WHEN contains(m, 'sheet') OR regexp_matches(n, '\\.(csv|xls|xlsx)$') THEN 'spreadsheet'
  WHEN contains(m, 'pdf') OR regexp_matches(n, '\\.(pdf|doc|docx|txt|rtf)$') THEN 'document' WHEN regexp_matches(n, '\\.(zip|rar|7z)$') THEN 'archive' ELSE 'other' END AS local,
 CASE m WHEN 'application/vnd.google-apps.document' THEN 'pdf' WHEN 'application/vnd.google-apps.spreadsheet' THEN 'xlsx' WHEN 'application/vnd.google-apps.presentation' THEN 'pdf' WHEN 'application/vnd.google-apps.drawing' THEN 'png' END AS export,
 count(*) AS n FROM (SELECT coalesce(mime_type, '') AS m, lower(coalesce(name, '')) AS n FROM cur) GROUP BY 1, 2, 3""".replace("\\\\", "\\")


@query(_FILES + _ROUTES)
def extraction_routes(spark, d):
    f = _files(spark, d)
    return f.groupBy(validation.extraction_route().alias("route"), validation.local_category(F.col("mime_type"), F.col("name")).alias("local"), validation.export_hint(F.col("mime_type"))["ending"].alias("export")).agg(F.count("*").alias("n"))


@query(_FILES + "SELECT id, row_number() OVER (ORDER BY name, id) AS pos, 3 AS page, CAST(greatest(1, ceil((SELECT count(*) FROM cur) / 50.0)) AS INT) AS page_count, (SELECT count(*) FROM cur) AS total FROM cur QUALIFY pos BETWEEN 101 AND 150".replace("pos, 3", "pos, 3"))
def paginate(spark, d):
    p = search.paginate(_files(spark, d).select("id", "name"), ["name", "id"], 3, 50)
    return p.select("id", (F.row_number().over(W.orderBy("name", "id")) + 100).cast("bigint").alias("pos"), "page", "page_count", "total")


# -- vectors ------------------------------------------------------------------------------------

@query(_VEC + "SELECT id, round(s, 6) AS score FROM sim WHERE nth = 0 ORDER BY round(s, 9) DESC, id LIMIT 200")
def cosine_topk(spark, d):
    q = F.array(*[F.lit(x) for x in _query_vector(spark, d)])
    return _latest_vectors(spark, d).select("id", V.cosine(F.col("embedding"), q).alias("s")).orderBy(F.round("s", 9).desc(), "id").limit(200).select("id", F.round("s", 6).alias("score"))


@query(_VEC + "SELECT file_id, round(max(s), 6) AS score FROM sim WHERE nth = 0 AND s >= 0.22 GROUP BY file_id")
def neural_per_file_max(spark, d):
    return search.vector_search(_latest_vectors(spark, d), _query_vector(spark, d), top=None).select("file_id", F.round("score", 6).alias("score"))


@query(_VEC + "SELECT file_id, round(max(s), 6) AS score FROM sim WHERE s >= 0.22 GROUP BY file_id")
def neural_variant_merge(spark, d):
    v = _latest_vectors(spark, d)
    return search.merge_variants([search.vector_search(v, _query_vector(spark, d, i), top=None) for i in range(3)]).select("file_id", F.round("score", 6).alias("score"))


def _lsh_sql() -> str:
    """Signatures from the planes written out: bit sums, their signs, and the least certain bit flipped."""
    tables = []
    for t, bits in enumerate(V.planes(DIM)):
        sums = ", ".join(" + ".join(f"{sign} * e[{i + 1}]" for i, sign in plane) for plane in bits)
        tables.append(f"SELECT id, ck, {t} AS t, [{sums}] AS p FROM (SELECT id, ck, embedding::DOUBLE[] AS e FROM lat)")
    sig = "list_sum(list_transform(p, lambda x, i: CASE WHEN x >= 0 THEN 1 << (i - 1) ELSE 0 END))"
    return _VEC.rstrip() + ", pr AS (" + " UNION ALL ".join(tables) + f"""), sg AS (SELECT ck, t, CAST({sig} AS BIGINT) AS s, CAST(1 << (list_position(list_transform(p, lambda x: abs(x)), list_min(list_transform(p, lambda x: abs(x)))) - 1) AS BIGINT) AS f FROM pr)
SELECT '{V.INDEX_VERSION}:' || replace(ck, ':', '%3A') || ':' || t || ':' || b AS bucket, count(*) AS n FROM (SELECT ck, t, s AS b FROM sg UNION ALL SELECT ck, t, xor(s, f) FROM sg) GROUP BY 1"""


@query(_lsh_sql())
def lsh_buckets(spark, d):
    return search.bucket_index(_latest_vectors(spark, d), DIM).groupBy("bucket").agg(F.count("*").alias("n"))


@query(_VEC + "SELECT file_id, round(max(s), 6) AS score FROM sim WHERE nth = 0 AND ck = 'user' AND s >= 0.22 GROUP BY file_id ORDER BY max(s) DESC, file_id LIMIT 200")
def exact_corpus_search(spark, d):
    hits, _ = search.ann_search(_latest_vectors(spark, d), _query_vector(spark, d), "user", DIM, exact_up_to=1 << 40)
    return hits.select("file_id", F.round("score", 6).alias("score"))


@query(SQL["exact_corpus_search"])
def ann_search_guarded(spark, d):
    hits, _ = search.ann_search(_latest_vectors(spark, d), _query_vector(spark, d), "user", DIM)
    return hits.select("file_id", F.round("score", 6).alias("score"))


_ASKED = "CAST('0x' || substr(md5(id), 1, 4) AS INT) % 100 = 0"


@query(_VEC + f"SELECT count(*) AS queries, true AS reached FROM lat WHERE {_ASKED}")
def ann_recall(spark, d):
    """Whether the buckets alone, without the guard, find nine of ten nearest vectors, for every hundredth vector by MD5 of its id."""
    m = ann_recall_metrics(spark, d)
    return m.select("queries", (F.col("recall_at_10") >= 0.9).alias("reached"))


@query()
def ann_recall_metrics(spark, d):
    v = stage(_latest_vectors(spark, d).select("id", "corpus_key", "embedding"))
    asked = v.where(F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 100 == 0)
    return search.bucket_recall(v, asked, DIM).select("queries", *[F.round(c, 4).alias(c) for c in ("precision_at_5", "recall_at_10", "mrr")])


_HYB = _DOCS + _bm25_sql(QUERY) + """,
f AS (SELECT * FROM files WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_at DESC NULLS LAST) = 1),
{neural}
j AS (SELECT f.id, lower(coalesce(name, '')) AS nm, lower(coalesce(semantic_summary, '')) AS sm, {meta} AS meta, b.score AS b,
   coalesce(least(100.0::DOUBLE, b.score * 12), 0) AS bm, coalesce(floor(greatest(0, least(1, n.s)) * 100 + 0.5), 0) AS nn
  FROM f LEFT JOIN top b ON b.file_id = f.id LEFT JOIN nh n ON n.file_id = f.id),
k AS (SELECT *, {score} AS raw FROM j WHERE meta > 0 OR bm > 0 OR nn > 0)
SELECT id AS file_id, CAST(least(100, raw + CASE WHEN nm = '{q}' OR regexp_replace(nm, '\\.[a-z0-9]{{1,8}}$', '') = '{q}' THEN 18 WHEN contains(nm, '{q}') OR contains(sm, '{q}') THEN 6 ELSE 0 END) AS BIGINT) AS score FROM k WHERE raw > 0"""


def _hybrid_sql(neural: str, score: str) -> str:
    meta = _meta_sql(QUERY)
    return _HYB.replace("{neural}", neural).replace("{meta}", meta).replace("{score}", score).replace("{q}", QUERY).replace("{{", "{").replace("}}", "}")


_NH = _VEC.replace("\nWITH valid", "valid").rstrip() + ",\nnh AS (SELECT file_id, max(s) AS s FROM sim WHERE nth = 0 AND s >= 0.22 AND file_id IN (SELECT id FROM f) GROUP BY file_id ORDER BY max(s) DESC, file_id LIMIT 200),"
_WEIGHTED = "floor(nn * 0.55::DOUBLE + bm * 0.25::DOUBLE + meta * 0.2::DOUBLE + 0.5)"


@query(_hybrid_sql(_NH, f"CASE WHEN nn > 0 OR bm <= 0 THEN {_WEIGHTED} ELSE greatest({_WEIGHTED}, floor(bm * 0.5::DOUBLE + meta * 0.2::DOUBLE + 0.5)) END"))
def hybrid_search(spark, d):
    files = _files(spark, d)
    neural = search.vector_search(_latest_vectors(spark, d), _query_vector(spark, d), live=files)
    return search.hybrid_search(files, _docs(spark, d), QUERY, neural).select("file_id", "score")


@query(_hybrid_sql("nh AS (SELECT NULL::VARCHAR AS file_id, NULL::DOUBLE AS s WHERE false),", "CASE WHEN b IS NOT NULL THEN floor(least(100.0::DOUBLE, meta + least(40.0::DOUBLE, b * 8) * 0.5::DOUBLE) + 0.5) ELSE meta END"))
def hybrid_no_neural(spark, d):
    return search.hybrid_search(_files(spark, d), _docs(spark, d), QUERY).select("file_id", "score")


# -- duplicates ---------------------------------------------------------------------------------

_DUP = _FILES.rstrip() + r""",
k AS (SELECT *, CASE WHEN coalesce(content_hash, '') = '' OR starts_with(content_hash, 'gdrive-') OR starts_with(content_hash, 'user-')
    OR (starts_with(content_hash, 'sha256:') AND NOT coalesce(content_hash_modified_time <> '' AND content_hash_modified_time = modified_time, false))
  THEN CASE WHEN size > 0 THEN 'size:' || size || '|name:' || lower(coalesce(name, '')) END ELSE content_hash END AS dup_key FROM cur)
"""


@query(_DUP + "SELECT dup_key, CASE WHEN starts_with(dup_key, 'sha256:') THEN 'sha256' ELSE 'candidate' END AS verification, count(*) AS file_count, CAST(sum(coalesce(size, 0)) AS BIGINT) AS total_size, CAST(sum(coalesce(size, 0)) - arg_min(coalesce(size, 0), id) AS BIGINT) AS reclaimable_size FROM k WHERE dup_key IS NOT NULL GROUP BY dup_key HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return duplicates.duplicate_groups(_files(spark, d)).select("dup_key", "verification", "file_count", "total_size", "reclaimable_size")


@query(_DUP + "SELECT CAST(coalesce(sum(r), 0) AS BIGINT) AS reclaimable FROM (SELECT sum(coalesce(size, 0)) - arg_min(coalesce(size, 0), id) AS r FROM k WHERE dup_key IS NOT NULL GROUP BY dup_key HAVING count(*) > 1)")
def reclaimable_total(spark, d):
    return duplicates.duplicate_groups(_files(spark, d)).agg(F.coalesce(F.sum("reclaimable_size"), F.lit(0)).alias("reclaimable"))


@query(_DUP.rstrip() + r""",
t AS (SELECT *, epoch_ms(TRY_CAST(created_time AS TIMESTAMPTZ)) AS c FROM k WHERE dup_key IS NOT NULL),
g AS (SELECT *, count(*) OVER w AS n, max(coalesce(size, 0)) OVER w AS mx, min(c) OVER w AS c0 FROM t WINDOW w AS (PARTITION BY dup_key)),
p AS (SELECT *, coalesce(starred, false) AS a, coalesce(is_offline, false) AS b, coalesce(folder_id, '') NOT IN ('', 'root') AS f, length(coalesce(semantic_summary, '')) >= 80 AS l,
  regexp_matches(lower(coalesce(name, '')), '(^|[^a-z0-9_])(copy|duplicate|dup)([^a-z0-9_]|$)|\(copy( [0-9]+)?\)|\([0-9]+\)$') AS cp FROM g WHERE n > 1)
SELECT dup_key, id, round(coalesce(size, 0)::DOUBLE / greatest(1, mx)::DOUBLE * 12 + CASE WHEN a THEN 40 ELSE 0 END + CASE WHEN b THEN 15 ELSE 0 END + CASE WHEN f THEN 8 ELSE 0 END + CASE WHEN l THEN 4 ELSE 0 END - CASE WHEN cp THEN 25 ELSE 0 END
   + CASE WHEN c IS NOT NULL THEN greatest(0.0::DOUBLE, 8.0::DOUBLE - least(8.0::DOUBLE, (c - c0)::DOUBLE / 86400000 / 365)) ELSE 0 END, 6) AS score,
  CASE WHEN a OR b OR f OR l OR cp THEN concat_ws('; ', CASE WHEN a THEN 'starred' END, CASE WHEN b THEN 'available offline' END, CASE WHEN f THEN 'organized in a folder' END, CASE WHEN l THEN 'richer metadata' END, CASE WHEN cp THEN 'copy/duplicate naming penalty' END)
   ELSE 'highest combined preservation score' END AS reasons FROM p""")
def keep_candidates(spark, d):
    s = duplicates.scored_files(_files(spark, d))
    return s.select("dup_key", "id", F.round("score", 6).alias("score"), F.array_join(duplicates.keep_reasons(), "; ").alias("reasons"))


_SCORED = SQL["keep_candidates"].partition("SELECT dup_key, id, round(")[0]
_POINTS = SQL["keep_candidates"].partition("SELECT dup_key, id, round(")[2].partition(", 6) AS score")[0]


@query(_SCORED.rstrip() + f""",
s AS (SELECT dup_key, id, name, c, epoch_ms(TRY_CAST(modified_time AS TIMESTAMPTZ)) AS m, {_POINTS} AS score FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY dup_key ORDER BY score DESC, coalesce(c, 4611686018427387904), coalesce(m, 4611686018427387904), coalesce(name, ''), id) AS best FROM s)
SELECT dup_key, CAST(row_number() OVER (PARTITION BY dup_key ORDER BY best <> 1, coalesce(m, 4611686018427387904), id) - 1 AS INT) AS position, id FROM o""")
def group_members(spark, d):
    return duplicates.group_members(_files(spark, d))


@query(_DUP + "SELECT id FROM k WHERE dup_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dup_key ORDER BY id) > 1")
def movable_survivors(spark, d):
    keyed = _files(spark, d).withColumn("dup_key", duplicates.duplicate_key()).where("dup_key is not null")
    first = keyed.groupBy("dup_key").agg(F.min("id").alias("first"))
    return keyed.join(first, "dup_key").where("id <> first").select("id")


@query("""WITH f AS (SELECT doc_id, octet_length(encode(text)) || ':' || sha256(text) AS fp FROM documents WHERE text IS NOT NULL)
SELECT doc_id, fp FROM f WHERE fp IN (SELECT fp FROM f GROUP BY fp HAVING count(*) > 1)""")
def fingerprint_candidates(spark, d):
    from corvane.sources.listing import fast_fingerprint

    # texts here are under 64 KiB or above it alike: the head is the whole text below that size, twice
    raw = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    fp = raw.select("doc_id", fast_fingerprint(F.col("content"), F.octet_length("content")).alias("quick"), F.concat(F.octet_length("content").cast("string"), F.lit(":"), F.sha2("content", 256)).alias("fp"))
    many = fp.groupBy("quick").agg(F.count("*").alias("c")).where("c > 1").select("quick")
    cand = fp.join(many, "quick")
    full = cand.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    return cand.join(full, "fp").select("doc_id", "fp")


_REPS = _VEC.rstrip() + """,
rk AS (SELECT file_id, id, idx, embedding, row_number() OVER (PARTITION BY file_id ORDER BY idx, id) - 1 AS r, count(*) OVER (PARTITION BY file_id) AS n FROM lat),
reps AS (SELECT *, CASE WHEN n <= 12 THEN r ELSE list_position(list_transform(range(0, 12), lambda i: CAST(floor(i * (n - 1) / 11.0::DOUBLE + 0.5) AS BIGINT)), r) - 1 END AS pos FROM rk
  WHERE n <= 12 OR list_contains(list_transform(range(0, 12), lambda i: CAST(floor(i * (n - 1) / 11.0::DOUBLE + 0.5) AS BIGINT)), r))
"""


@query(_REPS + "SELECT file_id, CAST(pos AS INT) AS pos, idx FROM reps")
def representative_chunks(spark, d):
    return semantic.representatives(_latest_vectors(spark, d)).select("file_id", "pos", "idx")


@query(_REPS.rstrip() + """,
e AS (SELECT file_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dd FROM reps),
m AS (SELECT file_id, list(x ORDER BY dd) AS v FROM (SELECT file_id, dd, avg(x) AS x FROM e GROUP BY ALL) GROUP BY file_id)
SELECT a.file_id, b.file_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM m a JOIN m b ON a.file_id <> b.file_id
QUALIFY row_number() OVER (PARTITION BY a.file_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.file_id) <= 8""")
def centroid_shortlist(spark, d):
    """The eight nearest profiles of every file, over all files."""
    profiles = stage(semantic.centroids(semantic.representatives(_latest_vectors(spark, d))))
    return semantic.shortlist(profiles, blocks=max(1, -(-profiles.count() // semantic.BLOCK))).select("file_id", "other", F.round("similarity", 6).alias("similarity"))


_AT = "len(list_filter(acc, lambda c: c[-1].j < x[1][1].j))"  # chains that the match may follow
_SCORED_PAIRS = _REPS.rstrip().replace("WITH", "WITH RECURSIVE", 1) + f""",
e AS (SELECT file_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dd FROM reps),
m AS (SELECT file_id, list(x ORDER BY dd) AS v FROM (SELECT file_id, dd, avg(x) AS x FROM e GROUP BY ALL) GROUP BY file_id),
sl AS (SELECT a.file_id AS x, b.file_id AS y FROM m a JOIN m b ON a.file_id <> b.file_id
  QUALIFY row_number() OVER (PARTITION BY a.file_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.file_id) <= 8),
pr AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM sl), nn AS (SELECT file_id, count(*) AS n FROM reps GROUP BY 1),
sm AS (SELECT a, b, l.pos AS i, r.pos AS j, round(coalesce(nullif(list_cosine_similarity(l.embedding, r.embedding), 'nan'::DOUBLE), 0), 12) AS s FROM pr JOIN reps l ON l.file_id = a JOIN reps r ON r.file_id = b),
ls AS (SELECT a, b, list([{{'i': i, 'j': j, 's': s}}] ORDER BY s DESC, i, j) AS l FROM sm WHERE s >= 0.75 GROUP BY a, b),
gr AS (SELECT a, b, list_sort(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.i = x[1].i OR k.j = x[1].j)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM ls),
ch AS (SELECT a, b, list_reduce(list_transform(k, lambda q: [[q]]), lambda acc, x: list_concat(list_concat(acc[1:{_AT}], [CASE WHEN {_AT} > 0 THEN list_concat(acc[{_AT}], x[1]) ELSE x[1] END]), acc[{_AT} + 2:])) AS c FROM gr),
sc AS (SELECT a, b, least(p.n, q.n) AS small, c[-1] AS run FROM ch JOIN nn p ON p.file_id = a JOIN nn q ON q.file_id = b),
ps AS (SELECT a, b, least(1.0::DOUBLE, greatest(0.0::DOUBLE, len(run)::DOUBLE / small * (list_sum(list_transform(run, lambda q: q.s)) / len(run)))) AS similarity FROM sc WHERE len(run) >= least(2, small))"""


@query(_SCORED_PAIRS + """, ed AS (SELECT a, b FROM ps WHERE similarity >= 0.9 UNION SELECT b, a FROM ps WHERE similarity >= 0.9),
r AS (SELECT a, b FROM ed UNION SELECT r.a, ed.b FROM r JOIN ed ON r.b = ed.a), c AS (SELECT a AS file_id, min(b) AS component FROM r GROUP BY a)
SELECT c.component, c.file_id, round(w.best, 6) AS best FROM c JOIN (SELECT component, greatest(0.9::DOUBLE, max(similarity)) AS best FROM ps JOIN c ON c.file_id = ps.a WHERE similarity >= 0.9 GROUP BY component) w USING (component)""")
def semantic_duplicates(spark, d):
    return semantic.semantic_groups(_latest_vectors(spark, d), 0.9, None).select("component", "file_id", F.round("best_similarity", 6).alias("best"))


@query(_SCORED_PAIRS + " SELECT a, b, round(similarity, 6) AS similarity FROM ps WHERE similarity < 0.9 AND similarity >= 0.9 - 0.05")
def uncertain_pairs(spark, d):
    return semantic.uncertain_pairs(_latest_vectors(spark, d), 0.9, None).select("a", "b", F.round("similarity", 6).alias("similarity"))


_TREE = r"""WITH RECURSIVE o AS (SELECT id, min(CASE WHEN regexp_matches(parent_ids[1], '\S') THEN parent_ids[1] END) AS parent, min(name) AS name FROM folders WHERE id IS NOT NULL GROUP BY id),
l AS (SELECT o.id, p.id AS parent, o.name FROM o LEFT JOIN o p ON o.parent = p.id)"""


@query(_TREE + """, e AS (SELECT id AS a, parent AS b FROM l WHERE parent IS NOT NULL AND parent <> id UNION SELECT parent, id FROM l WHERE parent IS NOT NULL AND parent <> id),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def connected_components(spark, d):
    e = hierarchy.links(table(spark, d, "folders")).where("parent is not null").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    return components.connected_components(e)


@query(_TREE + """, u AS (SELECT id AS node, id AS cur, parent AS nxt, [id] AS seen, [trim(coalesce(name, ''))] AS names FROM l
  UNION ALL SELECT u.node, l.id, l.parent, list_append(seen, l.id), list_prepend(trim(coalesce(l.name, '')), names) FROM u JOIN l ON l.id = u.nxt WHERE NOT list_contains(seen, l.id) AND len(seen) < 20),
t AS (SELECT node, arg_max(names, len(seen)) AS names FROM u GROUP BY node)
SELECT node AS folder_id, CASE WHEN array_to_string(list_filter(names, lambda x: x <> ''), ' / ') = '' THEN coalesce(l.name, '') ELSE array_to_string(list_filter(names, lambda x: x <> ''), ' / ') END AS label FROM t JOIN l ON l.id = t.node""")
def folder_paths(spark, d):
    return semantic.folder_labels(table(spark, d, "folders"))


@query(_TREE + """, u AS (SELECT id AS node, id AS cur, parent AS nxt, [id] AS seen, [trim(coalesce(name, ''))] AS names FROM l
  UNION ALL SELECT u.node, l.id, l.parent, list_append(seen, l.id), list_prepend(trim(coalesce(l.name, '')), names) FROM u JOIN l ON l.id = u.nxt WHERE NOT list_contains(seen, l.id) AND len(seen) < 20),
t AS (SELECT node, list_filter(arg_max(names, len(seen)), lambda x: x <> '') AS names FROM u GROUP BY node),
""" + _VEC.replace("\nWITH ", "").rstrip() + """,
fc AS (SELECT id, folder_id FROM files WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_at DESC NULLS LAST) = 1),
e AS (SELECT folder_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dd FROM lat JOIN fc ON fc.id = lat.file_id WHERE folder_id IS NOT NULL),
m AS (SELECT folder_id, list(x ORDER BY dd) AS v FROM (SELECT folder_id, dd, avg(x) AS x FROM e GROUP BY ALL) GROUP BY folder_id)
SELECT m.folder_id, CASE WHEN len(t.names) = 0 THEN coalesce(l.name, '') ELSE array_to_string(t.names, ' / ') END AS label, round(list_cosine_similarity(v, q), 6) AS score
FROM m JOIN t ON t.node = m.folder_id JOIN l ON l.id = m.folder_id, q WHERE nth = 0 ORDER BY list_cosine_similarity(v, q) DESC, label, m.folder_id LIMIT 5""")
def folder_suggestions(spark, d):
    """Folders ranked for one document vector; a folder's vector is the mean of its files' vectors."""
    files = _files(spark, d).where("folder_id is not null").select(F.col("id").alias("file_id"), "folder_id")
    emb = semantic.mean_embedding(_latest_vectors(spark, d).join(files, "file_id"), "folder_id")
    return semantic.suggest_folders(list(_query_vector(spark, d)), semantic.folder_labels(table(spark, d, "folders")), emb, 5).withColumn("score", F.round("score", 6))


@query(_FILES + "SELECT f.id AS folder_id, count(c.id) AS n FROM (SELECT DISTINCT id FROM folders WHERE id IS NOT NULL) f LEFT JOIN cur c ON c.folder_id = f.id GROUP BY f.id")
def folder_counts(spark, d):
    n = _files(spark, d).groupBy("folder_id").agg(F.count("*").alias("n"))
    return table(spark, d, "folders").where("id is not null").select(F.col("id").alias("folder_id")).distinct().join(n, "folder_id", "left").select("folder_id", F.coalesce("n", F.lit(0)).alias("n"))


# -- upkeep -------------------------------------------------------------------------------------

_CURS = """WITH fcur AS (SELECT * FROM files WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_at DESC NULLS LAST) = 1),
dcur AS (SELECT *, coalesce(corpus_key, 'user') AS ck FROM documents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY TRY_CAST(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST, doc_id DESC) = 1)
"""


@query(_CURS + """SELECT f.id, CASE WHEN d.id IS NULL THEN 'missing' WHEN coalesce(f.modified_time, '') <> '' AND coalesce(d.drive_modified_time, '') = '' THEN 'unknown-revision'
 WHEN coalesce(f.modified_time, '') <> '' AND d.drive_modified_time <> f.modified_time THEN 'revision' END AS reason FROM fcur f LEFT JOIN dcur d ON d.id = f.id""")
def stale_documents(spark, d):
    return upkeep.stale_documents(_files(spark, d), _docs(spark, d)).select("id", "reason")


@query(_CURS + "SELECT id FROM dcur WHERE ck <> 'user' OR id IN (SELECT id FROM fcur)")
def prune_missing(spark, d):
    return upkeep.prune_missing(_docs(spark, d), _files(spark, d), True, "user").select("id")


_ACT = f"""WITH c AS (SELECT DISTINCT file_id, idx, text FROM chunks WHERE trim(text) <> ''), s AS (SELECT file_id, idx, sha256(text) AS h FROM c),
v AS (SELECT file_id, idx, content_hash, embedding_model = '{MODEL}' AND embedding_version = '{VERSION}' AND dimension = {DIM} AND len(embedding) = {DIM} AS ok FROM vectors WHERE file_id IN (SELECT file_id FROM s)),
j AS (SELECT coalesce(s.file_id, v.file_id) AS file_id, coalesce(s.idx, v.idx) AS idx, max(CASE WHEN h IS NULL THEN 0 WHEN coalesce(ok AND content_hash = h, false) THEN 2 ELSE 1 END) AS a
  FROM s FULL JOIN v ON s.file_id = v.file_id AND s.idx = v.idx GROUP BY 1, 2)
"""


@query(_ACT + "SELECT file_id, idx, CASE a WHEN 0 THEN 'delete' WHEN 1 THEN 'embed' ELSE 'keep' END AS action FROM j")
def vector_actions(spark, d):
    return upkeep.vector_actions(table(spark, d, "chunks").distinct(), table(spark, d, "vectors"), MODEL, VERSION, DIM)


@query(_ACT + "SELECT file_id, bool_and(a = 2) AS complete FROM j GROUP BY file_id")
def vector_set_compatible(spark, d):
    return upkeep.vector_sets(table(spark, d, "chunks").distinct(), table(spark, d, "vectors"), MODEL, VERSION, DIM)


@query(_FILES + """SELECT id FROM cur WINDOW w AS (ORDER BY modified_time DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING)
QUALIFY row_number() OVER w > 79 OR sum(coalesce(size, 0)) OVER w + 1000000 > 209715200""")
def lru_eviction(spark, d):
    cache = _files(spark, d).select("id", F.col("modified_time").alias("cached_at"), "size")
    return upkeep.lru_evictions(cache, incoming=1_000_000)


@query(_FILES + "SELECT count(*) FILTER (is_offline) AS entries, CAST(coalesce(sum(size) FILTER (is_offline), 0) AS BIGINT) AS bytes FROM cur")
def cache_stats(spark, d):
    return _files(spark, d).agg(F.count_if(F.col("is_offline")).alias("entries"), F.coalesce(F.sum(F.when(F.col("is_offline"), F.col("size"))), F.lit(0)).alias("bytes"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 120")
def ring_buffer(spark, d):
    return upkeep.ring_buffer(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")).drop("ts")


@query("""WITH s AS (SELECT DISTINCT seq - (SELECT min(seq) FROM drive_changes) AS i FROM drive_changes)
SELECT min(i) AS cursor FROM (SELECT i + 1 AS i FROM s UNION SELECT 0) WHERE i NOT IN (SELECT i FROM s)""")
def contiguous_cursor(spark, d):
    c = table(spark, d, "drive_changes")
    low = c.agg(F.min("seq")).first()[0]
    return upkeep.contiguous_cursor(c.select((F.col("seq") - low).alias("idx")))


def _requests(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("user"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("request_id"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT user_id, event_id, ms, k, ms + 86400000 AS reset_at, 1 AS c FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.ms, o.k, CASE WHEN o.ms >= s.reset_at THEN o.ms + 86400000 ELSE s.reset_at END, CASE WHEN o.ms >= s.reset_at THEN 1 ELSE s.c + 1 END
  FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id AS "user", ms AS ts, event_id AS request_id, c <= 1 AS allowed, CASE WHEN c <= 1 THEN 0 ELSE greatest(1, CAST(ceil((reset_at - ms) / 1000.0) AS BIGINT)) END AS retry_after, c = 2 AS log_event FROM s""")
def rate_limit_decisions(spark, d):
    return upkeep.rate_limit_decisions(_requests(spark, d), limit=1, window_ms=86_400_000)


@query("""WITH r AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id AS "user", count(*) FILTER (p IS NULL OR ms - p >= 60000) AS sessions FROM r GROUP BY user_id""")
def rate_limit_sessions(spark, d):
    return upkeep.rate_limit_sessions(_requests(spark, d)).select("user", "session").distinct().groupBy("user").agg(F.count("*").alias("sessions"))


@query("""WITH e(total, batch_end, contiguous_cursor, failures, cancelled, aborted) AS (SELECT 500 + event_id % 7 * 10, event_id % 600, event_id % 550, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id % 97 = 0, event_id % 89 = 0 FROM events)
SELECT CASE WHEN cancelled OR aborted THEN 'stopped' WHEN contiguous_cursor >= total THEN 'done' WHEN failures > 0 THEN 'retry' WHEN batch_end < total THEN 'continue' ELSE 'incomplete' END AS kind, count(*) AS n FROM e GROUP BY 1""")
def batch_transitions(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select((500 + i % 7 * 10).alias("total"), (i % 600).alias("batch_end"), (i % 550).alias("contiguous_cursor"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("failures"), (i % 97 == 0).alias("cancelled"), (i % 89 == 0).alias("aborted"))
    return e.groupBy(upkeep.batch_transition()["kind"].alias("kind")).agg(F.count("*").alias("n"))


@query(_FILES + "SELECT sha256('user|scope:all|' || string_agg(id || ':' || coalesce(modified_time, ''), '|' ORDER BY id || ':' || coalesce(modified_time, ''))) AS signature FROM cur")
def index_signature(spark, d):
    return upkeep.index_signature(_files(spark, d), "user", "all")


@query(_CURS + """SELECT 'document source unknown' AS rule, count(*) FILTER (source IS NULL OR source NOT IN ('export', 'binary-text', 'offline-blob')) AS violations FROM documents
UNION ALL SELECT 'document char_count wrong', count(*) FILTER (coalesce(char_count <> length(text), true)) FROM documents
UNION ALL SELECT 'document id repeated', CAST(count(*) - count(DISTINCT id) AS BIGINT) FROM documents
UNION ALL SELECT 'vector id repeated', CAST(count(*) - count(DISTINCT id) AS BIGINT) FROM vectors
UNION ALL SELECT 'vector key wrong', count(*) FILTER (coalesce(id <> coalesce(corpus_key, 'user') || '::' || file_id || '#' || idx, true)) FROM vectors
UNION ALL SELECT 'vector without document', count(*) FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.id = v.file_id AND coalesce(x.corpus_key, 'user') = coalesce(v.corpus_key, 'user'))""")
def backup_validation(spark, d):
    rules = ("document source unknown", "document char_count wrong", "document id repeated", "vector id repeated", "vector key wrong", "vector without document")
    return validation.backup_violations(table(spark, d, "documents"), table(spark, d, "vectors")).where(F.col("rule").isin(*rules))


@query(_CURS + "SELECT (SELECT count(*) FROM dcur) AS documents, (SELECT count(*) FROM vectors) AS vectors, (SELECT count(*) FROM fcur) AS files, (SELECT count(DISTINCT id) FROM folders) AS folders")
def backup_summary(spark, d):
    one = lambda t, n: t.agg(F.count("*").alias(n))  # noqa: E731 - four single rows
    out = one(_docs(spark, d), "documents")
    for t, n in ((table(spark, d, "vectors"), "vectors"), (_files(spark, d), "files"), (table(spark, d, "folders").select("id").distinct(), "folders")):
        out = out.crossJoin(one(t, n))
    return out


@query("SELECT CAST((SELECT sum(length(coalesce(text, '')) * 4 + length(coalesce(name, '')) * 8 + 2048) FROM documents) + (SELECT sum(coalesce(len(embedding), 0) * 16 + length(coalesce(text, '')) * 4 + 2048) FROM vectors) AS BIGINT) AS bytes")
def backup_bytes(spark, d):
    return validation.backup_bytes(table(spark, d, "documents"), table(spark, d, "vectors"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents")
def encrypt_roundtrip(spark, d):
    key = crypto.derive_key("a long enough passphrase", b"0123456789abcdef")
    sealed = table(spark, d, "documents").select("doc_id", crypto.encrypt(F.coalesce("text", F.lit("")), key).alias("x"))
    return sealed.select("doc_id", F.md5(crypto.decrypt(F.col("x"), key)).alias("h"))


@query(_CURS + """, m AS (SELECT id, 'ab' || id AS sha, drive_modified_time AS rev FROM dcur)
SELECT f.id, CASE WHEN m.id IS NULL THEN content_hash WHEN coalesce(rev, '') <> '' AND rev = modified_time THEN 'sha256:' || sha
 WHEN starts_with(coalesce(content_hash, ''), 'sha256:') THEN CASE WHEN content_hash_modified_time = modified_time AND content_hash_modified_time <> '' THEN content_hash ELSE 'gdrive-' || f.id || '-' || coalesce(size, 0) END
 ELSE content_hash END AS content_hash FROM fcur f LEFT JOIN m ON m.id = f.id""")
def offline_hashes(spark, d):
    metas = _docs(spark, d).select("id", F.concat(F.lit("ab"), "id").alias("sha256"), "drive_modified_time")
    return upkeep.apply_cache_meta(_files(spark, d), metas).select("id", "content_hash")


@query(_CURS + "SELECT f.id, CASE WHEN d.id IS NOT NULL THEN coalesce(d.drive_modified_time = f.modified_time, false) END AS verified FROM fcur f LEFT JOIN dcur d ON d.id = f.id")
def hash_verification(spark, d):
    hashed = _docs(spark, d).select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("drive_modified_time").alias("modified_time"))
    return upkeep.verify_hashes(_files(spark, d), hashed).select("id", "verified")


@query(_CURS + "SELECT id FROM fcur WHERE coalesce(is_drive_item, false) UNION SELECT id FROM fcur WHERE NOT coalesce(is_drive_item, false)")
def merged_listing(spark, d):
    f = _files(spark, d)
    return upkeep.merge_listing(f.where(F.coalesce("is_drive_item", F.lit(False))), f).select("id")


@query(_FILES + "SELECT count(DISTINCT file_id) AS legacy FROM vectors WHERE regexp_matches(text, '^title: .* \\| text: ') AND file_id IN (SELECT id FROM cur)")
def legacy_profiles(spark, d):
    return validation.legacy_profiles(table(spark, d, "vectors"), _files(spark, d)).agg(F.count("*").alias("legacy"))


@query(_CURS + """SELECT id FROM dcur WHERE id IN (SELECT id FROM fcur) AND id NOT IN (SELECT file_id FROM vectors WHERE file_id IS NOT NULL AND (regexp_matches(text, '^title: .* \\| text: ') OR embedding_version = '2'))""")
def available_documents(spark, d):
    v = table(spark, d, "vectors").where(validation.is_legacy_chunk(F.col("text")) | (F.col("embedding_version") == "2"))
    return search.available_documents(_docs(spark, d), _files(spark, d), v.select("file_id")).select("id")


@query(_FILES + "SELECT id FROM cur WHERE coalesce(starred, false)")
def starred_files(spark, d):
    return search.category_filter(_files(spark, d), "starred").select("id")


@query(_FILES + "SELECT id FROM cur WHERE contains(lower(concat_ws(' ', name, folder_id)), 'report')")
def device_filter(spark, d):
    return _files(spark, d).where(validation.device_filter(F.col("name"), F.col("folder_id"), " Report ")).select("id")


@query(_CURS + """, gone AS (SELECT id FROM dcur WHERE source = 'export')
SELECT (SELECT count(*) FROM dcur WHERE coalesce(source <> 'export', true)) AS documents, (SELECT count(*) FROM chunks WHERE file_id NOT IN (SELECT id FROM gone)) AS chunks,
 (SELECT count(*) FROM vectors WHERE file_id NOT IN (SELECT id FROM gone)) AS vectors, (SELECT count(*) FROM vectors WHERE file_id IN (SELECT id FROM fcur)) AS live_vectors""")
def delete_document_set(spark, d):
    docs, vectors = _docs(spark, d), table(spark, d, "vectors")
    left = upkeep.delete_documents({"documents": docs, "chunks": table(spark, d, "chunks"), "vectors": vectors}, docs.where("source = 'export'").select("id"))
    left["live_vectors"] = upkeep.prune_vectors(vectors, _files(spark, d), True)
    out = None
    for name in ("documents", "chunks", "vectors", "live_vectors"):
        one = left[name].agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


@query("""SELECT CASE WHEN trim(text) = '' THEN 'empty text not allowed' WHEN length(trim(text)) > 8000 THEN 'text too long' END AS error, count(*) AS n FROM documents GROUP BY 1""")
def embed_requests(spark, d):
    e = validation.embed_request_error(F.array("text"), F.lit("document"), F.lit("3"))
    return table(spark, d, "documents").groupBy(e.alias("error")).agg(F.count("*").alias("n"))


@query("""SELECT ck AS corpus_key, count(*) AS documents, CAST(sum(coalesce(chunk_count, 0)) AS BIGINT) AS chunks FROM (SELECT *, coalesce(corpus_key, 'user') AS ck FROM documents WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY TRY_CAST(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST, doc_id DESC) = 1) GROUP BY ck""")
def corpus_counts(spark, d):
    return _docs(spark, d).groupBy("corpus_key").agg(F.count("*").alias("documents"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunks"))
