"""Registered queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import consensus, mixing, neardup, packing, scans, similar, spans, splitting
from corvane.functions.catalog import millis
from corvane.operators import duplicates
from corvane.operators.changefeed import current_rows
from corvane.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return neardup.unique_ids(table(spark, d, "documents"))


def _p2_sql(k: int, least: int, threshold: float) -> str:
    gram = ", ".join(f"t[i + {j}]" for j in range(k))
    return f"""
WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, list_value({gram}) AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - {k - 2})) AS i FROM tok WHERE len(t) >= {least})),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {threshold} * (x.n + y.n - c))
"""


@query(_p2_sql(3, 20, 0.6) + "SELECT a AS doc_id_a, b AS doc_id_b FROM pairs")
def p2_found(spark, d):
    return neardup.expand_pairs(neardup.near_duplicates(_docs(spark, d), k=3, threshold=0.6, min_tokens=20))


@query(_p2_sql(5, 5, 0.8) + """
SELECT n.doc_id, count(p.o) AS links FROM n LEFT JOIN (SELECT a AS doc_id, b AS o FROM pairs UNION ALL SELECT b, a FROM pairs) p USING (doc_id) GROUP BY n.doc_id""")
def p2_links(spark, d):
    return neardup.link_counts(neardup.near_duplicates(_docs(spark, d))).select("doc_id", "links")


@query(_p2_sql(5, 5, 0.8).replace("WITH", "WITH RECURSIVE", 1) + """, bi AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT a, b FROM bi UNION SELECT r.a, bi.b FROM r JOIN bi ON r.b = bi.a)
SELECT n.doc_id, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS group_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id""")
def p2_groups(spark, d):
    return neardup.duplicate_groups(_docs(spark, d))


@query("""
WITH t AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
h AS (SELECT DISTINCT doc_id, hash(substr(text, i, 200)) AS h FROM t),
r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1), k AS (SELECT * FROM h WHERE h IN (SELECT h FROM r))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id""")
def p10_found(spark, d):
    return spans.shared_pairs(spans.shared_spans(table(spark, d, "documents"), 200))


@query("""
WITH t AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
h AS (SELECT doc_id, i, hash(substr(text, i, 200)) AS h FROM t),
r AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1),
k AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM h WHERE h IN (SELECT h FROM r)),
s AS (SELECT doc_id, sum(least(200, coalesce(n - i, 200))) AS c FROM k GROUP BY doc_id)
SELECT d.doc_id, length(text)::BIGINT AS n_chars, coalesce(s.c, 0)::BIGINT AS shared_chars, round(coalesce(s.c, 0)::DOUBLE / length(text), 6) AS share FROM documents d LEFT JOIN s USING (doc_id) WHERE length(text) >= 200""")
def p10_share(spark, d):
    return spans.shared_share(spans.shared_spans(table(spark, d, "documents"), 200))


def _limit(spark, d, name):
    r = table(spark, d, "size_limits").where(F.col("limit_name") == name).first()
    return r["max_size"], r["overlap_min"], r["overlap_max"]


@query("SELECT doc_id FROM documents WHERE strlen(text) > (SELECT max_size FROM size_limits WHERE limit_name = 'container')")
def p8_found(spark, d):
    return packing.oversized(packing.pack(table(spark, d, "documents"), _limit(spark, d, "container")[0]))


@query()
def p8_containers(spark, d):
    return packing.fill(packing.pack(table(spark, d, "documents"), _limit(spark, d, "container")[0]))


@query("""WITH n AS (SELECT source, sum(strlen(text)) AS t FROM documents GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN n USING (source)
WHERE m.max_repeats * coalesce(n.t, 0) < m.target_share * (SELECT sum(strlen(text)) FROM documents)""")
def p9_found(spark, d):
    return mixing.capped_sources(mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")))


@query()
def p9_mixture(spark, d):
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).documents


@query()
def p9_report(spark, d):
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


@query("""WITH n AS (SELECT source, sum(strlen(text)) AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY source)
SELECT m.source, CAST(coalesce(n.t, 0) AS BIGINT) AS tokens, m.max_repeats * coalesce(n.t, 0) < m.target_share * (SELECT sum(t) FROM n) AS capped, true AS limit_kept, true AS share_met
FROM mix_targets m LEFT JOIN n USING (source)""")
def p9_audit(spark, d):
    """Every source keeps its limit, and has its target within one text unless every text is used as often as allowed."""
    docs = table(spark, d, "documents")
    longest = docs.agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("longest"), F.sum(F.octet_length("text")).alias("whole"))
    r = mixing.mix_sources(docs, table(spark, d, "mix_targets")).report.crossJoin(F.broadcast(longest))  # one row
    return r.select("source", "tokens", "capped", (F.col("most_repeats") <= F.col("max_repeats")).alias("limit_kept"),
                    (F.col("capped") | (F.col("used") >= F.col("target_share") * F.col("whole") - F.col("longest"))).alias("share_met"))


@query(r"""
WITH lim AS (SELECT max_size AS m, overlap_min AS lo, overlap_max AS hi FROM size_limits WHERE limit_name = 'piece'),
p AS (SELECT DISTINCT file_id, idx, coalesce(text, '') AS text FROM chunks WHERE file_id IS NOT NULL AND idx IS NOT NULL),
q AS (SELECT *, lag(text) OVER (PARTITION BY file_id ORDER BY idx) AS prev FROM p),
d AS (SELECT id, trim(regexp_replace(text, '[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) AS t FROM documents WHERE id IS NOT NULL AND text IS NOT NULL),
o AS (SELECT q.file_id, q.idx, t, unnest(list_filter(range(1, length(t) - length(text) + 2), lambda i: substr(t, i, length(text)) = text)) AS i, length(text) AS n FROM q JOIN d ON d.id = q.file_id WHERE contains(t, text)),
e AS (SELECT file_id, idx, substr(t, 1, i - 1) AS l1, substr(t, i) AS r1, substr(t, 1, i + n - 1) AS l2, substr(t, i + n) AS r2 FROM o),
w AS (SELECT file_id, idx, bool_and(coalesce((l1 <> '' AND NOT ends_with(l1, ' ') AND NOT starts_with(r1, ' ') AND length(regexp_extract(l1, '[^ ]*$')) + length(regexp_extract(r1, '^[^ ]*')) <= 80)
   OR (r2 <> '' AND NOT ends_with(l2, ' ') AND NOT starts_with(r2, ' ') AND length(regexp_extract(l2, '[^ ]*$')) + length(regexp_extract(r2, '^[^ ]*')) <= 80), false)) AS bad FROM e GROUP BY ALL),
v AS (SELECT file_id, idx, prev IS NOT NULL AND NOT coalesce(list_max(list_filter(range(1, least(length(prev), length(text)) + 1), lambda k: right(prev, k) = left(text, k))) BETWEEN lo AND hi, false) AS bad, length(text) > m AS long FROM q, lim)
SELECT DISTINCT v.file_id, v.idx FROM v LEFT JOIN w ON w.file_id = v.file_id AND w.idx = v.idx WHERE v.long OR v.bad OR coalesce(w.bad, false)""".replace("\\\\", "\\"))
def p6_found(spark, d):
    limit, low, high = _limit(spark, d, "piece")
    return splitting.faulty_pieces(splitting.audit_pieces(table(spark, d, "chunks"), table(spark, d, "documents"), limit, low, high))


_FLAT = r"trim(regexp_replace(text, '[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))"


@query(f"SELECT doc_id, length({_FLAT}) AS n_chars, true AS covers, true AS fits, true AS laps FROM documents WHERE text IS NOT NULL AND {_FLAT} <> ''")
def p6_audit(spark, d):
    """Pieces cover their document, keep the limit and overlap as asked. (A text is as long as its last piece's end.)"""
    limit, low, high = _limit(spark, d, "piece")
    p = splitting.split_documents(table(spark, d, "documents"), limit, low, high).withColumn("end", F.col("start") + F.length("text"))
    w = W.partitionBy("doc_id").orderBy("idx")
    p = p.withColumn("lap", F.lag("end").over(w) - F.col("start"))
    return p.groupBy("doc_id").agg(
        F.max("end").alias("n_chars"), F.min((F.col("idx") > 0) & (F.col("lap") >= 0) | (F.col("start") == 0)).alias("covers"), (F.max(F.length("text")) <= limit).alias("fits"),
        F.coalesce(F.min(F.col("lap").between(low, high)), F.lit(True)).alias("laps"))


@query("SELECT doc_id, strlen(text) AS tokens, ceil(strlen(text) / (SELECT max_size FROM size_limits WHERE limit_name = 'container'))::BIGINT AS pieces, true AS fits FROM documents WHERE strlen(text) > 0")
def p8_audit(spark, d):
    """Every text is in containers whole, cut only if it exceeds one, and no container that holds some of it is overfull."""
    capacity = _limit(spark, d, "container")[0]
    items = packing.pack(table(spark, d, "documents"), capacity).items.where("container_id is not null")
    used = items.groupBy("container_id").agg((F.sum("size") <= capacity).alias("ok"))
    return items.join(used, "container_id").groupBy("doc_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("pieces"), F.min("ok").alias("fits"))


@query()
def p6_pieces(spark, d):
    limit, low, high = _limit(spark, d, "piece")
    return splitting.split_documents(table(spark, d, "documents"), limit, low, high)


_P4 = r"""
WITH cur AS (SELECT * FROM files WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_at DESC) = 1),
k AS (SELECT *, CASE WHEN coalesce(content_hash, '') = '' OR starts_with(content_hash, 'gdrive-') OR starts_with(content_hash, 'user-')
    OR (starts_with(content_hash, 'sha256:') AND NOT coalesce(content_hash_modified_time <> '' AND content_hash_modified_time = modified_time, false))
  THEN CASE WHEN size > 0 THEN 'size:' || size || '|name:' || lower(coalesce(name, '')) END ELSE content_hash END AS dup_key,
  epoch_ms(TRY_CAST(created_time AS TIMESTAMPTZ)) AS c, epoch_ms(TRY_CAST(modified_time AS TIMESTAMPTZ)) AS m FROM cur),
g AS (SELECT *, count(*) OVER w AS n, max(coalesce(size, 0)) OVER w AS mx, min(c) OVER w AS c0 FROM k WHERE dup_key IS NOT NULL WINDOW w AS (PARTITION BY dup_key)),
s AS (SELECT *, coalesce(size, 0)::DOUBLE / greatest(1, mx)::DOUBLE * 12.0::DOUBLE + CASE WHEN starred THEN 40.0::DOUBLE ELSE 0 END + CASE WHEN is_offline THEN 15.0::DOUBLE ELSE 0 END
  + CASE WHEN coalesce(folder_id, '') NOT IN ('', 'root') THEN 8.0::DOUBLE ELSE 0 END + CASE WHEN length(coalesce(semantic_summary, '')) >= 80 THEN 4.0::DOUBLE ELSE 0 END
  - CASE WHEN regexp_matches(lower(coalesce(name, '')), '(^|[^a-z0-9_])(copy|duplicate|dup)([^a-z0-9_]|$)|\(copy( [0-9]+)?\)|\([0-9]+\)$') THEN 25.0::DOUBLE ELSE 0 END
  + CASE WHEN c IS NOT NULL THEN greatest(0.0::DOUBLE, 8.0::DOUBLE - least(8.0::DOUBLE, (c - c0)::DOUBLE / 86400000.0::DOUBLE / 365.0::DOUBLE)) ELSE 0 END AS score FROM g WHERE n > 1)
"""


@query(_P4 + """SELECT id AS keep_id FROM s
QUALIFY row_number() OVER (PARTITION BY dup_key ORDER BY score DESC, coalesce(c, 4611686018427387904), coalesce(m, 4611686018427387904), coalesce(name, ''), id) = 1""")
def p4_found(spark, d):
    return consensus.best_representatives(table(spark, d, "files")).select("keep_id")


_ORDER = "score DESC, coalesce(c, 4611686018427387904), coalesce(m, 4611686018427387904), coalesce(name, ''), id"


@query(_P4 + f""", f AS (SELECT dup_key, max(n) AS group_size, first(id ORDER BY {_ORDER}) AS keep_id, round(max(score), 6) AS keep_score,
  {", ".join(f"first({x} ORDER BY {x} IS NULL, {_ORDER}) AS {x}" for x in ("mime_type", "size", "created_time", "folder_id", "category"))},
  max(m) AS modified_ms, bool_or(coalesce(starred, false)) AS starred FROM s GROUP BY dup_key),
t AS (SELECT dup_key, string_agg(t, ',' ORDER BY t) AS tags FROM (SELECT DISTINCT dup_key, unnest(tags) AS t FROM s) WHERE t IS NOT NULL GROUP BY dup_key),
o AS (SELECT dup_key, count(DISTINCT name) AS names, count(DISTINCT semantic_summary) AS summaries FROM s GROUP BY dup_key)
SELECT f.*, t.tags, names > 0 AS named, summaries > 0 AS summed FROM f JOIN o USING (dup_key) LEFT JOIN t USING (dup_key)""")
def p4_fields(spark, d):
    """Everything of a representative but the wording of its voted texts, which must be texts of the group."""
    files = table(spark, d, "files")
    r = consensus.best_representatives(files)
    own = duplicates.scored_files(current_rows(files)).select("dup_key", F.explode(F.array(F.struct(F.lit("n").alias("f"), F.col("name").alias("v")), F.struct(F.lit("s").alias("f"), F.col("semantic_summary").alias("v")))).alias("o"))
    hit = own.join(r.select("dup_key", "name", "semantic_summary"), "dup_key").groupBy("dup_key").agg(
        F.coalesce(F.bool_or((F.col("o.f") == "n") & (F.col("o.v") == F.col("name"))), F.lit(False)).alias("named"), F.coalesce(F.bool_or((F.col("o.f") == "s") & (F.col("o.v") == F.col("semantic_summary"))), F.lit(False)).alias("summed"))
    return r.join(hit, "dup_key").select(
        "dup_key", "group_size", "keep_id", F.round("keep_score", 6).alias("keep_score"), "mime_type", "size", "created_time", "folder_id", "category", millis("modified_time").alias("modified_ms"), "starred",
        F.when(F.size("tags") > 0, F.array_join("tags", ",")).alias("tags"), "named", "summed")


@query()
def p4_representatives(spark, d):
    return consensus.best_representatives(table(spark, d, "files"))


@query()
def p5_found(spark, d):
    return scans.scan_noise(table(spark, d, "documents"))


@query()
def p5_repaired(spark, d):
    return scans.repair_scans(table(spark, d, "documents"))


_P1 = """
WITH lat AS (SELECT * FROM vectors WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) = 1),
u AS (SELECT id, coalesce(file_id, id) AS f, coalesce(corpus_key, 'user') AS c, embedding AS e FROM lat WHERE embedding_model = 'multi-embed-b' AND embedding_version = '3' AND dimension = 64 AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM u a JOIN u b ON a.c = b.c AND a.f <> b.f)"""


@query(_P1 + """,
t AS (SELECT a, b FROM s WHERE s >= 0.90 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t""")
def p1_found(spark, d):
    return similar.similar_pairs(similar.similar_vectors(table(spark, d, "vectors"), wanted=0.90))


@query(_P1 + """
SELECT a AS id, CAST(row_number() OVER (PARTITION BY a ORDER BY round(s, 7) DESC, b) AS INT) AS rank, round(s, 4) AS cosine FROM s QUALIFY rank <= 5""")
def p1_neighbours(spark, d):
    return similar.similar_vectors(table(spark, d, "vectors")).select("id", "rank", F.round("cosine", 4).alias("cosine"))


@query("""
WITH lat AS (SELECT * FROM vectors WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) = 1)
SELECT count(*) AS queries, true AS reached FROM lat WHERE embedding_model = 'multi-embed-b' AND embedding_version = '3' AND dimension = 64 AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  AND CAST('0x' || substr(md5(id), 1, 4) AS INT) % 100 = 0""")
def p1_recall(spark, d):
    """Whether at least nine of ten true neighbours are found, for every hundredth vector, without a floor on the cosine."""
    r = similar.recall(table(spark, d, "vectors"))
    return r.select("queries", (F.col("recall") >= 0.9).alias("reached"))
