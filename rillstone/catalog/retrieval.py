"""Retrieval queries: documents as the corpus, benchmark items as the queries, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval as R
from ..plans.scratch import settle
from ..plans.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


DIFFICULTY = "CASE WHEN n_chars < 700 THEN 'beginner' WHEN n_chars < 1400 THEN 'beginner-intermediate' WHEN n_chars < 2800 THEN 'intermediate' ELSE 'advanced' END"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text", F.col("source").alias("module"), F.expr(DIFFICULTY).alias("difficulty"), "lang")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text of each item as a query, with filters derived from its id."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.col("text").alias("query"),
        F.expr("CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 20) WHEN item_id % 3 = 1 THEN 'Any course topic' END").alias("module"),
        F.expr("element_at(array('Entry-level', 'Mid-level', 'Senior', 'Staff', 'unknown'), cast(item_id % 5 as int) + 1)").alias("level"),
        F.expr("CASE WHEN item_id % 2 = 0 THEN sequence(0L, item_id) ELSE cast(array() as array<bigint>) END").alias("exclude"),
    )


TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
BM25_CTE = f"""
doc AS (SELECT doc_id AS idx, source AS module, lang, {DIFFICULTY} AS difficulty, {TOK} AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM doc),
post AS (SELECT idx, dl, term, count(*) AS tf FROM (SELECT idx, len(toks) AS dl, unnest(toks) AS term FROM doc) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
qterm AS (SELECT DISTINCT item_id AS qid, unnest({TOK}) AS term FROM benchmark),
scored AS (SELECT q.qid, p.idx, round(sum(i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / (SELECT avgdl FROM stats)))), 6) AS score
  FROM qterm q JOIN post p ON p.term = q.term JOIN idf i ON i.term = q.term GROUP BY ALL)"""


@query(f"WITH {BM25_CTE} SELECT qid AS item_id, r::INTEGER AS rank, idx AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM scored) WHERE r <= 5")
def bm25_topk(spark, sf):
    best = R.top_k(R.bm25_scores(corpus(spark, sf), items(spark, sf)), 5)
    return best.select(F.col("qid").alias("item_id"), "rank", F.col("idx").alias("doc_id"), "score")


FILTER_CTE = f"""{BM25_CTE},
q0 AS (SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 20) END AS module,
  [['beginner', 'beginner-intermediate'], ['beginner-intermediate', 'intermediate'], ['intermediate', 'advanced'], ['intermediate', 'advanced'], NULL][(item_id % 5) + 1] AS diffs,
  CASE WHEN item_id % 2 = 0 THEN range(item_id + 1) ELSE [] END AS excl FROM benchmark),
p1 AS (SELECT q.*, d.idx, d.difficulty FROM q0 q JOIN doc d ON q.module IS NULL OR q.module = d.module),
p2 AS (SELECT *, bool_or(list_contains(diffs, difficulty)) OVER (PARTITION BY qid) AS any_fit FROM p1),
p3 AS (SELECT * FROM p2 WHERE diffs IS NULL OR NOT coalesce(any_fit, false) OR list_contains(diffs, difficulty)),
p4 AS (SELECT *, bool_or(NOT list_contains(excl, idx)) OVER (PARTITION BY qid) AS any_fresh FROM p3),
pool AS (SELECT qid, idx FROM p4 WHERE NOT any_fresh OR NOT list_contains(excl, idx)),
hit AS (SELECT p.qid, p.idx, s.score, row_number() OVER (PARTITION BY p.qid ORDER BY s.score DESC, p.idx) AS r FROM pool p JOIN scored s ON s.qid = p.qid AND s.idx = p.idx)"""


@query(f"WITH {FILTER_CTE} SELECT qid, r::INTEGER AS rank, idx, score FROM hit WHERE r <= 5 UNION ALL SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY idx)::INTEGER, idx, 0.0 FROM pool WHERE qid NOT IN (SELECT qid FROM hit)")
def bm25_filtered(spark, sf):
    return R.search(corpus(spark, sf), items(spark, sf))


@query(f"WITH {FILTER_CTE} SELECT qid, count(*) AS pool FROM pool GROUP BY qid")
def bm25_exclude(spark, sf):
    """Sizes of the candidate pools, from the counts that decide the filters."""
    c, f = corpus(spark, sf), R.effective_filters(corpus(spark, sf), items(spark, sf))
    n = c.groupBy("module", "difficulty").agg(F.count(F.lit(1)).alias("n"))
    ok = (F.col("f.module").isNull() | (F.col("f.module") == F.col("n.module"))) & (F.col("f.difficulties").isNull() | F.array_contains("f.difficulties", F.col("n.difficulty")))
    sizes = f.alias("f").join(F.broadcast(n).alias("n"), ok).groupBy("qid").agg(F.sum("n").alias("n"))
    gone = R.in_pool(f.where("exclude IS NOT NULL").select("qid", F.explode("exclude").alias("idx")).distinct(), c, f.withColumn("exclude", F.lit(None).cast("array<bigint>")))
    gone = gone.groupBy("qid").agg(F.count(F.lit(1)).alias("gone"))
    return sizes.join(gone, "qid", "left").select("qid", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("pool"))


@query("""SELECT item_id AS qid, row_number() OVER (PARTITION BY item_id ORDER BY doc_id)::INTEGER AS rank, doc_id AS idx, 0.0::DOUBLE AS score
FROM benchmark JOIN documents ON item_id % 3 <> 0 OR source = 'src' || (item_id % 20)""")
def bm25_fallback_pool(spark, sf):
    """Queries that match nothing get their whole pool, each item's own module, in order."""
    q = items(spark, sf).select("qid", F.lit("zzzzqq").alias("query"), "module", F.lit(None).cast("string").alias("level"), F.expr("cast(array() as array<bigint>)").alias("exclude"))
    return R.search(corpus(spark, sf), q)


VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
DENSE_CTE = f"""
v AS (SELECT vec_id AS idx, label, {VEC} AS vector FROM embeddings),
q AS (SELECT idx AS qid, label AS qlabel, vector AS qv FROM v WHERE idx % 25 = 0),
dense AS (SELECT qid, idx, label, qlabel, round(list_cosine_similarity(vector, qv), 6) AS score FROM v, q)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, sf):
    return vectors(spark, sf).where("idx % 25 = 0").select(F.col("idx").alias("qid"), "vector", F.col("label").alias("qlabel"))


@query(f"WITH {DENSE_CTE} SELECT qid, idx, score, r::INTEGER AS rank FROM (SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM dense) WHERE r <= 5")
def dense_topk(spark, sf):
    return R.top_k(R.dense_scores(vectors(spark, sf), vector_queries(spark, sf), k=5), 5)


@query(f"WITH {DENSE_CTE} SELECT qid, idx, score, r::INTEGER AS rank FROM (SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM dense WHERE label = qlabel AND idx <> qid) WHERE r <= 3")
def dense_by_label_filter(spark, sf):
    s = R.dense_scores(vectors(spark, sf), vector_queries(spark, sf)).join(vectors(spark, sf).select("idx", "label"), "idx")
    s = s.join(F.broadcast(vector_queries(spark, sf).select("qid", "qlabel")), "qid").where("label = qlabel AND idx <> qid")
    return R.top_k(s.select("qid", "idx", "score"), 3)


EMBED_CTE = f"""
slots AS (SELECT idx, ('0x' || right(md5(term), 2))::INTEGER % 64 AS slot FROM (SELECT idx, unnest(toks) AS term FROM doc)),
grid AS (SELECT idx, s.slot FROM doc, (SELECT unnest(range(64)) AS slot) s),
emb AS (SELECT g.idx, list(coalesce(c.n, 0)::DOUBLE ORDER BY g.slot) AS vector FROM grid g LEFT JOIN (SELECT idx, slot, count(*) AS n FROM slots GROUP BY ALL) c ON c.idx = g.idx AND c.slot = g.slot GROUP BY g.idx),
qslots AS (SELECT qid, ('0x' || right(md5(term), 2))::INTEGER % 64 AS slot FROM (SELECT item_id AS qid, unnest({TOK}) AS term FROM benchmark)),
qgrid AS (SELECT qid, s.slot FROM (SELECT DISTINCT qid FROM qterm), (SELECT unnest(range(64)) AS slot) s),
qemb AS (SELECT g.qid, list(coalesce(c.n, 0)::DOUBLE ORDER BY g.slot) AS qv FROM qgrid g LEFT JOIN (SELECT qid, slot, count(*) AS n FROM qslots GROUP BY ALL) c ON c.qid = g.qid AND c.slot = g.slot GROUP BY g.qid),
hdense AS (SELECT qid, idx, round(list_dot_product(vector, qv) / (greatest(sqrt(list_dot_product(vector, vector)), 1e-12) * greatest(sqrt(list_dot_product(qv, qv)), 1e-12)), 6) AS score FROM emb, qemb),
br AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM scored WHERE score > 0),
dr AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM hdense),
fused AS (SELECT qid, idx, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM br UNION ALL SELECT * FROM dr) GROUP BY ALL)"""


def scorers(spark, sf):
    """The items' words and their vectors against all documents."""
    c, q = corpus(spark, sf), items(spark, sf)
    query_vectors = R.hash_embed(q.select(F.col("qid").alias("idx"), F.col("query").alias("text"))).withColumnRenamed("idx", "qid")
    return R.bm25_scorer(c, q), R.dense_scorer(R.hash_embed(c), query_vectors)


@query(f"WITH {BM25_CTE}, {EMBED_CTE} SELECT idx, round(sqrt(list_dot_product(vector, vector)), 6) AS norm, list_position(vector, list_max(vector))::INTEGER AS top_slot FROM emb")
def hash_embed_docs(spark, sf):
    c = corpus(spark, sf)
    counts = c.select("idx", F.size(text.tokens(F.col("text"))).alias("n"), text.tokens(F.col("text")).alias("toks"))
    e = R.hash_embed(c)
    raw = counts.select("idx", F.explode_outer("toks").alias("t")).groupBy("idx", R.numeric.hash_slot(F.col("t")).alias("slot")).agg(F.count("t").alias("n"))
    norm = raw.groupBy("idx").agg(F.round(F.sqrt(F.sum(F.col("n") * F.col("n"))), 6).alias("norm"))
    return e.join(norm, "idx").select("idx", "norm", F.array_position("vector", F.array_max("vector")).cast("int").alias("top_slot"))


@query(f"WITH {BM25_CTE}, {EMBED_CTE} SELECT qid, idx, score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM fused) WHERE r <= 5")
def hybrid_topk(spark, sf):
    return R.fused_top(*scorers(spark, sf))


@query(f"""WITH {DENSE_CTE}, a AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM dense),
b AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY idx) AS r FROM dense WHERE label = qlabel)
SELECT qid, idx, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a WHERE r <= 20 UNION ALL SELECT * FROM b WHERE r <= 20) GROUP BY ALL""")
def rrf_fusion(spark, sf):
    dense = R.dense_scores(vectors(spark, sf), vector_queries(spark, sf))
    a = R.ranked(dense).where("rank <= 20")
    same = vectors(spark, sf).join(F.broadcast(vector_queries(spark, sf).select("qid", "qlabel")), F.col("label") == F.col("qlabel"))
    b = R.ranked(same.select("qid", "idx", F.lit(0.0).alias("score"))).where("rank <= 20")
    return R.rrf_fuse(a.unionByName(b))


@query(f"""WITH {BM25_CTE}, {EMBED_CTE}, x AS (SELECT qid, list(idx ORDER BY r) AS l FROM br WHERE r <= 5 GROUP BY qid), y AS (SELECT qid, list(idx ORDER BY r) AS m FROM dr WHERE r <= 5 GROUP BY qid)
SELECT count(*) AS queries, count(*) FILTER (l = m) AS identical, round(avg(len(list_intersect(l, m)) / greatest(len(list_distinct(list_concat(l, m))), 1)), 6) AS mean_jaccard FROM x JOIN y USING (qid)""")
def store_agreement(spark, sf):
    b, d = scorers(spark, sf)
    return R.agreement(b.best(5), d.best(5))


@query(f"""WITH {BM25_CTE}, tops AS (SELECT s.qid, s.idx, s.score, d.lang AS bank, row_number() OVER (PARTITION BY s.qid, d.lang ORDER BY s.score DESC, s.idx) AS r FROM scored s JOIN doc d USING (idx))
SELECT qid, bank, idx, score FROM tops WHERE r <= 3 AND idx % 4 <> 0 AND score >= 10 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, bank, r) = 1""")
def best_eligible_per_query(spark, sf):
    from pyspark.sql import Window

    s = R.bm25_scores(corpus(spark, sf), items(spark, sf)).join(corpus(spark, sf).select("idx", F.col("lang").alias("bank")), "idx")
    tops = s.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "bank").orderBy(F.desc("score"), "idx")))
    return R.best_eligible(tops, F.col("idx") % 4 != 0)


@query(f"""WITH {BM25_CTE}, {EMBED_CTE}, lists AS (SELECT qid, idx, 0 AS arm, r FROM br WHERE r <= 3 UNION ALL SELECT qid, idx, 1, r FROM dr WHERE r <= 3),
seen AS (SELECT qid, idx, min(struct_pack(arm := arm, r := r)) AS a FROM lists GROUP BY ALL), prop AS (SELECT qid, idx FROM br WHERE r = 1)
SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY a, idx)::INTEGER AS place FROM seen s WHERE NOT EXISTS (FROM prop p WHERE p.qid = s.qid AND p.idx = s.idx) QUALIFY place <= 6""")
def skim_pool(spark, sf):
    b, d = (settle(x.best(3), "tops") for x in scorers(spark, sf))
    lists = b.select("qid", "idx", "rank", F.lit(0).alias("arm")).unionByName(d.select("qid", "idx", "rank", F.lit(1).alias("arm")))
    return R.skim(lists, b.where("rank = 1"))


@query(f"""WITH {BM25_CTE}, {EMBED_CTE}, b AS (SELECT qid, idx, score FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) = 1),
d AS (SELECT qid, idx, score FROM hdense QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) = 1),
h AS (SELECT qid, idx, score FROM fused QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) = 1)
SELECT qid, CASE WHEN b.score >= 10 THEN b.idx END AS threshold, CASE WHEN b.idx = d.idx THEN b.idx END AS agree, CASE WHEN d.score >= 0.35 THEN d.idx END AS dense_floor,
CASE WHEN h.score >= 0.0284 THEN h.idx END AS hybrid FROM b FULL JOIN d USING (qid) FULL JOIN h USING (qid)""")
def policy_decisions(spark, sf):
    b, d = scorers(spark, sf)
    return R.policies(b.best(1), d.best(1), R.fused_top(b, d, 1), R.MIN_SCORE, 0.35, 0.0284)


@query(f"""WITH {BM25_CTE}, rel AS (SELECT item_id AS qid, doc_id AS idx FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
best AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM scored),
f AS (SELECT q.qid, min(b.r) AS first FROM (SELECT DISTINCT qid FROM rel) q LEFT JOIN (SELECT b.* FROM best b JOIN rel USING (qid, idx) WHERE r <= 5) b USING (qid) GROUP BY q.qid)
SELECT count(*) AS queries, round(avg(CASE WHEN first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_k, round(avg(CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_1, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr FROM f""")
def retrieval_recall_mrr(spark, sf):
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    relevant = table(spark, sf, "documents").join(R.small_side(bench), F.col("text").contains(F.col("passage"))).select("qid", F.col("doc_id").alias("idx"))
    return R.evaluate(R.top_k(R.bm25_scores(corpus(spark, sf), items(spark, sf)), 5), relevant)


@query(f"WITH {BM25_CTE} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, sf):
    return R.idf_table(*R.bm25_index(corpus(spark, sf))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25_CTE} SELECT idx, len(toks)::INTEGER AS dl, round(len(toks) / (SELECT avgdl FROM stats), 6) AS relative FROM doc")
def doc_lengths(spark, sf):
    c = corpus(spark, sf).select("idx", F.size(text.tokens(F.col("text"))).alias("dl"))
    return c.crossJoin(F.broadcast(c.agg(F.avg("dl").alias("avgdl")))).select("idx", "dl", F.round(F.col("dl") / F.col("avgdl"), 6).alias("relative"))


@query(f"WITH {BM25_CTE} SELECT round(list(idf ORDER BY idf)[(count(*) // 2) + 1], 6) AS median_idf FROM idf")
def median_idf(spark, sf):
    return R.median_idf(R.idf_table(*R.bm25_index(corpus(spark, sf)))).select(F.round("median_idf", 6).alias("median_idf"))


@query(f"""WITH {BM25_CTE}, top AS (SELECT s.qid, s.score, coalesce(contains(d.text, b.text), false) AS rel FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) = 1) s
  JOIN documents d ON d.doc_id = s.idx JOIN benchmark b ON b.item_id = s.qid)
SELECT t.score AS threshold, count(*) AS attached, round(avg(CASE WHEN u.rel THEN 1.0::DOUBLE ELSE 0 END), 6) AS precision, round(count(*) / (SELECT count(*) FROM top)::DOUBLE, 6) AS attach_rate
FROM (SELECT DISTINCT score FROM top) t JOIN top u ON u.score >= t.score GROUP BY t.score""")
def threshold_sweep(spark, sf):
    from ..operators.evaluation import threshold_sweep as sweep

    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    top = R.top_k(R.bm25_scores(corpus(spark, sf), items(spark, sf)), 1).join(bench, "qid").join(table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text"), "idx")
    return sweep(top.select("score", F.col("text").contains(F.col("passage")).alias("relevant")))
