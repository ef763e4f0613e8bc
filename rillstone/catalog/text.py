"""Text, parsing, classification and duplicate queries over documents, benchmark, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric, text, udfs
from ..operators import dedupe, sampling, transcripts
from ..plans.scratch import settle
from ..plans.session import table
from .retrieval import TOK

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duck(pattern: str) -> str:
    return q(pattern)


def ladder(col: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {duck(p)}) THEN {q(n)}" for n, p in rules) + f" ELSE {default} END"


LINES = "(SELECT doc_id, unnest(string_split(text, '\n')) AS line, generate_subscripts(string_split(text, '\n'), 1) AS n FROM documents)"
VAGUE_RULE = f"NOT (contains(line, '?') OR contains(line, '？') OR regexp_matches(lower(line), {q(text.IMPERATIVE)})) AND len({TOK.replace('text', 'line')}) + len(regexp_extract_all(line, {q(text.CJK)})) // 2 < 5"


def lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


@query(f"""SELECT doc_id, n::INTEGER AS n, {ladder("lower(line)", (("followup", text.FOLLOWUP), *text.CATEGORIES), "'behavioral'")} AS category,
{ladder("lower(line)", text.INTENTS, "NULL")} AS intent, {ladder("lower(line)", [(m, p) for p, m in text.KEYWORD_MODULES], q(text.DEFAULT_MODULE))} AS module FROM {LINES}""")
def classify_ladder(spark, sf):
    low = F.col("low")
    rows = lines(spark, sf).select("doc_id", "n", F.lower("line").alias("low"))
    return rows.select("doc_id", "n", text.classify(low, True).alias("category"), text.intent_of(low, True).alias("intent"), text.module_for(low, True).alias("module"))


@query(f"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, {q(text.CJK)})) = 0 THEN 'en' WHEN len(regexp_extract_all(text, {q(text.CJK)})) > length(text) / 3 THEN 'zh' ELSE 'mixed' END AS language FROM documents")
def language_of(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.language_of(F.col("text")).alias("language"))


@query(f"SELECT doc_id, count(*) FILTER ({VAGUE_RULE}) AS vague, count(*) AS lines FROM {LINES} GROUP BY doc_id")
def too_vague(spark, sf):
    return lines(spark, sf).groupBy("doc_id").agg(F.count_if(text.too_vague(F.col("line"))).alias("vague"), F.count(F.lit(1)).alias("lines"))


STEM = "CASE WHEN t LIKE '%ing' AND length(t) >= 6 THEN left(t, length(t) - 3) WHEN t LIKE '%ed' AND length(t) >= 5 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) >= 4 THEN left(t, length(t) - 1) ELSE t END"


@query(f"SELECT {STEM} AS stem, count(*) AS n, count(DISTINCT t) AS forms FROM (SELECT unnest({TOK}) AS t FROM documents) GROUP BY 1")
def stem_tokens(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("t"))
    return t.groupBy(text.stem(F.col("t")).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("forms"))


@query(f"""SELECT doc_id, 'doc_' || lpad(doc_id::VARCHAR, 3, '0') || '_' || coalesce(nullif(array_to_string(({TOK})[1:4], '_'), ''), 'question') AS record_id,
array_to_string({TOK}, '-')[1:40] AS slug FROM documents WHERE doc_id < 1000""".replace(" WHERE doc_id < 1000", ""))
def slug_ids(spark, sf):
    t = F.col("text")
    number = F.when(F.length(F.col("doc_id").cast("string")) >= 3, F.substring(F.col("doc_id").cast("string"), 1, 3)).otherwise(F.lpad(F.col("doc_id").cast("string"), 3, "0"))
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("_", F.lit("doc"), number, text.slug(t)).alias("record_id"), F.substring(text.slugify(t), 1, 40).alias("slug"))


@query("SELECT doc_id, sha256(concat_ws(' ', source, lang, text)) AS digest, length(concat_ws(' ', source, lang, text)) AS n FROM documents")
def retrieval_text(spark, sf):
    from ..operators.retrieval import retrieval_text as joined

    t = joined(F.col("source"), F.col("lang"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), F.length(t).cast("long").alias("n"))


@query()
def html_blocks(spark, sf):
    return table(spark, sf, "pages").select("page_id", udfs.html_to_text(F.col("html")).alias("text"))


@query()
def page_sections(spark, sf):
    """Headings carried forward over the lines of a page, paragraphs counted per section."""
    l = html_blocks(spark, sf).select("page_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").startswith("#"), F.regexp_replace("line", "^#+ ", ""))
    return l.withColumn("section", F.last(head, ignorenulls=True).over(w)).groupBy("page_id", "section").agg(F.count_if(~F.col("line").startswith("#")).alias("paragraphs"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def page_titles(spark, sf):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), n("<a ").alias("links"), n("<p>").alias("paragraphs"))


@query("SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '<[A-Za-z/][^>]*>', '', 'g'), '\\n{3,}', '\n\n', 'g'), ' ')) AS digest FROM documents")
def md_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.markdown_to_text(F.col("text")), 256).alias("digest"))


@query("SELECT sha256(text) AS fingerprint, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return dedupe.exact_duplicates(table(spark, sf, "documents"), "doc_id", "text")


STOP = "[" + ", ".join(q(w) for w in text.STOP_WORDS) + "]"
SETS = f"""s AS (SELECT doc_id AS idx, list_distinct(list_filter({TOK}, lambda t: NOT list_contains({STOP}, t))) AS toks FROM documents),
sz AS (SELECT idx, len(toks) AS n FROM s WHERE len(toks) > 0), e AS (SELECT idx, unnest(toks) AS t FROM s)"""


@query(f"""WITH {SETS} SELECT i, j, round(c / least(ni, nj)::DOUBLE, 6) AS score FROM (SELECT a.idx AS i, b.idx AS j, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.idx < b.idx GROUP BY ALL)
JOIN (SELECT idx AS i, n AS ni FROM sz) USING (i) JOIN (SELECT idx AS j, n AS nj FROM sz) USING (j) WHERE c / least(ni, nj)::DOUBLE >= 0.8 - 1e-12""")
def containment_pairs(spark, sf):
    sets = dedupe.token_sets(table(spark, sf, "documents"), "doc_id", "text")
    return dedupe.containment_pairs(sets, 0.8).select("i", "j", F.round("score", 6).alias("score"))


@query(f"""WITH {SETS}, b AS (SELECT item_id AS idx, list_distinct(list_filter({TOK}, lambda t: NOT list_contains({STOP}, t))) AS toks FROM benchmark), be AS (SELECT idx, len(toks) AS n, unnest(toks) AS t FROM b),
o AS (SELECT be.idx AS a, e.idx AS b, be.n AS na, count(*) AS c, (SELECT n FROM sz WHERE sz.idx = e.idx) AS nb FROM be JOIN e ON be.t = e.t GROUP BY be.idx, e.idx, be.n),
best AS (SELECT a, arg_max(b, struct_pack(s := c / na::DOUBLE, m := -b)) AS dup, max(c / na::DOUBLE) AS s, any_value(na) AS na, arg_max(b, struct_pack(s := c / least(na, nb)::DOUBLE, m := -b)) AS ref, max(c / least(na, nb)::DOUBLE) AS r FROM o GROUP BY a)
SELECT b.idx, CASE WHEN s >= 0.8 AND na >= 3 THEN dup END AS bank_dup, CASE WHEN NOT coalesce(s >= 0.8 AND na >= 3, false) AND r >= 0.6 THEN ref END AS bank_ref FROM b LEFT JOIN best ON best.a = b.idx WHERE len(b.toks) > 0""")
def bank_overlap(spark, sf):
    c = dedupe.token_sets(table(spark, sf, "benchmark"), "item_id", "text")
    return dedupe.bank_overlap(c, dedupe.token_sets(table(spark, sf, "documents"), "doc_id", "text"))


SHINGLES = f"""dt AS (SELECT doc_id AS id, {TOK} AS t FROM documents), bt AS (SELECT item_id AS id, {TOK} AS t FROM benchmark),
ds AS (SELECT DISTINCT id, array_to_string(t[i:i + 7], ' ') AS sh FROM (SELECT id, t, unnest(range(1, len(t) - 6)) AS i FROM dt WHERE len(t) >= 8)),
bs AS (SELECT DISTINCT id, array_to_string(t[i:i + 7], ' ') AS sh FROM (SELECT id, t, unnest(range(1, len(t) - 6)) AS i FROM bt WHERE len(t) >= 8)),
sh AS (SELECT bs.id AS item_id, ds.id AS doc_id, count(*) AS shared FROM bs JOIN ds USING (sh) GROUP BY ALL)"""


@query(f"WITH {SHINGLES} SELECT * FROM sh")
def shingle_contamination(spark, sf):
    b = dedupe.shingles(table(spark, sf, "benchmark"), "item_id", "text")
    d = dedupe.shingles(table(spark, sf, "documents"), "doc_id", "text")
    return dedupe.shared_shingles(b, d).select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), "shared")


@query(f"""WITH {SHINGLES} SELECT item_id, doc_id, round(len(list_filter(bt.t, lambda x: list_contains(dt.t, x))) / len(bt.t)::DOUBLE, 6) AS share,
len(list_filter(bt.t, lambda x: list_contains(dt.t, x))) / len(bt.t)::DOUBLE >= 0.85 AS grounded FROM sh JOIN bt ON bt.id = item_id JOIN dt ON dt.id = doc_id""")
def excerpt_grounded(spark, sf):
    pairs = shingle_contamination(spark, sf).select("item_id", "doc_id")
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("excerpt"))
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    share = dedupe.excerpt_share(F.col("excerpt"), F.col("content"))
    return pairs.join(b, "item_id").join(d, "doc_id").select("item_id", "doc_id", F.round(share, 6).alias("share"), (share >= 0.85).alias("grounded"))


@query(f"""WITH {SETS}, c AS (SELECT item_id AS idx, list_distinct(list_filter({TOK}, lambda t: NOT list_contains({STOP}, t))) AS toks FROM benchmark)
SELECT c.idx, min(d.b) AS dup FROM c LEFT JOIN (SELECT x.idx AS a, e.idx AS b FROM (SELECT idx, len(toks) AS n, unnest(toks) AS t FROM c WHERE len(toks) >= 3) x JOIN e ON e.t = x.t GROUP BY x.idx, x.n, e.idx HAVING count(*) / x.n::DOUBLE >= 0.8) d ON d.a = c.idx WHERE len(c.toks) > 0 GROUP BY c.idx""")
def lexical_dup(spark, sf):
    c = dedupe.token_sets(table(spark, sf, "benchmark"), "item_id", "text")
    return dedupe.lexical_dup(c, dedupe.token_sets(table(spark, sf, "documents"), "doc_id", "text"))


@query()
def greedy_merge(spark, sf):
    docs = table(spark, sf, "documents")
    pairs = dedupe.containment_pairs(dedupe.token_sets(docs, "doc_id", "text"), 0.65)
    return dedupe.greedy_merge(docs.select(F.col("doc_id").alias("idx")), pairs)


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) >= 0.35")
def cosine_pairs(spark, sf):
    return dedupe.cosine_pairs(table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector")), 0.35)


@query()
def cosine_dedupe(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    return dedupe.greedy_merge(v, settle(dedupe.cosine_pairs(v, 0.35), "pairs"))


@query(f"""WITH c AS (SELECT item_id AS idx, {ladder("lower(text)", (("followup", text.FOLLOWUP), *text.CATEGORIES), "'behavioral'")} AS category, {ladder("lower(text)", text.INTENTS, "NULL")} AS intent FROM benchmark)
SELECT idx, category, intent, CASE WHEN category IN ('behavioral', 'experience') AND intent IS NOT NULL THEN min(idx) OVER (PARTITION BY CASE WHEN category IN ('behavioral', 'experience') THEN intent END) ELSE idx END AS canon FROM c""")
def intent_merge(spark, sf):
    c = table(spark, sf, "benchmark").select(F.col("item_id").alias("idx"), text.classify(F.col("text")).alias("category"), text.intent_of(F.col("text")).alias("intent"))
    return dedupe.merge_by_intent(c)


@query(f"SELECT t AS term, count(*) AS n, count(DISTINCT doc_id) AS docs, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 'number' WHEN regexp_matches(t, '[0-9]') THEN 'mixed' WHEN length(t) <= 3 THEN 'short' ELSE 'word' END AS category FROM (SELECT doc_id, unnest({TOK}) AS t FROM documents) GROUP BY t")
def term_histogram(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    kind = F.when(F.col("term").rlike("^[0-9]+$"), "number").when(F.col("term").rlike("[0-9]"), "mixed").when(F.length("term") <= 3, "short").otherwise("word")
    per_doc = t.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs")).withColumn("category", kind)


WORDS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+')"
PADDED = f"(' ' || lower(array_to_string({WORDS}, ' ')) || ' ')"
FILLER_SUM = " + ".join(f"(length({PADDED}) - length(replace({PADDED}, ' {f} ', ''))) // {len(f) + 2}" for f in text.FILLERS)


@query(f"SELECT conv_id, turn, len({WORDS})::INTEGER AS words, ({FILLER_SUM})::BIGINT AS fillers FROM conversations")
def filler_counts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(text.word_run(F.col("text"))).alias("words"), text.filler_count(F.col("text")).alias("fillers"))


@query(f"""WITH a AS (SELECT conv_id, len({WORDS}) AS w, ({FILLER_SUM})::BIGINT AS f, CASE WHEN turn % 3 <> 0 THEN (1000 + 137 * turn)::DOUBLE / 1000 END AS s FROM conversations WHERE role = 'user' AND trim(text) <> '')
SELECT conv_id, count(*) AS answers, sum(w)::BIGINT AS total_words, round(avg(w), 1) AS avg_words, max(w)::INTEGER AS longest_words, min(w)::INTEGER AS shortest_words, round(stddev_pop(w) / nullif(avg(w), 0), 2) AS length_balance_cv,
sum(f)::BIGINT AS filler_total, round(100 * sum(f) / greatest(sum(w), 1), 1) AS filler_per_100_words, round(avg(s), 1) AS avg_answer_seconds, round(max(s), 1) AS longest_answer_seconds, round(min(s), 1) AS shortest_answer_seconds,
round(sum(w) FILTER (s IS NOT NULL) / (sum(s) / 60), 0) AS words_per_minute, round(sum(f) FILTER (s IS NOT NULL) / (sum(s) / 60), 1) AS fillers_per_minute FROM a GROUP BY conv_id""")
def conv_metrics(spark, sf):
    ms = F.when(F.col("turn") % 3 != 0, 1000 + 137 * F.col("turn"))
    turns = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.col("text").alias("answer"), ms.alias("answer_ms"))
    return transcripts.communication(turns, "conv_id")


@query("""SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role, length(text) AS n, lead(length(text)) OVER w AS next_n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def turn_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("long")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("turn").over(w).alias("next_turn"), F.lead("role").over(w).alias("next_role"), n.alias("n"), F.lead(n).over(w).alias("next_n"))


PHASES = (("warmup", 1), ("walkthrough", 2), ("deepdive", 8), ("behavioral", 10), ("closing", 11))


@query("""SELECT conv_id, count(*) AS asked, CASE WHEN count(*) < 1 THEN 'warmup' WHEN count(*) < 2 THEN 'walkthrough' WHEN count(*) < 8 THEN 'deepdive' WHEN count(*) < 10 THEN 'behavioral' WHEN count(*) < 11 THEN 'closing' ELSE 'done' END AS phase
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def phase_position(spark, sf):
    """The phase of the next turn: the first whose cumulative quota exceeds the turns asked."""
    quota = spark.createDataFrame([("warmup", 1, 0), ("walkthrough", 1, 1), ("deepdive", 6, 2), ("behavioral", 2, 3), ("closing", 1, 4)], "phase string, quota int, ord int")
    upto = quota.withColumn("upto", F.sum("quota").over(Window.orderBy("ord")))
    asked = table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("asked"))
    j = asked.join(F.broadcast(upto), F.col("asked") < F.col("upto"), "left").groupBy("conv_id", "asked").agg(F.min_by("phase", "ord").alias("phase"))
    return j.select("conv_id", "asked", F.coalesce("phase", F.lit("done")).alias("phase"))


@query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations WHERE role IN ('assistant', 'user'))
SELECT conv_id, grp::BIGINT AS grp, min(turn) AS first_turn, count(*) FILTER (role = 'user') AS parts, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn), '') AS answer FROM g GROUP BY conv_id, grp""")
def late_merge(spark, sf):
    """Speech without a pending question is appended to the answer before."""
    c = table(spark, sf, "conversations").where("role IN ('assistant', 'user')")
    g = c.withColumn("grp", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn")))
    said = F.filter(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: s["role"] == "user")
    return g.groupBy("conv_id", "grp").agg(F.min("turn").alias("first_turn"), F.count_if(F.col("role") == "user").alias("parts"), F.array_join(F.transform(said, lambda s: s["text"]), " ").alias("answer"))


@query("SELECT conv_id, string_agg(role || ': ' || text, '\n' ORDER BY turn) AS transcript FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) GROUP BY conv_id")
def conversation_tail(spark, sf):
    """The last ten messages of a conversation as text."""
    line = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))
    rows = F.array_sort(F.collect_list(line))
    tail = F.slice(rows, F.greatest(F.size(rows) - 9, F.lit(1)), 10)
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(tail, lambda s: s["line"]), "\n").alias("transcript"))


@query()
def wer_pairs(spark, sf):
    """Word error rate of each benchmark item against the document that shares most shingles with it."""
    best = shingle_contamination(spark, sf).groupBy("item_id").agg(F.min_by("doc_id", F.struct(-F.col("shared"), "doc_id")).alias("doc_id"))
    j = best.join(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("b")), "item_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    ref, hyp = text.spoken_tokens(F.col("b")), text.spoken_tokens(F.col("text"))
    return j.select("item_id", "doc_id", ref.alias("ref"), hyp.alias("hyp")).select("item_id", "doc_id", transcripts.word_distance(F.col("ref"), F.col("hyp")).alias("edits"), F.round(transcripts.wer(F.col("ref"), F.col("hyp")), 6).alias("wer"))


def _term_items(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), text.spoken_tokens(F.col("text")).alias("ref"), F.filter(text.spoken_tokens(F.col("text")), lambda w, i: i % 7 != 3).alias("hyp"))


def _lexicon(spark):
    return transcripts.lexicon(spark.createDataFrame([(0, "that", ["tha"]), (1, "of the", ["ofthe"]), (2, "tion", []), (3, "with", ["wit h"])], "pos int, term string, aliases array<string>"))


@query()
def term_errors(spark, sf):
    return transcripts.term_errors(_term_items(spark, sf), _lexicon(spark))


@query()
def keyterm_select(spark, sf):
    summary = transcripts.term_summary(term_errors(spark, sf)).select("term", "rate", F.col("count").alias("observed"))
    lex = _lexicon(spark).withColumn("short", F.lit(None).cast("string")).withColumn("common", F.col("term") == "that")
    return transcripts.keyterms(lex, summary, ["tion"], 3)


@query()
def sentence_stream(spark, sf):
    """Spoken sentences per turn with the unfinished rest, by the abbreviation-aware splitter."""
    s = udfs.split_spoken(F.col("text"), F.lit(False))
    return table(spark, sf, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", F.size("s.sentences").alias("sentences"), F.length("s.rest").alias("rest"))


@query("""SELECT doc_id, lang, turn::INTEGER AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents) WHERE turn <= 50 ORDER BY turn, lang LIMIT 50""")
def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


@query("""WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS r FROM (SELECT DISTINCT source FROM documents))
SELECT d.doc_id, d.source, g.r <= ceil((SELECT count(*) FROM g) * 0.2) AS held_out FROM documents d JOIN g USING (source)""")
def group_split(spark, sf):
    return sampling.group_split(table(spark, sf, "documents").select("doc_id", "source"), "source", 0.2).select("doc_id", "source", "held_out")


@query("""SELECT p_partkey, p_brand, place::INTEGER AS place FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN regexp_matches(p_type, 'STEEL|BRASS') THEN 0 ELSE 1 END, p_partkey) AS place FROM part) WHERE place <= 5""")
def cap_per_group(spark, sf):
    p = table(spark, sf, "part")
    return sampling.cap_per_group(p, "p_brand", [F.col("p_partkey")], 5, F.col("p_type").rlike("STEEL|BRASS")).select("p_partkey", "p_brand", "place")


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) = 1")
def random_pick(spark, sf):
    return sampling.random_pick(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id")


@query("""SELECT doc_id, sha256(CASE WHEN len(w) > 120 THEN array_to_string(w[1:120], ' ') || ' ...' ELSE array_to_string(w, ' ') END) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def clip_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.clip_words(F.col("text"), 120), 256).alias("digest"))


TAIL = "[" + ", ".join(q(w) for w in text.UNFINISHED_TAIL) + "]"


@query(f"""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN false WHEN right(trim(text), 1) IN (',', ';', ':', '-') THEN true WHEN right(trim(text), 1) IN ('.', '?', '!') THEN false
ELSE list_contains({TAIL}, regexp_replace(lower(regexp_split_to_array(trim(text), '\\s+')[-1]), '[^a-z'']', '', 'g')) END AS unfinished FROM conversations""")
def unfinished_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.looks_unfinished(F.col("text")).alias("unfinished"))
