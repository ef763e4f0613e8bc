"""Chunk records: assembly, projections, eligibility, review decisions, resolution, quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

PRIVATE = ("frequency", "companies", "industries", "original", "bank_ref", "semantic_ref", "review")
RUBRIC_ROUNDS = ("technical", "system_design", "ml_coding")


def strip(chunks: DataFrame) -> DataFrame:
    """The public edition: without the content and the private fields of the metadata."""
    return chunks.drop("content").withColumn("metadata", F.col("metadata").dropFields(*PRIVATE))


def build(candidates: DataFrame, licensed: tuple[str, ...] = ("MIT", "Apache-2.0", "CC-BY-4.0")) -> DataFrame:
    """Chunk records from (idx, text, answer, key_points, companies, role_family, tier, license, source):
    sorted distinct sets, a default role, and stored text only under a license that allows it."""
    ordered = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array()), lambda x: x.isNotNull() & (x != ""))))
    roles = F.when(F.size(ordered(F.col("role_family"))) > 0, ordered(F.col("role_family"))).otherwise(F.array(F.lit("MLE")))
    meta = F.struct(
        text.module_for(F.col("text")).alias("module"), F.coalesce("tier", F.lit("intermediate")).alias("difficulty"), ordered(F.col("companies")).alias("companies"),
        roles.alias("role_family"), text.language_of(F.col("text")).alias("language"), F.col("source").alias("source"), F.col("license").alias("license"),
        F.col("answer").isNotNull().alias("has_source_answer"),
    )
    kept = F.when(F.col("license").isin(*licensed), F.col("answer"))
    return candidates.select(
        text.record_id("list", F.col("idx"), F.col("text")).alias("id"),
        F.struct(F.col("text").alias("question"), kept.alias("model_answer"), F.col("key_points").alias("key_points")).alias("interview"), meta.alias("metadata"),
    )


def payload(chunks: DataFrame) -> DataFrame:
    """What a question page shows of a chunk."""
    return chunks.select("id", "interview.question", "metadata.module", "metadata.difficulty", F.size(F.coalesce("interview.key_points", F.array())).alias("points"))


def rubric_eligible(round_: Column) -> Column:
    return round_.isNull() | round_.isin(*RUBRIC_ROUNDS)


def is_relevant(ids: Column, module: Column, tags: Column, chunk_id: Column, chunk_module: Column, chunk_tags: Column) -> Column:
    """Expected ids decide alone; else the expected module must match and expected tags overlap; nothing
    expected means not relevant."""
    asked = module.isNotNull() | tags.isNotNull()
    by_meta = (module.isNull() | (module == chunk_module)) & (tags.isNull() | F.arrays_overlap(tags, chunk_tags))
    return F.coalesce(F.when(ids.isNotNull(), F.array_contains(ids, chunk_id)).otherwise(asked & by_meta), F.lit(False))


def parents(bank: DataFrame, done: DataFrame, seed: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks to expand: with content, no children, matching the seed, not expanded before, in order."""
    out = bank.where("content IS NOT NULL AND content <> '' AND metadata.expanded_from IS NULL")
    if seed:
        out = out.where(F.col("metadata.topic").rlike(f"(?i){seed}"))
    out = out.join(done.select(F.col("parent").alias("id")), "id", "left_anti").orderBy("id")
    return out.limit(limit) if limit else out


def mentioned(notes: DataFrame, rows: DataFrame, pattern: str = r"\b([a-z]+_[0-9]{3})\b") -> DataFrame:
    """(note_id, ids): rows whose id begins with one that a note mentions, the note itself left out."""
    said = notes.select("note_id", F.explode(F.array_distinct(F.regexp_extract_all("note", F.lit(pattern), F.lit(1)))).alias("prefix"))
    prefix = rows.select("id", F.regexp_extract("id", f"^{pattern.strip(chr(92) + 'b')}", 1).alias("prefix"))
    return said.join(prefix, "prefix").where("id <> note_id").groupBy("note_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def resolve(queries: DataFrame, problems: DataFrame) -> DataFrame:
    """(qid, problem_id, synthetic): by slug, then by number, then by slugified title; else a synthetic row."""
    q = queries.select("qid", "query", text.slugify(F.col("query")).alias("slug"), F.col("query").try_cast("int").alias("number"))
    p = problems.select("problem_id", F.col("slug").alias("pslug"), F.col("number").alias("pnumber"), text.slugify(F.col("title")).alias("ptitle"))
    first = lambda key, name: p.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{name}")).agg(F.min("problem_id").alias(name))
    j = q.join(first("pslug", "a"), F.col("slug") == F.col("_a"), "left").join(first("pnumber", "b"), F.col("number") == F.col("_b"), "left").join(first("ptitle", "c"), F.col("slug") == F.col("_c"), "left")
    found = F.coalesce("a", "b", "c")
    return j.select("qid", found.alias("problem_id"), found.isNull().alias("synthetic"), text.title_from_slug(F.col("slug")).alias("title"))


def sections(docs: DataFrame, begin: str, end: str, drop: str | None = None) -> DataFrame:
    """(id, text): lines from the first heading like ``begin`` up to the next like ``end``, without the
    sections whose heading is like ``drop``; blank lines collapsed."""
    l = docs.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ ", ""))
    state = F.when(heading.rlike(begin), F.lit("in")).when(heading.rlike(end), F.lit("out"))
    marked = l.withColumn("state", F.last(state, True).over(w)).withColumn("head", F.last(heading, True).over(w))
    kept = marked.where("state = 'in'").where(~F.coalesce(F.col("head").rlike(drop), F.lit(False)) if drop else F.lit(True))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("id").agg(F.trim(F.regexp_replace(joined, r"\n{3,}", "\n\n")).alias("text"))


def issues(shared_shingles: Column) -> Column:
    """Names of the rules that a coding record breaks: columns question, answer, key_points, hints, complexity."""
    rule = lambda name, broken: F.when(F.coalesce(broken, F.lit(True)), F.lit(name))
    return F.filter(
        F.array(
            rule("no question", F.length(F.trim("question")) < 10), rule("no answer", F.length(F.trim("answer")) < 20), rule("few key points", F.size("key_points") < 3),
            rule("no hints", F.size("hints") < 1), rule("no complexity", ~F.col("complexity").rlike(r"O\(")), rule("copied text", shared_shingles > 0),
        ),
        lambda x: x.isNotNull(),
    )


def decide(rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the decision's status and note, undecided ones retired; ids that no row has)."""
    d = decisions.select(F.col("id").alias("_id"), "status", "note")
    out = rows.join(d, F.col("id") == F.col("_id"), "left").withColumn("status", F.coalesce("status", F.lit("retire"))).drop("_id")
    return out, decisions.join(rows.select("id"), "id", "left_anti").select("id")


def semantic_verdicts(bank: DataFrame, parent: DataFrame, earlier: DataFrame, at: float = 0.90, parent_at: float = 0.85, note_at: float = 0.80) -> DataFrame:
    """(idx, verdict, of): stages in order - like a bank row (drop or note), like the parent, like an earlier
    row.  Each input has (idx, of, score), one row per similar pair."""
    best = lambda d, name: d.groupBy("idx").agg(F.max(F.struct("score", (-F.col("of")).alias("m"))).alias(name))
    j = best(bank, "b").join(best(parent, "p"), "idx", "full").join(best(earlier, "e"), "idx", "full")
    return j.select(
        "idx",
        F.when(F.col("b.score") >= at, "bank_dup").when(F.col("p.score") >= parent_at, "parent_dup").when(F.col("e.score") >= at, "pool_dup").when(F.col("b.score") >= note_at, "noted").otherwise("keep").alias("verdict"),
        F.when(F.col("b.score") >= at, -F.col("b.m")).when(F.col("p.score") >= parent_at, -F.col("p.m")).when(F.col("e.score") >= at, -F.col("e.m")).when(F.col("b.score") >= note_at, -F.col("b.m")).alias("of"),
    )


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys: the same text for the same content."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def parse_answers(body: Column, n: int) -> Column:
    """(score, verdicts) of a typed reply: 1 plus the score; missing probabilities are 0, missing points null."""
    parsed = F.from_json(body, "score double, probabilities map<string,double>, points map<string,string>")
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(parsed["points"], i.cast("string")))
    p = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.coalesce(F.try_element_at(parsed["probabilities"], i.cast("string")), F.lit(0.0)))
    return F.struct((parsed["score"] + 1).alias("score"), p.alias("probabilities"), at.alias("points"))
