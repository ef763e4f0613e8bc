"""Line dedup by distinct-site spread.

A line's spread is the number of distinct sites it occurs on.  HyperLogLog sketches of the sites are
built per line digest before the shuffle, straight from the occurrences, and merged after it: a row per
line and task moves, however many sites a line has.  Lines whose estimate lies within the error band
around the threshold, and only these, get an exact distinct count.  A line on at least ``min_sites`` sites
is boilerplate and leaves every document but the one that has it first (smallest id, then smallest line
number), so nothing is lost from the corpus altogether.  All steps are DataFrame functions.

Cases: null or empty texts have no lines and stay as they are; blank lines are never boilerplate; a
null site counts as one site of its own; null ids sort before all others; rows with equal id and text
are equal and lose the same lines (the first occurrence stays in each of them); rows that share an id but
not the text are different documents; other columns may have any name; an empty table gives an empty one.
Lines are compared after trimming spaces; digests are 128 bits wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settle
from .rows import held, version_of

MIN_SITES = 5
LG_K = 12
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def band(min_sites: int, lg_k: int) -> tuple[float, float]:
    """Estimates below the first number are surely under the threshold, above the second surely over:
    six standard errors of a sketch with 2**lg_k registers, one site at least."""
    width = max(1.0, 6 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    return min_sites - width, min_sites + width


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc, version, site, line_no, line): a 16-byte digest for each line that is not blank."""
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc"),
        version_of(text_col).alias("version"),
        F.col(f"`{site_col}`").cast("string").alias("site"),
        F.posexplode(_lines(F.col(f"`{text_col}`").cast("string"))).alias("line_no", "line_text"),
    )
    return base.select("doc", "version", "site", "line_no", F.trim("line_text").alias("line_text")).where("line_text <> ''").select(
        "doc", "version", "site", "line_no", F.unhex(F.md5("line_text")).alias("line")
    )


def spread(seen: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line, first, sites): digest, first occurrence and spread of each line on ``min_sites`` or more sites.

    Sketches merge by aggregation, a hot line's in every task first.  The exact count groups (line, site)
    of the few lines in the band: neither a hot line nor a hot site is one group before it is counted."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("n"))
    low, high = band(min_sites, lg_k)
    sketched = (
        seen.groupBy("line")
        .agg(
            F.min(F.struct("doc", "version", "line_no")).alias("first"),
            F.count(F.lit(1)).alias("n"),
            F.hll_sketch_agg(site, F.lit(lg_k)).alias("sketch"),
        )
        .where(F.col("n") >= min_sites)
        .select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") > low)
    )
    sketched = settle(sketched, "spread-lines")
    near = sketched.where(F.col("sites") < high).select("line")
    exact = seen.join(near, "line", "left_semi").groupBy("line", site.alias("site")).agg(F.count(F.lit(1)).alias("n")).groupBy("line").agg(F.count(F.lit(1)).alias("exact_sites"))
    return (
        sketched.join(exact, "line", "left")
        .where(F.coalesce("exact_sites", "sites") >= min_sites)
        .select("line", "first", F.coalesce("exact_sites", "sites").alias("sites"))
    )


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text.  ``counts`` names two more columns: lines
    before, and lines removed (``rows.free`` finds names).  The hits of a hot line are spread over salts."""
    seen = occurrences(docs, id_col, text_col, site_col)
    salt = F.pmod(F.xxhash64("doc", "version", "line_no"), F.lit(SALTS)).cast("int")
    widespread = spread(seen, min_sites, lg_k).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    hits = (
        seen.select("doc", "version", "line_no", "line", salt.alias("salt"))
        .join(widespread, ["line", "salt"])
        .where(~F.struct("doc", "version", "line_no").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc").alias("hit_doc"), F.col("version").alias("hit_version"))
        .agg(F.collect_set("line_no").alias("gone"))
    )
    joined = held(docs, id_col, text_col).join(
        hits, F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("version") == F.col("hit_version")), "left"
    )
    text = F.col("row").getField(text_col).cast("string")
    cut = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), _lines(text)).alias("parts"), _lines(text).alias("every"))
    # sets of places, so a long document costs no more than its lines
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")
    fields = [
        F.when(F.col("gone").isNull(), F.col("row").getField(c)).otherwise(kept).alias(c) if c == text_col else F.col("row").getField(c).alias(c)
        for c in docs.columns
    ]
    if counts is None:
        return cut.select(*fields)
    n_lines = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size("every"))
    return cut.select(*fields, n_lines.alias(counts[0]), F.coalesce(F.size("gone"), F.lit(0)).alias(counts[1]))


def oracle(min_sites: int = MIN_SITES) -> str:
    """The same removal as DuckDB SQL, with exact distinct counts throughout."""
    return f"""
WITH parts AS (SELECT doc_id, source, text, unnest(string_split(text, '\n')) AS raw,
    generate_subscripts(string_split(text, '\n'), 1) - 1 AS line_no FROM documents WHERE coalesce(text, '') <> ''),
seen AS (SELECT doc_id, source, line_no, trim(raw, ' ') AS line FROM parts WHERE trim(raw, ' ') <> ''),
wide AS (SELECT line, min(struct_pack(d := doc_id, n := line_no)) AS first_at FROM seen GROUP BY line
    HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {min_sites}),
gone AS (SELECT s.doc_id, s.line_no FROM seen s JOIN wide w ON s.line = w.line
    WHERE struct_pack(d := s.doc_id, n := s.line_no) <> w.first_at),
kept AS (SELECT p.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
    string_agg(CASE WHEN g.line_no IS NULL THEN p.raw END, '\n' ORDER BY p.line_no) AS kept_text
    FROM parts p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.line_no = p.line_no GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
    CASE WHEN coalesce(d.text, '') = '' THEN d.text ELSE coalesce(k.kept_text, '') END AS kept_text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
