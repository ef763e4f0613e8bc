"""Benchmark decontamination by template windows.

Texts are canonicalised into templates: numbers, units after numbers and names (capitalised words inside
a sentence) become typed placeholders, punctuation goes, and the first words of sentences are lower-cased.  Windows
of WINDOW template words are hashed and joined to the windows of the benchmark.  Matches of a document
and an item that lie on one diagonal (same distance between both positions) belong together: there, the
slots' values are paired up, and they must stand for each other one to one.  A document is contaminated
by an item if one consistent diagonal covers at least COVERAGE of the item's windows.  Items shorter than
a window must equal a document's whole template.  All steps are DataFrame functions.

``drop_contaminated`` also drops what ``embedded`` finds: items with changed, inserted or dropped words.
There, windows of SEED words on neighbouring diagonals are added up, and COVERAGE of the item's words must
be covered; items of fewer than WINDOW words must be covered whole.

The benchmark's windows are broadcast while they are few (counted first); a larger benchmark is joined by
a shuffle of the hashes.  Only matches are ever grouped, per document, item and diagonal, which bounds a
group by the item's length.

Cases: null and empty texts and items match nothing; repeated benchmark texts each report their own id;
repeated documents are reported once; rows that share an id, or have none, are judged by their own text
(``version``, its hash); null ids are reported as null; texts of any length are read whole; empty tables match
nothing.  Only id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.broadcasts import is_small
from .rows import version_of, without

WINDOW, COVERAGE = 8, 0.8
SEED, SHIFT = 4, 0.2  # embedded items: words of a window; by how many of an item's words diagonals may lie apart
BROADCAST_WINDOWS = 100_000  # of some 300 bytes each, words and slots included

# Unit words that count as such right after a number.
UNITS = (
    "percent kg g mg lb lbs oz t km m cm mm mi mile miles ft feet inch inches yd s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years l ml gal gallon gallons w kw v a hz usd eur gbp dollar dollars euro euros pound pounds cent cents c f k"
).split()
FIRST, UNIT, NUMBER, NAME = "\x02", "\x03", "#", "\x01"
# The canonicalisation, as (pattern, replacement) in the order of application: mark the
# first word of a sentence, mark units, leave one space between words.
MARKS = (
    (r"[.!?:\n][^\p{L}\p{N}]*(\p{L})", " " + FIRST + "{1}"),
    (rf"([0-9]) ?({'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)", "{1} " + UNIT + "{2}{3}"),
    (r"[^\p{L}\p{N}\x02\x03]+", " "),
)


def _java(put: str) -> str:
    return put.replace("{", "$").replace("}", "")


def marked(text: Column) -> Column:
    """The text's words, one space apart; the first words of sentences and units bear a mark in front."""
    out = F.concat(F.lit("."), F.coalesce(text, F.lit("")))
    for pattern, put in MARKS:
        out = F.regexp_replace(out, pattern, _java(put))
    return F.trim(out)


def template_word(mark: Column) -> Column:
    """A placeholder or the word in lower case.  Words compare by their bytes, so the first character
    tells marks, digits and capitals (of Latin-1) apart."""
    capital = ((mark >= "A") & (mark < "[")) | ((mark >= "À") & (mark < "ß"))
    return (
        F.when(mark < UNIT, F.lower(F.substr(mark, F.lit(2))))
        .when(mark < "\x04", UNIT)
        .when((mark >= "0") & (mark < ":"), NUMBER)
        .when(capital, NAME)
        .otherwise(mark)
    )


def _shifted(hashes: Column, by: int) -> Column:
    """Hash of neighbours ``by`` apart, for each position that has one."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + by, n), lambda a, b: F.xxhash64(a, b))


def prepare(df: DataFrame, id_col: str, text_col: str, name: str, window: int = WINDOW) -> DataFrame:
    """(name, version, marks, words, hashes): marked words, template words and the hash of the window at each
    position (``window`` is a power of two: windows are hashed by doubling).  A text of fewer words has one
    hash, of the whole, which equals no window's."""
    out = df.select(F.col(f"`{id_col}`").alias(name), version_of(text_col).alias("version"), F.split(marked(F.col(f"`{text_col}`")), " ").alias("marks"))
    out = out.withColumn("words", F.transform("marks", template_word))
    out = out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    width = 1
    while width < window:
        out = out.withColumn("hashes", _shifted(F.col("hashes"), width))
        width *= 2
    whole = F.array(F.xxhash64(F.lit("whole"), F.array_join("words", " ")))
    return out.withColumn("hashes", F.when(F.size("words") < window, whole).otherwise(F.col("hashes")))


def _slots(words: Column, marks: Column, at: Column) -> Column:
    """(position, value) of the placeholders among ``words``, which begin at position ``at``."""
    pairs = F.transform(F.arrays_zip(words.alias("w"), marks.alias("m")), lambda x, i: F.struct((at + i).alias("at"), x["w"].alias("w"), x["m"].alias("m")))
    return F.transform(F.filter(pairs, lambda p: p["w"].isin(NUMBER, NAME, UNIT)), lambda p: F.struct(p["at"].alias("at"), p["m"].alias("m")))


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """(doc_id, version, item_id, n_words, item_windows, item_pos, diagonal, item_slots, doc_slots): equal windows."""
    texts = prepare(docs, id_col, text_col, "doc_id", window)
    items = prepare(benchmark, item_id, item_text, "item_id", window).where("words[0] <> ''")
    here = F.slice("words", F.col("pos") + 1, window)
    slots = _slots(here, F.slice("marks", F.col("pos") + 1, window), F.col("pos"))
    item_windows = (
        items.withColumn("item_windows", F.size("hashes"))
        .select("item_id", "item_windows", "words", "marks", F.posexplode("hashes").alias("pos", "hash"))
        .select("item_id", F.size("words").alias("n_words"), "item_windows", F.col("pos").alias("item_pos"), F.col("hash").alias("item_hash"), F.array_join(here, " ").alias("item_words"), slots.alias("item_slots"))
    )
    if is_small(item_windows.select("item_hash"), BROADCAST_WINDOWS):
        item_windows = F.broadcast(item_windows)
    return (
        # outer: for a plain explode the planner puts a filter on the array's size below, which computes all hashes again
        texts.select("doc_id", "version", "words", "marks", F.posexplode_outer("hashes").alias("pos", "hash"))
        .join(item_windows, F.col("hash") == F.col("item_hash"))
        # written as no equality: it would become a join key, computed for every window of every document
        .where(F.array_join(here, " ").between(F.col("item_words"), F.col("item_words")))
        .select("doc_id", "version", "item_id", "n_words", "item_windows", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_slots", slots.alias("doc_slots"))
    )


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, version, item_id, windows, item_windows, coverage, slots, changed): the best consistent diagonal of
    each contaminated document and item; ``changed`` counts the slots with another value."""
    hits = _hits(docs, benchmark, id_col, text_col, item_id, item_text, WINDOW)
    paired = F.zip_with("item_slots", "doc_slots", lambda i, d: F.struct(i["at"].alias("at"), i["m"].alias("i"), d["m"].alias("d")))
    lines = (
        hits.groupBy("doc_id", "version", "item_id", "item_windows", "diagonal")
        .agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(paired))).alias("pairs"))
        .withColumn("windows", F.size("at"))
        .where(F.col("windows") >= F.ceil(F.col("item_windows") * COVERAGE))
    )
    distinct = lambda f: F.size(F.array_distinct(F.transform("pairs", f)))
    one_to_one = lines.select(
        "*", distinct(lambda p: F.struct(p["i"], p["d"])).alias("n_pairs"), distinct(lambda p: p["i"]).alias("n_i"), distinct(lambda p: p["d"]).alias("n_d")
    ).where("n_pairs = n_i AND n_pairs = n_d")
    found = one_to_one.select(
        "doc_id", "version", "item_id", F.col("windows").cast("long").alias("windows"), F.col("item_windows").cast("long").alias("item_windows"),
        F.size("pairs").cast("long").alias("slots"), F.size(F.filter("pairs", lambda p: p["i"] != p["d"])).cast("long").alias("changed"),
    )
    best = F.max(F.struct("windows", (-F.col("changed")).alias("same"), "item_windows", "slots")).alias("b")
    return found.groupBy("doc_id", "version", "item_id").agg(best).select(
        "doc_id", "version", "item_id", "b.windows", "b.item_windows", F.round(F.col("b.windows") / F.col("b.item_windows"), 6).alias("coverage"),
        "b.slots", (-F.col("b.same")).alias("changed"),
    )


def embedded(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, version, item_id) of documents that hold an item with few words changed, inserted or dropped.

    Diagonals up to SHIFT of the item's words apart are taken together, those of most words first; each
    adds the words that none before it covers, unless their slots contradict.  An item of fewer than
    WINDOW words must be covered whole, with SEED ordinary words; of fewer than SEED, ``matches`` decides.
    """
    hits = _hits(docs, benchmark, id_col, text_col, item_id, item_text, SEED).where(F.col("n_words") >= SEED)
    paired = F.zip_with("item_slots", "doc_slots", lambda i, d: F.struct(i["at"].alias("at"), i["m"].alias("i"), d["m"].alias("d")))
    covers = F.transform(F.collect_set("item_pos"), lambda p: F.sequence(p, p + SEED - 1))
    lines = (
        hits.groupBy("doc_id", "version", "item_id", "n_words", "diagonal")
        .agg(F.array_distinct(F.flatten(covers)).alias("at"), F.array_distinct(F.flatten(F.collect_set(paired))).alias("pairs"))
    )
    long = F.col("n_words") >= WINDOW
    need = F.when(long, F.ceil(F.col("n_words") * COVERAGE)).otherwise(F.col("n_words"))
    # bands overlap by half: diagonals that may go together have one in common
    half = F.when(long, F.floor(F.col("n_words") * SHIFT)).otherwise(0) + 1
    band = F.floor(F.col("diagonal") / half)
    bands = (
        lines.withColumn("band", F.explode(F.array(band, band - 1)))
        .groupBy("doc_id", "version", "item_id", "n_words", "band")
        .agg(F.sort_array(F.collect_list(F.struct(F.size("at").alias("n"), "diagonal", "at", "pairs")), asc=False).alias("lines"))
        .where(F.size(F.array_distinct(F.flatten(F.col("lines.at")))) >= need)
    )
    distinct = lambda pairs, f: F.size(F.array_distinct(F.transform(pairs, f)))

    def add(held: Column, line: Column) -> Column:
        fresh = F.array_except(line["at"], held["at"])
        pairs = F.concat(held["pairs"], F.filter(line["pairs"], lambda p: F.array_contains(fresh, p["at"])))
        n = distinct(pairs, lambda p: F.struct(p["i"], p["d"]))
        fits = (n == distinct(pairs, lambda p: p["i"])) & (n == distinct(pairs, lambda p: p["d"]))
        return F.when(fits, F.struct(F.concat(held["at"], fresh).alias("at"), pairs.alias("pairs"))).otherwise(held)

    nothing = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<struct<at:int,i:string,d:string>>").alias("pairs"))
    found = bands.withColumn("all", F.aggregate("lines", nothing, add)).where(F.size("all.at") >= need)
    return found.where(long | (F.col("n_words") - F.size("all.pairs") >= SEED)).select("doc_id", "version", "item_id").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, columns unchanged."""
    found = matches(docs, benchmark, id_col, text_col).select("doc_id", "version").union(embedded(docs, benchmark, id_col, text_col).select("doc_id", "version"))
    return without(docs, found, id_col, text_col)


def oracle() -> str:
    """The same search as DuckDB SQL, windows compared as strings."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    mark = "'.' || coalesce(text, '')"
    for pattern, put in MARKS:
        mark = f"regexp_replace({mark}, {quote(pattern)}, {quote(put.replace('{', chr(92)).replace('}', ''))}, 'g')"
    word = f"""CASE WHEN m < '{UNIT}' THEN lower(substr(m, 2)) WHEN m < '\x04' THEN '{UNIT}' WHEN m >= '0' AND m < ':' THEN '{NUMBER}'
      WHEN (m >= 'A' AND m < '[') OR (m >= 'À' AND m < 'ß') THEN '{NAME}' ELSE m END"""
    side = lambda t, key: f"""SELECT id, ver, marks, words, CASE WHEN len(words) < {WINDOW} THEN 1 ELSE len(words) - {WINDOW - 1} END AS n FROM (
      SELECT id, ver, marks, list_transform(marks, lambda m: {word}) AS words FROM (SELECT {key} AS id, md5(coalesce(text, '')) AS ver, string_split(trim({mark}), ' ') AS marks FROM {t}))
      WHERE words[1] <> ''"""  # noqa: E731
    windows = lambda t: f"SELECT id, ver, n, marks, words, unnest(range(n)) AS pos FROM {t}"
    slot = f"w IN ('{NUMBER}', '{NAME}', '{UNIT}')"
    return f"""
WITH d AS ({side("documents", "doc_id")}), b AS ({side("benchmark", "item_id")}),
dw AS (SELECT *, words[pos + 1:pos + {WINDOW}] AS win FROM ({windows("d")})),
bw AS (SELECT *, words[pos + 1:pos + {WINDOW}] AS win FROM ({windows("b")})),
hits AS (SELECT dw.id AS doc_id, dw.ver AS ver, bw.id AS item_id, bw.n AS item_windows, bw.pos AS item_pos, dw.pos - bw.pos AS diagonal,
  bw.win AS ws, bw.marks[bw.pos + 1:bw.pos + {WINDOW}] AS ims, dw.marks[dw.pos + 1:dw.pos + {WINDOW}] AS dms
  FROM dw JOIN bw ON dw.win = bw.win AND (len(dw.words) < {WINDOW}) = (len(bw.words) < {WINDOW})),
lines AS (SELECT doc_id, ver, item_id, item_windows, diagonal, count(DISTINCT item_pos) AS windows FROM hits GROUP BY ALL
  HAVING count(DISTINCT item_pos) >= ceil(item_windows * {COVERAGE})),
pairs AS (SELECT DISTINCT h.doc_id, h.ver, h.item_id, h.item_windows, h.diagonal, h.item_pos + k AS at, h.ws[k + 1] AS w, h.ims[k + 1] AS i, h.dms[k + 1] AS d
  FROM (SELECT *, unnest(range(len(ws))) AS k FROM hits) h),
slots AS (SELECT doc_id, ver, item_id, item_windows, diagonal, count(*) AS slots, count(*) FILTER (i <> d) AS changed,
  count(DISTINCT i || ' ' || d) AS np, count(DISTINCT i) AS ni, count(DISTINCT d) AS nd FROM pairs WHERE {slot} GROUP BY ALL),
found AS (SELECT l.doc_id, l.ver, l.item_id, l.windows, l.item_windows, coalesce(s.slots, 0) AS slots, coalesce(s.changed, 0) AS changed
  FROM lines l LEFT JOIN slots s ON s.doc_id IS NOT DISTINCT FROM l.doc_id AND s.ver = l.ver AND s.item_id = l.item_id AND s.diagonal = l.diagonal
  WHERE s.np IS NULL OR (s.np = s.ni AND s.np = s.nd))
SELECT doc_id, item_id, windows::BIGINT AS windows, item_windows::BIGINT AS item_windows, round(windows / item_windows, 6) AS coverage,
  slots::BIGINT AS slots, changed::BIGINT AS changed
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ver, item_id ORDER BY windows DESC, changed, item_windows DESC, slots DESC) AS r FROM found) WHERE r = 1
"""
