"""Text functions, Column in and Column out, all of them built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word boundaries that mean the same in Java, RE2 and Python on any script.
W0, W1 = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
CJK = r"[\x{4e00}-\x{9fff}]"

# Stop words that carry no content in a question.
STOP_WORDS = (
    "a an the you your do did have has what whats is are was were how why me my i we our to of in on for and or about "
    "tell can could would any with that this it"
).split()

# Question categories, first match wins.
FOLLOWUP = (
    rf"is that (correct|right)|^(it )?sounds like{W1}|{W0}you (said|mentioned|just (said|mentioned|trained)){W1}|"
    rf"{W0}(this|that) (code|project){W1}|{W0}been there{W1}|{W0}do (you|they) do (there|exactly){W1}"
)
CATEGORIES = (
    ("coding", r"coding|solve\s*:|implement|write (a|from)|leetcode|from scratch|白板.*(cod|题)"),
    ("system_design", rf"system design|design.*{W0}(system|pipeline|ranking)|how would you (design|build)|架构"),
    (
        "logistics",
        rf"visa|spons|relocat|on[- ]?site|hybrid|notice{W1}|located|location|where.*based|based (out|in)|base在|your base{W1}|"
        r"calling in from|office|days a week|availability|start date|schedul|consent|authoriz|work author|move immediat|签证|入职|办公",
    ),
    (
        "experience",
        r"walk me through|tell me about (a|the|your|more)|experience with|have you (work|done|built|fine-tun|tried|isolat)|"
        r"production issue|debug|proud of|challeng|你.*(经历|经验)|有没有|有什么.*经验",
    ),
    (
        "technical",
        r"precision|recall|overfit|underfit|gradient|pytorch|tensor|model|deploy|serv(ed|ing)|monitor|roll.*back|kubernetes|"
        r"terraform|feature|metric|fine-?tun|token|transformer|neural|statis|compiled|database|latency|observability|privacy|"
        rf"{W0}(sft|rlhf|rag|llm|k8s|iou|r2|r²|oop|api|sla|aws|gpu|cuda|pinn){W1}",
    ),
)
# Screening intents, first match wins.
INTENTS = (
    ("compensation", r"compensation|salary|薪酬|base value|rough estimate"),
    ("why_us", r"bringing you to|motivat\w*.{0,25}apply|interested in (a|the|this|our).{0,20}compan|why (us|this company)"),
    (
        "pipeline_status",
        r"interviewing (elsewhere|with)|other (ongoing )?interview|final stages|actively (looking|interviewing|searching)|job search|"
        r"career search|(your|the) timeline|making a decision|how far along|passively or actively|on ?going oppo|talked to any other company",
    ),
    (
        "tell_me_about_yourself",
        r"tell (me|my) .{0,20}(yourself|your background|your cv|your experience|resume)|overview of your (cv|career)|"
        r"walk me through your resume|highlight your background|^introduce yourself|个人介绍|自我介绍",
    ),
    (
        "why_leaving",
        r"(why|reason|what.?s bringing|motivat\w*).{0,45}(leav|switch|change|new (role|opportunit|job)|apply|explore|opportunit\w* outside)|"
        r"looking to leave|why are you looking|searching for new|为什么.{0,10}离开",
    ),
    (
        "questions_for_me",
        r"questions? (for (me|us|you)|unclear|at all)|(you )?have any (initial |other |specific )?questions|"
        r"anything (else|i can help|i didn.?t touch)|help clarify|before (we wrap|i let you go)",
    ),
    ("know_our_company", r"(know|familiar|heard) (much )?about|were you familiar|公司.{0,8}(熟悉|了解)"),
    (
        "current_company",
        r"(about|introduce|explain|tell me about) .{0,15}(current|your) (company|employer|position|role)|is \w+ a startup|"
        r"what.?s the company doing|介绍当前雇主|(当前|现在)的?(公司|雇主|职责)",
    ),
    (
        "next_role_wants",
        r"(what|things|important) .{0,40}(looking for|important (to|for) you).{0,40}(next|role|opportunit|company|compan)|"
        r"kind of compan(y|ies).{0,45}looking|top things|differentiating between one opportunit",
    ),
)
# Keyword routing of list questions into modules, first match wins.
KEYWORD_MODULES = (
    (rf"{W0}rag{W1}|retriev|rerank|chunk|vector|embedding|hybrid search|bm25", "RAG & Retrieval"),
    (rf"agent|tool[- ]?use|function call|mcp{W1}|planning|multi-agent", "Agents & Tool Use"),
    (r"prompt|few-shot|zero-shot|chain[- ]of[- ]thought|context window|in-context", "Prompt & Context Engineering"),
    (rf"fine-?tun|lora|rlhf|dpo|alignment|instruction|sft{W1}|reward model|peft", "Fine-tuning & Alignment"),
    (r"evaluat|benchmark|metric|judge|observab|monitor|hallucinat", "Evaluation & Observability"),
    (
        r"inference|kv cache|serving|latency|throughput|quantiz|batching|speculative|deploy|distill|prun|vllm|flash attention|memory",
        "Inference & Production",
    ),
    (r"safety|jailbreak|injection|guardrail|bias|toxic|privacy|red[- ]team", "Safety & Security"),
)
DEFAULT_MODULE = "LLM Fundamentals"
IMPERATIVE = r"^(implement|write|solve|design|build|draft|explain)([^\p{L}\p{N}_]|$)"

# Words that a spoken sentence does not end on.
UNFINISHED_TAIL = (
    "and but or so because then which that with to of for in on at by from into about than as if when while where the a an is was are were "
    "be been being i we my our um uh like also just really basically actually very"
).split()
# Filler phrases of spoken answers.
FILLERS = ("um", "uh", "erm", "like", "you know", "kind of", "sort of", "basically", "actually", "i mean", "stuff like that")
# Replacements of the phonetic key, in order.
PHONETIC = (("ph", "f"), ("ck", "k"), ("qu", "kw"), ("q", "k"), ("c", "k"), ("x", "ks"), ("z", "s"), ("y", "i"), ("w", "v"))
# Spoken numbers.
NUMBER_WORDS = dict(
    zip(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
        "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split(),
        [*map(str, range(21)), "30", "40", "50", "60", "70", "80", "90", "100", "1000"],
    )
)
# Characters of transcripts and what replaces them, in order.
SPOKEN = (
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", " "), ("—", " "), ("‒", " "), ("−", "-"), ("²", "2"), ("³", "3"), ("×", " x "),
    ("→", " "), ("≤", " <= "), ("≥", " >= "), ("…", " "), ("'", ""), ("/", " "), ("-", " "), ("_", " "), ("@", " at "), ("+", " plus "),
    ("%", " percent "),
)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; accented letters split words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(tokens(text))


def content_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOP_WORDS)))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def stem(token: Column) -> Column:
    """Without the first of ing, ed, s that leaves three characters or more."""
    cut = lambda suffix: token.endswith(suffix) & (F.length(token) - len(suffix) >= 3)
    keep = lambda suffix: F.substr(token, F.lit(1), F.length(token) - len(suffix))
    return F.when(cut("ing"), keep("ing")).when(cut("ed"), keep("ed")).when(cut("s"), keep("s")).otherwise(token)


def grader_tokens(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?;\n]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) >= 3)


def ladder(text: Column, rules, default: Column) -> Column:
    """First (name, pattern) whose pattern occurs in ``text``."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def classify(text: Column, lowered: bool = False) -> Column:
    """Category of a question; ``lowered`` says that the text is in lower case, which saves doing it per rung."""
    return ladder(text if lowered else F.lower(text), (("followup", FOLLOWUP), *CATEGORIES), F.lit("behavioral"))


def intent_of(text: Column, lowered: bool = False) -> Column:
    return ladder(text if lowered else F.lower(text), INTENTS, F.lit(None).cast("string"))


def module_for(text: Column, lowered: bool = False) -> Column:
    return ladder(text if lowered else F.lower(text), [(m, p) for p, m in KEYWORD_MODULES], F.lit(DEFAULT_MODULE))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def language_of(text: Column) -> Column:
    n = cjk_count(text)
    return F.when(n == 0, "en").when(n > F.length(text) / 3, "zh").otherwise("mixed")


def too_vague(text: Column) -> Column:
    weight = F.size(tokens(text)) + F.floor(cjk_count(text) / 2)
    rescued = text.contains("?") | text.contains("？") | F.lower(text).rlike(IMPERATIVE)
    return ~rescued & (weight < 5)


def slug(text: Column, n: int = 4) -> Column:
    """First ``n`` tokens joined by underscores, or ``question``."""
    return F.coalesce(F.nullif(F.array_join(F.slice(tokens(text), 1, n), "_"), F.lit("")), F.lit("question"))


def slugify(text: Column) -> Column:
    return F.array_join(tokens(text), "-")


def title_from_slug(slug_: Column) -> Column:
    return F.array_join(F.transform(F.split(slug_, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def record_id(prefix: str, number: Column, text: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), F.lpad(number.cast("string"), 3, "0"), slug(text))


def clip_words(text: Column, cap: int) -> Column:
    w = words(text)
    return F.concat(F.array_join(F.slice(w, 1, cap), " "), F.when(F.size(w) > cap, " ...").otherwise(""))


def cap_words(text: Column, cap: int) -> Column:
    """The paragraphs that fit in ``cap`` words, at least the first, else the first ``cap`` words of it."""
    paragraphs = F.split(text, r"\n\s*\n")
    total = lambda upto: F.aggregate(F.slice(paragraphs, 1, upto), F.lit(0), lambda a, p: a + F.size(words(p)))
    n = F.size(F.filter(F.sequence(F.lit(1), F.size(paragraphs)), lambda i: total(i) <= cap))
    return F.when(n > 0, F.array_join(F.slice(paragraphs, 1, F.greatest(n, F.lit(1))), "\n\n")).otherwise(clip_words(text, cap))


def phonetic_key(text: Column) -> Column:
    out = F.lower(text)
    for old, new in PHONETIC:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.substring(out, 1, 1), F.regexp_replace(F.substr(out, F.lit(2)), "[aeiou]", ""))
    return F.regexp_replace(out, r"(.)\1+", "$1")


def looks_unfinished(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    last = F.regexp_replace(F.lower(F.element_at(F.split(t, r"\s+"), -1)), "[^a-z']", "")
    end = F.right(t, F.lit(1))
    return F.when(t == "", False).when(end.isin(*",;:-"), True).when(end.isin(*".?!"), False).otherwise(last.isin(*UNFINISHED_TAIL))


def word_run(text: Column) -> Column:
    """Words of a spoken answer."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9']+"), F.lit(0))


def filler_count(text: Column) -> Column:
    """Non-overlapping occurrences of each filler, counted one filler at a time."""
    padded = F.concat(F.lit(" "), F.lower(F.array_join(word_run(text), " ")), F.lit(" "))
    count = lambda f: (F.length(padded) - F.length(F.replace(padded, F.lit(f" {f} "), F.lit("")))) / (len(f) + 2)
    total = count(FILLERS[0])
    for f in FILLERS[1:]:
        total = total + count(f)
    return total.cast("long")


def spoken_tokens(text: Column) -> Column:
    """Tokens of a transcript: symbols as words, digit words as digits, decimals kept, punctuation gone.
    Compatibility characters are expected to be folded before (``functions.udfs.nfkc``)."""
    out = F.coalesce(text, F.lit(""))
    for old, new in SPOKEN:
        out = F.replace(out, F.lit(old), F.lit(new))
    numbers = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    bare = lambda w: F.regexp_replace(w, r"""^[.,;:!?"']+|[.,;:!?"']+$""", "")
    spoken = F.transform(words(F.lower(out)), lambda w: F.coalesce(F.try_element_at(numbers, bare(w)), w))
    joined = F.regexp_replace(F.array_join(spoken, " "), r"(?<=\d) point (?=\d)", ".")
    joined = F.regexp_replace(F.regexp_replace(joined, r"(?<!\d)\.|\.(?!\d)", " "), r"(?U)[^\w.%\s]", " ")
    return words(joined)


def canonical(token_list: Column) -> Column:
    return F.array_join(token_list, "")


def normalize_label(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("yes", "y", "fair", "1"), "fair").when(v.isin("no", "n", "unfair", "0"), "unfair")


def error_type(stderr: Column) -> Column:
    """Class name of the last line that begins with one, else ``Error``."""
    lines = F.transform(F.split(F.coalesce(stderr, F.lit("")), "\n"), lambda x: F.trim(x))
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^(\w+(?:Error|Exception|Interrupt|Exit))\b", 1)), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("Error"))


def split_trailer(text: Column) -> tuple[Column, Column]:
    """(spoken, trailer) at the last line of dashes; the trailer is null without one."""
    pattern = r"(?s)^(.*)\n-{3,}[ \t]*\n(.*)$"
    has = text.rlike(pattern)
    return F.when(has, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(F.trim(text)), F.when(has, F.regexp_extract(text, pattern, 2))


def replace_section(text: Column, heading: str, section: str) -> Column:
    """The part from ``heading`` to the next heading of its level replaced by ``section``."""
    level = heading.split(" ")[0]
    return F.regexp_replace(text, rf"(?ms)^\Q{heading}\E$.*?(?=^{level} |\z)", section.replace("\\", "\\\\").replace("$", "\\$"))


def normalize_resume(text: Column) -> Column:
    """Plain line breaks, bullets for private-use characters, wrapped words joined, blank lines collapsed."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x{e000}-\x{f8ff}]", "-")
    out = F.regexp_replace(F.replace(out, F.lit(" "), F.lit(" ")), r"(\w)-\n(\w)", "$1-$2")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n\s*\n+", "\n\n"))


def markdown_to_text(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)```.*?```", "")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)^\s*(import|export) .*$", ""), r"<[A-Za-z/][^>]*>", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def rst_to_text(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?m)^([^\n]+)\n[=\-~^\"']{3,}[ \t]*$", "# $1")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)^\s*\.\. .*$", ""), r"(?m)^\s*(>>>|\.\.\.) ?", "")
    out = F.regexp_replace(F.regexp_replace(out, r":[a-z:]+:`~?([^`<]+)( <[^>]*>)?`", "$1"), "``", "`")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def pydoc_to_text(source: Column, symbol: str) -> Column:
    """The docstring of a class in Python source, dedented, as text; null without one."""
    pattern = rf"(?sm)^class \Q{symbol}\E\b[^\n]*:\n\s+(\x22{{3}}|\x27{{3}})(.*?)\1"
    doc = F.nullif(F.regexp_extract(source, pattern, 2), F.lit(""))
    rows = F.split(doc, "\n")
    margins = F.transform(F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))
    margin = F.coalesce(F.array_min(margins), F.lit(0))
    flat = F.transform(rows, lambda x, i: F.when(i == 0, F.ltrim(x)).otherwise(F.substr(x, margin + 1)))
    return rst_to_text(F.array_join(flat, "\n"))


# What a line of code outside fences looks like, and words that tell steps.
CODE_LINE = (
    r"^\s*(?:\w+(?:\[[^\]]*\])?\s*[-+*/]?=\s*\S|def\s+\w+\(|class\s+\w+|(?:for|while|if|elif|else|try|except|with)\b[^\n]*:\s*$"
    r"|return\b|import\s+\w+|from\s+\w+\s+import\b|\w+\([^)]*\)\s*$)"
)
STEP_WORDS = r"(?i)\b(first|then|next|finally|after that|loop|iterate|for each|return|update|increment|decrement|while)\b"


def code_lines(reply: Column) -> Column:
    """Lines of code: all that is not blank between fences, and lines outside that read as code."""
    rows = F.split(F.coalesce(reply, F.lit("")), "\n")
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("fenced"))

    def step(s: Column, row: Column) -> Column:
        fence = F.trim(row).startswith("```")
        counts = F.when(s["fenced"], F.trim(row) != "").otherwise(row.rlike(CODE_LINE))
        return F.struct((s["n"] + F.when(~fence & counts, 1).otherwise(0)).alias("n"), (s["fenced"] != fence).alias("fenced"))

    return F.aggregate(rows, start, step, lambda s: s["n"])


def prose_suspect(reply: Column, level: Column) -> Column:
    """Whether a reply may give away a procedure: long at level 2; long and in steps below."""
    t = F.coalesce(reply, F.lit(""))
    n, steps = F.regexp_count(t, F.lit(r"\w+")), F.regexp_count(t, F.lit(r"(?m)^\s*(?:\d+[.)]|[-*])\s+"))
    return F.when(level == 2, n > 55).otherwise((n > 60) & ((steps >= 3) | (F.regexp_count(t, F.lit(STEP_WORDS)) >= 5)))


def render(body: Column, **slots: Column) -> Column:
    """A template with its ``{slot}`` places filled; doubled braces are braces."""
    out = F.replace(F.replace(body, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.replace(F.replace(out, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.format_string("[%02d:%02d]", F.floor(s / 60).cast("int"), (s % 60).cast("int"))
