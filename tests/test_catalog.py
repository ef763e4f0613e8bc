"""Every query: against DuckDB where it has SQL, else against a plain Python version or known bounds."""

import difflib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone import catalog
from rillstone.catalog import corpus as C
from rillstone.catalog import text as X
from rillstone.functions import text
from rillstone.plans.session import table
from rillstone.streaming import folds
from tests.oracle import assert_same, oracle

QUERIES, ORACLES = catalog.all_queries(), catalog.all_oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), oracle(ORACLES[name], sf))


def test_keys_match():
    assert set(ORACLES) <= set(QUERIES)


def test_every_query_is_compared():
    """A query without SQL has a comparison here."""
    own = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert set(QUERIES) - set(ORACLES) <= own, set(QUERIES) - set(ORACLES) - own


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "bm25_topk" in entry.queries()


def greedy(ids, score):
    """(kept, into): rows in order, each merged into the best accepted one before it."""
    accepted, into = [], {}
    for i in ids:
        near = [(score[a, i], -a) for a in accepted if (a, i) in score]
        if near:
            into[i] = -max(near)[1]
        else:
            accepted.append(i)
    return set(accepted), into


def test_greedy_merge(spark, sf):
    sets = {r.idx: set(r.tokens) for r in X.dedupe.token_sets(table(spark, sf, "documents"), "doc_id", "text").collect()}
    ids = sorted(sets)
    score = {}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            s = len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j]))
            if s >= 0.65 - 1e-12:
                score[i, j] = s
    kept, into = greedy(ids, score)
    got = [r for r in QUERIES["greedy_merge"](spark, sf).collect() if r.idx in sets]
    assert {r.idx for r in got if r.kept} == kept and {r.idx: r.into for r in got if not r.kept} == into


def test_cosine_dedupe(spark, sf):
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s, ids = np.round(v @ v.T, 6), [r.vec_id for r in rows]
    score = {(ids[a], ids[b]): s[a, b] for a in range(len(ids)) for b in range(a + 1, len(ids)) if s[a, b] >= 0.35}
    kept, into = greedy(ids, score)
    got = QUERIES["cosine_dedupe"](spark, sf).collect()
    assert {r.idx for r in got if r.kept} == kept and {r.idx: r.into for r in got if not r.kept} == into


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_wer_pairs(spark, sf):
    tokens = lambda t, key: {r[0]: list(r[1]) for r in table(spark, sf, t).select(key, text.spoken_tokens(F.col("text"))).collect()}
    items, docs = tokens("benchmark", "item_id"), tokens("documents", "doc_id")
    got = QUERIES["wer_pairs"](spark, sf).collect()
    shared = defaultdict(dict)
    for r in X.shingle_contamination(spark, sf).collect():
        shared[r.item_id][r.doc_id] = r.shared
    assert {r.item_id: r.doc_id for r in got} == {i: min(d, key=lambda x: (-d[x], x)) for i, d in shared.items()}
    for r in sorted(got, key=lambda r: len(docs[r.doc_id]))[:8]:
        want = edits(items[r.item_id], docs[r.doc_id])
        assert r.edits == want and r.wer == pytest.approx(want / max(1, len(items[r.item_id])), abs=1e-6)


def test_term_errors(spark, sf):
    lex = [(r.term, list(r.tokens), set(r.forms)) for r in X._lexicon(spark).collect()]
    want = {}
    for r in X._term_items(spark, sf).collect():
        for term, toks, forms in lex:
            runs = lambda t, n: sum(t[i : i + n] == toks for i in range(len(t) - n + 1))
            count = runs(list(r.ref), len(toks))
            if count:
                hyp = list(r.hyp)
                loose = sum(any("".join(hyp[i : i + n]) in forms for n in range(1, len(hyp) - i + 1)) for i in range(len(hyp)))
                want[r["item"], term] = (count, min(count, runs(hyp, len(toks))), min(count, loose))
    got = {(r["item"], r.term): (r["count"], r.strict, r.lenient) for r in QUERIES["term_errors"](spark, sf).collect()}
    assert got == want


def test_keyterm_select(spark, sf):
    per = defaultdict(lambda: [0, 0])
    for r in QUERIES["term_errors"](spark, sf).collect():
        per[r.term][0] += r["count"]
        per[r.term][1] += r.lenient
    score = {}
    for pos, (term, common) in enumerate([("that", True), ("of the", False), ("tion", False), ("with", False)]):
        n, hit = per[term]
        rate = round(1 - hit / n, 3) if n else 0.0
        rarity = 0.0 if common else 0.5 if " " in term else 1.0
        score[term] = (-round(3 * rate + (term == "tion") + rarity - (n >= 2 and rate == 0), 6), pos)
    want = sorted(score, key=score.get)[:3]
    assert [r.form for r in QUERIES["keyterm_select"](spark, sf).orderBy("place").collect()] == want


def test_html_blocks(spark, sf):
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    got = {r.page_id: r.text for r in QUERIES["html_blocks"](spark, sf).collect()}
    assert set(got) == set(pages)
    for page, html in pages.items():
        paragraphs = [re.sub(r"\s+", " ", re.sub("<[^>]*>", "", p)).strip() for p in re.findall(r"(?s)<p>(.*?)</p>", html or "")]
        assert not re.search(r"</?(p|h1|div|script)>", got[page] or "")
        flat = re.sub(r"\s+", " ", got[page] or "")
        found = [p for p in paragraphs if p and "&" not in p and p[:60] in flat]
        assert len(found) >= 0.5 * len([p for p in paragraphs if p and "&" not in p])


def test_page_sections(spark, sf):
    want = Counter()
    for r in QUERIES["html_blocks"](spark, sf).collect():
        section = None
        for line in (r.text or "").split("\n"):
            if line.startswith("#"):
                section = re.sub("^#+ ", "", line)
                want[r.page_id, section] += 0
            else:
                want[r.page_id, section] += 1
    assert {(r.page_id, r.section): r.paragraphs for r in QUERIES["page_sections"](spark, sf).collect()} == dict(want)


def test_sentence_stream(spark, sf):
    got = {(r.conv_id, r.turn): r for r in QUERIES["sentence_stream"](spark, sf).collect()}
    for r in table(spark, sf, "conversations").collect():
        if re.fullmatch(r"(?:[A-Z]?[a-z]{4,} ?)+\.", r.text):  # one plain sentence
            assert got[r.conv_id, r.turn].sentences <= 1
        assert 0 <= got[r.conv_id, r.turn].rest <= len(r.text)


def test_synthetic_answers(spark, sf):
    n = table(spark, sf, "benchmark").count()
    per = Counter(r.tier for r in QUERIES["synthetic_answers"](spark, sf).collect())
    assert per["model_answer"] == per["vague"] == per["question_echo"] == n and per["partial"] >= per["partial_2"] and len(per) >= 11


def test_tier_label_range(spark, sf):
    got = {r.tier: (r.low, r.high) for r in QUERIES["tier_label_range"](spark, sf).collect()}
    assert got["model_answer"] == (9, 9) and got["vague"] == (2, 2) and got["off_topic"] == (1, 1) and 2 <= got["partial"][0] <= got["partial"][1] <= 8


def test_coverage_features(spark, sf):
    """The features tell good answers from poor ones; each lies in its range."""
    rows = QUERIES["coverage_features"](spark, sf).collect()
    of = defaultdict(list)
    for r in rows:
        of[r.row_id.split("/")[1]].append(r.kp_cover_mean)
        assert 0 <= r.kp_cover_min <= r.kp_cover_mean <= r.kp_cover_max <= 1 + 1e-6 and 0 <= r.technical_density <= 1 and 0 <= r.type_token_ratio <= 1
    assert np.mean(of["model_answer"]) > np.mean(of["vague_short"]) + 0.2 and len(rows) == QUERIES["synthetic_answers"](spark, sf).count()


def test_keypoint_features(spark, sf):
    for r in QUERIES["keypoint_features"](spark, sf).limit(400).collect():
        assert r.cover_best == pytest.approx(max(r.token_overlap, r.char_cosine), abs=1e-6) and 0 <= r.cover_rank_norm <= 1 and r.kp_idf_mean >= 0


def test_quota_coupled(spark, sf):
    events = C.table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("day"), "ts", "event_id", "user_id", "event_type").collect()
    used, calls, total, want = Counter(), Counter(), Counter(), {}
    for r in sorted(events, key=lambda r: (r.ts, r.event_id)):
        paid = r.event_type == "click"
        if paid and used[r.day, r.user_id] >= 1:
            want[r.event_id] = "quota"
        elif calls[r.day, r.user_id] >= 4 or total[r.day] >= 250:
            want[r.event_id] = "budget"
        else:
            used[r.day, r.user_id] += paid
            calls[r.day, r.user_id] += 1
            total[r.day] += 1
            want[r.event_id] = "ok"
    assert {r.event_id: r.verdict for r in QUERIES["quota_coupled"](spark, sf).collect()} == want


def test_endpoint_events(spark, sf):
    frames = defaultdict(list)
    for r in table(spark, sf, "events").collect():
        frames[r.user_id].append((r.event_id, r.event_id * 7919 % 1000 / 1000.0))
    want = set()
    for session, rows in frames.items():
        speaking, against, total, said, gave = False, 0.0, 0.0, False, False
        for frame, p in sorted(rows):
            voiced = p >= (0.35 if speaking else 0.5)
            total += 32
            against = against + 32 if voiced != speaking else 0.0
            if voiced != speaking and against >= (96 if speaking else 64):
                speaking, against, said = not speaking, 0.0, True
                want.add((session, frame, "speech_start" if speaking else "end_of_turn"))
            elif not speaking and not voiced and not said and not gave and total >= 1000:
                gave = True
                want.add((session, frame, "timeout"))
    assert {tuple(r) for r in QUERIES["endpoint_events"](spark, sf).collect()} == want


def test_spoken_stream(spark, sf):
    said, heard = defaultdict(list), defaultdict(list)
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        said[r.conv_id].append(r.text)
    for r in QUERIES["spoken_stream"](spark, sf).orderBy("turn_id", "seq").collect():
        heard[r.turn_id].append(r.sentence)
    for conv, parts in heard.items():  # what is spoken stands in the text, in order
        whole, at = re.sub(r"\s+", " ", " ".join(said[conv])), 0
        for s in parts:
            at = whole.find(re.sub(r"\s+", " ", s).strip(), at)
            assert at >= 0


def test_transcript_reconcile(spark, sf):
    rows = QUERIES["transcript_reconcile"](spark, sf).collect()
    segments = defaultdict(list)
    for r in table(spark, sf, "events").collect():
        kind = "interim" if r.event_type in ("click", "view") else "final"
        segments[r.user_id].append((r.event_id, kind, float(r.event_id - r.event_id % 3 * 40), r.event_type))
    assert {r.session for r in rows} == set(segments)
    for r in rows:
        machine = folds.Reconciler()
        for _, kind, end, words in sorted(segments[r.session]):
            machine.feed(kind, end, words)
        assert r.text == machine.finish()


def test_record_questions(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["record_questions"](spark, sf).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.id].append(r.place)
        assert difflib.SequenceMatcher(None, r.question[:40], texts[r.id], autojunk=False).find_longest_match().size >= min(5, len(r.question))
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_ridge_metrics(spark, sf):
    r = QUERIES["ridge_metrics"](spark, sf).first()
    assert r.n > 20 and r.mae < 2.0 and r.spearman > 0.5


def test_boosted_metrics(spark, sf):
    r = QUERIES["boosted_metrics"](spark, sf).first()
    assert r.n > 20 and r.mae < 2.0 and r.spearman > 0.5


def test_rf_metrics(spark, sf):
    r = QUERIES["rf_metrics"](spark, sf).first()
    assert r.accuracy > 0.6 and r.macro_f1 > 0.4


def test_stacked_metrics(spark, sf):
    r = QUERIES["stacked_metrics"](spark, sf).first()
    assert r.n > 20 and r.mae < 2.0


def test_isotonic_fit(spark, sf):
    """Rising, and the pooled means of the training rows."""
    train, _ = C._graded(spark, sf)
    rows = sorted((r.kp_cover_mean, r.label) for r in train.select("kp_cover_mean", "label").collect())
    blocks = []  # sum, number, upper end
    for x in sorted({x for x, _ in rows}):
        ys = [y for v, y in rows if v == x]
        blocks.append([sum(ys), len(ys), x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], last[2]]
    got = sorted((r.cover, r.calibrated) for r in QUERIES["isotonic_fit"](spark, sf).collect())
    assert [c for _, c in got] == sorted(c for _, c in got)
    for x, y in got:
        block = next((b for b in blocks if x <= b[2]), blocks[-1])
        low = max((b[0] / b[1] for b in blocks if b[2] < x), default=1.0)
        assert min(low, 10) - 1e-6 <= y <= max(1.0, min(10.0, block[0] / block[1])) + 1e-6
