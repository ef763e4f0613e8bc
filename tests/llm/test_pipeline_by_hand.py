"""The whole pipeline against a plain Python version of its stages."""

import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from rillstone.llm import mixing, quality

WORDS = "the house stands near a river and people walk along its bank every morning while birds sing in tall trees behind them".split()
ITEM = "Name the largest moon of the ringed planet and say which of its lakes holds the most liquid methane in winter"


def fixture():
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = []
    for i in range(70):
        lines = [prose(rng.randint(25, 60)), prose(rng.randint(10, 30))]
        if i % 3 == 0:
            lines.insert(1, "subscribe to the letter of the house")  # on seven sources
        if i in (5, 17):
            lines.append("and so on: " + ITEM + ".")
        rows.append((i, "\n".join(lines), "en" if i % 4 else "fr", f"s{i % 7}"))
    for i, base in ((70, 1), (71, 2), (72, 1)):  # near copies
        words = rows[base][1].split(" ")
        words[3] = "river"
        rows.append((i, " ".join(words), "en", "s1"))
    rows += [(80 + k, "".join(rng.choice("qxzjvk #$%") for _ in range(150)), "en", "s2") for k in range(4)]  # junk
    rows += [(90, None, "en", "s1"), (91, "", "en", "s1"), (92, rows[7][1], "en", "s6"), (93, prose(40), None, None)]
    labels = [(i, 1, 0) for i in range(0, 60)] + [(3, 0, 0), (81, 0, 0)]
    return rows, labels, [(1, ITEM), (2, None)]


def classes(text):
    return np.frombuffer(quality.fold(text or ""), np.uint16).tolist()


class Model:
    def __init__(self, texts):
        n = quality.ORDER
        self.counts = [Counter() for _ in range(n + 1)]
        for t in texts:
            p = [0] * (n - 1) + classes(t) + [0]
            self.counts[n].update(tuple(p[k - n + 1 : k + 1]) for k in range(n - 1, len(p)))
        for k in range(n - 1, 0, -1):
            self.counts[k].update(g[1:] for g in self.counts[k + 1])
        self.cut, self.total, self.freed = [None] * (n + 1), [defaultdict(int) for _ in range(n + 1)], [defaultdict(float) for _ in range(n + 1)]
        for k in range(1, n + 1):
            of = Counter(min(v, 9) for v in self.counts[k].values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.0
            self.cut[k] = [0.0] + [min(j, max(0.0, j - (j + 1) * y * of[j + 1] / of[j])) if of[j] else 0.5 * j for j in (1, 2, 3)]
            for g, v in self.counts[k].items():
                self.total[k][g[:-1]] += v
                self.freed[k][g[:-1]] += self.cut[k][min(v, 3)]

    def p(self, g):
        if not g:
            return 1 / quality.CLASSES
        k, low = len(g), self.p(g[1:])
        if g[:-1] not in self.total[k]:
            return low
        c = self.counts[k].get(g, 0)
        return (c - self.cut[k][min(c, 3)] + self.freed[k][g[:-1]] * low) / self.total[k][g[:-1]]

    def perplexity(self, text):
        n, q = quality.ORDER, classes(text)
        if not q:
            return None
        q = [0] * (n - 1) + q + [0]
        return math.exp(-sum(math.log(max(1e-12, self.p(tuple(q[k - n + 1 : k + 1])))) for k in range(n - 1, len(q))) / (len(q) - n + 1))


def good(rows, labels):
    quality_of = defaultdict(set)
    for i, q, _ in labels:
        quality_of[i].add(q)
    trusted = {i for i, qs in quality_of.items() if qs == {1}}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    held = {i for i in trusted if signed(xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) % quality.CALIBRATION == 0}
    model = Model([t for i, t, *_ in rows if i in trusted - held])
    ppl = [model.perplexity(t) for _, t, *_ in rows]
    pick = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs)) - 1)]

    def cut(values, q):
        sample = [(r[2], v) for r, v in zip(rows, values) if r[0] in held and v is not None]
        every, own = pick([v for _, v in sample], q), defaultdict(list)
        for lang, v in sample:
            own[lang].append(v)
        of = lambda lang: math.exp((len(own[lang]) * math.log(pick(own[lang], q)) + quality.PRIOR_TEXTS * math.log(every)) / (len(own[lang]) + quality.PRIOR_TEXTS)) if lang is not None and own.get(lang) else every
        return [of(r[2]) for r in rows]

    middle, n = cut(ppl, 0.5), [len(t or "") + 1 for _, t, *_ in rows]
    score = [None if p is None else math.exp((math.log(p) * k + quality.PRIOR_CHARS * math.log(m)) / (k + quality.PRIOR_CHARS)) for p, k, m in zip(ppl, n, middle)]
    limit = [x * quality.MARGIN for x in cut(score, quality.QUANTILE)]
    return [r for r, s, x in zip(rows, score, limit) if s is not None and s <= x]


def without_boilerplate(rows):
    sites, first = defaultdict(set), {}
    for i, t, _, s in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(s)
                first.setdefault(line.strip(" "), (i, k))
    out = []
    for i, t, lang, s in rows:
        kept = [line for k, line in enumerate(t.split("\n")) if len(sites[line.strip(" ")]) < 5 or first[line.strip(" ")] == (i, k)]
        if "\n".join(kept).strip() or len(kept) == len(t.split("\n")):
            out.append((i, "\n".join(kept), lang, s))
    return out


def one_of_near_copies(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t, *_ in rows for w in [t.lower().split()]]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    least = {}
    for r, row in zip(root, rows):
        least[r] = min(least.get(r, row), row, key=lambda x: x[0])
    return list(least.values())


def uniform(seed, *keys):
    return int(hashlib.md5(":".join([str(seed), *map(str, keys)]).encode()).hexdigest()[:13], 16) / 2**52


def mixed(rows):
    mass = Counter()
    for _, t, _, s in rows:
        mass[s] += max(1, len(t))
    weight = {s: m**mixing.TEMPERATURE for s, m in mass.items()}
    rate = {s: weight[s] * sum(mass.values()) / (sum(weight.values()) * mass[s]) for s in mass}
    out = []
    for i, t, _, s in rows:
        for copy in range(mixing.expected_copies(rate[s], uniform(mixing.SEED, i))):
            out.append((i, t, copy, uniform(mixing.SEED + 1, i, copy)))
    return out


def test_pipeline_by_hand(spark, tmp_path):
    rows, labels, bench = fixture()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = good(rows, labels)
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {80, 81, 82, 83, 90, 91}
    lines = without_boilerplate(kept)
    single = one_of_near_copies(lines)
    assert {70, 72, 92} & {r[0] for r in single} == set()
    clean = [r for r in single if ITEM not in r[1]]
    want = mixed(clean)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, r.copy_no) for r in got) == sorted((i, t, c) for i, t, c, _ in want)
    keys = {(i, c): u for i, _, c, u in want}
    assert all(r.mix_key == pytest.approx(keys[r.doc_id, r.copy_no]) and r.n_chars == len(r.text) for r in got)
