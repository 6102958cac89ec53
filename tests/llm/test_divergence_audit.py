import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, mismatch
from rows import edge_docs, no_docs, prose

from ebbtide.llm import divergence_audit as da


def brute(rows, least=10):
    """(lang, source, part, item, value, rank) in plain Python integers; rows are (lang, source, text)."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in terms]
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(own):
            total = sum(own[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (own[t] + 2) // total for t in kept]

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        price = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(t, sum(map(price, p[s], p[t]))) for t in sources if t != s]
            terms = [(t, price(a, b)) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda f: (-f[1], f[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)}
    return out


def results(frame):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(sources):
    draw = random.Random(sources)
    rows = []
    for i in range(60 * sources):
        words = [draw.choice(["Été", "the", "THE", "naïve", "x1y", "漢字", "ſs", "KelvinK"]) + draw.choice("abcdefgh") for _ in range(draw.randrange(9))]
        rows.append((draw.choice(["en", "fr", None]), f"s{draw.randrange(sources)}", draw.choice([" ", ", ", "-"]).join(words)))
    rows += [("de", "alone", "too rare"), ("de", "other", None), ("de", None, ""), ("en", "bare", "12 34"), ("en", "s1", "the " * 50_000)]
    return rows + rows[:30]


@pytest.mark.parametrize(("sources", "tile", "block"), [(5, 64, 4096), (17, 4, 8)])
def test_audit_against_plain_sums(spark, monkeypatch, sources, tile, block):
    """Small blocks and tiles spread terms and sources over tasks."""
    monkeypatch.setattr(da, "TILE_SOURCES", tile)
    monkeypatch.setattr(da, "HELD_TERMS", 20)
    rows = made_up(sources)
    docs = spark.createDataFrame([r + (1, "z") for r in rows], "lang string, source string, text string, block long, term string")
    assert results(da.divergence_audit(docs, block_terms=block)) == brute(rows)


def test_trees_share_equal_subtrees():
    counts = np.array([[1, 2, 1, 2, 0, 0, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0], [0] * 8, [1, 2, 1, 2, 0, 0, 0, 0]])
    forest = da.Forest(counts)
    assert forest.roots[0] == forest.roots[3] != forest.roots[1]
    assert [h.shape[1] for h in forest.halves] == [2, 3, 3]  # pairs (1, 2) and (0, 0); three halves; three trees
    x, y, times = forest.meetings(0, 1)
    assert sorted(zip(x, y, times)) == sorted((a, b, n) for (a, b), n in Counter(zip(*counts[:2].tolist())).items())


def test_forest_meets_every_leaf_once():
    draw = np.random.default_rng(2)
    for width in (1, 2, 3, 31, 64, 100):
        counts = draw.poisson(0.4, (4, width))
        forest = da.Forest(counts)
        for a in range(4):
            for b in range(4):
                met = Counter({(x, y): n for x, y, n in zip(*(v.tolist() for v in forest.meetings(a, b)))})
                assert met == Counter(zip(counts[a].tolist(), counts[b].tolist()))


def test_probabilities_of_huge_counts():
    counts = np.array([0, 5, 10**13], np.int64)
    total = 10**13 + 5 + 6
    assert da.probabilities(counts, total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts.tolist()]


def test_edge_rows(spark):
    docs = edge_docs(spark).selectExpr("*", "source AS lang")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert results(da.divergence_audit(docs, least_docs=2)) == brute(rows, 2)
    assert da.divergence_audit(no_docs(spark).selectExpr("*", "source AS lang")).count() == 0
    same = spark.createDataFrame([("en", "a", prose(1))] * 12, "lang string, source string, text string")
    assert results(da.divergence_audit(same)) == brute([tuple(r) for r in same.collect()])


def test_registered_query_against_sql_and_sums(spark, folder):
    found = da.op12_divergence_audit(spark, folder)
    assert mismatch(found, connect(folder), da.OP12_SQL) is None
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "source", "text").collect()
    assert results(found) == brute([tuple(r) for r in rows])
