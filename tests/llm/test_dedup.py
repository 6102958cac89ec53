import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from compare import connect, mismatch
from rows import EDGE, edge_docs, no_docs, prose

from ebbtide.llm import exact_dedup, line_dedup, registry, simhash, suffix_dedup
from ebbtide.llm.common import components

LAST = 1 << 63


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(50, 51), (51, 52), (52, 50), (9, 9)]
    found = components(spark.createDataFrame(edges, "a long, b long"), "t").collect()
    assert {r.node: r.component for r in found} == {k: v for k, v in roots(edges).items()}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# --- exact


def exact_brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    least = defaultdict(lambda: LAST)
    for (i, *_), t in zip(rows, norm):
        least[t] = min(least[t], LAST if i is None else i)
    size = Counter(norm)
    return sorted(
        (str(i), str(None if least[t] == LAST else least[t]), size[t], hashlib.sha256(t.encode()).hexdigest())
        for (i, *_), t in zip(rows, norm)
    )


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_groups_of_edge_rows(spark, block):
    got = exact_dedup.exact_groups(edge_docs(spark), block_bytes=block).collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == exact_brute(EDGE)
    kept = [r for r in got if r.kept]
    # One row stays of each text, also where the row itself repeats; null ids stand for themselves.
    assert Counter(r.text_sha256 for r in kept) == Counter({r.text_sha256: 1 for r in got})


def test_exact_dedup_keeps_all_columns_and_one_row_each(spark):
    docs = edge_docs(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert Counter(texts) == Counter(set(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in EDGE))
    assert exact_dedup.exact_groups(no_docs(spark)).count() == 0
    assert exact_dedup.keep_first(no_docs(spark)).count() == 0


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op5_line_dedup", "op10_tool_calls"])
def test_queries_against_sql(spark, folder, name):
    assert mismatch(registry.QUERIES[name](spark, folder), connect(folder), registry.ORACLE[name]) is None


# --- byte strings


def test_collection_of_strings_against_brute_force():
    draw = random.Random(3)
    for alphabet in (b"a", b"ab", bytes(range(65, 90)), bytes(range(256))):
        for length in (5, 16):
            base = bytes(draw.choices(alphabet, k=90))
            strings = [base[i : i + length + draw.randrange(40)] for i in range(0, 60, 5)]
            strings += [bytes(draw.choices(alphabet, k=draw.randrange(length, 70))) for _ in range(20)]
            places = np.array([draw.randrange(9) for _ in strings])
            best = {}
            for s, p in zip(strings, places):
                for i in range(len(s) - length + 1):
                    best[s[i : i + length]] = min(best.get(s[i : i + length], 99), p)
            expected = [[best[s[i : i + length]] for i in range(len(s) - length + 1)] for s in strings]
            assert [list(g) for g in suffix_dedup.smallest_places(strings, places, length)] == expected
    assert suffix_dedup.smallest_places([], np.zeros(0, np.int64)) == []


def repeats_brute(rows, length):
    first = {}
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, t in sorted(texts):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(None if i == LAST else i), len(t), int(gone.sum()), spans, kept))
    return sorted(out)


@pytest.mark.parametrize("wide", [1 << 20, 0])
def test_repeated_strings_of_edge_rows(spark, wide):
    """wide = 0 sends each window of a shared anchor by itself."""
    got = suffix_dedup.remove_repeats(edge_docs(spark), chunk_bytes=20_000, collection_bytes=30_000, wide_bytes=wide)
    found = sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert found == repeats_brute(EDGE, 50)
    assert sum(f[2] for f in found) > 50_000


def test_strings_alone_with_their_anchor_are_left_out(monkeypatch):
    """Segments as they are cut from texts: the same places with and without the lone ones in the collection."""
    draw = random.Random(8)
    base = [prose(i, 40).encode() for i in range(6)]
    texts = [b + prose(90 + i, 30).encode() for i, b in enumerate(base)] + [prose(60 + i, 9).encode() + b for i, b in enumerate(base[:3])]
    segments = {}
    for place, text in enumerate(texts):
        start, count, _ = suffix_dedup.runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 50)
        for s, c in zip(start.tolist(), count.tolist()):
            segments.setdefault(text[s : s + c + 49], place)
    strings, places = list(segments), np.array(list(segments.values()))
    draw.shuffle(strings)
    places = np.array([segments[s] for s in strings])
    whole = suffix_dedup.smallest_places(strings, places)
    sent = []
    build = suffix_dedup.smallest_places
    monkeypatch.setattr(suffix_dedup, "smallest_places", lambda own, *rest: sent.extend(own) or build(own, *rest))
    assert [list(g) for g in suffix_dedup._smallest(strings, places, 50)] == [list(g) for g in whole]
    assert 0 < len(sent) < len(strings)


def test_strings_that_share_only_their_anchor_are_left_out(monkeypatch):
    """A common phrase shorter than the length makes no shared window, so nothing is built of its strings."""
    draw = random.Random(3)
    strings = [draw.randbytes(40) + b"a phrase that many have" + draw.randbytes(40) for _ in range(200)]
    twice = draw.randbytes(30) + strings[7][20:80]
    sent = []
    build = suffix_dedup.smallest_places
    monkeypatch.setattr(suffix_dedup, "smallest_places", lambda own, *rest: sent.extend(own) or build(own, *rest))
    found = suffix_dedup._smallest([*strings, twice], np.arange(201), 50)
    assert sent == [strings[7][20:80]] * 2
    assert [i for i, own in enumerate(found) if own.min() < i] == [200]
    assert (found[200][:30] == 200).all() and (found[200][30:] == 7).all()
    assert suffix_dedup._smallest([], np.zeros(0, np.int64), 50) == []


def test_segment_hashes_can_be_compared_between_texts():
    a, b = b"some words that stand here", b"and again some words that stand there, and some more"
    one = suffix_dedup.segment_hashes(np.frombuffer(a, np.uint8), np.array([0]), np.array([21]))
    two = suffix_dedup.segment_hashes(np.frombuffer(b, np.uint8), np.array([10, 9]), np.array([21, 21]))
    assert one[0] == two[0] != two[1]


def test_an_anchor_is_asked_for_in_five_bytes():
    draw = random.Random(6)
    texts = [draw.randbytes(400) for _ in range(40)]
    texts[30] = texts[3]
    chunk = pd.DataFrame({"place": range(40), "body": texts, "chunk": 0})
    bounds = np.arange(0, 400 * 41, 400)
    keys = np.unique(suffix_dedup.runs(np.frombuffer(b"".join(texts), np.uint8), bounds, 50)[2])
    asked = suffix_dedup._anchor_request(50, 3)(chunk)
    assert asked["blob"].map(len).sum() == 5 * len(keys)
    replies = pd.concat([suffix_dedup._anchor_answer(1 << 20)(own) for _, own in asked.groupby("to")])
    shared, wide = suffix_dedup._anchors_of(replies)
    only = np.unique(suffix_dedup.runs(np.frombuffer(texts[3], np.uint8), np.array([0, 400]), 50)[2])
    assert not len(wide)
    assert set(shared) == set(suffix_dedup._in_part(only % np.uint64(3), suffix_dedup._names(only)))


def test_bodies_are_shuffled_once(spark):
    """Only rows that come often are collapsed before the exchange by chunk, which then serves all passes."""
    rows = [(1, None, 7, b"a")] * 150 + [(0, 2, 2, b"b")] * 3 + [(1, 7, 7, b"a")] * 2
    frame = spark.createDataFrame(rows, "chunk long, id long, place long, body binary")
    found = suffix_dedup._collapsed(frame, 100)
    assert sorted((r.place, r.copies) for r in found.collect()) == [(2, 3), (7, 2), (7, 150)]
    passed = found.groupBy("chunk").applyInPandas(lambda rows: rows[["chunk"]], "chunk long")
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(chunk#\w+, \d+\)", plan)) == 1
    assert len(re.findall(r"hashpartitioning\(chunk#\w+, (?:id|place)#", plan)) == 1  # of those that come often


def test_segment_hashes_follow_the_bytes():
    data = np.frombuffer(b"abcabcab" * 9, np.uint8)
    start, size = np.array([0, 8, 16, 3, 0]), np.array([8, 8, 8, 8, 7])
    found = suffix_dedup.segment_hashes(data, start, size)
    assert found[0] == found[1] == found[2] and len(set(found.tolist())) == 3


def test_a_footer_shorter_than_the_length_is_spread():
    """A common 36-byte footer puts its anchor into every document: its windows are dealt one by one, and no
    collection gets much more than another."""
    draw = random.Random(4)
    footer = b" -- all rights of this are reserved "
    assert len(footer) == 36
    texts = [draw.randbytes(120) + footer + draw.randbytes(60) for _ in range(3000)]
    chunks = [pd.DataFrame({"place": range(c, 3000, 6), "body": texts[c::6], "chunk": c}) for c in range(6)]

    def sizes(wide_bytes):
        parts = 8
        asked = pd.concat([suffix_dedup._anchor_request(50, parts)(c) for c in chunks])
        replies = pd.concat([suffix_dedup._anchor_answer(wide_bytes)(own) for _, own in asked.groupby("to")])
        total = Counter()
        for number, chunk in enumerate(chunks):
            sent = suffix_dedup._segment_request(50, parts)(chunk, replies[replies["c"] == number])
            for part, blob in zip(sent["to"], sent["blob"]):
                total[part] += int(suffix_dedup._unpacked(blob, "u1", "<i8", "<i8")[0].sum())
        return total

    together, apart = sizes(1 << 30), sizes(20_000)
    assert max(together.values()) > 0.5 * sum(together.values())
    assert max(apart.values()) < 0.25 * sum(apart.values())


def test_repeated_rows_are_one_row_until_the_end(spark):
    rows = [(1, prose(1), "a")] + [(2, prose(1), "a")] * 400 + [(None, prose(2), "a")] * 3 + [(3, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == repeats_brute(rows, 50)


def test_repeated_strings_of_low_complexity(spark):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("ab", k=draw.randrange(150))) + "ab" * draw.randrange(60), "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = suffix_dedup.remove_repeats(docs, length=20, chunk_bytes=900, collection_bytes=2000).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == repeats_brute(rows, 20)
    assert suffix_dedup.remove_repeats(no_docs(spark)).count() == 0


# --- lines


def test_lines_of_edge_rows(spark):
    docs = edge_docs(spark)
    got = {(r.id, r.n_lines, r.n_removed, r.n_spans, r.kept_text) for r in line_dedup.dedup_lines(docs).collect()}
    assert (9, 4, 3, 1, prose(9)) in got
    assert (8, 4, 0, 0, EDGE[11][1]) in got
    assert {(3, 1, 0, 0, ""), (4, 1, 0, 0, "")} <= got
    assert line_dedup.dedup_lines(docs).count() == len(EDGE)
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0


def test_lines_repeated_inside_a_document_and_under_one_id(spark):
    rows = [(1, "a\na\na\na\na"), (5, "x\ny\nz\nq"), (5, "x\ny\nz\nr"), (None, "x\ny\nz"), (6, "p\nx\ny\nz\nx\ny\nz")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.id), r.n_removed, r.n_spans, r.kept_text) for r in got) == [
        ("1", 4, 1, "a"), ("5", 0, 0, "x\ny\nz\nq"), ("5", 0, 0, "x\ny\nz\nr"), ("6", 6, 1, "p"), ("None", 3, 1, ""),
    ]


# --- fingerprints


def fingerprint_brute(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for text in (None, "", " \n", "One", "one two", "One two THREE four", prose(2, 200), "É é É"):
        assert simhash.fingerprint(text) % (1 << 64) == fingerprint_brute(text)
    long = prose(9, 70_000)
    assert simhash.fingerprint(long) % (1 << 64) == fingerprint_brute(long)


def test_linked_fingerprints_against_all_pairs(spark):
    draw = random.Random(8)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        value = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 9)):
            values.add(value)
            value ^= 1 << draw.randrange(64)
            value ^= draw.choice([0, 1 << draw.randrange(64)])
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long")
    for bits in (2, 3):
        want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % (1 << 64)).bit_count() <= bits}
        assert {(r.a, r.b) for r in simhash.linked_pairs(distinct, bits).collect()} == want


def test_near_groups_of_edge_rows(spark):
    got = simhash.near_groups(edge_docs(spark)).collect()
    prints = [(LAST if i is None else i, fingerprint_brute(t)) for i, t, _ in EDGE]
    links = [(a[1], b[1]) for a in prints for b in prints if (a[1] ^ b[1]).bit_count() <= 2]
    group = roots(links)
    least = defaultdict(lambda: LAST)
    for i, f in prints:
        least[group[f]] = min(least[group[f]], i)
    want = sorted((str(None if i == LAST else i), f, str(None if least[group[f]] == LAST else least[group[f]])) for i, f in prints)
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    kept = simhash.keep_one(edge_docs(spark))
    assert kept.count() == len(set(least)) and kept.columns == edge_docs(spark).columns
    assert simhash.near_groups(no_docs(spark)).count() == 0


# --- the registered queries over a whole table


def documents(spark, folder):
    return [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_suffix_query_against_brute_force(spark, folder):
    rows = documents(spark, folder)
    want = {(int(i), n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in repeats_brute(rows, 50)}
    got = registry.QUERIES["op2_suffix_dedup"](spark, folder)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == want


def test_simhash_query_against_brute_force(spark, folder):
    prints = [(i, fingerprint_brute(t)) for i, t, _ in documents(spark, folder)]
    group = roots([(a, b) for i, a in prints for j, b in prints if i <= j and (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in sorted(prints):
        least.setdefault(group[f], i)
    got = registry.QUERIES["op9_simhash_dedup"](spark, folder).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", least[group[f]]) for i, f in prints}
