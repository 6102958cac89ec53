import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import EDGE, edge_docs, no_docs, prose
from tokenizers import Tokenizer

from ebbtide.llm import metric_join, mixing, packing, quality_classifier, range_coder, registry, token_files, tool_calls
from ebbtide.llm.tokens import TextIds, public_path

# --- embeddings


def vector_rows(seed=4):
    draw = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for _ in range(30):
            centre = draw.normal(size=6)
            for _ in range(draw.integers(1, 9)):
                rows.append((len(rows), (centre + draw.normal(size=6) * 0.25).astype(np.float32).tolist(), label))
    rows += [(900 + i, rows[0][1], 0) for i in range(5)]  # copies
    rows += [(905, rows[0][1], 1), (906, rows[0][1], None), (907, None, 0), (908, [0.0] * 6, 0), (909, [], 0)]
    rows += [(910, [float("nan")] * 6, 0), (911, [None] * 6, 0), (912, [float("inf")] + [0.0] * 5, 0)]
    rows += [(913, rows[0][1][:5], 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    return rows


def links_brute(rows, least=0.93):
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[] for _ in range(n)]
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                if math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b)) >= least:
                    near[i].append(j)
                    near[j].append(i)
    place = [1 << 63 if i is None else i for i, *_ in rows]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        smallest = min(place[g] for g in group)
        for g in group:
            out[g] = (str(rows[g][0]), len(near[g]), str(None if smallest == 1 << 63 else smallest))
    return sorted(out)


@pytest.mark.parametrize("cell", [2048, 20])
def test_range_join_against_all_pairs(spark, monkeypatch, cell):
    """Small cells make several rounds of pivots and visitors."""
    monkeypatch.setattr(metric_join, "CELL_ROWS", cell)
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 40)
    rows = vector_rows()
    vectors = spark.createDataFrame([r + ("x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cell string, node long")
    got = metric_join.range_join(vectors).collect()
    assert sorted((str(r.id), r.n_links, str(r.component_id)) for r in got) == links_brute(rows)
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_range_join_of_parallel_vectors(spark, monkeypatch):
    """Vectors of one direction, which no pivot takes apart, among others."""
    stored = metric_join.materialize

    def bounded(df, purpose, rounds=[]):  # noqa: B006
        rounds += [purpose] * (purpose == "cells")
        assert len(rounds) < 12, "cells are not split any further"
        return stored(df, purpose)

    monkeypatch.setattr(metric_join, "CELL_ROWS", 20)
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 40)
    monkeypatch.setattr(metric_join, "materialize", bounded)
    rows = [(i, [i + 1.0] + [0.0] * 5, 0) for i in range(150)]
    rows += [(200 + i, [3.0, 0.05 * i] + [0.0] * 4, 0) for i in range(1, 40)]
    rows += [(i + 300, v, label) for i, (_, v, label) in enumerate(vector_rows(7)[:120])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = metric_join.range_join(vectors).collect()
    assert sorted((str(r.id), r.n_links, str(r.component_id)) for r in got) == links_brute(rows)


def test_range_join_of_extreme_vectors(spark):
    """Their squares leave the range of doubles, their directions do not."""
    rows = [(1, [1e-200, 0.0], 0), (2, [1e200, 1e199], 0), (3, [1.0, 0.0], 0), (4, [5e-324, 0.0], 0), (5, [0.0, -1e308], 0), (6, [0.0, -3.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in metric_join.range_join(vectors).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5)}


def test_range_join_of_nothing(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert metric_join.range_join(vectors).count() == 0


# --- mixing


def mixed(rows):
    """Tokens taken of each source, and how often each document."""
    taken, times = defaultdict(int), Counter()
    for r in rows:
        taken[r.source] += r.n_tokens
        times[r.doc_id, r.source, r.h1, r.h2] += 1
    return taken, times


def mixing_docs(spark):
    draw = random.Random(2)
    rows = [(i, prose(i, draw.randrange(1, 60)), s) for i, s in enumerate("a" * 200 + "b" * 60 + "c" * 25)]
    return spark.createDataFrame(rows + [(900, "x y", None), (901, "", "none"), (902, None, "none")], "doc_id long, text string, source string")


def test_mix_meets_the_limit_of_repeats(spark):
    docs = mixing_docs(spark)
    tokens = defaultdict(int)
    for r in docs.collect():
        tokens[r.source] += len((r.text or "").split())
    limit = 3.0
    taken, times = mixed(mixing.mix(docs, max_repeats=limit).collect())
    shares = [v for v in tokens.values() if v]
    t = 1 + math.log(limit) / math.log(min(shares) / max(shares))
    for source, own in tokens.items():
        repeats = (own / max(shares)) ** (t - 1) if own else 1.0
        budget = repeats * own
        longest = 60
        assert budget - longest <= taken[source] <= budget * (1 + 1e-6) + 1e-6, source
    assert len(times) == docs.count()
    assert set(times.values()) <= {1, 2, 3}


def test_mix_meets_an_entropy_and_a_budget(spark):
    docs = mixing_docs(spark).where("source IN ('a', 'b', 'c')")
    found = mixing.mix(docs, entropy=1.0, budget_tokens=3000).collect()
    weights = {r.source: r.weight for r in found}
    assert abs(sum(weights.values()) - 1) < 1e-9
    assert abs(-sum(w * math.log(w) for w in weights.values()) - 1.0) < 1e-6
    taken, times = mixed(found)
    for source, weight in weights.items():
        assert 0 <= weight * 3000 - taken[source] <= 60
        own = [n for (_, s, *_), n in times.items() if s == source]
        assert max(own) - min(own) <= 1  # passes are whole but for the last


def test_mix_of_edge_rows(spark):
    docs = edge_docs(spark)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r.source) for r in got.collect()} == set(EDGE)
    rows = mixing.mix(docs, max_repeats=1.0).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((i, s) for i, _, s in EDGE)
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mixed_documents(no_docs(spark)).count() == 0


# --- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_bound_and_best_fit(sizes):
    sizes = np.array(sizes, np.int64)
    bins, offsets, rooms = packing.best_fit(sizes, 32)
    bound = packing.lower_bound(sizes, 32)
    assert bound <= len(rooms) <= max(bound, math.ceil(11 / 9 * bound) + 1)
    for b in range(len(rooms)):
        own = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist()))
        assert [o for o, _ in own] == np.cumsum([0] + [s for _, s in own[:-1]]).tolist()
        assert sum(s for _, s in own) + rooms[b] == 32


def test_cut_lengths():
    assert packing.cut_lengths(1) == [1] and packing.cut_lengths(2048) == [2048]
    assert packing.cut_lengths(5000) == [904, 2048, 2048]


def check_sequences(rows, capacity=2048):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack_edge_rows(spark):
    rows = packing.pack_documents(edge_docs(spark)).collect()
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want = []
    for doc, text, _ in EDGE:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        start = 0
        for piece, length in enumerate(packing.cut_lengths(len(ids))):
            want.append((str(doc), piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            start += length
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert check_sequences(rows) == packing.lower_bound(np.array([w[3] for w in want]))
    assert packing.pack_documents(no_docs(spark)).count() == 0


def test_exchange_between_partitions(spark):
    draw = random.Random(1)
    rows = [(i, 0, 0, draw.choice([700, 690, 1400, 3, 1000, 650]), 0, i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing._PIECES)
    alone = packing.pack(pieces, rows_per_task=10_000).collect()
    dealt = packing.pack(pieces, rows_per_task=300).collect()
    assert sorted(r.uid for r in dealt) == list(range(3000))
    bound = packing.lower_bound(np.array([r[3] for r in rows]))
    assert bound <= check_sequences(alone) and check_sequences(dealt) <= check_sequences(alone) * 1.01 + 1


def test_rounds_end_where_no_bin_is_saved(spark, caplog):
    """Pieces above half a sequence: no two fit one, so dealing them anew saves nothing and ends."""
    rows = [(i, 0, 0, 1100 + i % 7, 0, i) for i in range(400)]
    pieces = spark.createDataFrame(rows, packing._PIECES)
    with caplog.at_level("INFO", logger=packing.__name__):
        packed = packing.pack(pieces, rows_per_task=50).collect()
    assert check_sequences(packed) == 400 and sorted(r.uid for r in packed) == list(range(400))
    rounds = [r.getMessage() for r in caplog.records if r.name == packing.__name__]
    assert 1 <= len(rounds) <= 12 and "8 of 8 partitions certified" in rounds[0]


# --- tokens and their files


def test_pieces_give_the_library_ids():
    texts = ["", " ", "\n", "a\n\nb", "a  b c \n d", " lead", "trail ", "tab\tx\r\ny", "<|endoftext|> a", "a b  c",
             "İSTANBUL ΣΑΣ Σ é x\x1cy \x1c z", "it's I'll  we've\n 's", "日本語 テキスト 👍🏽 🙂", "a \n b", "x\n", "né,. É! ß #1a"] + [t or "" for _, t, _ in EDGE]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        encoder = TextIds(public_path(name), drops, most=50)
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode(texts) == want


def test_special_tokens_in_texts_give_the_library_ids():
    from tokenizers import Tokenizer

    marks = ["<|endoftext|>", "<|startoftext|>"]
    texts = [t.replace("@", m) for m in marks for t in (
        "a @ b", "@", "@ a", "a @", " @ ", "a@b", "a@ b c", "a @b c", "@@", "@ @ x", "x\n@\ny", "\n@", "@\n", "a  @  b", "a \n @ \n b",
        "tab\t@\t b", "a @ ", " @ a", "It's @, and @. So", "A@ B @C", "a @\n\n b c", "\x1c@ b", "a.@ b", "1 @ 2", "é @ ß c",
    )] + ["<|endoftext|", "a <| endoftext |> b", "<|ENDOFTEXT|> a", "<|endoftext|><|startoftext|> a b"]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        library = Tokenizer.from_file(public_path(name))
        got = [np.frombuffer(ids, "<u4").tolist() for ids in TextIds(public_path(name), drops).encode(texts)]
        for text, ids in zip(texts, got):
            assert ids == library.encode(text, add_special_tokens=False).ids, (name, text)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=300), max_size=5), st.integers(1, 4))
def test_range_coder_round_trip(blocks, repeat):
    blocks = [np.array(b * repeat, np.int64) for b in blocks]
    coded = range_coder.write_blocks([(b, b"t%d" % i) for i, b in enumerate(blocks)])
    for i, (own, (ids, tables)) in enumerate(zip(blocks, range_coder.read_blocks(coded))):
        assert ids.tolist() == own.tolist() and tables == b"t%d" % i


def test_range_coder_learns_and_tells_damage():
    draw = np.random.default_rng(1)
    ids = np.tile(draw.integers(0, 50_000, 256), 16)
    (coded,) = range_coder.write_blocks([(ids, b"")])
    assert len(coded) < 3 * 256 + 1200  # the later rounds cost nearly nothing
    for at in (0, 30, len(coded) - 1):
        bad = bytearray(coded)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.read_blocks([bytes(bad)])
    a, b = b"some bytes", b"and more" * 40
    assert range_coder.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files_of_edge_rows(spark, tmp_path):
    path = f"{tmp_path}/ids"
    docs = edge_docs(spark)
    token_files.write_token_files(docs, path)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == sorted([i for i, *_ in EDGE if i is not None]) + [None, None]
    tokenizer = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    want = Counter()
    for doc, text, _ in EDGE:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    token_files.write_token_files(no_docs(spark), f"{tmp_path}/none")
    assert token_files.read_token_files(spark, f"{tmp_path}/none").count() == 0


# --- classifier


def labelled(spark, n=900, seed=3):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = draw.choice([0, 0, 0, 1, 2])
        text = prose(i, draw.randrange(30, 200))
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 2:
            words = text.split()
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(["vile", "scumbag", "idiots"]))
            text = " ".join(words)
        rows.append((i, text, kind))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    labels += [(None, 1, 0), (5_000, None, 0), (5_001, 1, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, kind int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    rows, docs, labels = labelled(spark)
    kept = {r.id for r in quality_classifier.resample(docs, labels).collect()}
    held_out = [(i, kind) for i, _, kind in rows if i % 2 == 0]
    assert sum(i in kept for i, kind in held_out if kind == 0) >= 0.98 * sum(kind == 0 for _, kind in held_out)
    assert sum(i in kept for i, kind in held_out if kind) <= 0.03 * sum(kind > 0 for _, kind in held_out)
    first = quality_classifier.resample(docs, labels, k=100).collect()
    assert len(first) == 100 and {r.id for r in first} <= kept


def test_classifier_on_edge_rows(spark):
    docs = edge_docs(spark)
    _, _, labels = labelled(spark, 20)
    none = labels.limit(0)
    assert quality_classifier.resample(docs, none).count() == len(EDGE)
    kept = quality_classifier.keep_sampled(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(EDGE)
    assert quality_classifier.resample(no_docs(spark), labels).count() == 0


def test_classifier_with_few_labels(spark):
    """At sf0.01 each insult is in 12 to 21 labelled documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.join(docs.select("doc_id", "lang"), "doc_id").where("quality > 0").collect()
    for some in (labels, labels.where("doc_id % 4 <> 1")):
        kept = {r.id for r in quality_classifier.resample(docs, some).collect()}
        toxic = [r.doc_id in kept for r in rows if r.toxic and r.lang == "en"]
        clean = [r.doc_id in kept for r in rows if not r.toxic]
        assert len(toxic) > 25 and sum(toxic) <= 0.05 * len(toxic)
        assert sum(clean) >= 0.99 * len(clean)


def test_labelled_classes(spark):
    rows = [(i, 1, 0) for i in range(5_000)] + [(i, 0, 1) for i in range(5_000, 5_600)] + [(i, 1, 1) for i in range(6_000, 6_050)]
    rows += [(7_000, None, 1), (7_001, None, 0), (7_002, None, None), (None, 1, 1), (7_000, 1, 0), (7_003, 1, 0), (7_003, None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    every = {r.id: (r.kind, r.of) for r in quality_classifier.labelled_classes(labels).collect()}
    assert len(every) == 5_652 and every[0] == (0, 5_000) and every[5_000] == (1, 600)
    assert every[7_000] == every[7_003] == every[6_000] == (2, 52)
    some = quality_classifier.labelled_classes(labels, most=1_000).collect()
    of = {kind: [r.of for r in some if r.kind == kind] for kind in range(3)}
    assert len(some) <= 1_000 and of[2] == [52] * 52 and min(len(of[0]), len(of[1])) > 380
    assert set(of[0]) == {5_000} and set(of[1]) == {600}


def test_greatest_keys(spark):
    draw = random.Random(6)
    values = [draw.gauss(0, 1) for _ in range(500)] + [0.25] * 20
    keyed = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 17, 260, 520):
        assert quality_classifier.greatest_keys(keyed, "key", k) == sorted(values, reverse=True)[k - 1]


# --- tool calls


def test_text_behind_the_arguments_is_an_error(spark):
    texts = {
        "plain": '{"x":1}', "blank": ' {"x":1} \n', "two": '{"x":1} {"x":2}', "comma": '{"x":1},{"x":2}', "list": '{"x":1}] [',
        "object": '{"x":1},"b":{"x":2}', "closed": '{"x":1}} {', "open": '{"x":1', "twice": '{"x":1,"x":2}', "number": '{"x":1.50}',
    }
    rows = [(1, k, None, None, "t", v) for k, v in texts.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, parent_id string, seq long, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, call_id string, seq long, content string")
    found = {r.call_id: r for r in tool_calls.link_calls(calls, results, {"t": {"x": ("number", True, None, None)}}).collect()}
    good = {"plain", "blank", "number"}
    assert {k for k, r in found.items() if r.status == "pending"} == good
    assert all(found[k].errors == "not a JSON object" for k in texts if k not in good)
    assert json.loads(found["two"].json)["arguments"] == texts["two"]
    assert found["number"].json.startswith('{"arguments":{"x":1.5},') and found["plain"].seq is None


def test_tool_calls_by_hand(spark):
    schemas = {"add": {"x": ("integer", True, 0, 9), "note": ("string", False, None, None), "by": ("number", False, None, None)}}
    calls = [
        (1, "a", None, 5, "add", '{"x": 3, "note": "n\\"1"}'),
        (1, "b", "a", 1, "add", '{"x": 12}'),
        (1, "c", "b", 0, "add", '{"note": 4, "z": [1, {"q": 2, "p": 1}]}'),
        (1, "c", None, 9, "add", '{"x": 1}'),
        (1, "d", "e", 2, "add", '{"x": 1, "by": 1.5}'),
        (1, "e", "d", 3, "add", '{"x": 1}'),
        (1, "f", "missing", 4, "other", "not json"),
        (1, "g", None, 4, "add", None),
        (None, "a", None, 0, "add", '{"x": 1}'),
        (2, None, None, 0, "add", '{"x": 1}'),
    ]
    results = [(1, "a", 2, "late"), (1, "a", 1, "early"), (1, "b", 1, None), (7, "z", 0, "alone"), (None, "a", 1, "null conv")]
    calls = spark.createDataFrame([c + (1,) for c in calls], "conv_id long, call_id string, parent_id string, seq long, name string, arguments string, depth int")
    results = spark.createDataFrame(results, "conv_id long, call_id string, seq long, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert len(got) == 9
    assert (got[1, "a"].depth, got[1, "b"].depth, got[1, "c"].depth) == (0, 1, 2)
    assert {k[1]: r.status for k, r in got.items() if k[0] == 1} == {"a": "ok", "b": "invalid", "c": "invalid", "d": "cycle", "e": "cycle", "f": "invalid", "g": "invalid"}
    assert got[1, "b"].errors == "range x" and got[1, "c"].errors == "missing x; type note; unknown z"
    assert got[1, "c"].n_calls == 2 and got[1, "a"].n_results == 2
    assert got[1, "a"].json == '{"arguments":{"note":"n\\"1","x":3},"call_id":"a","name":"add","parent":null,"result":"early"}'
    assert json.loads(got[1, "c"].json)["arguments"] == {"note": 4, "z": [1, {"p": 1, "q": 2}]}
    assert '"z":[1,{"p":1,"q":2}]' in got[1, "c"].json
    assert json.loads(got[1, "f"].json)["arguments"] == "not json" and json.loads(got[1, "g"].json)["arguments"] is None
    assert got[7, "z"].status == "orphan" and got[None, "a"].status == "ok"
    assert tool_calls.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_long_chains_of_calls(spark):
    rows = [(1, f"c{i}", f"c{i - 1}" if i else None, 0, "t", "{}") for i in range(70)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, parent_id string, seq long, name string, arguments string")
    assert {r.call_id: r.depth for r in tool_calls.depths(calls).collect()} == {f"c{i}": i for i in range(70)}


# --- the registered queries over a whole table


def test_vector_query_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = registry.QUERIES["op3_metric_join"](spark, folder).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == links_brute(rows)


def test_token_queries_against_brute_force(spark, folder):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    words, letters = (Tokenizer.from_file(public_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    files, pieces, start = set(), [], 0
    for doc, text in docs:
        ids = np.array(words.encode(text, add_special_tokens=False).ids + [2], "<u4")
        files.add((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        ids = np.array(letters.encode(text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for piece, length in enumerate(packing.cut_lengths(len(ids))):
            pieces.append((doc, piece, at, length, zlib.crc32(ids[at : at + length].tobytes())))
            at += length
    got = registry.QUERIES["op8_token_files"](spark, folder).collect()
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got} == files
    got = registry.QUERIES["op6_best_fit_packing"](spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    assert check_sequences(got) <= packing.lower_bound(np.array([p[3] for p in pieces])) + 1


def test_mixing_and_sampling_queries(spark, folder):
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    times = Counter((r.doc_id, r.source) for r in registry.QUERIES["op4_source_mixing"](spark, folder).collect())
    assert dict(times.keys()) == docs and set(times.values()) <= {1, 2}
    kept = [r.doc_id for r in registry.QUERIES["op7_quality_classifier"](spark, folder).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(docs)
