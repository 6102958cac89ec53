import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from rows import edge_docs, no_docs
from tokenizers import Tokenizer

from ebbtide.llm import harmonic_packing as hp
from ebbtide.llm.tokens import public_path

CAPACITY = 2048


def library_ids(texts):
    own = Tokenizer.from_file(public_path(hp.TOKENIZER))
    return [e.ids + [1] for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def padding(lengths, capacity=CAPACITY):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def check(pieces, docs, capacity=CAPACITY):
    """Every id of every document lies in one piece, sequences are gapless and fit; gives their lengths."""
    pieces = [tuple(p) for p in pieces]
    ids = library_ids([t for _, t in docs])
    want, have = Counter(), Counter()
    by_doc = defaultdict(list)
    for (doc, _), own in zip(docs, ids):
        by_doc[doc].append(own)
    for doc, start, length, crc, tokens, _, _ in pieces:
        assert any(
            len(own) == tokens and zlib.crc32(np.array(own[start : start + length], "<u4").tobytes()) == crc
            for own in by_doc[doc]
        )
        assert 0 < length and start + length <= tokens
        have[doc, tokens] += length
    for (doc, _), own in zip(docs, ids):
        want[doc, len(own)] += len(own)
    assert have == want
    cuts = defaultdict(Counter)
    for doc, start, length, _, tokens, _, _ in pieces:
        cuts[doc, tokens][start] += 1
        cuts[doc, tokens][start + length] -= 1
    for (doc, tokens), ends in cuts.items():  # pieces of a document follow one another
        assert {k: v for k, v in ends.items() if v} == {0: ends[0], tokens: -ends[0]}
    sequences = defaultdict(list)
    for *_, length, _, _, sequence, offset in [(p[2], p[3], p[4], p[5], p[6]) for p in pieces]:
        sequences[sequence].append((offset, length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in own) for own in sequences.values()]


def test_plan_is_the_cheapest_of_all():
    """Against the same minimum over every head, by recursion, for a small capacity."""
    capacity, price = 48, 3

    def spare(s):
        return (capacity - capacity // s * s) / (capacity // s)

    best = {0: 0.0}
    for n in range(1, capacity):
        best[n] = min([spare(n)] + [price + spare(capacity // k) + best[n - capacity // k] for k in range(2, 49) if capacity // k < n])
    for n in range(1, capacity):
        plan = hp.cut_plan(capacity, price)[n]
        assert sum(plan) == n and min(plan) > 0
        assert sum(map(spare, plan)) + price * (len(plan) - 1) == pytest.approx(best[n])
    assert hp.piece_lengths(5 * capacity, capacity, price) == (capacity,) * 5


def bins_of(lengths):
    bins = hp._Bins(CAPACITY, 0)
    for i, n in enumerate(lengths):
        ids = np.full(n, i, "<u4").tobytes()
        bins.add((i, 0, n, zlib.crc32(ids), n, ids))
    return bins


def test_bins_hold_a_fixed_number_of_a_class():
    draw = random.Random(1)
    lengths = [draw.randrange(1, CAPACITY + 1) for _ in range(3000)]
    bins = bins_of(lengths)
    own = defaultdict(list)
    for row in bins.rows:
        own[row[5]].append(row[2])
    for pieces in own.values():
        assert {CAPACITY // n for n in pieces} == {len(pieces)}
    assert all(len(ps) < count for count, ps in bins.open.items())
    assert sum(p[2] for ps in bins.open.values() for p in ps) < 90 * CAPACITY


def test_chain_wastes_nothing():
    bins = bins_of([700, 33, 33, 1500 // 2, 5, 1])
    placed = len(bins.rows)
    bins.chain()
    rows = bins.rows[placed:]
    sums = Counter()
    for row in rows:
        sums[row[5]] += row[2]
    assert padding(sums.values()) == 0 and not bins.open
    assert isinstance(bins.leave(0), pa.RecordBatch)


@pytest.mark.parametrize("fan", [2, 64])
def test_edge_rows(spark, monkeypatch, fan):
    monkeypatch.setattr(hp, "FAN", fan)
    docs = edge_docs(spark).repartition(7)
    lengths = check(hp.pack_harmonic(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert padding(lengths) <= 0.01 * sum(lengths)
    assert hp.pack_harmonic(no_docs(spark)).count() == 0


def test_registered_query_covers_all_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    lengths = check(hp.op13_harmonic_packing(spark, folder).collect(), [tuple(d) for d in docs])
    assert padding(lengths) <= 0.005 * sum(lengths)
