import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from ebbtide.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"


def spoil(rows):
    """The damage, in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        said = [" " if v is None else v for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def kinds(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = text.strip(WHITE)
        kind = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def regular(turns):
    return re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r else "-" for r, _ in turns)) is not None


def every_repair(rows, faults):
    """All edits of a short conversation, with up to two insertions at each place."""
    here = []
    for (_, _, role, text), kind in zip(rows, faults):
        own = [(4, "D", None)]
        if kind in ("", "truncated"):
            extra = 3 * (kind == "truncated")
            own += [(extra, "K", (role, text))] + [(3 + extra, "R", (r, text)) for r in ("user", "assistant")]
        here.append(own)
    added = [[()], [("user",)], [("assistant",)], [("user", "assistant")], [("assistant", "user")]]
    added = [a[0] for a in added]
    for edits in itertools.product(*here):
        for gaps in itertools.product(added, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i, gap in enumerate(gaps):
                cost, audit = cost + 3 * len(gap), audit + "I" * len(gap)
                turns += [(r, "") for r in gap]
                if i < len(edits):
                    price, letter, turn = edits[i]
                    cost, audit = cost + price, audit + letter
                    turns += [turn] if turn else []
            if regular(turns):
                yield cost, audit, turns


def cheapest(rows, faults):
    """Uniform-cost search over (rows done, last initial)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(turns)
        for role in ("user", "assistant"):
            if (state, role[0]) in after:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*turns, (role, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, turns))
            if faults[i] in ("", "truncated"):
                extra = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in after:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, after[state, role[:1]], (*turns, (role, text))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in after:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, new[0], (*turns, (new, text))))


def by_turn(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def brute(rows, solve=cheapest, spoiled=True):
    said = spoil(rows) if spoiled else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    groups = defaultdict(list)
    for row in said:
        groups[row[0]].append(row)
    out = set()
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv], key=by_turn)
        faults = kinds(own)
        turns = {t for _, t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = solve(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        counted = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out.add((conv, gaps, *counted, illegal, cost, audit, digest))
    return out


def results(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(draw, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randrange(1, longest + 1)):
            text = draw.choice(["Yes.", "No!", "Why?", "cut", "cut off ", " \t", "", None, "Well.\n", "é ", "a.b"])
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 2, None, 0]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_search_of_the_tests_equals_all_edits():
    """The check itself is checked: uniform-cost search against every edit of short conversations."""
    draw = random.Random(5)
    for _ in range(25):
        rows = sorted((r for r in brute_rows(draw)), key=by_turn)
        faults = kinds(rows)
        cost, audit, turns = min(every_repair(rows, faults), key=lambda e: e[:2])
        assert cheapest(rows, faults) == (cost, audit, turns)


def brute_rows(draw):
    return [(0, t, r or " ", x or " ") for _, t, r, x in made_up(draw, 1, 3)]


def test_cells_do_not_depend_on_the_split():
    """Interval parsing over every split of every span gives the cells of the balanced one."""
    draw = random.Random(3)
    for _ in range(30):
        rows = [
            draw.choice([(None, False, 1), (None, False, 3), *[(i, t, 1) for i in ("s", "u", "a", "t", "") for t in (False, True)]])
            for _ in range(draw.randrange(1, 9))
        ]
        n = len(rows)
        table = {(i, i + 1): cr.leaf(*rows[i]) for i in range(n)}
        for length in range(2, n + 1):
            for i in range(n - length + 1):
                cells = {}
                for k in range(i + 1, i + length):
                    for key, new in cr.combine(table[i, k], table[k, i + length]).items():
                        cells[key] = min(cells.get(key, new), new)
                table[i, i + length] = cells
        assert table[0, n] == cr.parse(rows)


def test_repair_against_search(spark):
    rows = made_up(random.Random(1), 400, 9)
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Ho.")]
    rows += [(900, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(40)] * 3
    frame = spark.createDataFrame([r + (1, "x") for r in rows], f"{SCHEMA}, place long, cells string")
    assert results(cr.repair(frame)) == brute(rows, spoiled=False)
    assert results(cr.repair(cr.damaged(frame))) == brute(rows)


@pytest.mark.parametrize("fan", [2, 64])
def test_long_conversations_over_many_tasks(spark, monkeypatch, fan):
    """Conversations that go on through many parts of the sorted rows, and repeated rows."""
    monkeypatch.setattr(cr, "FAN", fan)
    monkeypatch.setattr(cr, "CHUNK_BYTES", 200)
    draw = random.Random(fan)
    rows = [(1, t, draw.choice(["user", "assistant", "tool"]), draw.choice(["Yes.", "x", "", f"Say {t}."])) for t in range(700)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(500)]
    rows += [(3, 5, "user", "The same.")] * 300 + [(4, None, "user", "cut")] * 20 + [(5, 0, "system", "Only.")]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, SCHEMA)
        assert results(cr.repair(frame)) == brute(rows, spoiled=False)
        assert results(cr.repair(cr.damaged(frame))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_registered_query_against_search(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(cr.op11_conversation_repair(spark, folder)) == brute(rows)


def test_nothing_and_very_long_texts(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert cr.repair(cr.damaged(frame)).count() == 0
    rows = [(7, 1, "user", "word " * 400_000 + "."), (7, 2, "assistant", "." + " " * 100_000), (8, 1, None, None)]
    assert results(cr.repair(spark.createDataFrame(rows, SCHEMA))) == brute(rows, spoiled=False)
