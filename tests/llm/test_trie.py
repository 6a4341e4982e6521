"""The prefix trie against one made of tuples."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from halfstep.llm import prefix_trie as P

SCHEMA = "conv_id long, turn int, role string, text string"


def given():
    """Shared and own turns, null and repeated turns, missing neighbours, and long conversations."""
    out = []
    for c in range(60):
        if c in (10, 25):
            continue
        for k in range(c % 7 + (c % 11 == 0) * 9):
            out.append((c, k, ("user", "assistant", None)[k % 3], None if (c + k) % 13 == 0 else f"t{k}" if c % 3 else f"own {c} {k} é"))
    out += [(7, None, "system", "before"), (12, 1, "user", "tie"), (12, 1, "user", "tie"), (None, 0, "user", "lost"), (-3, 0, "user", "minus")]
    for c in (100, 101, 105):
        out += [(c, k, "user", f"long {k}") for k in range(40)]
    out += [(c, 0, "user", "hot") for c in range(200, 300)]
    return out


def brute_force(rows, whole=False):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        base = c - int(c - 5 * int(c / 5)) if c < 0 else c - c % 5
        h = 0 if base == c or whole else zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * (len(path[-1][1].encode()) if path else 0)
    return sorted(((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path], leaves[path], saved[path], hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == path).encode()).hexdigest()) for path, m in members.items()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("most, block, ids", [(P.MOST_CELLS, P.BLOCK, P.IDS), (1024, 4, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, most, block, ids):
    """Also with sketches so small that prefixes are dealt into slices and most estimates are too high."""
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "IDS", ids)
    df = spark.createDataFrame(given(), SCHEMA).repartition(3)
    rows, convs = P.rebuilt(P.cut(P.turns(df)))
    assert rows_of(P.trie(rows, convs, most)) == brute_force(given())


def test_conversations_as_they_are(spark):
    df = spark.createDataFrame(given(), SCHEMA)
    rows = P.cut(P.plain(P.cut(P.turns(df))))
    assert rows_of(P.trie(rows, rows.select("conv", "length").distinct())) == brute_force(given(), True)


def test_turnless_single_and_no_conversations(spark):
    for some in ([], [(1, 0, "user", "a")], [(3, 0, "u", "a"), (4, 0, "u", "a")], [(0, 0, None, None)], [(None, 1, "u", "x")]):
        rows, convs = P.rebuilt(P.cut(P.turns(spark.createDataFrame(some, SCHEMA))))
        assert rows_of(P.trie(rows, convs)) == brute_force(some)


def test_sketches_are_never_too_low(spark):
    df = spark.range(3000).selectExpr("xxhash64(id % 2000) as d1", "xxhash64(id % 2000, 7) as d2")
    bits = P.sketch(df.repartition(5), 1 << 16)
    for k, c in enumerate(("d1", "d2")):
        at = P._cell(df.toPandas()[c].to_numpy()[:1000], k, 1 << 16)
        assert ((bits[at >> 3] >> (at & 7).astype("uint8")) & 1).all()  # those that occur twice
