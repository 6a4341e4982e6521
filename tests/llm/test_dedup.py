import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from halfstep.llm import common
from halfstep.llm import exact_dedup as E
from halfstep.llm import jaccard_join as J
from halfstep.llm.components import components
from halfstep.llm.exact_dedup import drop_exact, exact_groups

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, n=4):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def by_brute_force(rows, percent=85, of=None):
    """Component of each row, by all pairs."""
    sets = [(of or shingles)(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        least[find(k)].append(d)
    return [(d, len(s), min((x for x in least[find(k)] if x is not None), default=None)) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_exact_groups(docs):
    rows = [(r["doc_id"], (r["text"] or "").translate(LOW)) for r in docs.collect()]
    members = defaultdict(list)
    for d, t in rows:
        members[t].append(d)
    got = exact_groups(docs, digest=True).collect()
    assert len(got) == len(rows)
    best = {t: max((d for d in m if d is not None), default=None) for t, m in members.items()}
    want = sorted(((d, best[t], len(members[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(members) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drop_exact_keeps_one_row_of_each_text(docs, clashing):
    kept = drop_exact(docs).collect()
    texts = [(r["text"] or "").translate(LOW) for r in kept]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "").translate(LOW) for r in docs.collect()})
    other = drop_exact(clashing)
    assert other.columns == clashing.columns and other.count() == len(kept)
    assert sorted(map(str, exact_groups(clashing).collect())) == sorted(map(str, exact_groups(docs).collect()))


def test_exact_of_nothing(empty):
    assert exact_groups(empty, digest=True).count() == 0 and drop_exact(empty).count() == 0


def test_a_shuffled_join_gives_the_same(docs, monkeypatch):
    want = sorted(map(str, exact_groups(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, exact_groups(docs).collect())) == want
    assert drop_exact(docs).count() == len({(r["text"] or "").translate(LOW) for r in docs.collect()})


def test_levels_leave_only_rows_that_have_a_twin(spark):
    rows = [(1, "aaa"), (2, "bbbb"), (3, "cccc"), (4, "x" * 70 + "1"), (5, "x" * 70 + "2"), (6, "X" * 70 + "1"), (7, None), (8, "")]
    hashed = {r["doc_id"] for r in E.refined(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["_sha"] is not None}
    assert hashed == {4, 5, 6, 7, 8}  # 1 has no other of its length, 2 and 3 no other of their prefix


def test_filters_never_lose_a_key(spark):
    df = spark.range(5000)
    marks = common.cut(common.bitmaps(df.filter("id % 3 = 0"), "id"))
    got = common.with_maybe(df, marks, "m", "id").collect()
    assert len(got) == 5000 and all(r["m"] for r in got if r["id"] % 3 == 0) and sum(r["m"] for r in got) < 1700


@pytest.mark.parametrize("rows_in_block", [4096, 3])
def test_components_by_brute_force(docs, monkeypatch, rows_in_block):
    monkeypatch.setattr(J, "BLOCK_ROWS", rows_in_block)
    monkeypatch.setattr(J, "TREE_ROWS", rows_in_block)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs).collect()]
    assert sorted(got, key=key) == sorted(by_brute_force(rows), key=key)


def near_copies(seed, groups=8, copies=30):
    """Groups of near copies with edits at different rates, a passage that all share, and texts of few words."""
    r = random.Random(seed)
    passage, out = [f"p{k}" for k in range(60)], []
    for g in range(groups):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(30, 300))]
        for _ in range(copies):
            t = list(base)
            for _ in range(int(len(t) * r.choice((0, 0.005, 0.01, 0.02, 0.04)))):
                t[r.randrange(len(t))] = f"e{r.randrange(9999)}"
            out.append(" ".join(t + (passage if g % 3 == 0 else [])))
    out += [" ".join(f"w{k}" for k in range(n)) for n in (1, 2, 3, 4, 5)] * 2
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("rows_in_block,most,broadcast", [(4096, 1_000_000, 200_000), (7, 1_000_000, 200_000), (5, 4, 0)])
def test_near_copies_by_brute_force(spark, monkeypatch, rows_in_block, most, broadcast):
    """Groups in one block, in many blocks, and with every shingle salted and all joins shuffled."""
    monkeypatch.setattr(J, "BLOCK_ROWS", rows_in_block)
    monkeypatch.setattr(J, "TREE_ROWS", rows_in_block)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(J, "HOT", most)
    monkeypatch.setattr(J, "LONG", {4096: 512, 7: 80, 5: 3}[rows_in_block])
    rows = near_copies(rows_in_block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs).collect()]
    want = by_brute_force(rows)
    assert sorted(got) == sorted(want) and len({c for _, _, c in want}) > 20
    kept = [r["doc_id"] for r in J.drop_near(docs).collect()]
    assert sorted(kept) == sorted({c for _, n, c in want})


def test_near_of_nothing_and_of_empty_texts(spark, empty, docs):
    assert J.jaccard_components(empty).count() == 0
    bare = docs.filter("text is null or trim(text) = ''")
    assert {(r["doc_id"], r["component_id"]) for r in J.jaccard_components(bare).collect()} == {(r["doc_id"], r["doc_id"]) for r in bare.collect()}


def test_drop_near_keeps_repeated_rows_once(docs, clashing):
    left = J.drop_near(docs).collect()
    want = by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(left) == len({c for _, n, c in want if n}) + sum(1 for _, n, _ in want if not n)
    other = J.drop_near(clashing)
    assert other.columns == clashing.columns and other.count() == len(left)


def test_shingle_hashes_tell_sets_apart():
    texts = ["a b c d e", "A  b\tC d\ne", "a b c", "a b", "a  b c ", "", " ", "é é é é", "ab c d e", "a bc d e", None, "a b c d e a b c d"]
    sets = J.shingle_sets(texts)
    for i, s in enumerate(sets):
        assert len(s) == len(shingles(texts[i]))
        for j, t in enumerate(sets):
            assert (s.tolist() == t.tolist()) == (shingles(texts[i]) == shingles(texts[j]))
            assert len(set(s.tolist()) & set(t.tolist())) == len(shingles(texts[i]) & shingles(texts[j]))


def morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_polynomial_hashes_confuse():
    a = morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    hashes, upto = J.word_hashes([f"{a} {b}", None, "A b\tabcdefgh abcdefghi", "a"])
    assert len(set(hashes.tolist())) == 6 and hashes[2] == hashes[6] and upto.tolist() == [0, 2, 2, 6, 7]
    one, other = J.shingle_sets([f"x y {a} z", f"x y {b} z"])
    assert not set(one.tolist()) & set(other.tolist())


def sets_of_groups(seed, groups=12, copies=25):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = np.unique(r.integers(0, 1 << 63, int(r.integers(40, 400)), dtype=np.uint64))
        for _ in range(copies):
            keep = base[r.random(len(base)) > r.choice([0, 0.02, 0.06, 0.1])]
            out.append(np.unique(np.concatenate([keep, r.integers(0, 1 << 63, int(len(base) * r.choice([0, 0.02, 0.06])), dtype=np.uint64)])))
    return out


def roots_of(count, links):
    root = list(range(count))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if z in (x, y) else z for z in root]
    return root


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_token(percent):
    """Sets of sizes about the intervals' ends, as unlike as links allow."""
    r = np.random.default_rng(percent)
    often = np.ones(J.BUCKETS, np.int64)
    edges = J.intervals(40, percent).tolist()
    linked = 0
    for n in [*range(20, 60), *(e + d for e in edges[1:9] for d in (-2, -1, 0, 1)), 3000]:
        for _ in range(4):
            m = int(r.integers(n, n * 100 // percent + 1))
            both = -(-percent * (n + m) // (100 + percent))
            if both > n:
                continue
            every = np.unique(r.integers(0, 1 << 63, n + m - both, dtype=np.uint64) << np.uint64(1))
            every = r.permutation(every)
            a, b = np.sort(every[:n]), np.sort(np.concatenate([every[:both], every[n:]]))
            assert 100 * both >= percent * (len(a) + len(b) - both)
            linked += 1
            assert set(J.tokens_of(a, often, 40, percent).tolist()) & set(J.tokens_of(b, often, 40, percent).tolist()), (n, m)
    assert linked > 200


@pytest.mark.parametrize("sided", [False, True])
def test_a_block_gives_all_components(sided):
    sets = sets_of_groups(int(sided))
    n = len(sets)
    side = np.arange(n) % 2 if sided else np.full(n, 2)
    lot = J.Lot.of_sets(sets, np.arange(n), np.arange(n), side)
    lot.large_block(np.arange(n))

    def linked(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)

    want = roots_of(n, [(j, i) for i in range(n) for j in range(i) if (not sided or i % 2 != j % 2) and linked(i, j)])
    assert roots_of(n, lot.links) == want and all(linked(i, j) for i, j in lot.links)
    assert len(lot.links) == n - len(set(want)) and 12 < len(set(want)) < n // 2
    small = J.Lot.of_sets(sets[:30], np.arange(30), np.arange(30), side[:30])
    small.small_blocks(np.arange(30), np.arange(30))
    assert len(small.links) == len([x for x in lot.links if max(x) < 30]) or roots_of(30, small.links) == roots_of(30, [(j, i) for i in range(30) for j in range(i) if (not sided or i % 2 != j % 2) and linked(i, j)])


def test_the_bound_alone_joins_all_that_links_would():
    sets = sets_of_groups(5)
    n = len(sets)
    points = np.stack([J.point(s, J.GROUPS) for s in sets])
    lot = J.Lot(np.array([len(s) for s in sets]), points, np.arange(n), np.arange(n), np.full(n, 2))
    lot.large_block(np.arange(n), np.array([int(s.min() >> np.uint64(1)) for s in sets]))
    allowed = [(j, i) for i in range(n) for j in range(i) if 100 * min(lot.n[i], lot.n[j]) >= 85 * max(lot.n[i], lot.n[j]) and np.minimum(points[i], points[j]).sum() >= J.needed(lot.n[i], lot.n[j])]
    assert roots_of(n, lot.links) == roots_of(n, allowed) and 12 <= len(set(roots_of(n, allowed))) < n


@pytest.mark.parametrize("percent,seed", [(85, 1), (80, 2)])
def test_ranges_of_coordinates_lose_no_pair_that_the_bound_allows(monkeypatch, percent, seed):
    """Blocks over SPLIT rows against all pairs, by the bound alone and verified on sets, with sizes about intervals' ends."""
    monkeypatch.setattr(J, "SPLIT", 20)
    r = np.random.default_rng(seed)
    sets = sets_of_groups(seed, 10, 20)
    for n in (1, 2, 3, 5, 6, 7, 8, 13, 14, 40, 47, 48, 100, 117, 118):
        base = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        for _ in range(6):
            keep = base[r.random(len(base)) > r.choice([0, 0.05, 0.1])]
            sets.append(np.unique(np.concatenate([keep if len(keep) else base, r.integers(0, 1 << 63, n // 12, dtype=np.uint64) << np.uint64(1)])))
    n = len(sets)
    sizes, points = np.array([len(s) for s in sets]), np.stack([J.point(s, J.GROUPS) for s in sets])
    near = np.minimum(points[:, None], points[None]).sum(-1)
    fit = percent * np.maximum.outer(sizes, sizes) <= 100 * np.minimum.outer(sizes, sizes)
    allowed = np.argwhere(np.triu(fit & (near >= J.needed(sizes[:, None], sizes[None], percent)), 1)).tolist()
    lot = J.Lot(sizes, points, np.arange(n), np.arange(n), np.full(n, 2), percent=percent)
    lot.large_block(np.arange(n), np.array([int(s.min() >> np.uint64(1)) for s in sets]))
    assert roots_of(n, lot.links) == roots_of(n, allowed)
    whole = J.Lot.of_sets(sets, np.arange(n), np.arange(n), np.full(n, 2), percent)
    whole.large_block(np.arange(n))
    both = [(i, j, len(np.intersect1d(sets[i], sets[j]))) for i, j in allowed]
    linked = [(i, j) for i, j, k in both if 100 * k >= percent * (sizes[i] + sizes[j] - k)]
    assert roots_of(n, whole.links) == roots_of(n, linked) and len(linked) > 500


def test_unlike_texts_with_a_common_shingle_seldom_meet(monkeypatch):
    """Points compared for each text, when their number doubles: far fewer than all pairs."""
    looked = [0]

    def counted(p, q, of=J.bounded):
        looked[0] += len(p)
        return of(p, q)

    monkeypatch.setattr(J, "bounded", counted)
    for rows in (4096, 8192):
        r = np.random.default_rng(rows)
        sets = [np.unique(np.append(r.integers(0, 1 << 63, 99, dtype=np.uint64) << np.uint64(1), np.uint64(12345))) for _ in range(rows)]
        lot = J.Lot(np.array([len(s) for s in sets]), np.stack([J.point(s, J.GROUPS) for s in sets]).astype(np.uint8), np.arange(rows), np.arange(rows), np.full(rows, 2))
        looked[0] = 0
        lot.large_block(np.arange(rows), np.array([int(s[-1] >> np.uint64(1)) for s in sets]))
        assert not lot.links and looked[0] < rows * rows / 2 / 15


def test_filters_grow_with_their_keys(spark, monkeypatch):
    """Beyond the least size a filter has bits by its keys, so few other rows pass; rows go the same way whatever its size."""
    monkeypatch.setattr(common, "BITS", 1 << 16)
    assert common.bits_for(0) == 1 << 16 and common.bits_for(5000) == 1 << 18 and common.bits_for(10**10) == common.MOST_BITS
    df, bits = spark.range(20_000), common.bits_for(5000)
    marks = common.cut(common.bitmaps(df.filter("id % 4 = 0"), "id", bits=bits))
    got = common.with_maybe(df, marks, "m", "id", bits=bits).collect()
    assert all(r["m"] for r in got if r["id"] % 4 == 0) and sum(r["m"] for r in got if r["id"] % 4) < 15_000 / 25
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    lost = df.filter("id % 4 = 0").select(F.col("id").alias("_key"), F.col("id").alias("_id"))
    left = common.drop_rows(df.withColumn("text", F.lit("t")), F.col("id"), "id", lost, lost.limit(0))
    assert sorted(r["id"] for r in left.collect()) == [k for k in range(20_000) if k % 4]


def test_what_is_verified_and_written_grows_with_the_copies():
    """Groups of near copies: links one fewer than copies, and pairs looked at in proportion to them."""
    looked = []
    for copies in (50, 100, 200, 400):
        r = np.random.default_rng(copies)
        base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        sets = [np.unique(np.concatenate([np.delete(base, r.integers(0, 300, 6)), r.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(copies)]
        lot = J.Lot.of_sets(sets, np.arange(copies), np.arange(copies), np.full(copies, 2))
        lot.large_block(np.arange(copies))
        assert len(lot.links) == copies - 1
        looked.append(lot.verified / copies)
    assert max(looked) < 2 * looked[0] + 2


def test_long_chains_are_one_component(spark):
    links = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(5000, 5001), (5001, 5002)], "a long, b long")).repartition(5)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 3001)}, 5001: 5000, 5002: 5000}
    assert components(links.limit(0)).count() == 0


def test_the_near_stage_links_from_four_fifths_of_five_word_shingles(spark, monkeypatch):
    """Pairs between 0.80 and 0.85, and some below, against all pairs."""
    stage = pytest.importorskip("corpus_pipeline").near_dedup
    rows = []
    for g, (n, more, changes) in enumerate([(500, 90, 0), (500, 120, 0), (500, 130, 0), (600, 0, 12), (600, 0, 13), (600, 0, 16), (100, 20, 0), (100, 25, 0)]):
        base = [f"g{g}w{k}" for k in range(n)]
        other = base + [f"g{g}m{k}" for k in range(more)]
        for k in range(changes):
            other[20 + k * (n - 40) // changes] = f"g{g}c{k}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setitem(globals(), "shingles", lambda text, n=5, of=shingles: of(text, n))
    want = by_brute_force(rows, 80)
    linked = {d // 2 for d, _, c in want if d != c}
    assert 3 <= len(linked) < 8 and len(linked) > len({d // 2 for d, _, c in by_brute_force(rows, 85) if d != c})
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == sorted({c for _, _, c in want})
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs, words=5, percent=80).collect()]
    assert sorted(got) == sorted(want)
