"""SuperMinHash signatures, and near-duplicate groups against all pairs."""

import numpy as np
from test_dedup import by_brute_force, key, shingles

from halfstep.llm import jaccard_join as J
from halfstep.llm import superminhash as S


def running(seed, n):
    return [f"w{k}" for k in np.random.default_rng(seed).integers(0, 5000, n)]


def plain_signature(elements, slots):
    """One element after another, one step after another."""
    out = [None] * slots
    for e in elements:
        places = list(range(slots))
        for step in range(slots):
            a, b = (int(S.mixed(np.array([e], np.uint64) ^ S.mixed(np.full(1, 2 * step + k, np.uint64)))[0]) for k in (1, 2))
            pick = step + ((b >> 32) * (slots - step) >> 32)
            places[step], places[pick] = places[pick], places[step]
            value = step << 56 | a >> 8
            if out[places[step]] is None or value < out[places[step]]:
                out[places[step]] = value
    return out


def test_signatures_equal_those_made_step_by_step():
    r = np.random.default_rng(3)
    sets = [r.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300)]
    assert S.signatures(sets, 24).tolist() == [plain_signature(s.tolist(), 24) for s in sets]
    assert S.signatures([], 24).shape == (0, 24)


def test_slots_agree_as_often_as_sets_are_alike():
    r = np.random.default_rng(4)
    for n in (30, 200, 2000):
        pairs = []
        for _ in range(60):
            base = r.integers(0, 1 << 63, n).astype(np.uint64)
            other = base.copy()
            other[: n // 10] = r.integers(0, 1 << 63, n // 10)
            pairs += [base, other]
        sig = S.digests(S.signatures(pairs))
        agree = (sig[::2] == sig[1::2]).sum(1)
        alike = (n - n // 10) / (n + n // 10)
        assert abs(agree.mean() / S.SLOTS - alike) < 0.02 and agree.min() > S.ALIKE
        assert np.all((S.band_keys(sig[::2]) == S.band_keys(sig[1::2])).sum(1) > 0)


def test_rows_join_over_links_and_sides():
    r = np.random.default_rng(5)
    a, b = (r.integers(0, 1 << 16, S.SLOTS).astype(np.uint16) for _ in range(2))
    middle = np.where(np.arange(S.SLOTS) < 140, a, b)
    other = np.where(np.arange(S.SLOTS) < 60, a, b)
    rows = np.stack([a, middle, other, r.integers(0, 1 << 16, S.SLOTS).astype(np.uint16)])
    assert len(S.joined(rows, np.arange(4), np.full(4, 2))) == 1  # a and middle; middle and other agree in 120
    assert S.joined(rows, np.array([0, 0, 2, 3]), np.full(4, 2)) == []
    assert S.joined(rows, np.arange(4), np.array([0, 0, 1, 1])) == []
    assert len(S.joined(np.stack([a] * 50), np.arange(50), np.full(50, 2))) == 49


def group_rows(n=60):
    base, out = running(5, 400), []
    for k in range(n):
        at = 7 * k % 390
        out.append((k, " ".join([*base[:at], f"own{k}", *base[at + 1 :]])))
    passage = running(6, 120)
    out += [(1000 + k, " ".join([*running(100 + k, 130), *passage, *running(300 + k, 130)])) for k in range(30)]
    return out


def test_groups_equal_brute_force(spark, docs, clashing, empty, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + group_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(((*r, r[0] == r[2]) for r in by_brute_force(rows, 85, lambda t: shingles(t, 3))), key=key)
    assert sorted(map(tuple, S.near_components(df).collect()), key=key) == want
    assert sum(not r[3] for r in want) > 60
    monkeypatch.setattr(S, "GROUP_ROWS", 8)  # groups dealt into blocks
    monkeypatch.setattr(S, "BLOCK_ROWS", 8)
    assert sorted(map(tuple, S.near_components(df).collect()), key=key) == want
    monkeypatch.undo()
    assert S.near_components(empty).count() == 0
    assert S.near_components(clashing).count() == docs.count() and J.WORDS == 4
