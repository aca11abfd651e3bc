"""The links' convex problem against a dense solver, its rounds and its residual."""

import numpy as np
import pytest

from verbatrix.llm.school_links import AGREE, RESIDUAL, SHARE, around_words, mentions_of, settle

SCHEMA = "mention long, host string, unitid string, pro double, con double"


def cases(seed, mentions=12):
    rng = np.random.default_rng(seed)
    return [(m, f"h{m % 3}", f"s{s}", float(rng.choice([0.5, 1.5, 4.0, 6.0, 8.0])), float(rng.choice([0.3, 1.0, 3.0, 9.0]))) for m in range(mentions) for s in rng.choice(4, rng.integers(1, 4), replace=False)]


def capped(v):
    """The nearest point with no negative part and a sum of at most 1."""
    p = np.maximum(v, 0)
    if p.sum() <= 1:
        return p
    u = np.sort(v)[::-1]
    k = np.nonzero(u * np.arange(1, len(u) + 1) > np.cumsum(u) - 1)[0][-1]
    return np.maximum(v - (np.cumsum(u)[k] - 1) / (k + 1), 0)


def dense(pairs, steps=20_000):
    """Projected gradient over all values at once."""
    first = {(h, s): [] for _, h, s, _, _ in pairs}
    told = {}
    for m, h, s, p, c in pairs:
        first[h, s].append(p / (p + c))
        told.setdefault(h, set()).add(m)
    ties = [k for k, v in first.items() if sum(v) >= SHARE * len(told[k[0]])]
    m, y = np.zeros(len(pairs)), np.zeros(len(ties))
    pro, con = (np.array([r[k] for r in pairs]) for k in (3, 4))
    at = np.array([ties.index((r[1], r[2])) if (r[1], r[2]) in ties else -1 for r in pairs])
    mentions = [[i for i, r in enumerate(pairs) if r[0] == x] for x in {r[0] for r in pairs}]
    hosts = [[i for i, t in enumerate(ties) if t[0] == x] for x in {t[0] for t in ties}]
    for _ in range(steps):
        gap = np.where(at >= 0, m - y[at], 0.0)
        m = m - 0.01 * (con * m - pro * (1 - m) + AGREE * gap)
        y = y + 0.01 * AGREE * np.array([gap[at == i].sum() for i in range(len(ties))])
        for g in mentions:
            m[g] = capped(m[g])
        for g in hosts:
            y[g] = capped(y[g])
    return {(r[0], r[2]): v for r, v in zip(pairs, m)}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_dense_solver(spark, seed):
    pairs = cases(seed)
    values, y, gap = settle(spark.createDataFrame(pairs, SCHEMA))
    got, want = {(r["mention"], r["unitid"]): r["m"] for r in values.collect()}, dense(pairs)
    assert gap <= RESIDUAL and set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 0.03
    by_host = {}
    for r in y.collect():
        by_host[r["host"]] = by_host.get(r["host"], 0) + r["y"]
    assert all(v <= 1 + 1e-6 for v in by_host.values())


def test_rounds_matter(spark):
    # two mentions say s1 weakly, eight of the same host say s2: alone the weak ones would be links
    pairs = [(m, "h", "s1", 1.05, 1.0) for m in range(2)] + [(m, "h", "s2", 9.0, 0.3) for m in range(2, 6)] + [(m, "h", "s1", 1.05, 1.0) for m in range(6, 8)] + [(m, "h", "s2", 0.2, 1.0) for m in (0, 1, 6, 7)]
    df = spark.createDataFrame(pairs, SCHEMA)
    values, _, gap = settle(df)
    got, want = {(r["mention"], r["unitid"]): r["m"] for r in values.collect()}, dense(pairs)
    assert gap <= RESIDUAL and max(abs(got[k] - want[k]) for k in want) < 0.03
    assert 1.05 / 2.05 > 0.5 > got[0, "s1"]  # a link by itself, none beside its host's others
    with pytest.raises(ArithmeticError):
        settle(df, rounds=1)


def test_words_around_names_are_learnt(spark):
    schools = spark.createDataFrame([("1", "Ormvale Quist College"), ("2", "Tarn University")], "unitid string, name string")
    titles = [f"{x} Bugle of the {p}" for x in ("Kell", "Varn", "Dosk", "Brim", "Hollin", "Peth", "Wend", "Zarn", "Quell", "Stave") for p in ("North", "South")] + [f"Ormvale Quist {x}" for x in "abcdefghijklm"] + [f"Tarn {x} Bugle" for x in "abcdefghij"]
    candidates = spark.createDataFrame([(i, f"h{i}.example", t, None) for i, t in enumerate(titles)], "id long, domain string, title string, snippet string")
    learnt = around_words(schools, mentions_of(candidates))
    assert "bugle" in learnt and not {"ormvale", "quist", "tarn"} & learnt
