"""Mixing, hard negatives and clusters against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import random

import numpy as np
import pytest

DOCS = "doc_id long, text string, source string, size string, target string, no_source string"
VECTORS = "vec_id long, embedding array<double>, label int, row_ string, vec string, chunk string"


# ---- mixing


def targets(sizes, most=3):
    """By the rule: share, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return held | share
        held |= {s: float(most * sizes[s]) for s in over}


def test_mix_reaches_its_targets_and_repeats_itself(spark):
    from ledgerline.llm.mixing import mix

    random.seed(3)
    rows = [(i, "w " * random.randint(0, 60), random.choice(["big"] * 6 + ["a", "é", "z", None]), "x", "y", "z") for i in range(900)]
    rows += [(7, "same words here", "big", "x", "y", "z")] * 2600  # one row over and over, more than one run of copies
    rows += [(None, None, None, "x", "y", "z"), (None, "", "a", "x", "y", "z"), (5000, "long " * 300_000, "big", "x", "y", "z"), (5001, None, "nothing", "x", "y", "z")]
    df = spark.createDataFrame(rows, DOCS)
    got = mix(df).collect()
    words = lambda t: len((t or "").split())
    assert collections.Counter((r["doc_id"], r["size"], r["source"]) for r in got) == collections.Counter((r[0], words(r[1]), r[2]) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += words(r[1])
    want = targets(sizes)
    assert any(v == 3 * sizes[s] > 0 for s, v in want.items()) and want["nothing"] == 0
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    # Whole epochs for all, one more for some, and one document on the cut for each source.
    for s in sizes:
        own = [r for r in got if r["source"] == s and r["size"]]
        assert sum(r["taken"] % r["size"] > 0 for r in own) <= 1
        assert not own or max(r["taken"] // r["size"] for r in own) - min(r["taken"] // r["size"] for r in own) <= 1
    again = mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix(df.limit(0)).collect() == []


def test_mix_of_many_sources_and_ranges(spark):
    from ledgerline.llm.mixing import mix

    rows = [(i, "a " * (i % 5), f"s{i % 400:03d}" if i % 3 else "hot", "", "", "") for i in range(9000)]  # more than one range of keys
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = targets(sizes)
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_mixing_runs_without_python(spark):
    from ledgerline.llm.mixing import mix

    plan = mix(spark.createDataFrame([(1, "a", "s", "", "", "")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- hard negatives


def hard(rows, every=100):
    """By the rule, in whole numbers."""
    kept = []
    for r in rows:
        if r[0] is None or r[2] is None or r[1] is None or any(x is None or not np.isfinite(x) for x in r[1]):
            continue
        kept.append((r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], [int(np.floor(256 * x)) for x in r[1]]))
    out = []
    for i, (anchor, label, q) in enumerate(kept):
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), v_id, j) for j, (v_id, _, v) in enumerate(kept) if j != i and len(v) == len(q))
        for s, positive, _ in [x for x in scored if kept[x[2]][1] == label][:5]:
            fit = [x for x in scored if kept[x[2]][1] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(anchor, positive, n, x[1], -s, -x[0]) for n, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_hard_negatives_equal_the_rule(spark, dim):
    from pyspark.sql import functions as F

    from ledgerline.llm.negatives import hard_negatives

    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(10, dim))
    rows = []
    for i in range(420):
        label = int(rng.integers(0, 10)) if i % 3 else 1  # one label holds a third
        rows.append((i, (0.4 * centres[label] + 0.3 * rng.normal(size=dim)).round(2).tolist(), label, "r", "v", "c"))
    rows += [rows[100], rows[101]] + [(1000 + i, rows[5][1], 1 + i % 2, "r", "v", "c") for i in range(30)]  # an anchor twice, ties
    rows += [(2000, None, 1, "", "", ""), (2100, [None] * dim, 1, "", "", ""), (2200, [float("nan")] * dim, 1, "", "", ""), (2300, rows[0][1], None, "", "", ""), (None, rows[0][1], 1, "", "", "")]
    rows += [(2400, [0.0] * dim, 1, "", "", ""), (2500, [1.0, 2.0], 1, "", "", ""), (2600, [], 1, "", "", "")]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 100 == 0, block=90, chunk=3).collect())
    assert got == hard(rows) and len(got) > 50
    assert hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_code_intervals_hold_every_score():
    from ledgerline.llm.negatives import Asked, coded, survivors

    rng = np.random.default_rng(5)
    for dim in (1, 2, 7, 64, 130):
        x = rng.integers(-300, 300, (200, dim))
        x[:20] = 0
        code, along, left = coded(x, 6)
        for q in x[::15]:
            score, widths = x @ q, []

            def needed(low, high, score=score, widths=widths):
                assert (low <= score).all() and (score <= high).all()
                widths.append((high - low).mean())
                return np.ones(len(low), bool)

            assert len(survivors(Asked(q, 6), np.arange(200), code, along, left, needed)) == 200
            assert dim < 7 or not q.any() or widths[-1] < 0.2 * widths[0]


# ---- clusters


def kmeans(rows, count=40, rounds=5, dim=64):
    kept = [(r[0], [int(np.floor(256 * x)) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and np.isfinite(x) for x in r[1])]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:count]
    k = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(k)) for _, v in kept]
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign(), strict=True):
            groups[j].append(v)
        k = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else k[j] for j in range(len(k))]
    last = assign()
    by = collections.Counter()
    for d, j in last:
        by[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in k]
    return sorted((str(i), j, d, by[j], sum(by.values()), name[j]) for (i, _), (d, j) in zip(kept, last, strict=True))


def test_clusters_equal_the_plain_rule(spark):
    from ledgerline.llm.clusters import centroid_clusters, clustered

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).round(2).tolist(), 0, "r", "v", "c") for i in range(300)]
    rows += [rows[3]] * 100 + [(900 + i, rows[4][1], 0, "", "", "") for i in range(10)] + [(None, rows[5][1], 0, "", "", "")]
    rows += [(1000, None, 0, "", "", ""), (1001, [1.0] * 7, 0, "", "", ""), (1002, [None] * 8, 0, "", "", ""), (1003, [float("inf")] * 8, 0, "", "", ""), (1004, [], 0, "", "", "")]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    for count in (1, 2, 12):
        got = sorted((str(r[0]), *tuple(r)[1:]) for r in centroid_clusters(df, count=count, dim=8).collect())
        assert got == kmeans(rows, count=count, dim=8)
    state, k = clustered(df, count=12, dim=8)
    assert state.groupBy().avg("compared").first()[0] < 4 < len(k)  # the bounds leave out most centroids
    few = df.where("vec_id < 3")
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in centroid_clusters(few, count=12, dim=8).collect()) == kmeans([r for r in rows if r[0] is not None and r[0] < 3], count=12, dim=8)
    assert centroid_clusters(df.limit(0)).count() == 0
    large = [(i, [float((i * 7919 + j * 104729) % 200_000) for j in range(8)], 0, "", "", "") for i in range(60)]  # beyond what doubles sum exactly
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in centroid_clusters(spark.createDataFrame(large, VECTORS), count=5, dim=8).collect())
    assert got == kmeans(large, count=5, dim=8)


def test_loosening_bounds_what_drift_can_do_and_is_less_than_it():
    from ledgerline.llm.clusters import loosening

    rng = np.random.default_rng(8)
    old = rng.normal(size=(9, 5)) * 100
    new = old + rng.normal(size=(9, 5)) * 10
    radius = rng.uniform(1, 60, 9)
    fall, drift = loosening(old, new, radius), np.linalg.norm(new - old, axis=1)
    for a in range(9):
        way = rng.normal(size=(4000, 5))
        x = old[a] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[a]
        real = np.linalg.norm(x[:, None] - old, axis=2) - np.linalg.norm(x[:, None] - new, axis=2)
        assert (real.max(axis=0) <= fall[a] + 1e-9).all()
    assert (fall <= drift * (1 + 1e-6)).all() and fall.mean() < 0.8 * drift.mean()
