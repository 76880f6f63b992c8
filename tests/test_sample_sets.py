"""Sample sets of modules, thresholds and options of operators against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import frame
from weftlab.operators import bicluster, clinical, evaluate, merge, pairs, prepare, rankoverlap


def plain_two_means(x):
    """Labels of the rows of x by Lloyd's steps from the rows with the lowest and the highest mean."""
    mean = [sum(r) / len(r) for r in x]
    centres = [list(x[mean.index(min(mean))]), list(x[mean.index(max(mean))])]
    label = None
    for _ in range(100):
        far = [[sum((a - b) ** 2 for a, b in zip(r, c, strict=True)) for c in centres] for r in x]
        new = [int(d[1] < d[0]) for d in far]
        if new == label:
            break
        label = new
        for k in (0, 1):
            own = [r for r, c in zip(x, label, strict=True) if c == k]
            if not own:
                return label
            centres[k] = [sum(col) / len(own) for col in zip(*own, strict=True)]
    return label


@pytest.fixture(scope="module")
def given(spark):
    """(values, sets of genes, frames of both): noise with some raised and lowered blocks."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((30, 40)).round(3)
    for lo, by in ((0, 3.0), (6, -3.0), (12, 2.0)):
        x[lo : lo + 5, rng.choice(40, 12, replace=False)] += by
    x[20:24, :3] += 9.0  # too few samples
    x[25:28, :30] += 6.0  # too many
    sets = {1: [0, 1, 2, 3, 4], 2: [6, 7, 8], 3: [12, 13, 14, 16], 4: [20, 21, 22], 5: [25, 26, 27], 6: [3, 9, 17, 29], 7: [19]}
    m = frame(spark, [(g, s, float(x[g, s])) for g in range(30) for s in range(40)], "gene long, sample int, value double")
    return x, sets, m, frame(spark, [(i, g) for i, gs in sets.items() for g in gs], "id int, gene long")


def plain_set(x, genes, direction, n, least, most=0.55):
    rows = x[genes].T.tolist()
    label = plain_two_means(rows)
    size = [label.count(0), label.count(1)]
    if min(size) < least:
        return None
    mean = [np.mean([r for r, c in zip(rows, label, strict=True) if c == k]) for k in (0, 1)]
    k = {"UP": int(mean[1] > mean[0]), "DOWN": int(mean[1] < mean[0]), "MIXED": int(size[1] < size[0])}[direction]
    return None if direction != "MIXED" and size[k] >= most * n else {s for s, c in enumerate(label) if c == k}


def plain_snr(x, genes, inside):
    rest = sorted(set(range(x.shape[1])) - inside)
    own = sorted(inside)
    return float(np.mean([abs(x[g, own].mean() - x[g, rest].mean()) / (x[g, own].std() + x[g, rest].std()) for g in genes]))


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], set()).add(r["sample"])
    return out


def test_two_means_of_sets(spark, given):
    x, sets, m, members = given
    got = {}
    for r in bicluster.two_means_split(members, m).collect():
        got.setdefault(r["id"], {})[r["sample"]] = r["cluster"]
    assert got == {i: dict(enumerate(plain_two_means(x[genes].T.tolist()))) for i, genes in sets.items()}


@pytest.mark.parametrize("direction", ["UP", "DOWN", "MIXED"])
def test_sample_sets(spark, given, direction):
    x, sets, m, members = given
    ways = members.select("id").distinct().withColumn("direction", F.lit(direction))
    found = bicluster.discordant_sample_set(members, m, 40, 4) if direction == "MIXED" else bicluster.optimal_sample_set(members, m, ways, 40, 4)
    want = {i: s for i, genes in sets.items() if (s := plain_set(x, genes, direction, 40, 4)) is not None}
    assert len(want) < len(sets) and collected(found) == want


def test_modules_and_thresholds(spark, given):
    x, sets, m, _ = given
    rows = [(i, k, a, b) for i, genes in sets.items() for k, (a, b) in enumerate(zip(genes[:-1], genes[1:], strict=True))] + [(8, 0, 0, 29)]
    edges = frame(spark, [(100 * i + k, a, b) for i, k, a, b in rows], "eid long, g1 long, g2 long")
    state = frame(spark, [(100 * i + k, i) for i, k, _, _ in rows], "eid long, module long")
    known = [plain_snr(x, g, s) for g in sets.values() if len(g) > 2 and (s := plain_set(x, g, "UP", 40, 4))]
    limit = (min(known) + max(known)) / 2
    got = {r["id"]: (r["n_edges"], r["n_genes"], r["n_samples"], r["reason"], r["avgSNR"]) for r in bicluster.modules_to_biclusters(edges, state, m, "UP", 40, limit, 4).collect()}
    for i, genes in [*((i, g) for i, g in sets.items() if len(g) > 1), (8, [0, 29])]:
        inside = plain_set(x, genes, "UP", 40, 4) if len(genes) > 2 else None
        score = plain_snr(x, genes, inside) if inside else None
        reason = "single_edge" if len(genes) == 2 else "samples" if inside is None else "snr" if score < limit else "kept"
        assert got[i][:4] == (len(genes) - 1, len(genes), len(inside) if inside else None, reason)
        assert score is None or math.isclose(got[i][4], score, rel_tol=1e-9)
    assert {v[3] for v in got.values()} == {"single_edge", "samples", "snr", "kept"}
    scores = frame(spark, [(1, a, b, None if i == 4 else i / 7) for i, _, a, b in rows], "one int, g1 long, g2 long, s double")
    values = [-1.0 if i == 4 else i / 7 for i, _, _, _ in rows]
    for q in (0.1, 0.37):
        assert rankoverlap.snr_threshold(scores, "s", q, 1000).first()["min_snr"] == round(float(np.quantile(values, 1 - q)), 3)


def test_pairs_of_blocks_against_plain_sets(spark, monkeypatch):
    """Bitmaps in several blocks and layers of words; directions, empty sets, null samples."""
    monkeypatch.setattr(pairs, "BLOCK", 5)
    rng = random.Random(4)
    sets = {i: {rng.randrange(70) for _ in range(rng.randrange(30))} for i in range(23)}
    ways = {i: rng.choice(["UP", "DOWN"]) for i in sets}
    bics = frame(spark, list(ways.items()), "id int, direction string")
    samples = frame(spark, [(i, f"n{s}") for i, have in sets.items() for s in [*have, *list(have)[:2]]] + [(3, None)], "id int, sample string")
    n = 70

    def want(i, j):
        b = sets[j] if ways[i] == ways[j] else set(range(n)) - sets[j]
        shared, union = len(sets[i] & b), len(sets[i] | b)
        p = sum(math.comb(len(sets[i]), k) * math.comb(n - len(sets[i]), len(b) - k) for k in range(shared, min(len(sets[i]), len(b)) + 1)) / math.comb(n, len(b))
        return shared, len(sets[i]) - shared, len(b) - shared, p, shared / union if union else 0.0

    for about in (n, 1):  # the number of samples touches sizes alone: with 1, all words of one layer are full
        bits, words = pairs.numbered_bits(samples, about)
        packed = pairs.packed_sets(bics, samples, bits, words)
        rows = {(r["i"], r["j"]): r for r in pairs.pair_overlaps(pairs.set_pairs(packed), n).collect()}
        assert set(rows) == {(i, j) for i in sets for j in sets if i < j}
        for (i, j), r in rows.items():
            a = want(i, j)
            assert (r["shared"], r["only_1"], r["only_2"]) == a[:3] and math.isclose(r["p"], a[3], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(r["jac"], a[4])
    some = packed.filter("id in (2, 9, 10)")
    met = pairs.set_pairs(some, packed).collect()
    assert sorted((r["i"], r["j"]) for r in met) == sorted((i, j) for i in sets for j in sets if i < j and {i, j} & {2, 9, 10})


def test_options_of_evaluation(spark):
    genes = frame(spark, [(1, g) for g in range(8)] + [(2, g) for g in range(20, 24)], "id int, gene int")
    sets = frame(spark, [("narrow", g) for g in range(4)] + [("wide", g) for g in range(12)] + [("other", g) for g in range(30, 33)], "set_name string, gene int")
    pick = lambda by_fold: [(r["id"], r["set_name"]) for r in evaluate.gene_set_enrichment(genes, sets, 100, by_fold=by_fold).collect()]
    assert pick(True) == [(1, "narrow")] and pick(False) == [(1, "wide")]
    tests = frame(spark, [(1, 0.03, "a"), (2, 0.0001, "b"), (3, 0.006, "c")], "id int, p double, v string")
    kept = lambda by_p: {r["id"]: (round(r["threshold"], 6), r["v"]) for r in evaluate.bh_filter(tests, "p", "v", ["id"], by_p=by_p).collect()}
    assert kept(False) == {1: (0.002778, "NA"), 2: (0.005556, "b"), 3: (0.008333, "c")}
    assert kept(True) == {2: (0.002778, "b"), 3: (0.005556, "NA"), 1: (0.008333, "NA")}
    side = lambda i, ss: (frame(spark, [(i, 1), (i, 2)], "id int, gene int"), frame(spark, [(i, s) for s in ss], "id int, sample int"))
    every = frame(spark, [(1,), (2,), (3,)], "sample int")
    match = lambda limit: evaluate.best_match_biclusters(side(1, [1, 2, 9]), side(5, [2, 3, 9]), every, limit).first()["jac"]
    assert math.isclose(match(False), 2 / 3) and math.isclose(match(True), 1 / 3)
    ids = prepare.assign_ids(frame(spark, [("b",), ("a",), (None,), ("b",)], "g string"), "g", "gid")
    assert sorted(map(tuple, prepare.map_back(frame(spark, [(1, 7.0), (0, 8.0)], "gid int, v double"), "gid", ids).collect())) == [(0, 8.0, "a"), (1, 7.0, "b")]
    table = frame(spark, [(1, "x_I"), (2, "x_IX"), (3, None)], "id int, stage string")
    assert [r["id"] for r in clinical.rejects(table, "stage", {"I": "1"}, strip="x_").collect()] == [2]


def test_merging_one_pair_a_round_equals_a_plain_version(spark, given):
    """exact=True: the best pair of all biclusters, computed anew each round in plain code."""
    x, _, m, _ = given
    sets = {1: [0, 1, 2], 2: [2, 3, 4], 3: [6, 7], 4: [8, 9], 5: [12, 13, 16], 6: [14, 13]}
    n, have = 40, {}
    for i, genes in sets.items():
        have[i] = plain_set(x, genes, "UP", n, 4) or plain_set(x, genes, "DOWN", n, 4)
    sets = {i: set(g) for i, g in sets.items() if have[i]}
    start = {i: (set(sets[i]), set(have[i])) for i in sets}

    def tail(a, b):
        k = len(a & b)
        return sum(math.comb(len(a), t) * math.comb(n - len(a), len(b) - t) for t in range(k, min(len(a), len(b)) + 1)) / math.comb(n, len(b))

    now, tried = {i: (set(g), set(s)) for i, (g, s) in start.items()}, set()
    while True:
        ranked = sorted((round(tail(now[i][1], now[j][1]), 12), -len(now[i][1] & now[j][1]) / len(now[i][1] | now[j][1]), i, j) for i in now for j in now if i < j and (i, j) not in tried and tail(now[i][1], now[j][1]) * len(now) < 0.05)
        if not ranked:
            break
        _, _, i, j = ranked[0]
        genes = sorted(now[i][0] | now[j][0])
        inside = plain_set(x, genes, "UP", n, 4)
        if inside and plain_snr(x, genes, inside) >= 0.3:
            now[i] = (set(genes), inside)
            del now[j]
            tried = {t for t in tried if not {i, j} & set(t)}
        else:
            tried.add((i, j))
    ids = frame(spark, [(i, "UP") for i in start], "id int, direction string")
    members, samples = (frame(spark, [(i, v) for i in start for v in sorted(start[i][k])], f"id int, {c}") for k, c in enumerate(("gene long", "sample int")))
    b, g, s = merge.merge_biclusters(ids, members, samples, m, n, 0.3, 4, exact=True)
    of = lambda df, c, i: {r[c] for r in df.filter(F.col("id") == i).collect()}
    assert {r["id"] for r in b.collect()} == set(now) and len(now) < len(start)
    assert all((of(g, "gene", i), of(s, "sample", i)) == now[i] for i in now)


@pytest.mark.parametrize("missing", [False, True])
def test_correlations_of_blocks_against_plain_pairs(spark, missing):
    """Every pair counts whichever blocks its genes are in; constant genes and cells that lack a value leave their pairs out."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 12)).round(3)
    x[7], x[8, :11] = 1.5, 0.1
    has = rng.random(x.shape) > (0.3 if missing else 0.0)
    sets_, inside = {0: list(range(0, 30)), 1: list(range(5, 40)), 2: [3]}, {0: range(12), 1: range(2, 9), 2: range(5)}
    m = frame(spark, [(g, s, float(x[g, s]) if has[g, s] else None) for g in range(40) for s in range(12) if has[g, s] or s % 2], "gene long, sample int, value double")
    members, samples = frame(spark, [(i, g) for i, gs in sets_.items() for g in gs], "id int, gene long"), frame(spark, [(i, s) for i, ss in inside.items() for s in ss], "id int, sample int")
    known = {(r["gene"], r["sample"]): r["value"] for r in m.collect() if r["value"] is not None}
    want = {}
    for i, genes in sets_.items():
        rs = []
        for g, h in itertools.combinations(genes, 2):
            both = [s for s in inside[i] if (g, s) in known and (h, s) in known]
            u, v = [known[g, s] for s in both], [known[h, s] for s in both]
            if len(set(u)) > 1 and len(set(v)) > 1:
                rs.append(np.corrcoef(u, v)[0, 1])
        if rs:
            want[i] = (sum(rs) / len(rs), min(rs), max(rs))
    for block in (3, 64):
        got = {r["id"]: (r["avg"], r["min"], r["max"]) for r in bicluster.bicluster_correlations(members, samples, m, block).collect()}
        assert got.keys() == want.keys()
        for i in want:
            assert np.allclose(got[i], want[i], atol=0.00501)


def test_part_edges_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share of the lines stays the same, however many there are."""
    from weftlab.plans import fixtures

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(fixtures, "LINES", 500)
    edges = fixtures.part_edges(spark, sf)
    assert edges.rdd.getNumPartitions() >= spark.read.parquet(f"{sf}/lineitem.parquet").count() / 500
    monkeypatch.setattr(fixtures, "LINES", 10**9)
    assert edges.exceptAll(fixtures.part_edges(spark, sf)).isEmpty() and edges.count() == fixtures.part_edges(spark, sf).count()


def test_thresholds_score_only_the_edges_they_take(spark, monkeypatch):
    """The threshold reads 1000 edges by hash, so no other edge needs a score."""
    from weftlab.plans import bicluster_queries

    scored = []
    score = bicluster.bicluster_snr
    monkeypatch.setattr(bicluster, "bicluster_snr", lambda members, found, m: scored.append(members.select("id").distinct().count()) or score(members, found, m))
    monkeypatch.setattr(rankoverlap, "SIZE", 50)
    assert bicluster_queries.snr_threshold(spark, "/root/testdata/sf0.001").count() == 1 and scored == [50]
