"""Hand-made frames: ties, empty inputs, rejections, flips, invariants of stochastic jobs."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlab.functions.ordering import numbered
from weftlab.functions.stats import hypergeom_tail
from weftlab.operators import bicluster, evaluate, gibbs, jobs, merge, modules, network, nulls, pairs, rankoverlap, sampler, sets
from weftlab.operators.components import connected_components
from weftlab.session import new_path
from weftlab.sources import matrix


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(0, k) for k in range(300, 400)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r["node"]: r["component"] for r in connected_components(frame(spark, edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
    assert connected_components(frame(spark, [], "u long, v long")).count() == 0


def test_rank_ties_go_by_sample(spark):
    m = frame(spark, [(1, s, 1.0) for s in (3, 1, 2)], "gene int, sample int, value double")
    for direction in ("UP", "DOWN"):
        assert {r["sample"]: r["rnk"] for r in rankoverlap.rank_samples(m, direction).collect()} == {1: 0, 2: 1, 3: 2}


def test_two_means_and_direction(spark):
    m = frame(spark, [(g, s, 2.0 if s < 4 else 0.0) for g in (1, 2) for s in range(20)], "gene int, sample int, value double")
    genes = frame(spark, [(1, 1), (1, 2)], "id int, gene int")
    up = bicluster.optimal_sample_set(genes, m, frame(spark, [(1, "UP")], "id int, direction string"), 20, 4)
    assert sorted(r["sample"] for r in up.collect()) == [0, 1, 2, 3]
    down = bicluster.optimal_sample_set(genes, m, frame(spark, [(1, "DOWN")], "id int, direction string"), 20, 4)
    assert down.count() == 0  # 16 of 20 is over the limit
    assert bicluster.discordant_sample_set(genes, m, 20, 4).count() == 4
    assert bicluster.optimal_sample_set(genes, m, frame(spark, [(1, "UP")], "id int, direction string"), 20, 5).count() == 0


def test_two_means_constant():
    assert set(bicluster.two_means(np.ones((5, 2)))) == {0}


def test_flip_keeps_mixed(spark):
    bics = frame(spark, [(1, "UP"), (2, "MIXED"), (3, "DOWN")], "id int, direction string")
    samples = frame(spark, [(i, s) for i in (1, 2) for s in range(8)] + [(3, 0)], "id int, sample int")
    every = frame(spark, [(s,) for s in range(10)], "sample int")
    b, s = bicluster.flip_large_biclusters(bics, samples, every, 10)
    assert {r["id"]: r["direction"] for r in b.collect()} == {1: "DOWN", 2: "MIXED", 3: "DOWN"}
    assert sorted((r["id"], r["sample"]) for r in s.collect()) == [(1, 8), (1, 9), (2, 8), (2, 9), (3, 0)]


def test_no_predictions_give_zeros(spark):
    genes, samples = frame(spark, [(1, 1), (2, 2)], "id int, gene int"), frame(spark, [(1, 1), (2, 2)], "id int, sample int")
    none = (genes.filter("false"), samples.filter("false"))
    assert [r["relevance"] for r in evaluate.relevance(none, (genes, samples)).collect()] == [0.0, 0.0]
    assert [r["recovery"] for r in evaluate.recovery(none, (genes, samples)).collect()] == [0.0, 0.0]


def test_flat_series_has_not_converged(spark):
    series = frame(spark, [(i, 1.0, float(i)) for i in range(12)], "step int, x1 double, x2 double")
    row = modules.convergence_check(series).first()
    assert row["slope_1"] is None and row["converged"] is False


def test_complement_of_everything_is_empty(spark):
    every = frame(spark, [(1,), (2,)], "sample int")
    assert sets.complement(frame(spark, [(1, 1), (1, 2)], "id int, sample int"), "id", every).count() == 0


@pytest.mark.parametrize("block", [3, 10_000])
def test_complement_in_parts(spark, block):
    names = set(range(40))
    own = {1: {0, 5, 39, 77}, 2: set(), None: {7}, 3: names}
    rows = [(k, s) for k, have in own.items() for s in [*have, *list(have)[:1], None]]
    every = frame(spark, [(s,) for s in [*names, 3, None]], "sample long")
    got = sets.complement(frame(spark, rows, "id int, sample int"), "id", every, block).collect()
    assert sorted((str(r["id"]), r["sample"]) for r in got) == sorted((str(k), s) for k, have in own.items() for s in names - have)
    assert sets.complement(frame(spark, [], "id int, sample int"), "id", every, block).count() == 0
    assert sets.complement(frame(spark, rows, "id int, sample int"), "id", every.filter("false"), block).count() == 0


@pytest.fixture(scope="module")
def net(spark):
    edges = [(k, (k * 3 + 1) % 30) for k in range(30)] + [(k, k + 1) for k in range(29)]
    return network.canonical_edges(frame(spark, edges, "g1 long, g2 long"))


@pytest.mark.parametrize("most_edges", [nulls.MOST_EDGES, 0])
def test_walks_are_connected_and_repeatable(spark, net, most_edges):
    nbrs = {}
    for r in net.collect():
        nbrs.setdefault(r["g1"], set()).add(r["g2"])
        nbrs.setdefault(r["g2"], set()).add(r["g1"])
    got = {}
    for r in nulls.random_connected_subnets(net, [4, 6], 10, seed=3, most_edges=most_edges).collect():
        got.setdefault((r["size"], r["walk"]), set()).add(r["gene"])
    assert len(got) == 20
    for (size, _), genes in got.items():
        seen, todo = set(), [min(genes)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in nbrs[x] if y in genes]
        assert seen == genes and len(genes) == size
    other_form = nulls.MOST_EDGES if most_edges == 0 else 0
    again = nulls.random_connected_subnets(net.repartition(7), [4, 6], 10, seed=3, most_edges=other_form).collect()
    assert {(r["size"], r["walk"], r["gene"]) for r in again} == {(k[0], k[1], g) for k, v in got.items() for g in v}


def of_net(spark, net, n=12):
    edges = net.withColumn("eid", net["g1"] * 100 + net["g2"])
    return edges, spark.createDataFrame([(r["eid"], s) for r in edges.collect() for s in range(n) if (r["eid"] + s) % 3 == 0], "eid long, sample int")


@pytest.mark.parametrize("part_edges", [None, 17])
def test_sampler_labels_follow_the_candidate_rule(spark, net, part_edges):
    edges, samples = of_net(spark, net)
    history = sampler.sample_modules(edges, samples, 12, steps=3, seed=5, part_edges=part_edges)
    last = history.filter("step = 2")
    ids = {r["eid"] for r in edges.collect()}
    rows = history.collect()
    assert len(rows) == 3 * len(ids) and {r["module"] for r in rows} <= ids and {r["converged"] for r in rows} == {False}
    assert modules.module_sample_counts(last.select("eid", "module"), samples).groupBy("module").agg({"m": "max"}).agg({"max(m)": "sum"}).first()[0] == len(ids)
    again = sampler.sample_modules(edges.repartition(5), samples.repartition(3), 12, steps=3, seed=5, part_edges=part_edges)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert sampler.sample_modules(edges.filter("false"), samples, 12).count() == 0


def test_part_scores_moves_as_the_operators_do(spark, net):
    """Candidates and log-probabilities of a task's part equal edge_candidate_modules and edge_module_loglik, whole and split over parts."""
    edges, samples = of_net(spark, net)
    state = frame(spark, [(r["eid"], [e["eid"] for e in edges.collect()][(r["eid"] * 7 % 5) * 3]) for r in edges.collect()], "eid long, module long")
    want = {(r["eid"], r["module"]): r["lp"] for r in modules.edge_module_loglik(modules.edge_candidate_modules(edges, state), state, samples, 12).collect()}
    label, have = {r["eid"]: r["module"] for r in state.collect()}, {}
    for r in samples.collect():
        have.setdefault(r["eid"], []).append(r["sample"])
    rows = [(r["eid"], r["g1"], r["g2"]) for r in edges.collect()]

    def part(some, held=None, offered=None):
        eid, g1, g2 = (np.array(x) for x in zip(*some, strict=True))
        return gibbs.Part(eid, g1, g2, [np.array(have.get(e, []), int) for e in eid], np.array([label[e] for e in eid]), 12, 0.5, 1.0, 1, held, offered)

    def scored(p):
        every = np.arange(len(p.eid))
        owner, k, alone_owner, alone = p.candidates(every)
        got = {(int(p.eid[i]), int(p.modules[j])): x for i, j, x in zip(owner, k, p.loglik(every, owner, k).tolist(), strict=True)}
        return got | {(int(p.eid[i]), int(p.modules[j])): p.alone() for i, j in zip(alone_owner, alone, strict=True)}

    def equal(a, b):
        return a.keys() == b.keys() and all(math.isclose(a[x], b[x], abs_tol=1e-9) for x in a)

    assert equal(scored(part(rows)), want)
    held = part(rows).counts()
    split = {}
    for mine, rest in ((rows[:25], rows[25:]), (rows[25:], rows[:25])):
        offered = sorted({(g, k) for e, *ends in rest for g in ends for k in (e, label[e])})
        split |= scored(part(mine, held, tuple(np.array(x) for x in zip(*offered, strict=True))))
    assert equal(split, want)
    moved = part(rows)
    moved.sweep(0)
    fresh = gibbs.Part(moved.eid, np.array([r[1] for r in sorted(rows)]), np.array([r[2] for r in sorted(rows)]), [np.array(have.get(e, []), int) for e in moved.eid], moved.modules[moved.label], 12, 0.5, 1.0, 1)
    assert sorted(zip(*moved.counts(), strict=True)) == sorted(zip(*fresh.counts(), strict=True))  # counts kept by changes equal counts taken anew


def test_sampler_has_the_sequential_sampler_s_distribution():
    """Over many steps pairs of edges share a module as often as under a plain sampler that draws edge after edge."""
    n, rng = 6, random.Random(8)
    ends = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 3)]
    have = [{0, 1, 2}, {0, 1, 2}, {2, 3, 4}, {3, 4, 5}, {0, 1}]
    steps, pairs_ = 6000, [(a, b) for a in range(5) for b in range(a)]
    near = [[f for f in range(5) if set(ends[e]) & set(ends[f])] for e in range(5)]

    def lp(e, k, label):
        rest = [f for f in range(5) if f != e and label[f] == k]
        m, ones = len(rest), [sum(s in have[f] for f in rest) for s in range(n)]
        if m == 0:
            return n * math.log(0.5)
        if m == 1:
            match = sum(ones[s] for s in have[e])
            return match * math.log(1.25 / 0.5) + (n - match) * math.log(0.25 / 0.5) + math.log(2)
        return sum(math.log(((ones[s] if s in have[e] else m - ones[s]) + 0.25) / (m + 0.5)) for s in range(n)) + math.log(m + 1)

    label, plain = list(range(5)), dict.fromkeys(pairs_, 0)
    for _ in range(steps):
        for e in range(5):
            ks = sorted({x for f in near[e] for x in (f, label[f])})
            logs = [lp(e, k, label) for k in ks]
            label[e] = rng.choices(ks, [math.exp(x - max(logs)) if x - max(logs) >= -7 else 0.0 for x in logs])[0]
        for a, b in pairs_:
            plain[a, b] += label[a] == label[b]
    part = gibbs.Part(np.arange(5), *(np.array(x) for x in zip(*ends, strict=True)), [np.array(sorted(h)) for h in have], np.arange(5), n, 0.5, 1.0, 3)
    assert all(not set(ends[a]) & set(ends[b]) for level in part.levels for a in level for b in level if a < b)
    got = dict.fromkeys(pairs_, 0)
    for step in range(steps):
        part.sweep(step)
        for a, b in pairs_:
            got[a, b] += part.label[a] == part.label[b]
    assert all(abs(got[x] - plain[x]) / steps < 0.05 for x in pairs_)


def test_windows_and_flatness_as_the_operators_tell(spark):
    rng = np.random.default_rng(2)
    history = rng.integers(0, 3, (120, 8))
    history[:40] = 1
    rows = frame(spark, [(s, e, int(history[e, s])) for e in range(120) for s in range(8)], "step int, eid long, module long")
    squares, terms = gibbs.window_change(history)
    one, two = (modules.edge_transitions(rows.filter(f)) for f in ("step < 7", "step > 0"))
    assert math.isclose((squares / terms) ** 0.5, modules.transition_rmsd(one, two).first()[0], rel_tol=1e-12)
    assert gibbs.window_change(np.ones((3, 5), np.int64)) == (0.0, 0)
    series = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.random(15), np.linspace(0, 1, 15) ** 0.1, strict=True))]
    table = frame(spark, series, "step int, x1 double, x2 double")
    for tol in (0.05, 0.12, 0.5):
        assert sampler.is_flat(series, 10, tol) == modules.convergence_check(table, 10, tol).first()["converged"]
    assert not sampler.is_flat([(i, 1.0, float(i)) for i in range(12)], 10, 0.1)


def test_hypergeometric_tail_against_whole_numbers(spark):
    cases = [(x, k, m, n) for n in (1, 7, 64, 500) for k in {0, 1, n // 3, n} for m in {0, n // 2, n} for x in {-1, 0, 1, k * m // n, k * m // n + 3, min(k, m), min(k, m) + 1}]
    for n in {c[3] for c in cases}:
        rows = [(x, k, m) for x, k, m, size in cases if size == n]
        got = frame(spark, rows, "x long, k long, m long")
        for r in got.withColumn("p", hypergeom_tail(F.col("x"), F.col("k"), F.col("m"), n)).collect():
            want = sum(math.comb(r["k"], i) * math.comb(n - r["k"], r["m"] - i) for i in range(max(0, r["x"]), min(r["k"], r["m"]) + 1)) / math.comb(n, r["m"])
            assert math.isclose(r["p"], want, rel_tol=1e-9, abs_tol=1e-15), (r, want)


def test_hypergeometric_tail_of_large_sets(spark):
    """Products of the counts exceed a long here; the sum over the middle half of the terms has all of the mass but some 1e-300."""
    n, k, m = 1_200_000, 90_000, 240_000
    lf = lambda i: math.lgamma(i + 1.0)
    term = lambda i: math.exp(lf(k) + lf(n - k) + lf(m) + lf(n - m) - lf(n) - lf(i) - lf(k - i) - lf(m - i) - lf(n - k - m + i))
    rows = [(x, k, m) for x in (0, 17_000, 17_800, 18_000, 18_001, 18_250, 20_000, k)]
    for r in frame(spark, rows, "x long, k long, m long").withColumn("p", hypergeom_tail(F.col("x"), F.col("k"), F.col("m"), n)).collect():
        want = math.fsum(term(i) for i in range(max(r["x"], 13_000), 23_000)) if r["x"] < 23_000 else 0.0
        assert math.isclose(r["p"], want, rel_tol=1e-6, abs_tol=1e-12), (r, want)


def test_numbered_keeps_the_order(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    got = {r["a"]: r["n"] for r in numbered(frame(spark, rows, "a int, b int"), ["a"], "n").collect()}
    assert got == {i: i for i in range(101)}
    assert numbered(frame(spark, [], "a int"), ["a"], "n").count() == 0


def test_tool_results(spark):
    def write(name, text):
        path = new_path(spark, "tool")
        frame(spark, [(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
        return f"{path}/*/part-*", path

    flat = "Sample_id:1; Parameters:k=2; Runtime:1; Run:1\n2 2\n241 575\n191 179\n3 2\n1 2 3\n4 5\nSample_id:1; Parameters:k=2; Runtime:1; Run:3\n0 2\n\n7 8\n2 0\n5 6\n0 0\n2 3\n7 8\n1 2 3\n"
    path, _ = write("flat", flat)
    got = [(r["run"], r["id"], r["parameters"], r["genes"], r["samples"]) for r in matrix.read_tool_biclusters(spark, path, n_runs=4).orderBy("run", "id").collect()]
    k = "k=2"
    assert got == [
        (1, 1, k, ["241", "575"], ["179", "191"]), (1, 2, k, ["1", "2", "3"], ["4", "5"]), (2, 0, None, [], []),
        (3, 1, k, [], ["7", "8"]), (3, 2, k, ["5", "6"], []), (3, 3, k, [], []), (3, 4, k, ["7", "8"], ["1", "2", "3"]), (4, 0, None, [], []),
    ]
    path, root = write("x_2/Results_biclustering/a", "Bicluster 4\nNumber_of_Genes: 2\nNumber_of_Conditions: 1\nGene_names: a b\nCondition_names: s\n")
    assert [(r["run"], r["id"], r["genes"], r["samples"]) for r in matrix.read_tool_biclusters(spark, root + "/x_2/Results_biclustering/a").collect()] == [(2, 4, ["a", "b"], ["s"])]
    path, _ = write("m_5.own.biclusters.txt", "id:\t3\naverage SNR:\t0.75\ngenes:\ta b\nsamples:\ts t\n")
    assert [(r["run"], r["id"], r["avgSNR"], r["genes"], r["samples"]) for r in matrix.read_tool_biclusters(spark, path).collect()] == [(5, 3, 0.75, ["a", "b"], ["s", "t"])]


def test_wide_matrices(spark):
    """25,000 samples, written and read back; gaps, repeated cells, short and long lines."""
    n = 25_000
    names = [f"s{i}" for i in range(n)]
    rows = [(g, s, float(k)) for k, s in enumerate(names) for g in ("a", "b") if (k + (g == "b")) % 3]
    path = new_path(spark, "wide")
    matrix.write_harmonised(frame(spark, [*rows, ("a", "s1", 5.0), ("c", "elsewhere", 1.0)], "gene string, sample string, value double"), path, names)
    got = matrix.read_expression(spark, path)
    assert got.count() == 2 * n and sorted(map(tuple, got.filter("value is not null").collect())) == sorted(rows)
    text = new_path(spark, "lines")
    frame(spark, [("id\tkey\tx\ty",), ('"p"\tq\t1\tNaN',), ("",), ("r\t\t2",), ("u\tv\t3\tn/a\t9",)], "value string").coalesce(1).write.text(text)
    found = sorted(map(str, (tuple(r) for r in matrix.read_expression_two_key(spark, text).collect())))
    assert found == sorted(map(str, [("p", "q", "x", 1.0), ("p", "q", "y", math.nan), ("r", None, "x", 2.0), ("r", None, "y", None), ("u", "v", "x", 3.0), ("u", "v", "y", None)]))
    none = new_path(spark, "none")
    frame(spark, [], "value string").write.text(none)
    assert matrix.read_expression(spark, none).count() == 0


def test_annotation_in_both_orientations(spark):
    given = frame(spark, [("p1", "I", 50), ("p2", None, 61)], "sample string, stage string, age int")
    rows, turned = new_path(spark, "rows"), new_path(spark, "turned")
    matrix.write_annotation(given, rows)
    assert sorted(map(str, map(tuple, matrix.read_clinical(spark, rows).collect()))) == ["('p1', 'I', '50')", "('p2', None, '61')"]
    matrix.write_annotation(given, turned, columns=["p2", "p1"])
    assert sorted(map(str, map(tuple, matrix.read_clinical(spark, turned).select("variable", "p2", "p1").collect()))) == ["('age', '61', '50')", "('stage', None, 'I')"]


def planted(spark, blocks, n_genes, n_samples, seed=3):
    """A matrix of noise with raised blocks (genes, samples)."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n_genes, n_samples))
    for genes, samples in blocks:
        x[np.ix_(genes, samples)] += 4.0
    return frame(spark, [(g, s, float(x[g, s])) for g in range(n_genes) for s in range(n_samples)], "gene long, sample int, value double")


def test_merging(spark):
    inside = list(range(10))
    m = planted(spark, [(list(range(6)), inside), (list(range(6, 9)), list(range(20, 30)))], 12, 40)
    genes = frame(spark, [(i, g) for i, gs in ((1, (0, 1, 2)), (2, (3, 4, 5)), (3, (6, 7, 8)), (4, (1, 5))) for g in gs], "id int, gene long")
    samples = frame(spark, [(i, s) for i, ss in ((1, inside), (2, inside), (3, range(20, 30)), (4, inside[:9])) for s in ss], "id int, sample int")
    ways = lambda d: frame(spark, list(d.items()), "id int, direction string")

    def merged(directions, **how):
        b, g, s = merge.merge_biclusters(ways(directions), genes.filter(genes.id.isin(list(directions))), samples.filter(samples.id.isin(list(directions))), m, 40, how.pop("snr", 0.5), 5, **how)
        of = lambda df, c: {i: sorted(r[c] for r in rows if r["id"] == i) for rows in [df.collect()] for i in {r["id"] for r in rows}}
        return {r["id"]: r["direction"] for r in b.collect()}, of(g, "gene"), of(s, "sample")

    for ids, exact in (((1, 2, 3, 4), False), ((1, 2, 3), True)):
        got = merged(dict.fromkeys(ids, "UP"), exact=exact)
        assert got == ({1: "UP", 3: "UP"}, {1: [0, 1, 2, 3, 4, 5], 3: [6, 7, 8]}, {1: inside, 3: list(range(20, 30))})
    assert set(merged({1: "UP", 2: "UP"}, snr=50.0)[0]) == {1, 2}  # rejected for its SNR, and the rounds end
    # opposite directions overlap where the second is complemented: here 1 and the complement of 5's samples
    more = samples.union(frame(spark, [(5, s) for s in range(10, 40)], "id int, sample int"))
    both = genes.union(frame(spark, [(5, g) for g in (3, 4, 5)], "id int, gene long"))
    b, g, s = merge.merge_biclusters(ways({1: "UP", 5: "DOWN"}), both.filter("id in (1, 5)"), more.filter("id in (1, 5)"), m, 40, 0.5, 5, discordant=True)
    assert [(r["id"], r["direction"]) for r in b.collect()] == [(1, "MIXED")] and sorted(r["sample"] for r in s.collect()) == inside
    none = merge.merge_biclusters(ways({1: "UP"}).filter("false"), genes.filter("false"), samples.filter("false"), m, 40, 0.5)
    assert none[0].count() == 0


def test_pair_overlap_of_empty_sets(spark):
    bics = frame(spark, [(1, "UP"), (2, "UP")], "id int, direction string")
    rows = pairs.bicluster_pair_overlap(bics, frame(spark, [(1, 1)], "id int, sample int"), 10).collect()
    assert [(r["shared"], r["p"], r["jac"]) for r in rows] == [(0, 1.0, 0.0)]


@pytest.mark.parametrize("most_edges", [nulls.MOST_EDGES, 0])
def test_null_sets_grow_along_a_path_and_give_up(spark, most_edges):
    path = frame(spark, [(k, k + 1) for k in range(9)] + [(3, 3), (2, 1), (None, 4)], "g1 long, g2 long")
    for r in nulls.random_connected_subnets(path, [4], 50, seed=2, most_edges=most_edges).groupBy("walk").count().collect():
        assert r["count"] == 4
    assert nulls.random_connected_subnets(path, [20], 2, max_restarts=2, most_edges=most_edges).count() == 0
    assert nulls.random_connected_subnets(path.filter("false"), [3], 2, most_edges=most_edges).count() == 0
    m = planted(spark, [], 10, 30)
    rows = nulls.null_distribution(path, m, [3], 20).collect()
    assert len(rows) == 20 and all(r["n_genes"] == 3 and 1 <= r["n_samples"] <= 15 and r["avgSNR"] > 0 for r in rows)


def test_large_random_sets_take_time_in_proportion(spark):
    """On a sparse net walks get stuck all the time; a search of the whole set each time took minutes here."""
    n = 40_000
    net = frame(spark, [(k, (k * 7 + 1) % n) for k in range(n)] + [(k, k + 1) for k in range(n - 1)], "g1 long, g2 long")
    began = time.time()
    rows = nulls.random_connected_subnets(net, [15_000], 4).groupBy("walk").agg(F.countDistinct("gene").alias("n")).collect()
    assert [r["n"] for r in rows] == [15_000] * 4 and time.time() - began < 60


def test_both_forms_of_null_distributions_agree(spark, net):
    """With missing and null cells, and genes that the matrix lacks."""
    rng = random.Random(4)
    rows = [(g, f"s{s:02}", None if rng.random() < 0.1 else rng.gauss(g % 3 if s < 9 else 0, 1)) for g in range(28) for s in range(20) if rng.random() > 0.1]
    m = frame(spark, rows, "gene long, sample string, value double")
    told = [sorted((r["n_genes"], r["n_samples"], round(r["avgSNR"], 9)) for r in nulls.null_distribution(net, m, [3, 7], 6, most_edges=k).collect()) for k in (nulls.MOST_EDGES, 0)]
    assert told[0] == told[1] and len(told[0]) == 12


def test_pvalues_count_ties_and_gaps(spark):
    rng = random.Random(1)
    some = lambda: rng.choice([None, 0.0, 0.5, 0.5, 1.0, math.nan])
    null = [(rng.randrange(1, 4), rng.choice([None, *range(9)]), some()) for _ in range(300)]
    bics = [(i, rng.randrange(1, 5), rng.choice([None, *range(10)]), some()) for i in range(60)]
    key = lambda x: math.inf if x is not None and math.isnan(x) else x
    got = bicluster.empirical_pvalues(frame(spark, bics, "id int, n_genes int, n_samples int, avgSNR double"), frame(spark, null, "n_genes int, n_samples int, avgSNR double"))
    want = []
    for i, size, n, r in bics:
        own = [z for z in null if z[0] == size]
        most = [z for z in own if n is not None and z[1] is not None and z[1] >= n]
        high = [z for z in most if r is not None and z[2] is not None and key(z[2]) >= key(r)]
        want.append((i, (len(high) + 1) / (len(own) + 1), len(most), len(high)))
    assert sorted(map(tuple, got.collect())) == want


def test_corners_of_one_edge_step_by_step(spark):
    """The walk of a plain loop over diagonals, with ties and samples of any type."""
    rng, n, step, least = np.random.default_rng(7), 24, 2, 2
    x = rng.standard_normal((6, n)).round(1)
    x[1:3, :8] += 2
    m = frame(spark, [(g, f"s{s:02d}", float(x[g, s])) for g in range(6) for s in range(n)], "gene int, sample string, value double")
    ranked = rankoverlap.rank_samples(m)
    edges = frame(spark, [(a, b) for a in range(6) for b in range(a + 1, 6)], "g1 int, g2 int")
    limit = rankoverlap.overlap_thresholds(spark, n, step, 0.2)
    needed = {(r["tu"], r["tw"]): r["min_overlap"] for r in limit.collect()}
    place = [{s: r for r, s in enumerate(sorted(range(n), key=lambda s: (-x[g, s], s)))} for g in range(6)]

    def ratio(g, inside):
        a, b = x[g, sorted(inside)], x[g, sorted(set(range(n)) - inside)]
        return abs(a.mean() - b.mean()) / (a.std() + b.std())

    want = {}
    cuts = rankoverlap.cutoffs(n, step)
    for a in range(6):
        for b in range(a + 1, 6):
            for d in range(len(cuts)):
                hits, stop = [], False
                for c1 in range(d + 1):
                    tu, tw = cuts[c1], cuts[d - c1]
                    inside = {s for s in range(n) if place[a][s] < tu and place[b][s] < tw}
                    stop |= len(inside) <= least
                    if len(inside) > needed[tu, tw] and (ratio(a, inside) + ratio(b, inside)) / 2 >= 0.3:
                        hits.append((-len(inside), abs(tu - tw), c1, tu, tw, {f"s{s:02d}" for s in inside}))
                if hits:
                    want[a, b] = min(hits, key=lambda h: h[:3])[3:]
                if hits or stop:
                    break
    got = rankoverlap.best_corner(edges, ranked, n, step, limit, least, 0.3, with_samples=True).collect()
    assert want and {(r["g1"], r["g2"]): (r["tu"], r["tw"], set(r["samples"])) for r in got} == want
    assert all(r["n"] == len(r["samples"]) for r in got)


def test_consensus_of_the_last_steps(spark):
    rows = [(s, 1, 5 if s < 30 else 6) for s in range(40)]
    history = frame(spark, rows, "step int, eid long, module long")
    assert [(r["module"], r["share"]) for r in sampler.final_modules(history, True).collect()] == [(6, 10 / 15)]
    assert [(r["module"], r["share"]) for r in sampler.final_modules(history, False).collect()] == [(6, 1.0)]


def test_planted_biclusters_are_found(spark):
    """Both jobs on a planted matrix: what is found matches the planted sets far better than random connected sets do."""
    truth = [(list(range(8)), list(range(14))), (list(range(20, 28)), list(range(30, 45)))]
    m = planted(spark, truth, 60, 60)
    rng = random.Random(6)
    edges = [(a, b) for genes, _ in truth for a in genes for b in genes if a < b and rng.random() < 0.5] + [(rng.randrange(60), rng.randrange(60)) for _ in range(60)]
    net_ = frame(spark, edges, "g1 long, g2 long")
    found = jobs.discover(net_, m, "UP", min_snr=0.5)
    tg = frame(spark, [(i, g) for i, (gs, _) in enumerate(truth) for g in gs], "id int, gene long")
    ts = frame(spark, [(i, s) for i, (_, ss) in enumerate(truth) for s in ss], "id int, sample int")
    hit = [r["recovery"] for r in evaluate.recovery((found[1], found[2]), (tg, ts)).collect()]
    assert len(hit) == 2 and min(hit) > 0.6
    path = new_path(spark, "biclusters")
    matrix.write_biclusters(jobs.listed(found), path)  # both jobs meet through files, as their users' runs do
    report = jobs.significance_from_files(path, path + "-none", net_, m, 0.5, sets_per_size=200).collect()
    assert report and min(r["p_val"] for r in report) <= 0.01
    assert [r["id"] for r in sorted(report, key=lambda r: (r["n_genes"], -r["avgSNR"]))] == list(range(len(report)))
