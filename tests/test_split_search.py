"""Split search and forests against plain Python, on small tables with missing values, ties and empty arms."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from armwise.operators import candidates, checks, forest, ordinals, scoring, tallies, thresholds
from armwise.plans import split_search
from armwise.sources import sinks, synthetic

CUTS = [1.0, 2.5, 4.0, 9.0]
#: Root: d0 <= 2, missing left. Left: leaf. Right: d1 is category 1, missing right.
TREE = {"node_type": [1, 0, 2, 0, 0], "feature_idx": [0, 0, 1, 0, 0], "thresholds": [2.0, 0, 0, 0, 0], "cat_value": [0, 0, 1, 0, 0], "left_child": [1, 1, 3, 3, 4], "right_child": [2, 1, 4, 3, 4], "nan_goes_left": [True, True, False, True, True], "leaf_response_rates": [[0, 0], [0.5, 0.25], [0, 0], [0.125, 1.0], [0.75, 0.0]]}


def drawn(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    values = [0.5, 1.0, 2.0, 2.5, 3.0, 4.0, 5.0, math.inf, -math.inf, math.nan, None]
    return [(rng.choice(values), rng.choice(["control", "a", "b"]), rng.choice([0.0, 1.0])) for _ in range(n)]


def prefix(spark, rows, cuts=CUTS, **options):
    df = spark.createDataFrame(rows, "feature double, treatment string, outcome double")
    return split_search.build_prefix_sums(df, feature_cols=["feature"], splits={"feature": list(cuts)}, **options)


def searched(rows, cuts, least=1):
    """Plain Python: {(bin, direction): (counts and sums of both sides, score, valid)}."""
    missing = lambda x: x is None or math.isnan(x)
    arms, out = sorted({t for _, t, _ in rows}), {}
    for (k, cut), way in itertools.product(enumerate(cuts), ("left", "right")):
        sides = {s: {t: [0, 0.0] for t in arms} for s in ("left", "right")}
        for x, t, y in rows:
            cell = sides[way if missing(x) else "left" if x < cut else "right"][t]
            cell[0], cell[1] = cell[0] + 1, cell[1] + y
        full = all(n for side in sides.values() for n, _ in side.values())
        score = None
        if full:
            up = {s: [c[t][1] / c[t][0] - c["control"][1] / c["control"][0] for t in arms if t != "control"] for s, c in sides.items()}
            score = max(max(up["right"]) - min(up["left"]), max(up["left"]) - min(up["right"]))
        sums = [f(c[i] for c in sides[s].values()) for s in ("left", "right") for i, f in ((0, sum), (1, sum))]
        out[k, way] = (*sums, score, full and min(sums[0], sums[2]) >= least)
    return out


@pytest.mark.parametrize("mode", ["sql", "pandas"])
@pytest.mark.parametrize(("n", "least"), [(7, 1), (60, 1), (60, 20)])
def test_candidates(spark, mode, n, least):
    rows = drawn(n, n)
    scored = candidates.score(prefix(spark, rows), evaluation_mode=mode, min_leaf_size=least)
    got = {(r.candidate_bin, r.nan_direction): r for r in scored.collect()}
    want = searched(rows, CUTS, least)
    assert set(got) == set(want)
    for key, (lc, ls, rc, rs, score, valid) in want.items():
        r = got[key]
        assert (r.left_count, r.left_sum, r.right_count, r.right_sum, r.is_valid) == (lc, ls, rc, rs, valid)
        assert r.score == score or math.isclose(r.score, score, abs_tol=1e-12)
    valid = [(-w[4], CUTS[k], k, way == "left", way) for (k, way), w in want.items() if w[5]]
    if valid:
        best = candidates.choose(scored)
        assert math.isclose(best["score"], -min(valid)[0], abs_tol=1e-12)


def test_edges(spark):
    rows = [(2.5, "a", math.nan), (math.inf, "control", None), (-math.inf, "a", 1.0), (0.0, None, 1.0)]
    at_cut = {(r.candidate_bin, r.treatment): (r.left_count_base, r.left_sum_base) for r in prefix(spark, rows, [2.5]).collect()}
    assert at_cut == {(0, "control"): (0, 0.0), (0, "a"): (1, 1.0)}
    for options, cuts in (({"min_leaf_size": 400}, CUTS), ({}, ())):
        with pytest.raises(ValueError, match="no valid split"):
            candidates.choose(candidates.score(prefix(spark, drawn(60, 1), cuts), **options))
    with pytest.raises(ValueError, match="missing columns"):
        split_search.build_prefix_sums(spark.range(1), feature_cols=["feature"], splits={"feature": []})


def test_wide_tallies(spark, monkeypatch):
    """Tallies of Arrow batches are those of the expressions, with empty partitions and clashing column names."""
    rows = [(*(x for x, _, _ in drawn(3, i)), f"t{i % 3}", float(i % 2), i) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, opps double, treatment string, outcome double, feature int").repartition(13)
    cuts = {"a": CUTS, "b": [], "opps": [2.0]}
    obs = tallies.observations(df, list(cuts))
    narrow = sorted(map(str, tallies.tally(obs, cuts).collect()))
    monkeypatch.setattr(tallies, "WIDE", 1)
    assert sorted(map(str, tallies.tally(obs, cuts).collect())) == narrow
    assert tallies.tally(obs.limit(0), cuts).collect() == []


@pytest.mark.parametrize("wide", [24, 1])
def test_exact_sums(spark, monkeypatch, wide):
    """Sums of real outcomes are the exactly rounded ones, bit by bit, however rows are dealt out; plain ones differ."""
    monkeypatch.setattr(tallies, "WIDE", wide)
    rng = random.Random(11)
    rows = [(rng.choice([0.5, 3.0, None]), rng.choice("ab"), rng.choice([rng.uniform(-1, 1) * 10 ** rng.randrange(-3, 13), 0.1, -0.1, 2.0**46, -(2.0**46), 2.0**-48])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "x double, treatment string, outcome double")
    held = lambda y: round(math.ldexp(y, 48)) if abs(y) < 2**5 else int(math.ldexp(y, 48))
    want = {}
    for x, t, y in rows:
        key = (2 if x is None else int(x >= 1), t)
        want[key] = want.get(key, 0) + held(y)
    want = {k: float((v >> 48) + (v & (2**48 - 1)) / 2.0**48) for k, v in want.items()}
    for part in (df.coalesce(1), df.repartition(5), df.repartition(13)):
        got = {(r.bin_id, r.treatment): r.accepts for r in tallies.tally(tallies.observations(part, ["x"]), {"x": [1.0]}, exact=True).collect()}
        assert got == want
    with pytest.raises(Exception, match="no exact sum"):
        tallies.tally(tallies.observations(df.withColumn("outcome", F.lit(-(2.0**47))), ["x"]), {"x": [1.0]}, exact=True).collect()


def test_exact_quantiles(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.gauss(0, 1e-3), rng.expovariate(1e-6), 0.0, -0.5, 2.0**40, 5e-324, math.inf, -math.inf, None, math.nan]) for _ in range(500)]
    df = spark.createDataFrame([(v, 3.0, None) for v in values], "a double, b double, c double")
    present = sorted(v for v in values if v is not None and not math.isnan(v))
    for n in (1, 2, 7, 64):
        got = {f: sorted(r.cut for r in thresholds.exact_quantiles(df, ["a", "b", "c"], n).where(F.col("feature") == f).collect()) for f in "abc"}
        assert got == {"a": sorted({present[math.ceil(i * len(present) / n) - 1] for i in range(1, n)}), "b": [3.0] * (n > 1), "c": []}


def test_sweep_arms(spark):
    rows = drawn(400, 9)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "feature double, treatment string, outcome double, i int")
    arms = {n: F.when(F.col("i") % n == 0, "control").otherwise(F.concat(F.lit("t"), F.col("i") % n)) for n in (2, 4, 8)}
    got = {r.config: r for r in split_search.sweep_arms(df, "feature", CUTS, arms).collect()}
    for n in arms:
        want = searched([(x, f"t{i % n}" if i % n else "control", y) for i, (x, _, y) in enumerate(rows)], CUTS)
        assert math.isclose(got[n].score, max(w[4] for w in want.values() if w[5]), abs_tol=1e-12)


@pytest.mark.parametrize("kind", sinks.FORMATS)
def test_sinks(spark, tmp_path, kind):
    rows = spark.createDataFrame([("a,\"b\"\n c", 0.1, None, True), (None, -1e300, 2**60, False)], "name string, score double, n bigint, ok boolean")
    sinks.write_rows(rows, str(tmp_path / "rows"), kind)
    if kind != "csv":
        assert sorted(map(str, sinks.read_rows(spark, str(tmp_path / "rows"), rows.schema, kind).collect())) == sorted(map(str, rows.collect()))
    plain = rows.withColumn("name", F.lit("x"))
    sinks.write_rows(plain, str(tmp_path / "plain"), kind)
    assert sorted(map(str, sinks.read_rows(spark, str(tmp_path / "plain"), plain.schema, kind).collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(ValueError):
        sinks.write_rows(rows, str(tmp_path / "other"), "xml")


@pytest.mark.parametrize("kind", sinks.FORMATS)
def test_manifest(spark, tmp_path, kind):
    """A manifest is the same for any order and partitions; a lost, repeated or changed row is detected."""
    rows = spark.createDataFrame([(f"r{i}", i / 7, i if i % 3 else None) for i in range(50)], "name string, score double, n bigint")
    path = sinks.write_rows(rows.repartition(4), str(tmp_path / "rows"), kind, manifest=True)
    assert sorted(map(tuple, sinks.read_rows(spark, path, kind=kind, verify=True).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    again = [tuple(r.agg(*sinks.fingerprint(r)).first()) for r in (rows, rows.repartition(7).orderBy("score"))]
    assert again[0] == again[1]
    changes = [rows.where("score > 0"), rows.unionByName(rows.limit(2)), rows.withColumn("score", F.when(F.col("name") == "r3", 0.0).otherwise(F.col("score")))]
    for changed in changes:
        sinks.write_rows(changed, path, kind, mode="overwrite")
        with pytest.raises(ValueError, match="manifest"):
            sinks.read_rows(spark, path, kind=kind, verify=True)
    empty = sinks.write_rows(rows.limit(0), str(tmp_path / "none"), "parquet", manifest=True)
    assert sinks.read_rows(spark, empty, verify=True).count() == 0


def test_metadata(spark, tmp_path):
    facts = {"rows": 5, "features": ["a", "b"], "error": 0.01}
    sinks.write_metadata(spark, facts, str(tmp_path / "run"))
    assert sinks.read_metadata(spark, str(tmp_path / "run")) == facts


def test_parity(spark):
    a = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, 0.4]), (3, [0.5, 0.6])], "id int, scores array<double>")
    b = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, 0.5]), (4, [0.5, 0.6])], "id int, scores array<double>")
    assert checks.parity({"a": a, "b": b, "c": a}, ["id"]).first().asDict() == {"n_rows": 4, "unpaired": 2, "repeated": 0, "a_b": 1, "a_c": 0}


def test_parity_of_repeated_keys(spark):
    """Keys that repeat, or are null, are told and never multiplied; with ordinals each row has its own pair."""
    rows = spark.createDataFrame([(k % 3 if k % 7 else None, [float(k)], k) for k in range(200)], "id int, scores array<double>, ordinal_ int").repartition(5)
    assert checks.parity({"a": rows, "b": rows}, ["id"]).first().asDict() == {"n_rows": 4, "unpaired": 0, "repeated": 4, "a_b": 0}
    assert checks.paired({"a": rows, "b": rows}, ["id"], "scores").agg(F.sum("n_a"), F.sum("n_b"), F.count("*")).first() == (200, 200, 4)
    named = ordinals.with_ordinal(rows.withColumn("place", F.lit(1)))
    assert sorted(r.ordinal for r in named.collect()) == list(range(200)) and named.columns == ["id", "scores", "ordinal_", "place", "ordinal"]
    again = named.repartition(3).orderBy("scores")
    assert checks.parity({"a": named, "b": again}, ["ordinal"]).first().asDict() == {"n_rows": 200, "unpaired": 0, "repeated": 0, "a_b": 0}
    assert ordinals.with_ordinal(rows.limit(0)).collect() == []
    with pytest.raises(ValueError, match="exists"):
        ordinals.with_ordinal(named)


@pytest.mark.parametrize(("arms", "control"), [(["Control", "b"], "Control"), (["1", "0"], "0"), (["b", "a"], "a"), (["control", "Control"], "Control")])
def test_control(spark, arms, control):
    assert candidates.control_arm(spark.createDataFrame([(a,) for a in arms], "treatment string")).first()[0] == control


def test_thresholds(spark):
    assert thresholds.clean([3, 1.0, None, math.nan, math.inf, 1]) == [1.0, 3.0]
    with pytest.raises(ValueError):
        thresholds.clean(["x"])
    df = spark.createDataFrame([(None,), (math.nan,)], "a double")
    assert thresholds.quantiles(df, ["a"], 4, 0.0) == {"a": []}


@pytest.mark.parametrize("score", [scoring.score_arrow, scoring.score_pandas, scoring.score_native])
def test_small_tree(spark, score):
    rows = [(2.0, 0.0), (2.5, 1.0), (7.0, 0.0), (None, 1.0), (math.nan, 0.0), (3.0, None)]
    df = spark.createDataFrame(rows, "d0 double, d1 double").coalesce(1)
    leaf = [1, 3, 4, 1, 1, 4]
    assert [r.scores for r in score(df, [TREE], ["d0", "d1"]).collect()] == [TREE["leaf_response_rates"][k] for k in leaf]
    assert score(df.limit(0), [TREE], ["d0", "d1"]).collect() == []
    two = TREE | {"leaf_response_rates": [[2 * x for x in r] for r in TREE["leaf_response_rates"]]}
    assert [r.scores for r in score(df, [TREE, two], ["d0", "d1"]).collect()] == [[(x + 2 * x) / 2 for x in TREE["leaf_response_rates"][k]] for k in leaf]


def test_large_forests_are_not_native(spark):
    with pytest.raises(ValueError, match="score_arrow"):
        scoring.score_native(spark.createDataFrame([(0.0,)], "f0 double"), synthetic.forest(7, 2, 5, n_features=1), ["f0"])


def test_paths_agree(spark, tmp_path):
    synthetic.features(spark, 2000, 8, 0.2, partitions=4).write.parquet(str(tmp_path / "x"))
    df, trees, names = spark.read.parquet(str(tmp_path / "x")), synthetic.forest(4, 4, 5, n_features=8), [f"f{i}" for i in range(8)]
    both = scoring.score_native(scoring.score_pandas(scoring.score_arrow(df, trees, names, "a"), trees, names, "b"), trees, names, "c")
    assert tuple(checks.mismatches(both, "a", "b", 1e-12).first()) == tuple(checks.mismatches(both, "a", "c", 1e-12).first()) == (2000, 0)
    assert checks.contract(both, "a", 4).first()[0] == 0


def test_validation(spark):
    for change in ({"left_child": [9, 1, 3, 3, 4]}, {"left_child": [0, 1, 3, 3, 4]}, {"node_type": [7, 0, 2, 0, 0]}, {"feature_idx": [5, 0, 1, 0, 0]}, {"thresholds": [0.5]}):
        with pytest.raises(ValueError):
            forest.validate([TREE | change], 2)
    with pytest.raises(ValueError):
        forest.validate([TREE, TREE | {"leaf_response_rates": [[0.0]] * 5}], 2)
    table = forest.nodes(spark, forest.to_json([TREE, TREE | {"feature_idx": [5, 0, 1, 0, 0]}]))
    assert table.count() == 10 and [(r.tree, r.node) for r in forest.invalid_nodes(table, 2).collect()] == [(1, 0)]


def test_node_faults(spark):
    """Long chains and loops, against walks in plain Python."""
    rng, rows = random.Random(2), []
    for tree in range(40):
        n = rng.choice([1, 2, 7, 33, 100])
        for i in range(n):
            far = lambda: rng.choice([i + 1, i + 2, rng.randrange(n + 2)]) if rng.random() < 0.9 else i  # noqa: E731, B023
            rows.append((tree, i, rng.choice([0, 1, 1, 2]), far(), far()))
    table = spark.createDataFrame(rows, "tree int, node int, node_type int, left_child int, right_child int").repartition(5)
    want, have = set(), {(t, i) for t, i, *_ in rows}
    parents = {}
    for t, i, kind, left, right in rows:
        for c in (left, right) if kind else ():
            parents.setdefault((t, c), []).append(i)
            want |= {(t, i, "child_outside")} if (t, c) not in have else set()
    for t, i in have:
        links, at, steps = parents.get((t, i), []), i, 0
        want |= {(t, i, f) for f, bad in (("root_has_parent", i == 0 and links), ("two_parents", len(links) > 1)) if bad}
        while at and (t, at) in parents and steps < 200:
            at, steps = min(parents[t, at]), steps + 1
        end = "cycle" if steps == 200 else "unreachable" if at else "too_deep" if steps > 9 else None
        want |= {(t, i, end)} if end else set()
    assert {f for *_, f in want} == {"child_outside", "root_has_parent", "two_parents", "cycle", "unreachable", "too_deep"}
    found = [tuple(r) for r in forest.node_faults(table, 9).collect()]
    assert sorted(found) == sorted(want)
    assert forest.node_faults(table.limit(0), 9).collect() == []
    assert forest.node_faults(forest.nodes(spark, forest.to_json([TREE])), 2).collect() == []


def test_node_faults_broadcasts_no_nodes(spark):
    """Tables of nodes are small files of many rows: no join may send one to the driver, also below the broadcast threshold."""
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    rows = [(t, i, int(i < 3), 2 * i + 1 if i else 9, 2 * i + 2) for t in range(5) for i in range(7)]
    table = spark.createDataFrame(rows, "tree int, node int, node_type int, left_child int, right_child int")
    before = ran().size()
    assert {(r.node, r.fault) for r in forest.node_faults(table, 9).collect()} == {(0, "child_outside"), *((i, "unreachable") for i in (1, 3, 4))}
    joins = [p for p in (ran().apply(k).physicalPlanDescription() for k in range(before, ran().size())) if "Join" in p]
    assert len(joins) >= 3 and all("SortMergeJoin" in p and "Broadcast" not in p for p in joins)


@pytest.mark.parametrize("block", [1, 7, 50])
def test_score_blocks(spark, block):
    """Blocks of trees give the bits of one broadcast forest, for chunks of any size, nulls and clashing names."""
    names = [f"f{i}" for i in range(6)]
    df = synthetic.features(spark, 3000, 6, 0.2).withColumns({"chunk": F.lit("c"), "turn": F.lit(1), "row": F.lit(2), "place": F.lit(3)})
    df = df.withColumn("f2", F.when(F.col("f1") > 0, float("nan")).otherwise(F.col("f2")))
    trees = synthetic.forest(5, 3, 50, n_features=6)
    want = sorted(map(str, scoring.score_arrow(df, trees, names).collect()))
    for chunk in (700, 1 << 18):
        assert sorted(map(str, scoring.score_blocks(df, forest.tree_table(spark, trees), names, block=block, chunk=chunk).collect())) == want
    if block == 7:
        assert scoring.score_blocks(df.limit(0), forest.tree_table(spark, trees), names).collect() == []
        with pytest.raises(Exception, match="child outside"):
            scoring.score_blocks(df, forest.tree_table(spark, [TREE | {"left_child": [9, 1, 3, 3, 4]}]), names).collect()
        for score in (scoring.score_arrow, scoring.score_pandas):
            with pytest.raises(ValueError, match="not a number"):
                score(df.withColumn("f0", F.current_date()), trees, names)


def test_synthetic(spark):
    assert synthetic.observations(spark, 100, 2, 3).columns == ["x0", "x1", "treatment", "outcome"]
    assert synthetic.three_arms(spark, 50, 0.2, 0.2).count() == 50
    tree = synthetic.forest(3, 2, 2, missing_routing="left")[0]
    assert len(tree["node_type"]) == 15 and np.all(tree["nan_goes_left"])
    inner = tree["node_type"] != 0
    assert inner.sum() == 7 and not tree["leaf_response_rates"][inner].any() and set(tree["node_type"][inner]) == {1, 2}
    arms = {r.treatment: r["count"] / 4000 for r in synthetic.three_arms(spark, 4000).groupBy("treatment").count().collect()}
    assert all(abs(arms[a] - share) < 0.05 for a, share in synthetic.SHARES.items())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sql_path_has_no_python(spark):
    sums = prefix(spark, drawn(9, 2))
    for plan in (plan_of(sums), plan_of(candidates.score(sums))):
        assert "Python" not in plan and "Pandas" not in plan


def test_no_single_task_above_candidates(spark):
    """The control arm is a scalar of the written prefix sums; candidates never meet in one task."""
    plan = plan_of(candidates.best_split_per_feature(candidates.score(prefix(spark, drawn(60, 2)))))
    assert "SinglePartition" not in plan.split("Subquery")[0]


def test_pandas_candidates_are_dealt(spark):
    """One feature's candidates go to several tasks, whole ones; batches that cut one off change nothing."""
    cuts = [x / 8 for x in range(1, 60)]
    scored = lambda mode: candidates.score(prefix(spark, drawn(3000, 5), cuts), evaluation_mode=mode)
    parts = scored("pandas").withColumn("part", F.spark_partition_id())
    assert parts.select("part").distinct().count() > 3
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = {tuple(r)[:4]: tuple(r)[4:] for r in scored("pandas").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {tuple(r)[:4]: tuple(r)[4:] for r in scored("sql").collect()}
    assert len(want) == 118 and set(got) == set(want)
    for key, row in want.items():
        assert all(a == b or math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[key], row, strict=True))


def test_quantile_passes(spark):
    """Only values of cells with a wanted rank take the shuffle of values; the cells are broadcast to the second pass."""
    df = spark.range(200_000).select((F.xxhash64("id") / 1e18).alias("x"))
    found = thresholds.exact_quantiles(df, ["x"], 4)
    values = sorted(r.x for r in df.collect())
    assert sorted(r.cut for r in found.collect()) == [values[50_000 * i - 1] for i in (1, 2, 3)]
    assert "BroadcastHashJoin" in plan_of(found)
    cells = df.select(thresholds._cell(F.col("x")).alias("cell")).groupBy("cell").count()
    assert 3 * cells.agg(F.max("count")).first()[0] < 200_000 / 50  # at most so many values are in the wanted cells


def test_default_quantiles(spark, monkeypatch):
    """Each default threshold's rank is within the asked error, also for values that repeat; a wrong one is told."""
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.gauss(0, 1), float(rng.randrange(4)), None, rng.choice("ab"), 1.0) for _ in range(5000)], "x double, y double, z double, treatment string, outcome double")
    cuts = thresholds.quantiles(df, ["x", "y", "z"], 16, 0.02)
    errors = {(r.feature, r.quantile): r.error for r in thresholds.rank_errors(df, cuts, 16).collect()}
    values = sorted(r.x for r in df.select("x").collect())
    for i in range(1, 16):
        near = min(abs(sum(v <= c for v in values) - math.ceil(i * 5000 / 16)) / 5000 for c in cuts["x"])
        assert math.isclose(errors["x", i], near, abs_tol=1 / 5000) and near <= 0.02 and errors["y", i] <= 0.02 and errors["z", i] is None
    assert thresholds.rank_errors(df, {"x": [values[-1]]}, 16).where("error > 0.5").count() == 7
    sums = split_search.build_prefix_sums(df, feature_cols=["x", "y"], check_quantiles=True)
    assert sums.where("feature = 'x'").select("candidate_bin").distinct().count() == 15
    monkeypatch.setattr(thresholds, "quantiles", lambda *a: {"x": [0.0]})
    with pytest.raises(ValueError, match="asked error"):
        split_search.build_prefix_sums(df, feature_cols=["x"], check_quantiles=True)


def test_synthetic_partitions(spark):
    """The same rows for any number of partitions."""
    makers = [lambda p: synthetic.features(spark, 500, 3, 0.2, partitions=p), lambda p: synthetic.observations(spark, 500, 2, 3, 0.1, partitions=p)]
    for make in makers:
        first, *others = [sorted(map(str, make(p).collect())) for p in (1, 4, 13)]
        assert all(o == first for o in others) and len(set(first)) > 450
    x = [r.f0 for r in synthetic.features(spark, 20_000, 1).collect()]
    assert abs(np.mean(x)) < 0.03 and abs(np.std(x) - 1) < 0.03 and abs(np.mean(np.abs(x) < 1) - 0.6827) < 0.02
    u = [r.x0 for r in synthetic.observations(spark, 20_000).collect()]
    assert abs(np.mean(u) - 0.5) < 0.01 and 0 <= min(u) and max(u) < 1
