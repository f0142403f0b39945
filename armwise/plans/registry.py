"""All queries of the library by name, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armwise.functions.values import imputed, is_missing
from armwise.operators import candidates, checks, forest, ordinals, scoring, tallies, thresholds
from armwise.plans import split_search
from armwise.sources import sinks, synthetic, views

# ---- fixed parameters of the queries

CUTS = {
    "l_extendedprice": [float(x) for x in range(10_000, 100_000, 10_000)],
    "l_quantity": [float(x) for x in range(5, 50, 5)],
    "l_discount": [0.02, 0.04, 0.06, 0.08],
    "l_tax": [0.02, 0.04, 0.06],
}
PRICE = ["l_extendedprice"]
SWEEP = {4: thresholds.equal_width(0.0, 100_000.0, 4), 8: thresholds.equal_width(0.0, 100_000.0, 8), 16: thresholds.equal_width(0.0, 100_000.0, 16), 32: thresholds.equal_width(0.0, 100_000.0, 32)}
FOREST = [
    {"node_type": [1, 0, 1, 0, 0], "feature_idx": [0, 0, 1, 0, 0], "thresholds": [20.0, 0.0, 40000.0, 0.0, 0.0], "cat_value": [0.0] * 5, "left_child": [1, 0, 3, 0, 0], "right_child": [2, 0, 4, 0, 0], "nan_goes_left": [True, True, False, True, True], "leaf_response_rates": [[0.0, 0.0, 0.0], [0.1, 0.2, 0.3], [0.0, 0.0, 0.0], [0.4, 0.5, 0.6], [0.7, 0.8, 0.9]]},
    {"node_type": [2, 1, 0, 0, 0], "feature_idx": [4, 2, 0, 0, 0], "thresholds": [0.0, 0.05, 0.0, 0.0, 0.0], "cat_value": [2.0, 0.0, 0.0, 0.0, 0.0], "left_child": [1, 3, 0, 0, 0], "right_child": [2, 4, 0, 0, 0], "nan_goes_left": [False] * 5, "leaf_response_rates": [[0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.25, 0.5, 0.125], [0.3, 0.1, 0.2], [0.6, 0.35, 0.45]]},
    {"node_type": [1, 0, 0], "feature_idx": [1, 0, 0], "thresholds": [30000.0, 0.0, 0.0], "cat_value": [0.0] * 3, "left_child": [1, 0, 0], "right_child": [2, 0, 0], "nan_goes_left": [True, True, True], "leaf_response_rates": [[0.0, 0.0, 0.0], [0.15, 0.05, 0.85], [0.55, 0.65, 0.75]]},
]

ARMS = (2, 4, 8, 16)
WIDE = 250
WIDE_CUTS = {f"w{k}": thresholds.equal_width(0.0, 100_000.0 * (1 + k % 7) + 50.0 * k, 8) for k in range(WIDE)}
DEEP_INPUTS = 32
DEEP_FOREST = synthetic.forest(7, 4, 50, n_features=DEEP_INPUTS, seed=20240611)

# ---- queries


def _obs(spark: SparkSession, d: str, features: list[str]) -> DataFrame:
    return tallies.observations(views.obs_line(spark, d), features)


def _prefix(spark: SparkSession, d: str, features: list[str] = PRICE) -> DataFrame:
    return split_search.build_prefix_sums(views.obs_line(spark, d), feature_cols=features, splits=CUTS)


def observations(spark: SparkSession, d: str) -> DataFrame:
    x = lambda c: F.when(~is_missing(F.col(c)), F.col(c)).alias(c)
    return _obs(spark, d, views.LINE_FEATURES).select(*[x(c) for c in views.LINE_FEATURES], "treatment", "outcome")


def impute_zero(spark: SparkSession, d: str) -> DataFrame:
    rows = views.obs_line(spark, d).select(imputed(F.col("l_extendedprice")).alias("price"), imputed(F.col("l_quantity")).alias("quantity"))
    return rows.withColumn("label", F.when(F.col("price") > 0, 1.0).otherwise(0.0))


def thresholds_quantile(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.exact_quantiles(views.obs_line(spark, d), views.LINE_FEATURES, 16)


def quantile_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The default thresholds (sketches, error 0.01) of each feature: whether each quantile's rank is as near as asked."""
    rows = views.obs_line(spark, d)
    found = thresholds.rank_errors(rows, thresholds.quantiles(rows, views.LINE_FEATURES), 16)
    return found.select("feature", "quantile", (F.col("error") <= 0.01).alias("within"))


def prefix_sums_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Prefix sums with default thresholds, whose ranks are checked."""
    return split_search.build_prefix_sums(views.obs_line(spark, d), feature_cols=views.LINE_FEATURES, check_quantiles=True)


def thresholds_equal_width(spark: SparkSession, d: str) -> DataFrame:
    rows = _obs(spark, d, views.LINE_FEATURES).select(*[F.when(~is_missing(F.col(c)), F.col(c)).alias(c) for c in views.LINE_FEATURES])
    ends = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in views.LINE_FEATURES])).alias("v")).groupBy("v.feature").agg(F.min("v.x").alias("lo"), F.max("v.x").alias("hi"))
    return ends.select("feature", F.explode(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / 16)).alias("cut")).distinct()


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.boundaries(_prefix(spark, d, views.LINE_FEATURES))


def bin_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = tallies.binned(_obs(spark, d, views.LINE_FEATURES), CUTS)
    return rows.groupBy("feature", "bin_id").agg(F.count(F.lit(1)).alias("n_rows"))


def bin_tallies(spark: SparkSession, d: str) -> DataFrame:
    return tallies.tally(_obs(spark, d, views.LINE_FEATURES), CUTS).drop("bin_boundary")


def bin_tallies_dense(spark: SparkSession, d: str) -> DataFrame:
    return tallies.densify(tallies.tally(_obs(spark, d, PRICE), {"l_extendedprice": [1.0, *CUTS["l_extendedprice"], 1e9]}), {"l_extendedprice": [1.0, *CUTS["l_extendedprice"], 1e9]}).drop("bin_boundary")


def prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    return _prefix(spark, d, views.LINE_FEATURES)


def nan_expanded(spark: SparkSession, d: str) -> DataFrame:
    return candidates.expand(_prefix(spark, d))


def control_arm(spark: SparkSession, d: str) -> DataFrame:
    segments = views.obs_order(spark, d).select("treatment").distinct()
    lines = views.obs_line(spark, d).select("treatment").distinct()
    return candidates.control_arm(lines).withColumn("view", F.lit("line")).unionByName(candidates.control_arm(segments).withColumn("view", F.lit("order")))


def arm_rates(spark: SparkSession, d: str) -> DataFrame:
    prefix = _prefix(spark, d)
    return candidates.arm_rates(candidates.expand(prefix), candidates.control_arm(prefix.select("treatment").distinct()).scalar())


def scored_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates.score(_prefix(spark, d, views.LINE_FEATURES), min_leaf_size=100)


def scored_candidates_pandas(spark: SparkSession, d: str) -> DataFrame:
    return candidates.score(_prefix(spark, d, views.LINE_FEATURES), min_leaf_size=100, evaluation_mode="pandas")


def best_split(spark: SparkSession, d: str) -> DataFrame:
    return candidates.best_split(candidates.score(_prefix(spark, d)))


def best_split_multi(spark: SparkSession, d: str) -> DataFrame:
    return candidates.best_split(candidates.score(_prefix(spark, d, views.LINE_FEATURES)))


def best_split_per_feature(spark: SparkSession, d: str) -> DataFrame:
    return candidates.best_split_per_feature(candidates.score(_prefix(spark, d, views.LINE_FEATURES)))


def bin_sweep(spark: SparkSession, d: str) -> DataFrame:
    return split_search.sweep(views.obs_line(spark, d), "l_extendedprice", SWEEP)


def determinism(spark: SparkSession, d: str) -> DataFrame:
    rows = views.obs_line(spark, d)
    parts = [rows, rows.repartition(13), rows.repartition(5, "treatment")]
    return split_search.same_choice([candidates.best_split(candidates.score(split_search.build_prefix_sums(p, feature_cols=PRICE, splits=CUTS))) for p in parts])


def determinism_real(spark: SparkSession, d: str) -> DataFrame:
    """Exact sums of real outcomes by bin and arm, and how many different ones 1, 5 and 13 partitions give."""
    rows = views.obs_revenue(spark, d)
    every = None
    for part in (rows.coalesce(1), rows.repartition(5), rows.repartition(13)):
        own = tallies.tally(tallies.observations(part, views.LINE_FEATURES), CUTS, exact=True)
        every = own if every is None else every.unionByName(own)
    sums = every.groupBy("feature", "bin_id", "treatment").agg(F.countDistinct("opps", "accepts").alias("versions"), F.max("opps").alias("opps"), F.max("accepts").alias("accepts"))
    return sums.select("feature", "bin_id", "treatment", "versions", "opps", "accepts")


def sample_first_n(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").orderBy("l_orderkey", "l_linenumber").limit(1000)


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return checks.run_summary(views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").cast("double").alias("v")), "mode", "v")


def forest_json_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The inner nodes of the JSON forest with the rows that pass each node's own test: one scan, one row of counts a task."""
    inner = forest.nodes(spark, forest.to_json(FOREST)).where("node_type <> 0").collect()  # a model's nodes
    tests = []
    for node in inner:
        x = F.col(views.FOREST_FEATURES[node.feature_idx])
        test = x <= node.thresholds if node.node_type == 1 else x == node.cat_value
        tests.append(F.when(is_missing(x), F.lit(node.nan_goes_left)).otherwise(test))
    counts = views.forest_input(spark, d).agg(F.count(F.lit(1)).alias("rows_all"), *[F.count_if(t).alias(f"c{k}") for k, t in enumerate(tests)])
    each = [
        F.struct(F.lit(n.tree).alias("tree"), F.lit(n.node).alias("node"), F.lit(n.node_type).cast("bigint").alias("node_type"), F.lit(views.FOREST_FEATURES[n.feature_idx]).alias("feature"), F.col(f"c{k}").alias("rows_left"))
        for k, n in enumerate(inner)
    ]
    return counts.select(F.explode(F.array(*each)).alias("n"), "rows_all").select("n.*", "rows_all")


def forest_invalid_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that break a rule in stumps made from the best split of each feature, one of them spoilt."""
    best = candidates.best_split_per_feature(candidates.score(_prefix(spark, d, views.LINE_FEATURES)))
    order = F.element_at(F.map_from_arrays(F.array(*[F.lit(f) for f in views.LINE_FEATURES]), F.array(*[F.lit(i) for i in range(4)])), F.col("feature"))
    tree = best.select(order.alias("tree"), "bin_boundary")
    kinds = F.array(*[F.struct(F.lit(i).alias("node"), F.lit(k).alias("node_type"), F.lit(a).alias("left_child"), F.lit(b).alias("right_child")) for i, (k, a, b) in enumerate([(1, 1, 2), (0, 0, 0), (0, 0, 0)])])
    table = tree.select("tree", F.explode(kinds).alias("n")).select("tree", "n.*", F.when(F.col("tree") == 3, 9).otherwise(F.col("tree")).alias("feature_idx"), F.array(F.lit(0.5), F.lit(0.5)).alias("leaf_response_rates"))
    return forest.invalid_nodes(table, 4).select("tree", "node", "feature_idx")


#: Depth that the walks of ``forest_faults`` may have.
BUDGET = 4


def forest_faults(spark: SparkSession, d: str) -> DataFrame:
    """Loops, nodes with two parents or none, children that are not there and walks beyond the budget, in a tree for each part."""
    return forest.node_faults(views.planted_forest(spark, d), BUDGET)


def _wide(df: DataFrame, n: int = 3) -> DataFrame:
    return df.select("l_orderkey", "line", "l_partkey", "l_suppkey", *[F.element_at("scores", i + 1).alias(f"r{i}") for i in range(n)])


def tree_scores(spark: SparkSession, d: str) -> DataFrame:
    return _wide(scoring.score_arrow(views.forest_input(spark, d), FOREST[:1], views.FOREST_FEATURES))


def forest_scores(spark: SparkSession, d: str) -> DataFrame:
    return _wide(scoring.score_arrow(views.forest_input(spark, d), FOREST, views.FOREST_FEATURES))


def forest_scores_pandas(spark: SparkSession, d: str) -> DataFrame:
    return _wide(scoring.score_pandas(views.forest_input(spark, d), FOREST, views.FOREST_FEATURES))


def forest_scores_expr(spark: SparkSession, d: str) -> DataFrame:
    return _wide(scoring.score_native(views.forest_input(spark, d), FOREST, views.FOREST_FEATURES))


def score_contract(spark: SparkSession, d: str) -> DataFrame:
    return checks.contract(scoring.score_arrow(views.forest_input(spark, d), FOREST, views.FOREST_FEATURES), "scores", 3)


def score_checksum(spark: SparkSession, d: str) -> DataFrame:
    found = checks.array_checksum(scoring.score_arrow(views.forest_input(spark, d), FOREST, views.FOREST_FEATURES), "scores")
    return found.select(F.round("checksum", 3).alias("checksum"))


def scalar_checksum(spark: SparkSession, d: str) -> DataFrame:
    return checks.scalar_checksum(views.table(spark, d, "lineitem"), "l_quantity").select(F.round("checksum", 3).alias("checksum"))


def score_parity(spark: SparkSession, d: str) -> DataFrame:
    """Arrow scores against native ones, in one row: no join."""
    rows = scoring.score_arrow(views.forest_input(spark, d), FOREST, views.FOREST_FEATURES, "a")
    return checks.mismatches(scoring.score_native(rows, FOREST, views.FOREST_FEATURES, "b"), "a", "b")


def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Arrow, pandas and native scores of separate runs, paired by the rows' ordinals."""
    rows = ordinals.with_ordinal(views.forest_input(spark, d))
    ways = {"arrow": scoring.score_arrow, "pandas": scoring.score_pandas, "native": scoring.score_native}
    return checks.parity({n: f(rows, FOREST, views.FOREST_FEATURES) for n, f in ways.items()}, ["ordinal"])


def line_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Arrow and native scores paired by the line items' own keys, some of which may repeat."""
    rows = views.forest_input(spark, d)
    return checks.parity({"arrow": scoring.score_arrow(rows, FOREST, views.FOREST_FEATURES), "native": scoring.score_native(rows, FOREST, views.FOREST_FEATURES)}, ["l_orderkey", "line"])


def arm_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The best price split for 2, 4, 8 and 16 arms, dealt by part."""
    rows = views.table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("price"), "l_partkey", (F.col("l_linestatus") == "F").cast("double").alias("outcome"))
    arms = {n: F.pmod("l_partkey", F.lit(n)).cast("string") for n in ARMS}
    return split_search.sweep_arms(rows, "price", CUTS["l_extendedprice"], arms)


def best_split_wide(spark: SparkSession, d: str) -> DataFrame:
    """The best split of each of 250 features, from one scan."""
    prefix = split_search.build_prefix_sums(views.wide_line(spark, d, WIDE), feature_cols=list(WIDE_CUTS), splits=WIDE_CUTS)
    return candidates.best_split_per_feature(candidates.score(prefix))


def deep_forest_scores(spark: SparkSession, d: str) -> DataFrame:
    """50 trees of depth 7 over 32 features, four arms."""
    scored = scoring.score_arrow(views.deep_input(spark, d, DEEP_INPUTS), DEEP_FOREST, [f"d{k}" for k in range(DEEP_INPUTS)])
    return _wide(scored, 4)


def deep_forest_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same forest as a table of trees, in blocks of seven, none of which is broadcast."""
    trees = forest.tree_table(spark, DEEP_FOREST)
    return _wide(scoring.score_blocks(views.deep_input(spark, d, DEEP_INPUTS), trees, [f"d{k}" for k in range(DEEP_INPUTS)], block=7, chunk=1 << 16), 4)


def result_rows_csv(spark: SparkSession, d: str) -> DataFrame:
    """Scored candidates written as CSV, read back and compared with their manifest."""
    rows = scored_candidates(spark, d)
    path = sinks.write_rows(rows, sinks.scratch(spark, "results"), "csv", manifest=True)
    return sinks.read_rows(spark, path, kind="csv", verify=True)


def mllib_tree_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.mllib_tree(views.forest_input(spark, d), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "l_extendedprice")


QUERIES = {
    f.__name__: f
    for f in (
        observations, impute_zero, thresholds_quantile, quantile_ranks, prefix_sums_quantile, thresholds_equal_width, boundaries, bin_assign, bin_tallies, bin_tallies_dense, prefix_sums, nan_expanded, control_arm, arm_rates, scored_candidates,
        scored_candidates_pandas, best_split, best_split_multi, best_split_per_feature, bin_sweep, determinism, determinism_real, sample_first_n, run_summary, forest_json_nodes, forest_invalid_nodes, forest_faults, tree_scores, forest_scores,
        forest_scores_pandas, forest_scores_expr, score_contract, score_checksum, scalar_checksum, score_parity, mllib_tree_scores,
        score_pairs, line_pairs, arm_sweep, best_split_wide, deep_forest_scores, deep_forest_blocks, result_rows_csv,
    )
}

# ---- SQL

_LINE = """line AS (SELECT {cols},
  CASE l_returnflag WHEN 'A' THEN 'control' WHEN 'N' THEN 't1' ELSE 't2' END AS treatment,
  CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome FROM lineitem)""".format(
    cols=", ".join(f"CASE WHEN l_linenumber NOT IN (3, 5) THEN {c}::DOUBLE END AS {c}" for c in views.LINE_FEATURES)
)


def _bin(x: str, cuts: list[float]) -> str:
    return f"CASE WHEN {x} IS NULL THEN {len(cuts) + 1} ELSE " + " + ".join(f"CASE WHEN {x} >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in cuts) + " END"


def _ctes(cuts: dict[str, list[float]], source: dict[str, str] | None = None) -> str:
    """Observations to prefix sums: b (binned), t (tallies), g (dense), p (prefix sums)."""
    source = source or {f: f for f in cuts}
    b = " UNION ALL ".join(f"SELECT '{f}' AS feature, {_bin(source[f], own)} AS bin_id, treatment, outcome FROM line" for f, own in cuts.items())
    rows = [(f, i, repr(c) + "::DOUBLE" if i < len(own) else "NULL::DOUBLE", "false") for f, own in cuts.items() for i, c in enumerate([*own, 0.0])] + [(f, len(own) + 1, "NULL::DOUBLE", "true") for f, own in cuts.items()]
    bins = ", ".join(f"('{f}', {i}, {c}, {m})" for f, i, c, m in rows)
    return f"""WITH {_LINE}, b AS ({b}),
    t AS (SELECT feature, bin_id, treatment, count(*) AS opps, sum(outcome) AS accepts FROM b GROUP BY ALL),
    bins(feature, bin_id, bin_boundary, is_missing_bin) AS (VALUES {bins}),
    arms AS (SELECT DISTINCT treatment FROM t),
    g AS (SELECT bins.*, arms.treatment, coalesce(t.opps, 0) AS opps, coalesce(t.accepts, 0.0::DOUBLE) AS accepts
          FROM bins CROSS JOIN arms LEFT JOIN t ON t.feature = bins.feature AND t.bin_id = bins.bin_id AND t.treatment = arms.treatment),
    w AS (SELECT *, sum(opps) OVER u AS lc, sum(accepts) OVER u AS ls,
            sum(CASE WHEN NOT is_missing_bin THEN opps ELSE 0 END) OVER a AS ac, sum(CASE WHEN NOT is_missing_bin THEN accepts ELSE 0 END) OVER a AS asum,
            sum(CASE WHEN is_missing_bin THEN opps ELSE 0 END) OVER a AS mc, sum(CASE WHEN is_missing_bin THEN accepts ELSE 0 END) OVER a AS ms
          FROM g WINDOW u AS (PARTITION BY feature, treatment ORDER BY bin_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY feature, treatment)),
    p AS (SELECT feature, bin_id AS candidate_bin, bin_boundary, treatment, lc::BIGINT AS left_count_base, ls::DOUBLE AS left_sum_base, (ac - lc)::BIGINT AS right_count_base,
            (asum - ls)::DOUBLE AS right_sum_base, mc::BIGINT AS missing_count, ms::DOUBLE AS missing_sum FROM w WHERE NOT is_missing_bin AND bin_boundary IS NOT NULL)"""


_EXPANDED = """, d(nan_direction) AS (VALUES ('left'), ('right')),
    e AS (SELECT feature, candidate_bin, bin_boundary, nan_direction, treatment,
      left_count_base + CASE WHEN nan_direction = 'left' THEN missing_count ELSE 0 END AS left_count, left_sum_base + CASE WHEN nan_direction = 'left' THEN missing_sum ELSE 0 END AS left_sum,
      right_count_base + CASE WHEN nan_direction = 'right' THEN missing_count ELSE 0 END AS right_count, right_sum_base + CASE WHEN nan_direction = 'right' THEN missing_sum ELSE 0 END AS right_sum
      FROM p CROSS JOIN d),
    r AS (SELECT *, left_sum / nullif(left_count, 0) AS rl, right_sum / nullif(right_count, 0) AS rr, treatment = 'control' AS c FROM e)"""


def _scored(cuts: dict[str, list[float]], least: int, source: dict[str, str] | None = None) -> str:
    return f"""{_ctes(cuts, source)}{_EXPANDED},
    s AS (SELECT feature, candidate_bin, bin_boundary, nan_direction, sum(left_count)::BIGINT AS left_count, sum(left_sum)::DOUBLE AS left_sum, sum(right_count)::BIGINT AS right_count, sum(right_sum)::DOUBLE AS right_sum,
      min(least(left_count, right_count)) AS few, max(rl) FILTER (NOT c) - max(rl) FILTER (c) AS lh, min(rl) FILTER (NOT c) - max(rl) FILTER (c) AS ll,
      max(rr) FILTER (NOT c) - max(rr) FILTER (c) AS rh, min(rr) FILTER (NOT c) - max(rr) FILTER (c) AS rlo, bool_or(c) AND count(*) FILTER (NOT c) > 0 AS arms FROM r GROUP BY 1, 2, 3, 4),
    v AS (SELECT feature, candidate_bin, bin_boundary, nan_direction, left_count, left_sum, right_count, right_sum, CASE WHEN few > 0 THEN greatest(rh - ll, lh - rlo) END AS score,
      few > 0 AND arms AND least(left_count, right_count) >= {least} AND coalesce(greatest(rh - ll, lh - rlo) >= 0, false) AS is_valid, CASE WHEN nan_direction = 'right' THEN 0 ELSE 1 END AS tie_break_rank FROM s)"""


_RANK = "score DESC, bin_boundary ASC NULLS LAST, candidate_bin, tie_break_rank, feature"
_PRICE = {"l_extendedprice": CUTS["l_extendedprice"]}
_DENSE = {"l_extendedprice": [1.0, *CUTS["l_extendedprice"], 1e9]}
_SWEEP = {f"l_extendedprice#{k}": cuts for k, cuts in SWEEP.items()}
_FIT = "fit AS (SELECT l_orderkey, l_linenumber AS line, l_partkey, l_suppkey, CASE WHEN l_linenumber NOT IN (3, 5) THEN l_extendedprice::DOUBLE END AS p, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS di FROM lineitem)"


def _tree_sql(k: int, arm: int) -> str:
    leaf = [t["leaf_response_rates"] for t in FOREST]
    x = lambda i: f"{leaf[k][i][arm]!r}::DOUBLE"
    if k == 0:
        return f"CASE WHEN q <= 20 THEN {x(1)} WHEN p IS NOT NULL AND p <= 40000 THEN {x(3)} ELSE {x(4)} END"
    if k == 1:
        return f"CASE WHEN line = 2 THEN CASE WHEN di <= 0.05::DOUBLE THEN {x(3)} ELSE {x(4)} END ELSE {x(2)} END"
    return f"CASE WHEN p IS NULL OR p <= 30000 THEN {x(1)} ELSE {x(2)} END"


def _deep_sql() -> str:
    """Each tree's leaf by nested conditions, then the leaves' rates from lists."""
    columns = ", ".join(f"{views.DEEP_FEATURES[k % 4].replace('0D', '0::DOUBLE').replace('5D', '5::DOUBLE').replace('K', str(k))} AS d{k}" for k in range(DEEP_INPUTS))

    def walk(t: dict, i: int) -> str:
        if t["node_type"][i] == 0:
            return str(i)
        x = f"d{t['feature_idx'][i]}"
        test = f"{x} <= {float(t['thresholds'][i])!r}::DOUBLE" if t["node_type"][i] == 1 else f"{x} = {float(t['cat_value'][i])!r}::DOUBLE"
        go = f"coalesce({test}, {str(bool(t['nan_goes_left'][i])).lower()})"
        return f"CASE WHEN {go} THEN {walk(t, t['left_child'][i])} ELSE {walk(t, t['right_child'][i])} END"

    leaves = ", ".join(f"{walk(t, 0)} AS n{k}" for k, t in enumerate(DEEP_FOREST))
    listed = lambda t, a: "[" + ", ".join(f"{float(r)!r}::DOUBLE" for r in t["leaf_response_rates"][:, a]) + "]"
    arm = lambda a: "(" + " + ".join(f"{listed(t, a)}[n{k} + 1]" for k, t in enumerate(DEEP_FOREST)) + f") / {len(DEEP_FOREST)}.0::DOUBLE AS r{a}"
    return f"""WITH i AS (SELECT l_orderkey, l_linenumber AS line, l_partkey, l_suppkey, l_orderkey AS okey, l_quantity::DOUBLE AS quantity, l_discount::DOUBLE AS discount,
          CASE WHEN l_linenumber NOT IN (3, 5) THEN l_extendedprice::DOUBLE END AS price FROM lineitem),
        f AS (SELECT l_orderkey, line, l_partkey, l_suppkey, {columns} FROM i),
        l AS (SELECT l_orderkey, line, l_partkey, l_suppkey, {leaves} FROM f)
        SELECT l_orderkey, line, l_partkey, l_suppkey, {", ".join(arm(a) for a in range(4))} FROM l"""


def _faults_sql() -> str:
    """The ways up by the least parent, step by step, until they end or are longer than any tree."""
    return f"""WITH RECURSIVE g AS (SELECT p_partkey AS tree, p_partkey % 7 AS kind, unnest(range(0, 19))::INTEGER AS node FROM part),
        n AS (SELECT * FROM g WHERE node < 15 OR kind = 5),
        c AS (SELECT tree, node, CASE WHEN kind = 2 AND node = 3 THEN 1 WHEN kind = 4 AND node = 0 THEN 2 WHEN kind = 6 AND node = 5 THEN 99 WHEN kind = 5 AND node >= 14 THEN node + 1 ELSE 2 * node + 1 END AS l,
                CASE WHEN kind = 1 AND node = 6 THEN 0 WHEN kind = 3 AND node = 2 THEN 5 WHEN kind = 4 AND node = 4 THEN 1 WHEN kind = 5 AND node >= 14 THEN node + 2 ELSE 2 * node + 2 END AS r
              FROM n WHERE node < 7 OR kind = 5 AND node IN (14, 16)),
        k AS (SELECT tree, node AS parent, unnest([l, r]) AS node FROM c),
        m AS (SELECT tree, node, count(*) AS links, min(parent) AS parent FROM k GROUP BY tree, node),
        up AS (SELECT tree, node, node AS top, 0 AS steps FROM n
               UNION ALL SELECT up.tree, up.node, m.parent, steps + 1 FROM up JOIN m ON m.tree = up.tree AND m.node = up.top WHERE up.top <> 0 AND steps < 20),
        e AS (SELECT tree, node, max(steps) AS steps, arg_max(top, steps) AS top FROM up GROUP BY tree, node),
        f AS (SELECT e.*, coalesce(links, 0) AS links FROM e LEFT JOIN m USING (tree, node))
        SELECT tree, node, 'root_has_parent' AS fault FROM f WHERE node = 0 AND links > 0 UNION ALL SELECT tree, node, 'two_parents' FROM f WHERE links > 1
        UNION ALL SELECT tree, node, 'cycle' FROM f WHERE steps = 20 UNION ALL SELECT tree, node, 'unreachable' FROM f WHERE steps < 20 AND top <> 0
        UNION ALL SELECT tree, node, 'too_deep' FROM f WHERE steps BETWEEN {BUDGET + 1} AND 19 AND top = 0
        UNION ALL SELECT DISTINCT tree, parent, 'child_outside' FROM k WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tree = k.tree AND n.node = k.node)"""


def _forest_sql(arm: int) -> str:
    return "(" + " + ".join(_tree_sql(k, arm) for k in range(3)) + ") / 3.0::DOUBLE"


def _arm_sweep_sql() -> str:
    """The single-feature search for each number of arms, in place of the arms of ``line``."""
    rows = lambda n: f"line AS (SELECT l_extendedprice::DOUBLE AS price, (l_partkey % {n})::VARCHAR AS treatment, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome FROM lineitem)"
    best = _scored({"price": CUTS["l_extendedprice"]}, 1).replace("treatment = 'control' AS c", "treatment = '0' AS c")
    parts = [f"({best.replace(_LINE, rows(n))} SELECT *, {n}::INTEGER AS config FROM v WHERE is_valid ORDER BY {_RANK} LIMIT 1)" for n in ARMS]
    return " UNION ALL ".join(f"SELECT * FROM {p} AS s{k}" for k, p in enumerate(parts))


_FOREST_SQL = f"WITH {_FIT} SELECT l_orderkey, line, l_partkey, l_suppkey, " + ", ".join(f"{_forest_sql(a)} AS r{a}" for a in range(3)) + " FROM fit"
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM line" for c in views.LINE_FEATURES)

ORACLES = {
    "observations": f"WITH {_LINE} SELECT * FROM line",
    "impute_zero": f"WITH {_LINE}, i AS (SELECT coalesce(l_extendedprice, 0.0::DOUBLE) AS price, coalesce(l_quantity, 0.0::DOUBLE) AS quantity FROM line) SELECT *, CASE WHEN price > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM i",
    "thresholds_quantile": f"WITH {_LINE}, v AS ({_LONG}), q AS (SELECT feature, unnest(quantile_disc(x, [{', '.join(str(i / 16) for i in range(1, 16))}])) AS cut FROM v GROUP BY feature) SELECT DISTINCT feature, cut FROM q",
    "quantile_ranks": "SELECT DISTINCT feature, quantile, true AS within FROM (SELECT unnest([{}]) AS feature FROM lineitem), (SELECT unnest(range(1, 16))::INTEGER AS quantile)".format(", ".join(f"'{f}'" for f in views.LINE_FEATURES)),
    "thresholds_equal_width": f"WITH {_LINE}, v AS ({_LONG}), m AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM v GROUP BY feature) SELECT DISTINCT feature, lo + (hi - lo) * i / 16 AS cut FROM m CROSS JOIN (SELECT unnest(range(1, 16)) AS i)",
    "boundaries": f"{_ctes(CUTS)} SELECT DISTINCT feature, bin_boundary FROM p",
    "bin_assign": f"{_ctes(CUTS)} SELECT feature, bin_id, count(*) AS n_rows FROM b GROUP BY ALL",
    "bin_tallies": f"{_ctes(CUTS)} SELECT t.feature, t.bin_id, is_missing_bin, treatment, opps, accepts FROM t JOIN bins ON t.feature = bins.feature AND t.bin_id = bins.bin_id",
    "bin_tallies_dense": f"{_ctes(_DENSE)} SELECT feature, bin_id, is_missing_bin, treatment, opps, accepts FROM g",
    "prefix_sums": f"{_ctes(CUTS)} SELECT * FROM p",
    "nan_expanded": f"{_ctes(_PRICE)}{_EXPANDED} SELECT * FROM e",
    "control_arm": "SELECT 'control' AS treatment, 'line' AS view WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT min(c_mktsegment), 'order' FROM customer JOIN orders ON o_custkey = c_custkey",
    "arm_rates": f"""{_ctes(_PRICE)}{_EXPANDED}, k AS (SELECT *, max(CASE WHEN c THEN rl END) OVER o AS cl, max(CASE WHEN c THEN rr END) OVER o AS cr FROM r WINDOW o AS (PARTITION BY feature, candidate_bin, nan_direction))
        SELECT feature, candidate_bin, bin_boundary, nan_direction, treatment, rl AS left_rate, rr AS right_rate, CASE WHEN NOT c THEN rl - cl END AS left_uplift, CASE WHEN NOT c THEN rr - cr END AS right_uplift FROM k""",
    "scored_candidates": f"{_scored(CUTS, 100)} SELECT * FROM v",
    "scored_candidates_pandas": f"{_scored(CUTS, 100)} SELECT * FROM v",
    "best_split": f"{_scored(_PRICE, 1)} SELECT * FROM v WHERE is_valid ORDER BY {_RANK} LIMIT 1",
    "best_split_multi": f"{_scored(CUTS, 1)} SELECT * FROM v WHERE is_valid ORDER BY {_RANK} LIMIT 1",
    "best_split_per_feature": f"{_scored(CUTS, 1)} SELECT * FROM v WHERE is_valid QUALIFY row_number() OVER (PARTITION BY feature ORDER BY {_RANK}) = 1",
    "bin_sweep": f"{_scored(_SWEEP, 1, dict.fromkeys(_SWEEP, 'l_extendedprice'))} SELECT * REPLACE ('l_extendedprice' AS feature), split_part(feature, '#', 2)::INTEGER AS config FROM v WHERE is_valid QUALIFY row_number() OVER (PARTITION BY feature ORDER BY {_RANK}) = 1",
    "determinism": f"{_scored(_PRICE, 1)} SELECT count(*) AS distinct_choices FROM (SELECT * FROM v WHERE is_valid ORDER BY {_RANK} LIMIT 1)",
    "determinism_real": f"""WITH {_LINE.replace("CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "l_extendedprice::DOUBLE * (1.0::DOUBLE - l_discount::DOUBLE)")},
        b AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {_bin(f, own)} AS bin_id, treatment, outcome FROM line" for f, own in CUTS.items())}),
        s AS (SELECT feature, bin_id, treatment, count(*) AS opps, sum((outcome * 281474976710656.0::DOUBLE)::HUGEINT) AS q FROM b GROUP BY ALL)
        SELECT feature, bin_id, treatment, 1::BIGINT AS versions, opps, (q // 281474976710656)::DOUBLE + (q % 281474976710656)::DOUBLE / 281474976710656.0::DOUBLE AS accepts FROM s""",
    "sample_first_n": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000",
    "run_summary": "SELECT l_returnflag AS mode, avg(l_linenumber::DOUBLE) AS avg_value, min(l_linenumber::DOUBLE) AS min_value, max(l_linenumber::DOUBLE) AS max_value FROM lineitem GROUP BY 1",
    "forest_json_nodes": f"""WITH {_FIT}, n AS (
        SELECT 0 AS tree, 0 AS node, 1 AS node_type, 'l_quantity' AS feature, coalesce(q <= 20, true) AS l FROM fit UNION ALL SELECT 0, 2, 1, 'l_extendedprice', coalesce(p <= 40000, false) FROM fit
        UNION ALL SELECT 1, 0, 2, 'l_linenumber', coalesce(line = 2, false) FROM fit UNION ALL SELECT 1, 1, 1, 'l_discount', coalesce(di <= 0.05::DOUBLE, false) FROM fit
        UNION ALL SELECT 2, 0, 1, 'l_extendedprice', coalesce(p <= 30000, true) FROM fit)
        SELECT tree, node, node_type::BIGINT AS node_type, feature, count(*) FILTER (l) AS rows_left, count(*) AS rows_all FROM n GROUP BY 1, 2, 3, 4""",
    "forest_invalid_nodes": f"{_scored(CUTS, 1)} SELECT DISTINCT 3 AS tree, 0 AS node, 9 AS feature_idx FROM v WHERE is_valid AND feature = 'l_tax'",
    "forest_faults": _faults_sql(),
    "tree_scores": f"WITH {_FIT} SELECT l_orderkey, line, l_partkey, l_suppkey, " + ", ".join(f"{_tree_sql(0, a)} AS r{a}" for a in range(3)) + " FROM fit",
    "forest_scores": _FOREST_SQL,
    "forest_scores_pandas": _FOREST_SQL,
    "forest_scores_expr": _FOREST_SQL,
    "score_contract": f"SELECT count(*) FILTER (r0 IS NULL OR r1 IS NULL OR r2 IS NULL) AS violations FROM ({_FOREST_SQL})",
    "score_checksum": f"SELECT round(sum(r0 + r1 + r2), 3) AS checksum FROM ({_FOREST_SQL})",
    "scalar_checksum": "SELECT round(sum(l_quantity::DOUBLE), 3) AS checksum FROM lineitem",
    "score_pairs": "SELECT count(*) AS n_rows, 0::BIGINT AS unpaired, 0::BIGINT AS repeated, 0::BIGINT AS arrow_pandas, 0::BIGINT AS arrow_native FROM lineitem",
    "line_pairs": "SELECT count(*) AS n_rows, 0::BIGINT AS unpaired, count(*) FILTER (n > 1) AS repeated, 0::BIGINT AS arrow_native FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "arm_sweep": _arm_sweep_sql(),
    "best_split_wide": f"{_scored(WIDE_CUTS, 1, {f: f'(l_extendedprice * {float(1 + k % 7)!r}::DOUBLE + l_quantity * {float(k)!r}::DOUBLE)' for k, f in enumerate(WIDE_CUTS)})} SELECT * FROM v WHERE is_valid QUALIFY row_number() OVER (PARTITION BY feature ORDER BY {_RANK}) = 1",
    "deep_forest_scores": _deep_sql(),
    "deep_forest_blocks": _deep_sql(),
    "result_rows_csv": f"{_scored(CUTS, 100)} SELECT * FROM v",
    "score_parity": "SELECT count(*) AS n_rows, 0::BIGINT AS mismatches FROM lineitem",
}
