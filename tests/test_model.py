import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from market import tables
from ordermill.models import attribution, evaluation, forest, node_table, review_model
from ordermill.operators.shaping import inline_rows
from ordermill.plans import features
from ordermill.session import scratch_path, written


def test_feature_table(spark):
    out = {r.order_id: r for r in features.feature_table(tables(spark)).collect()}
    assert set(out) == {"o1", "o2", "o6", "o7"}
    o1 = out["o1"]
    assert (o1.category, o1.item_count, o1.cross_state, o1.payment_type, o1.max_installments,
            o1.is_low_review) == ("books", 3, 1, "credit_card", 3, 0)
    # equal top prices: the first item decides; both sellers sit in the customer's state
    assert (out["o6"].category, out["o6"].cross_state) == ("toys", 0)
    # no items at all: nulls stay, and the row is not used by a model
    assert (out["o7"].category, out["o7"].item_count, out["o7"].cross_state) == ("unknown", None, None)
    assert features.model_rows(features.feature_table(tables(spark))).count() == 3


def labelled(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("order_id"),
                                 (F.col("id") % 8 == 0).cast("int").alias("is_low_review"))


def test_split_is_exact_stratified_and_repeatable(many_partitions):
    df = labelled(many_partitions)
    split = features.stratified_split(df)
    counts = {(r.is_test, r.is_low_review): r["count"] for r in
              split.groupBy("is_test", "is_low_review").count().collect()}
    assert counts == {(True, 1): 25, (True, 0): 175, (False, 1): 100, (False, 0): 700}
    again = features.stratified_split(df.repartition(9))
    assert split.exceptAll(again).count() == 0
    other = features.stratified_split(df, seed=7)
    assert split.filter("is_test").exceptAll(other.filter("is_test")).count() > 0


def test_split_cut_is_found_by_counting(many_partitions, monkeypatch):
    monkeypatch.setattr(features, "_DIGITS", 1)
    monkeypatch.setattr(features, "_NEAR", 3)  # several rounds, then a few rows are ordered
    df = labelled(many_partitions, 2000)
    order = Window.partitionBy("is_low_review").orderBy("h", "order_id")
    want = df.withColumn("h", features.hash_order("order_id", features.SEED)).withColumn("rn", F.row_number().over(order)) \
             .withColumn("is_test", F.col("rn") <= F.when(F.col("is_low_review") == 1, 50).otherwise(350)).drop("h", "rn")
    assert features.stratified_split(df).exceptAll(want).count() == 0
    assert features.stratified_split(df.filter("order_id < 3")).filter("is_test").count() == 0
    assert features.stratified_split(df.limit(0)).count() == 0


def test_weights(spark):
    got = {r.is_low_review: (r.n, r.weight, r.imbalance_ratio)
           for r in features.balanced_weights(labelled(spark, 800)).collect()}
    assert got == {0: (700, 800 / 1400, 7.0), 1: (100, 4.0, 7.0)}


def test_levels_fold_below_the_limit_and_when_unseen(spark):
    train = spark.range(999).select(F.when(F.col("id") < 500, "often").otherwise("rare").alias("c"))
    known = features.frequent_levels(train, "c", 500)
    assert known == ["often"]
    df = inline_rows(spark, [("often",), ("rare",), ("new",), (None,)], "c string")
    assert [r[0] for r in df.select(features.fold_level(F.col("c"), known)).collect()] == [
        "often", "infrequent", "infrequent", "infrequent"]
    with pytest.raises(ValueError):
        features.frequent_levels(train, "c", 1, max_levels=1)


def test_scaling(spark):
    train = inline_rows(spark, [(1, 5), (2, 5), (3, 5)], "a int, b int")
    stats = features.moments(train, ["a", "b"]).first().asDict()
    got = [tuple(r) for r in train.select(features.scaled("a", stats), features.scaled("b", stats)).collect()]
    assert [g[0] for g in got] == pytest.approx([-1.5 ** 0.5, 0, 1.5 ** 0.5])
    assert [g[1] for g in got] == [0.0, 0.0, 0.0]


def brute(scores, labels):
    """ROC-AUC over all pairs, average precision over distinct thresholds."""
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y)
        recall, precision = tp / len(pos), tp / sum(s >= t for s in scores)
        ap += (recall - seen) * precision
        seen = recall
    return auc, ap


def test_ranking_metrics_with_ties(many_partitions):
    rng = np.random.default_rng(5)
    scores = [float(s) for s in rng.integers(0, 40, 500) / 40]
    labels = [int(y) for y in rng.random(500) < np.array(scores) * 0.5]
    df = inline_rows(many_partitions, list(zip(scores, labels)), "p double, y int")
    row = evaluation.ranking_metrics(df, "p", "y").first()
    assert (row.roc_auc, row.pr_auc) == pytest.approx(brute(scores, labels))
    doubled = df.withColumn("g", F.lit("a")).union(df.select(1 - F.col("p"), "y", F.lit("b")))
    by = {r.g: (r.roc_auc, r.pr_auc) for r in evaluation.ranking_metrics(doubled, "p", "y", ["g"]).collect()}
    assert by["a"] == pytest.approx(brute(scores, labels))
    assert by["b"] == pytest.approx(brute([1 - s for s in scores], labels))


def test_small_score_example(spark):
    df = inline_rows(spark, [(0.9, 1), (0.9, 0), (0.4, 1), (0.4, 0), (0.1, 0)], "p double, y int")
    assert evaluation.threshold_metrics(df, "p", "y").first() == (0.5, 0.5, 0.5)
    assert [tuple(r) for r in evaluation.confusion(df, "p", "y").collect()] == [
        ("true_ok", 2, 1), ("true_low", 1, 1)]
    assert evaluation.confusion_report(df, "p", "y").first() == (5, 2, 2, 1, 0.4, 0.5, 0.5)
    nothing = evaluation.threshold_metrics(df, "p", "y", 2.0).first()
    assert tuple(nothing) == (0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def planted(spark):
    """Orders where a long delay makes a low review likely, and nothing else matters."""
    h = F.pmod(F.xxhash64("order_id"), F.lit(1000)) / 1000
    base = spark.range(3000).withColumnRenamed("id", "order_id").withColumn("h", h)
    return base.selectExpr(
        "order_id", "cast(order_id * 7 % 40 - 20 as int) as delivery_delay_days",
        "cast(order_id % 30 as int) as delivery_days", "cast(order_id % 97 as decimal(12,2)) as price_total",
        "cast(order_id % 13 as decimal(12,2)) as freight_total", "order_id % 3 + 1 as item_count",
        "if(order_id % 5 = 0, 'toys', 'books') as category", "cast(order_id % 2 as int) as cross_state",
        "'credit_card' as payment_type", "cast(order_id % 11 + 1 as int) as max_installments",
        "cast(h < if(order_id * 7 % 40 - 20 > 5, 0.8D, 0.1D) as int) as is_low_review")


@pytest.fixture(scope="module")
def fitted(spark, planted):
    """Small models of every kind, saved, with the rows that they were fitted on and those they were not."""
    split = written(features.stratified_split(planted), "split")
    train, test = split.filter("not is_test").drop("is_test"), split.filter("is_test").drop("is_test")
    options = {"logistic_regression": {"max_iter": 50}, "random_forest": {"trees": 10, "max_depth": 5},
               "boosted_trees": {"rounds": 5, "max_depth": 3}}
    return train, test, options, review_model.saved_models(train, options, 100)


def test_models_find_the_planted_signal(spark, fitted):
    train, test, options, models = fitted
    prevalence = test.agg(F.avg("is_low_review")).first()[0]
    out = {r.model: r for r in review_model.compare(train, test, options, min_count=100).collect()}
    assert set(out) == {"logistic_regression", "random_forest", "boosted_trees"}
    for row in out.values():
        assert row.pr_auc > prevalence * 1.3 and row.roc_auc > 0.75
    for name in ("random_forest", "boosted_trees"):
        assert models[name].importance(12).first().feature == "delivery_delay_days"
        parts = attribution.tree_attribution(models[name], test).collect()
        assert parts[0].feature == "delivery_delay_days" and parts[0].mean_abs > 3 * parts[1].mean_abs
    drops = attribution.permutation_importance(models["boosted_trees"], features.sample_rows(test, 400)).collect()
    assert len(drops) == 9 and drops[0].feature == "delivery_delay_days"
    assert drops[0].pr_auc_drop > 0.1 > abs(drops[-1].pr_auc_drop)
    linear = models["logistic_regression"]
    parts = attribution.linear_attribution(linear, test).collect()
    assert parts[0].feature == "delivery_delay_days" and len(parts) == len(linear.names)


def test_a_fit_repeats_and_is_read_again(spark, fitted, monkeypatch):
    train, test, options, models = fitted
    preparation = review_model.prepare(train, 100)
    again = review_model.fit(train.repartition(5), "boosted_trees", preparation, rounds=5, max_depth=3)
    top = review_model.risk_rank(again, test, 10).collect()
    assert [r.order_id for r in top] == [r.order_id for r in review_model.risk_rank(models["boosted_trees"], test, 10).collect()]
    monkeypatch.setattr(review_model, "ESTIMATORS", {})  # nothing is fitted any more
    read = review_model.saved_models(train.repartition(3), options, 100)
    assert read["boosted_trees"].nodes.count() == models["boosted_trees"].nodes.count()
    with pytest.raises(KeyError):
        review_model.saved_models(train.limit(100), {"boosted_trees": options["boosted_trees"]}, 100)


@pytest.mark.parametrize("name", ["random_forest", "logistic_regression", "boosted_trees"])
def test_models_score_after_rows_were_observed(spark, fitted, name, tmp_path):
    train, test, options, _ = fitted
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).write.parquet(f"{tmp_path}/seen")
    assert seen.get == {"n": 3}
    model = review_model.fit(train, name, review_model.prepare(train, 100), **options[name])
    assert model.score(test).filter("risk between 0 and 1").count() == test.count()


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees", "logistic_regression"])
def test_saved_models_score_as_the_library_does(spark, fitted, name):
    train, test, options, models = fitted
    model = review_model.fit(train, name, review_model.prepare(train, 100), **options[name])
    want = {r.order_id: r.risk for r in model.score(test).collect()}
    got = {r.order_id: r.risk for r in models[name].score(test).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    if name == "logistic_regression":
        return
    shares = model.fitted.featureImportances.toArray()
    named = {n.split("__")[1]: float(v) for n, v in zip(models[name].names, shares)}
    assert {r.feature: r.importance for r in models[name].importance(99).collect()} == pytest.approx(named, abs=1e-9)


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees"])
def test_contributions_add_up_on_every_row(spark, fitted, name):
    _, test, _, models = fitted
    model = models[name]
    both = model.contributions(model.scored(test)).select(
        "score", (F.col("base") + F.aggregate("parts", F.lit(0.0), lambda a, b: a + b)).alias("sum"), "parts").collect()
    assert len(both) == test.count()
    assert [r["sum"] for r in both] == pytest.approx([r.score for r in both], abs=1e-9)
    assert any(abs(p) > 0.01 for p in both[0].parts)


def test_nodes_follow_plain_sql(spark, fitted, tmp_path):
    """The written nodes of a fitted ensemble, scored by another engine."""
    _, test, _, models = fitted
    model = models["boosted_trees"]
    model.nodes.toPandas().to_parquet(f"{tmp_path}/nodes.parquet")
    test.select("order_id", F.posexplode(model.features()).alias("feature", "x")).toPandas().to_parquet(f"{tmp_path}/cells.parquet")
    want = duckdb.sql(f"""with recursive n as (select * from '{tmp_path}/nodes.parquet'), c as (select * from '{tmp_path}/cells.parquet'),
        walk as (select order_id, n.* from (select distinct order_id from c) cross join n where node = 0
          union all select w.order_id, m.* from walk w join c on c.order_id = w.order_id and c.feature = w.feature
            join n m on m.tree = w.tree and m.node = case when c.x <= w.cut then w.low else w.high end where w.low is not null)
        select order_id, sum(value) from walk where low is null group by 1""").fetchall()
    got = {r.order_id: r.score for r in model.scored(test).collect()}
    assert got == pytest.approx(dict(want), abs=1e-12)


@pytest.mark.parametrize("walked", [3, 4096])
def test_batches_of_rows_walk_the_trees_as_single_rows_do(spark, monkeypatch, walked):
    monkeypatch.setattr(node_table, "WALKED", walked)
    rng = np.random.default_rng(11)
    trees = []
    for tree in range(8):  # of any shape; one is a single leaf
        nodes = [[tree, 0, None, None, None, None, float(rng.normal()), None]]
        for node in range(0 if tree == 3 else 9):
            if node < len(nodes) and rng.random() < 0.8:
                n = len(nodes)
                nodes[node][2:6] = int(rng.integers(0, 3)), float(rng.normal()), n, n + 1
                nodes += [[tree, n + i, None, None, None, None, float(rng.normal()), None] for i in range(2)]
        trees.append(nodes)
    rows = [(i, [None if rng.random() < 0.1 else float("nan") if rng.random() < 0.1 else float(rng.normal()) for _ in range(3)])
            for i in range(50)]
    shared = node_table.shared_nodes(inline_rows(spark, [tuple(n) for t in trees[::-1] for n in t[::-1]], node_table.NODES))
    df = inline_rows(spark, rows, "id int, x array<double>").repartition(2)
    out = df.select("id", node_table.tree_sums(shared, F.col("x"), 4, 3).alias("s"), node_table.tree_parts(shared, F.col("x"), 4, 3).alias("p"))
    # every node is reached by array access, not by functions that are interpreted for each row and node
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.s, r.p) for r in out.collect()}
    for i, x in rows:
        total, parts = 0.0, [0.0] * 3
        for nodes in trees:
            at, own = 0, [0.0] * 3
            for _ in range(4):
                _, _, feature, cut, low, high, value, _ = nodes[at]
                if low is None:
                    break
                at = low if x[feature] is not None and x[feature] <= cut else high
                own[feature] += nodes[at][6] - value
            total += nodes[at][6]
            parts = [a + b for a, b in zip(parts, own)]
        assert got[i] == (total, parts)


def test_too_many_nodes_are_not_broadcast(spark, fitted, monkeypatch):
    _, test, _, models = fitted
    monkeypatch.setattr(node_table, "MAX_NODES", 10)
    with pytest.raises(ValueError, match="too many"):
        models["boosted_trees"].score(test)


def test_preparation_names_match_the_vector(spark, planted):
    preparation = review_model.prepare(planted, 100)
    row = preparation.apply(planted.limit(1)).first()
    assert row.features.size == len(preparation.names)
    assert preparation.names[7:] == ["cat__category_books", "cat__category_infrequent", "cat__category_toys",
                                     "cat__payment_type_credit_card", "cat__payment_type_infrequent"]
    unseen = preparation.apply(planted.limit(1).withColumn("category", F.lit("new"))).first()
    assert unseen.features.toArray()[8] == 1.0


def test_moments_of_constant_and_nearly_constant_columns(spark):
    rows = [(12345.67, 1e6 + 0.01 * (i % 2)) for i in range(3 * 4)]
    df = spark.createDataFrame(rows, "a double, b double")
    stats = features.moments(df, ["a", "b"]).first().asDict()
    assert stats["a__std"] == 0.0
    assert abs(stats["b__std"] - 0.005) < 1e-9
    assert df.select(features.scaled("a", stats)).distinct().collect() == [(0.0,)]


def test_a_row_without_label_stops_the_split(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "order_id int, is_low_review int")
    with pytest.raises(Exception, match="has no"):
        features.stratified_split(df).collect()


def test_trees_are_scored_some_at_a_time(spark, fitted, monkeypatch):
    _, test, _, models = fitted
    want = {r.order_id: r.risk for r in models["random_forest"].score(test).collect()}
    most = models["random_forest"].nodes.groupBy("tree").count().agg(F.max("count")).first()[0]
    monkeypatch.setattr(node_table, "MAX_NODES", 2 * most)  # all ten trees are more
    assert {r.order_id: r.risk for r in models["random_forest"].score(test).collect()} == want


@pytest.mark.parametrize("rows, few", [(3000, 400), (12_500, 5000)])
def test_trees_grown_on_counts_are_the_librarys(spark, monkeypatch, rows, few):
    """More rows than the library draws its cuts from, several partitions and chunks, a saved model, scores checkpointed."""
    h = F.pmod(F.xxhash64("order_id"), F.lit(1000)) / 1000
    train = spark.range(rows).withColumnRenamed("id", "order_id").withColumn("h", h).selectExpr(
        "order_id", "cast(order_id * 7 % 40 - 20 as int) as delivery_delay_days", "cast(xxhash64(order_id, 1) % 60 as int) as delivery_days",
        "cast(xxhash64(order_id, 2) % 9973 as decimal(12,2)) as price_total", "cast(7 as decimal(12,2)) as freight_total",
        "pmod(xxhash64(order_id, 3), 4) + 1 as item_count", "element_at(array('toys', 'books', 'art'), cast(order_id % 3 + 1 as int)) as category",
        "cast(order_id % 2 as int) as cross_state", "if(order_id % 7 = 0, 'boleto', 'credit_card') as payment_type",
        "cast(order_id % 11 + 1 as int) as max_installments",
        "cast(h < if(order_id * 7 % 40 - 20 > 5, 0.7D, 0.1D) + order_id % 3 * 0.1D as int) as is_low_review")
    preparation = review_model.prepare(train, 100)
    vectors = review_model.prepared(train, preparation)
    settings = {"rounds": 6, "max_depth": 4}
    library = review_model.fit(train, "boosted_trees", preparation, rows=vectors, **settings)
    monkeypatch.setattr(review_model, "COUNTED_ROWS", 1000)
    for name, value in (("FEW", few), ("CHUNK", 700), ("KEPT", 2)):
        monkeypatch.setattr(review_model.boosting, name, value)
    counted = review_model.fit(train, "boosted_trees", preparation, rows=vectors, **settings)
    assert isinstance(counted.fitted, review_model.boosting.BoostedTrees)
    want = {r.order_id: r.risk for r in library.score(train).collect()}
    assert {r.order_id: r.risk for r in counted.score(train).collect()} == pytest.approx(want, abs=1e-12)
    assert counted.fitted.featureImportances.toArray() == pytest.approx(library.fitted.featureImportances.toArray(), abs=1e-9)
    saved = review_model.saved_models(train, {"boosted_trees": settings}, 100)["boosted_trees"]
    assert {r.order_id: r.risk for r in saved.score(train).collect()} == pytest.approx(want, abs=1e-12)


def test_cuts_part_the_weight_evenly():
    cuts_of = review_model.boosting.cuts_of
    one = np.ones(8)
    assert cuts_of(np.array([1.0, 2, 2, 3, 1, 2, 3, 3]), one, 8.0, 31).tolist() == [1.5, 2.5]
    assert cuts_of(np.arange(1.0, 9), one, 8.0, 3).tolist() == [2.5, 4.5, 6.5]
    assert cuts_of(np.array([0.0, 0, 0, 4, 4, 4, 4, 4]), one, 8.0, 31).tolist() == [2.0]  # zeros weigh the rest
    assert cuts_of(np.zeros(8), one, 8.0, 31).tolist() == []


def test_features_share_cells():
    cuts = [np.arange(n) for n in (31, 31, 0, 7, 1, 300)]
    groups = review_model.boosting.grouped(cuts)
    assert sorted(f for g in groups for f, _, _ in g) == [0, 1, 3, 4, 5]
    assert all(review_model.boosting.width(g) <= 256 or len(g) == 1 for g in groups)


def odd_vectors(spark, rows):
    h = F.pmod(F.xxhash64("order_id"), F.lit(1000)) / 1000
    train = spark.range(rows).withColumnRenamed("id", "order_id").withColumn("h", h).selectExpr(
        "order_id", "cast(order_id * 7 % 40 - 20 as int) as delivery_delay_days", "cast(xxhash64(order_id, 1) % 60 as int) as delivery_days",
        "cast(xxhash64(order_id, 2) % 9973 as decimal(12,2)) as price_total", "cast(7 as decimal(12,2)) as freight_total",
        "pmod(xxhash64(order_id, 3), 4) + 1 as item_count", "element_at(array('toys', 'books', 'art'), cast(order_id % 3 + 1 as int)) as category",
        "cast(order_id % 2 as int) as cross_state", "if(order_id % 7 = 0, 'boleto', 'credit_card') as payment_type",
        "cast(order_id % 11 + 1 as int) as max_installments",
        "cast(h < if(order_id * 7 % 40 - 20 > 5, 0.7D, 0.1D) + order_id % 3 * 0.1D as int) as is_low_review")
    preparation = review_model.prepare(train, 100)
    return train, preparation, review_model.prepared(train, preparation)


@pytest.mark.parametrize("rows, depth, least", [(3000, 30, 5), (12_500, 12, 5)])
def test_a_tree_grown_by_one_task_is_the_librarys(spark, monkeypatch, rows, depth, least):
    """All rows and features, as the random numbers are others: the same splits, but where gains tie."""
    monkeypatch.setattr(review_model, "PART_ROWS", 2000)
    train, _, vectors = odd_vectors(spark, rows)
    weights = {0: 1.0, 1: 2.0}
    library = RandomForestClassifier(
        labelCol="is_low_review", weightCol="weight", numTrees=1, maxDepth=depth, minInstancesPerNode=least, bootstrap=False,
        featureSubsetStrategy="all", seed=features.SEED).fit(vectors.withColumn("weight", F.col("is_low_review") + F.lit(1.0)))
    labels = {r.is_low_review: (r["count"], weights[r.is_low_review]) for r in train.groupBy("is_low_review").count().collect()}
    own = forest.forest(vectors.withColumnRenamed("is_low_review", "label"), labels, 1, depth, least, features.SEED, drawn=False)
    path = scratch_path(spark, "library")
    library.write().save(path)
    trees = [{r.node: r for r in nodes.collect()} for nodes in (node_table.nodes_of(spark, path)[0], own.nodes)]
    todo, same, ties = [(0, 0)], 0, 0
    while todo:
        want, got = (tree[n] for tree, n in zip(trees, todo.pop()))
        assert (got.low is None) == (want.low is None) and got.value == pytest.approx(want.value, abs=1e-12)
        assert want.low is None or got.gain == pytest.approx(want.gain, rel=1e-9)
        if (want.feature, want.cut) == (got.feature, got.cut):
            same += 1
            todo += [] if want.low is None else [(want.low, got.low), (want.high, got.high)]
        else:
            ties += 1
    assert ties <= same / 20 and abs(len(trees[0]) - len(trees[1])) <= len(trees[0]) / 50
    assert own.featureImportances.toArray() == pytest.approx(library.featureImportances.toArray(), abs=0.01)


def test_many_rows_are_fitted_tree_by_tree(spark, monkeypatch):
    train, preparation, vectors = odd_vectors(spark, 6000)
    test = train.filter("order_id % 5 = 0")
    train, vectors = train.filter("order_id % 5 > 0"), vectors.filter("order_id % 5 > 0")
    settings = {"trees": 16}
    library = review_model.fit(train, "random_forest", preparation, rows=vectors, **settings)
    monkeypatch.setattr(review_model, "SIDE_BY_SIDE_ROWS", 4000)
    own, again = (review_model.fit(train, "random_forest", preparation, rows=vectors, **settings) for _ in range(2))
    assert isinstance(own.fitted, forest.ForestTrees)
    nodes = own.fitted.nodes
    assert nodes.exceptAll(again.fitted.nodes).count() == 0  # a seed repeats its result
    sizes = [r["count"] for r in nodes.groupBy("tree").count().collect()]
    assert len(sizes) == 16 and len(set(sizes)) > 1  # every tree has rows and features of its own
    assert np.mean(sizes) == pytest.approx(library.fitted.totalNumNodes / 16, rel=0.25)
    want, got = (evaluation.all_metrics(m.score(test), "risk", "is_low_review").first() for m in (library, own))
    assert got.roc_auc == pytest.approx(want.roc_auc, abs=0.02) and got.pr_auc == pytest.approx(want.pr_auc, abs=0.03)
    assert own.fitted.featureImportances.toArray() == pytest.approx(library.fitted.featureImportances.toArray(), abs=0.02)
    saved = review_model.as_saved(spark, own, scratch_path(spark, "model"))
    risk = [{r.order_id: r.risk for r in m.score(test).collect()} for m in (own, saved)]
    assert risk[1] == pytest.approx(risk[0], abs=1e-12)
    monkeypatch.setattr(review_model, "MAX_ROWS", 4500)  # too many rows for deep trees; others go to the library
    assert review_model.random_forest(vectors, 2, 3).totalNumNodes > 2
    with pytest.raises(ValueError, match="too many nodes"):
        review_model.random_forest(vectors, 2)


def test_nodes_of_a_tree_by_hand():
    """Feature 0 has three bins, feature 1 two; the labels follow feature 0 beyond its first bin, and nothing else parts them."""
    rng, weights = np.random.default_rng(0), np.array([1.0, 1.0])
    x = np.repeat([[0, 0], [1, 1], [2, 0]], 6, axis=0)
    labels = np.repeat([0, 0, 1], 6).astype(np.uint8)
    cuts = [np.array([0.5, 1.5]), np.array([0.5]), np.array([])]
    groups = review_model.boosting.grouped(cuts)
    cells = np.stack([sum(x[:, f] * stride for f, stride, _ in g) for g in groups]).astype(np.uint8)
    table = forest.table_of(cells, labels, cuts, groups)
    tree = forest.grown(table, rng, np.ones(18, np.uint8), weights, 30, 5, 3)
    assert tree["low"].tolist() == [1, -1, -1] and (tree["feature"][0], tree["cut"][0]) == (0, 1)
    assert tree["whole"].tolist() == [[12, 6], [12, 0], [0, 6]]
    assert tree["gain"][0] == pytest.approx(4 / 9)
    # too few drawn rows on a side, no depth, a single label, siblings that predict the same label: one leaf
    for counts, least, depth in ((1, 7, 30), (1, 5, 0)):
        assert len(forest.grown(table, rng, np.full(18, counts, np.uint8), weights, depth, least, 3)["low"]) == 1
    assert len(forest.grown(forest.table_of(cells, labels * 0, cuts, groups), rng, np.ones(18, np.uint8), weights, 30, 5, 3)["low"]) == 1
    assert len(forest.grown(table, rng, np.ones(18, np.uint8), np.array([1.0, 0.01]), 1, 7, 3)["low"]) == 1
    # a row drawn twice counts twice
    assert forest.grown(table, rng, np.full(18, 2, np.uint8), weights, 30, 7, 3)["whole"][0].tolist() == [24, 12]


def test_features_are_drawn_like_a_reservoirs():
    drawn = forest.drawn_features(np.random.default_rng(3), 20_000, 7, 3)
    assert all(len(set(row)) == 3 for row in drawn[:500].tolist())
    assert np.bincount(drawn.ravel(), minlength=7) / 20_000 == pytest.approx(np.full(7, 3 / 7), abs=0.02)
    assert forest.drawn_features(np.random.default_rng(3), 2, 3, 3).tolist() == [[0, 1, 2]] * 2
    assert forest.drawn_rows(np.random.default_rng(3), 200_000).mean() == pytest.approx(1, abs=0.01)


def test_parted_rows_and_chunks(monkeypatch):
    rows, sides = forest.parted(np.array([True, False, True, False, False, True]), np.array([4, 2]), np.arange(10, 16))
    assert rows.tolist() == [11, 13, 10, 12, 14, 15] and sides.tolist() == [2, 2, 1, 1]
    monkeypatch.setattr(forest, "CHUNK", 5)
    assert list(forest.chunks(np.array([2, 3, 9, 1, 1, 4]))) == [(0, 2), (2, 3), (3, 5), (5, 6)]
