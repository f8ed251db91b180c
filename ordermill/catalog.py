"""Every registered query: name -> function of (session, folder of generic parquet tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.models import attribution, evaluation, node_table, review_model
from ordermill.operators import cleaning, quality, shaping
from ordermill.operators.shaping import inline_rows, union_rows
from ordermill.plans import explore, features, metrics, pages, questions, sketches, star
from ordermill.schemas import CLEAN_TABLES, CONSTRAINTS, DATE_COLUMNS, RAW, Rule
from ordermill.session import scratch_path, written
from ordermill.sources import files, roles

Query = Callable[[SparkSession, str], DataFrame]


def _on_clean(function: Callable[..., DataFrame], *tables: str, **options) -> Query:
    """A query that hands the named cleaned tables to a function."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        clean = roles.clean_tables(spark, folder)
        return function(*[clean[t] for t in tables], **options)
    return run


QUESTIONS: dict[str, Query] = {
    "monthly_revenue": _on_clean(questions.monthly_revenue, "orders", "order_items"),
    "category_revenue": _on_clean(questions.category_revenue, "orders", "order_items", "products"),
    "state_delivery": _on_clean(questions.state_delivery, "orders", "customers"),
    "top_sellers": _on_clean(questions.top_sellers, "orders", "order_items", "sellers", "reviews"),
    "cohort_repeat": _on_clean(questions.cohort_repeat, "orders", "customers"),
    "rfm": _on_clean(questions.rfm, "orders", "order_items", "customers"),
}


REPORTED: dict[str, Query] = {
    f"reported_{name}": (lambda s, d, name=name: questions.reported(name, QUESTIONS[name](s, d)))
    for name in QUESTIONS}


# ---- audits and constraints --------------------------------------------------------

# Beside the declared constraints: some that the generic test tables break.
ROLE_RULES = (
    Rule("orders", "not_null", ("order_delivered_customer_date",)),
    Rule("orders", "max_length", ("order_status",), (8,)),
    Rule("customers", "length", ("customer_state",), (8,)),
    Rule("products", "not_null", ("product_category_name_english",)),
    Rule("products", "between", ("product_photos_qty",), (1, 45)),
    Rule("order_items", "fits", ("price",), ("decimal(6,2)",)),
    Rule("order_items", "fits", ("freight_value",), ("decimal(5,2)",)),
    Rule("payments", "between", ("payment_installments",), (1, 11)),
)


def _profile_nulls(spark, folder):
    return quality.profile_nulls(dict(roles.raw_tables(spark, folder).items()))


def _profile_shape(spark, folder):
    raw = roles.raw_tables(spark, folder)
    return quality.profile_shape(dict(raw.items()))


def _dup_rows(spark, folder):
    return quality.dup_row_count(dict(roles.raw_tables(spark, folder).items()))


def _null_by_group(spark, folder):
    return quality.null_by_group(roles.orders(spark, folder), "order_delivered_customer_date",
                                 "order_status")


def _column_span(spark, folder):
    items = roles.order_items(spark, folder)
    return quality.column_span(items, ["price", "freight_value", "order_item_id"])


def _predicate_count(spark, folder):
    return quality.predicate_count(roles.order_items(spark, folder), {
        "free_freight": F.col("freight_value") == 0, "no_price": F.col("price") <= 0})


def _row_delta(spark, folder):
    return quality.row_delta(roles.raw_tables(spark, folder), roles.clean_tables(spark, folder))


def _row_parity(spark, folder):
    """Rows counted while all eight tables are written, against what reads back."""
    target = scratch_path(spark, "parity")
    counts = files.write_clean(roles.clean_tables(spark, folder), target)
    return quality.count_parity(spark, counts, files.read_clean(spark, target, list(counts)))


def _check_constraints(spark, folder):
    clean = roles.clean_tables(spark, folder)
    # both tiers read a table; what takes more than a scan to make is loaded first
    made = ("reviews", "geolocation", "customers", "products", "sellers")
    clean = {t: written(clean[t], t) if t in made else clean[t] for t in clean}
    rules = [r for r in (*CONSTRAINTS, *ROLE_RULES) if set(r.columns) <= set(clean[r.table].columns)]
    return quality.check_constraints(clean, rules)


def _lookup_gaps(spark, folder):
    """Categories before the hand-added translation: some products stay untranslated."""
    translated = cleaning.translate(roles.products_raw(spark, folder),
                                    roles.translation(spark, folder))
    return quality.lookup_gaps(translated, "product_category_name", "product_category_name_english")


def _unmatched_keys(spark, folder):
    points = cleaning.inside_box(roles.geolocation_raw(spark, folder))
    return quality.unmatched_keys({
        "customers": (roles.customers(spark, folder), "customer_zip_code_prefix"),
        "sellers": (roles.sellers(spark, folder), "seller_zip_code_prefix"),
    }, points.select("geolocation_zip_code_prefix").distinct(), "geolocation_zip_code_prefix")


AUDITS: dict[str, Query] = {
    "profile_nulls": _profile_nulls,
    "profile_shape": _profile_shape,
    "dup_row_count": _dup_rows,
    "null_by_group": _null_by_group,
    "column_span": _column_span,
    "predicate_count": _predicate_count,
    "row_delta": _row_delta,
    "row_parity": _row_parity,
    "check_constraints": _check_constraints,
    "lookup_gaps": _lookup_gaps,
    "date_order_conflicts": lambda s, d: quality.date_order_conflicts(roles.orders(s, d)),
    "unmatched_keys": _unmatched_keys,
    "key_reuse": lambda s, d: quality.key_reuse(roles.reviews_raw(s, d)),
    "person_repeat_audit": lambda s, d: quality.person_repeat_audit(roles.customers(s, d)),
    "seller_audit": lambda s, d: quality.seller_audit(roles.sellers(s, d)),
}

# ---- cleaning ------------------------------------------------------------------------


def _clean_orders(spark, folder):
    """Dates as text, as a raw file holds them, parsed back to timestamps."""
    orders = roles.orders(spark, folder)
    text = orders.withColumns({c: F.col(c).cast("string") for c in DATE_COLUMNS["orders"]})
    return cleaning.clean_orders(text)


CLEANING: dict[str, Query] = {
    "clean_orders": _clean_orders,
    "clean_payments": lambda s, d: cleaning.clean_payments(roles.payments_raw(s, d)),
    "keep_latest_review": lambda s, d: cleaning.clean_reviews(roles.reviews_raw(s, d)),
    "translate_category": lambda s, d: roles.clean_tables(s, d)["products"],
    "zip_centroid": lambda s, d: cleaning.zip_centroid(roles.geolocation_raw(s, d)),
}

# ---- star, measures and pages -----------------------------------------------------------



def _star(spark: SparkSession, folder: str, with_places: bool = False) -> star.Star:
    return star.build_star(spark, roles.clean_tables(spark, folder), with_places=with_places)


def _measures(*names: str, by=(), where=None) -> Query:
    return lambda s, d: metrics.evaluate(_star(s, d), names, by, where)


def _sketched(dims: tuple[str, ...], by: tuple[str, ...], where=None) -> Query:
    """Exact counts of persons and orders, and whether those of the kept sketches are within four standard errors."""
    def run(spark, folder):
        shop = _star(spark, folder)
        near = sketches.estimated(sketches.monthly_sketches(shop, dims), by, where)
        facts = metrics.delivered_facts(shop, {*dims, *(c for c in by if c not in star.DATE_COLUMNS), "customer_unique_id"})
        dates = {c: star.DATE_COLUMNS[c](F.col("order_date")) for c in (*by, *(where or {})) if c in star.DATE_COLUMNS}
        facts = facts.withColumns(dates)
        for column, values in (where or {}).items():
            facts = facts.filter(F.col(column).isin(list(values)))
        counts = {name: F.count_distinct(c).alias(f"exact_{name}") for name, c in sketches.COUNTED.items()}
        exact = facts.groupBy(*by).agg(*counts.values())
        both = near.join(exact, list(by)) if by else near.crossJoin(F.broadcast(exact))
        within = [(F.abs(F.col(n) - F.col(f"exact_{n}")) <= 4 * sketches.ERROR * F.col(f"exact_{n}") + 1).alias(f"{n}_within")
                  for n in sketches.COUNTED]
        return both.select(*by, *[f"exact_{n}" for n in sketches.COUNTED], *within)
    return run


def _page(visual: Callable[..., DataFrame], where=None) -> Query:
    return lambda s, d: visual(_star(s, d), where)


_PLAIN = tuple(m for m in metrics.MEASURES if m != "mom_growth")

STAR: dict[str, Query] = {
    "fact_order_items": _on_clean(star.fact_order_items, "order_items", "orders", "reviews"),
    "dim_customer": _on_clean(star.dim_customer, "customers", "geolocation"),
    "dim_product": _on_clean(star.dim_product, "products"),
    "dim_seller": _on_clean(star.dim_seller, "sellers", "geolocation"),
    "dim_date": _on_clean(star.dim_date_of, "orders"),
    "measures_total": _measures(*metrics.MEASURES),
    "measures_by_month": _measures(*metrics.MEASURES, by=["year_month"]),
    "measures_by_state": _measures(*_PLAIN, by=["customer_state"]),
    "measures_by_category": _measures(*_PLAIN, by=["category"]),
    "measures_by_seller_state": _measures(*_PLAIN, by=["seller_state", "year"]),
    "measures_sliced": _measures(*metrics.MEASURES, by=["customer_state"],
                                 where={"year": [1997, 1998], "category": ["promo", "small"]}),
    "mom_calendar": _measures("mom_growth", by=["year_month"]),
    "mom_by_category": _measures("total_revenue", "mom_growth", by=["category", "year_month"],
                                 where={"year": [1999]}),
    "repeat_rate_by_year": _measures("repeat_customer_rate", by=["year"]),
    "sketched_by_year": _sketched((), ("year",)),
    "sketched_by_category": _sketched(("category",), ("category",), {"year": [1996, 1997]}),
    "overview_top_categories": _page(pages.top_categories),
    "overview_top_states": _page(pages.top_states, {"year": [1996]}),
    "category_economics": _page(pages.category_economics),
    "delivery_by_state": _page(pages.delivery_by_state),
    "late_by_month": _page(pages.late_by_month),
    "score_by_delay_bin": _page(pages.score_by_delay_bin),
    "months_sorted": _page(pages.months_sorted),
}


# ---- whole pages, one query for each visual, under a slicer ------------------------------

_YEAR = {"year": [1997]}


def _visual(page: Callable[..., dict[str, DataFrame]], visual: str) -> Query:
    return lambda s, d: page(_star(s, d), _YEAR)[visual]


def _whole(visuals) -> Query:
    return lambda s, d: pages.whole_page(_star(s, d), visuals, _YEAR)


PAGES: dict[str, Query] = {
    "page_overview": _whole(pages.OVERVIEW),
    "page_customers": _whole(pages.CUSTOMERS),
    "page_delivery": _whole(pages.DELIVERY),
    "overview_cards": _visual(pages.page_overview, "cards"),
    "overview_monthly_revenue": _visual(pages.page_overview, "monthly_revenue"),
    "overview_top_categories_of_year": _visual(pages.page_overview, "top_categories"),
    "overview_top_states_of_year": _visual(pages.page_overview, "top_states"),
    "customers_cards": _visual(pages.page_customers, "cards"),
    "customers_orders_by_month": _visual(pages.page_customers, "orders_by_month"),
    "customers_orders_by_state": _visual(pages.page_customers, "orders_by_state"),
    "customers_category_economics": _visual(pages.page_customers, "category_economics"),
    "delivery_cards": _visual(pages.page_delivery, "cards"),
    "delivery_days_by_state": _visual(pages.page_delivery, "days_by_state"),
    "delivery_late_by_month": _visual(pages.page_delivery, "late_by_month"),
    "delivery_score_by_delay_bin": _visual(pages.page_delivery, "score_by_delay_bin"),
}

# ---- exploration ---------------------------------------------------------------------------

# Order values of the generic test tables are about a thousand times the source's.
_VALUE_CAP = 200_000

EXPLORE: dict[str, Query] = {
    "delivery_headline": _on_clean(explore.delivery_headline, "orders"),
    "score_by_delay": _on_clean(explore.score_by_delay, "orders", "reviews"),
    "order_value_stats": _on_clean(explore.order_value_stats, "orders", "order_items",
                                   cap=_VALUE_CAP),
    "order_value_hist": _on_clean(explore.order_value_hist, "orders", "order_items",
                                  cap=_VALUE_CAP),
    "monthly_trend": _on_clean(explore.monthly_trend, "orders", "order_items"),
    "monthly_trend_filled": _on_clean(explore.monthly_trend_filled, "orders", "order_items"),
    "peak_month": _on_clean(explore.peak_month, "orders", "order_items"),
    "state_revenue_share": _on_clean(explore.state_revenue, "orders", "order_items", "customers"),
    "state_concentration": _on_clean(explore.state_concentration, "orders", "order_items",
                                     "customers"),
    "category_pareto": _on_clean(explore.category_pareto, "orders", "order_items", "products"),
    "category_concentration": _on_clean(explore.category_concentration, "orders", "order_items",
                                        "products"),
    "payment_value_share": _on_clean(explore.payment_value_share, "orders", "payments"),
    "installment_dist": _on_clean(explore.installment_dist, "orders", "payments"),
    "installment_shares": _on_clean(explore.installment_shares, "orders", "payments"),
    "purchase_rank": _on_clean(explore.purchase_rank, "orders", "customers"),
    "repeat_rate": _on_clean(explore.repeat_rate, "orders", "customers"),
    "repeat_gap": _on_clean(explore.repeat_gap, "orders", "customers"),
    "repeat_gap_hist": _on_clean(explore.repeat_gap_hist, "orders", "customers"),
}


# ---- features and metrics -----------------------------------------------------------------

# Levels with fewer training rows than this fold together in the registered queries.
_MIN_LEVEL_ROWS = 100


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return features.feature_table(roles.clean_tables(spark, folder))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return features.stratified_split(features.model_rows(_features(spark, folder)))


def _train_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    split = _split(spark, folder)
    return split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")


def _level_folding(spark, folder):
    """Rows per folded category; levels are learned on training rows and applied to all."""
    split = _split(spark, folder)
    known = features.frequent_levels(split.filter(~F.col("is_test")), "category", _MIN_LEVEL_ROWS)
    return split.withColumn("category", features.fold_level(F.col("category"), known)).groupBy(
        "category", "is_test").agg(F.count("*").alias("n"))


def _scaled_features(spark, folder):
    train, test = _train_test(spark, folder)
    stats = features.moments(train).first().asDict()
    return test.select("order_id", *[features.scaled(c, stats).alias(c) for c in features.NUMERIC])


def _hashed_scores(spark, folder):
    """Labels with a score that is a fixed function of the order number."""
    key = F.col("order_id")
    return _features(spark, folder).select(
        "order_id", features.LABEL, ((key * 7919 % 1009).cast("double") / F.lit(1009.0)).alias("risk"))


def _metric(function: Callable[..., DataFrame], digits: dict[str, int] | None = None) -> Query:
    def run(spark, folder):
        out = function(_hashed_scores(spark, folder), "risk", features.LABEL)
        return out.withColumns({c: F.round(c, d) for c, d in (digits or {}).items()})
    return run


FEATURES: dict[str, Query] = {
    "feature_table": _features,
    "null_total": lambda s, d: quality.null_total(_features(s, d)),
    "stratified_split": lambda s, d: _split(s, d).select("order_id", features.LABEL, "is_test"),
    "split_counts": lambda s, d: features.split_counts(_split(s, d)),
    "balanced_weights": lambda s, d: features.balanced_weights(_train_test(s, d)[0]),
    "level_folding": _level_folding,
    "scaled_features": _scaled_features,
    "sample_rows": lambda s, d: features.sample_rows(_features(s, d), 500).select("order_id"),
    "threshold_metrics": _metric(evaluation.threshold_metrics),
    "roc_auc": _metric(evaluation.roc_auc),
    # a sum of doubles: the last digits depend on the order of addition
    "avg_precision": _metric(evaluation.average_precision, {"pr_auc": 12}),
    "confusion": _metric(evaluation.confusion),
    "confusion_report": _metric(evaluation.confusion_report),
}

# ---- models ----------------------------------------------------------------------------------
# All at their full size (300 trees, 300 rounds), on all rows; a model is fitted once for the same training rows and saved.


def _models(spark, folder, *estimators: str) -> tuple[dict[str, node_table.SavedModel], DataFrame]:
    split = written(_split(spark, folder), "split")
    train, test = split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")
    return review_model.saved_models(train, {e: {} for e in estimators}, _MIN_LEVEL_ROWS), test


def _model_compare(spark, folder):
    return review_model.compared(*_models(spark, folder, *review_model.ESTIMATORS))


def _on_model(function: Callable[..., DataFrame], estimator: str, *options) -> Query:
    def run(spark, folder):
        models, test = _models(spark, folder, estimator)
        return function(models[estimator], test, *options)
    return run


# A fixed linear model over scaled features, so that its scores and contributions can be stated in SQL.
_LITERAL = {"delivery_delay_days": 0.75, "delivery_days": 0.5, "price_total": -0.25, "item_count": 0.125}


def _contributions(spark, folder) -> DataFrame:
    """Each test row's contribution of every feature of the fixed model."""
    scaled = _scaled_features(spark, folder)
    return scaled.select("order_id", *[(F.col(c) * F.lit(w)).alias(c) for c, w in _LITERAL.items()])


def _literal_scores(spark, folder) -> DataFrame:
    total = sum((F.col(c) for c in _LITERAL), F.lit(0.0))
    return _contributions(spark, folder).select("order_id", total.alias("log_odds"))


def _literal_risk_top(spark, folder):
    # to six digits: the sum's last ones depend on the order of addition
    scores = _literal_scores(spark, folder).withColumn("log_odds", F.round("log_odds", 6))
    return shaping.top_n(scores, 100, [F.col("log_odds").desc(), "order_id"])


def _literal_mean_abs(spark, folder):
    rows = _contributions(spark, folder)
    out = attribution.mean_abs(rows, {c: F.col(c) for c in _LITERAL})
    return out.withColumn("mean_abs", F.round("mean_abs", 6))


# A fixed ensemble over the first four features, so that scores, gains and contributions of trees can be stated in SQL.
_LITERAL_NODES = [  # tree, node, feature, cut, low, high, value, gain
    (0, 0, 0, 0.5, 1, 2, 0.125, 40.0), (0, 1, 2, -0.25, 3, 4, -0.25, 8.0), (0, 2, None, None, None, None, 1.0, None),
    (0, 3, None, None, None, None, -0.5, None), (0, 4, None, None, None, None, -0.125, None),
    (1, 0, 1, 0.0, 1, 2, 0.0625, 24.0), (1, 1, None, None, None, None, -0.1875, None), (1, 2, 0, -0.5, 3, 4, 0.375, 16.0),
    (1, 3, None, None, None, None, 0.125, None), (1, 4, None, None, None, None, 0.5, None),
    (2, 0, 3, 0.75, 1, 2, -0.0625, 12.0), (2, 1, None, None, None, None, -0.125, None), (2, 2, None, None, None, None, 0.25, None)]


def _literal_trees(spark, folder) -> tuple[node_table.SavedModel, DataFrame]:
    train, test = _train_test(spark, folder)
    levels = {c: features.frequent_levels(train, c, _MIN_LEVEL_ROWS) for c in features.CATEGORICAL}
    nodes = inline_rows(spark, _LITERAL_NODES, node_table.NODES)
    return node_table.SavedModel(nodes, features.moments(train).first().asDict(), levels, node_table.LOG_ODDS, 2), test


def _tree_scores(spark, folder):
    model, test = _literal_trees(spark, folder)
    return model.scored(test).select("order_id", "score")


def _tree_parts(spark, folder):
    """Every test row's contributions, which add up to its score."""
    model, test = _literal_trees(spark, folder)
    return model.contributions(test).select("order_id", "base", F.posexplode(F.slice("parts", 1, 4)).alias("i", "part")) \
        .join(node_table.named_features(spark, model.names), F.col("i") == F.col("feature")) \
        .select("order_id", "base", F.split_part("name", F.lit("__"), F.lit(2)).alias("feature"), "part")


def _tree_mean_abs(spark, folder):
    model, test = _literal_trees(spark, folder)
    return attribution.tree_attribution(model, test, 4).withColumn("mean_abs", F.round("mean_abs", 6))


def _tree_importance(spark, folder):
    """Shares of gain, and how many test rows lie above each feature's mean."""
    model, test = _literal_trees(spark, folder)
    above = test.select(F.posexplode(F.slice(model.features(), 1, 4)).alias("i", "x")).groupBy("i").agg(
        F.count_if(F.col("x") > 0).alias("rows_above"))
    named = node_table.named_features(spark, model.names).select(
        F.split_part("name", F.lit("__"), F.lit(2)).alias("feature"), F.col("feature").alias("i"))
    return model.importance(4).join(named, "feature").join(above, "i").select("feature", "importance", "rows_above")


def _tree_metrics(spark, folder):
    model, test = _literal_trees(spark, folder)
    out = evaluation.all_metrics(model.score(test), "risk", features.LABEL)
    return out.withColumns({c: F.round(c, 9) for c in out.columns})


def _tree_risk_top(spark, folder):
    """The riskiest orders, riskiest last."""
    model, test = _literal_trees(spark, folder)
    top = review_model.risk_rank(model, test, 50).select("order_id", F.round("risk", 9).alias("risk"))
    return top.orderBy("risk", F.col("order_id").desc())


MODELS: dict[str, Query] = {
    "model_compare": _model_compare,
    "risk_top": _on_model(review_model.risk_rank, "boosted_trees", 100),
    "feature_importance": _on_model(lambda model, test: model.importance(), "boosted_trees"),
    "attribution_trees": _on_model(attribution.tree_attribution, "boosted_trees"),
    "attribution_linear": _on_model(attribution.linear_attribution, "logistic_regression"),
    "attribution_permutation": _on_model(attribution.permutation_importance, "boosted_trees"),
    "literal_tree_scores": _tree_scores,
    "literal_tree_parts": _tree_parts,
    "literal_tree_mean_abs": _tree_mean_abs,
    "literal_tree_importance": _tree_importance,
    "literal_tree_metrics": _tree_metrics,
    "literal_tree_risk_top": _tree_risk_top,
    "literal_risk_top": _literal_risk_top,
    "literal_mean_abs": _literal_mean_abs,
}

# ---- sources and sinks -------------------------------------------------------------------------


def _inline_rows(spark, folder):
    """Translations with the hand-added rows, and the products each one names."""
    added = inline_rows(spark, roles.EXTRA_TRANSLATIONS,
                        "product_category_name string, product_category_name_english string")
    used = roles.products_raw(spark, folder).groupBy("product_category_name").agg(
        F.count("*").alias("products"))
    return union_rows(roles.translation(spark, folder), added).join(used, "product_category_name")


def _csv_reviews(spark, folder):
    """Reviews with line breaks and quotes in their text, written as CSV and read back."""
    message = F.concat("review_comment_message", F.lit('\nsaid "'), "review_id", F.lit('", twice'))
    text = roles.reviews_raw(spark, folder).withColumn("review_comment_message", message)
    target = f"{scratch_path(spark, 'csv')}/reviews.csv"
    text.select([F.col(c).cast("string") for c in text.columns]).write.option(
        "header", True).option("escape", '"').csv(target)
    return files.read_csv(spark, target, RAW["reviews"], quoted_newlines=True)


def _csv(name: str) -> Query:
    """A raw table written as CSV and read back under its declared types."""
    def run(spark, folder):
        rows = roles.raw_tables(spark, folder)[name]
        declared = dict(f.split(" ", 1) for f in RAW[name].split(", "))
        target = f"{scratch_path(spark, 'csv')}/{name}.csv"
        rows.select([F.col(c).cast("string") for c in rows.columns]).write.option(
            "header", True).option("escape", '"').csv(target)
        return files.read_csv(spark, target, ", ".join(f"{c} {declared[c]}" for c in rows.columns))
    return run


def _parquet(name: str) -> Query:
    """A cleaned table written as parquet and read back."""
    def run(spark, folder):
        target = scratch_path(spark, "parquet")
        files.write_clean({name: roles.clean_tables(spark, folder)[name]}, target)
        return files.read_clean(spark, target, [name])[name]
    return run


def _table_round_trip(spark, folder):
    """Orders and items as tables bucketed on the order, joined without a shuffle."""
    target = scratch_path(spark, "tables")
    suffix = target.rsplit("-", 1)[-1]
    clean = roles.clean_tables(spark, folder)
    names = files.load_tables({f"orders_{suffix}": clean["orders"],
                               f"order_items_{suffix}": clean["order_items"]},
                              "default", target, bucket_by_order=8)
    orders, items = (spark.table(n) for n in names)
    return orders.join(questions.order_revenue(items), "order_id").groupBy("order_status").agg(
        F.count("*").alias("orders"), F.sum("revenue").alias("revenue"))


def _preview(spark, folder):
    return files.preview(QUESTIONS["monthly_revenue"](spark, folder), ["order_month"])


def _register_views(spark, folder):
    """Row counts of the five views, read back by name, and how many rows have coordinates."""
    shop = _star(spark, folder, with_places=True)
    names = star.register_star(spark, shop)
    located = {v: F.count("geolocation_lat") for v in ("dim_customer", "dim_seller")}
    counts = quality.stacked(
        spark.table(v).agg(F.count("*").alias("n"), located.get(v, F.lit(None).cast("long")).alias("located"))
        .select(F.lit(v).alias("view"), "n", "located") for v in shop.views())
    return names.join(counts, "view")


def _source_manifest(spark, folder):
    """The generic tables, and one that is not there."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "returns")
    return files.source_manifest(spark, folder, [f"{n}.parquet" for n in names]).select("file_name", "table_rows", "missing")


SOURCES: dict[str, Query] = {
    "source_manifest": _source_manifest,
    "inline_rows": _inline_rows,
    "csv_reviews": _csv_reviews,
    **{f"csv_{t}": _csv(t) for t in RAW if t != "reviews"},
    **{f"parquet_{t}": _parquet(t) for t in CLEAN_TABLES},
    "table_round_trip": _table_round_trip,
    "preview": _preview,
    "register_views": _register_views,
}

QUERIES: dict[str, Query] = {
    **QUESTIONS, **REPORTED, **PAGES, **AUDITS, **CLEANING, **STAR, **EXPLORE, **FEATURES, **MODELS, **SOURCES}
