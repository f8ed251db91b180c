from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from market import build, tables
from ordermill.operators.shaping import inline_rows
from ordermill.plans import explore, metrics, pages, questions, sketches
from ordermill.plans.star import Star, build_star

D = Decimal


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


@pytest.fixture(scope="module")
def star(spark):
    return build(spark)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_monthly_revenue_keeps_undated_orders_and_skips_missing_months(t):
    out = questions.reported("monthly_revenue", questions.monthly_revenue(t["orders"], t["order_items"]))
    assert rows(out, "order_month", "orders", "revenue", "mom_growth_pct") == [
        (date(2016, 9, 1), 1, D("52.00"), None), (date(2016, 10, 1), 1, D("25.00"), D("-51.9")),
        (date(2016, 12, 1), 1, D("7.50"), D("-70.0")), (date(2017, 1, 1), 2, D("184.00"), D("2353.3"))]


def test_category_revenue(t):
    out = questions.category_revenue(t["orders"], t["order_items"], t["products"])
    assert rows(out, "category", "items_sold", "revenue") == [
        ("toys", 4, D("164.00")), ("books", 2, D("55.00")), ("unknown", 2, D("49.50"))]
    assert sum(r[0] for r in rows(out, "revenue_share_pct")) == pytest.approx(100)


def test_state_delivery(t):
    out = questions.reported("state_delivery", questions.state_delivery(t["orders"], t["customers"]))
    assert rows(out, "customer_state", "delivered_orders", "avg_delivery_days", "avg_days_vs_estimate",
                "late_pct") == [("RJ", 3, D("7.3"), D("1.7"), D("33.33")),
                                ("SP", 2, D("6.0"), D("-4.5"), D("50.00"))]


def test_top_sellers_count_a_review_once_per_order(t):
    out = questions.top_sellers(t["orders"], t["order_items"], t["sellers"], t["reviews"], 2)
    assert rows(out, "seller_id", "seller_state", "orders", "revenue", "avg_review_score") == [
        ("s2", "RJ", 3, D("139.00"), pytest.approx(10 / 3)), ("s1", "SP", 3, D("129.50"), 5.0)]


def test_cohorts_count_later_repeats(t):
    out = questions.cohort_repeat(t["orders"], t["customers"])
    assert rows(out, "cohort_month", "cohort_customers", "repeat_customers", "repeat_rate_pct") == [
        (date(2016, 9, 1), 1, 1, 100.0), (date(2016, 12, 1), 1, 1, 100.0), (date(2017, 1, 1), 2, 0, 0.0)]


def test_rfm_leaves_out_orders_without_items(t):
    out = questions.rfm(t["orders"], t["order_items"], t["customers"])
    got = {r.customer_unique_id: (r.recency_days, r.frequency, r.monetary, r.r_score, r.f_score, r.m_score)
           for r in out.collect()}
    assert got == {"u1": (97, 2, D("77.00"), 1, 3, 1), "u3": (4, 1, D("100.00"), 2, 1, 3),
                   "u2": (0, 2, D("91.50"), 3, 3, 2)}
    assert [r.customer_unique_id for r in out.collect()] == ["u3", "u2", "u1"]


def test_explored_numbers(t):
    assert explore.delivery_headline(t["orders"]).first() == (5, 0.4, 3.0 - 1.0)
    by_delay = rows(explore.score_by_delay(t["orders"], t["reviews"]), "delay_bucket", "mean_score",
                    "low_share", "n")
    assert by_delay == [("Early", 3.5, 0.5, 2), ("On the day", 4.0, 0.0, 1), ("1-7 days late", 1.0, 1.0, 1)]
    stats = explore.order_value_stats(t["orders"], t["order_items"], cap=60).first()
    assert (stats.orders, stats.median_value, stats.max_value, stats.share_up_to_cap) == (4, 38.5, D("84.00"), 0.75)
    assert explore.peak_month(t["orders"], t["order_items"]).first() == (
        date(2017, 1, 1), D("84.00"), D("168.50"))
    assert explore.category_concentration(t["orders"], t["order_items"], t["products"]).first()[:2] == (3, 3)
    assert explore.repeat_rate(t["orders"], t["customers"]).first() == (3, 2, 2 / 3)
    assert explore.repeat_gap(t["orders"], t["customers"]).first() == (2, 1.0, 1.0, 16.5)
    hist = rows(explore.repeat_gap_hist(t["orders"], t["customers"]), "bin_start", "n")
    assert len(hist) == 53 and [h for h in hist if h[1]] == [(0, 1), (21, 1)]


def test_payment_numbers(t):
    share = rows(explore.payment_value_share(t["orders"], t["payments"]), "payment_type", "payment_value")
    assert share == [("credit_card", D("138.50")), ("boleto", D("25.00")), ("voucher", D("10.00"))]
    assert rows(explore.installment_dist(t["orders"], t["payments"]), "installments", "n") == [
        (1, 1), (3, 1), (10, 1), (11, 1)]
    assert explore.installment_shares(t["orders"], t["payments"]).first() == (4, 0.25, 0.5)


def test_purchase_rank_breaks_ties_by_order_id(spark, t):
    same = t["orders"].filter(F.col("order_id").isin("o1", "o2")).withColumn(
        "order_purchase_timestamp", F.lit("2018-01-01").cast("timestamp_ntz"))
    assert sorted(rows(explore.purchase_rank(same, t["customers"]), "order_id", "purchase_rank")) == [
        ("o1", 0), ("o2", 1)]


# ---- measures -------------------------------------------------------------------------------

def test_grand_totals(star):
    row = metrics.evaluate(star, metrics.MEASURES).first()
    # an order without items is no fact row: o7 counts nowhere; o4 has no date
    assert row.total_revenue == D("168.50") and row.total_orders == 4
    assert row.avg_order_value == pytest.approx(168.5 / 4)
    assert row.avg_delivery_days == pytest.approx((2 + 10 + 19 + 2) / 4)  # one vote per order
    assert row.pct_late == 0.5
    assert row.avg_review_score == pytest.approx((5 + 1 + 4) / 3)  # the unreviewed order is skipped
    assert row.repeat_customer_rate == 1.0


def test_groups_add_up_to_the_total(star):
    for by in (["category"], ["customer_state"], ["year_month"], ["seller_state", "year"], []):
        out = metrics.evaluate(star, ["total_revenue"], by)
        assert sum(r.total_revenue for r in out.collect()) == D("168.50")


def test_order_facts_count_once_per_group(star):
    got = {r.category: (r.total_orders, r.avg_review_score)
           for r in metrics.evaluate(star, ["total_orders", "avg_review_score"], ["category"]).collect()}
    assert got == {"toys": (2, 4.5), "books": (2, 3.0), "unknown": (2, 4.0)}


def test_growth_looks_at_the_calendar_month_before(star):
    got = {r.year_month: r.mom_growth
           for r in metrics.evaluate(star, ["mom_growth"], ["year_month"]).collect()}
    assert got == {date(2016, 9, 1): None, date(2016, 10, 1): pytest.approx(25 / 52 - 1),
                   date(2016, 11, 1): -1.0, date(2016, 12, 1): None,
                   date(2017, 1, 1): pytest.approx(84 / 7.5 - 1), date(2017, 2, 1): -1.0}


def test_growth_of_a_selected_year_sees_the_december_before(star):
    both = metrics.evaluate(star, ["total_revenue", "mom_growth"], ["year_month"], {"year": [2017]})
    got = {r.year_month: (r.total_revenue, r.mom_growth) for r in both.collect()}
    assert got[date(2017, 1, 1)] == (D("84.00"), pytest.approx(84 / 7.5 - 1))
    total = metrics.evaluate(star, ["mom_growth"], (), {"year": [2017]}).first()
    assert total.mom_growth == pytest.approx((84 - 91.5) / 91.5)  # Dec 2016 to Nov 2017 before
    with pytest.raises(ValueError):
        metrics.evaluate(star, ["mom_growth"], ["day_name"])


def test_slicers_on_several_dimensions(star):
    row = metrics.evaluate(star, ["total_revenue", "total_orders", "repeat_customer_rate"], (),
                           {"customer_state": ["SP"], "category": ["books"]}).first()
    assert (row.total_revenue, row.total_orders, row.repeat_customer_rate) == (D("55.00"), 2, 1.0)
    empty = metrics.evaluate(star, ["total_orders", "avg_order_value"], (), {"year": [2018]}).first()
    assert (empty.total_orders, empty.avg_order_value) == (0, None)


def test_unknown_measure_is_refused(star):
    with pytest.raises(ValueError):
        metrics.evaluate(star, ["profit"])


def test_sketches_add_up_like_sets(spark):
    """Forty thousand orders of ten thousand people over two years: any union of kept sketches against exact counts."""
    orders = spark.range(40_000).select(
        F.col("id").alias("order_id"), F.col("id").alias("customer_id"), F.lit(1).alias("is_delivered"),
        F.date_add(F.lit(date(2017, 1, 1)), (F.col("id") * 7919 % 730).cast("int")).alias("order_date"),
        F.lit(1).alias("delivery_days"), F.lit(0).alias("delivery_delay_days"), F.lit(0).alias("is_late"))
    items = orders.select("order_id", F.lit("p").alias("product_id"), F.lit("s").alias("seller_id"),
                          F.lit(D("1.00")).alias("price"), F.lit(D("0.50")).alias("freight_value"))
    people = orders.select("customer_id", F.expr("customer_id * 104729 % 10000").alias("customer_unique_id"),
                           (F.col("customer_id") % 5).cast("string").alias("customer_state"))
    shop = Star(fact=items, items=items, orders=orders, scores=None, customer=people,
                product=spark.createDataFrame([("p", "toys")], "product_id string, category string"),
                seller=spark.createDataFrame([("s", "SP")], "seller_id string, seller_state string"), calendar=lambda: None)
    kept = sketches.monthly_sketches(shop, ["customer_state"]).cache()
    assert kept.count() == 24 * 5
    facts = orders.join(people, "customer_id").withColumn("year", F.year("order_date"))
    for by, where in (((), None), (("year",), None), (("customer_state",), {"year": [2018]})):
        got = {tuple(r[c] for c in by): (r.persons, r.orders) for r in sketches.estimated(kept, by, where).collect()}
        rows = facts if where is None else facts.filter("year = 2018")
        for r in rows.groupBy(*by).agg(F.count_distinct("customer_unique_id").alias("p"), F.count_distinct("order_id").alias("o")).collect():
            persons, placed = got[tuple(r[c] for c in by)]
            assert abs(persons - r.p) <= 4 * sketches.ERROR * r.p and abs(placed - r.o) <= 4 * sketches.ERROR * r.o
    with pytest.raises(ValueError):
        sketches.estimated(kept, ["category"])
    with pytest.raises(ValueError):
        sketches.monthly_sketches(shop, ["year"])


def test_a_page_reads_every_table_once(star):
    """All visuals of a page come from one scan of each table, and equal the measures evaluated one by one."""
    page = pages.whole_page(star, pages.OVERVIEW, {"year": [2016, 2017]})
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") <= 5  # items, orders, scores, products, customers
    for name, (measures, by) in pages.OVERVIEW.items():
        one = metrics.evaluate(star, measures, by, {"year": [2016, 2017]})
        cut = metrics.select_visual(page, name, (measures, by))
        assert sorted(map(str, cut.collect())) == sorted(map(str, one.collect())), name
    cards = page.filter("visual = 'cards'").first()
    assert (cards.total_revenue_label, cards.total_orders_label, cards.avg_order_value_label) == ("168", "4", "42.12")
    months = {r.year_month_label: r.mom_growth_label for r in page.filter("visual = 'monthly_revenue'").collect()}
    assert months["Oct 2016"] == "-51.9%" and months["Nov 2016"] == "-100.0%" and months["Sep 2016"] is None


def test_an_empty_selection_still_has_cards(star):
    rows = metrics.evaluate_all(star, pages.CUSTOMERS, {"year": [2018]})
    cards = metrics.select_visual(rows, "cards", pages.CUSTOMERS["cards"]).first()
    assert (cards.total_orders, cards.repeat_customer_rate) == (0, None)


def test_pages(star):
    overview = pages.page_overview(star)
    assert overview["cards"].first().total_revenue == D("168.50")
    assert [r.category for r in overview["top_categories"].collect()] == ["toys", "books", "unknown"]
    customers = pages.page_customers(star, {"year": [2016]})
    assert customers["cards"].first().total_orders == 3
    assert {r.customer_state: r.total_orders for r in customers["orders_by_state"].collect()} == {"SP": 2, "RJ": 1}
    delivery = pages.page_delivery(star)
    bins = {r.delay_bin_7d: r.avg_review_score for r in delivery["score_by_delay_bin"].collect()}
    assert bins == {-14: 5.0, 0: 2.5, 14: None}
    assert [r.month_number for r in pages.months_sorted(star).collect()] == [1, 9, 10, 12]


def test_input_partitioning_does_not_change_results(spark, t):
    spread = {n: df.repartition(7, F.rand(1)) for n, df in t.items()}
    a = questions.top_sellers(t["orders"], t["order_items"], t["sellers"], t["reviews"]).collect()
    b = questions.top_sellers(spread["orders"], spread["order_items"], spread["sellers"], spread["reviews"]).collect()
    assert a == b


def test_reported_types_round_half_up(spark):
    df = inline_rows(spark, [("2018-01", D("1.005"), 0.25)], "order_month string, revenue decimal(10,3), "
                                                              "mom_growth_pct double")
    row = questions.reported("monthly_revenue", df).first()
    assert (row.revenue, row.mom_growth_pct) == (D("1.01"), D("0.3"))


def test_sums_beyond_their_printed_type_keep_all_digits(spark):
    kind = "category string, items_sold long, revenue decimal(33,3), revenue_share_pct double"
    small = [("a", 1, D("9999999999.994"), 60.0), ("b", 1, None, None)]
    out = questions.reported("category_revenue", inline_rows(spark, small, kind))
    assert dict(out.dtypes)["revenue"] == "decimal(12,2)"
    assert rows(out, "revenue") == [(D("9999999999.99"),), (None,)]
    large = [("a", 1, D("9999999999.995"), 60.0), ("b", 1, D("-1.005"), 40.0)]
    out = questions.reported("category_revenue", inline_rows(spark, large, kind))
    assert rows(out, "revenue", "revenue_share_pct") == [(D("10000000000.00"), D("60.00")), (D("-1.01"), D("40.00"))]


def test_growth_and_revenue_outside_a_fixed_calendar(spark, t):
    shop = build_star(spark, t, with_places=False)
    months = metrics.evaluate(shop, ["total_revenue", "mom_growth"], ["year_month"])
    total = metrics.evaluate(shop, ["total_revenue"]).first()[0]
    assert months.filter("year_month is null").count() == 0
    assert months.agg({"total_revenue": "sum"}).first()[0] == total
    with pytest.raises(ValueError, match="misses"):
        metrics.evaluate(build_star(spark, t, (date(2030, 1, 1), date(2030, 12, 31)), with_places=False),
                         ["total_revenue"], ["year"]).collect()
