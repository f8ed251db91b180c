from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ordermill.operators import cleaning, quality
from ordermill.operators.shaping import inline_rows
from ordermill.plans import star
from ordermill.schemas import CONSTRAINTS, RAW, Rule
from ordermill.session import scratch_path, shared_dir
from ordermill.sources import files


def test_payments(spark):
    raw = inline_rows(spark, [("o1", 1, "not_defined", 1, 0), ("o2", 1, "credit_card", 0, 9),
                              ("o3", 1, "voucher", 1, 0), ("o4", 1, None, 2, 4), ("o5", 1, "boleto", None, 3)],
                      "order_id string, payment_sequential int, payment_type string, "
                      "payment_installments int, payment_value int")
    got = {r.order_id: r.payment_installments for r in cleaning.clean_payments(raw).collect()}
    assert got == {"o2": 1, "o3": 1, "o4": 2, "o5": None}


def test_latest_review_wins_and_ties_are_ordered(spark):
    day = datetime(2018, 1, 1)
    later = datetime(2018, 1, 2)
    df = inline_rows(spark, [("r1", "o1", 5, day), ("r2", "o1", 1, later), ("r3", "o2", 4, day),
                             ("r4", "o2", 2, day), ("r1", "o3", 3, None), ("r9", "o3", 4, later)],
                     "review_id string, order_id string, review_score int, t timestamp_ntz")
    got = {r.order_id: r.review_id for r in cleaning.keep_latest(
        df, ["order_id"], "t", ["review_id", "review_score"]).collect()}
    assert got == {"o1": "r2", "o2": "r4", "o3": "r1"}


def test_products_keep_unknown_categories_and_get_names_fixed(spark):
    raw = inline_rows(spark, [("p1", "pc_gamer", 3, 4), ("p2", None, None, None), ("p3", "moveis", 5, 6)],
                      "product_id string, product_category_name string, product_name_lenght int, "
                      "product_description_lenght int")
    table = inline_rows(spark, [("moveis", "furniture")],
                        "product_category_name string, product_category_name_english string")
    clean = cleaning.clean_products(raw, table)
    assert {"product_name_length", "product_description_length"} <= set(clean.columns)
    assert {r.product_id: r.product_category_name_english for r in clean.collect()} == {
        "p1": "pc_gamer", "p2": None, "p3": "furniture"}
    assert quality.lookup_gaps(clean, "product_category_name",
                               "product_category_name_english").first() == (0, 1, 2)
    dims = star.dim_product(clean.withColumns({"product_photos_qty": F.lit(1), "product_weight_g": F.lit(1)}))
    assert {r.product_id: r.category for r in dims.collect()}["p2"] == "unknown"


def test_zip_centroid(spark):
    points = [(1, -33.8, -74.0), (1, 5.3, -34.7), (1, 5.4, -50.0), (2, 1.0, -40.0), (2, 1.0, -40.0),
              (2, 2.0, -41.0), (2, 3.0, -42.0), (2, 10.0, -42.0), (2, 4.0, -43.0), (3, 90.0, 0.0),
              (4, None, -40.0)]
    df = inline_rows(spark, points, "geolocation_zip_code_prefix int, geolocation_lat double, "
                                    "geolocation_lng double")
    got = {r[0]: (r[1], r[2]) for r in cleaning.zip_centroid(df).collect()}
    assert got == {1: (pytest.approx(-14.25), pytest.approx(-54.35)), 2: (2.5, -41.5)}


def test_timestamps_parse_and_bad_text_raises(spark):
    df = inline_rows(spark, [("2018-01-02 03:04:05", None)], "a string, b string")
    assert cleaning.parse_timestamps(df, ["a", "b"]).first() == (datetime(2018, 1, 2, 3, 4, 5), None)
    with pytest.raises(Exception):
        cleaning.parse_timestamps(inline_rows(spark, [("soon",)], "a string"), ["a"]).collect()


def test_csv_text_with_breaks_quotes_and_empty_fields(spark, tmp_path):
    (tmp_path / "order_reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"first line\nsecond ""quoted"" line",2018-01-01 00:00:00,2018-01-02 10:00:00\n')
    reviews = files.read_raw(spark, str(tmp_path), {"reviews": "order_reviews.csv"})["reviews"]
    row = reviews.first()
    assert row.review_comment_title is None
    assert row.review_comment_message == 'first line\nsecond "quoted" line'
    assert reviews.count() == 1


RAW_FILES = {name: f"{name}.csv" for name in RAW}


def _raw_files(folder):
    """A tiny raw data set with the planted defects."""
    texts = {
        "orders": "o1,c1,delivered,2018-01-01 10:00:00,,,2018-01-04 09:00:00,2018-01-03 00:00:00\n"
                  "o2,c2,shipped,2018-02-01 10:00:00,,,,2018-02-20 00:00:00\n",
        "order_items": "o1,1,p1,s1,2018-01-02 00:00:00,10.50,1.25\no1,2,p1,s1,2018-01-02 00:00:00,10.50,1.25\n"
                       "o2,1,p2,s1,2018-02-02 00:00:00,5.00,0.00\n",
        "payments": "o1,1,credit_card,0,23.50\no2,1,not_defined,1,0.00\n",
        "reviews": "r1,o1,5,,,2018-01-05 00:00:00,2018-01-05 10:00:00\n"
                   "r2,o1,2,,,2018-01-05 00:00:00,2018-01-06 10:00:00\n",
        "customers": "c1,u1,1000,sao paulo,SP\nc2,u1,2000,rio,RJ\n",
        "products": "p1,moveis,3,4,1,100,1,1,1\np2,,,,,,,,\n",
        "sellers": "s1,1000,sao paulo,SP\n",
        "geolocation": "1000,-23.5,-46.6,sao paulo,SP\n1000,-23.5,-46.6,sao paulo,SP\n9000,80.0,0.0,x,SP\n",
        "translation": "moveis,furniture\n",
    }
    for name, text in texts.items():
        header = ",".join(c.split()[0] for c in RAW[name].replace("decimal(10,2)", "decimal").split(", "))
        (folder / RAW_FILES[name]).write_text(header + "\n" + text)


def test_raw_folder_to_cleaned_parquet_and_views(spark, tmp_path):
    raw_dir, clean_dir = tmp_path / "raw" / "x" / "raw", tmp_path / "clean"
    raw_dir.mkdir(parents=True)
    _raw_files(raw_dir)
    manifest = files.source_manifest(spark, str(raw_dir), [*RAW_FILES.values(), "extra.csv"])
    assert [r.file_name for r in manifest.filter("missing").collect()] == ["extra.csv"]
    with pytest.raises(FileNotFoundError):
        files.require_complete(manifest)

    raw = files.read_raw(spark, str(raw_dir), RAW_FILES)
    clean = cleaning.clean_all(raw)
    counts = files.write_clean(clean, str(clean_dir))
    loaded = files.read_clean(spark, str(clean_dir))
    quality.require_parity(quality.row_parity(clean, loaded))
    quality.require_parity(quality.count_parity(spark, counts, loaded))
    files.write_clean({"orders": clean["orders"]}, str(tmp_path / "months"), by_month=True)
    assert sorted(p.name for p in (tmp_path / "months" / "orders.parquet").glob("purchase_month=*")) == [
        "purchase_month=2018-01", "purchase_month=2018-02"]
    deltas = {r.table_name: r.rows_removed for r in quality.row_delta(raw, loaded).collect()}
    assert deltas == {"orders": 0, "order_items": 0, "payments": 1, "reviews": 1, "customers": 0,
                      "products": 0, "sellers": 0, "geolocation": 2}
    built = star.build_star(spark, loaded)
    assert {r.view for r in star.register_star(spark, built).filter("created").collect()} == {
        "fact_order_items", "dim_customer", "dim_product", "dim_seller", "dim_date"}
    assert spark.sql("select count(*) from dim_date").first()[0] == 31 + 28 + 31  # and the month after
    fact = spark.sql("select order_id, is_delivered, revenue, delivery_days, delivery_delay_days, is_late,"
                     " review_score from fact_order_items where order_item_id = 1 order by order_id").collect()
    assert [(r.order_id, r.is_delivered, float(r.revenue), r.delivery_days, r.delivery_delay_days,
             r.is_late, r.review_score) for r in fact] == [
        ("o1", 1, 11.75, 2, 1, 1, 2), ("o2", 0, 5.0, None, None, 0, None)]


def test_a_category_translated_twice_stops_the_job(spark):
    products = inline_rows(spark, [("p1", "a"), ("p2", "b"), ("p3", None)], "product_id string, product_category_name string")
    once = inline_rows(spark, [("a", "x"), ("b", "y")], "product_category_name string, product_category_name_english string")
    assert cleaning.translate(products, once).count() == 3
    with pytest.raises(Exception, match="more than once"):
        cleaning.translate(products, once.union(once)).collect()


def test_parity_fails_on_a_difference(spark):
    one, two = spark.range(1), spark.range(2)
    with pytest.raises(ValueError, match="t"):
        quality.require_parity(quality.row_parity({"t": one}, {"t": two}))


def test_constraint_breaks_are_counted(spark):
    key = "a" * 32
    customers = inline_rows(spark, [(key, key, 1, "x" * 51, "SP"), (key, None, 1, "rio", "SPX")],
                            "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
                            "customer_city string, customer_state string")
    orders = inline_rows(spark, [("short", "b" * 32, "delivered", datetime(2018, 1, 1), datetime(2018, 1, 1))],
                         "order_id string, customer_id string, order_status string, "
                         "order_purchase_timestamp timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    reviews = inline_rows(spark, [(1, "1e9"), (6, "99999999.99"), (None, "100000000.00")], "s int, v string")
    rules = [r for r in CONSTRAINTS if r.table in ("customers", "orders")]
    rules += [Rule("reviews", "between", ("s",), (1, 5)), Rule("reviews", "fits", ("v",), ("decimal(10,2)",))]
    found = quality.check_constraints({"customers": customers, "orders": orders, "reviews": reviews}, rules)
    broken = {(r.table_name, r.rule, r["columns"]): r.violations for r in found.filter("violations > 0").collect()}
    assert broken == {
        ("customers", "not_null", "customer_unique_id"): 1, ("customers", "max_length", "customer_city"): 1,
        ("customers", "max_length", "customer_state"): 1, ("customers", "unique", "customer_id"): 1,
        ("orders", "length", "order_id"): 1, ("orders", "foreign_key", "customer_id"): 1,
        ("reviews", "between", "s"): 1, ("reviews", "fits", "v"): 2}
    with pytest.raises(ValueError):
        quality.require_valid(found)


def test_null_profile_counts_nan(spark):
    df = inline_rows(spark, [(1.0, None), (float("nan"), None), (None, "x")], "a double, b string")
    got = {r.column_name: r.nulls for r in quality.profile_nulls({"t": df}).collect()}
    assert got == {"a": 2, "b": 2}
    assert quality.null_total(df).first() == (3, 4)


def test_duplicates_treat_nulls_as_equal(spark):
    df = inline_rows(spark, [(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    assert quality.dup_row_count({"t": df}).first().duplicate_rows == 2


def test_key_reuse(spark):
    df = inline_rows(spark, [("r1", "o1"), ("r1", "o2"), ("r2", "o2"), ("r3", "o3")],
                     "review_id string, order_id string")
    assert quality.key_reuse(df).first() == (1, 1, 2)


class _Named:
    """Stands in for a session or context that was started with a checkpoint folder."""

    def __init__(self, folder, master):
        self.folder, self.master, self.sparkContext, self.conf = folder, master, self, self

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.folder


def test_intermediates_go_to_the_folder_the_session_names():
    named = _Named("hdfs:///shared", "yarn")
    assert shared_dir(named) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_dir(_Named(None, "local-cluster[2,1,1024]"))  # its executors are processes of their own
    assert scratch_path(named, "x").startswith("hdfs:///shared/x-")
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(_Named(None, "yarn"))  # never a machine-local folder on a cluster


def test_local_mode_keeps_one_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
