"""Column types of the raw files and of the cleaned tables, and their declared constraints."""

from __future__ import annotations

from dataclasses import dataclass

# ---- raw files: dates stay text until they are parsed explicitly ---------------

RAW = {
    "orders": "order_id string, customer_id string, order_status string, "
              "order_purchase_timestamp string, order_approved_at string, "
              "order_delivered_carrier_date string, order_delivered_customer_date string, "
              "order_estimated_delivery_date string",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
                   "shipping_limit_date string, price decimal(10,2), freight_value decimal(10,2)",
    "payments": "order_id string, payment_sequential int, payment_type string, "
                "payment_installments int, payment_value decimal(10,2)",
    "reviews": "review_id string, order_id string, review_score int, "
               "review_comment_title string, review_comment_message string, "
               "review_creation_date string, review_answer_timestamp string",
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
                 "customer_city string, customer_state string",
    "products": "product_id string, product_category_name string, product_name_lenght int, "
                "product_description_lenght int, product_photos_qty int, product_weight_g int, "
                "product_length_cm int, product_height_cm int, product_width_cm int",
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_city string, "
               "seller_state string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, "
                   "geolocation_lng double, geolocation_city string, geolocation_state string",
    "translation": "product_category_name string, product_category_name_english string",
}

# Free text with line breaks inside quotes. Only these files need whole-file
# parsing; all others stay splittable.
QUOTED_NEWLINES = frozenset({"reviews"})

DATE_COLUMNS = {
    "orders": ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"),
    "order_items": ("shipping_limit_date",),
    "reviews": ("review_creation_date", "review_answer_timestamp"),
}

# Load order, tables that others refer to come first.
CLEAN_TABLES = ("customers", "sellers", "products", "geolocation",
                "orders", "order_items", "payments", "reviews")

CLEAN_KEYS = {
    "customers": ("customer_id",), "sellers": ("seller_id",), "products": ("product_id",),
    "geolocation": ("geolocation_zip_code_prefix",), "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "payments": ("order_id", "payment_sequential"), "reviews": ("order_id",),
}

# ---- constraints -----------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One declared constraint on one table.

    ``kind`` is ``not_null``, ``length`` (exact), ``max_length``, ``between``,
    ``fits`` (castable to a SQL type), ``unique`` or ``foreign_key``.
    """

    table: str
    kind: str
    columns: tuple[str, ...]
    arg: tuple = ()


# The declared constraints of the cleaned tables.
CONSTRAINTS = (
    Rule("customers", "not_null", ("customer_id",)),
    Rule("customers", "not_null", ("customer_unique_id",)),
    Rule("customers", "not_null", ("customer_zip_code_prefix",)),
    Rule("customers", "not_null", ("customer_city",)),
    Rule("customers", "not_null", ("customer_state",)),
    Rule("customers", "length", ("customer_id",), (32,)),
    Rule("customers", "length", ("customer_unique_id",), (32,)),
    Rule("customers", "max_length", ("customer_city",), (50,)),
    Rule("customers", "max_length", ("customer_state",), (2,)),
    Rule("customers", "unique", ("customer_id",)),
    Rule("sellers", "not_null", ("seller_id",)),
    Rule("sellers", "not_null", ("seller_zip_code_prefix",)),
    Rule("sellers", "not_null", ("seller_city",)),
    Rule("sellers", "not_null", ("seller_state",)),
    Rule("sellers", "length", ("seller_id",), (32,)),
    Rule("sellers", "max_length", ("seller_city",), (50,)),
    Rule("sellers", "max_length", ("seller_state",), (2,)),
    Rule("sellers", "unique", ("seller_id",)),
    Rule("products", "not_null", ("product_id",)),
    Rule("products", "length", ("product_id",), (32,)),
    Rule("products", "max_length", ("product_category_name",), (50,)),
    Rule("products", "max_length", ("product_category_name_english",), (50,)),
    Rule("products", "between", ("product_name_length",), (-32768, 32767)),
    Rule("products", "between", ("product_description_length",), (-32768, 32767)),
    Rule("products", "between", ("product_length_cm",), (-32768, 32767)),
    Rule("products", "between", ("product_height_cm",), (-32768, 32767)),
    Rule("products", "between", ("product_width_cm",), (-32768, 32767)),
    Rule("products", "between", ("product_photos_qty",), (0, 255)),
    Rule("products", "unique", ("product_id",)),
    Rule("geolocation", "not_null", ("geolocation_zip_code_prefix",)),
    Rule("geolocation", "not_null", ("geolocation_lat",)),
    Rule("geolocation", "not_null", ("geolocation_lng",)),
    Rule("geolocation", "unique", ("geolocation_zip_code_prefix",)),
    Rule("orders", "not_null", ("order_id",)),
    Rule("orders", "not_null", ("customer_id",)),
    Rule("orders", "not_null", ("order_status",)),
    Rule("orders", "not_null", ("order_purchase_timestamp",)),
    Rule("orders", "not_null", ("order_estimated_delivery_date",)),
    Rule("orders", "length", ("order_id",), (32,)),
    Rule("orders", "length", ("customer_id",), (32,)),
    Rule("orders", "max_length", ("order_status",), (15,)),
    Rule("orders", "unique", ("order_id",)),
    Rule("order_items", "not_null", ("order_id",)),
    Rule("order_items", "not_null", ("product_id",)),
    Rule("order_items", "not_null", ("seller_id",)),
    Rule("order_items", "not_null", ("order_item_id",)),
    Rule("order_items", "not_null", ("shipping_limit_date",)),
    Rule("order_items", "not_null", ("price",)),
    Rule("order_items", "not_null", ("freight_value",)),
    Rule("order_items", "length", ("order_id",), (32,)),
    Rule("order_items", "length", ("product_id",), (32,)),
    Rule("order_items", "length", ("seller_id",), (32,)),
    Rule("order_items", "between", ("order_item_id",), (0, 255)),
    Rule("order_items", "fits", ("price",), ("decimal(10,2)",)),
    Rule("order_items", "fits", ("freight_value",), ("decimal(10,2)",)),
    Rule("order_items", "unique", ("order_id", "order_item_id")),
    Rule("payments", "not_null", ("order_id",)),
    Rule("payments", "not_null", ("payment_sequential",)),
    Rule("payments", "not_null", ("payment_type",)),
    Rule("payments", "not_null", ("payment_installments",)),
    Rule("payments", "not_null", ("payment_value",)),
    Rule("payments", "length", ("order_id",), (32,)),
    Rule("payments", "max_length", ("payment_type",), (15,)),
    Rule("payments", "between", ("payment_sequential",), (0, 255)),
    Rule("payments", "between", ("payment_installments",), (0, 255)),
    Rule("payments", "fits", ("payment_value",), ("decimal(10,2)",)),
    Rule("payments", "unique", ("order_id", "payment_sequential")),
    Rule("reviews", "not_null", ("order_id",)),
    Rule("reviews", "not_null", ("review_id",)),
    Rule("reviews", "not_null", ("review_score",)),
    Rule("reviews", "not_null", ("review_creation_date",)),
    Rule("reviews", "not_null", ("review_answer_timestamp",)),
    Rule("reviews", "length", ("order_id",), (32,)),
    Rule("reviews", "length", ("review_id",), (32,)),
    Rule("reviews", "max_length", ("review_comment_title",), (50,)),
    Rule("reviews", "max_length", ("review_comment_message",), (300,)),
    Rule("reviews", "unique", ("order_id",)),
    Rule("reviews", "between", ("review_score",), (1, 5)),
    Rule("payments", "between", ("payment_installments",), (1, 255)),
    Rule("orders", "foreign_key", ("customer_id",), ("customers",)),
    Rule("order_items", "foreign_key", ("order_id",), ("orders",)),
    Rule("order_items", "foreign_key", ("product_id",), ("products",)),
    Rule("order_items", "foreign_key", ("seller_id",), ("sellers",)),
    Rule("payments", "foreign_key", ("order_id",), ("orders",)),
    Rule("reviews", "foreign_key", ("order_id",), ("orders",)),
)
