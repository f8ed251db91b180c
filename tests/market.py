"""A tiny cleaned marketplace built from literal rows."""

from datetime import date, datetime
from decimal import Decimal

from ordermill.operators.shaping import inline_rows
from ordermill.plans import star

ORDERS = [  # id, customer, status, purchase, delivered, promised
    ("o1", "c1", "delivered", datetime(2016, 9, 5, 10), datetime(2016, 9, 8, 9), datetime(2016, 9, 20)),
    ("o2", "c2", "delivered", datetime(2016, 10, 2, 10), datetime(2016, 10, 12, 11), datetime(2016, 10, 9)),
    ("o3", "c3", "delivered", datetime(2016, 12, 31, 23), datetime(2017, 1, 20, 1), datetime(2017, 1, 5)),
    ("o4", "c4", "delivered", datetime(2017, 1, 3, 8), None, datetime(2017, 1, 9)),
    ("o5", "c5", "canceled", datetime(2017, 1, 4, 8), datetime(2017, 1, 6, 8), datetime(2017, 1, 9)),
    ("o6", "c6", "delivered", datetime(2017, 1, 7, 8), datetime(2017, 1, 9, 22), datetime(2017, 1, 9)),
    ("o7", "c7", "delivered", datetime(2017, 1, 8, 8), datetime(2017, 1, 9, 22), datetime(2017, 1, 19)),
]
# o1 has three units and one review; o7 has no items
ITEMS = [("o1", 1, "p1", "s1", "10.00", "1.00"), ("o1", 2, "p1", "s1", "10.00", "1.00"),
         ("o1", 3, "p2", "s2", "30.00", "0.00"), ("o2", 1, "p2", "s2", "20.00", "5.00"),
         ("o3", 1, "p3", "s1", "7.00", "0.50"), ("o4", 1, "p1", "s1", "99.00", "1.00"),
         ("o5", 1, "p1", "s1", "50.00", "1.00"), ("o6", 1, "p1", "s2", "40.00", "2.00"),
         ("o6", 2, "p3", "s2", "40.00", "2.00")]
REVIEWS = [("o1", 5), ("o2", 1), ("o6", 4), ("o7", 2), ("o5", 1)]  # o3 has none
CUSTOMERS = [("c1", "u1", 1, "x", "SP"), ("c2", "u1", 1, "x", "SP"), ("c3", "u2", 2, "y", "RJ"),
             ("c4", "u3", 3, "z", "MG"), ("c5", "u3", 3, "z", "MG"), ("c6", "u2", 2, "y", "RJ"),
             ("c7", "u4", 2, "y", "RJ")]
PRODUCTS = [("p1", "toys"), ("p2", "books"), ("p3", None)]
SELLERS = [("s1", 1, "x", "SP"), ("s2", 2, "y", "RJ")]
PAYMENTS = [("o1", 1, "voucher", 1, "10.00"), ("o1", 2, "credit_card", 3, "42.00"),
            ("o2", 1, "boleto", 1, "25.00"), ("o6", 1, "credit_card", 12, "84.00"),
            ("o7", 1, "credit_card", 1, "5.00"), ("o3", 1, "credit_card", 10, "7.50")]


def tables(spark):
    def money(rows, *at):
        return [tuple(Decimal(v) if i in at else v for i, v in enumerate(r)) for r in rows]
    return {
        "orders": inline_rows(spark, ORDERS, "order_id string, customer_id string, order_status string, "
                              "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date "
                              "timestamp_ntz, order_estimated_delivery_date timestamp_ntz"),
        "order_items": inline_rows(spark, money(ITEMS, 4, 5), "order_id string, order_item_id int, "
                                   "product_id string, seller_id string, price decimal(10,2), "
                                   "freight_value decimal(10,2)"),
        "reviews": inline_rows(spark, REVIEWS, "order_id string, review_score int"),
        "customers": inline_rows(spark, CUSTOMERS, "customer_id string, customer_unique_id string, "
                                 "customer_zip_code_prefix int, customer_city string, customer_state string"),
        "products": inline_rows(spark, [(*p, 1, 1) for p in PRODUCTS], "product_id string, "
                                "product_category_name_english string, product_photos_qty int, "
                                "product_weight_g int"),
        "sellers": inline_rows(spark, SELLERS, "seller_id string, seller_zip_code_prefix int, "
                               "seller_city string, seller_state string"),
        "payments": inline_rows(spark, money(PAYMENTS, 4), "order_id string, payment_sequential int, "
                                "payment_type string, payment_installments int, payment_value decimal(10,2)"),
    }


def build(spark):
    return star.build_star(spark, tables(spark), (date(2016, 9, 1), date(2018, 12, 31)), with_places=False)
