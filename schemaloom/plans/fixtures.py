"""A small catalog on which every rule has a case that fires and cases that do not."""

from __future__ import annotations

from schemaloom.sources.fields import Field, parse_spec

_MANY = ", ".join(f"col_{a}:STRING" for a in "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda".split())
_TEXT: dict[str, str] = {
    "users": 'id:INT64, user_id:INT64, account_id:STRING, email:STRING, photo_link:STRING, password:STRING, api_token:STRING"the secret part"#, home_address:STRING"personal home"#, phone:STRING"private number", is_member:INT64, is_not_ready:BOOLEAN, no_show:INTEGER, has_car:STRING, created_at:STRING, updated_at:TIMESTAMP, birth_date:TIMESTAMP, signup_date:DATE, order:STRING, data:STRING, cfg_json:STRING, usrNm:STRING, xk:STRING, f1:INT64, iso_2:STRING, total_price:FLOAT64, item_count:STRING, status:STRING, user_type:STRING"valid: a, b", tag:STRING*, names:STRING, name_str:STRING, sha_hash:STRING, event_date:DATE, seen_epoch:INT64, call_duration:INT64, fee_amount:NUMERIC, lat:FLOAT64, lon:FLOAT64, sent_at:DATETIME, _lead:STRING, trail_:STRING, a__b:STRING, one_two_three_four_five_six_seven:STRING, a_name_that_is_much_longer_than_the_fifty_characters_allowed:STRING',
    "Orders": 'orderId:STRING, customerName:STRING, PlacedBy:STRING, STATE:STRING, net_total:NUMERIC, currency:STRING, gross_total:NUMERIC, lines:RECORD*(sku:STRING, qty:INT64, unit_price:FLOAT64), skus:STRING*, sku:RECORD(code:STRING, text:STRING), attributes:RECORD*(key:STRING, value:STRING), wide:RECORD*(' + _MANY + "), ship:RECORD(city:STRING, zip:STRING), parent_id:INT64",
    "wrapped": "tags:RECORD(list:RECORD*(element:RECORD(id:INT64))), notes:RECORD*(element:RECORD(a:STRING)), deep:RECORD(l1:RECORD(l2:RECORD(l3:RECORD(l4:RECORD(l5:RECORD(l6:RECORD(l7:RECORD(l8:RECORD(l9:RECORD(l10:RECORD(l11:RECORD(x:STRING))))))))))))",
    "triples": ", ".join(f"{n}:RECORD*(element:RECORD(a:INT64, b:STRING, c:STRING, d:DATE, e:BOOL, f:STRING))" for n in ("home", "work", "other")),
    "pre": "cust_id:INT64!, cust_first_name:STRING, cust_last_name:STRING, cust_first_seen:DATE, cust_first_buy:DATE, cust_first_call:DATE, cust_zip:STRING, cust_age:INT64",
    "documented": 'id:INT64!"key", created_at:TIMESTAMP!"when", updated_at:TIMESTAMP!"when", created_by:STRING!"who", updated_by:STRING!"who", _transform_created_at:TIMESTAMP!"x", _transform_updated_at:TIMESTAMP!"x", is_deleted:BOOLEAN!"flag"',
    "broad": ", ".join(f"measure{i}x:STRING" for i in range(101)),
    "middling": ", ".join(f"field{i}x:STRING" for i in range(60)),
    "nested_god": "a:RECORD(b:RECORD(c:RECORD(god:RECORD*(" + ", ".join(f"v{i}:STRING" for i in range(22)) + "))))",
    "events_202401": "id:INT64, user_id:INT64",
    "events_202402": "id:INT64, user_id:STRING",
    "events_202403": "id:STRING, user_id:INT64",
    "fact_sales": "order_id:INT64, line_id:INT64, customer_key:INT64, date_key:INT64, ship_date_key:INT64, product_key:STRING, store_key:INT64, promo_key:INT64, order_date:DATE, ship_date:DATE, complete_date:DATE, amount:NUMERIC, balance_eur:NUMERIC, on_hand:INT64, margin_pct:FLOAT64, as_of_date:DATE, order_number:STRING, invoice_code:STRING, po_ref:STRING, ticket_reference:STRING, tracking_number:STRING, row_uuid:STRING, items:RECORD*(item_id:INT64, qty:INT64)",
    "fct_stock": "snapshot:DATE, product_key:INT64, on_hand:INT64, inventory_qty:INT64, report_date:DATE",
    "fact_clicks": "happened_at:TIMESTAMP, header_id:INT64x".replace("INT64x", "INT64") + ", position:INT64",
    "grain_fact": "document_number:STRING, order_line:STRING, position:INT64, weight:FLOAT64, weight_unit:STRING, height:FLOAT64",
    "dim_customer": "customer_key:INT64, customer_code:STRING, first_name:STRING, region:STRING, last_login:DATE, loyalty_score:INT64, risk_rating:INT64, order_status:STRING, mail_preference:STRING, vip_flag:STRING, is_vip:BOOL, start_date:DATE, hobby_ids:STRING*, departments:STRING*",
    "dim_product": "product_name:STRING, brand_code:STRING, status_code:STRING, status_text:STRING, parent_key:INT64",
    "dim_brand": "brand_key:INT64, label:STRING, colour:STRING, origin:STRING",
    "dim_maker": "maker_key:INT64, label:STRING, colour:STRING, origin:STRING",
    "dim_date": "date_key:INT64, year:INT64, fiscal_year:INT64, month:INT64",
    "dim_employee": "employee_key:INT64, manager_id:INT64, level:INT64, effective_end:DATE",
    "bridge_customer_group": "customer_key:INT64!, group_key:INT64!, weight:NUMERIC",
    "camel": 'customerId:INT64, customer_name:STRING"n/a when absent", orderDate:DATE, order_no:STRING, shipTo:STRING, ship_from:STRING, Total:NUMERIC',
    "clicks": "event_timestamp:TIMESTAMP, url:STRING",
    "fact_visits": "visit_date_key:INT64, leave_date_key:INT64, seconds:INT64",
    "dim_colour": "colour_code:STRING, label:STRING",
    "customer_store_xref": "customer_key:INT64, store_key:INT64",
}

TABLES: dict[str, list[Field]] = {name: parse_spec(text) for name, text in _TEXT.items()}

#: table, column, referenced table
FOREIGN_KEYS = [
    ("fact_sales", "customer_key", "dim_customer"), ("fact_sales", "date_key", "dim_date"), ("fact_sales", "ship_date_key", "dim_date"), ("fact_sales", "product_key", "dim_product"), ("fact_sales", "store_key", "dim_store"), ("fact_sales", "promo_key", "dim_promo"),
    ("fct_stock", "product_key", "dim_product"), ("fact_clicks", "header_id", "pages"),
    ("dim_product", "brand_code", "dim_brand"), ("dim_brand", "origin", "dim_maker"), ("dim_employee", "manager_id", "dim_employee"),
    ("bridge_customer_group", "customer_key", "dim_customer"), ("bridge_customer_group", "group_key", "dim_group"), ("customer_store_xref", "customer_key", "dim_customer"), ("customer_store_xref", "store_key", "dim_store"),
    ("users", "account_id", "dim_customer"), ("Orders", "customerName", "dim_customer"), ("grain_fact", "order_line", "Orders"),
]
FOREIGN_KEYS += [("wide_fact", f"k{i}", f"dim_{i}") for i in range(14)]
PRIMARY_KEYS = [("bridge_customer_group", "customer_key", 1), ("bridge_customer_group", "group_key", 2), ("dim_customer", "customer_key", 1), ("dim_brand", "brand_key", 1), ("documented", "id", 1)]
#: table, partition column (null: by ingestion time), filter required, clustering column (a row for each)
STORAGE = [("clicks", None, True, ""), ("users", None, False, "status"), ("documented", "created_at", True, ""), ("dim_customer", None, True, "is_vip"), ("fact_sales", "order_date", False, "order_number"), ("Orders", "STATE", True, "STATE")]
STORAGE += [("dim_customer", None, True, c) for c in ("customer_key", "region", "order_status")]
