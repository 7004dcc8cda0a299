"""What each rule must find on the fixture catalog.

Recorded from a run and read against the rules' definitions, some of them in
depth; a rule whose threshold, word list or scope changes no longer gives them.

Rows are (pattern, severity, table, paths); a finding about a table as a whole has the path ''.
The three rules that fire on nearly every table, or on made-up names, are stated by what they share.
"""

from __future__ import annotations

from schemaloom.plans import fixtures

_STATED: dict[str, list[tuple[str, str, str, list[str]]]] = {
    "unnecessary_struct_wrapper": [("unnecessary_struct_wrapper", "warning", "wrapped", ["tags"])],
    "unnecessary_element_wrapper": [
        ("unnecessary_element_wrapper", "warning", "triples", ["home", "other", "work"]),
        ("unnecessary_element_wrapper", "warning", "wrapped", ["notes", "tags.list"]),
    ],
    "boolean_as_integer": [("boolean_as_integer", "info", "users", ["is_member"])],
    "deep_nesting": [("deep_nesting", "warning", "wrapped", ["deep.l1.l2.l3.l4.l5.l6.l7.l8.l9.l10.l11"])],
    "missing_array_ordering": [
        ("missing_array_ordering", "info", "Orders", ["attributes", "lines", "wide"]),
        ("missing_array_ordering", "info", "fact_sales", ["items"]),
        ("missing_array_ordering", "info", "nested_god", ["a.b.c.god"]),
    ],
    "generic_field_name": [("generic_field_name", "info", "Orders", ["attributes.value"]), ("generic_field_name", "info", "users", ["data"])],
    "missing_description": [
        ("missing_description", "info", "Orders", ["wide"]),
        ("missing_description", "info", "nested_god", ["a.b.c.god"]),
        ("missing_description", "info", "triples", ["home.element", "other.element", "work.element"]),
    ],
    "inconsistent_naming": [("inconsistent_naming", "info", "camel", [""])],
    "overall_deep_nesting": [("overall_deep_nesting", "warning", "wrapped", [""])],
    "wide_table": [("wide_table", "info", "middling", [""]), ("wide_table", "warning", "broad", [""])],
    "inconsistent_timestamps": [("inconsistent_timestamps", "warning", "documented", [""]), ("inconsistent_timestamps", "warning", "users", [""])],
    "nullable_foreign_keys": [
        ("nullable_foreign_keys", "info", "Orders", ["parent_id"]),
        ("nullable_foreign_keys", "info", "fact_sales", ["items.item_id"]),
    ],
    "redundant_structures": [("redundant_structures", "info", "triples", ["home.list.element", "other.list.element", "work.list.element"])],
    "inconsistent_casing": [("inconsistent_casing", "info", "camel", [""])],
    "json_string_blobs": [("json_string_blobs", "warning", "users", ["cfg_json", "data"])],
    "nullable_id_fields": [
        ("nullable_id_fields", "warning", "dim_employee", ["manager_id"]),
        ("nullable_id_fields", "warning", "events_202401", ["id", "user_id"]),
        ("nullable_id_fields", "warning", "events_202402", ["id", "user_id"]),
        ("nullable_id_fields", "warning", "events_202403", ["id", "user_id"]),
        ("nullable_id_fields", "warning", "fact_clicks", ["header_id"]),
        ("nullable_id_fields", "warning", "fact_sales", ["line_id", "order_id"]),
        ("nullable_id_fields", "warning", "users", ["account_id", "id", "user_id"]),
    ],
    "reserved_keywords": [("reserved_keywords", "warning", "users", ["order"])],
    "overly_granular_timestamps": [("overly_granular_timestamps", "info", "users", ["birth_date"])],
    "expensive_unnest": [("expensive_unnest", "info", "Orders", ["wide"]), ("expensive_unnest", "info", "nested_god", ["a.b.c.god"])],
    "negative_booleans": [("negative_booleans", "info", "users", ["is_not_ready", "no_show"])],
    "overly_long_names": [("overly_long_names", "info", "users", ["a_name_that_is_much_longer_than_the_fifty_characters_allowed"])],
    "string_type_abuse": [
        ("string_type_abuse:boolean", "warning", "users", ["has_car"]),
        ("string_type_abuse:numeric", "warning", "fact_sales", ["order_number", "tracking_number"]),
        ("string_type_abuse:numeric", "warning", "grain_fact", ["document_number"]),
        ("string_type_abuse:numeric", "warning", "users", ["account_id", "item_count"]),
    ],
    "inconsistent_id_types": [("inconsistent_id_types", "warning", "users", ["account_id", "user_id"])],
    "float_for_money": [("float_for_money", "warning", "Orders", ["lines.unit_price"]), ("float_for_money", "warning", "users", ["total_price"])],
    "god_table": [("god_table", "warning", "broad", [""])],
    "array_without_id": [("array_without_id", "warning", "Orders", ["lines", "wide"]), ("array_without_id", "warning", "nested_god", ["a.b.c.god"])],
    "pii_unmarked_undocumented": [
        ("pii_unmarked_undocumented", "warning", "dim_customer", ["first_name", "last_login", "risk_rating"]),
        ("pii_unmarked_undocumented", "warning", "pre", ["cust_first_name", "cust_last_name"]),
        ("pii_unmarked_undocumented", "warning", "users", ["birth_date", "email", "photo_link"]),
    ],
    "pii_missing_policy_tags": [("pii_missing_policy_tags", "info", "users", ["phone"])],
    "plaintext_secrets": [("plaintext_secrets", "error", "users", ["password"])],
    "secrets_needing_review": [("secrets_needing_review", "info", "users", ["api_token"])],
    "unstructured_address": [("unstructured_address", "info", "users", ["home_address"])],
    "undocumented_enum": [
        ("undocumented_enum", "info", "Orders", ["STATE"]),
        ("undocumented_enum", "info", "dim_customer", ["order_status"]),
        ("undocumented_enum", "info", "dim_product", ["status_code", "status_text"]),
        ("undocumented_enum", "info", "users", ["status"]),
    ],
    "plural_singular_confusion": [
        ("plural_singular_confusion", "info", "Orders", ["skus", "wide"]),
        ("plural_singular_confusion", "info", "fact_visits", ["seconds"]),
        ("plural_singular_confusion", "info", "triples", ["home", "other", "work"]),
        ("plural_singular_confusion", "info", "users", ["names"]),
    ],
    "type_in_name": [("type_in_name", "info", "users", ["name_str"])],
    "redundant_prefix": [
        ("redundant_prefix", "info", "pre", ["cust_age", "cust_first_buy", "cust_first_call", "cust_first_name", "cust_first_seen", "cust_id", "cust_last_name", "cust_zip"]),
    ],
    "denormalization_abuse": [("denormalization_abuse", "info", "pre", ["cust_first_buy", "cust_first_call", "cust_first_name", "cust_first_seen"])],
    "eav_antipattern": [("eav_antipattern", "warning", "Orders", ["attributes"])],
    "string_for_binary": [("string_for_binary", "info", "users", ["sha_hash"])],
    "missing_soft_delete": [("missing_soft_delete", "info", "users", [""])],
    "inconsistent_date_granularity": [("inconsistent_date_granularity", "info", "users", ["birth_date", "event_date", "signup_date"])],
    "mixed_null_representation": [("mixed_null_representation", "info", "camel", ["customer_name"])],
    "inconsistent_boolean_type": [("inconsistent_boolean_type", "warning", "users", ["has_car", "is_member", "is_not_ready"])],
    "nullable_partition_field": [("nullable_partition_field", "warning", "users", ["event_date"])],
    "over_structuring": [("over_structuring", "info", "Orders", ["ship", "sku"])],
    "epoch_as_int64": [("epoch_as_int64", "warning", "users", ["seen_epoch"])],
    "duration_without_interval": [
        ("duration_without_interval", "info", "pre", ["cust_age"]),
        ("duration_without_interval", "info", "users", ["call_duration"]),
    ],
    "money_without_currency": [
        ("money_without_currency", "warning", "Orders", ["lines.unit_price"]),
        ("money_without_currency", "warning", "camel", ["Total"]),
        ("money_without_currency", "warning", "fact_sales", ["amount", "balance_eur"]),
        ("money_without_currency", "warning", "users", ["fee_amount", "total_price"]),
    ],
    "latlon_not_geography": [("latlon_not_geography", "info", "users", ["lat"])],
    "datetime_for_instants": [("datetime_for_instants", "warning", "users", ["sent_at"])],
    "problematic_field_names": [
        ("problematic_field_names", "warning", "documented", ["_transform_created_at", "_transform_updated_at"]),
        ("problematic_field_names", "warning", "users", ["_lead", "a__b", "a_name_that_is_much_longer_than_the_fifty_characters_allowed", "one_two_three_four_five_six_seven", "trail_"]),
    ],
    "repeated_scalar_should_be_struct": [("repeated_scalar_should_be_struct", "info", "Orders", ["skus"])],
    "array_missing_keys": [
        ("array_missing_keys", "warning", "Orders", ["lines", "wide"]),
        ("array_missing_keys", "warning", "nested_god", ["a.b.c.god"]),
    ],
    "god_child_array": [("god_child_array", "warning", "nested_god", ["a.b.c.god"])],
    "ingestion_time_when_event_time_exists": [("ingestion_time_when_event_time_exists", "warning", "clicks", ["event_timestamp"])],
    "missing_partition_filter_requirement": [
        ("missing_partition_filter_requirement", "warning", "fact_sales", [""]),
        ("missing_partition_filter_requirement", "warning", "users", [""]),
    ],
    "poor_clustering_choices": [
        ("poor_clustering_choices", "info", "Orders", ["STATE"]),
        ("poor_clustering_choices", "info", "dim_customer", ["is_vip", "order_status"]),
        ("poor_clustering_choices", "info", "users", ["status"]),
    ],
    "too_many_clustering_fields": [("too_many_clustering_fields", "info", "dim_customer", [""])],
    "sharded_tables_by_name": [("sharded_tables_by_name", "warning", "events", [""])],
    "dataset_inconsistent_id_types": [("dataset_inconsistent_id_types", "warning", "", ["id", "user_id"])],
    "fk_type_mismatch": [
        ("fk_type_mismatch", "warning", "Orders", ["customerName"]),
        ("fk_type_mismatch", "warning", "dim_product", ["brand_code"]),
        ("fk_type_mismatch", "warning", "users", ["account_id"]),
    ],
    "is_fact": [
        ("is_fact", "info", "fact_clicks", [""]),
        ("is_fact", "info", "fact_sales", [""]),
        ("is_fact", "info", "fact_visits", [""]),
        ("is_fact", "info", "fct_stock", [""]),
        ("is_fact", "info", "grain_fact", [""]),
    ],
    "is_dim": [
        ("is_dim", "info", "dim_brand", [""]),
        ("is_dim", "info", "dim_colour", [""]),
        ("is_dim", "info", "dim_customer", [""]),
        ("is_dim", "info", "dim_date", [""]),
        ("is_dim", "info", "dim_employee", [""]),
        ("is_dim", "info", "dim_maker", [""]),
        ("is_dim", "info", "dim_product", [""]),
    ],
    "star_hub_fact_table": [("star_hub_fact_table", "info", "dim_customer", [""])],
    "snowflake_dimension": [
        ("snowflake_dimension", "warning", "dim_brand", ["origin"]),
        ("snowflake_dimension", "warning", "dim_employee", ["manager_id"]),
        ("snowflake_dimension", "warning", "dim_product", ["brand_code"]),
    ],
    "ambiguous_fact_grain": [("ambiguous_fact_grain", "warning", "fact_sales", [""])],
    "missing_fact_surrogate_key": [("missing_fact_surrogate_key", "warning", "grain_fact", [""])],
    "semi_additive_measures": [
        ("semi_additive_measures", "info", "fact_sales", ["balance_eur", "on_hand"]),
        ("semi_additive_measures", "info", "fct_stock", ["on_hand"]),
    ],
    "non_additive_measures": [("non_additive_measures", "info", "fact_sales", ["margin_pct"])],
    "role_playing_dates": [
        ("role_playing_dates", "info", "fact_sales", ["date_key", "ship_date_key"]),
        ("role_playing_dates", "info", "fact_visits", ["leave_date_key", "visit_date_key"]),
    ],
    "missing_date_dimension": [("missing_date_dimension", "warning", "fact_visits", [""])],
    "incomplete_scd_type2": [("incomplete_scd_type2", "warning", "dim_customer", [""]), ("incomplete_scd_type2", "warning", "dim_employee", [""])],
    "no_scd_support": [
        ("no_scd_support", "info", "dim_brand", [""]),
        ("no_scd_support", "info", "dim_colour", [""]),
        ("no_scd_support", "info", "dim_date", [""]),
        ("no_scd_support", "info", "dim_maker", [""]),
        ("no_scd_support", "info", "dim_product", [""]),
    ],
    "junk_dimension_candidate": [("junk_dimension_candidate", "info", "dim_customer", [""])],
    "nested_line_items": [("nested_line_items", "warning", "Orders", ["lines"]), ("nested_line_items", "warning", "fact_sales", ["items"])],
    "dimension_unknown_member": [
        ("dimension_unknown_member", "info", "dim_brand", [""]),
        ("dimension_unknown_member", "info", "dim_colour", [""]),
        ("dimension_unknown_member", "info", "dim_customer", [""]),
        ("dimension_unknown_member", "info", "dim_date", [""]),
        ("dimension_unknown_member", "info", "dim_employee", [""]),
        ("dimension_unknown_member", "info", "dim_maker", [""]),
        ("dimension_unknown_member", "info", "dim_product", [""]),
    ],
    "conformed_dimension": [("conformed_dimension", "info", "dim_product", [""])],
    "duplicate_dimension_structure": [
        ("duplicate_dimension_structure", "warning", "dim_brand", [""]),
        ("duplicate_dimension_structure", "warning", "dim_maker", [""]),
    ],
    "fact_type": [
        ("fact_type:accumulating_snapshot", "info", "fact_sales", [""]),
        ("fact_type:periodic_snapshot", "info", "fct_stock", [""]),
        ("fact_type:transaction", "info", "fact_clicks", [""]),
        ("fact_type:unclassified", "info", "fact_visits", [""]),
        ("fact_type:unclassified", "info", "grain_fact", [""]),
    ],
    "bridge_by_name": [("bridge_by_name", "info", "bridge_customer_group", [""]), ("bridge_by_name", "info", "customer_store_xref", [""])],
    "nested_many_to_many": [("nested_many_to_many", "warning", "fact_sales", ["items"])],
    "array_fk_needs_bridge": [("array_fk_needs_bridge", "warning", "dim_customer", ["hobby_ids"])],
    "self_referencing_hierarchy": [("self_referencing_hierarchy", "info", "dim_employee", ["manager_id"])],
    "implied_hierarchy_no_fk": [
        ("implied_hierarchy_no_fk", "warning", "Orders", ["parent_id"]),
        ("implied_hierarchy_no_fk", "warning", "dim_product", ["parent_key"]),
    ],
    "hierarchy_missing_helpers": [("hierarchy_missing_helpers", "info", "Orders", [""]), ("hierarchy_missing_helpers", "info", "dim_product", [""])],
    "multi_valued_hierarchy": [("multi_valued_hierarchy", "warning", "dim_customer", ["departments"])],
    "mini_dimension_candidate": [("mini_dimension_candidate", "warning", "dim_customer", [""])],
    "score_mini_dimension": [("score_mini_dimension", "info", "dim_customer", [""])],
    "degenerate_dimension": [
        ("degenerate_dimension", "info", "fact_sales", ["invoice_code", "order_number", "po_ref", "ticket_reference", "tracking_number"]),
    ],
    "excessive_degenerate_dimensions": [("excessive_degenerate_dimensions", "warning", "fact_sales", [""])],
    "uuid_degenerate_dimension": [("uuid_degenerate_dimension", "info", "fact_sales", ["row_uuid"])],
    "dimension_with_arrays": [("dimension_with_arrays", "warning", "dim_customer", ["departments", "hobby_ids"])],
    "missing_unit_of_measure": [
        ("missing_unit_of_measure", "warning", "bridge_customer_group", ["weight"]),
        ("missing_unit_of_measure", "warning", "fact_sales", ["amount"]),
        ("missing_unit_of_measure", "warning", "grain_fact", ["height"]),
        ("missing_unit_of_measure", "warning", "users", ["call_duration", "fee_amount"]),
    ],
    "code_value_antipattern": [("code_value_antipattern", "warning", "dim_product", ["status_code/status_text"])],
    "snapshot_date_nullable": [
        ("snapshot_date_nullable", "warning", "fact_sales", ["as_of_date"]),
        ("snapshot_date_nullable", "warning", "fct_stock", ["report_date"]),
    ],
    "snapshot_with_semi_additive": [
        ("snapshot_with_semi_additive", "info", "fact_sales", [""]),
        ("snapshot_with_semi_additive", "info", "fct_stock", [""]),
    ],
    "mixed_grain_fact": [("mixed_grain_fact", "error", "fact_clicks", [""])],
    "dimension_missing_surrogate_key": [("dimension_missing_surrogate_key", "warning", "dim_colour", [""])],
    "mini_dimension_rapid": [("mini_dimension_rapid", "info", "dim_customer", [""])],
    "bridge_by_fk": [("bridge_by_fk", "info", "bridge_customer_group", [""]), ("bridge_by_fk", "info", "customer_store_xref", [""])],
    "snowflake_depth_excessive": [
        ("snowflake_depth_excessive", "warning", "dim_employee", [""]),
        ("snowflake_depth_excessive", "warning", "dim_product", [""]),
    ],
    "conformed_dim_type_inconsistency": [("conformed_dim_type_inconsistency", "error", "dim_product", ["product_key"])],
    "fact_too_denormalized": [
        ("fact_too_denormalized", "warning", "fact_clicks", [""]),
        ("fact_too_denormalized", "warning", "fact_visits", [""]),
        ("fact_too_denormalized", "warning", "fct_stock", [""]),
        ("fact_too_denormalized", "warning", "grain_fact", [""]),
    ],
    "god_fact_table": [("god_fact_table", "warning", "wide_fact", [""])],
    "late_arriving_fact_risk": [("late_arriving_fact_risk", "info", "fact_sales", [""])],
    "orphan_fk_risk": [
        ("orphan_fk_risk", "warning", "customer_store_xref", ["store_key"]),
        ("orphan_fk_risk", "warning", "fact_clicks", ["header_id"]),
        ("orphan_fk_risk", "warning", "fact_sales", ["promo_key", "store_key"]),
    ],
    "incomplete_date_dimension": [("incomplete_date_dimension", "info", "dim_date", [""])],
}

_PLAIN = [t for t in fixtures.TABLES if t != "documented"]
#: Letters alone, letters with a number in them, names of two characters.
_STATED["cryptic_names"] = [
    ("cryptic_names", "info", "broad", [f"measure{i}x" for i in range(101)]),
    ("cryptic_names", "info", "middling", [f"field{i}x" for i in range(60)]),
    ("cryptic_names", "info", "nested_god", ["a", "a.b", "a.b.c", *(f"a.b.c.god.v{i}" for i in range(10))]),
    ("cryptic_names", "info", "triples", [f"{n}.element.{x}" for n in ("home", "other", "work") for x in "abcdef"]),
    ("cryptic_names", "info", "users", ["f1", "xk"]),
    ("cryptic_names", "info", "wrapped", ["notes.element.a", *("deep." + ".".join(f"l{k}" for k in range(1, i + 1)) for i in range(1, 12)), "deep." + ".".join(f"l{k}" for k in range(1, 12)) + ".x"]),
]
_STATED["missing_audit_columns"] = [("missing_audit_columns", "warning", t, [""]) for t in _PLAIN]
_STATED["low_documentation_coverage"] = [("low_documentation_coverage", "error", t, [""]) for t in _PLAIN]

#: By rule: (table_name, path, pattern, severity).
FINDINGS: dict[str, list[tuple[str, str, str, str]]] = {rule: [(table, path, pattern, severity) for pattern, severity, table, paths in stated for path in paths] for rule, stated in _STATED.items()}

#: Of comparisons and analyses, read against their definitions in the same way: columns and rows.
RESULTS: dict[str, tuple[list[str], list[tuple]]] = {
    "flatten_paths": (
        ["path"],
        [
            ("active",), ("age",), ("bag",), ("born",), ("both",), ("code",), ("contact.email",), ("contact.phone",), ("created_at",), ("email",),
            ("gone",), ("id",), ("items[0].qty",), ("items[0].sku",), ("legacy",), ("mess",), ("misc",), ("name",), ("note",), ("pile[0].k",),
            ("score",), ("status",), ("tags",), ("void",),
        ],
    ),
    "paths_by_name": (
        ["leaf", "paths", "n"],
        [
            ("active", "active", 1), ("age", "age", 1), ("bag", "bag", 1), ("born", "born", 1), ("both", "both", 1), ("code", "code", 1),
            ("created_at", "created_at", 1), ("email", "contact.email,email", 2), ("gone", "gone", 1), ("id", "id", 1), ("k", "pile[0].k", 1),
            ("legacy", "legacy", 1), ("mess", "mess", 1), ("misc", "misc", 1), ("name", "name", 1), ("note", "note", 1), ("phone", "contact.phone", 1),
            ("qty", "items[0].qty", 1), ("score", "score", 1), ("sku", "items[0].sku", 1), ("status", "status", 1), ("tags", "tags", 1),
            ("void", "void", 1),
        ],
    ),
    "path_changes": (
        ["leaf", "shared", "left_paths", "right_paths"],
        [
            ("k", None, "pile[0].k", "bag[0].k"), ("name", None, "name", "profile.name"),
        ],
    ),
    "filter_fields": (
        ["path", "kind", "atoms"],
        [
            ("contact", "object", "object"), ("contact.email", "scalar", "str"), ("contact.phone", "scalar", "missing|str"),
            ("items[0].sku", "scalar", "str"), ("name", "scalar", "str"),
        ],
    ),
    "presence_wrap": (
        ["path", "wrapped"],
        [
            ("active", "bool"), ("age", "int"), ("bag", "array"), ("born", "date"), ("both", "int"), ("code", "union(int|missing|str)"),
            ("contact.email", "str"), ("contact.phone", "union(missing|str)"), ("created_at", "timestamp"), ("email", "str"), ("gone", "missing"),
            ("id", "int"), ("items[0].qty", "int"), ("items[0].sku", "str"), ("legacy", "str"), ("mess", "union(any|empty_string|int|str)"),
            ("misc", "union(any|int)"), ("name", "union(str|missing)"), ("note", "any"), ("pile[0].k", "str"), ("score", "float"),
            ("status", "union(int|str)"), ("tags", "union(array|missing)"), ("void", "empty_string"),
        ],
    ),
    "presence_inject": (
        ["path", "atoms"],
        [
            ("active", "bool"), ("age", "int"), ("bag", "array"), ("born", "date"), ("both", "int"), ("code", "int|missing|str"),
            ("contact.email", "str"), ("contact.phone", "missing|str"), ("created_at", "timestamp"), ("email", "str"), ("gone", "missing"),
            ("id", "int"), ("items", "array"), ("items[0].qty", "int"), ("items[0].sku", "str"), ("legacy", "str"), ("mess", "int|str"),
            ("misc", "int"), ("name", "missing|str"), ("note", "any"), ("pile", "array"), ("pile[0].k", "str"), ("score", "float"),
            ("status", "int|str"), ("tags", "array|missing"), ("void", "str"),
        ],
    ),
    "fmt_path": (
        ["path", "shown"],
        [
            ("active", "active"), ("age", "age"), ("bag", "bag"), ("born", "born"), ("both", "both"), ("code", "code"), ("contact", "contact"),
            ("contact.email", "contact.email"), ("contact.phone", "contact.phone"), ("created_at", "created_at"), ("email", "email"), ("gone", "gone"),
            ("id", "id"), ("items", "items"), ("items[0].qty", "items[].qty"), ("items[0].sku", "items[].sku"), ("legacy", "legacy"), ("mess", "mess"),
            ("misc", "misc"), ("name", "name"), ("note", "note"), ("pile", "pile"), ("pile[0].k", "pile[].k"), ("score", "score"),
            ("status", "status"), ("tags", "tags"), ("void", "void"),
        ],
    ),
    "union_str": (
        ["path", "type_repr"],
        [
            ("active", "bool"), ("age", "int"), ("bag", "array"), ("born", "date"), ("both", "int"), ("code", "union(int|str)"), ("contact", "object"),
            ("contact.email", "str"), ("contact.phone", "union(missing|str)"), ("created_at", "timestamp"), ("email", "str"), ("gone", "missing"),
            ("id", "int"), ("items", "array"), ("items[0].qty", "int"), ("items[0].sku", "str"), ("legacy", "str"),
            ("mess", "union(any|empty_string|int|str)"), ("misc", "union(any|int)"), ("name", "str"), ("note", "any"), ("pile", "array"),
            ("pile[0].k", "str"), ("score", "float"), ("status", "union(int|str)"), ("tags", "array"), ("void", "empty_string"),
        ],
    ),
    "norm_empty": (
        ["path", "atoms"],
        [
            ("active", "bool"), ("age", "int"), ("bag", "array"), ("born", "date"), ("both", "int"), ("code", "int|str"), ("contact", "object"),
            ("contact.email", "str"), ("contact.phone", "missing|str"), ("created_at", "timestamp"), ("email", "str"), ("gone", "missing"),
            ("id", "int"), ("items", "array"), ("items[0].qty", "int"), ("items[0].sku", "str"), ("legacy", "str"), ("mess", "any|str|int|str"),
            ("misc", "any|int"), ("name", "str"), ("note", "any"), ("pile", "array"), ("pile[0].k", "str"), ("score", "float"), ("status", "int|str"),
            ("tags", "array"), ("void", "str"),
        ],
    ),
    "norm_union": (
        ["path", "atoms"],
        [
            ("active", "bool"), ("age", "int"), ("bag", "array"), ("born", "date"), ("both", "int"), ("code", "int|str"), ("contact", "object"),
            ("contact.email", "str"), ("contact.phone", "missing|str"), ("created_at", "timestamp"), ("email", "str"), ("gone", "missing"),
            ("id", "int"), ("items", "array"), ("items[0].qty", "int"), ("items[0].sku", "str"), ("legacy", "str"), ("mess", "int|str"),
            ("misc", "int"), ("name", "str"), ("note", "any"), ("pile", "array"), ("pile[0].k", "str"), ("score", "float"), ("status", "int|str"),
            ("tags", "array"), ("void", "str"),
        ],
    ),
    "norm_walk": (
        ["path", "type_repr", "kind"],
        [
            ("active", "bool", "scalar"), ("age", "int", "scalar"), ("bag", "array", "array"), ("born", "date", "scalar"), ("both", "int", "scalar"),
            ("code", "union(int|str)", "scalar"), ("contact", "object", "object"), ("contact.email", "str", "scalar"),
            ("contact.phone", "union(missing|str)", "scalar"), ("created_at", "timestamp", "scalar"), ("email", "str", "scalar"),
            ("gone", "missing", "scalar"), ("id", "int", "scalar"), ("items", "array", "array"), ("items[0].qty", "int", "scalar"),
            ("items[0].sku", "str", "scalar"), ("legacy", "str", "scalar"), ("mess", "union(int|str)", "scalar"), ("misc", "int", "scalar"),
            ("name", "str", "scalar"), ("note", "any", "scalar"), ("pile", "array", "array"), ("pile[0].k", "str", "scalar"),
            ("score", "float", "scalar"), ("status", "union(int|str)", "scalar"), ("tags", "array", "array"), ("void", "str", "scalar"),
        ],
    ),
    "norm_has_any": (
        ["path", "has_any"],
        [
            ("active", False), ("age", False), ("bag", False), ("born", False), ("both", False), ("code", False), ("contact", False),
            ("contact.email", False), ("contact.phone", False), ("created_at", False), ("email", False), ("gone", False), ("id", False),
            ("items", False), ("items[0].qty", False), ("items[0].sku", False), ("legacy", False), ("mess", True), ("misc", True), ("name", False),
            ("note", True), ("pile", False), ("pile[0].k", False), ("score", False), ("status", False), ("tags", False), ("void", False),
        ],
    ),
    "diff_trees": (
        ["path", "section", "left_atoms", "right_atoms"],
        [
            ("active", "type_mismatch", "bool", "str"), ("age", "type_mismatch", "int", "str"),
            ("audit_log.entry.line", "only_right", None, "missing|str"), ("bag[0].k", "only_right", None, "str"),
            ("born", "type_mismatch", "date", "timestamp"), ("both", "presence", "required", "nullable"), ("both", "type_mismatch", "int", "str"),
            ("code", "presence", "nullable", "required"), ("contact.email", "only_left", "str", None),
            ("contact.phone", "presence", "nullable", "required"), ("created_at", "common", "timestamp", "timestamp"),
            ("email", "presence", "required", "nullable"), ("gone", "presence", "nullable", "required"), ("id", "common", "int", "int"),
            ("is_premium", "only_right", None, "bool|missing"), ("items[0].qty", "only_left", "int", None), ("items[0].sku", "common", "str", "str"),
            ("legacy", "only_left", "str", None), ("mess", "common", "int|str", "int|str"), ("misc", "common", "int", "int"),
            ("name", "only_left", "missing|str", None), ("needed", "only_right", None, "int"), ("pile[0].k", "only_left", "str", None),
            ("profile", "only_right", None, "object"), ("score", "type_mismatch", "float", "int"), ("status", "common", "int|str", "int|str"),
            ("tags", "presence", "nullable", "required"), ("updated_at", "only_right", None, "missing|timestamp"), ("void", "common", "str", "str"),
        ],
    ),
    "diff_report": (
        ["section", "n", "paths"],
        [
            ("only_left", 5, "contact.email,items[0].qty,legacy,name,pile[0].k"),
            ("only_right", 6, "audit_log.entry.line,bag[0].k,is_premium,needed,profile,updated_at"),
            ("presence", 6, "both,code,contact.phone,email,gone,tags"), ("type_mismatch", 5, "active,age,born,both,score"),
        ],
    ),
    "diff_onlyleft": (
        ["path"],
        [
            ("contact.email",), ("items[0].qty",), ("legacy",), ("name",), ("pile[0].k",),
        ],
    ),
    "diff_onlyright": (
        ["path"],
        [
            ("audit_log.entry.line",), ("bag[0].k",), ("is_premium",), ("needed",), ("profile",), ("updated_at",),
        ],
    ),
    "diff_common": (
        ["path"],
        [
            ("active",), ("age",), ("born",), ("both",), ("code",), ("contact.phone",), ("created_at",), ("email",), ("gone",), ("id",),
            ("items[0].sku",), ("mess",), ("misc",), ("note",), ("score",), ("status",), ("tags",), ("void",),
        ],
    ),
    "diff_structuring": (
        ["path", "change"],
        [
            ("bag", "structured"), ("pile", "unstructured"),
        ],
    ),
    "type_split": (
        ["path", "base", "nullable"],
        [
            ("active", "bool", False), ("age", "int", False), ("bag", "array", False), ("born", "date", False), ("both", "int", False),
            ("code", "union(int|str)", True), ("contact", "object", False), ("contact.email", "str", False), ("contact.phone", "str", True),
            ("created_at", "timestamp", False), ("email", "str", False), ("gone", "missing", True), ("id", "int", False), ("items", "array", False),
            ("items[0].qty", "int", False), ("items[0].sku", "str", False), ("legacy", "str", False), ("mess", "union(int|str)", False),
            ("misc", "int", False), ("name", "str", True), ("note", "any", False), ("pile", "array", False), ("pile[0].k", "str", False),
            ("score", "float", False), ("status", "union(int|str)", False), ("tags", "array", True), ("void", "str", False),
        ],
    ),
    "type_change": (
        ["path", "type_changed", "nullability_changed"],
        [
            ("active", True, False), ("age", True, False), ("born", True, False), ("both", True, True), ("code", False, True),
            ("contact.phone", False, True), ("email", False, True), ("gone", False, True), ("note", True, False), ("score", True, False),
            ("tags", False, True),
        ],
    ),
    "type_presence": (
        ["path", "presence_only"],
        [
            ("active", False), ("age", False), ("bag", False), ("born", False), ("both", False), ("code", True), ("contact", False),
            ("contact.phone", True), ("created_at", False), ("email", True), ("gone", True), ("id", False), ("items", False), ("items[0].sku", False),
            ("mess", False), ("misc", False), ("note", False), ("pile", False), ("score", False), ("status", False), ("tags", True), ("void", False),
        ],
    ),
    "presence_fmt": (
        ["path", "for_schema", "for_data"],
        [
            ("active", "bool", "bool"), ("age", "int", "int"), ("bag", "array", "array"), ("born", "date", "date"), ("both", "int", "int"),
            ("code", "union(int|missing|str)", "union(int|missing|str)"), ("contact", "object", "object"), ("contact.email", "str", "str"),
            ("contact.phone", "nullable str", "str"), ("created_at", "timestamp", "timestamp"), ("email", "str", "str"),
            ("gone", "nullable", "missing data"), ("id", "int", "int"), ("items", "array", "array"), ("items[0].qty", "int", "int"),
            ("items[0].sku", "str", "str"), ("legacy", "str", "str"), ("mess", "union(int|str)", "union(int|str)"), ("misc", "int", "int"),
            ("name", "nullable str", "str"), ("note", "any", "any"), ("pile", "array", "array"), ("pile[0].k", "str", "str"),
            ("score", "float", "float"), ("status", "union(int|str)", "union(int|str)"), ("tags", "nullable array", "array"), ("void", "str", "str"),
        ],
    ),
    "evo_basic": (
        ["path", "change", "old_type", "new_type", "breaking"],
        [
            ("active", "type_changed", "bool", "str", False), ("age", "type_changed", "int", "str", False),
            ("audit_log.entry.line", "added", None, "str", False), ("born", "type_changed", "date", "timestamp", False),
            ("both", "now_optional", "int", "str", False), ("both", "type_changed", "int", "str", False),
            ("code", "now_required", "union(int|str)", "union(int|str)", True), ("contact.email", "removed", "str", None, True),
            ("contact.phone", "now_required", "union(missing|str)", "str", True), ("contact.phone", "type_changed", "union(missing|str)", "str", True),
            ("email", "now_optional", "str", "str", False), ("gone", "type_changed", "missing", "str", True),
            ("is_premium", "added", None, "bool", False), ("legacy", "removed", "str", None, True), ("name", "removed", "str", None, True),
            ("needed", "added", None, "int", True), ("note", "type_changed", "any", "int", True), ("pile", "now_required", "array", "array", True),
            ("profile.name", "added", None, "str", True), ("score", "type_changed", "float", "int", True),
            ("tags", "now_required", "array", "array", True), ("updated_at", "added", None, "timestamp", False),
        ],
    ),
    "evo_breaking": (
        ["path", "old_type", "new_type", "breaking"],
        [
            ("active", "bool", "str", False), ("age", "int", "str", False), ("born", "date", "timestamp", False), ("both", "int", "str", False),
            ("contact.phone", "union(missing|str)", "str", True), ("gone", "missing", "str", True), ("note", "any", "int", True),
            ("score", "float", "int", True),
        ],
    ),
    "evo_advanced": (
        ["breaking", "types", "removed", "added", "depth_change", "score", "effort"],
        [
            (13, 8, 3, 5, 1, 60, "very_high"),
        ],
    ),
    "model_lookup": (
        ["path", "kind", "atoms"],
        [
            ("active", "scalar", "bool"), ("age", "scalar", "int"), ("bag", "array", "array"), ("born", "scalar", "date"), ("both", "scalar", "int"),
            ("contact.email", "scalar", "str"), ("created_at", "scalar", "timestamp"), ("email", "scalar", "str"), ("gone", "scalar", "missing"),
            ("id", "scalar", "int"), ("items", "array", "array"), ("legacy", "scalar", "str"), ("mess", "scalar", "int|str"),
            ("misc", "scalar", "int"), ("note", "scalar", "any"), ("score", "scalar", "float"), ("status", "scalar", "int|str"),
            ("void", "scalar", "str"),
        ],
    ),
    "mig_removals": (
        ["path", "critical"],
        [
            ("contact.email", True), ("items[0].qty", False), ("legacy", False), ("name", True), ("pile[0].k", False),
        ],
    ),
    "mig_types": (
        ["mismatches", "extent"],
        [
            (5, "some"),
        ],
    ),
    "mig_additions": (
        ["purpose", "n"],
        [
            ("business", 5), ("metadata", 1),
        ],
    ),
    "mig_presence": (
        ["n"],
        [
            (6,),
        ],
    ),
    "mig_paths": (
        ["moved", "extent"],
        [
            (2, "some"),
        ],
    ),
    "mig_analyze": (
        ["critical_removed", "removed", "added", "mismatches", "presence", "common", "verdict"],
        [
            (2, 5, 6, 5, 6, 7, "breaking"),
        ],
    ),
    "agg_categories": (
        ["category", "n", "percent"],
        [
            ("audit_fields", 12, 18.2), ("boolean_fields", 4, 6.1), ("classification_fields", 2, 3.0), ("identifier_fields", 37, 56.1),
            ("metric_fields", 7, 10.6), ("scd_fields", 2, 3.0), ("temporal_fields", 2, 3.0),
        ],
    ),
    "agg_suggest": (
        ["table_name", "suggestion"],
        [
            ("Orders", "require"), ("bridge_customer_group", "none"), ("broad", "split"), ("camel", "require"), ("clicks", "require"),
            ("customer_store_xref", "require"), ("dim_brand", "require"), ("dim_colour", "require"), ("dim_customer", "require"),
            ("dim_date", "require"), ("dim_employee", "require"), ("dim_maker", "require"), ("dim_product", "require"), ("documented", "none"),
            ("events_202401", "require"), ("events_202402", "require"), ("events_202403", "require"), ("fact_clicks", "require"),
            ("fact_sales", "require"), ("fact_visits", "require"), ("fct_stock", "require"), ("grain_fact", "require"), ("middling", "split"),
            ("nested_god", "require"), ("pre", "none"), ("triples", "require"), ("users", "require"), ("wrapped", "flatten"),
        ],
    ),
    "agg_policytags": (
        ["table_name", "fields", "tagged", "untagged_sensitive", "coverage"],
        [
            ("Orders", 34, 0, 0, 0.0), ("bridge_customer_group", 3, 0, 0, 0.0), ("broad", 101, 0, 0, 0.0), ("camel", 7, 0, 0, 0.0),
            ("clicks", 2, 0, 0, 0.0), ("customer_store_xref", 2, 0, 0, 0.0), ("dim_brand", 4, 0, 0, 0.0), ("dim_colour", 2, 0, 0, 0.0),
            ("dim_customer", 14, 0, 3, 0.0), ("dim_date", 4, 0, 0, 0.0), ("dim_employee", 4, 0, 0, 0.0), ("dim_maker", 4, 0, 0, 0.0),
            ("dim_product", 5, 0, 0, 0.0), ("documented", 8, 0, 0, 0.0), ("events_202401", 2, 0, 0, 0.0), ("events_202402", 2, 0, 0, 0.0),
            ("events_202403", 2, 0, 0, 0.0), ("fact_clicks", 3, 0, 0, 0.0), ("fact_sales", 25, 0, 1, 0.0), ("fact_visits", 3, 0, 0, 0.0),
            ("fct_stock", 5, 0, 0, 0.0), ("grain_fact", 6, 0, 0, 0.0), ("middling", 60, 0, 0, 0.0), ("nested_god", 26, 0, 0, 0.0),
            ("pre", 8, 0, 2, 0.0), ("triples", 24, 0, 0, 0.0), ("users", 44, 2, 4, 4.55), ("wrapped", 20, 0, 0, 0.0),
        ],
    ),
    "agg_complexity": (
        ["table_name", "fields", "required", "objects", "arrays", "scalars", "max_depth", "avg_depth"],
        [
            ("Orders", 34, 0, 5, 4, 28, 2, 1.5882), ("bridge_customer_group", 3, 2, 0, 0, 3, 1, 1.0), ("broad", 101, 0, 0, 0, 101, 1, 1.0),
            ("camel", 7, 0, 0, 0, 7, 1, 1.0), ("clicks", 2, 0, 0, 0, 2, 1, 1.0), ("customer_store_xref", 2, 0, 0, 0, 2, 1, 1.0),
            ("dim_brand", 4, 0, 0, 0, 4, 1, 1.0), ("dim_colour", 2, 0, 0, 0, 2, 1, 1.0), ("dim_customer", 14, 0, 0, 2, 12, 1, 1.0),
            ("dim_date", 4, 0, 0, 0, 4, 1, 1.0), ("dim_employee", 4, 0, 0, 0, 4, 1, 1.0), ("dim_maker", 4, 0, 0, 0, 4, 1, 1.0),
            ("dim_product", 5, 0, 0, 0, 5, 1, 1.0), ("documented", 8, 8, 0, 0, 8, 1, 1.0), ("events_202401", 2, 0, 0, 0, 2, 1, 1.0),
            ("events_202402", 2, 0, 0, 0, 2, 1, 1.0), ("events_202403", 2, 0, 0, 0, 2, 1, 1.0), ("fact_clicks", 3, 0, 0, 0, 3, 1, 1.0),
            ("fact_sales", 25, 0, 1, 1, 24, 2, 1.08), ("fact_visits", 3, 0, 0, 0, 3, 1, 1.0), ("fct_stock", 5, 0, 0, 0, 5, 1, 1.0),
            ("grain_fact", 6, 0, 0, 0, 6, 1, 1.0), ("middling", 60, 0, 0, 0, 60, 1, 1.0), ("nested_god", 26, 0, 4, 1, 22, 5, 4.6154),
            ("pre", 8, 1, 0, 0, 8, 1, 1.0), ("triples", 24, 0, 6, 3, 18, 3, 2.625), ("users", 44, 0, 0, 1, 43, 1, 1.0),
            ("wrapped", 20, 0, 17, 2, 3, 13, 5.35),
        ],
    ),
    "pii_classify": (
        ["leaf", "category", "indicators"],
        [
            ("birth_date", "personal_date", "birth_date"), ("cust_first_name", "name", "first_name"), ("cust_last_name", "name", "last_name"),
            ("email", "contact", "email"), ("first_name", "name", "first_name"), ("home_address", "location", "address,home_address"),
            ("last_login", "device_user_id", "login"), ("phone", "contact", "phone"), ("photo_link", "biometric", "photo"),
            ("row_uuid", "device_user_id", "uuid"),
        ],
    ),
    "canon_type": (
        ["native_type", "canonical"],
        [
            ("BOOL", "BOOLEAN"), ("BOOLEAN", "BOOLEAN"), ("DATE", "DATE"), ("DATETIME", "DATETIME"), ("FLOAT64", "FLOAT64"), ("INT64", "INT64"),
            ("INTEGER", "INT64"), ("NUMERIC", "NUMERIC"), ("RECORD", "RECORD"), ("STRING", "STRING"), ("TIMESTAMP", "TIMESTAMP"),
        ],
    ),
    "parse_bq_type": (
        ["native_type", "atom"],
        [
            ("BOOL", "bool"), ("BOOLEAN", "bool"), ("DATE", "date"), ("DATETIME", "datetime"), ("FLOAT64", "float"), ("INT64", "int"),
            ("INTEGER", "int"), ("NUMERIC", "number"), ("RECORD", "record"), ("STRING", "str"), ("TIMESTAMP", "timestamp"),
        ],
    ),
    "ddl_scalar": (
        ["native_type", "ddl_type"],
        [
            ("BOOL", "BOOL"), ("BOOLEAN", "BOOL"), ("DATE", "DATE"), ("DATETIME", "DATETIME"), ("FLOAT64", "FLOAT64"), ("INT64", "INT64"),
            ("INTEGER", "INT64"), ("NUMERIC", "NUMERIC"), ("STRING", "STRING"), ("TIMESTAMP", "TIMESTAMP"),
        ],
    ),
    "ddl_constraints": (
        ["table_name", "col", "ref_table", "ref_col"],
        [
            ("Orders", "customerName", "dim_customer", "customer_key"), ("bridge_customer_group", "customer_key", "dim_customer", "customer_key"),
            ("customer_store_xref", "customer_key", "dim_customer", "customer_key"), ("dim_product", "brand_code", "dim_brand", "brand_key"),
            ("fact_sales", "customer_key", "dim_customer", "customer_key"), ("users", "account_id", "dim_customer", "customer_key"),
        ],
    ),
    "ddl_dataset": (
        ["tables", "columns", "names"],
        [
            (28, 339, "Orders,bridge_customer_group,broad,camel,clicks,customer_store_xref,dim_brand,dim_colour,dim_customer,dim_date,dim_employee,dim_maker,dim_product,documented,events_202401,events_202402,events_202403,fact_clicks,fact_sales,fact_visits,fct_stock,grain_fact,middling,nested_god,pre,triples,users,wrapped"),
        ],
    ),
    "parse_dbt_dtype": (
        ["native", "atom"],
        [
            ("bigint", "int"), ("float64", "float"), ("super", "any"), ("text", "str"), ("timestamp with time zone", "timestamp"),
        ],
    ),
    "parse_sql_wrapper": (
        ["table_name", "path", "unwrapped"],
        [
            ("wrapped", "tags.list.element", "tags[0]"), ("wrapped", "tags.list.element.id", "tags[0].id"),
        ],
    ),
}
