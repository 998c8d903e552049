"""Declared schemas, in DDL; nothing is inferred from data."""

from __future__ import annotations

ITEMS = "parent_asin string, title string, store string, details map<string,string>, categories array<string>, price string, average_rating double, rating_number long"
RAW_REVIEWS = "parent_asin string, asin string, user_id string, rating double, title string, text string, helpful_vote int, verified_purchase boolean, timestamp long"
PRODUCTS = (
    "parent_asin string, title string, brand string, store string, is_renewed boolean, cpu_brand string, cpu_family string, cpu_tier double, cpu_ghz double, ram_gb double, ram_type string, "
    "storage_gb double, storage_type string, screen_in double, screen_w double, screen_h double, gpu_brand string, gpu_model string, is_discrete_gpu boolean, os_family string, weight_lb double, "
    "price double, price_is_missing boolean, average_rating double, rating_number long, segment string, n_reviews long, n_variants long"
)
REVIEWS = (
    "parent_asin string, orig_parent_asin string, asin string, user_id string, rating double, review_title string, text string, helpful_vote int, verified_purchase boolean, "
    "timestamp timestamp, review_year short, text_len int"
)
