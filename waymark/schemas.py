"""Schemas of the store. Missing values are '' / 0 / '[]', as the merge rules expect; epochs are seconds as doubles."""

from __future__ import annotations

DISCOVERIES = (
    "id long, ident_hash_hex string, b32_addr string, i2p_dns_name string, probe_mode string, reachable int, status_code int, "
    "body_length long, response_time double, via_method string, title string, content_type string, detected_lang string, "
    "content_summary string, content_hash string, last_modified string, found_links string, flags string, needs_review int, "
    "error_msg string, probed_at double, deep_analysis string"
)
TARGETS = (
    "id long, ident_hash_hex string, b32_addr string, i2p_dns_name string, source string, source_site string, provenance_chain string, "
    "dest_data string, last_probed_at double, first_seen_at double, last_updated_at double, backoff_until double, last_analyzed_at double, "
    "susi_active int, consecutive_failures int, crawl_depth int"
)
ROUTERS = (
    "ident_hash_hex string, key_type int, version int, bandwidth_kbps int, options_mask int, published int, file_size int, caps string, "
    "i2p_dns_name string, source string, updated_at double"
)
LEASESETS = "ident_hash_hex string, store_type int, num_leases int, options_mask int, leases_v1_count int, file_size int, i2p_dns_name string, source string, updated_at double, created_at double"
TRANSPORTS = "ident_hash_hex string, ip string, port int, protocol string, published boolean, created_at double"
SMOKE = (
    "run_at double, name string, url string, success boolean, status_code int, body_length long, response_time double, content_type string, summary_preview string, "
    "found_links string, needs_review boolean, review_reason string, stages array<struct<name:string,ok:boolean,detail:string,elapsed_sec:double>>, checks map<string,boolean>, failure_reasons array<string>"
)
FLAG = "array<struct<type:string,value:string>>"

#: Columns of a probe log row that a later row with an empty value doesn't overwrite, and their empty value.
KEPT = {"i2p_dns_name": "", "title": "", "error_msg": "", "found_links": "[]", "flags": "[]"}
#: Columns that an upsert never touches.
UNTOUCHED = ("id", "deep_analysis")
