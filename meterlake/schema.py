"""Schemas of the usage log."""

from __future__ import annotations

TOKENS = ("input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens", "cache_tokens", "total_tokens")

#: The fact table: one row for each request.
EVENTS = (
    "api string, model string, ts timestamp, utc_offset string, latency_ms long, ttft_ms long, api_key string, api_key_hash string, "
    "source string, provider string, auth_id string, auth_index string, auth_type string, base_url string, "
    "thinking struct<intensity:string,mode:string,level:string,budget:long>, "
    "input_tokens long, output_tokens long, reasoning_tokens long, cached_tokens long, cache_tokens long, total_tokens long, "
    "failed boolean, status_code int, failure string, headers map<string,array<string>>, ingest_seq long"
)
EVENT_COLUMNS = tuple(x.split(" ")[0] for x in EVENTS.replace("struct<intensity:string,mode:string,level:string,budget:long>", "s").replace("map<string,array<string>>", "m").split(", "))

#: What makes two rows the same request.
DEDUP_KEY = ("api", "model", "ts", "source", "auth_index", "failed", *TOKENS)

DETAIL = (
    "struct<model:string,timestamp:string,latency_ms:long,ttft_ms:long,api_key:string,api_key_hash:string,source:string,provider:string,"
    "auth_id:string,auth_index:string,auth_type:string,base_url:string,thinking:struct<intensity:string,mode:string,level:string,budget:long>,"
    "tokens:struct<input_tokens:long,output_tokens:long,reasoning_tokens:long,cached_tokens:long,cache_tokens:long,total_tokens:long>,"
    "failed:boolean,status_code:int,failure:string,headers:map<string,array<string>>>"
)
LINE = f"api string, model string, detail {DETAIL}, _corrupt string"
SNAPSHOT = (
    "version int, exported_at string, plugin string, detail_count long, "
    f"usage struct<total_requests:long,success_count:long,failure_count:long,total_tokens:long,apis:map<string,struct<models:map<string,struct<details:array<{DETAIL}>>>>>>"
)
PRICES = "updated_at string, prices map<string,struct<prompt:double,completion:double,cache:double>>"
PRICE_TABLE = "model string, prompt double, completion double, cache double"
