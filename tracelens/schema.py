"""Schemas of traces and judge records. Members without a fixed shape are JSON strings; line_num is the row's place in its file."""

PAGE = "STRUCT<fetch_backend:STRING,fetch_status:STRING,http_status:INT,content_type:STRING,final_url:STRING,reader_url:STRING,artifact_path:STRING,truncated_by_max_bytes:BOOLEAN,extractor:STRING,extracted_text_chars:BIGINT,extracted_text_tokens_estimate:BIGINT,text_sha256:STRING,fetch_latency_ms:DOUBLE,error:STRING,extracted_text:STRING>"
RESULT = f"STRUCT<document_id:STRING,rank:INT,title:STRING,url:STRING,snippet:STRING,domain:STRING,provider_metadata:STRING,page_fetch:{PAGE}>"
RETRIEVAL = f"STRUCT<retrieval_id:STRING,retrieval_index:INT,iteration_num:INT,tool_call_id:STRING,search_query:STRING,search_response:STRUCT<provider_id:STRING,query:STRING,latency_ms:DOUBLE,timestamp:STRING,raw_response:STRING,results:ARRAY<{RESULT}>>>"
FETCH = f"STRUCT<fetch_id:STRING,iteration_num:INT,tool_call_id:STRING,requested_document_id:STRING,url:STRING,reason:STRING,seen_in_search_results:BOOLEAN,source_retrieval_id:STRING,source_document_id:STRING,source_search_query:STRING,source_rank:INT,source_title:STRING,source_domain:STRING,source_snippet:STRING,page_fetch:{PAGE}>"
USAGE = "STRUCT<prompt_tokens:BIGINT,completion_tokens:BIGINT,total_tokens:BIGINT>"
ITERATION = f"STRUCT<iteration_num:INT,llm_request:STRING,llm_response:STRING,llm_tool_calls:STRING,llm_usage:{USAGE},llm_latency_ms:DOUBLE,agent_decision:STRING,searches:ARRAY<STRUCT<retrieval_id:STRING>>,fetches:ARRAY<STRUCT<fetch_id:STRING>>>"
TRACE = (
    "schema_version STRING, trace_id STRING, run_id STRING, started_at STRING, ended_at STRING, dataset STRUCT<name:STRING,subset:STRING,selection:STRING>, "
    "query_id STRING, source_index BIGINT, question STRING, gold_answer STRING, gold_urls ARRAY<STRING>, "
    "metadata STRUCT<freshness:STRING,topic:STRING,search_results:STRING,question_types:ARRAY<STRING>,effective_year:STRING>, provider_id STRING, model_id STRING, "
    "config STRUCT<max_iterations:INT,max_results_per_search:INT,page_fetch_enabled:BOOLEAN,fetch_tool_enabled:BOOLEAN>, "
    f"iterations ARRAY<{ITERATION}>, retrievals ARRAY<{RETRIEVAL}>, fetches ARRAY<{FETCH}>, "
    "final_response STRING, final_answer STRING, answered BOOLEAN, ceiling_hit BOOLEAN, total_search_calls BIGINT, total_fetch_calls BIGINT, "
    "total_prompt_tokens BIGINT, total_completion_tokens BIGINT, total_cost_usd DOUBLE, wall_time_seconds DOUBLE, failed BOOLEAN, failure_stage STRING, errors STRING"
)
JUDGMENT = "STRUCT<contains_gold_answer:BOOLEAN,gold_answer_in_snippets:BOOLEAN,gold_answer_in_extracted_page:BOOLEAN,supports_model_answer:BOOLEAN,contradicts_gold_answer:BOOLEAN,is_garbage:BOOLEAN,garbage_reason:STRING,answer_span:STRING,gold_snippet_span:STRING,gold_extracted_page_span:STRING,confidence:DOUBLE>"
JUDGE = (
    "schema_version STRING, judge_type STRING, query_id STRING, provider_id STRING, document_id STRING, retrieval_id STRING, source_document_id STRING, search_query STRING, "
    "rank INT, title STRING, url STRING, normalized_url STRING, domain STRING, page_fetch_source STRING, judge_surface_class STRING, judge_snippet_surface_signature STRING, "
    "judge_page_fetch_signature STRING, model_fetched_document BOOLEAN, fetch_tool_record_id STRING, fetch_tool_requested_document_id STRING, fetch_tool_iteration_num INT, "
    f"page_fetch {PAGE}, document_garbage_precheck STRUCT<is_garbage:BOOLEAN,category:STRING,reason:STRING>, effective_is_garbage BOOLEAN, "
    f"messages ARRAY<STRUCT<role:STRING,content:STRING>>, judgment {JUDGMENT}, execution_error STRING, judgment_parse_error STRING, seq BIGINT"
)
#: The versions that rows name.
TRACE_VERSION, JUDGE_VERSION, SUMMARY_VERSION = "searchapi_trace_v1", "kimi_judge_record_v3", "page_fetch_summary_v1"
