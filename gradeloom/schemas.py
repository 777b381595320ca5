"""Fixed table layouts, as Spark DDL."""

ITEMS = (
    "dataset_id string, item_id string, input string, criteria string, image string, "
    "options map<string,string>, response_format string, score_schema string"
)

MODELS = "model string, provider string, params map<string,string>"

GENERATIONS = (
    "observation_id string, session_id string, trace_name string, model string, "
    "tags array<string>, latency double, tokens_in bigint, tokens_out bigint, "
    "total_cost double, start_time timestamp, output string"
)

SCORES = (
    "observation_id string, name string, value_num double, value_str string, "
    "data_type string, comment string"
)

SESSIONS = "session_id string, created_at timestamp, environment string"

CONTENT_PARTS = "array<struct<type:string,text:string,url:string>>"
