"""Table schemas, as column lists that readers and parsers take."""

CHUNKS = (
    "chunk_id string, document_id string, document_name string, document_type string, target_index string, "
    "clause_id string, clause_title string, section_title string, section_level int, hierarchy_level int, "
    "content_type string, page_no int, page_number int, regulatory_strength string, "
    "cross_references array<string>, char_count int, sub_chunk_index int, text string, embedding array<float>"
)
EDGES = ("src string, dst string")
TASKS = (
    "project_id string, task_id string, task_name string, wbs string, start_date timestamp, end_date timestamp, "
    "original_duration int, remaining_duration double, percent_complete double, budget_cost double, "
    "actual_cost double, total_float double, critical boolean, resource_crew string, status string"
)
RELATIONSHIPS = (
    "project_id string, pred_task_id string, succ_task_id string, relationship_type string, lag_days int"
)
RESOURCES = (
    "project_id string, task_id string, resource_id string, resource_name string, units double, cost_per_unit double"
)
USAGE_EVENTS = (
    "event_id string, event_type string, ts timestamp, user_id string, session_id string, "
    "metadata map<string,string>, duration_ms bigint, success boolean"
)
RETRIEVAL_METRICS = (
    "query string, ts timestamp, results_count int, avg_score double, max_score double, min_score double, "
    "has_relevant_result boolean, user_feedback int"
)
USER_FEEDBACK = ("ts timestamp, event_id string, query string, rating int, feedback_text string")
CACHE = (
    "key string, value string, created_at timestamp, expires_at timestamp, access_count bigint, last_accessed timestamp"
)
REPORT_VERSIONS = (
    "report_id string, version_number int, version_id string, content_hash string, content string, "
    "created_at timestamp, created_by string, changes string"
)
LAB_ROWS = (
    "Sample_ID string, Depth_m double, Test_Type string, Parameter_Name string, Value double, Unit string"
)
BOREHOLE_CSV = (
    "Type string, Depth_From double, Depth_To double, Description string, SPT_N double, Key string, Value string"
)
BOREHOLE_LAYERS = "array<struct<depth_from_m: double, depth_to_m: double, description: string, spt_n: double>>"
BOREHOLE_JSON = (
    "borehole_id string, location map<string,double>, ground_level_m double, water_level_m double, "
    f"layers {BOREHOLE_LAYERS}"
)
SESSION_JSON = (
    "session_id string, saved_at string, "
    "chat_history array<struct<role: string, content: string>>, "
    "designer_messages array<struct<role: string, content: string>>, "
    "metadata map<string,string>"
)
