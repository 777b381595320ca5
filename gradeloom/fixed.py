"""Values that results must carry exactly: names, formats, tables, prompt text."""

# --- fixed values: score names and value kinds -------------------------------
JUDGE_SCORE = "llm-judge-score"
JUDGE_ERROR = "llm-judge-error"
SCHEMA_SCORE = "json-schema-valid"
TRUNCATION_SCORE = "response-truncated"
UNSCORED = "unscored"
NUMERIC = "NUMERIC"
CATEGORICAL = "CATEGORICAL"

# --- fixed values: trace naming ----------------------------------------------
TRACE_PREFIX = "eval:"
SESSION_PREFIX = "eval-"
DATASET_TAG = "dataset:"
PROVIDER_TAG = "provider:"
UNKNOWN = "(unknown)"
METADATA_LIMIT = 200

# --- fixed values: providers, accepted parameters, client defaults -----------
DEFAULT_PROVIDER = "groq"
LOCAL_CAPABLE_PROVIDER = "ollama"
DEFAULT_LOCAL_ENDPOINT = "http://localhost:11434"
PROVIDERS = ["groq", "nvidia", "gemini", "ollama"]
SUPPORTED_PARAMS = {
    "groq": ["model", "messages", "temperature", "max_completion_tokens", "top_p", "response_format"],
    "nvidia": [
        "model", "messages", "temperature", "max_completion_tokens", "top_p", "response_format",
        "reasoning_effort",
    ],
    "gemini": ["model", "messages", "temperature", "max_completion_tokens", "top_p", "response_format"],
    "ollama": [
        "model", "messages", "temperature", "max_completion_tokens", "top_p", "response_format",
        "repeat_penalty", "think", "seed", "keep_alive",
    ],
}
CLIENT_DEFAULTS = {
    "groq": {"temperature": "0.6", "max_completion_tokens": "2048", "top_p": "0.95"},
    "nvidia": {"temperature": "0.6", "max_completion_tokens": "2048", "top_p": "0.95"},
}

# --- fixed values: media ------------------------------------------------------
MIME_BY_EXTENSION = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "avif": "image/avif",
}
MIME_FALLBACK = "application/octet-stream"
INLINE_IMAGE_LABEL = "(inline data URL)"

# Template expression by which a captured request names an image file; the path is base64.
IMAGE_PATH_TEMPLATE = r"\$\{\[\s*fs\.readFile\(\s*path=b64'([^']*)'\s*,\s*encoding='base64'\s*\)\s*\]\}"

# --- fixed values: judge call -------------------------------------------------
JUDGE_MAX_TOKENS = 512
JUDGE_TEMPERATURE = "0"
JUDGE_MODEL = "openai/gpt-oss-20b"
JUDGE_PROMPT_BEFORE_INPUT = (
    'You are a strict, impartial evaluator of LLM outputs.\n\nTask given to the model:\n"""\n'
)
JUDGE_PROMPT_BEFORE_OUTPUT = '\n"""\n\nModel\'s response:\n"""\n'
JUDGE_PROMPT_BEFORE_CRITERIA = '\n"""\n\nEvaluation criteria:\n"""\n'
JUDGE_PROMPT_AFTER_CRITERIA = (
    '\n"""\n\n'
    "Score the response from 1 to 5, where:\n"
    "1 = completely fails the criteria\n"
    "2 = mostly fails, minor redeeming qualities\n"
    "3 = partially meets the criteria\n"
    "4 = mostly meets the criteria, minor issues\n"
    "5 = fully meets the criteria\n\n"
    "Respond with ONLY a JSON object, no markdown fences, no extra text, in exactly this shape:\n"
    '{"score": <integer 1-5>, "reasoning": "<one or two sentence explanation>"}'
)

# --- fixed values: request limits ---------------------------------------------
MAX_BACKOFF_SECONDS = 30.0
MIN_INTERVAL_MS = {"groq": 2200, "nvidia": 2200, "gemini": 0, "ollama": 0}
MAX_RETRIES = {"groq": 5, "nvidia": 5, "gemini": 3, "ollama": 2}
MAX_BACKOFF_SECONDS_OF = {"groq": 30.0, "nvidia": 30.0, "gemini": 10.0, "ollama": 10.0}

# --- fixed values: report -----------------------------------------------------
TIE_MARGIN = 0.005
DEFAULT_LAST_SESSIONS = 5
DEFAULT_SINCE_DAYS = 30

# --- fixed values: traffic kinds ----------------------------------------------
TRAFFIC_KINDS = [
    ("/otel/", "spans (OTLP)"),
    ("/ingestion", "score writes"),
    ("/media", "media uploads"),
]

# --- fixed values: the blanks that trimming removes ---------------------------
TRIM_CHARACTERS = (
    "\t\n\u000b\f\r   "
    "           "
    "    　﻿"
)

# --- fixed values: texts of score comments and reasons ------------------------
CUT_OFF = ("Provider stopped generation early (done_reason: ", "). The output is incomplete.")
FINISHED = ("Provider finished normally (done_reason: ", ").")
UNPARSEABLE = ("Not parseable as JSON: ", ". First 200 chars: ")
CONFORMS = ("Valid JSON matching the schema (", " constraints checked).")
VIOLATES = ("Valid JSON but does not match the schema (", " problem(s), ", " constraints passed): ")
MISSING_PROPERTY = "required property is missing"
UNEXPECTED_PROPERTY = "unexpected property"
WRONG_TYPE = ("expected ", ", got ")
NOT_IN_ENUM = " is not one of "
JUDGE_CUT_OFF = ("Judge response was truncated at ", " tokens, so no verdict could be read. Raw: ")
JUDGE_UNREADABLE = ("Failed to parse judge output (", "). Raw: ")
JUDGE_NOT_JSON = "not valid JSON"
JUDGE_NO_SCORE = "score is not a finite number"
JUDGE_CALL_FAILED = "Judge call failed: "

# --- fixed values: structured output ------------------------------------------
RESPONSE_FORMAT = ('{"type":"json_schema","json_schema":{"name":"eval_response","strict":true,"schema":', "}}")
