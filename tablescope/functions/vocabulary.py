"""Word lists, thresholds, labels and patterns that decide results."""

from __future__ import annotations

# --- Column-name keywords (substring test on the lower-cased name) ------------

DATE_KEYWORDS = (
    "date", "time", "timestamp", "datetime", "received", "incident", "created", "updated",
    "modified", "opened", "closed", "submitted", "reported", "recorded", "logged", "posted",
)

ID_KEYWORDS = (
    "id", "number", "num", "no", "code", "key", "index", "seq", "sequence", "ref", "reference",
    "identifier", "uuid", "guid", "sku", "hash", "claim", "ticket", "record", "row", "case",
)

FINANCIAL_KEYWORDS = (
    "amount", "price", "cost", "revenue", "salary", "pay", "wage", "fee", "value", "charge",
    "balance", "total", "sum", "budget", "spend", "expenditure", "income", "profit", "loss",
    "tax", "discount", "refund", "payment", "payout", "settlement", "close",
)

TEXT_KEYWORDS = (
    "description", "notes", "note", "comment", "remarks", "remark", "detail", "narrative",
    "summary", "text", "message", "feedback", "review", "memo", "body",
)

OUTCOME_KEYWORDS = (
    "status", "disposition", "outcome", "result", "decision", "verdict", "resolution", "conclusion",
)

MONEY_NAME_HINTS = (
    "amount", "price", "cost", "revenue", "salary", "pay", "fee", "value", "charge", "total", "close",
)

PERCENT_NAME_HINTS = ("pct", "percent", "percentage", "rate", "ratio")

# --- Words inside outcome values ----------------------------------------------

NEGATIVE_OUTCOME_WORDS = (
    "deny", "denied", "reject", "rejected", "fail", "failed", "close", "closed", "cancel",
    "cancelled", "lost",
)

POSITIVE_OUTCOME_WORDS = ("approve", "approved", "accept", "pass", "settle", "settled", "win")

# --- Missing-value tokens in text ---------------------------------------------

NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Semantic types ------------------------------------------------------------

TYPE_LABELS = {
    "id_column": "Identifier (not used in analysis)",
    "date_column": "Date / Time",
    "financial": "Financial Amount",
    "categorical": "Category",
    "metric": "Numeric Measurement",
    "high_cardinality": "Category (many values)",
    "text": "Free Text",
}
OTHER_LABEL = "Other"

CATEGORY_LIMIT = 50
ID_UNIQUENESS = 0.90

# --- Date text -------------------------------------------------------------------

# Each format with the shape a value must have before it is parsed (a failed parse is far dearer than
# a failed match).
STRICT_DATE_FORMAT = "yyyy-M-d"
DATE_FORMATS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-M-d H:m:s[.SSSSSS]": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$",
    "yyyy-M-d H:m": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$",
    "yyyy-M-d'T'H:m:s[.SSSSSS]": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
    "yyyyMMdd": r"^\d{8}$",
    "yyyy-M-d'T'H:m:s[.SSSSSS]XXX": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$",
    "M/d/yyyy h:m a": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2} [AP]M$",
    "MMMM d, yyyy": r"^[A-Z][a-z]{2,8} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Z][a-z]{2} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Z][a-z]{2,8} \d{4}$",
    "yyyy.M.d": r"^\d{4}\.\d{1,2}\.\d{1,2}$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    # Day first, taken where month first reads fewer rows: on a tie the earlier format wins.
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
}
# What a value of each shape leaves without digits, small letters and line ends, capitals as A; no other format can read it.
LINE_ENDS = "\n\r\u0085\u2028\u2029"  # before one of which the $ of a shape also matches
DATE_OUTLINES = {
    "yyyy-M-d": ("--",),
    "yyyy-M-d H:m:s[.SSSSSS]": ("-- ::", "-- ::."),
    "yyyy-M-d H:m": ("-- :",),
    "yyyy-M-d'T'H:m:s[.SSSSSS]": ("--A::", "--A::."),
    "yyyy/M/d": ("//",),
    "M/d/yyyy": ("//",),
    "M/d/yyyy H:m:s": ("// ::",),
    "M-d-yyyy": ("--",),
    "d-MMM-yyyy": ("-A-",),
    "MMM d, yyyy": ("A , ",),
    "yyyyMMdd": ("",),
    "yyyy-M-d'T'H:m:s[.SSSSSS]XXX": ("--A::A", "--A::.A", "--A::+:", "--A::.+:", "--A::-:", "--A::.-:"),
    "M/d/yyyy h:m a": ("// : AA",),
    "MMMM d, yyyy": ("A , ",),
    "d MMM yyyy": (" A ",),
    "d MMMM yyyy": (" A ",),
    "yyyy.M.d": ("..",),
    "d.M.yyyy": ("..",),
    "M/d/yy": ("//",),
    "d/M/yyyy": ("//",),
    "d/M/yyyy H:m:s": ("// ::",),
    "d-M-yyyy": ("--",),
    "d/M/yy": ("//",),
}
LAST_TWO_DIGIT_YEAR = 2068  # 69 is 1969
STRICT_DATE_SHARE = 0.50
ACCEPT_DATE_SHARE = 0.70

# --- Expected type of a column, from its values ---------------------------------

NUMERIC_TEXT_PATTERN = r"^-?\d+(\.\d+)?$"
CURRENCY_TEXT_PATTERN = r"\$|,"
EXPECTED_NUMERIC_SHARE = 0.85
EXPECTED_CURRENCY_SHARE = 0.60
EXPECTED_DATE_SHARE = 0.75
EXPECTED_ID_UNIQUENESS = 0.95

# --- Recommendations -----------------------------------------------------------------

RECOMMEND_MISSING_PCT = 30
RECOMMEND_MIN_DISTINCT = 1

# --- Quality score ----------------------------------------------------------------------

GRADES = ((90, "Excellent"), (75, "Good"), (60, "Fair"))
LOWEST_GRADE = "Needs Work"
MISSING_PENALTY_CAP, MISSING_PENALTY_RATE = 30.0, 10.0
DUPLICATE_PENALTY_CAP, DUPLICATE_PENALTY_RATE = 20.0, 4.0
OUTLIER_PENALTY_CAP, OUTLIER_PENALTY_RATE = 10.0, 0.5
SKEW_PENALTY = 5.0
SKEW_LIMIT = 1.0
MANY_OUTLIERS_PCT = 5.0
FENCE_FACTOR = 1.5
EXTREME_FACTOR = 10.0
WARNING_BELOW_PCT = 5.0
HEALTH_MISSING_PCT = 20.0
HEALTH_OUTLIER_PCT = 15.0
EVEN_SKEW = 0.5

# --- Insights -------------------------------------------------------------------------------

PLAUSIBLE_FROM = "2000-01-01 00:00:00"
YEARLY_ABOVE_DAYS = 730
MONTHLY_ABOVE_DAYS = 60
TREND_MIN_ROWS = 10
TREND_MIN_PERIODS = 2
TREND_STRONG_PCT, TREND_MILD_PCT = 25, 10
SEGMENT_COLUMNS = 4
DOMINANT_PCT, MAJORITY_PCT = 75, 50
COUNT_RATIO = 5
MONEY_RATIO = 2
MOSTLY_ZERO_PCT = 40
TOP_COLUMNS, TOP_VALUES = 2, 10
OUTCOME_MAJORITY_PCT = 50

# --- Charts -----------------------------------------------------------------------------------

INSIGHT_BINS, EXPLORER_BINS = 40, 50
BAR_LIMIT = 20
SCATTER_ROWS = 5000

# --- Cleaning -----------------------------------------------------------------------------------

ONE_HOT_LIMIT = 30
DUPLICATE_PREVIEW_ROWS = 50
SUGGEST_URGENT_PCT = 5.0

# --- Report ---------------------------------------------------------------------------------------

REPORT_TOP_CATEGORIES = 3
REPORT_TOP_SEGMENTS = 5
PROFILE_NUMERIC_COLUMNS = 8
CONTEXT_FINDINGS = 6


def has_keyword(name: str, keywords: tuple[str, ...]) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in keywords)


def type_label(semantic_type: str) -> str:
    return TYPE_LABELS.get(semantic_type, OTHER_LABEL)
