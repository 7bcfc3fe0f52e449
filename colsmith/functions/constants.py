"""Patterns, word lists and placeholder sets.

They have to be these exact values for results to agree with existing profiles.
"""

# Share-of-values patterns for strings (anchored at the start when applied).
VALUE_PATTERNS = {
    "matches_iso_datetime": r"\d{4}-\d{2}-\d{2}",
    "matches_date_pattern": r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    "matches_boolean_tf": r"(?i:T|F|True|False)$",
    "matches_boolean_yn": r"(?i:Y|N|Yes|No)$",
    "matches_boolean_01": r"[01]$",
    "matches_numeric_pattern": r"-?\d+\.?\d*$",
    "matches_currency_pattern": r"\$?£?€?¥?\d+[,\.]?\d*",
    "matches_phone_pattern": r"\+?1?\d{9,15}$|\(\d{3}\)\s*\d{3}-\d{4}$",
    "matches_email_pattern": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "matches_url_pattern": r"https?://[^\s]+$",
}

# Any-value patterns for strings (searched anywhere).
CONTENT_PATTERNS = {
    "has_currency_symbols": r"[$£€¥]",
    "has_percentage_symbol": r"%",
    "has_extra_whitespace": r"\s{2,}",
    "has_special_chars": r"(?U)[^\w\s]",
    "has_delimiters": r"[,;|/\t]",
}

DOMAIN_PATTERNS = {
    "currency": r"[\$€£¥₹]\s*\d+(?:,\d{3})*(?:\.\d{2})?$",
    "stock_ticker": r"[A-Z]{1,5}$",
    "credit_card": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$",
    "ssn": r"\d{3}-\d{2}-\d{4}$",
    "ein": r"\d{2}-\d{7}$",
    "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{1,30}$",
    "swift": r"[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$",
    "percentage": r"\d+(?:\.\d+)?%$",
    "icd_code": r"[A-Z]\d{2}(?:\.\d{1,3})?$",
    "cpt_code": r"\d{4}[A-Z0-9]$",
    "mrn": r"\d{6,12}$",
    "tracking": r"[A-Z0-9]{10,25}$",
}

# Patterns whose number of hits makes up the pattern complexity (searched anywhere).
COMPLEXITY_PATTERNS = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d+\.\d+",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"https?://",
    r"[$£€¥]",
    r"%",
    r"\(\d{3}\)",
)

EMBEDDED_NULL_PATTERNS = (
    r"\bna\b", r"\bn/a\b", r"\bnull\b", r"\bnone\b", r"\bnan\b",
    r"\bmissing\b", r"\bunknown\b", r"^-+$", r"^\?+$", r"^\*+$",
)

NULL_NUMBERS = (-999, -9999, 99999, 999999, -1)
NULL_WORDS = ("missing", "unknown", "n/a", "null", "?", "-", "none", "undefined")
NULL_DATES = ("1900-01-01", "1970-01-01", "0000-00-00", "9999-12-31")

ORDINAL_SCALES = (
    ("low", "medium", "high"),
    ("small", "medium", "large"),
    ("never", "sometimes", "always"),
    ("bad", "good", "excellent"),
    ("poor", "fair", "good", "excellent"),
)

TRUE_WORDS = ("true", "yes", "1", "t", "y", "on")
FALSE_WORDS = ("false", "no", "0", "f", "n", "off")

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
CURRENCY_NOISE = r"[$,€£¥₹\s]"

# Formats tried in turn when text is read as a date or time.
DATETIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "MM-dd-yyyy", "dd MMM yyyy", "MMM dd, yyyy",
)

# Semantic type patterns, first detector. Case is ignored where (?i) says so.
SEMANTIC_PATTERNS = {
    "url": r'(?i)^https?://[^\s<>"{}|\\^`\[\]]+$',
    "phone": r"^\+\d{1,4}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}$|^\(\d{3}\)\s*\d{3}[-.\s]?\d{4}$"
             r"|^\d{10,15}$|^\d{3}[-.\s]\d{3}[-.\s]\d{4}$",
    "iso": r"^\d{4}[-/]\d{2}[-/]\d{2}([T\s]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$",
    "date": r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$|^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"
            r"|^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}$|^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}$",
    "uuid": r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",
    "alnum": r"^[a-zA-Z0-9]+$",
    "blank": r"\s",
}

# Semantic type patterns, second detector (on trimmed values).
SECOND_PATTERNS = {
    "numeric_string": r"^-?\d+[,\d]*\.?\d*$",
    "currency": r"^[\$€£¥₹]\s*-?\d+[,\d]*\.?\d*$|^-?\d+[,\d]*\.?\d*\s*[\$€£¥₹]$",
    "percentage": r"^-?\d+\.?\d*\s*%$",
    "boolean_tf": r"(?i)^(?:true|false|t|f)$",
    "boolean_yn": r"(?i)^(?:yes|no|y|n)$",
    "boolean_01": r"^[01]$",
    "boolean_onoff": r"(?i)^(?:on|off)$",
    "iso_datetime": r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?",
    "us_date": r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    "eu_date": r"^\d{1,2}-\d{1,2}-\d{2,4}$",
    "named_date": r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{1,2},?\s*\d{4}$",
    "phone": r"^\+?1?\d{9,15}$|^\(\d{3}\)\s*\d{3}-\d{4}$|^\d{3}[-.\s]?\d{3}[-.\s]?\d{4}$",
    "url": r"^https?://[^\s]+$|^www\.[^\s]+$",
}

# "Looks like" patterns of the 62 features.
LOOKS_PATTERNS = {
    "web": r"^https?://",
    "call": r"^\+?[\d\s\-\(\)]{7,}$",
    "zip": r"^\d{5}(-\d{4})?$",
    "money": r"^[\$€£¥]\s*[\d,]+\.?\d*$",
    "code": r"^[A-Z0-9]{2,10}$",
    "special": r"""[!@#$%^&*()+=\[\]{};':"\\|,.<>?/~`]""",
    "delimited": r"[,|;]\s*(?U:\w)",
}

NULL_INDICATORS = ("na", "n/a", "null", "none", "missing", "?", "-", "", "nan", "nil", "undefined")

BOOLEAN_SETS = (("true", "false"), ("t", "f"), ("yes", "no"), ("y", "n"), ("1", "0"), ("1.0", "0.0"))
BOOLEAN_WORDS = ("true", "false", "yes", "no", "0", "1", "y", "n", "t", "f")
BINARY_SETS = (("0", "1"), ("true", "false"), ("yes", "no"), ("positive", "negative"), ("good", "bad"),
               ("pass", "fail"), ("win", "lose"))
ORDINAL_WORDS = ("low", "medium", "high", "small", "large", "xs", "s", "m", "l", "xl")

# Name keywords of the first semantic detector.
NAME_HINTS = {
    "url": ("url", "link", "website", "href", "photo", "image", "img", "src"),
    "phone": ("phone", "mobile", "cell", "tel", "contact", "fax"),
    "email": ("email", "mail", "e-mail", "e_mail"),
    "identifier": ("id", "uuid", "guid", "hash", "key", "code", "ref", "index", "row"),
    "datetime": ("date", "time", "datetime", "timestamp", "created", "updated", "at", "on"),
    "text": ("name", "title", "description", "comment", "note", "text", "bio", "about"),
}

# First keyword found in the name gives the signal.
NAME_SIGNALS = (
    ("id", -1.0), ("key", -1.0), ("uuid", -1.0), ("timestamp", 0.8), ("date", 0.8), ("time", 0.8),
    ("price", 0.6), ("amount", 0.6), ("revenue", 0.6), ("cost", 0.6), ("age", 0.3), ("count", 0.3),
    ("category", 0.5), ("type", 0.5), ("status", 0.5),
)

SEMANTIC_KEYWORDS = (
    ("id", "key", "uuid", "guid", "identifier", "pk_", "fk_"),
    ("amount", "price", "cost", "revenue", "sales", "value", "count", "quantity", "total", "sum", "avg", "rate"),
    ("name", "type", "category", "status", "description", "label", "tag", "group", "class"),
    ("date", "time", "timestamp", "created", "updated", "modified", "datetime", "year", "month", "day"),
    ("target", "label", "class", "outcome", "result", "y", "prediction", "response"),
)
BUSINESS_KEYWORDS = (
    ("price", "cost", "revenue", "amount", "payment", "balance", "interest", "fee", "tax", "discount", "profit"),
    ("customer", "user", "client", "account", "subscriber", "member", "visitor", "guest"),
    ("product", "item", "sku", "inventory", "stock", "catalog"),
    ("date", "time", "timestamp", "period", "duration"),
    ("country", "city", "state", "zip", "postal", "address", "location", "region", "latitude", "longitude", "geo"),
)
NAME_GROUPS = {
    "id": ("id", "key", "uuid", "guid", "pk", "fk", "idx", "index"),
    "date": ("date", "dt", "day", "created", "updated", "modified"),
    "time": ("time", "hour", "minute", "second", "timestamp", "ts"),
    "price": ("price", "cost", "fee", "charge", "msrp", "retail"),
    "cost": ("cost", "expense", "spend", "expenditure"),
    "amount": ("amount", "amt", "total", "sum", "balance"),
    "count": ("count", "cnt", "num", "qty", "quantity", "number"),
    "num": ("num", "no", "number", "n_", "_n"),
    "rating": ("rating", "rate", "star", "review", "score"),
    "score": ("score", "point", "grade", "rank", "ranking"),
    "pct": ("pct", "percent", "percentage", "ratio", "%"),
    "ratio": ("ratio", "rate", "proportion", "share"),
    "code": ("code", "cd", "sku", "upc", "barcode", "isbn"),
    "type": ("type", "typ", "kind", "class"),
    "category": ("category", "cat", "group", "segment", "genre"),
    "status": ("status", "state", "flag", "active", "enabled"),
    "name": ("name", "title", "label", "description"),
    "desc": ("desc", "description", "comment", "note", "text"),
}
SHORT_NAME_GROUPS = {
    "has_id": ("id", "key", "uuid", "index"),
    "has_name": ("name", "title", "label"),
    "has_date": ("date", "time", "timestamp", "day", "month", "year"),
    "has_price": ("price", "cost", "amount", "revenue", "salary"),
    "has_count": ("count", "number", "quantity", "total"),
}

# Target detection by name.
TARGET_KEYWORDS = (
    "target", "label", "class", "output", "y", "price", "cost", "revenue", "sales", "income", "profit",
    "churn", "fraud", "default", "click", "convert", "purchase", "score", "rating", "grade", "rank",
    "survival", "outcome", "result", "status", "prediction", "predict", "forecasted",
)
STRONG_TARGET_KEYWORDS = ("target", "label", "class", "y", "price", "churn", "fraud")
EXACT_TARGETS = (
    "target", "label", "class", "y", "outcome", "result", "selling_price", "sale_price", "price", "sales_price",
    "churn", "fraud", "default", "clicked", "converted", "is_fraud", "is_churn", "is_default", "has_churned",
    "survived", "survival",
)
TARGET_EXCLUSIONS = (
    "id", "uuid", "guid", "key", "index", "row", "date", "time", "timestamp", "datetime", "created", "updated",
    "url", "link", "path", "file", "image", "photo", "email", "phone", "address", "zip", "postal",
    "name", "title", "description", "comment", "note", "count", "num_", "total_", "sum_", "avg_", "mean_",
)
TARGET_EXCLUSIONS_ANYWHERE = ("id", "uuid", "guid", "date", "time", "url", "email", "phone")
PROTECTED_KEYWORDS = ("price", "target", "label", "y", "churn", "fraud", "outcome", "sales", "revenue")
