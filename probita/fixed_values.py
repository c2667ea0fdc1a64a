"""Word lists, tables, thresholds and patterns that results depend on.

Everything here is data, stated plainly and in one place. Nothing in this module computes.
"""

# --- screening -----------------------------------------------------------------------------
CONFIRMED_THRESHOLD = 0.85
POSSIBLE_THRESHOLD = 0.55
CORROBORATION_FLOOR = 0.55
MATCH_WEIGHTS = {"name": 0.30, "alias": 0.15, "dob": 0.15, "nationality": 0.10, "company": 0.15, "context": 0.15}
UNKNOWN_ATTRIBUTE = 0.5
UNKNOWN_CONTEXT = 0.3
MATCH_LIMIT = 25
KEY_LENGTH = 4
CONTEXT_CHARS = 1000
FIXTURE_SUFFIX = " (SAMPLE FIXTURE)"

COUNTRY_CODES = {
    "ae": "AE", "uae": "AE", "united arab emirates": "AE",
    "af": "AF", "afghanistan": "AF",
    "au": "AU", "australia": "AU",
    "ca": "CA", "canada": "CA",
    "ch": "CH", "switzerland": "CH",
    "cn": "CN", "china": "CN", "people's republic of china": "CN", "prc": "CN",
    "cy": "CY", "cyprus": "CY",
    "de": "DE", "germany": "DE",
    "fr": "FR", "france": "FR",
    "gb": "GB", "uk": "GB", "united kingdom": "GB", "great britain": "GB", "england": "GB",
    "hk": "HK", "hong kong": "HK",
    "in": "IN", "india": "IN",
    "ir": "IR", "iran": "IR", "islamic republic of iran": "IR",
    "jp": "JP", "japan": "JP",
    "kp": "KP", "north korea": "KP", "dprk": "KP", "korea, north": "KP",
    "kr": "KR", "south korea": "KR", "korea, south": "KR",
    "ky": "KY", "cayman islands": "KY",
    "lb": "LB", "lebanon": "LB",
    "nl": "NL", "netherlands": "NL",
    "pa": "PA", "panama": "PA",
    "qa": "QA", "qatar": "QA",
    "ru": "RU", "russia": "RU", "russian federation": "RU",
    "sd": "SD", "sudan": "SD",
    "sg": "SG", "singapore": "SG",
    "sy": "SY", "syria": "SY", "syrian arab republic": "SY",
    "us": "US", "usa": "US", "united states": "US", "united states of america": "US",
    "ve": "VE", "venezuela": "VE",
    "vg": "VG", "british virgin islands": "VG",
    "vn": "VN", "vietnam": "VN", "viet nam": "VN",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# --- list files ----------------------------------------------------------------------------
SDN_COLUMNS = [
    "ent_num", "SDN_Name", "SDN_Type", "Program", "Title", "Call_Sign",
    "Vess_type", "Tonnage", "GRT", "Vess_flag", "Vess_owner", "Remarks",
]
ALT_COLUMNS = ["ent_num", "alt_num", "alt_type", "alt_name", "alt_remarks"]
LIST_NULL = "-0-"
SDN_SOURCE = "OFAC SDN"
SDN_URL = "https://www.treasury.gov/ofac/downloads/sdn.csv"
OPEN_LIST_SOURCE = "opensanctions"
OPEN_LIST_URL = "https://opensanctions.org/entities/"
SCREENABLE_SCHEMAS = ["Person", "Company", "LegalEntity", "Organization"]
DOB_PATTERN = r"(?i)DOB\s+(\d{1,2}\s+\w+\s+\d{4}|\d{4})"
NATIONALITY_PATTERN = r"(?i)nationality\s+([A-Za-z\s]+?)(?:;|$)"
AKA_PATTERN = r"(?i)a\.k\.a\.\s+'([^']+)'"

# --- ingestion -----------------------------------------------------------------------------
KYC_COLUMNS = [
    "client_id", "client_name", "client_type", "country", "sector",
    "sector_risk", "pep_flag", "sanctions_flag", "fatf_country_flag",
]
KYC_REQUIRED = ["client_id", "client_name", "client_type", "country", "sector"]
KYC_FLAGS = ["pep_flag", "sanctions_flag", "fatf_country_flag"]
KYC_EXTRA_COLUMNS = ["ofac_country_flag", "sectoral_sanctions_flag", "ownership_opacity_score"]
KYC_MAX_LENGTH = {"client_id": 64, "client_name": 256, "client_type": 64, "country": 64, "sector": 128}
TRUE_TOKENS = ["true", "1", "yes", "y", "t"]
FALSE_TOKENS = ["false", "0", "no", "n", "f"]
SECTOR_RISKS = {"low": "low", "medium": "medium", "med": "medium", "high": "high"}
LENIENT_TRUE = ["true", "yes", "y"]
MAX_FILE_MB = 50
QUALITY_PENALTY = {"low": 3, "medium": 10, "high": 25}
COMPLETENESS_FIELDS = ["client_name", "country", "sector", "sector_risk", "aliases"]

# --- risk scoring --------------------------------------------------------------------------
COMPONENT_MAX = {
    "kyc_profile_risk": 25, "sanctions_risk": 30, "transaction_risk": 25,
    "adverse_media_risk": 15, "jurisdiction_risk": 5,
}
LEVEL_MEDIUM, LEVEL_HIGH, LEVEL_CRITICAL = 31, 61, 81
REPORT_MIN_CONFIDENCE = 0.70
FLOORS = [(0.85, 85), (0.60, 65)]
MODEL_VERSION = "risk-engine-v2.0"
HIGH_RISK_SECTORS = ["crypto", "gambling", "arms", "defense", "precious metals", "money services"]
HIGH_RISK_COUNTRIES = ["iran", "north korea", "myanmar", "syria", "russia"]
FATF_COUNTRIES = ["iran", "north korea", "myanmar"]
TRUSTED_LISTS = ["ofac sdn", "opensanctions"]
TRUSTED_MEDIA = ["ofac sdn", "opensanctions", "government registry", "regulator", "reuters", "ap"]
LINKED_PARTY = ["ubo", "beneficial owner", "director", "signatory", "shareholder"]
SEVERITY_POINTS = {"low": 5, "medium": 8, "high": 11, "critical": 12}
SEVERITY_POINTS_OTHER = 6

# --- text ----------------------------------------------------------------------------------
ALLEGATION_TERMS = [
    "alleged", "allegedly", "accused", "investigation", "investigators",
    "sanctioned", "sanctions", "laundering", "fraud", "charged", "arrested",
    "seized", "frozen", "probe", "violation", "evasion", "illicit", "shell",
]
NEWS_HIGH = ["sanction", "laundering", "terror", "fraud", "corruption"]
NEWS_MEDIUM = ["investigation", "probe", "regulator"]

ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
LOOKALIKE_FROM = "авсеніјкморѕтухѵαεικνορτυχ"
LOOKALIKE_TO = "abcehijkmopstyxvaeikvoptux"

VERBS = r"(?:ignore|disregard|forget|discard|omit|skip|drop|bypass)"
NOUNS = r"(?:instruction|prompt|direction|guidance|rule|polic|context|message)"
SCOPES = r"(?:previous|prior|earlier|above|preceding|all|any|the)"
INJECTION_PATTERNS = [
    (rf"\b{VERBS}\b[^.!?]{{0,40}}\b{SCOPES}\b[^.!?]{{0,40}}\b{NOUNS}", "instruction override"),
    (rf"\bdo not\b[^.!?]{{0,20}}\b(?:follow|obey|apply|use)\b[^.!?]{{0,30}}\b{NOUNS}", "instruction override"),
    (r"\b(?:you are now|you're now|from now on|new task|new instructions?)\b", "role reassignment"),
    (r"(?:^|\n|#|\*)\s*(?:system|assistant|developer)\s*(?::|message)", "role-marker spoof"),
    (r"\bact as\s+(?:a|an|the)?\s*(?:compliance|admin|reviewer|auditor|analyst|system|assistant|officer)\b", "role impersonation"),
    (r"\b(?:override|bypass|suppress|clear|disable|remove)\b[^.!?]{0,30}\b(?:compliance|flag|risk|sanction|control|check|alert)", "control override"),
    (r"\b(?:mark|set|report|classify|treat|rate|score)\b[^.!?]{0,30}\b(?:as\s+)?(?:clean|low[\s-]?risk|no[\s-]?risk|not\s+sanctioned)\b", "verdict injection"),
    (r"\b(?:risk[_\s-]?score|sanctions?[_\s-]?match|match[_\s-]?score|confidence)[\"']?\s*(?:[=:]|\bis\b)\s*[\"']?\s*(?:0(?:\.0+)?|false|none|null)\b", "field injection"),
    (r"\bapprove\b[^.!?]{0,30}\b(?:all|pending|the)\b[^.!?]{0,20}\btransactions?\b", "action injection"),
]
DESPACED_PATTERNS = [
    (rf"{VERBS}(?:all|any)?{SCOPES}?(?:{NOUNS})", "instruction override"),
    (r"youarenow|newtask|newinstruction", "role reassignment"),
]

# Words of which a text must hold one from every group before a pattern above can match, in the same order.
_VERB_WORDS = ["ignore", "disregard", "forget", "discard", "omit", "skip", "drop", "bypass"]
_NOUN_WORDS = ["instruction", "prompt", "direction", "guidance", "rule", "polic", "context", "message"]
INJECTION_WORDS = [
    [_VERB_WORDS, ["previous", "prior", "earlier", "above", "preceding", "all", "any", "the"], _NOUN_WORDS],
    [["do not"], ["follow", "obey", "apply", "use"], _NOUN_WORDS],
    [["you are now", "you're now", "from now on", "new task", "new instruction"]],
    [["system", "assistant", "developer"], [":", "message"]],
    [["act as"], ["compliance", "admin", "reviewer", "auditor", "analyst", "system", "assistant", "officer"]],
    [["override", "bypass", "suppress", "clear", "disable", "remove"], ["compliance", "flag", "risk", "sanction", "control", "check", "alert"]],
    [["mark", "set", "report", "classify", "treat", "rate", "score"], ["clean", "risk", "sanctioned"]],
    [["risk", "sanction", "match", "confidence"], ["0", "false", "none", "null"], ["=", ":", "is"]],
    [["approve"], ["transaction"]],
]
DESPACED_WORDS = [[_VERB_WORDS, _NOUN_WORDS], [["youarenow", "newtask", "newinstruction"]]]

# Patterns for text that leaves the house, applied in this order.
EGRESS_PATTERNS = [
    ("internal_id", r"(?i)\b(?:CLIENT|CUST|CUSTOMER|ACCT|EVD|AUD)-\d+\b"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"),
    ("card_number", r"\b(?:\d[ -]?){13,19}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("aadhaar", r"\b\d{4}\s\d{4}\s\d{4}\b"),
    ("passport", r"\b[Pp]assport\s+(?:no\.?\s*)?[A-Z0-9]{6,9}\b"),
    ("phone", r"(?:\+\d{1,3}[ -]?)?\(?\d{3}\)?[ -]\d{3}[ -]\d{4}\b"),
    ("swift", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b(?=\s*(?:SWIFT|BIC))"),
]

# What a text must hold before a pattern above can match: a digit, or one of some letters or words.
EGRESS_NEEDS_DIGIT = ["internal_id", "card_number", "iban", "ssn", "aadhaar", "phone"]
EGRESS_NEEDS_TEXT = {"internal_id": ["-"], "email": ["@"], "ssn": ["-"], "passport": ["assport"], "swift": ["SWIFT", "BIC"]}

# Report redaction, applied in this order: (replacement, article, category, description, pattern).
REPORT_RULES = [
    ("[DOB_REDACTED]", "article5", "Data Retention", "Full date of birth — unnecessary for SAR narrative",
     r"(?i)\b(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b"),
    ("[NATIONAL_ID_REDACTED]", "article9", "Data Retention", "National ID / SSN — special category, data minimisation applies",
     r"\b\d{3}-\d{2}-\d{4}\b"),
    ("[PASSPORT_REDACTED]", "article9", "Data Retention", "Passport number — not required in SAR narrative",
     r"\b[A-Z]{1,2}\d{6,9}\b"),
    ("[EMAIL_REDACTED]", "article5", "First Party Collection/Use", "Email address — not required in SAR narrative",
     r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("[PHONE_REDACTED]", "article5", "First Party Collection/Use", "Phone number — not required in SAR narrative",
     r"\+\d{1,3}[\s.-]?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}\b"),
    ("[ACCT_REDACTED]", "article5", "Third Party Sharing/Collection", "Full account number — redacted per data minimisation",
     r"(?<!client_id[=: ])\b\d{7,}\b"),
]
BIRTH_WORDS = ["born", "dob", "birth", "d.o.b"]
BIRTH_WINDOW = 40
ACCOUNT_PATTERN = r"\b\d{7,}\b"

# --- citations -----------------------------------------------------------------------------
PROFILE_FIELDS = [
    "client_id", "client_name", "client_type", "sector", "sector_risk", "country",
    "pep_flag", "sanctions_flag", "fatf_country_flag", "ofac_country_flag",
    "sectoral_sanctions_flag", "ownership_opacity_score",
]
TRANSACTION_PREFIXES = ["txn:", "transaction:", "tx:"]
LIST_PREFIXES = ["ofac_sdn:", "ofac:", "opensanctions:", "sanctions:"]
UNCHECKED_SOURCES = ["pep_registry", "open_source", "llm_analysis"]
MIN_SUBSTRING = 4

# --- privacy -------------------------------------------------------------------------------
# field -> (class, default mask)
FIELD_CLASSES = {
    "client_id": ("internal", "pseudonymize"),
    "client_name": ("personal", "mask_name"),
    "client_type": ("internal", "none"),
    "country": ("internal", "none"),
    "sector": ("internal", "none"),
    "sector_risk": ("internal", "none"),
    "pep_flag": ("sensitive", "redact"),
    "sanctions_flag": ("sensitive", "redact"),
    "fatf_country_flag": ("internal", "none"),
    "aliases": ("highly_sensitive", "mask_name"),
    "created_at": ("internal", "none"),
    "updated_at": ("internal", "none"),
}
UNKNOWN_FIELD_CLASS = ("highly_sensitive", "redact")
# context -> field -> treatment; a field that is not listed is left out.
CONTEXT_TREATMENTS = {
    "internal_processing": {field: "raw" for field in FIELD_CLASSES},
    "logging": {"client_id": "mask", "client_type": "raw", "country": "raw", "sector_risk": "raw"},
    "entity_screening": {
        "client_id": "raw", "client_name": "raw", "client_type": "raw", "country": "raw", "aliases": "raw",
    },
    "human_review": {
        "client_id": "mask", "client_name": "mask", "client_type": "raw", "country": "raw", "sector": "raw",
        "sector_risk": "raw", "pep_flag": "raw", "sanctions_flag": "raw", "fatf_country_flag": "raw",
        "aliases": "mask", "created_at": "raw", "updated_at": "raw",
    },
    "agent_context": {"client_id": "mask", "client_type": "raw", "country": "raw", "sector_risk": "raw"},
    "external_response": {"client_id": "mask", "client_type": "raw"},
}
REDACTED = "[REDACTED]"
PSEUDONYM_PREFIX = "anon_"
PSEUDONYM_DIGITS = 16

# --- audit ---------------------------------------------------------------------------------
ZERO_GENESIS = "0" * 64
WORD_GENESIS = "GENESIS"
ACTION_PATTERN = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+$"
RESOURCE_PATTERN = r"^[a-z][a-z0-9_]*$"
MAX_ACTOR_ID, MAX_RESOURCE_TYPE, MAX_RESOURCE_ID, MAX_REQUEST_ID = 200, 100, 500, 64
EVENT_TYPES = [
    "HTTP_REQUEST", "AUTHENTICATION", "AUTHORIZATION", "INGESTION", "DATA_VALIDATION",
    "PII_PROCESSING", "ENCRYPTION", "SECRET_ACCESS", "SECURITY_CONFIGURATION",
]
OUTCOMES = ["SUCCESS", "FAILURE", "DENIED", "ERROR"]
SEVERITIES = ["INFO", "WARNING", "ERROR", "CRITICAL"]
ACTOR_TYPES = ["ANONYMOUS", "USER", "SERVICE", "SYSTEM"]
SENSITIVE_KEY_PARTS = [
    "password", "passwd", "secret_value", "secret_key", "client_secret", "token", "authorization",
    "api_key", "apikey", "encryption_key", "private_key", "vault_token", "credential", "cookie",
    "session_id", "refresh_token", "access_token", "signing_key", "hmac_key", "passphrase",
]
ALLOWED_KEYS = [
    "key_id", "secret_id", "secret_reference", "secret_name", "logical_secret_name", "resource_id",
    "resource_type", "source_id", "source_type", "artifact_id", "artifact_type", "provider_type",
    "permission", "required_permission", "algorithm", "mechanism",
]
MAX_DEPTH, MAX_STRING, MAX_ITEMS, MAX_KEYS = 4, 512, 20, 30
TRUNCATED_TEXT = "...[TRUNCATED]"
TRUNCATED_DEPTH = "[DEPTH_LIMIT_EXCEEDED]"
TRUNCATED_ITEMS = "[COLLECTION_TRUNCATED]"
SCREENING_ACTION, MEDIA_ACTION, INJECTION_ACTION = (
    "ENTITY_MATCH_CALCULATED", "ADVERSE_MEDIA_AGENT_RUN", "PROMPT_INJECTION_DETECTED",
)

# Characters that a text strip removes.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
