"""Word lists, thresholds, patterns and tables that define the results.

Everything here is data. Results depend on these exact values.
"""

# ---- fixed values: severities -------------------------------------------------
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]

# ---- fixed values: cardholder-data names --------------------------------------
SENSITIVE_KEYWORDS = [
    "pan", "cvv", "cvc", "cardnumber", "cardnum", "creditcard", "debitcard", "accountnumber", "expiry",
    "primaryaccountnumber", "securitycode", "verificationcode", "cardholder", "trackdata", "track1", "track2",
    "magneticstripe", "pinblock",
]
TEST_PREFIXES = ["test", "mock", "fake", "dummy", "stub"]
SAD_NAME_PATTERN = (
    r"(?i)\b(cvv2?|cvc2?|cid|card[_ ]?verification|security[_ ]?code|track[12]?([_ ]?data)?|magstripe"
    r"|pin([_ ]?block)?|encrypted[_ ]?pin)\b"
)
PAN_NAME_PATTERN = (
    r"(?i)\b(pan|card[_ ]?number|primary[_ ]?account[_ ]?number|account[_ ]?number|cardNo|ccNo|credit[_ ]?card)\b"
)
PAYMENT_INDICATORS = [
    "amount", "currency", "merchant", "transaction", "card", "billing", "payment", "price", "fee",
]
BANKING_SIBLINGS = [
    "iban", "bic", "swift", "routingnumber", "sortcode", "aba", "bankcode", "routingno", "accountno",
]
CARD_SCOPE_SIBLINGS = [
    "cvv", "cvc", "cvv2", "expirymonth", "expiryyear", "expirationdate", "cardholdername", "pan", "cardnumber",
    "primaryaccountnumber", "track1", "track2", "servicecode", "pinblock",
]
TOKENISATION_WORDS = ["token", "vault", "map", "lookup", "detok", "detokenize", "stubsource"]
SAD_FIELD_NAMES = [
    "CVV", "CVC", "CVC2", "CVV2", "SecurityCode", "Cvv", "Cvc", "Cvc2", "Cvv2", "cvv", "cvc", "cvc2", "cvv2",
    "securityCode",
]
TRANSIT_PATH_MARKERS = [
    "/requests/", "/request/", "/responses/", "/response/", "/dto/", "/dtos/", "/api/", "/client/", "/clients/",
    "/models/requests/", "/models/responses/", "/handler/", "/handlers/",
]

# ---- fixed values: issuer ranges (brand, prefix digits, low, high, lengths) ----
CARD_BRANDS = [
    ("visa", 1, 4, 4, [13, 16, 19]),
    ("mastercard", 2, 51, 55, [16]),
    ("mastercard", 4, 2221, 2720, [16]),
    ("amex", 2, 34, 34, [15]),
    ("amex", 2, 37, 37, [15]),
    ("discover", 4, 6011, 6011, [16, 17, 18, 19]),
    ("discover", 3, 644, 649, [16, 17, 18, 19]),
    ("discover", 2, 65, 65, [16, 17, 18, 19]),
    ("jcb", 4, 3528, 3589, [16, 17, 18, 19]),
]
PAN_MIN_DIGITS, PAN_MAX_DIGITS = 13, 19

# ---- fixed values: secrets ----------------------------------------------------
SECRET_PREFIXES = [
    ("AWS Access Key", "AKIA", 20),
    ("AWS Temporary Key", "ASIA", 20),
    ("GitHub PAT", "ghp_", 40),
    ("GitHub OAuth", "gho_", 40),
    ("GitHub User-to-Server", "ghu_", 40),
    ("GitHub Server-to-Server", "ghs_", 40),
    ("GitHub Refresh", "ghr_", 40),
    ("GitHub Fine-Grained PAT", "github_pat_", 82),
    ("GitLab PAT", "glpat-", 26),
    ("Stripe Live Secret", "sk_live_", 32),
    ("Stripe Live Public", "pk_live_", 32),
    ("Stripe Test Secret", "sk_test_", 32),
    ("Stripe Restricted", "rk_live_", 32),
    ("Google API Key", "AIza", 39),
    ("Slack Bot Token", "xoxb-", 50),
    ("Slack User Token", "xoxp-", 50),
    ("Slack App Token", "xoxa-", 50),
    ("Slack Socket Token", "xoxs-", 50),
    ("Slack Refresh Token", "xoxr-", 50),
    ("Anthropic API Key", "sk-ant-", 20),
    ("NPM Token", "npm_", 36),
    ("PyPI Token", "pypi-", 20),
    ("Shopify Private App", "shpat_", 32),
    ("Shopify Custom App", "shpca_", 32),
    ("Shopify Partner App", "shppa_", 32),
    ("SendGrid API Key", "SG.", 20),
    ("NVIDIA API Key", "nvapi-", 20),
    ("Groq API Key", "gsk_", 20),
]
CREDENTIAL_KEY_WORDS = [
    "password", "passwd", "secret", "apikey", "api_key", "token", "accesskey", "privatekey", "credential", "auth",
]
PLACEHOLDER_VALUES = [
    "xxx", "changeme", "todo", "fixme", "replace_me", "your_key", "your_secret", "your_token", "your_password",
    "example", "dummy", "test", "none", "null", "undefined", "n/a",
]
PLACEHOLDER_SUBSTRINGS = ["changeme", "replace_me", "your_", "fixme"]
PASSWORD_PLACEHOLDERS = ["changeme", "placeholder", "todo"]
CONNECTION_STRING_PATTERNS = [
    r"(?i)^postgres(ql)?://[^:]+:[^@]+@",
    r"(?i)^mysql://[^:]+:[^@]+@",
    r"(?i)^mongodb(\+srv)?://[^:]+:[^@]+@",
    r"(?i)^redis://[^@]*:[^@]+@",
    r"(?i)^amqps?://[^:]+:[^@]+@",
]
SQL_TEXT_PATTERN = r"(?i)^\s*(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE|DROP|ALTER|WITH)\s+"
PATH_URL_KEY_SUFFIXES = ["_path", "_dir", "_file", "_location", "_url", "_uri", "_endpoint", "_host"]
URL_SCHEME_PATTERN = r"(?i)^(http://|https://|file://|s3://|gs://)"
HOSTNAME_PATTERN = r"^[a-zA-Z0-9][a-zA-Z0-9-]*(\.[a-zA-Z0-9-]+)+(/\S*)?$"
FILE_PATH_PATTERN = r"""^(/|\./|\.\./|[a-zA-Z]:[\\/])[^\s='"`]+$"""
RELATIVE_PATH_PATTERN = r"^[a-zA-Z0-9_][a-zA-Z0-9._-]*/[a-zA-Z0-9._-]+/[a-zA-Z0-9._/-]+$"
NOISE_CHARACTERS_PATTERN = r"""[ \t='"`]"""
LONG_TOKEN_SEGMENT_PATTERN = r"^[a-zA-Z0-9]{20,}$"
ENTROPY_MIN_BYTES, ENTROPY_THRESHOLD = 16, 4.5

# ---- fixed values: hard-coded keys and passwords ------------------------------
KEY_WORDS = ["key", "secret", "iv", "token", "password", "salt", "credential", "apikey"]
PASSWORD_WORDS = ["password", "passwd", "passphrase", "dbpass", "dbpwd"]
VALUE_SUFFIX_WORDS = [
    "base64", "string", "password", "value", "data", "bytes", "pem", "jwe", "encoded", "path", "file", "dir",
]
SEMVER_PATTERN = r"^v?\d+\.\d+(\.\d+)?(-[a-zA-Z0-9.]+)?$"
URL_PATTERN = r"^https?://"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
BASE64_PATTERN = r"^[A-Za-z0-9+/]{32,}={0,2}$"
HEX_PATTERN = r"^(0x)?[0-9a-fA-F]{16,}$"
DOTTED_KEY_PATTERN = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+$"
URL_PATH_PATTERN = r"^/[a-zA-Z0-9][a-zA-Z0-9_\-.]*(/[a-zA-Z0-9][a-zA-Z0-9_\-.]*)+$"
UPPER_ENUM_PATTERN = r"^[A-Z][A-Z0-9_]+$"
CAMEL_IDENTIFIER_PATTERN = r"^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$"
CAMEL_MAX_BYTES, CAMEL_MAX_DIGITS = 32, 3
ERROR_PREFIXES = [
    "invalid ", "missing ", "bad ", "unknown ", "error ", "err ", "failed ", "cannot ", "could not ", "unable to ",
]
ALPHABET_RUN, CHARACTER_SET_MIN_BYTES, CHARACTER_SET_PERCENT = 10, 20, 70
HEADER_NAME_PATTERN = r"(?i)^(X-|Content-|Accept-|Authorization-|Cache-Control|Pragma|If-None-Match)"
SNAKE_CASE_PATTERN = r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"
JSON_KEY_PATTERN = r"^[a-zA-Z]+([A-Z][a-z]+)*$"
PURE_HEX_PATTERN = r"^[0-9a-fA-F]+$"
BASE64_CHARSET_PATTERN = r"^[A-Za-z0-9+/=_-]+$"
CONSTANTS_FILE_PATTERN = r"(^|/)(errors|headers|logger/keys|constant[^/]*)\.go$"
ERROR_VARIABLE_PATTERN = r"^Err[A-Z]"
ERROR_TEXT_WORDS = [
    "error", "fail", "invalid", "expired", "cannot", "unable", "missing", "denied", "unauthorized",
]
TEST_HELPER_SEGMENTS = ["testutil", "testutils", "test"]

# ---- fixed values: environments seen in paths ---------------------------------
PROD_SEGMENTS = ["prod", "production", "k8s", "kubernetes"]
PROD_FILES = [".env.prod", ".env.production"]
PROD_PREFIXES = ["config/prod.", "config/prod/", "config/production.", "config/production/"]
DEV_SEGMENTS = [
    "dev", "local", "docker", "fixtures", "test", "testseed", "e2e", "example", "examples", "sample", "samples",
]
EXAMPLE_SEGMENTS = ["example", "examples", "sample", "samples"]
DEDICATED_DEV_SEGMENTS = [
    "dev", "local", "development", "sandbox", "test", "testseed", "example", "examples", "sample", "samples",
]
DEV_FILE_PREFIXES = [
    "docker-compose.dev.", "docker-compose.local.", "docker-compose.override.", ".env.local", ".env.dev",
    ".env.development", ".env.example", ".env.sample", ".env.template", "config.example.", "config.sample.",
]
DEV_PLACEHOLDERS = [
    "password", "changeme", "secret", "example", "localhost", "127.0.0.1", "test123", "dummy", "placeholder",
]
LOCATION_LABELS = [
    (["test", "tests", "testing"], "test directory"),
    (["testdata"], "testdata directory"),
    (["dev", "development"], "development directory"),
    (["example", "examples"], "examples directory"),
    (["mock", "mocks"], "mocks directory"),
    (["fixture", "fixtures"], "fixtures directory"),
    (["vendor"], "vendor directory"),
]

# ---- fixed values: corpus scope -----------------------------------------------
DEFAULT_EXCLUDED_DIRS = [".git", "vendor", "node_modules", "testdata", ".idea", ".vscode"]
TEST_DIR_SEGMENTS = ["test", "testing", "mocks", "fixtures", "e2e"]
TEST_FILE_SUFFIX = "_test.go"
MAX_FILE_BYTES = 10 * 1024 * 1024

# ---- fixed values: weak algorithms --------------------------------------------
HASH_CONTEXT_WORDS = ["password", "secret", "key", "token", "pan", "cvv", "card", "pin", "auth"]
SHA256_CONTEXT_WORDS = ["password", "passwd", "pwd"]
HASH_PROXIMITY_LINES = 5
# Quoted text and comments, which hold neither calls nor names.
NOT_CODE = r"""\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|/\*.*?\*/|(?://|/\*).*$"""
PLAIN_HTTP_PATTERN = r'http://[^\s"]+'
LOCAL_HTTP_PATTERN = r"^http://(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|example\.com)(:|/|$)"
PROHIBITED_CIPHER_WORDS = ["RC4", "3DES", "NULL", "EXPORT", "ANON"]
WEAK_TLS_VERSIONS = ["VersionSSL30", "VersionTLS10", "VersionTLS11"]
PASSWORD_MIN_LENGTH = 12

# ---- fixed values: pages ------------------------------------------------------
PAYMENT_FORM_WORDS = [
    "card", "cvv", "pan", "expiry", "checkout", "payment", "credit", "cardholder", "account-number", "card-number",
    "cvc", "ccn",
]
PAYMENT_FORM_ATTRIBUTES = ["name", "id", "class", "type", "action", "placeholder"]
CALLBACK_SEGMENTS = ["callback", "callbacks"]

# ---- fixed values: schema columns ---------------------------------------------
CARD_TABLE_WORDS = [
    "card", "cards", "creditcard", "creditcards", "debitcard", "debitcards", "paymentmethod", "paymentmethods",
    "token", "tokens", "vault", "wallet",
]
CARD_CONTEXT_COLUMNS = ["number", "account", "code", "verification"]
EXPIRY_CONTEXT_COLUMNS = ["expmonth", "expyear", "expirationmonth", "expirationyear", "month", "year"]
EXPIRY_COLUMNS = ["exp_month", "exp_year", "expiration_month", "expiration_year", "exp_date", "expiration_date"]
ACCOUNT_LIKE_COLUMNS = ["number", "account"]
PLAINTEXT_TYPE_PATTERN = (
    r"(?i)^(text|varchar(\([0-9]+\))?|character varying(\([0-9]+\))?|char(\([0-9]+\))?|citext|string)$"
)
CONSTRAINT_WORDS = ["primary", "foreign", "unique", "check", "constraint", "index", "key", "exclude"]

# ---- fixed values: retention --------------------------------------------------
RETENTION_KEYS = ["card", "pan", "cvv", "payment", "sensitive", "cardholder", "sad", "auth_data"]
TTL_KEYS = ["ttl", "expiry", "expiration", "retention", "max_age", "timeout"]
SCHEMA_DOC_ROOTS = ["swagger", "openapi", "$schema", "definitions", "paths", "components", "info"]
FLAG_FILE_WORDS = ["variants", "enabled", "percentage", "rollout", "defaultvariant", "targeting"]
SKIPPED_CONFIG_FILES = [
    "swagger.json", "swagger.yaml", "swagger.yml", "openapi.json", "openapi.yaml", "openapi.yml", "package.json",
    "package-lock.json", "tsconfig.json", "tsconfig.base.json", "composer.json",
]
SKIPPED_CONFIG_WORDS = ["example", "sample", "fixture", "mock", "demo"]
SKIPPED_CONFIG_DIRS = ["/docs/", "/swagger/", "/openapi/", "/flagd/"]
DEV_CONFIG_WORDS = ["dev", "local", "compose", "testutil", "testutils", "test"]

# ---- fixed values: audit trail and log records --------------------------------
AUDIT_FIELD_CATEGORIES = [
    (
        "user_identification",
        ["userid", "uid", "subject", "principal", "actor", "username", "accountid", "callerid", "operatorid"],
    ),
    ("timestamp", ["timestamp", "time", "ts", "createdat", "datetime", "date"]),
    (
        "event_type",
        [
            "action", "event", "eventtype", "operation", "method", "httpmethod", "url", "path", "endpoint",
            "requesttype",
        ],
    ),
    (
        "outcome",
        ["outcome", "result", "status", "httpstatus", "success", "error", "responsecode", "statuscode"],
    ),
    (
        "affected_resource",
        [
            "resource", "target", "object", "affected", "entity", "record", "item", "path", "endpoint", "table",
            "collection",
        ],
    ),
]
LOG_PAN_WORDS = [
    "pan", "primaryaccountnumber", "cardnumber", "iban", "cvv", "cvc", "securitycode", "accountnumber",
]
LOG_SECRET_WORDS = ["apikey", "password", "secret", "bearer"]
LOG_GENERIC_ID_WORDS = ["requestid", "traceid", "widgetid", "tenantid", "merchantid", "correlationid", "spanid"]
SAFE_LOG_FIELDS = [
    "x-request-id", "x-correlation-id", "x-trace-id", "user-agent", "referer", "request-id", "trace-id",
]

# ---- fixed values: payment context --------------------------------------------
PAYMENT_PATH_SEGMENTS = [
    "pay", "payment", "payments", "checkout", "check-out", "card", "cards", "transaction", "transactions", "charge",
    "charges", "refund", "refunds", "transfer", "transfers", "billing", "bill", "invoice", "invoices", "order",
    "orders", "purchase", "purchases", "tokenize", "detokenize", "token", "vault",
]
PAYMENT_NAME_WORDS = [
    "pay", "payment", "card", "checkout", "transaction", "charge", "refund", "transfer", "billing", "invoice",
    "purchase", "tokenize", "detokenize", "processcard", "handlecard",
]
TIER_1_WORDS = [
    "pay", "payment", "checkout", "charge", "transaction", "refund", "transfer", "billing", "card", "vault",
    "tokenize",
]
TIER_2_WORDS = ["invoice", "order", "purchase", "settlement", "merchant"]
TIER_3_WORDS = ["callback", "webhook", "notify"]
PAYMENT_DIR_SEGMENTS = [
    "/payment", "/payments", "/billing", "/checkout", "/card", "/invoice", "/tokens", "/transaction", "/order",
]
PAYMENT_SDK_WORDS = [
    "stripe", "paypal", "go-jose/go-jose", "braintree-go-sdk", "square/connect", "razorpay", "mollie", "adyen",
    "plaid", "checkout.com",
]
CARD_TYPE_WORDS = ["card", "pan", "token", "payment", "transaction", "invoice", "charge", "checkout"]
CARD_FIELD_WORDS = ["pan", "cvv", "cardnumber", "cardnum", "expiry", "expirydate", "cvc", "cardholder"]
PAYMENT_SCORE_THRESHOLD = 2

# ---- fixed values: suppression markers by file type ---------------------------
INLINE_MARKERS = [
    ([".go"], ["// pci-ignore:", "//pci-ignore:"], ""),
    ([".yaml", ".yml", ".env", ".toml"], ["# pci-ignore:", "#pci-ignore:"], ""),
    ([".html", ".tmpl", ".gohtml"], ["<!-- pci-ignore:", "<!--pci-ignore:"], "-->"),
]

# ---- fixed values: triage -----------------------------------------------------
HINT_PREFIXES = [
    ("AUDIT-NO-LOG", "check whether a middleware in the chain writes the audit log"),
    ("AUDIT-UNSTRUCTURED", "check whether a structured logger is attached by middleware"),
    ("CSP-MISSING", "check whether middleware or a reverse proxy sets the policy"),
    ("CSP-UNSAFE-INLINE", "check whether middleware adds a nonce or hash policy"),
    ("CSP-UNSAFE-EVAL", "check whether the application framework needs eval"),
    ("AUTH-MISSING-MFA", "check whether MFA is enforced by the infrastructure"),
    ("CRYPTO-HARDCODED", "check whether the value is a test or example key"),
    ("SEC-", "check whether the value is injected from the environment at run time"),
]
DEFAULT_HINT = "read the surrounding lines and imports"
# Minutes for which a scan's result is used again.
REUSE_MINUTES = 10
LINK_RADIUS, SNIPPET_RADIUS, LINE_TOLERANCE, PAGE_SIZE = 10, 2, 2, 60
MIME_TYPES = [
    ([".go"], "text/x-go"),
    ([".html", ".htm"], "text/html"),
    ([".yaml", ".yml"], "text/yaml"),
    ([".toml"], "text/toml"),
    ([".json"], "application/json"),
]
DEFAULT_MIME = "text/plain"

# ---- fixed values: advisory snapshots (days) ----------------------------------
STALE_DAYS, CRITICAL_DAYS = 7, 15

# ---- fixed values: rule to primary requirement --------------------------------
RULE_REQUIREMENTS = [
    ("AUDIT-LOG-OK", "10.2.1"),
    ("AUDIT-NO-LOG", "10.2.1"),
    ("AUDIT-UNSTRUCTURED", "10.2.1"),
    ("AUTH-BYTE-COUNT", "8.3.6"),
    ("AUTH-HARDCODED-PWD", "8.6.2"),
    ("AUTH-MISSING-MFA", "8.4.2"),
    ("AUTH-WEAK-POLICY", "8.3.6"),
    ("AUTH-WEBHOOK-NO-SIGNATURE", "6.2.4"),
    ("AUTH-WEBHOOK-VERIFIED", "6.2.4"),
    ("CRYPTO-HARDCODED-KEY", "6.2.4"),
    ("CRYPTO-PLAIN-HTTP", "4.2.1"),
    ("CRYPTO-WEAK-HASH", "6.2.4"),
    ("CSP-MISSING", "6.4.3"),
    ("CSP-NO-SCRIPT-SRC", "6.4.3"),
    ("CSP-OK", "6.4.3"),
    ("CSP-UNSAFE-EVAL", "6.4.3"),
    ("CSP-UNSAFE-INLINE", "6.4.3"),
    ("CSP-VALUE-UNANALYZABLE", "6.4.3"),
    ("DEP-CACHE-COLD", "6.3.3"),
    ("DEP-CACHE-NO-DIR", "6.3.3"),
    ("DEP-CACHE-STALE", "6.3.3"),
    ("DEP-VULN", "6.3.3"),
    ("ERR-LEAK-DIRECT", "6.2.4"),
    ("ERR-LEAK-ENCODE", "6.2.4"),
    ("ERR-LEAK-FORMAT", "6.2.4"),
    ("ERR-LEAK-WRITE", "6.2.4"),
    ("FIM-REQUIRED", "11.6.1"),
    ("GORM-ENCRYPT-OK", "3.5.1"),
    ("GORM-NO-ENCRYPT-HOOK", "3.5.1"),
    ("GORM-SENSITIVE-TAG", "3.5.1"),
    ("HTTP-INPUT-ERROR", "6.2.4"),
    ("HTTP-INPUT-LOG", "10.2.1"),
    ("HTTP-INPUT-PANIC", "10.2.1"),
    ("HTTP-INPUT-TAINT-OFF", "10.2.1"),
    ("META-CSP-ONLY", "6.4.3"),
    ("META-CSP-UNSAFE", "6.4.3"),
    ("NONCE-MISSING", "6.4.3"),
    ("NONCE-MISSING-PAYMENT", "6.4.3"),
    ("PAN-KEYWORD", "3.5.1"),
    ("PAN-LITERAL", "3.4.1"),
    ("PAN-LOGGER", "3.5.1"),
    ("PAN-TYPE", "3.5.1"),
    ("PAN-ZEROING", "3.5.1"),
    ("RET-CONFIG-NO-TTL", "3.2.1"),
    ("RET-DB-SENSITIVE-STORE", "3.2.1"),
    ("RET-GORM-SENSITIVE-STORE", "3.2.1"),
    ("RET-REDIS-KEEP-TTL", "3.2.1"),
    ("RET-REDIS-NO-EXPIRE", "3.2.1"),
    ("RET-REDIS-NO-TTL", "3.2.1"),
    ("RET-ZERO-AFTER-RESPONSE", "3.2.1"),
    ("RET-ZERO-BEFORE-AUTH", "3.2.1"),
    ("RET-ZERO-DEFER-ONLY", "3.2.1"),
    ("SEC-CONNSTR", "8.6.2"),
    ("SEC-CREDENTIAL-KEY", "8.6.2"),
    ("SEC-HIGH-ENTROPY", "8.6.2"),
    ("SEC-PREFIX", "8.6.2"),
    ("SQL-SENSITIVE-COLUMN", "3.5.1"),
    ("SQL-TEXT-TYPE", "3.5.1"),
    ("SRI-MISSING", "6.4.3"),
    ("SRI-MISSING-PAYMENT", "6.4.3"),
    ("SUPPRESSED-PACKAGE", "n/a"),
    ("TLS-INSECURE-SKIP-VERIFY", "4.2.1"),
    ("TLS-MISSING-MIN-VERSION", "4.2.1"),
    ("TLS-WEAK-CIPHER", "4.2.1"),
    ("TLS-WEAK-VERSION", "4.2.1"),
]

# Pairs that the rules here use besides: a rule of our own, and fields that are authentication data rather than card numbers.
OWN_RULE_REQUIREMENTS = [
    ("AUDIT-FIELDS", "10.2.1"),
    ("PAN-KEYWORD", "3.3.1"),
    ("PAN-LOGGER", "3.3.1"),
    ("SQL-SENSITIVE-COLUMN", "3.3.1"),
]

# Words of the runs by which licence texts are compared, and the percentage of a text that must be licence text.
LICENCE_SHINGLE, LICENCE_COVERAGE = 5, 75

# ---- fixed values: licence marker phrases, most restrictive first --------------
LICENCE_MARKERS = [
    ("AGPL-3.0", r"(?i)GNU Affero General Public License"),
    ("LGPL-3.0", r"(?i)GNU Lesser General Public License"),
    ("GPL-3.0", r"(?i)GNU General Public License,? version 3"),
    ("GPL-2.0", r"(?i)GNU General Public License,? version 2"),
    ("MPL-2.0", r"(?i)Mozilla Public License,? (v\.|version )?2\.0"),
    ("CC-BY-NC-4.0", r"(?i)\bCC BY-NC 4\.0\b"),
    ("Apache-2.0", r"(?i)Apache License,? Version 2\.0"),
    ("BSD-3-Clause", r"(?i)BSD 3-Clause"),
    ("MIT", r"(?i)\bMIT License\b"),
]
