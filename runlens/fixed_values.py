"""Results depend on these being exactly what they are."""

# Failure categories, in report order.
CATEGORIES = (
    "ASSERTION_FAILURE",
    "LOCATOR_FAILURE",
    "TIMEOUT_FAILURE",
    "NETWORK_FAILURE",
    "API_FAILURE",
    "CONFIGURATION_FAILURE",
    "UNKNOWN_FAILURE",
)
UNKNOWN_CATEGORY = "UNKNOWN_FAILURE"
UNKNOWN_SIGNATURE = "UNKNOWN_SIGNATURE"

# Ordered category rules (case-insensitive, first match wins).
CATEGORY_RULES = (
    ("CONFIGURATION_FAILURE", (
        r"browserType\.launch", r"browser\.newContext", r"browser\.newPage", r"fixture.*browser",
        r"executable.*does.*not.*exist", r"browser.*not.*found", r"context.*already.*closed",
    )),
    ("ASSERTION_FAILURE", (
        r"expect\s*\(", r"toEqual", r"toContain", r"toBeTruthy", r"toBeFalsy", r"toBeNull", r"toBeDefined",
        r"toBeUndefined", r"toBeGreaterThan", r"toBeLessThan", r"toMatch", r"toThrow", r"toHaveURL",
        r"toHaveTitle", r"toHaveText", r"toHaveValue", r"toHaveClass", r"toHaveCount", r"toHaveAttribute",
        r"toHaveCSS", r"toHaveId", r"toHaveScreenshot", r"call\s+to\s+locator",
    )),
    ("NETWORK_FAILURE", (
        r"net::ERR_", r"ECONNREFUSED", r"ENOTFOUND", r"ECONNRESET", r"ETIMEDOUT", r"socket hang up",
        r"fetch failed",
    )),
    ("API_FAILURE", (
        r"api.*fail", r"api.*error", r"status.*is\s+\d{3}", r"request.*aborted", r"response.*not.*ok",
        r"response.*status.*5\d{2}", r"response.*status.*4\d{2}",
    )),
    ("TIMEOUT_FAILURE", (r"timeout", r"timed out", r"ms exceeded")),
    ("LOCATOR_FAILURE", (
        r"strict mode violation", r"strict locator violation", r"waiting for locator", r"locator.*not found",
        r"element.*not.*found", r"no element", r"element.*not.*visible", r"element.*not.*attached",
        r"element.*not.*stable", r"element.*not.*enabled", r"element.*not.*editable", r"unable to locate",
        r"cannot find", r"page\.locator", r"getByRole", r"getByText", r"getByLabel", r"getByPlaceholder",
        r"getByTestId", r"getByAltText", r"getByTitle",
    )),
)

# Ordered signature rules per category (case-insensitive, first match wins).
SIGNATURE_RULES = (
    ("ASSERTION_FAILURE", (
        ("EXPECT_TO_HAVE_URL", r"toHaveURL"),
        ("EXPECT_TO_HAVE_TITLE", r"toHaveTitle"),
        ("EXPECT_TO_HAVE_TEXT", r"toHaveText"),
        ("EXPECT_TO_HAVE_VALUE", r"toHaveValue"),
        ("EXPECT_TO_HAVE_CLASS", r"toHaveClass"),
        ("EXPECT_TO_HAVE_COUNT", r"toHaveCount"),
        ("EXPECT_TO_HAVE_ATTRIBUTE", r"toHaveAttribute"),
        ("EXPECT_TO_HAVE_CSS", r"toHaveCSS"),
        ("EXPECT_TO_HAVE_ID", r"toHaveId"),
        ("EXPECT_TO_HAVE_SCREENSHOT", r"toHaveScreenshot"),
        ("EXPECT_TO_EQUAL", r"toEqual"),
        ("EXPECT_TO_CONTAIN", r"toContain"),
        ("EXPECT_TO_BE_TRUTHY", r"toBeTruthy"),
        ("EXPECT_TO_BE_FALSY", r"toBeFalsy"),
        ("EXPECT_TO_BE_NULL", r"toBeNull"),
        ("EXPECT_TO_BE_DEFINED", r"toBeDefined"),
        ("EXPECT_TO_BE_UNDEFINED", r"toBeUndefined"),
        ("EXPECT_TO_BE_GREATER_THAN", r"toBeGreaterThan"),
        ("EXPECT_TO_BE_LESS_THAN", r"toBeLessThan"),
        ("EXPECT_TO_MATCH", r"toMatch"),
        ("EXPECT_TO_THROW", r"toThrow"),
        ("EXPECT_TO_BE", r"\btoBe\b"),
        ("EXPECT_FAILURE", r"expect\s*\("),
    )),
    ("LOCATOR_FAILURE", (
        ("STRICT_MODE_VIOLATION", r"strict mode violation"),
        ("ELEMENT_NOT_VISIBLE", r"element.*not.*visible"),
        ("ELEMENT_NOT_ATTACHED", r"element.*not.*attached"),
        ("ELEMENT_NOT_STABLE", r"element.*not.*stable"),
        ("ELEMENT_NOT_ENABLED", r"element.*not.*enabled"),
        ("ELEMENT_NOT_EDITABLE", r"element.*not.*editable"),
        ("LOCATOR_NOT_FOUND", r"locator.*not found"),
        ("ELEMENT_NOT_FOUND", r"no element"),
        ("LOCATOR_NOT_FOUND", r"unable to locate"),
        ("LOCATOR_NOT_FOUND", r"cannot find"),
        ("LOCATOR_WAIT_TIMEOUT", r"waiting for locator"),
        ("LOCATOR_GET_BY_ROLE", r"getByRole"),
        ("LOCATOR_GET_BY_TEXT", r"getByText"),
        ("LOCATOR_GET_BY_LABEL", r"getByLabel"),
        ("LOCATOR_GET_BY_PLACEHOLDER", r"getByPlaceholder"),
        ("LOCATOR_GET_BY_TEST_ID", r"getByTestId"),
        ("LOCATOR_GET_BY_ALT_TEXT", r"getByAltText"),
        ("LOCATOR_GET_BY_TITLE", r"getByTitle"),
        ("LOCATOR_PAGE", r"page\.locator"),
    )),
    ("TIMEOUT_FAILURE", (
        ("LOCATOR_WAIT_TIMEOUT", r"waiting for locator"),
        ("PAGE_WAIT_TIMEOUT", r"waitForTimeout"),
        ("TIMEOUT", r"timeout"),
    )),
    ("NETWORK_FAILURE", (
        ("NETWORK_CONNECTION_REFUSED", r"ECONNREFUSED"),
        ("NETWORK_DNS_FAILURE", r"ENOTFOUND"),
        ("NETWORK_CONNECTION_RESET", r"ECONNRESET"),
        ("NETWORK_TIMEOUT", r"ETIMEDOUT"),
        ("NETWORK_SOCKET_HANGUP", r"socket hang up"),
        ("NETWORK_FETCH_FAILED", r"fetch failed"),
        ("NETWORK_ERROR", r"net::ERR_"),
    )),
    ("API_FAILURE", (
        ("API_STATUS_5XX", r"status.*5\d{2}"),
        ("API_STATUS_4XX", r"status.*4\d{2}"),
        ("API_RESPONSE_5XX", r"response.*status.*5\d{2}"),
        ("API_RESPONSE_4XX", r"response.*status.*4\d{2}"),
        ("API_REQUEST_ABORTED", r"request.*aborted"),
        ("API_RESPONSE_NOT_OK", r"response.*not.*ok"),
        ("API_FAILURE", r"api.*fail"),
        ("API_FAILURE", r"api.*error"),
    )),
    ("CONFIGURATION_FAILURE", (
        ("CONFIG_EXECUTABLE_NOT_FOUND", r"executable.*does.*not.*exist"),
        ("CONFIG_BROWSER_LAUNCH", r"browserType\.launch"),
        ("CONFIG_BROWSER_CONTEXT", r"browser\.newContext"),
        ("CONFIG_BROWSER_PAGE", r"browser\.newPage"),
        ("CONFIG_FIXTURE", r"fixture.*browser"),
        ("CONFIG_CONTEXT_CLOSED", r"context.*already.*closed"),
    )),
)

# Ordered error-type rules; every pattern of one tuple must match.
ERROR_TYPE_RULES = (
    ("AssertionError", (r"expect\s*\(",)),
    ("TimeoutError", (r"timeout", r"ms exceeded")),
    ("StrictModeViolation", (r"strict mode violation",)),
    ("NetworkError", (r"net::ERR_",)),
    ("ConnectionRefused", (r"ECONNREFUSED",)),
    ("SocketHangUp", (r"socket hang up",)),
    ("FetchFailed", (r"fetch failed",)),
    ("APIError", (r"api.*fail",)),
    ("APIError", (r"api.*error",)),
    ("StatusError", (r"status.*is\s+\d{3}",)),
    ("BrowserLaunchError", (r"browserType\.launch",)),
    ("ExecutableNotFound", (r"executable.*does.*not.*exist",)),
    ("ContextClosedError", (r"context.*already.*closed",)),
    ("LocatorError", (r"page\.locator",)),
    ("LocatorError", (r"waiting for locator",)),
    ("ElementNotFound", (r"element.*not.*found",)),
    ("ElementNotFound", (r"no element",)),
    ("ElementNotVisible", (r"element.*not.*visible",)),
    ("LocatorError", (r"getByRole",)),
    ("LocatorError", (r"getByText",)),
)
UNKNOWN_ERROR_TYPE = "UnknownError"

# Source position patterns in error texts.
STACK_FRAME_PATTERN = r"\bat\s+(?:.+?\s+)?\(?([A-Za-z0-9_\\/.-]+\.(?:js|ts|jsx|tsx|mjs|cjs))\b"
STACK_FILE_PATTERN = r"([A-Za-z0-9_]+\.(?:js|ts|jsx|tsx))\s*:\s*\d+"

# Words that mark an authentication problem.
AUTH_WORDS = (
    "login", "authentication", "auth", "session", "401", "403", "logout", "password", "credential",
    "unauthorized", "forbidden", "token",
)

# Root causes with label and advice.
ROOT_CAUSES = (
    ("AUTH_FLOW_REGRESSION", "Authentication Flow Regression",
     "Review authentication flow, session handling, and login credentials. Check for recent changes to auth logic or token expiration."),
    ("UI_REGRESSION", "UI Regression",
     "Inspect UI changes, selector updates, and DOM structure. Verify locators match current page markup."),
    ("API_REGRESSION", "API Regression",
     "Review API contracts, endpoint availability, and response status codes. Check for service outages or version mismatches."),
    ("TIMEOUT_REGRESSION", "Timeout Regression",
     "Investigate performance regressions, slow page loads, and network latency. Consider increasing timeouts or optimising slow operations."),
    ("CONFIGURATION_REGRESSION", "Configuration Regression",
     "Check browser configuration, environment variables, and test dependencies. Verify setup scripts and test data fixtures."),
    ("UNKNOWN_ROOT_CAUSE", "Unknown Root Cause",
     "Review individual failure details and error messages. Consider adding classification rules for unrecognised patterns."),
)

# Root cause that follows from the category alone.
CATEGORY_ROOT_CAUSES = (
    ("LOCATOR_FAILURE", "UI_REGRESSION"),
    ("API_FAILURE", "API_REGRESSION"),
    ("NETWORK_FAILURE", "API_REGRESSION"),
    ("TIMEOUT_FAILURE", "TIMEOUT_REGRESSION"),
    ("CONFIGURATION_FAILURE", "CONFIGURATION_REGRESSION"),
)

# Advice per dominating failure category.
CATEGORY_ADVICE = (
    ("ASSERTION_FAILURE", "Review business rules and expected outcomes.",
     ("Verify application behaviour matches test assertions.",
      "Check for recent changes to expected data or UI state.")),
    ("LOCATOR_FAILURE", "Review selectors and recent UI changes.",
     ("Check for dynamic content, iframes, or shadow DOM changes.",
      "Verify locator strategies are resilient to DOM updates.")),
    ("TIMEOUT_FAILURE", "Review application response times and waiting strategy.",
     ("Consider increasing timeouts for slow operations.", "Add explicit waits for dynamic content.",
      "Optimize test performance by reducing unnecessary waits.")),
    ("NETWORK_FAILURE", "Review environment stability and API availability.",
     ("Check network connectivity and server health.",
      "Verify API endpoints are reachable from test environment.")),
    ("API_FAILURE", "Review API contracts, status codes, and endpoint health.",
     ("Verify API response handling matches expected status codes.",
      "Check for API contract changes or version mismatches.")),
    ("CONFIGURATION_FAILURE", "Review browser configuration, environment setup, and test dependencies.",
     ("Check browser versions and installed dependencies.",
      "Verify test data fixtures and environment variables.")),
    ("UNKNOWN_FAILURE", "Review raw error messages and extend classification rules if patterns emerge.",
     ("Update FailureClassifier rules to better categorize these failures.",
      "Check for unexpected error types not yet handled.")),
)
NO_FAILURE_ADVICE = "All tests passed. No issues detected."
MIXED_ADVICE = "Multiple failure types detected. Review recurring failures and failure groups first."
MIXED_ADVICE_DETAILS = (
    "No single category exceeds 40% of failures.",
    "Prioritise by occurrence count in the Failure Group Summary.",
)

# Statuses.
FINAL_STATUSES = ("PASSED", "FAILED", "SKIPPED", "TIMEDOUT", "INTERRUPTED")
FAILING_STATUSES = ("FAILED", "TIMEDOUT", "INTERRUPTED")
FAILING_STATUS_SPELLINGS = ("FAILED", "FAILED:", "FAIL", "TIMEDOUT", "INTERRUPTED")

# Metadata defaults of a run without metadata.
METADATA_DEFAULTS = (
    ("project", "Project"),
    ("feature", "Feature"),
    ("environment", "QA"),
    ("browser", "chromium"),
    ("automation_tool", "Playwright"),
    ("executed_by", "Automation Framework"),
)

# Web resources that are not API calls.
STATIC_EXTENSIONS = (
    ".css", ".js", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".woff", ".woff2", ".ttf", ".ico", ".webp",
)
STATIC_PATHS = ("/static/", "/assets/", "/dist/", "/public/", "/cdn/", "/images/", "/fonts/")
TELEMETRY_VENDORS = ("google-analytics", "segment", "mixpanel", "newrelic", "sentry")

# Patterns that name the element behind a selector, in order.
SELECTOR_NAME_PATTERNS = (
    r"""\[aria-label=["']?([^"'\]]+)["']?\]""",
    r"""label=["']?([^"']+)["']?""",
    r"""\[placeholder=["']?([^"'\]]+)["']?\]""",
    r"""getByRole\([^,]+,\s*\{\s*name:\s*["']([^"']+)["']""",
    r"""\[data-testid=["']?([^"'\]]+)["']?\]""",
    r"""\[data-test=["']?([^"'\]]+)["']?\]""",
    r"""#([\w-]+)""",
    r"""\[name=["']?([^"'\]]+)["']?\]""",
    r"""text=["']?([^"']+)["']?""",
    r"""\.([\w-]+)""",
)

# Locator factory to target type.
TARGET_TYPES = (
    ("getByRole", "role"),
    ("getByText", "text"),
    ("getByLabel", "label"),
    ("getByPlaceholder", "placeholder"),
    ("getByTestId", "testId"),
    ("getByAltText", "altText"),
    ("getByTitle", "title"),
)

UNFINISHED_MESSAGE = "Test did not complete before report generation."

# History storage contract.
HISTORY_SCHEMA_VERSION = "1.0.0"
RUN_ID_PATTERN = r"^\d{8}-\d{6}-\d{3}-[a-f0-9]{8}$"
SAFE_RUN_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
SHA256_PATTERN = r"^sha256:[a-f0-9]{64}$"
STORED_TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z$"
INPUT_TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?(?:Z|[+-]\d{2}:\d{2})$"
VERSION_TOKEN_PATTERN = r"^\d{1,6}\.\d{1,6}\.\d{1,6}(?:-[0-9A-Za-z.-]{1,32})?$"
INVALID_VERSION_TOKEN = "invalid-version-token"
ARTIFACT_TYPES = ("execution", "metadata", "pdf", "dashboard", "evidence", "traces", "trace")
IO_ERROR_CODES = ("ENOENT", "EACCES", "EPERM", "EIO", "EISDIR", "ENOTDIR")
METADATA_FIELDS = ("project", "feature", "environment", "browser", "executedBy")
AVAILABILITY_FIELDS = ("pdf", "dashboard", "evidence", "traces")
COUNT_FIELDS = (
    "total", "passed", "failed", "skipped", "timedOut", "interrupted", "unsuccessful",
    "traceReportedCount", "tracePreservedCount", "traceAvailableCount",
)
MAX_SAFE_INTEGER = 9007199254740991

# Texts of the history diagnostics.
DIAGNOSTIC_MESSAGES = (
    ("MISSING_SUMMARY", "Completed history run is missing summary.json."),
    ("CORRUPT_SUMMARY", "Completed history run contains corrupt summary.json."),
    ("UNSUPPORTED_SCHEMA", "Completed history run uses an unsupported summary schema."),
    ("INVALID_SUMMARY", "Completed history run contains an invalid summary."),
    ("AGGREGATION_UNUSABLE_SUMMARY",
     "Completed history run is valid storage but cannot be represented by the aggregation numeric contract."),
    ("UNREADABLE_RUN", "Completed history run summary.json could not be read."),
)

# Grouping dimensions and trend granularities.
TIME_DIMENSIONS = ("day", "week", "month")
GROUP_DIMENSIONS = TIME_DIMENSIONS + (
    "project", "feature", "environment", "browser", "executedBy", "schemaVersion", "migration",
)
GRANULARITIES = ("run",) + TIME_DIMENSIONS
TOP_LIST_SIZE = 5
