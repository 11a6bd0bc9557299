"""Fixed values the results depend on.

FIXED VALUES — these must equal the behaviour being reproduced: file-suffix
tables, error patterns with their messages, routing words, the agent registry
and the agents' sampling settings. They are stated plainly, in their natural
order, and are used as small literal (broadcast) tables or `when` chains.
"""

from __future__ import annotations

# --- fixed values: backend suffix table (lower-cased suffix -> language) ---
BACKEND_SUFFIXES = [
    (".py", "python"),
    (".js", "javascript"),
    (".ts", "typescript"),
    (".jsx", "jsx"),
    (".tsx", "tsx"),
    (".java", "java"),
    (".cpp", "cpp"),
    (".c", "c"),
    (".go", "go"),
    (".rs", "rust"),
    (".rb", "ruby"),
    (".php", "php"),
    (".swift", "swift"),
    (".kt", "kotlin"),
    (".scala", "scala"),
    (".sh", "bash"),
    (".sql", "sql"),
]

# --- fixed values: chat-page suffix table (case-sensitive ends-with, in order) ---
UPLOAD_SUFFIXES = [
    (".py", "python"),
    (".js", "javascript"),
    (".ts", "typescript"),
    (".jsx", "jsx"),
    (".tsx", "tsx"),
    (".java", "java"),
    (".cpp", "cpp"),
    (".c", "c"),
    (".go", "go"),
    (".rs", "rust"),
    (".rb", "ruby"),
    (".php", "php"),
    (".swift", "swift"),
    (".kt", "kotlin"),
]

# --- fixed values: error patterns per language (pattern, message), in order ---
ERROR_PATTERNS = {
    "python": [
        (r"IndentationError", "Indentation error - check spacing"),
        (r"SyntaxError", "Syntax error - check code structure"),
        (r"NameError", "Name error - variable not defined"),
        (r"TypeError", "Type error - operation not supported"),
        (r"ValueError", "Value error - invalid value"),
        (r"AttributeError", "Attribute error - object has no attribute"),
        (r"KeyError", "Key error - dictionary key not found"),
        (r"IndexError", "Index error - list index out of range"),
    ],
    "javascript": [
        (r"SyntaxError", "Syntax error - check code structure"),
        (r"TypeError", "Type error - operation not supported"),
        (r"ReferenceError", "Reference error - variable not defined"),
        (r"RangeError", "Range error - value out of acceptable range"),
        (r"Cannot read propert(y|ies) of", "Property access error"),
    ],
    "java": [
        (r"Exception", "Exception thrown"),
        (r"NullPointerException", "Null pointer exception"),
        (r"ArrayIndexOutOfBoundsException", "Array index out of bounds"),
        (r"ClassNotFoundException", "Class not found"),
        (r"IOException", "IO error"),
    ],
}

# --- fixed values: bracket pairs checked for balance, in order ---
BRACKET_PAIRS = [("(", ")"), ("[", "]"), ("{", "}")]

# --- fixed values: function-definition patterns (Python `re` syntax), in order ---
FUNCTION_PATTERNS = {
    "python": [r"^\s*def\s+(\w+)\s*\((.*?)\)"],
    "javascript": [r"function\s+(\w+)\s*\((.*?)\)",
                   r"const\s+(\w+)\s*=\s*(?:async\s*)?\((.*?)\)\s*=>"],
    "typescript": [r"function\s+(\w+)\s*\((.*?)\)",
                   r"const\s+(\w+)\s*=\s*(?:async\s*)?\((.*?)\)\s*=>"],
    "java": [r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*\w+\s+(\w+)\s*\((.*?)\)"],
}
# The Python and JS/TS patterns are applied line-anchored (MULTILINE); Java's is not.
FUNCTION_MULTILINE = {"python": True, "javascript": True, "typescript": True, "java": False}

# --- fixed values: import patterns (Python `re` syntax, MULTILINE), in order ---
IMPORT_PATTERNS = {
    "python": [r"^\s*import\s+(.+)$", r"^\s*from\s+(.+?)\s+import\s+(.+)$"],
    "javascript": [r"^\s*import\s+.+?\s+from\s+['\"](.+?)['\"]", r"^\s*require\(['\"](.+?)['\"]\)"],
    "typescript": [r"^\s*import\s+.+?\s+from\s+['\"](.+?)['\"]", r"^\s*require\(['\"](.+?)['\"]\)"],
    "java": [r"^\s*import\s+(.+);"],
}

# --- fixed values: chat routing words, in order of precedence ---
ROUTE_WORDS = [
    ("debug", ["debug", "fix", "error", "bug"]),
    ("analyze", ["analyze", "review", "check", "security", "performance", "quality"]),
    ("docs", ["document", "doc", "docs", "documentation"]),
    ("orchestrate", ["task", "orchestrate", "execute", "multiple"]),
]
ROUTE_DEFAULT = "menu"

# --- fixed values: analysis type words (first hit wins), default ---
ANALYSIS_WORDS = ["security", "performance", "quality"]
ANALYSIS_DEFAULT = "comprehensive"

# --- fixed values: documentation type and style words (first hit wins), defaults ---
DOC_TYPE_WORDS = ["class", "module", "api"]
DOC_TYPE_DEFAULT = "function"
DOC_STYLE_WORDS = ["numpy", "sphinx"]
DOC_STYLE_DEFAULT = "google"

# --- fixed values: agent registry for orchestrated tasks ---
TASK_TYPES = ["debugger", "analyzer", "docs_generator"]

# --- fixed values: agent types of the message stream, and the error of any other ---
AGENT_TYPES = ["debugger", "analyzer", "docs_generator", "orchestrator"]
UNKNOWN_AGENT = "Unknown agent type: "

# --- fixed values: agent sampling settings (temperature, max tokens) ---
AGENT_SETTINGS = {
    "debugger": (0.3, 2048),
    "analyzer": (0.5, 3000),
    "docs_generator": (0.4, 3000),
}

# --- fixed values: task text and error prefix of an agent run that raised ---
AGENT_FAILURES = {
    "debugger": ("Debug code", "Debugger error: "),
    "analyzer": ("Analyze code", "Analyzer error: "),
    "docs_generator": ("Generate documentation", "Docs generator error: "),
    "orchestrator": ("Task orchestration", "Orchestrator error: "),
}

# --- fixed values: log rows of an orchestrated request ({} is the number of tasks) ---
ORCHESTRATION_MESSAGE = "Execute {} tasks"
ORCHESTRATION_TASK = "Execute {} tasks orchestration"
UNKNOWN_TASK = "Unknown task type: "

# --- fixed values: limits ---
RESULT_PREFIX_CHARS = 500      # execution log keeps the first 500 characters of a reply
LONG_LINE_CHARS = 100          # a line longer than this counts as long
CHARS_PER_TOKEN = 4            # token estimate: characters // 4
