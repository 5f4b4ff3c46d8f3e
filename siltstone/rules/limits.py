"""Limits, deductions, grades and category groups."""

MAX_UPLOAD_BYTES, MAX_PASTE_BYTES, MAX_REQUEST_BYTES = 5 * 1024 * 1024, 1024 * 1024, 5 * 1024 * 1024 + 512 * 1024
MAX_CONTENT_CHARS, MIN_TURNS, MAX_TURNS, CODE_CHARS, SHOWN_LINES = 5 * 1024 * 1024, 1, 50, 50, 1000
UPLOAD_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".vue", ".svelte"]
UPLOAD_MIME_TYPES = ["text/plain", "text/javascript", "application/javascript", "application/typescript"]
MEDIA_PREFIXES = ["image/", "video/", "audio/"]
ROLES = ["user", "assistant", "system"]
CATEGORIES = ["architecture", "security", "performance", "scalability", "maintainability", "general"]

# Severity, deduction.
DEDUCTIONS = [("critical", 25), ("high", 15), ("medium", 8), ("low", 3)]
LEAST_SCORE, DEFAULT_DEDUCTION = 10, 3
# Least score, grade, status.
GRADES = [
    (95, "A", "✅ Looks great"), (90, "A-", "✅ Looks clean"), (80, "B+", "⚠️ Review recommended"),
    (70, "B", "⚠️ Not production-ready"), (50, "C", "🚨 Needs refactoring"), (0, "D", "🚨 Critical vulnerabilities"),
]
NO_GRADE, WAITING, ANALYZING = "—", "Waiting for results", "⚡ Analyzing..."

WINDOW_MS, MAX_REQUESTS = 60_000, 10

# Guessed language, virtual file name, label, extension.
PASTE_NAMES = [("typescript", "pasted-input.ts", "TypeScript", ".ts"), ("javascript", "pasted-input.js", "JavaScript", ".js"), ("xml", "pasted-component.tsx", "TSX / JSX", ".tsx")]
PLAIN_PASTE, LEAST_RELEVANCE = ("pasted-snippet.txt", "Unknown / Plain Text", ".txt"), 2

# String members of a finding that a chat is about.
FINDING_TEXTS = ["id", "title", "category", "severity", "explanation", "recommendation"]
