"""Default parameters. Every operator takes them as arguments."""

# Results depend on these being exactly so.

# Word windows.
WINDOW_WORDS = 175
WINDOW_OVERLAP = 25

# Line patterns: a heading is "Condition 12A. Title", an outer section "SECTION B1: ...".
HEADING_PATTERN = r"^Condition\s+(\d+[A-Z]{0,3}(?:\.[A-Z])?)[.:]\s+(.+)"
OUTER_PATTERN = r"^(SECTION\s+[A-Z][0-9]?):\s*(.*)"
PAGE_NUMBER_PATTERN = r"^\d{1,3}$"
HEADING_KEYWORD = "Condition"

# Lexical ranking.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
TITLE_WEIGHT = 8

# List depths.
CANDIDATES = 10
DEEP_CANDIDATES = 40
TOP_K = 6
LANDSCAPE_SIZE = 25
MAX_SUBQUERIES = 6
UNION_BUDGET = 40

# Fusion and refusal.
RRF_K = 60
DISTANCE_FLOOR = 1.6

# Context expansion.
WHOLE_CHUNKS = 8
STRONG_ENTITIES = 2
STRONG_CHUNKS = 30

# History rows per answer.
HISTORY_NARROW = 2
HISTORY_BROAD = 8

# Change detection and diffs.
MIN_PRESENT_CHARS = 30
SMALL_EDIT_RATIO = 0.97
DIFF_CONTEXT_WORDS = 6
DIFF_BUDGET_WORDS = 140
REPORT_CANDIDATES = 12

# Sizing of our own jobs (not result-relevant).

SCAN_BLOCK = 4096          # order values per task group in blocked running totals
COMPARE_BLOCK_CHARS = 4096  # characters compared per row in change detection
TASK_ROWS = 250_000        # rows that one task sorts by entity
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
VECTOR_DIMS = 64
