"""They must keep exactly these values for results to agree."""

# Catalog build.
CATALOG_LANGUAGE = "pl"
TAXONOMY_PREFIX = "pl:"
PATH_SEPARATOR = " > "

# Letters that take part in camel-case and letter/digit splitting.
LOWER_LETTERS = "a-ząćęłńóśźż"
UPPER_LETTERS = "A-ZĄĆĘŁŃÓŚŹŻ"

# Search.
TOP_K = 50
SCORE_THRESHOLD = 550.0
FIELD_WEIGHTS = {
    "names": 3.0,
    "brands": 2.0,
    "categories": 1.5,
    "labels": 1.0,
    "quantity": 0.5,
}
SPECIFICITY_STEP = 0.1
MAX_FIELD_SCORE = 100.0

# Relevance (Robertson & Zaragoza, 2009).
BM25_K1 = 1.2
BM25_B = 0.75
SCORE_DIGITS = 6

# Accent folding used by the tokeniser.
FOLD_FROM = "ąćęłńóśźż"
FOLD_TO = "acelnoszz"

# Query rewriting.
LEVEL_MODELS = {1: "gpt-3.5-turbo", 2: "gpt-4"}
VALID_PRODUCT = "valid_product"
REPHRASED = "rephrased_successfully"
NOT_A_PRODUCT = "not_a_product"
NO_MATCH_FOUND = "no_match_found"
OFFLINE_ERROR = "OpenAI client not available"

# Report.
REPORT_COLUMNS = [
    "Number",
    "Input string",
    "Given Name",
    "Score",
    "ID",
    "Categories",
    "Product Names",
]
TEXT_ROW = "Mongo"
FUZZY_ROW = "Fuzzy"
LEVEL_ROWS = {1: "level-1", 2: "level-2"}
REWRITE_ROW_ID = "AI"

# Every character Python's str.strip() removes, derived from the Unicode data.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
