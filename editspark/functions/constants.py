"""Fixed values that define results: word lists, spellings, weights and boosts."""

# Spellings of units and their standard form.
UNITS = {
    "millimeter": "mm",
    "millimeters": "mm",
    "millimetre": "mm",
    "millimetres": "mm",
    "centimeter": "cm",
    "centimeters": "cm",
    "centimetre": "cm",
    "centimetres": "cm",
}

# Tokens of the highest weight (negation, severity, laterality and position, units).
CRITICAL = [
    "no", "not", "without", "absent", "denies", "negative", "none",
    "acute", "chronic", "subacute", "mild", "moderate", "severe", "marked", "gross",
    "right", "left", "bilateral", "anterior", "posterior", "superior", "inferior",
    "medial", "lateral", "proximal", "distal", "dorsal", "ventral", "upper", "lower",
    "mm", "cm", "m", "kg", "mg", "percent", "degree", "degrees",
]

# Tokens of the lowest weight.
FUNCTION_WORDS = [
    "the", "and", "of", "with", "in", "on", "at", "to", "a", "an", "is", "are",
    "was", "were", "be", "been", "being", "by", "for", "from", "or", "as", "into",
    "that", "this", "these", "those", "there", "has", "have", "had",
]

# Token weights; shares of the two sections; weights of changed, unchanged and unexpected fields.
CRITICAL_WEIGHT, CONTENT_WEIGHT, FUNCTION_WEIGHT = 4.0, 2.0, 0.25
FINDINGS_SHARE, IMPRESSION_SHARE = 0.65, 0.35
CHANGED, UNCHANGED, UNEXPECTED = 3.0, 1.0, 2.0

# Shares of the retrieval scores, factors of agreeing and disagreeing metadata, BM25's parameters.
HEADER_SHARE, BM25_SHARE, TFIDF_SHARE = 0.4, 0.35, 0.25
MODALITY_FACTORS, BODY_PART_FACTORS = (1.2, 0.8), (1.3, 0.7)
K1, B, EPSILON = 1.5, 0.75, 0.25

# Dictations that say nothing is abnormal.
NORMAL_DICTATIONS = ["normal", "none", "unremarkable", "no acute abnormality"]

# Patterns. White space and line ends are listed, as engines differ in what their classes hold.
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{_WS}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LIST_MARKER = r"^(?:\p{Nd}+[.)]|[-*•])" + WS + "*"
NUMBER = r"^[+-]?\p{Nd}+(?:\.\p{Nd}+)?$"
SUB_TOKEN = r"[a-z0-9]+|[+-]?\p{Nd}+(?:\.\p{Nd}+)?"
EDGE = r"""[,.;:!?()\[\]{}"']"""
EDGE_PUNCTUATION = f"^{EDGE}+|{EDGE}+$"
FIELD = rf"(?m)^[ \t]*([A-Z0-9/_()\-{_WS}]+):{WS}*"
MEASUREMENT = r"\b\d+(?:\.\d+)?\s*(?:mm|cm)\b"
WORD_RUN = r"[\p{L}\p{N}_]{2,}"
