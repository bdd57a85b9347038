"""The patterns, word lists and rules that define the pipeline's results."""

# --- offline cleaner, in order
OFFLINE_HEADER = r"(?m)^arXiv:\S+\s+\[[\w.\-]+\]\s+\d+\s+\w+\s+\d{4}\s*\n"
OFFLINE_STAMP = (
    r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
    r"\s+\d{1,2},?\s+\d{4}\n\d{1,2}:\d{2}\n"
)
OFFLINE_PUBLISHER = r"(?i)(?:WSPC|World Scientific|Typeset with|Preprint submitted to|Preprint typeset using|Draft version)[^\n]*\n(?:[^\n]{0,60}\n){0,2}"
OFFLINE_REPORT = r"(?m)^[A-Z]{2,10}-[\w/\-]+(?:,\s*[A-Z]{2,10}-[\w/\-]+)*\s*\n"
OFFLINE_REFERENCES = r"\n\s*(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY)\s*\n"
OFFLINE_REFERENCE_LIST = r"\n(?:\[\d+\]|\d+[\)\.]\s)\s*[A-Z][^.]{15,}\n(?:(?:\[\d+\]|\d+[\)\.]\s)\s*.{10,}\n){4,}"
OFFLINE_PAGES = [(r"\n\s*\d{1,3}\s*\n", "\n"), (r"\n\s*\d+/\d+\s*\n", "\n"), (r"(?i)\bpage\s+\d+\s+of\s+\d+\b", "")]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
HYPHEN = r"(\w)-\n(\w)"
OFFLINE_TAIL = [(r"\[?\w+@[\w.]+\]?\(?mailto:[\w@.]+\)?", ""), (r"\S+@\S+\.\S+", ""), (r"https?://\S+", ""), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")]

# --- online cleaner
ONLINE_HEADER = r"(?i)arXiv:\d{4}\.\d{4,5}v?\d*\s*\[[^\]]+\]\s*\d{1,2}\s+\w+\s+\d{4}"
ONLINE_JOURNAL = [r"(?i)Preprint submitted to.*", r"(?i)Draft version.*", r"(?i)Submitted to.*", r"(?i)Copyright.*"]
ONLINE_MARKERS = ["references", "bibliography"]
ONLINE_PAGES = [(r"\n\s*\d+\s*\n", "\n"), (r"(?i)page\s+\d+\s+of\s+\d+", " ")]
ONLINE_TAIL = [(r"\S+@\S+", " "), (r"https?://\S+|www\.\S+", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]

# --- sections
OFFLINE_INTRODUCTION = r"\n(?:1\.?\s*|I\.?\s*)?(?:Introduction|INTRODUCTION)\s*\n"
OFFLINE_NEXT = (
    r"\n(?:\d+\.?\s+[A-Z][a-z]|II\.?\s+[A-Z]|(?:RELATED WORK|BACKGROUND|METHODOLOGY|PROPOSED METHOD|LITERATURE REVIEW|PRELIMINARIES"
    r"|CONCLUSION|MODEL|EXPERIMENT|RESULTS|DISCUSSION|METHODS)\s*\n)"
)
ONLINE_INTRODUCTION = r"(?im)^\s*(1\.|i\.|I\.)?\s*introduction\s*$"
ONLINE_NEXT = r"(?im)^\s*((2\.|ii\.|II\.)\s+|related work|background|preliminaries|method|methodology|conclusion)\b"
ABSTRACT_TO_HEADING = r"(?is)(?:abstract)\s*[:\.]?\s*\n?(.*?)(?:\n\s*(?:1\.?\s*|I\.?\s*)?(?:Introduction|Keywords))"
ABSTRACT_LONG = r"(?is)(?:abstract)\s*[:\.]?\s*\n?(.{100,2000})"
TITLE = r"^(.{10,200}?)[\n\r]"

# --- citation and exclusion rules
INLINE_CITATIONS = [
    r"\[\s*\d+(\s*[-,]\s*\d+)*\s*\]",
    r"\([A-Z][A-Za-z\-]+ et al\.,?\s*\d{4}[a-z]?\)",
    r"\([A-Z][A-Za-z\-]+,\s*\d{4}[a-z]?\)",
    r"\([A-Z][A-Za-z\-]+ and [A-Z][A-Za-z\-]+,\s*\d{4}[a-z]?\)",
]
SEGMENT_CITATIONS = [r"\[\d+(,\s*\d+)*\]", r"\([A-Z][A-Za-z]+ et al\.,?\s*\d{4}\)", r"\([A-Z][A-Za-z]+,\s*\d{4}\)"]
REFERENCE_SECTIONS = ["references", "bibliography", "reference", "tài liệu tham khảo"]
REFERENCE_LIKE = [
    r"(?i)^\[\d+\]\s+.+",
    r"(?i)^\d+\.\s+[A-Z].+",
    r"(?i).+\bdoi:\s*\S+",
    r"(?i).+\barxiv:\s*\d{4}\.\d{4,5}",
    r"(?i).+\bjournal\b.+\b\d{4}\b",
    r"(?i).+\bproceedings\b.+\b\d{4}\b",
    r"(?i).+\bvol\.\s*\d+",
    r"(?i).+\bpp\.\s*\d+",
]
QUOTES = [('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")]
BOILERPLATE = [
    "corresponding author", "email address", "email addresses", "e-mail", "copyright", "all rights reserved", "preprint submitted", "submitted to",
    "draft version", "this work is supported by", "supported by .* grant", "grant number", "funded by", "acknowledg(e)?ments?",
    r"arxiv:\d{4}\.\d{4,5}", "keywords:", "pacs:", "msc:", "received .* accepted", "available online",
]
SYMBOL_RATIO, ALPHA_RATIO, SYMBOL_WORDS = 0.45, 0.35, 80
EXCLUSION_REASONS = ["small_match", "reference_section", "reference_like_text", "quoted_and_cited", "metadata_or_boilerplate", "symbol_heavy_short_formula"]

# --- concept layer
CUES = ["we propose", "we present", "we introduce", "novel", "our method", "our approach"]
KEYWORD_WHOLE = r"\A[a-z]{4,}\z"
PERCENT = r"(\d+\.?\d*)\s*%"
