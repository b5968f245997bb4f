"""Patterns, phrases and formats that results must follow."""

#: White space that trimming removes, beyond Java's \s.
SPACE = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SECTION_IN_TEXT = r"(?i)Section\s+([A-Za-z]?\d+(?:\.\d+)*[A-Za-z]?)"
SECTION_ALONE = r"^[A-Za-z]?\d+(?:\.\d+)*[A-Za-z]?\z"
ITEM_START = r"(?i)^\s*(?:\(\d+\)|\d+\)|\d+\.)?\s*In\s+IRC,\s+Section"
ITEM_NUMBER = r"(?i)^\s*\(?(\d+)\)?[.)]?\s*In\s+IRC,\s+Section"
ITEM_PHRASE = r"(?i)In\s+IRC,\s+Section"
QUOTED = '"([^"]+)"'
CHAPTER_LINE = r"(?i)^CHAPTER\s+(\d+)\b"
SECTION_LINE = r"^(R\d{3}(?:\.\d+)*)(?:\s+(.+))?\z"
TITLE_IN_QUERY = r"\btitle\s+([0-9a-z\-\.]+)"
CHAPTER_IN_QUERY = r"\bchapter\s+([0-9]+(?:-[0-9a-z]+)+)"
SECTION_IN_QUERY = r"\b(?:section|sec\.?|§)\s+([0-9]+(?:-[0-9a-z]+)*(?:\.[0-9a-z]+)*)"
TITLE_IN_PATH = r"title[-_\s]*([0-9a-z.\-]+)"
CHAPTER_IN_PATH = r"chapter[-_\s]*([0-9]+(?:-[0-9a-z]+)+)"
SECTION_IN_PATH = r"section[-_\s]*([0-9]+(?:-[0-9a-z]+)*(?:\.[0-9a-z]+)*)"
CODE_LETTER = r"(?i)\b([a-z]\d{3,}(\.\d+)*)\b"
CODE_DASHED = r"\b\d{1,3}-\d{1,3}-\d+(\.\d+)?\b"
QUOTE_MARK = r'"[^"]{3,}"'
CITATION = r"(?i)\[source\s+\d+,\s+lines\s+\d+[-–]\d+\]"
REFUSAL = "I cannot answer that from the provided code sections."
FOLLOW_UP = "\n\nFollow-up question:\n"
SECTION_URL = "https://le.utah.gov/xcode/Title{title}/Chapter{chapter}/{title}-{chapter}-S{rest}.html"
HEADER_PREFIX = "SECTION:"

#: Action by phrase, in this order.
ACTION_PHRASES = (
    ("replace", ("deleted and replaced", "amended to read as follows")),
    ("delete", ("is deleted",)),
    ("add", ("is added", "new exception is added")),
    ("modify", ("is modified", "modified by adding")),
)
#: Action by a word in the operation's name, in this order.
ACTION_WORDS = ("replace", "delete", "add", "modify")
#: Operation by phrases, in this order; the first needs all of its phrases, the others any.
DEFINITION_INSERT = ("definition for", "modified by adding the words", "after the word")
OPERATION_PHRASES = (
    ("replace_section", ("deleted and replaced", "amended to read as follows")),
    ("append_sentence", ("sentence is added at the end",)),
    ("add_exception", ("new exception is added",)),
    ("add_definition", ("definition is added",)),
)
SHORT_ITEM = 120

#: Page layout: patterns of lines and numeric tolerances.
DOT_LEADERS = r"(?:\.\s*){3,}"
PROSE_MARK = r"[.!?;:]"
PAGE_REFERENCE = r"(?:\b[A-Z]{1,3}-\d+\b\s*|\b\d+\b\s*)$"
TOC_START = r"(?i)^\s*(?:(?:SECTION\s+)?[A-Z]{1,3}\d{3,4}(?:\.\d+)*\b|APPENDIX\s+[A-Z]{1,3}\b)"
APPENDIX_LINE = r"(?i)^\s*APPENDIX\s+[A-Z]{1,3}\b"
REPEATED_KEYWORD = r"(?i)^\s*(SECTION|APPENDIX|TABLE|FIGURE|CHAPTER|PART)\s+\1\s*$"
CHAPTER_ANY = r"(?i)^CHAPTER\s+([A-Z0-9]+)\b"
TABLE_LABEL = r"(?i)^TABLE\s+([A-Z]{1,3}\d{3,4}(?:\.\d+)*(?:\([0-9A-Z]+\))?)\b\.?\s*(.*)?$"
AMENDMENT_WORD = r"(?i)\b(?:UTAH|STATE|AMENDED|MODIFIED|AMENDMENTS)\b"
TRUE_HEADING = r"(?i)^\s*([A-Z]{1,3}\d{3,4}(?:\.\d+){0,6})\b(.*)$"
PAGE_SECTION_LINE = r"(?i)^(?!.*(?:\.\s*){3,})\s*(?:SECTION\s+)?([A-Z]{1,3}\d{3,4}(?:\.\d+)*)\b(?:\s+(.*))?$"
SECTION_TEXT = r"(?i)\b([A-Z]{1,3}\d{3,4}(?:\.\d+)*)\b"
SECTION_MARKER = r"(?i)^\s*SECTION\s+([A-Z]{1,3}\d{3,4}(?:\.\d+){0,6})\b"
FOOTNOTE_START = r"^(?:\*|a\.|b\.|c\.|For SI:)"
LINE_TOLERANCE = 3.0
RULING_SLANT = 1.0
RULING_SNAP = 0.5
RULING_LEAST = 6.0
MERGE_GAP = 2.0
CROSS_TOLERANCE = 1.5
CENTER_BAND = 0.2
HEADER_BAND, FOOTER_BAND = 0.10, 0.90
LABEL_REACH = 60.0
EMPTY_MOST = 0.8
GUTTER_TOLERANCE = 2.0
SPLIT_OFF_CENTER = 0.15
HEADER_LINE_GAP = 12.0
TABLE_ROTATIONS = (0, 90, 270)
