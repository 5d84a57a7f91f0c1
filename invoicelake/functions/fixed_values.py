"""Fixed values.

Everything in this module is a constant that the results depend on: word
lists, lookup tables, rule patterns with their confidences, limits and message
formats.  They are stated as they are, in rule order; no logic lives here.
Patterns are in Java regex syntax, as Spark's ``regexp_*`` functions need it.

Flags: ``i`` ignore case, ``m`` anchors at line ends, ``d`` only LF ends a
line, ``U`` Unicode character classes.
"""

LINE_FLAGS = "(?imdU)"
TEXT_FLAGS = "(?idU)"

# --- Text -------------------------------------------------------------------

# Characters removed by strip, and characters (or pairs) that end a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"  # and CRLF as one

PAGE_SEPARATOR = "\n\n--- Page Break ---\n\n"
TABLE_HEADING = "\n--- Tables ---"
CELL_SEPARATOR = " | "

TOTAL_LINE = TEXT_FLAGS + r"total|amount\s+due|grand\s+total|balance\s+due"

# --- Invoice number ---------------------------------------------------------

_NUMBER_VALUE = r"([A-Z0-9][A-Z0-9\-_/]{2,24})"

INVOICE_NUMBER = [
    (LINE_FLAGS + r"invoice\s*(?:no\.?|number|num\.?|#|id)\s*[:\-]?\s*" + _NUMBER_VALUE, 0.95),
    (LINE_FLAGS + r"bill\s*(?:no\.?|number|#)\s*[:\-]?\s*" + _NUMBER_VALUE, 0.90),
    (LINE_FLAGS + r"receipt\s*(?:no\.?|number|#)\s*[:\-]?\s*" + _NUMBER_VALUE, 0.85),
    (LINE_FLAGS + r"ref(?:erence)?\s*(?:no\.?|#)?\s*[:\-]\s*" + _NUMBER_VALUE, 0.75),
    (LINE_FLAGS + r"\b((?:INV|BILL|REC|REF|ORD|PO|SI|SB)[-/][A-Z0-9][-A-Z0-9]{1,20})\b", 0.80),
]

# --- Dates ------------------------------------------------------------------

MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    "Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
MONTH_NUMBERS = {
    "jan": "1", "january": "1", "feb": "2", "february": "2", "mar": "3", "march": "3", "apr": "4", "april": "4",
    "may": "5", "jun": "6", "june": "6", "jul": "7", "july": "7", "aug": "8", "august": "8", "sep": "9",
    "september": "9", "oct": "10", "october": "10", "nov": "11", "november": "11", "dec": "12", "december": "12",
}

DATE_NUM = r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})"
DATE_TEXT = r"(\d{1,2}\s+(?:" + MONTHS + r")\s+\d{4})"
DATE_TEXT2 = r"((?:" + MONTHS + r")\s+\d{1,2},?\s+\d{4})"
DATE_ISO = r"(\d{4}[/\-]\d{2}[/\-]\d{2})"

_INVOICE_DATE_LABEL = LINE_FLAGS + r"invoice\s+date\s*[:\-]?\s*"
_ISSUED_LABEL = LINE_FLAGS + r"(?:issue[d]?|dated?)\s*(?:on\s*)?[:\-]?\s*"
_BARE_DATE_LABEL = LINE_FLAGS + r"(?<!\w)date\s*[:\-]\s*"

INVOICE_DATE = [
    (_INVOICE_DATE_LABEL + DATE_NUM, 0.95),
    (_INVOICE_DATE_LABEL + DATE_TEXT, 0.95),
    (_INVOICE_DATE_LABEL + DATE_TEXT2, 0.95),
    (_INVOICE_DATE_LABEL + DATE_ISO, 0.95),
    (_ISSUED_LABEL + DATE_NUM, 0.88),
    (_ISSUED_LABEL + DATE_TEXT, 0.88),
    (_ISSUED_LABEL + DATE_TEXT2, 0.88),
    (_BARE_DATE_LABEL + DATE_NUM, 0.75),
    (_BARE_DATE_LABEL + DATE_TEXT, 0.75),
    (_BARE_DATE_LABEL + DATE_TEXT2, 0.75),
    (_BARE_DATE_LABEL + DATE_ISO, 0.75),
]

_DUE_DATE_LABEL = LINE_FLAGS + r"due\s+date\s*[:\-]?\s*"
_PAYMENT_DUE_LABEL = LINE_FLAGS + r"payment\s+due\s*[:\-]?\s*"
_PAY_BY_LABEL = LINE_FLAGS + r"(?:due|pay(?:able)?)\s+by\s*[:\-]?\s*"
_PAYMENT_DATE_LABEL = LINE_FLAGS + r"payment\s+date\s*[:\-]?\s*"

DUE_DATE = [
    (_DUE_DATE_LABEL + DATE_NUM, 0.95),
    (_DUE_DATE_LABEL + DATE_TEXT, 0.95),
    (_DUE_DATE_LABEL + DATE_TEXT2, 0.95),
    (_PAYMENT_DUE_LABEL + DATE_NUM, 0.95),
    (_PAY_BY_LABEL + DATE_NUM, 0.90),
    (_PAY_BY_LABEL + DATE_TEXT, 0.90),
    (_PAYMENT_DATE_LABEL + DATE_NUM, 0.85),
]

NET_TERMS = LINE_FLAGS + r"\bnet\s*(\d+)\b"
NET_TERMS_CONFIDENCE = 0.70
NET_TERMS_DAYS = (1, 365)

# Any date, wherever it stands; the last resort for the invoice date.
DATE_ANYWHERE = (
    TEXT_FLAGS
    + r"\b\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}\b"
    + r"|\b\d{4}[/\-]\d{2}[/\-]\d{2}\b"
    + r"|\b\d{1,2}\s+(?:" + MONTHS + r")\s+\d{4}\b"
)
DATE_ANYWHERE_CONFIDENCE = 0.40

DATE_TRAILING_PUNCTUATION = ".,;:"
DATE_YEARS = (1990, 2100)

# --- Orders (our own) ---------------------------------------------------------

PO_NUMBER = [
    (LINE_FLAGS + r"\bpo\s*(?:no\.?|number|num\.?|#)\s*[:\-]?\s*" + _NUMBER_VALUE, 0.95),
    (LINE_FLAGS + r"\border\s*(?:no\.?|number|num\.?|#)\s*[:\-]?\s*" + _NUMBER_VALUE, 0.85),
]
_DELIVERY_LABEL = LINE_FLAGS + r"deliver(?:y\s+date|y|\s+by)\s*[:\-]?\s*"
DELIVERY_DATE = [(_DELIVERY_LABEL + value, 0.95) for value in (DATE_NUM, DATE_TEXT, DATE_TEXT2, DATE_ISO)]

# --- Amounts ----------------------------------------------------------------

CURRENCY_SYMBOLS = "$£€₹¥"
_CURRENCY_PREFIX = r"([\$£€₹¥]|(?:USD|EUR|GBP|INR|JPY|AUD|CAD|CHF|CNY)\b)?\s*"

# Two corrections against the plain form of this atom: thousands grouped by
# single spaces are read as one number, and a K or M counts only on the same
# line and when no letter follows it.
_MAGNITUDE = r"(?:[ \t]*[KkMm](?!\w))?"
AMOUNT = (
    r"(\d{1,3}(?: \d{3})+(?!\d)(?:[,.]\d{1,2})?" + _MAGNITUDE
    + r"|\d+(?:[,\.]\d{2,3})*(?:[,.]\d{1,2})?" + _MAGNITUDE + r")"
)

TOTAL_AMOUNT = [
    (LINE_FLAGS + r"grand\s+total\s*[:\-]?\s*" + _CURRENCY_PREFIX + AMOUNT, 0.97),
    (LINE_FLAGS + r"total\s+amount\s+due\s*[:\-]?\s*" + _CURRENCY_PREFIX + AMOUNT, 0.95),
    (LINE_FLAGS + r"amount\s+due\s*[:\-]?\s*" + _CURRENCY_PREFIX + AMOUNT, 0.95),
    (LINE_FLAGS + r"(?:balance|net|total)\s+due\s*[:\-]?\s*" + _CURRENCY_PREFIX + AMOUNT, 0.92),
    (LINE_FLAGS + r"(?:amount|total)\s+payable\s*[:\-]?\s*" + _CURRENCY_PREFIX + AMOUNT, 0.90),
    (LINE_FLAGS + r"(?<!sub)(?<!sub-)total\s*[:\-]?\s*" + _CURRENCY_PREFIX + AMOUNT, 0.80),
]
TOTAL_AMOUNT_GROUP = 2

AMOUNT_LIMIT = 1e12
MAGNITUDES = {"K": 1_000.0, "M": 1_000_000.0}

# --- Currency ---------------------------------------------------------------

CURRENCY_CODES = [
    "USD", "EUR", "GBP", "INR", "JPY", "AUD", "CAD", "CHF", "CNY", "SGD", "HKD", "NZD", "AED",
    "SAR", "MYR",
]

CURRENCY_MAP = {
    "$": "USD", "us$": "USD", "usd": "USD",
    "£": "GBP", "gbp": "GBP",
    "€": "EUR", "eur": "EUR",
    "₹": "INR", "inr": "INR", "rs": "INR", "rs.": "INR", "inr.": "INR",
    "¥": "JPY", "jpy": "JPY",
    "a$": "AUD", "aud": "AUD",
    "c$": "CAD", "cad": "CAD",
    "chf": "CHF",
    "cny": "CNY", "¥cn": "CNY",
    "sgd": "SGD", "s$": "SGD",
    "hkd": "HKD", "hk$": "HKD",
    "nzd": "NZD", "nz$": "NZD",
    "aed": "AED", "sar": "SAR",
    "myr": "MYR", "rm": "MYR",
}

CURRENCY_IN_TEXT = (
    LINE_FLAGS
    + r"\b(USD|EUR|GBP|INR|JPY|AUD|CAD|CHF|CNY|SGD|HKD|NZD|AED|SAR|MYR)\b"
    + r"|(?<!\w)([\$£€₹¥]|Rs\.?|RM)\b"
)

CURRENCY_CONFIDENCE = {"total_line": 0.90, "money_entity": 0.78, "text": 0.65}

# --- Vendor -----------------------------------------------------------------

ORG_SUFFIXES = (
    LINE_FLAGS
    + r"\b(?:Ltd\.?|Limited|Inc\.?|Incorporated|LLC|LLP|Corp\.?|Corporation|GmbH|S\.A\.?|"
    + r"Pvt\.?\s*Ltd\.?|Private\s+Limited|PLC|AG|BV|NV|SRL|SAS|SARL|OÜ|OY|AB|AS|ApS)\b"
)

VENDOR_LABELED = [
    (LINE_FLAGS + r"^(?:from|vendor|billed?\s+(?:by|from)|seller|supplier)\s*[:\-]\s*(.+)$", 0.92),
    (LINE_FLAGS + r"^company\s*(?:name)?\s*[:\-]\s*(.+)$", 0.85),
    (LINE_FLAGS + r"^service\s+provider\s*[:\-]\s*(.+)$", 0.80),
]

VENDOR_SUFFIX_LINES = 30
VENDOR_SUFFIX_CONFIDENCE = 0.65
VENDOR_FIRST_LINES = 10
VENDOR_FIRST_LINE_CONFIDENCE = 0.30
VENDOR_FIRST_LINE_MIN_CHARS = 4
VENDOR_MAX_CHARS = 120
VENDOR_NOT_A_NAME = r"(?U)^[\d\s\-/.:,]+$"
VENDOR_NOT_A_NAME_START = TEXT_FLAGS + r"^(?:invoice|bill|receipt|date|to:|from:|ref)"

# --- Line items -------------------------------------------------------------

# Parts of words, in any case.
ITEM_HEADER = ["description", "item", "particulars"]
ITEM_HEADER_PRICE = ["price", "amount", "total", "rate", "charge"]
ITEM_HEADER_QUANTITY = ["qty", "quantity", "unit", "no", "count"]
ITEM_STOP = (
    TEXT_FLAGS
    + r"^\s*(?:sub\s*[-]?\s*total|grand\s+total|total\s+amount|discount|tax\s*(?:@|:|\d)|vat|gst|"
    + r"cgst|sgst|igst|balance\s+due|amount\s+due|net\s+total)"
)
ITEM_COLUMN_GAP = r"(?U)[\s\x1c-\x1f]{2,}|\t+"
ITEM_NUMBER = r"(?U)^[\$£€₹]?\s*[\d,\.]+\s*[KkMm]?$"
ITEM_MAX_QUANTITY = 9999.0

# --- Entity evidence --------------------------------------------------------

ENTITY_ORG_SUFFIX = (
    TEXT_FLAGS
    + r"\b(?:Ltd\.?|Limited|Inc\.?|LLC|LLP|Corp\.?|Corporation|GmbH|S\.A\.?|Pvt\.?\s*Ltd\.?|"
    + r"Private\s+Limited|PLC|AG|BV)\b"
)
ENTITY_RELATIVE_DATE = (
    TEXT_FLAGS
    + r"\b(?:yesterday|today|tomorrow|last\s+\w+|next\s+\w+|this\s+\w+|ago|since|recently|now)\b"
)
ENTITY_YEAR = r"(?U)\b(?:19|20)\d{2}\b"
ENTITY_MONTH = TEXT_FLAGS + r"\b(?:" + MONTHS + r")\b"
ENTITY_NUMERIC_DATE = r"(?U)\d{1,4}[/\-.]\d{1,2}[/\-.]\d{2,4}"
ENTITY_CURRENCY = r"[\$£€₹¥]|USD|EUR|GBP|INR|JPY|AUD|CAD|CHF"
ENTITY_NUMBER_LIKE = r"(?U)[\d,\.]+"
ENTITY_DECIMALS = r"(?U)\d+[.,]\d{1,2}"
ENTITY_SPELLED_OUT = r"[a-zA-Z]{4,}"

ORG_SCORES = {"base": 0.75, "suffix": 0.10, "header": 0.05, "short": -0.10, "lower": -0.10}
DATE_SCORES = {"base": 0.70, "year": 0.10, "month": 0.05, "numeric": 0.10, "one_word": -0.15}
MONEY_SCORES = {
    "money": 0.72, "cardinal": 0.55, "currency": 0.10, "decimals": 0.08, "spelled_out": -0.15,
}
SHORT_ORG_CHARS = 3
ORG_HEADER_LINES = 10

NEAR_BASE = 0.75
NEAR_BONUS = 0.10

INVOICE_DATE_KEYWORDS = ["invoice", "date", "issued", "dated"]
INVOICE_DATE_WINDOW = 8
DUE_DATE_KEYWORDS = ["due", "pay", "payment", "payable"]
DUE_DATE_WINDOW = 8
TOTAL_KEYWORDS = ["total", "grand", "due", "payable"]
TOTAL_WINDOW = 6

DATE_ENTITY_DISCOUNT = 0.85
MONEY_ENTITY_DISCOUNT = 0.80

# --- Fusion, checks and scores ----------------------------------------------

AGREEMENT_BONUS = 0.05
SUM_CHECK_SLACK = 0.90
DATE_WARNING = (
    "Consistency check: due_date (%s) is before invoice_date (%s) — extraction may be wrong."
)
SUM_WARNING = (
    "Consistency check: total_amount (%s) is less than sum of line items (%s) — "
    "possible extraction error."
)
FIELDS = [
    "vendor_name", "invoice_number", "invoice_date", "due_date", "total_amount", "currency",
]
TIER_SCALES = {
    "display": [(0.80, "high"), (0.55, "moderate")],
    "schema": [(0.85, "strong"), (0.65, "labeled"), (0.40, "heuristic")],
}
REVIEW_THRESHOLD = 0.60

# --- Intake -----------------------------------------------------------------

MAX_FILE_MB = 10
MAX_FILE_BYTES = MAX_FILE_MB * 1024 * 1024

DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
SUPPORTED_MIMES = [
    "application/pdf", "image/jpeg", "image/png", "image/tiff", "image/webp", DOCX_MIME,
]
LOADER_KINDS = {
    "application/pdf": "pdf",
    "image/jpeg": "image",
    "image/png": "image",
    "image/tiff": "image",
    "image/webp": "image",
    DOCX_MIME: "docx",
}

# (hex of the leading bytes, MIME type); WebP has a second mark at byte 9.
MAGIC_BYTES = [
    ("25504446", "application/pdf"),
    ("EFBBBF25504446", "application/pdf"),
    ("FFD8FF", "image/jpeg"),
    ("89504E47", "image/png"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("504B0304", "application/zip"),
    ("504B0506", "application/zip"),
    ("504B0708", "application/zip"),
    ("474946", "image/gif"),
    ("424D", "image/bmp"),
    ("4D5A", "application/x-msdownload"),
    ("7F454C46", "application/x-executable"),
    ("1F8B08", "application/gzip"),
    ("526172211A07", "application/x-rar-compressed"),
    ("377ABCAF271C", "application/x-7z-compressed"),
    ("7B5C727466", "application/rtf"),
]
RIFF_MAGIC = "52494646"
WEBP_MAGIC = "57454250"
HEADER_BYTES = 12

# ZIP directories: signatures (a character for each byte), and places of fields behind them, from 1.
ZIP_END, ZIP_ENTRY = "PK\x05\x06", "PK\x01\x02"
ZIP_END_BYTES = 18
ZIP_END_COUNT, ZIP_END_SIZE, ZIP_END_COMMENT = 7, 9, 17
ZIP_ENTRY_NAME_SIZE, ZIP_ENTRY_NAME = 25, 43
TAIL_BYTES = 64 * 1024
CONTAINER_ENTRIES = [
    ("word/document.xml", DOCX_MIME),
    ("xl/workbook.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("ppt/presentation.xml", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
]

# --- Report formats ---------------------------------------------------------

MISSING = "—"
CURRENCY_SIGNS = {
    "USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥", "AUD": "A$", "CAD": "CA$",
    "CNY": "CN¥", "HKD": "HK$", "NZD": "NZ$", "BRL": "R$", "ILS": "₪", "KRW": "₩", "MXN": "MX$",
    "PHP": "₱", "TWD": "NT$", "VND": "₫",
}
MIME_LABELS = {
    "application/pdf": "PDF",
    "image/jpeg": "JPEG",
    "image/jpg": "JPEG",
    "image/png": "PNG",
    "image/tiff": "TIFF",
    "image/webp": "WebP",
    DOCX_MIME: "DOCX",
}
FIELD_LABELS = {
    "vendor_name": "Vendor Name",
    "invoice_number": "Invoice Number",
    "invoice_date": "Invoice Date",
    "due_date": "Due Date",
    "total_amount": "Total Amount",
    "currency": "Currency",
}
