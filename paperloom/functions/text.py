"""Text cleaning and invoice-field patterns as Column expressions.

Everything here is a JVM-side regular expression, so a scan, the patterns and
the projection run in one stage without Python workers.

Pattern dialect: the flags ``i`` (ignore case), ``U`` (Unicode classes) and ``d``
(only a newline ends a line) make the JVM's patterns behave like the patterns
the semantics were defined with.  ``\\s`` leaves out the four separator control
characters, so they are added wherever whitespace is meant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iUd)"
LINE_FLAGS = "(?iUdm)"

# Whitespace, the date forms in priority order, the labels and the value
# shapes of each field.  These decide which strings are returned.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = r"\s\x1c-\x1f"
S = f"[{BLANKS}]"
SEP = f"[:{BLANKS}]+"
MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|"
    r"Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
DATE_FORMS = (
    r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}",
    r"\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}",
    rf"\d{{1,2}}{S}+{MONTH}{S}+\d{{2,4}}",
    rf"{MONTH}{S}+\d{{1,2}},?{S}+\d{{2,4}}",
)
NUMBER_TOKEN = r"([A-Z0-9][\w\-/]{1,20})"
INVOICE_LABEL = rf"(?:invoice|inv|inv\.?{S}*no\.?|inv{S}*#){S}*[:#]?{S}*"
STRICT_INVOICE_LABEL = rf"\b(?:invoice|inv)\.?{S}*(?:number|no\.?|#)?{S}*[:#]?{S}*"
BILL_LABEL = rf"bill{S}*(?:no|number|#){SEP}"
HASH_NUMBER = rf"#{S}*([A-Z0-9]{{4,20}})\b"
INVOICE_DATE_LABEL = rf"(?:invoice{S}*date|date{S}*of{S}*invoice|date{S}*issued?){SEP}"
DUE_DATE_LABEL = rf"(?:due{S}*(?:date|on|by)|payment{S}*due){SEP}"
TOTAL_LABEL = rf"(?:grand{S}*total|total{S}*(?:amount{S}*)?due|total{S}*payable|amount{S}*due|total){SEP}"
TOTAL_AMOUNT = rf"([£$€¥]?{S}*[\d,]+(?:\.\d{{2}})?)"
LINE_END_AMOUNT = rf"([£$€¥]{S}*[\d,]+\.\d{{2}}){S}*$"
ISSUER_LABEL = rf"(?:from|bill{S}*from|issued?{S}*by){SEP}"
RECIPIENT_LABEL = rf"(?:to|bill{S}*to|sold{S}*to|client){SEP}"

# A look-ahead at the first letter lets the matcher skip most positions with one table look-up;
# it never changes what matches.
DATE = FLAGS + r"\b(?=[\djfmasond])(?:" + "|".join(DATE_FORMS) + r")\b"
NUMBER_FORMS = (
    FLAGS + "(?=i)" + INVOICE_LABEL + NUMBER_TOKEN,
    FLAGS + BILL_LABEL + NUMBER_TOKEN,
    FLAGS + HASH_NUMBER,
)
STRICT_NUMBER_FORMS = (
    FLAGS + STRICT_INVOICE_LABEL + r"(?=[\w\-/]*\d)" + NUMBER_TOKEN,
    FLAGS + r"\b" + BILL_LABEL + NUMBER_TOKEN,
    FLAGS + HASH_NUMBER,
)
INVOICE_DATE_WINDOW = FLAGS + "(?=[id])" + INVOICE_DATE_LABEL + "(.{1,30})"
DUE_DATE_WINDOW = FLAGS + "(?=[dp])" + DUE_DATE_LABEL + "(.{1,40})"
TOTAL_FORMS = (
    LINE_FLAGS + "(?=[gta])" + TOTAL_LABEL + TOTAL_AMOUNT,
    LINE_FLAGS + LINE_END_AMOUNT,
)
ISSUER_LINE = FLAGS + "(?=[fbi])" + ISSUER_LABEL + "(.+)"
RECIPIENT_LINE = FLAGS + "(?=[tbsc])" + RECIPIENT_LABEL + "(.+)"

CACHE_CHARS = 2000
NAME_CHARS = 60
DUE_CHARS = 30
MIN_PDF_CHARS = 30
ANCHOR_CHARS = 4


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only blanks."""
    return F.trim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return ~F.coalesce(F.regexp_like(col, F.lit(rf"(?U)[^{BLANKS}]")), F.lit(False))


def clean_text(col: Column, max_chars: int | None = None) -> Column:
    """Collapse whitespace runs and strip; ``max_chars`` cuts the result, by default the whole text stays."""
    cleaned = F.trim(F.regexp_replace(col, rf"(?U){S}+", " "))
    return cleaned if max_chars is None else F.left(cleaned, F.lit(max_chars))


def fill_blank(col: Column) -> Column:
    """One space in place of missing or blank text, so that a scorer sees every row."""
    return F.when(is_blank(col), F.lit(" ")).otherwise(col)


def choose_text(pdf_text: Column, ocr_text: Column) -> Column:
    """Embedded PDF text when it is long enough once stripped, else the OCR text; never trimmed."""
    return F.when(F.length(strip(pdf_text)) > MIN_PDF_CHARS, pdf_text).otherwise(ocr_text)


def match(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern whose group cannot be empty; an empty string when there is none."""
    return F.regexp_extract(col, pattern, group)


def found(*matches: Column) -> Column:
    """First of several matches that is not empty; null when all are."""
    return F.coalesce(*[F.when(m != "", m) for m in matches])


def first_match(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern whose group cannot be empty; null when there is none."""
    return F.nullif(match(col, pattern, group), F.lit(""))


def find_dates(col: Column) -> Column:
    """All date strings of the text, left to right."""
    return F.regexp_extract_all(col, F.lit(DATE), F.lit(0))


def invoice_number(col: Column, strict: bool = False) -> Column:
    """First pattern that matches anywhere wins, whatever its position.

    ``strict`` asks for a word boundary, prefers the longest label and wants a digit in the
    token, so "Invoice No: 123" gives ``123`` rather than ``No``.
    """
    forms = STRICT_NUMBER_FORMS if strict else NUMBER_FORMS
    return F.coalesce(*[first_match(col, form) for form in forms])


def invoice_date_window(col: Column) -> Column:
    """Up to 30 characters after the first invoice-date label; null when there is no label."""
    return first_match(col, INVOICE_DATE_WINDOW)


def due_date_window(col: Column) -> Column:
    """Up to 40 characters after the first due label; null when there is no label."""
    return first_match(col, DUE_DATE_WINDOW)


def invoice_date(window: Column, dates: Column) -> Column:
    """First date in the labelled window, else the first date of the document (``dates``)."""
    return F.coalesce(first_match(window, DATE, 0), F.get(dates, F.lit(0)))


def due_date(window: Column, dates: Column) -> Column:
    """Date after a due label, else that label's text; unlabelled: second date of the document."""
    labelled = F.coalesce(first_match(window, DATE, 0), F.left(strip(window), F.lit(DUE_CHARS)))
    return F.when(window.isNotNull(), labelled).otherwise(F.get(dates, F.lit(1)))


def total_amount(col: Column) -> Column:
    """Labelled total, else the first currency amount that ends a line."""
    return F.coalesce(*[strip(first_match(col, form)) for form in TOTAL_FORMS])


def labelled_name(col: Column, pattern: str) -> Column:
    return F.left(strip(first_match(col, pattern)), F.lit(NAME_CHARS))


def issuer_line(col: Column) -> Column:
    """Rest of the line after the first issuer label."""
    return labelled_name(col, ISSUER_LINE)


def recipient_line(col: Column) -> Column:
    """Rest of the line after the first recipient label."""
    return labelled_name(col, RECIPIENT_LINE)


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words of a text that is not blank."""
    return F.size(F.split(strip(col), rf"(?U){S}+"))


def anchor_prefix(col: Column) -> Column:
    """Lower-case first letters of the first word, by which a value is found on the page."""
    return F.left(F.regexp_extract(F.lower(col), rf"(?U)[^{BLANKS}]+", 0), F.lit(ANCHOR_CHARS))


def artifact_slug(col: Column) -> Column:
    """Model name as an artefact key: lower case, blanks and plus signs as underscores."""
    return F.translate(F.lower(col), " +", "__")


def dashboard_slug(col: Column) -> Column:
    """The dashboard's form of the key, which maps hyphens too."""
    return F.translate(F.lower(col), " +-", "___")
