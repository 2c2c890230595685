"""Column expressions shared by the cleaning step, the tag pipelines and the read queries.

Everything here returns a ``Column`` built from JVM-side functions, so it stays inside
whole-stage codegen. The recipes reproduce the reference engine's semantics where they
differ from Spark's defaults (see SURVEY §1.5):

* first-match-only ``regexp_replace`` (G1) -> anchored patterns,
* ``$`` also matching before a final newline in Java (G2) -> ``\\z``,
* ``trim`` stripping Unicode space separators (G3) -> ``\\p{Zs}``,
* loose numeric casts that round ``'3.7'`` to 4 and accept ``'1_000'`` (G4) -> decimal route,
* date and timestamp casts that reject partial dates and times without a date, and accept
  four separators and short years (G5) -> patterns whose parts are put in ISO form,
* ``ILIKE`` without an escape character (G10) -> explicit escape ``~``.

Casts look at the shape first: a text whose length and a few characters say that it is plain ISO (or a
plain whole number) is cast as it stands, where Spark and the pattern agree on every text of
that shape; only the rest meets the pattern, once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------
# Video id rule: 11 characters from letters, digits, '_' and '-'.
VIDEO_ID_PATTERN = r"^[A-Za-z0-9_-]{11}\z"
# Accepted dates after '.' -> '-': year-month-day with one separator, then nothing or a time with
# a zone or a space and anything behind it. Year up to six digits.
DATE_PATTERN = (r"(?s)^[\t\n\x0B\f\r ]*(\d{1,6})([-/\\ ])(\d{1,2})\2(\d{1,2})"
                r"(?:[\t\n\x0B\f\r ]*|[ \tT] *(?:(?:[01]?\d|2[0-3]):[0-5]?\d(?::(?:[0-5]?\d)?)?|24:00(?::00)?)"
                r"(?:Z| (?:[^ ].*)?|[+-]\d\d(?::?\d\d(?::\d\d)?)?)?)\z")
# Accepted timestamps: the same date, alone or with a time and a zone.
TS_PATTERN = (r"^[\t\n\x0B\f\r ]*(\d{1,6})([-/\\ ])(\d{1,2})\2(\d{1,2})"
              r"(?:([ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?) ?(Z|UTC|[+-]\d{2}(?::\d{2})?)?)?\z")
# Accepted numbers: single underscores between digits, a fraction, an exponent.
NUMBER_PATTERN = (r"^[\t\n\x0B\f\r ]*[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)"
                  r"(?:[eE][+-]?\d+(?:_\d+)*)?[\t\n\x0B\f\r ]*\z")
# Whole numbers without a sign that any bigint holds.
PLAIN_DIGITS = r"\A[0-9]{1,18}\z"
# Words that the reference's casts take as doubles and booleans, besides numbers.
DOUBLE_WORDS = ["nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]
BOOLEAN_WORDS = ["true", "false", "t", "f", "yes", "no", "y", "n", "1", "0"]
# Leading '#' runs and quotes of tags.
LEADING_HASHES = r"^#+"
LEADING_QUOTES, TRAILING_QUOTES = r'^"+', r'"+\z'
LEADING_QUOTE, TRAILING_QUOTE = r'^"', r'"\z'
# Tag strings that mean "no tags" in the legacy pipeline and the notebook.
NONE_LIKE_TAGS = ["[none]", "none", "nan", "null"]
NONE_LIKE = rf"(?i)\A\p{{Zs}}*(?:{'|'.join(map(re.escape, NONE_LIKE_TAGS))})\p{{Zs}}*\z"
# Length bounds and junk markers of the clean tag pipeline.
TAG_MIN_LEN = 2
TAG_MAX_LEN = 80
TAG_JUNK_PREFIX = "yt:"
TAG_JUNK_SUBSTRINGS = ["http", "https", "www.", "@"]
# ----------------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- C1..C4: safe parsing ----------------------------------------------------------------

def _at(c: Column, place: int) -> Column:
    return F.substring(c, place, 1)


def _digit(c: Column, place: int) -> Column:
    return _at(c, place).between("0", "9")


def _starts_between(c: Column, first: str, last: str) -> Column:
    """The first character is one of ``first`` .. ``last``: a comparison of the whole text."""
    return (c >= first) & (c < chr(ord(last) + 1))


def _iso(s: Column, pattern: str, form: str) -> Column:
    """The parts of a text that the pattern matches, as ISO text with a year of four digits or more;
    of any other text ``000--``, which no cast takes. One replacement for either."""
    parts = F.regexp_replace(s, rf"{pattern}|\A(?s:.*)\z", f"000$1-$3-$4{form}")
    return F.regexp_replace(parts, r"^0+(?=\d{4})", "")


def parse_trending_date(col) -> Column:
    """C1: '.' -> '-', then a safe DATE cast; NULL for anything that doesn't start with a whole
    date. The reference's words for special dates ('epoch', 'infinity', BC years) are NULL."""
    c = _c(col)
    s = F.translate(c, ".", "-")
    plain = ((F.length(c) == 10) & _at(c, 5).isin("-", ".") & _at(c, 8).isin("-", ".")
             & _starts_between(c, "0", "9") & _digit(c, 10))
    return F.when(plain, s.try_cast("date")).otherwise(_iso(s, DATE_PATTERN, "").try_cast("date"))


def valid_video_id(col) -> Column:
    """True/False for the id rule, NULL for a NULL id (three-valued, like the reference)."""
    return _c(col).rlike(VIDEO_ID_PATTERN)


def _rounding_integral(col, type_name: str) -> Column:
    # The reference's text->integer cast accepts '3.7' (-> 4), '2.5' (-> 3), '1e3' and '1_000'.
    # A decimal with 18 places holds any bigint; digits behind the 18th can't change the
    # rounding half away from zero, so they are cut before the parse would round them up.
    s = _c(col)
    # Spark's cast of a text from one of '-./0-9' to a digit takes whole numbers only, as the pattern does
    whole = F.when(_starts_between(s, "-", "9") & _digit(s, -1), s.try_cast(type_name))
    text = F.regexp_replace(F.translate(F.btrim(s, F.lit("\t\n\x0b\f\r ")), "_", ""), r"(\.\d{18})\d+\z", "$1")
    other = F.when(s.rlike(NUMBER_PATTERN), F.round(text.try_cast("decimal(38,18)"), 0).try_cast(type_name))
    return F.coalesce(whole, other)


def to_long(col) -> Column:
    """Safe BIGINT cast with the reference's rounding of fractional text."""
    return _rounding_integral(col, "bigint")


def to_int(col) -> Column:
    """Safe INTEGER cast with the same rounding."""
    return _rounding_integral(col, "int")


def to_ts(col) -> Column:
    """C4: safe timestamp cast; a whole date, alone or with a time and zone (UTC without one)."""
    c = _c(col)
    plain = ((F.length(c) == 19) | ((F.length(c) == 20) & (_at(c, 20) == "Z")))
    for place, marks in ((5, "-"), (8, "-"), (11, "T "), (14, ":"), (17, ":")):
        plain = plain & _at(c, place).isin(*marks)
    plain = plain & _starts_between(c, "0", "9") & _digit(c, 19)
    return F.when(plain, c.try_cast("timestamp")).otherwise(_iso(c, TS_PATTERN, "$5$6").try_cast("timestamp"))


def to_bool(col) -> Column:
    """Safe boolean cast for the two flag columns."""
    return _c(col).try_cast("boolean")


# Types that a text may be read as, the narrowest first; a mask holds the bit of each.
TYPE_BITS = {"bigint": 1, "double": 2, "boolean": 4, "date": 8, "timestamp": 16}


def plain_mask(col) -> Column:
    """``type_mask`` of most texts, without a cast: 0 where length and ends show that no type takes the
    text, and the mask of plain digits that fit a bigint. NULL for the rest, which a cast must judge."""
    s = _c(col)
    longer = (s >= ":") & (F.length(s) > max(map(len, DOUBLE_WORDS + BOOLEAN_WORDS))) & (_at(s, -1) > " ")
    digits = TYPE_BITS["bigint"] + TYPE_BITS["double"]
    flags = F.when(s.isin("0", "1"), F.lit(digits + TYPE_BITS["boolean"])).otherwise(F.lit(digits))
    return F.when(longer, F.lit(0)).when(s.rlike(PLAIN_DIGITS), flags)


def type_mask(col) -> Column:
    """The types whose safe cast takes the text, as bits: bigint without fraction or exponent, double,
    boolean, a date without a time (with '.' as C1 takes it), timestamp. White space around a
    number is no matter, as in the casts. NULL for NULL."""
    s = _c(col)
    text = F.btrim(s, F.lit("\t\n\x0b\f\r "))
    bit = lambda test, name: F.when(test, F.lit(TYPE_BITS[name])).otherwise(0)
    boolean = bit(F.lower(s).isin(BOOLEAN_WORDS), "boolean")
    whole = bit((F.translate(s, ".eE", "") == s) & to_long(s).isNotNull(), "bigint")
    # a number is no date; a date starts with a digit
    times = bit((F.translate(s, ":", "") == s) & parse_trending_date(s).isNotNull(), "date") + bit(to_ts(s).isNotNull(), "timestamp")
    digits = F.when(s.rlike(NUMBER_PATTERN), whole + F.lit(TYPE_BITS["double"]) + boolean).otherwise(times)
    words = bit(F.lower(text).isin(DOUBLE_WORDS), "double") + boolean
    other = F.when(_starts_between(text, "+", "9") & (F.length(text) > 0), F.when(
        F.lower(text).isin(DOUBLE_WORDS), F.lit(TYPE_BITS["double"])).otherwise(digits)).otherwise(words)
    return F.when(s.isNotNull(), F.coalesce(plain_mask(s), other))


# --- string helpers ------------------------------------------------------------------------

def trim_zs(col) -> Column:
    """Strip Unicode space separators (U+0020, U+00A0, U+3000, ...) at both ends."""
    return F.regexp_replace(_c(col), r"\A\p{Zs}+|\p{Zs}+\z", "")


def strip_leading_hashes(col) -> Column:
    c = _c(col)
    return F.when(c.startswith("#"), F.regexp_replace(c, LEADING_HASHES, "")).otherwise(c)


def collapse_first_ws_run(col) -> Column:
    """G1: replace only the FIRST run of ASCII whitespace ([\\t\\n\\f\\r ]) by one space."""
    return F.regexp_replace(_c(col), r"(?s)\A(.*?)[\t\n\f\r ]+", "$1 ")


def strip_quote_run_one_side(col) -> Column:
    """G1: remove the leading run of '"' if there is one, otherwise the trailing run."""
    c = _c(col)
    return F.when(c.startswith('"'), F.regexp_replace(c, LEADING_QUOTES, "")).otherwise(
        F.regexp_replace(c, TRAILING_QUOTES, "")
    )


def strip_one_quote_char(col) -> Column:
    """G1 (legacy form): remove one leading '"' if present, otherwise one trailing '"'."""
    c = _c(col)
    return F.when(c.startswith('"'), F.regexp_replace(c, LEADING_QUOTE, "")).when(
        c.endswith('"'), F.regexp_replace(c, TRAILING_QUOTE, "")).otherwise(c)


def has_text(col) -> Column:
    """``trim_zs`` of the text isn't empty."""
    return _c(col).rlike(r"[^\p{Zs}]")


def is_none_like(col) -> Column:
    """Tag string that is blank-equivalent: '[none]', 'none', 'nan', 'null' (any case)."""
    return _c(col).rlike(NONE_LIKE)


def has_usable_tags(col) -> Column:
    """Non-null, non-blank and not none-like (legacy pipeline, notebook cells)."""
    c = _c(col)
    return c.isNotNull() & has_text(c) & ~is_none_like(c)


# --- T1 / T6 / T13: tag normalisation ------------------------------------------------------

def clean_tag(piece) -> Column:
    """T1 chain: lower(trim) -> strip leading '#'s -> collapse first whitespace run ->
    strip the quote run on one side. No re-trim afterwards (mismatch 5 in SURVEY §2.5)."""
    t0 = F.lower(trim_zs(piece))
    return strip_quote_run_one_side(collapse_first_ws_run(strip_leading_hashes(t0)))


def clean_tag_keep(tag) -> Column:
    """T1 filter: non-empty, 2..80 code points, no 'yt:' prefix, no URL or mention marker."""
    t = _c(tag)
    cond = t.isNotNull() & (t != "") & (F.length(t) >= TAG_MIN_LEN) & (F.length(t) <= TAG_MAX_LEN)
    cond = cond & ~t.startswith(TAG_JUNK_PREFIX)
    for marker in TAG_JUNK_SUBSTRINGS:
        cond = cond & ~t.contains(marker)
    return cond


def legacy_tag(piece) -> Column:
    """T6 chain: strip leading '#'s (before trimming), strip one quote char, trim, lower."""
    return F.lower(trim_zs(strip_one_quote_char(strip_leading_hashes(piece))))


def notebook_tag(piece) -> Column:
    """Notebook pipe-split chain (E15-E18): strip one quote char, trim, lower."""
    return F.lower(trim_zs(strip_one_quote_char(piece)))


def lookup_tag(col) -> Column:
    """Normaliser for a user-typed tag: trim, lower, drop leading '#'s, collapse ALL
    whitespace runs, trim, then strip '"' on both sides and then "'" on both sides."""
    t = F.lower(F.regexp_replace(_c(col), r"(?U)\A\s+|\s+\z", ""))
    t = strip_leading_hashes(t)
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"(?U)\A\s+|\s+\z", "")
    t = F.regexp_replace(t, r'\A"+|"+\z', "")
    return F.regexp_replace(t, r"\A'+|'+\z", "")


def split_tags(col, pipe_too: bool = False) -> Column:
    """Split the delimited tag string into an array; '|' also separates when ``pipe_too``.
    Empty pieces are kept, like the reference's split."""
    c = _c(col)
    if pipe_too:
        c = F.translate(c, "|", ",")
    return F.split(c, ",", -1)


# --- search and months ----------------------------------------------------------------------

def contains_ci(col, text: str) -> Column:
    """Case-insensitive substring match where '%' and '_' in the user's text act as
    wildcards and nothing escapes them (the reference splices the text into ILIKE)."""
    pattern = "%" + text.replace("~", "~~") + "%"
    return F.ilike(_c(col), F.lit(pattern), F.lit("~"))


def month_of(col) -> Column:
    """First day of the month as DATE."""
    return F.trunc(_c(col), "MM")


def month_index(col) -> Column:
    """12 * year + month: consecutive calendar months differ by exactly 1."""
    c = _c(col)
    return F.year(c) * 12 + F.month(c)


# --- argument contract ----------------------------------------------------------------------

def clamp_limit(limit, default: int, cap: int) -> int:
    """``max(1, min(n, cap))``; raises ValueError for a non-integer (HTTP 400 in the reference)."""
    if limit is None:
        limit = default
    try:
        n = int(limit)
    except (TypeError, ValueError) as exc:
        raise ValueError("limit must be an integer") from exc
    return max(1, min(n, cap))


def clean_query_text(q: str | None) -> str:
    """Strip the search text; at least 2 characters are required."""
    text = (q or "").strip()
    if len(text) < 2:
        raise ValueError("q must be at least 2 characters")
    return text
