"""Text primitives as column expressions, with the exact character classes that every engine agrees on.

Patterns are written so that Java and RE2 read them alike: no \\s, \\d, \\w or \\b, whose meaning differs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming takes off, as members of a character class.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters, one by one.
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A number that no letter, digit or underscore of ASCII touches; the digit is looked for before what stands around it.
NUMBER = r"(?=[0-9])(?<![A-Za-z0-9_])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_])"

#: Languages (code, name, native name, direction) and the script range of those that have one.
LANGUAGES = [
    ("en", "English", "English", "ltr"),
    ("hi", "Hindi", "हिन्दी", "ltr"),
    ("gu", "Gujarati", "ગુજરાતી", "ltr"),
    ("pa", "Punjabi", "ਪੰਜਾਬੀ", "ltr"),
    ("ur", "Urdu", "اردو", "rtl"),
    ("ta", "Tamil", "தமிழ்", "ltr"),
    ("te", "Telugu", "తెలుగు", "ltr"),
    ("ml", "Malayalam", "മലയാളം", "ltr"),
    ("mr", "Marathi", "मराठी", "ltr"),
    ("bn", "Bengali", "বাংলা", "ltr"),
    ("ps", "Pashto", "پښتو", "rtl"),
    ("fa", "Farsi (Persian)", "فارسی", "rtl"),
]
SCRIPT_RANGES = {
    "hi": r"\x{0900}-\x{097F}",
    "mr": r"\x{0900}-\x{097F}",
    "bn": r"\x{0980}-\x{09FF}",
    "pa": r"\x{0A00}-\x{0A7F}",
    "gu": r"\x{0A80}-\x{0AFF}",
    "ta": r"\x{0B80}-\x{0BFF}",
    "te": r"\x{0C00}-\x{0C7F}",
    "ml": r"\x{0D00}-\x{0D7F}",
    "ur": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "en": "A-Za-z",
}


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def right_trimmed(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return trimmed(F.coalesce(c, F.lit(""))) == ""


def plain_result(c: Column) -> Column:
    """Markup taken out, ends trimmed."""
    return trimmed(F.regexp_replace(c, "<[^>]+>", ""))


#: Runs of white space but for single spaces, which most are. What comes next is asked for first, as a class that visible
#: ASCII fails at once: an intersection of classes (&&) takes Java some five times as long.
RUNS = rf"(?=[^!-~])(?: (?=[^!-~])[{WS}]+|(?=[^ -~])[{WS}]+)"


def plain_text(c: Column) -> Column:
    """Markup taken out, white space collapsed to single spaces, ends trimmed."""
    return trimmed(F.regexp_replace(F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, "<[^>]+>", "")).otherwise(c), RUNS, " "))


def numbers(c: Column) -> Column:
    """Integers and decimals of a text, in order."""
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def occurrences(c: Column, token: Column) -> Column:
    """How often token stands in the text without overlap; 0 for an empty token."""
    n = F.length(token)
    return F.when(n == 0, 0).otherwise(((F.length(c) - F.length(F.replace(c, token, F.lit("")))) / F.when(n > 0, n)).cast("int"))


def half_up(c: Column) -> Column:
    """Rounded to the nearest integer, halves up."""
    return F.floor(c + 0.5)


def xml_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _rewritten(c: Column, may: str, pattern: str, change) -> Column:
    """c with change(group 1) in place of each match of a pattern; texts without `may` are left alone."""
    made = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), change)
    joined = F.array_join(F.zip_with(F.split(c, pattern, -1), made, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(F.contains(c, F.lit(may)), joined).otherwise(c)


def _character(number: Column) -> Column:
    """The character of a reference's digits, decimal or x and hexadecimal; the reference as it is if there is none."""
    hexadecimal = F.lower(F.left(number, F.lit(1))) == "x"
    code = F.when(hexadecimal, F.conv(F.substring(number, 2, 8), 16, 10)).otherwise(number).try_cast("long")
    pair = code - 0x10000
    units = F.when(code > 0xFFFF, F.concat(F.hex(F.shiftright(pair, 10) + 0xD800), F.hex(F.pmod(pair, F.lit(1024)) + 0xDC00))).otherwise(F.lpad(F.hex(code), 4, "0"))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(units), "UTF-16BE")).otherwise(F.concat(F.lit("&#"), number, F.lit(";")))


#: What stands in a document without being markup: comments, CDATA sections, processing instructions.
NOT_MARKUP = r"(?s:<(?:!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>))"  #: one '<' for all: most characters fail at once
#: Characters that no XML document may hold stand around the number of a place that one of these was taken from.
PLACE = r"\x01([0-9]+)\x02"


def only_markup(xml: Column) -> Column:
    """Comments and instructions taken out, CDATA sections as escaped text: every '<' left opens or closes an element."""
    text = lambda m: F.when(F.startswith(m, F.lit("<![CDATA[")), xml_escape(F.substring(m, F.lit(10), F.length(m) - 12))).otherwise("")
    made = F.transform(F.regexp_extract_all(xml, F.lit(NOT_MARKUP), F.lit(0)), text)
    without = F.array_join(F.zip_with(F.split(xml, NOT_MARKUP, -1), made, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(F.contains(xml, F.lit("<!")) | F.contains(xml, F.lit("<?")), without).otherwise(xml)


def taken_out(xml: Column) -> tuple[Column, Column]:
    """(xml with numbered places for what is not markup, what was there): the same elements as in only_markup."""
    found = F.regexp_extract_all(xml, F.lit(NOT_MARKUP), F.lit(0))
    gaps = F.split(xml, NOT_MARKUP, -1)
    named = let(gaps, lambda g: F.array_join(F.transform(g, lambda x, k: F.when(k == 0, x).otherwise(F.concat(F.lit("\x01"), (k - 1).cast("string"), F.lit("\x02"), x))), ""))
    return F.when(F.contains(xml, F.lit("<!")) | F.contains(xml, F.lit("<?")), named).otherwise(xml), found


def put_back(text: Column, found: Column) -> Column:
    """What taken_out took, at the places that are left."""
    there = F.transform(F.regexp_extract_all(text, F.lit(PLACE), F.lit(1)), lambda k: F.coalesce(F.get(found, k.cast("int")), F.lit("")))
    whole = F.array_join(F.zip_with(F.split(text, PLACE, -1), there, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("\x01")), whole).otherwise(text)


def xml_unescape(c: Column) -> Column:
    """Numeric references and the five named ones as characters; what an escaped ampersand makes is not read again."""
    c = _rewritten(c, "&#", "&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", _character)
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def classify_format(path: Column) -> Column:
    """docx, xliff or mqxliff by the file extension; null for any other."""
    ext = extension(path)
    return F.when(ext == ".docx", "docx").when(ext == ".xliff", "xliff").when(ext.isin(".mqxliff", ".xml"), "mqxliff")


def normalize_domain(c: Column) -> Column:
    return F.when(c.isin("general", "medical", "legal"), c).otherwise("universal")


def failure_hint(message: Column) -> Column:
    """Which side a failure points at: the model's configuration, or quota, keys and network."""
    return F.when(message.rlike(r"(?i)model.+not found|not supported for generatecontent"), "model_config").otherwise("quota_auth_network")


def joined_runs(paragraph: Column, run: str) -> Column:
    """The texts that group 1 of run captures, joined."""
    return F.array_join(F.regexp_extract_all(paragraph, F.lit(run), F.lit(1)), "")


#: Fixed value: how a message says when to try again.
RETRY_HINT = r"(?:retry|try again) (?:in|after) ([0-9]+(?:\.[0-9]+)?) ?s"


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(1000) * F.pow(F.lit(2), attempt), F.lit(30000)).cast("long")


def retry_after_ms(message: Column) -> Column:
    """Milliseconds to wait by a message's 'retry in N s' hint, one second on top, 65 s at most; null without a hint."""
    seconds = F.regexp_extract(F.lower(message), RETRY_HINT, 1).try_cast("double")
    return F.when(seconds.isNotNull(), F.least(F.ceil(seconds * 1000) + 1000, F.lit(65000))).cast("long")


#: What marks a failure as worth another try.
RETRYABLE = r"429|500|502|503|504|rate limit|quota|timeout|network|econnreset"


def is_retryable(message: Column, pattern: str = RETRYABLE) -> Column:
    return F.coalesce(F.lower(message).rlike(pattern), F.lit(False))


def seconds_of(ms: Column) -> Column:
    return F.round(ms / 1000.0, 2)
