"""Text and scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that cells and inline text write as character references.
CELL_REFERENCES = "&<>`!#*[\\]_{|}"
INLINE_REFERENCES = "&<>`*[\\]_"
#: Characters of a link destination that are percent-encoded.
DESTINATION_ESCAPES = " \t\n()<>\\`\"'"


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def normalised(text: Column) -> Column:
    return F.lower(collapsed(text))


def _chain(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def reference_pairs(characters: str) -> list[tuple[str, str]]:
    """The ampersand comes first; `#` would touch the references, so it goes before all others but after it by way of a placeholder."""
    rest = [c for c in characters if c not in "&#"]
    first = [("&", "\u0001"), ("#", "\u0002")] if "#" in characters else [("&", "\u0001")]
    last = [("\u0001", "&#38;")] + ([("\u0002", "&#35;")] if "#" in characters else [])
    return first + [(c, f"&\u0003{ord(c)};") for c in rest] + last + [("\u0003", "#")]


def escape_cell(text: Column) -> Column:
    return F.replace(_chain(text, reference_pairs(CELL_REFERENCES)), F.lit("\n"), F.lit("<br>"))


def escape_inline(text: Column) -> Column:
    return _chain(text, reference_pairs(INLINE_REFERENCES))


def escape_lines(text: Column) -> Column:
    """Inline escapes, and what would open a block at the start of a line."""
    out = escape_inline(text)
    out = F.regexp_replace(out, r"(?m)^(    |\t)", "&#32;&#32;")
    for c in "+-:=~":
        out = F.regexp_replace(out, rf"(?m)^\{c}", f"&#{ord(c)};")
    return F.regexp_replace(out, r"(?m)^([0-9]+)\.", "$1&#46;")


def destination_pairs() -> list[tuple[str, str]]:
    return [(c, f"%{ord(c):02X}") for c in DESTINATION_ESCAPES]


def escape_destination(url: Column) -> Column:
    return _chain(url, destination_pairs())


def escape_html(text: Column) -> Column:
    return _chain(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])


def fence(text: Column) -> Column:
    """A code block with a fence longer than any backtick run inside."""
    body = F.regexp_replace(text, "\n+$", "")
    runs = F.transform(F.regexp_extract_all(body, F.lit("(`+)"), F.lit(1)), F.length)
    ticks = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(ticks, F.lit("\n"), body, F.lit("\n"), ticks)


def html_integer(value: Column) -> Column:
    """Leading white space, a sign and digits; the rest is ignored; null outside 32 bits."""
    digits = F.regexp_extract(value, r"^[ \t\n\f\r]*([+-]?[0-9]+)", 1)
    number = F.when((digits != "") & (F.length(digits) <= 18), digits).try_cast("bigint")
    return F.when(number.between(-(2**31), 2**31 - 1), number)


def slug(text: Column, most: int = 120) -> Column:
    out = F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", ""), 1, most)


def safe_id(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_-]", "-"), 1, 64)


def calendar_date(value: Column) -> Column:
    """YYYY-MM-DD of a leading date with one kind of separator, if the calendar has it; else null."""
    shaped = F.regexp_extract(value, r"^(\d{4})([-/]?)(\d{2})\2(\d{2})(?!\d)", 0)
    digits = F.regexp_replace(shaped, "[-/]", "")
    return F.when(shaped != "", F.date_format(F.try_to_date(digits, "yyyyMMdd"), "yyyy-MM-dd"))


def meta_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(key)), "^(dc|dcterms):", "$1.")


def citation_time(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; floors."""
    s = F.floor(seconds)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def vtt_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm, rounded to milliseconds before it is split."""
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def caption_time(seconds: Column) -> Column:
    """The captions' form: fields are floored first, so the seconds can print as 60.000."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%06.3f", F.floor(whole / 3600), F.floor(whole / 60) % 60, seconds - F.floor(seconds / 60) * 60)


def version_parts(text: Column) -> Column:
    """Dotted integers as an array; null if there are none."""
    found = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda p: p.cast("int")))


def css_length(text: Column) -> Column:
    return text.rlike(r"^(0|[0-9]+(\.[0-9]+)?(px|in|cm|mm))$")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def clock_micros(ts: Column) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def clock_seconds(ts: Column) -> Column:
    return F.floor(clock_micros(ts) / 1_000_000)


def finite(value: Column) -> Column:
    """A number, or 0 for what is none or not finite."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(n)


def bounded(text: Column, limit: int, mark: str = " [...]") -> Column:
    return F.when(F.length(F.trim(text)) > limit, F.concat(F.substring(F.trim(text), 1, limit), F.lit(mark))).otherwise(F.trim(text))


def resolve_corrections(text: Column) -> Column:
    """{word||||alt=r} keeps the word, {word||||spelling=r} the replacement, other marks the word."""
    spelled = F.regexp_replace(text, r"\{([^{}|]*)\|\|\|\|spelling=([^{}]*)\}", "$2")
    return F.regexp_replace(spelled, r"\{([^{}|]*)\|\|\|\|[^{}]*\}", "$1")


def unknown_corrections(text: Column) -> Column:
    kinds = F.regexp_extract_all(text, F.lit(r"\{[^{}|]*\|\|\|\|([a-z]+)=[^{}]*\}"), F.lit(1))
    return F.array_distinct(F.filter(kinds, lambda k: ~k.isin("alt", "spelling")))


def clean_narration(text: Column) -> Column:
    return collapsed(F.regexp_replace(text, r"/pause-[0-9]+/", " "))


def mask_volatile(text: Column, workdir: str) -> Column:
    """Paths, timestamps, versions and sizes as placeholders."""
    out = F.replace(text, F.lit(workdir), F.lit("<workdir>"))
    out = F.regexp_replace(out, r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z?", "<time>")
    out = F.regexp_replace(out, r"\bv?\d+\.\d+\.\d+\b", "<version>")
    return F.regexp_replace(out, r"\b\d+ bytes\b", "<size>")


def single_bytes(text: Column) -> Column:
    """Windows-1252 bytes of a text whose characters are all in Latin-1."""
    return F.encode(text, "ISO-8859-1")
