"""Redaction and local-path rules as column expressions; the HTML allow-list is in scrivane.operators.pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivane.functions.text import escape_html

REDACTED = "[REDACTED PASSWORD]"


def redact_values(text: Column, secrets: Column, mark: str = REDACTED) -> Column:
    """Every secret of the array taken out of the text."""
    return F.aggregate(F.filter(secrets, lambda s: F.coalesce(s, F.lit("")) != ""), text, lambda t, s: F.replace(t, s, F.lit(mark)))


def document_title(title: Column) -> Column:
    return F.concat(F.lit("<title>"), escape_html(title), F.lit("</title>"))


def standalone_document(title: Column, language: Column, body: Column) -> Column:
    return F.concat(F.lit('<!doctype html><html lang="'), escape_html(F.coalesce(language, F.lit(""))), F.lit('"><head><meta charset="utf-8">'), document_title(title), F.lit("</head><body>"), body, F.lit("</body></html>"))


def relative_local_path(url: Column, directory: str) -> Column:
    """A file URL below the directory as ./rest; null for others and for paths with dot segments."""
    path = F.url_decode(F.regexp_extract(url, r"^file://([^?#]*)", 1))
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    segments = F.split(path, "/")
    below = F.startswith(path, F.lit(directory.rstrip("/") + "/")) & ~F.exists(segments, lambda s: s.isin("..", "."))
    return F.when(below, F.concat(F.lit("."), F.substring(path, F.lit(len(directory.rstrip("/")) + 1), F.length(path)), tail))


def record_data_url(url: Column) -> Column:
    """A data URL is recorded as its header and length."""
    head = F.regexp_extract(url, r"^(data:[^,]*),", 1)
    return F.when(head != "", F.concat(head, F.lit(" ("), (F.length(url) - F.length(head) - 1).cast("string"), F.lit(" characters)"))).otherwise(url)
