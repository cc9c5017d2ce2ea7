"""URL, host and path predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SCHEMES = ["http", "https", "mailto", "data"]
READABLE = ["csv", "tsv", "json", "jsonl", "md", "markdown", "txt", "log", "yaml", "yml", "xml", "docx", "pptx", "xlsx", "epub", "zip"]
LOCAL_NAMES = ["localhost", "localhost.localdomain", "ip6-localhost"]
WATCH_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com"]
DEFAULT_PORTS = {"http": 80, "https": 443}


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def port(url: Column) -> Column:
    """The stated port, or the scheme's own."""
    stated = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1)
    return F.when(stated != "", stated.cast("int")).when(scheme(url) == "http", 80).when(scheme(url) == "https", 443)


def is_path_like(value: Column) -> Column:
    bare = value.rlike(r"^[^/:]+\.(" + "|".join(READABLE) + ")$")
    return value.rlike(r"^(\.\.?/|~|/|[A-Za-z]:[\\/])") | F.contains(value, F.lit("\\")) | bare


def normalise_source(value: Column) -> Column:
    """struct<source, error>: what a stated source means; refused ones keep their reason."""
    v = F.trim(value)
    good = lambda c: F.struct(c.alias("source"), F.lit(None).cast("string").alias("error"))
    bad = lambda why: F.struct(F.lit(None).cast("string").alias("source"), F.lit(why).alias("error"))
    return (
        F.when(v == "", bad("empty"))
        .when(v.rlike(r"(?i)^(https?|file)://"), good(v))
        .when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), bad("scheme"))
        .when(is_path_like(v), bad("path"))
        .when(v.rlike(r"^(localhost|[0-9]+(\.[0-9]+){3})(:[0-9]+)?(/|$)"), good(F.concat(F.lit("http://"), v)))
        .when(F.regexp_extract(v, "^([^/?#]*)", 1).rlike(r"\."), good(F.concat(F.lit("https://"), v)))
        .otherwise(bad("source"))
    )


def output_name(url: Column) -> Column:
    """Slug of the host and the last two path parts; web-page if nothing is left."""
    from scrivane.functions.text import slug

    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    name = slug(F.array_join(F.concat(F.array(host(url)), last), "-"))
    return F.when(name == "", "web-page").otherwise(name)


def output_path(name: Column, directory: str = "output") -> Column:
    return F.concat(F.lit(directory + "/"), F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit(".pdf"))


def published_name(url: Column) -> Column:
    return F.concat(output_name(url), F.lit("-"), F.substring(F.sha2(url, 256), 1, 12))


def crossed_origin(asked: Column, landed: Column) -> Column:
    web = scheme(asked).isin("http", "https") & scheme(landed).isin("http", "https")
    return web & ~((scheme(asked) == scheme(landed)) & (host(asked) == host(landed)) & (port(asked) == port(landed)))


def landed_on_home(asked: Column, landed: Column) -> Column:
    """A page was asked for, and the same origin's root came back."""
    stripped = F.regexp_replace(path(asked), r"(?i)/(index|default)\.(html?|php|aspx?)$", "/")
    same = scheme(asked).isin("http", "https") & (scheme(asked) == scheme(landed)) & (host(asked) == host(landed)) & (port(asked) == port(landed))
    return same & ~stripped.isin("", "/") & path(landed).isin("", "/")


def same_service(target: Column, home: Column) -> Column:
    """An equal host or a strict subdomain; literal addresses only by equality."""
    literal = home.rlike(r"^[0-9.]+$") | F.contains(home, F.lit("["))
    return (target != "") & (home != "") & ((target == home) | (~literal & F.endswith(target, F.concat(F.lit("."), home))))


def within_roots(target: Column, roots: Column) -> Column:
    return F.exists(roots, lambda r: (target == r) | F.startswith(target, F.concat(r, F.lit("/"))))


def watch_page(url: Column) -> Column:
    return host(url).isin(WATCH_HOSTS) & (path(url) == "/watch") & (F.regexp_extract(url, r"[?&]v=([^&#]+)", 1) != "")


def octets(address: Column) -> Column:
    return F.when(address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.transform(F.split(address, r"\."), lambda x: x.cast("int")))


def is_internal_ipv4(address: Column) -> Column:
    """Not globally routed, or multicast; null if the text is no dotted address."""
    o = octets(address)
    a, b, c = F.get(o, 0), F.get(o, 1), F.get(o, 2)
    return F.when(o.isNull() | F.exists(o, lambda x: x > 255), None).otherwise(
        a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.between(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    )
