"""Network and refusal policies."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.functions.arrow import arrow_function

# Fixed values.
EXIT_CODES = {"usage": 2, "source": 3, "policy": 4, "capture": 5, "render": 6, "validation": 7, "output": 8}
OTHER_CODE = 9
EXTRA_INTERNAL = ("fec0::/10", "64:ff9b:1::/48", "2001::/32")
PROFILE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def automation_refusal(headers: Column) -> Column:
    """Which automation check refused, by response headers (lower-case names)."""
    return F.when(F.lower(F.get(F.array(headers["cf-mitigated"]), 0)) == "challenge", "challenge").when(F.lower(headers["server"]) == "datadome", "datadome")


def refused_message(status: Column, headers: Column) -> Column:
    return (F.when(automation_refusal(headers).isNotNull(), "refused by an automation check").when(status == 401, "sign-in needed").when(status == 403, "forbidden"))


def exit_code(kind: Column) -> Column:
    out = F.lit(OTHER_CODE)
    for name, code in EXIT_CODES.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


def _embedded(a):
    """IPv4 addresses that an IPv6 one stands for."""
    if a.ipv4_mapped:
        yield a.ipv4_mapped
    if a.sixtofour:
        yield a.sixtofour
    n = int(a)
    if n >> 32 == 0 and n > 1 or n >> 32 == 0x64FF9B << 64 or (n >> 32) & 0xFFFFFFFF == 0 and (n >> 64) == 0xFFFF << 16:
        yield ipaddress.IPv4Address(n & 0xFFFFFFFF)


def internal_address(text: str) -> bool | None:
    """Not global, multicast, a reserved range, or standing for such an IPv4 address; None if it is no address."""
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    if not a.is_global or a.is_multicast:
        return True
    if a.version == 6:
        return any(a in ipaddress.ip_network(r) for r in EXTRA_INTERNAL) or any(internal_address(str(b)) for b in _embedded(a))
    return False


def literal_readings(host: str) -> list[str]:
    """Addresses that a host text can be read as: strict, and the loose forms with 1 to 4 parts in octal, hexadecimal or decimal."""
    host = host.strip("[]")
    try:
        return [str(ipaddress.ip_address(host))]
    except ValueError:
        pass
    parts = host.split(".")
    try:
        numbers = [int(p, 16 if p.lower().startswith("0x") else 8 if len(p) > 1 and p.startswith("0") else 10) for p in parts]
    except ValueError:
        return []
    if not 1 <= len(numbers) <= 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return []
    value = numbers[-1]
    for i, n in enumerate(numbers[:-1]):
        value += n << 8 * (3 - i)
    return [str(ipaddress.IPv4Address(value))]


@arrow_function("boolean")
def is_internal(addresses: pa.Array) -> pa.Array:
    return pa.array([None if a is None else internal_address(a) for a in addresses.to_pylist()], pa.bool_())


@arrow_function("array<string>")
def readings(hosts: pa.Array) -> pa.Array:
    return pa.array([None if h is None else literal_readings(h) for h in hosts.to_pylist()], pa.list_(pa.string()))


def check_target(url: Column, resolved: Column, allow_private: bool = False) -> Column:
    """Why an HTTP target is refused, or null. resolved: the addresses of its host, from a resolver table."""
    from scrivane.functions.url import LOCAL_NAMES, host

    h = host(url)
    internal = F.exists(resolved, lambda a: F.coalesce(a, F.lit(True)))
    refused = F.when(h == "", "no host").when(h.isin(LOCAL_NAMES) | F.endswith(h, F.lit(".localhost")), "local name").when(F.coalesce(F.size(resolved), F.lit(0)) <= 0, "unresolvable").when(internal, "internal address")
    return F.when(h == "", "no host") if allow_private else refused


def failed_requests(failures: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(tally by kind, the first ones listed) of rows (seq, url, kind): a URL counts once, under the kind of its first failure."""
    first = failures.groupBy("url").agg(F.min(F.struct("seq", "kind")).alias("f")).select("url", "f.seq", "f.kind")
    return first.groupBy("kind").agg(F.count(F.lit(1)).alias("urls")), first.orderBy("seq", "url").limit(most)


def empty_capture(text_characters: Column, visuals: Column, videos: Column, least: int = 50) -> Column:
    return (visuals == 0) & (videos == 0) & (text_characters < least)
