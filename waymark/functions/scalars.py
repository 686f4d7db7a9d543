"""Hash, address, metric and JSON expressions. All are built-in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds until a target is tried again after 1, 2, ... failures; the last holds for all later ones.
BACKOFF = (60, 300, 1800, 7200, 43200, 604800)
#: Kbps of each capability letter.
CAPS_KBPS = {"k": 6, "l": 30, "m": 56, "n": 96, "o": 192, "p": 1280, "x": 4096}
#: Upper bounds (exclusive) of bandwidth classes in kbps.
BANDWIDTH = ((12, "vlow"), (48, "low"), (64, "below_avg"), (256, "avg"), (2048, "high"))
LAST_BANDWIDTH = "extra_high"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used: an array of one element binds it."""
    return F.transform(F.array(value), use)[0]


def filled(value: Column) -> Column:
    """The value, or null where it is ''."""
    return once(value, lambda v: F.when(v != "", v))


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word bounds see ASCII letters, digits and _ alone; those of Java's `\\b` see all letters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def b32_address(hash_hex: Column) -> Column:
    """The base32 address of a 40-digit hex hash; '' for anything else. Four groups of 40 bits are written in base 32."""
    groups = [F.translate(F.lpad(F.conv(F.substring(hash_hex, 1 + 10 * i, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567") for i in range(4)]
    return F.when(hash_hex.rlike("^[0-9A-Fa-f]{40}$"), F.concat(*groups, F.lit(".b32.i2p"))).otherwise("")


def decode_blob(blob: Column) -> Column:
    """Bytes of a destination in the network's base64 (`-` and `~` variants), or null if it isn't base64."""
    plain = F.regexp_replace(F.translate(blob, "~-_", "/+/"), "=+$", "")
    return F.try_to_binary(F.concat(plain, F.substring(F.lit("==="), 1, F.pmod(-F.length(plain), F.lit(4)).cast("int"))), F.lit("base64"))


def identity_hash(binary: Column) -> Column:
    """Upper hex of the first 20 bytes."""
    return F.upper(F.hex(F.substring(binary, 1, 20)))


def hash_of_file_name(path: Column) -> Column:
    """The 40-digit hash that a base64 file name spells, if it has 20 bytes; else ''."""
    stem = F.regexp_extract(path, r"([^/]+?)\.[^./]*$", 1)
    for prefix in ("routerInfo-", "leaseSet-"):
        stem = F.regexp_replace(stem, f"^{prefix}", "")
    found = F.try_to_binary(F.translate(F.rpad(stem, 28, "="), "-_~", "+//"), F.lit("base64"))
    return F.when(F.octet_length(found) == 20, F.lower(F.hex(found))).otherwise("")


def hash_of_link(link: Column) -> Column:
    """The upper hash of a link to a record file: the one that its name spells, else the SHA-1 of the name."""
    spelt = hash_of_file_name(F.concat(link, F.lit(".dat")))
    return F.upper(F.when(spelt != "", spelt).otherwise(F.sha1(link.cast("binary"))))


def sample_id(body: Column) -> Column:
    """The first 12 digits of the SHA-256 of the first 8192 characters of a page."""
    return F.substring(F.sha2(F.substring(F.coalesce(body, F.lit("")), 1, 8192).cast("binary"), 256), 1, 12)


def content_hash(body: Column) -> Column:
    """SHA-256 of the body; '' for an empty or missing one."""
    return F.when(F.coalesce(F.octet_length(body), F.lit(0)) > 0, F.sha2(body.cast("binary"), 256)).otherwise("")


def backoff_interval(failures: Column, strategy: str = "exponential") -> Column:
    """Seconds to wait after so many failures in a row; 0 for none."""
    if strategy == "fixed":
        wait = failures * F.lit(300)
    elif strategy == "exponential":
        wait = F.element_at(F.array(*map(F.lit, BACKOFF)), F.greatest(F.least(failures, F.lit(len(BACKOFF))), F.lit(1)).cast("int"))
    else:
        raise ValueError(f"unknown backoff strategy: {strategy}")
    return F.when(failures <= 0, F.lit(0)).otherwise(wait).cast("double")


def bandwidth_class(kbps: Column) -> Column:
    out = F.lit(LAST_BANDWIDTH)
    for bound, name in reversed(BANDWIDTH):
        out = F.when(kbps < bound, F.lit(name)).otherwise(out)
    return out


def caps_bandwidth(caps: Column) -> Column:
    """The largest bandwidth that a capability string announces, 0 without one."""
    known = F.create_map(*[F.lit(x) for pair in CAPS_KBPS.items() for x in pair])
    return F.coalesce(F.array_max(F.transform(F.split(F.lower(caps), ""), lambda c: F.coalesce(known[c], F.lit(0)))), F.lit(0))


def options_mask(bits: Column) -> Column:
    """Bitwise or of an array of masks."""
    return F.aggregate(bits, F.lit(0), lambda a, b: a.bitwiseOR(b))


def utc_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def http_date(text: Column) -> Column:
    """The day of an HTTP date, or the text itself if it isn't one."""
    day = F.date_format(F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z")), "yyyy-MM-dd")
    return F.coalesce(day, text)


def leading_int(text: Column) -> Column:
    """A text's leading whole number, 0 without one, null for null: the cast of a dynamically typed store."""
    return F.when(text.isNotNull(), F.coalesce(F.expr("cast(null as int)"), F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)))


def analysed(deep_analysis: Column) -> Column:
    """Whether a row has an analysis worth reading."""
    return F.length(F.coalesce(deep_analysis, F.lit(""))) > 50


def interest_score(deep_analysis: Column) -> Column:
    return F.when(analysed(deep_analysis), leading_int(F.replace(F.get_json_object(deep_analysis, "$.interest_score"), F.lit("null"), F.lit(""))))


def content_depth(found_links: Column, body_length: Column) -> Column:
    """Links weighed by the page's size. Commas of the JSON text are counted, as the measure is defined on that text."""
    commas = F.length(found_links) - F.length(F.replace(found_links, F.lit(","), F.lit("")))
    depth = (1 + F.floor(commas / 2)) * F.log10(1 + F.greatest(body_length, F.lit(1)) / 1000.0)
    none = (F.coalesce(found_links, F.lit("[]")) == "[]") | body_length.isNull() | (body_length <= 0)
    return F.round(F.when(none, F.lit(0.0)).otherwise(depth), 2)


def stability_index(response_time: Column, bandwidth: Column, leases: Column) -> Column:
    index = F.coalesce(bandwidth, F.lit(0)) * F.coalesce(leases, F.lit(0)) / (response_time + 1.0)
    return F.round(F.when(response_time.isNull() | (response_time <= 0), F.lit(0.0)).otherwise(index), 2)


def reachable(status: Column) -> Column:
    return (status >= 200) & (status < 500)


def readiness(peers: Column, target: Column, tunnels: Column, uptime: Column) -> Column:
    """0.4 of peers against their target (10 at least), 0.4 of two tunnels, 0.2 of five minutes' uptime; each at most whole."""
    part = lambda x: F.least(x, F.lit(1.0))
    return 0.4 * part(peers / F.greatest(target, F.lit(10))) + 0.4 * part(tunnels / 2.0) + 0.2 * part(uptime / 300.0)


def links_of(json_text: Column) -> Column:
    """The array in a JSON text; empty if it is malformed."""
    return F.coalesce(F.from_json(json_text, "array<string>"), F.array().cast("array<string>"))


def flags_of(json_text: Column) -> Column:
    """The flags in a JSON text; plain strings of old rows become flags of type `legacy`; empty if malformed."""
    rich = F.filter(F.from_json(json_text, "array<struct<type:string,value:string>>"), lambda f: f["type"].isNotNull())
    plain = F.transform(F.filter(links_of(json_text), lambda s: ~s.startswith("{")), lambda s: F.struct(F.lit("legacy").alias("type"), s.alias("value")))
    return F.when(F.size(F.coalesce(rich, F.array())) > 0, rich).otherwise(plain)


def normal_headers(headers: Column) -> Column:
    """Header names in Title-Case."""
    return F.transform_keys(headers, lambda k, _: F.array_join(F.transform(F.split(F.lower(k), "-"), lambda p: F.initcap(p)), "-"))


def header(headers: Column, name: str) -> Column:
    """A header by name, whatever its case; '' without it."""
    found = F.filter(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.try_element_at(found, F.lit(1))["value"], F.lit(""))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)
