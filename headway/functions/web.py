"""Visit-log expressions: device, referrer, client address, keyed hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device markers, search and social hosts.
DEVICE_BUCKETS = ["mobile", "tablet", "desktop", "bot", "unknown"]
BOT_MARKERS = r"bot|crawl|spider|slurp|curl/|wget/|python-requests"
SEARCH_HOSTS = [
    "duckduckgo.com", "ecosia.org", "kagi.com", "brave.com", "yahoo.com", "yandex.com",
    "baidu.com", "qwant.com", "startpage.com", "you.com", "perplexity.ai",
    "search.marginalia.nu", "google.com", "bing.com",
]
SEARCH_SUFFIXES = [
    ".google.com", ".google.co.uk", ".google.ca", ".google.de", ".google.fr", ".bing.com",
]
SOCIAL_HOSTS = [
    "facebook.com", "m.facebook.com", "l.facebook.com", "x.com", "twitter.com", "t.co",
    "mobile.twitter.com", "instagram.com", "l.instagram.com", "threads.net", "reddit.com",
    "old.reddit.com", "new.reddit.com", "i.reddit.com", "linkedin.com", "lnkd.in",
    "www.linkedin.com", "tiktok.com", "vm.tiktok.com", "youtube.com", "m.youtube.com",
    "youtu.be", "bsky.app", "bsky.social", "mastodon.social", "pinterest.com", "pin.it",
]
URL_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)"


def device_bucket(user_agent: Column) -> Column:
    ua = F.lower(user_agent)
    return (
        F.when(F.coalesce(ua, F.lit("")) == "", "unknown")
        .when(ua.rlike(BOT_MARKERS), "bot")
        .when(ua.rlike("ipad|tablet"), "tablet")
        .when(ua.rlike("mobi|android|iphone"), "mobile")
        .otherwise("desktop")
    )


def url_host(url: Column) -> Column:
    """Lower-case host without user, port or path; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, URL_HOST, 1)), F.lit(""))


def referrer_bucket(host: Column, own_hosts: list[str] | None = None) -> Column:
    """direct / search / social / other; own and missing hosts are direct."""
    is_search = host.isin(SEARCH_HOSTS)
    for s in SEARCH_SUFFIXES:
        is_search = is_search | host.endswith(s)
    own = host.isin(own_hosts) if own_hosts else F.lit(False)
    return (
        F.when(host.isNull() | own, "direct")
        .when(is_search, "search")
        .when(host.isin(SOCIAL_HOSTS), "social")
        .otherwise("other")
    )


def client_ip(real_ip: Column, forwarded: Column, peer: Column) -> Column:
    """Trusted real-ip header, else the last forwarded hop, else the peer."""
    last = F.trim(F.element_at(F.split(F.nullif(forwarded, F.lit("")), ","), -1))
    return F.coalesce(F.nullif(F.trim(real_ip), F.lit("")), last, peer, F.lit("unknown"))


def ipv4_number(ip: Column) -> Column:
    """Dotted quad to a whole number; null when malformed."""
    octets = F.transform(F.split(ip, r"\."), lambda t: t.try_cast("bigint"))
    num = F.aggregate(
        octets, F.lit(0).cast("bigint"), lambda a, x: a * 256 + F.when(x.between(0, 255), x))
    return F.when(F.regexp_count(ip, F.lit(r"\.")) == 3, num)


#: Hex digits before an IPv4 address in the address space of both families.
IPV4_PREFIX = "0" * 20 + "ffff"


def address_hex(ip: Column) -> Column:
    """An address of either family as 32 hex digits, IPv4 as its mapped form; null when malformed.

    Digits sort as addresses do. A zone (`%eth0`) is left out.
    """
    said = F.regexp_replace(F.lower(F.trim(ip)), "%.*$", "")
    quad = F.regexp_extract(said, r"(?:^|:)(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    number = ipv4_number(F.nullif(quad, F.lit("")))
    last = F.lpad(F.lower(F.hex(number)), 8, "0")
    # A dotted tail of an IPv6 address is two groups.
    text = F.when(quad == "", said).otherwise(F.concat(
        F.left(said, F.length(said) - F.length(quad)), F.left(last, F.lit(4)), F.lit(":"), F.right(last, F.lit(4))))
    sides = F.split(text, "::")

    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    head, tail = groups(F.get(sides, F.lit(0))), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    zeros = 8 - F.size(head) - F.size(tail)
    legal = F.forall(F.concat(head, tail), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    legal = legal & F.when(F.size(sides) == 1, zeros == 0).otherwise((F.size(sides) == 2) & (zeros >= 1))
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), tail)
    six = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(~text.contains(":"), F.lit(None)).when(said == quad, F.concat(F.lit(IPV4_PREFIX), last)).when(legal, six)


def prefix_hex(address: Column, bits: Column) -> Column:
    """The first `bits` bits of 32 hex digits, the last digit of them cut to its leading bits."""
    whole = F.floor(bits / 4).cast("int")
    rest = (bits % 4).cast("int")
    digit = F.conv(F.substring(address, whole + 1, F.lit(1)), 16, 10).cast("int")
    part = F.floor(digit / F.pow(F.lit(2), 4 - rest)).cast("int").cast("string")
    return F.concat(F.left(address, whole), F.when(rest == 0, "").otherwise(F.concat(F.lit("/"), part)))


def _xor_pad(key_hex: Column, pad: int) -> Column:
    """Key (hex, at most 64 bytes) padded with zeros and xor-ed with `pad`."""
    padded = F.rpad(key_hex, 128, "0")
    word = int.from_bytes(bytes([pad]) * 4, "big")
    out = []
    for i in range(16):
        chunk = F.conv(F.substring(padded, 8 * i + 1, 8), 16, 10).cast("bigint")
        out.append(F.lpad(F.hex(chunk.bitwiseXOR(F.lit(word).cast("bigint"))), 8, "0"))
    return F.unhex(F.concat(*out))


def hmac_sha256(key: Column | bytes, message: Column) -> Column:
    """HMAC-SHA256 as hex; `key` is bytes, or a string column of any length."""
    msg = F.encode(message, "UTF-8")
    if isinstance(key, (bytes, bytearray)):
        k = hashlib.sha256(key).digest() if len(key) > 64 else bytes(key)
        k = k.ljust(64, b"\0")
        inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in k).hex()))
        outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in k).hex()))
    else:
        raw = F.encode(key, "UTF-8")
        key_hex = F.when(F.octet_length(raw) > 64, F.sha2(raw, 256)).otherwise(F.hex(raw))
        inner, outer = _xor_pad(key_hex, 0x36), _xor_pad(key_hex, 0x5C)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, msg), 256))), 256)


def daily_key(salt: str, day: Column) -> Column:
    """Key that rotates with the local day: salt followed by the ISO date."""
    return F.concat(F.lit(salt), day.cast("string"))
