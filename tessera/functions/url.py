"""URL rules, as columns and for the HTML kernel."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

# fmt: off
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gclsrc", "dclid", "fbclid", "fb_action_ids", "fb_action_types",
    "fb_source", "fb_ref", "msclkid", "twclid", "ref", "referer", "referrer", "mc_cid", "mc_eid", "_ga", "_gl",
)
PLACEHOLDERS = (
    "pixel.png", "pixel.gif", "blank.png", "blank.gif", "spacer.png", "spacer.gif", "1x1.", "data:image",
)
# fmt: on

_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def parses(u: str) -> bool:
    """Whether a URL can be parsed: no control signs, whole escapes, no colon first or before a path's first slash."""
    if any(ord(c) < 32 or ord(c) == 127 for c in u) or u.startswith(":"):
        return False
    before = u.split("#", 1)[0]
    m = _SCHEME.match(before)
    if not m and ":" in before.split("?", 1)[0].split("/", 1)[0]:
        return False
    path = before.split("?", 1)[0]
    rest = path[m.end() :] if m else path
    if rest.startswith("//"):
        host = rest[2:].split("/", 1)[0]
        if " " in host or (":" in (tail := host.rpartition("@")[2].rpartition("]")[2]) and not tail.rpartition(":")[2].isdigit() and tail.rpartition(":")[2]):
            return False
    return not _BAD_ESCAPE.search(path)


def resolve(base: str, ref: str) -> str:
    """``ref`` against ``base`` (RFC 3986); signs that a URL can't have are escaped."""
    u = urljoin(base, ref)
    head, mark, fragment = u.partition("#")
    path, qmark, query = head.partition("?")
    if not path.isascii() or " " in path:
        m = re.match(r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/]*)?", path)
        path = m[0] + quote(path[m.end() :], safe="$&+,/:;=@%~")
    return path + qmark + query.replace(" ", "%20") + mark + fragment


def strip_tracking(u: str) -> str:
    if "?" not in u:
        return u
    base, _, query = u.partition("?")
    query, mark, fragment = query.partition("#")
    kept = [p for p in query.split("&") if p and not tracked(p.partition("=")[0])]
    return base + ("?" + "&".join(kept) if kept else "") + mark + fragment


def tracked(key: str) -> bool:
    k = key.lower()
    return k in TRACKING or k.startswith("utm_")


def is_placeholder(u: str) -> bool:
    u = u.lower()
    return any(p in u for p in PLACEHOLDERS)


def render_url(u: str, base: str = "", enabled: bool = False) -> str:
    """A URL as written out: a scheme where only that lacks; resolved if asked for."""
    if u.startswith("//"):
        return "https:" + u
    if u.startswith(("http://", "https://")) or not enabled or not base:
        return u
    return resolve(base, u) if parses(u) and parses(base) else u


# -- the same as columns
#: URLs that parse and are normal already. Most are, and rules of their own take many times as long.
_PLAIN = r"https?://[A-Za-z0-9.-]++(?::[0-9]++)?+(?:/[A-Za-z0-9._~-]++)*+"
#: Two of them with a blank between, and two with one host and port.
_PAIR = f"^{_PLAIN} {_PLAIN}\\z"
_SAME = r"^https?://([A-Za-z0-9.-]++(?::[0-9]++)?+)(?:/[A-Za-z0-9._~-]++)*+ https?://\1(?:/[A-Za-z0-9._~-]++)*+\z"


def normalize(c: Column) -> Column:
    """Without fragment and one slash at the path's end; '' if it doesn't parse. Hosts and queries stay."""
    return F.when(c.rlike(f"^{_PLAIN}\\z"), c).otherwise(_normalize(c))


def _normalize(c: Column) -> Column:
    u = F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+/[^?]+?)/($|[?])", "$1$2")
    ok = F.try_parse_url(F.regexp_replace(u, "[^\\x21-\\x7e]", "x"), F.lit("PROTOCOL")).isNotNull() | ~c.contains(":")
    return F.when(c.isNull(), F.lit(None)).when(ok, u).otherwise("")


def authority(c: Column) -> Column:
    """host:port, without user and password; null if the URL doesn't parse."""
    return F.regexp_replace(F.try_parse_url(F.regexp_replace(c, "[^\\x21-\\x7e]", "x"), F.lit("AUTHORITY")), "^.*@", "")


def same_domain(a: Column, b: Column) -> Column:
    """Whether two URLs have one host and port; false if either doesn't parse."""
    return F.coalesce(authority(a) == authority(b), F.lit(False))


def leads_on(src: Column, dst: Column, stay: bool = True) -> Column:
    """Whether a link's target parses, and if ``stay`` has the host and port of its normalised source."""
    if not stay:
        return normalize(dst) != ""
    pair = F.concat(src, F.lit(" "), dst)
    plain, same = (F.coalesce(pair.rlike(p), F.lit(False)) for p in (_PAIR, _SAME))
    return same | (~plain & same_domain(_normalize(src), dst) & (_normalize(dst) != ""))


def drop_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def strip_tracking_params(c: Column) -> Column:
    """Without tracking parameters; the others keep their order, the fragment stays."""
    head = F.split_part(c, F.lit("?"), F.lit(1))
    rest = F.substring(c, F.length(head) + 2, F.length(c))
    query = F.split_part(rest, F.lit("#"), F.lit(1))
    fragment = F.substring(rest, F.length(query) + 1, F.length(rest))
    key = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).isin(*TRACKING) & ~key(p).startswith("utm_"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(c.contains("?"), F.concat(head, tail, fragment)).otherwise(c)


def placeholder_image(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(re.escape(p) for p in PLACEHOLDERS))


def link_key(c: Column) -> Column:
    """What repeated links are told by: the URL up to its fragment, trimmed."""
    return F.trim(F.split_part(c, F.lit("#"), F.lit(1)))


def scheme_added(c: Column) -> Column:
    return F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)


def checked_pattern(pattern: str) -> str:
    """A pattern in the dialect without look-around and back references; else ValueError."""
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|[*+?}]\+", pattern):
        raise ValueError(f"not supported in a URL pattern: {pattern}")
    re.compile(pattern)
    return pattern
