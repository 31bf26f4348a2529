"""URL cleaning: splitting, normalising, validating and keying URLs.

What a column expression can say is one, so that filters on it run in the JVM. The grammar of the normaliser needs loops; it
is an Arrow UDF over the distinct shapes that the JVM can't prove to be normal already.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .suffixes import BUILT_IN, Suffixes

_PORTS = {"http": 80, "https": 443, "ftp": 21}
_KNOWN = ("http", "https", "ftp", "file", "mailto", "jar")
_TRIMMED = "".join(map(chr, range(33)))
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~" + "!*'();:@&=+$,/?#[]")
_IN_PATH, _IN_QUERY = frozenset("/?#"), frozenset("%&;=:?#")

_STRAY_PERCENT = re.compile(r"%(?![0-9A-Fa-f]{2})")
_UP = re.compile(r"/[^/]*[^/.][^/]*/\.\./|^(?:/\.\./)+")
_DEFAULT_PAGE = re.compile(r"/(?i:index|default)\.(?i:js[pf][afx]?|cgi|cfm|aspx?|[psx]?html?|php[3456]?)(\?|&|#|\Z)")
_MATRIX_SESSION = re.compile(r";jsessionid=.*?(\?|&|#|\Z)")


def _parameter(names: str) -> re.Pattern[str]:
    return re.compile(rf"([?&])(?i:{'|'.join(names.split())})=.*?(&|#|\Z)")


_SESSION = _parameter("sid phpsessid sessionid session_id bv_sessionid jsessionid -session session session_key")
_DISPLAY = _parameter("width format country height src user username uname return_url returnurl sort sort_by sortby sort_direction sort_key order_by orderby sortorder collate")
_MEMBER = _parameter("user usr user_id userid memberid")


@dataclass(frozen=True)
class Parts:
    protocol: str
    host: str
    port: int
    path: str
    query: str | None
    ref: str | None


def split_url(url: str) -> Parts | None:
    """Parts of an absolute URL, or None if its protocol or port is none that we know."""
    protocol, colon, rest = url.partition(":")
    protocol = protocol.lower()
    if not colon or protocol not in _KNOWN:
        return None
    rest, has_ref, ref = rest.partition("#")
    rest, has_query, query = rest.partition("?")
    host, port, path = "", -1, rest
    if rest.startswith("//"):
        authority, slash, path = rest[2:].partition("/")
        path = slash + path
        authority = authority.rpartition("@")[2]
        tail = authority.rpartition("]")
        host, has_port, digits = tail[2].partition(":")
        host = tail[0] + tail[1] + host
        if has_port and digits:
            if not re.fullmatch(r"[+-]?[0-9]+", digits) or int(digits) < -1:
                return None
            port = int(digits)
    return Parts(protocol, host, port, path, query if has_query else None, ref if has_ref else None)


def decode(text: str) -> str:
    """Percent-decoded UTF-8; a percent sign that begins no escape stands for itself."""
    return unquote_plus(_STRAY_PERCENT.sub("%25", text), errors="replace")


def encode(text: str, reserved: frozenset[str]) -> str:
    """Escapes, in lower-case hex, what is neither plain ASCII nor allowed here; a space is a plus sign."""
    if all(c in _PLAIN and c not in reserved for c in text):
        return text
    out = []
    for c in text:
        if c == " ":
            out.append("+")
        elif c in _PLAIN and c not in reserved:
            out.append(c)
        else:
            out.append("".join(f"%{b:02x}" for b in c.encode("utf-8", "surrogatepass")))
    return "".join(out)


def normal_path(path: str) -> str:
    while m := _UP.search(path):
        path = f"{path[: m.start()]}/{path[m.end() :]}"
    if m := _DEFAULT_PAGE.search(path):
        path = f"{path[: m.start()]}/{m[1]}{path[m.end() :]}"
    kept = "".join("/" + encode(decode(p), _IN_PATH) for p in path.split("/") if p)
    if not kept:
        return "/"
    return kept + "/" if path.endswith("/") else kept


def normal_query(query: str | None) -> str:
    return "&".join("=".join(encode(decode(v), _IN_QUERY) for v in part.split("=")) for part in (query or "").split("&") if part)


def normalize(url: str, aggressive: bool = False, ref_as_query: bool = False) -> str:
    """The normal form of a URL; what isn't http or https comes back trimmed and without session parameters."""
    url = url.strip(_TRIMMED)
    if "://" not in url:
        url = "http://" + url
    url = _MATRIX_SESSION.sub(lambda m: m[1], url, count=1)
    for pattern in (_SESSION, _DISPLAY, *([_MEMBER] if aggressive else [])):
        url = pattern.sub(lambda m: m[1] + m[2], url, count=1)
    parts = split_url(url.replace("+", "%20"))
    if parts is None or parts.protocol not in ("http", "https"):
        return url
    host = parts.host.lower()
    host = host[:-1] if host.endswith(".") else host
    port = "" if parts.port in (-1, _PORTS[parts.protocol]) else f":{parts.port}"
    out = f"{parts.protocol}://{host}{port}{normal_path(parts.path)}"
    if ref_as_query and parts.ref is not None and parts.query is None and url.partition("#")[0].endswith("/"):
        return f"{out}#{normal_query(parts.ref)}"
    query = normal_query(parts.query)
    return f"{out}?{query}" if query else out


#: URLs that normalize() leaves as they are: lower-case host, no port, unreserved characters, no query; default pages are told by _DEFAULT.
_CLEAN = r"^https?://(?:[a-z0-9-]+\.)*[a-z0-9-]+/(?:[A-Za-z0-9_~-]+(?:\.[A-Za-z0-9_~-]+)*/)*(?:[A-Za-z0-9_~-]+(?:\.[A-Za-z0-9_~-]+)*)?$"
_DEFAULT = r"/(?i:index|default)\."


def normalized(url: Column, aggressive: bool = False, ref_as_query: bool = False) -> Column:
    """normalize() of a column; URLs that are plainly normal never leave the JVM. A null stays null."""

    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        out = []
        for u in urls:
            if u is None:
                out.append(None)
            else:
                if u not in known:
                    known[u] = normalize(u, aggressive, ref_as_query)
                out.append(known[u])
        return pd.Series(out, dtype=object)

    clean = url.rlike(_CLEAN) & ~url.rlike(_DEFAULT)
    return F.when(clean, url).otherwise(run(F.when(~clean, url)))


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_HOST = rf"(?:(?:{_LABEL}\.)*[A-Za-z](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.?|\d{{1,3}}(?:\.\d{{1,3}}){{3}}|\[[0-9A-Fa-f:.]+\])"
_SHAPE = rf"^https?://(?:[^/?#@\[\]]*@)?{_HOST}(?::\d*)?(?:/[^?#\[\]]*)?(?:\?[^#]*)?(?:#[^#]*)?$"
#: What no URI may hold: controls, white space, marks that must be escaped, stray percent signs.
_ILLEGAL = r"[\x00-\x20\"<>\\^`{|}\x7F-\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]|%(?![0-9A-Fa-f]{2})"


def is_valid(url: Column, excluded_suffixes: tuple[str, ...] = ()) -> Column:
    """Whether a URL is http or https (in lower case), has a host and holds only characters that a URI may; not one with an excluded suffix. False for null."""
    ok = url.rlike(_SHAPE) & ~url.rlike(_ILLEGAL)
    if excluded_suffixes:
        ok = ok & ~url.rlike(rf"\.(?:{'|'.join(map(re.escape, excluded_suffixes))})$")
    return F.coalesce(ok, F.lit(False))


_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def protocol(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def port(url: Column) -> Column:
    """The port that the URL names, or -1."""
    p = F.regexp_extract(url, _SPLIT, 3)
    return F.when(p == "", F.lit(-1)).otherwise(p.try_cast("int"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def query(url: Column) -> Column:
    """The query, or null if there is no question mark."""
    return F.when(url.rlike(r"^[^#]*\?"), F.regexp_extract(url, _SPLIT, 5))


def ref(url: Column) -> Column:
    """What follows the first number sign, or null."""
    return F.when(F.instr(url, "#") > 0, F.regexp_extract(url, _SPLIT, 6))


def origin(url: Column) -> Column:
    """protocol://host and the port if it isn't the protocol's own: the key of robots rules and politeness."""
    p, n = protocol(url), port(url)
    own = (n == -1) | ((p == "http") & (n == 80)) | ((p == "https") & (n == 443))
    return F.concat(p, F.lit("://"), host(url), F.when(own, F.lit("")).otherwise(F.concat(F.lit(":"), n.cast("string"))))


def _last(labels: Column, n: int) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), F.lit(n)), ".")


def pld_of_host(name: Column, suffixes: Suffixes = BUILT_IN) -> Column:
    """Registered domain of a host: its public suffix and one label more; the host itself if it has none (addresses, unknown suffixes)."""
    name = F.lower(name)
    labels = F.split(name, r"\.")
    top, two, n = F.element_at(labels, -1), _last(labels, 2), F.size(labels)
    long = two.isin(sorted(suffixes.seconds)) | (top.isin(sorted(suffixes.wild)) & (n > 1))
    found = F.when(long & (n > 2), _last(labels, 3)).when(~long & top.isin(sorted(suffixes.tops)) & (n > 1), two)
    deepest = max((x.count(".") + 1 for x in suffixes.longer), default=2)
    for k in range(3, deepest + 1):  # a longer suffix holds before a shorter one
        last = _last(labels, k)
        hit = last.isin(sorted(x for x in suffixes.longer if not x.startswith("*."))) | F.concat(F.lit("*."), _last(labels, k - 1)).isin(sorted(suffixes.longer))
        found = F.when(hit & (n > k), _last(labels, k + 1)).when(hit & (n == k), name).otherwise(found)
    for k in sorted({x.count(".") + 1 for x in suffixes.exceptions}):
        found = F.when(_last(labels, k).isin(sorted(suffixes.exceptions)), _last(labels, k)).otherwise(found)
    return F.when(name == "", name).otherwise(F.coalesce(found, name))


def pld(url: Column, suffixes: Suffixes = BUILT_IN) -> Column:
    return pld_of_host(host(url), suffixes)


def is_within(url: Column, domain: str, suffixes: Suffixes = BUILT_IN) -> Column:
    """Whether a URL is valid and its host, or a domain above it down to the registered one, is `domain`."""
    name, wanted = F.lower(host(url)), domain.lower()
    within = (name == wanted) | (name.endswith("." + wanted) & (F.length(pld_of_host(name, suffixes)) <= len(wanted)))
    return is_valid(url) & F.coalesce(within, F.lit(False))


def archive_key(url: Column) -> Column:
    """Key of a URL in the index of a crawl archive: reversed host, port, `)`, lower-case path without its last slash, sorted lower-case query, ref."""
    labels = F.split(host(url), r"\.")
    labels = F.when(F.element_at(labels, 1).startswith("www"), F.slice(labels, F.lit(2), F.size(labels))).otherwise(labels)
    p, q, r, n = path(url), query(url), ref(url), port(url)
    return F.concat(
        F.array_join(F.reverse(labels), ","),
        F.when(n == -1, F.lit("")).otherwise(F.concat(F.lit(":"), n.cast("string"))),
        F.lit(")"),
        F.when(F.length(p) <= 1, F.lit("/")).otherwise(F.regexp_replace(F.lower(p), "/$", "")),
        F.when(q.isNull(), F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(F.lower(q), "&")), "&"))),
        F.when(r.isNull(), F.lit("")).otherwise(F.concat(F.lit("#"), r)),
    )


def resolved(link: Column, base: Column) -> Column:
    """A link's absolute form on the page `base`, in the JVM: absolute, scheme-relative, root-relative, query, fragment and relative links.

    Dots in paths are left for the normaliser.
    """
    link = F.trim(link)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    bare = F.when(page == root, F.concat(page, F.lit("/"))).otherwise(page)
    folder = F.regexp_extract(bare, r"^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .when(link.startswith("?"), F.concat(bare, link))
        .otherwise(F.concat(folder, link))
    )
