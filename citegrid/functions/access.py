"""Column functions over URLs, hosts and fetch results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, strip

#: Hosts that only lead on to a document.
DOI_HOSTS = ("doi.org", "dx.doi.org")


def host_of(url: Column) -> Column:
    """Lower-case host; a URL that cannot be parsed has the empty one."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def host_in(host: Column, hosts: Sequence[str]) -> Column:
    """Whether host is one of hosts or below one."""
    tests = [(host == h) | F.endswith(host, F.lit("." + h)) for h in hosts]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def host_class(host: Column, publishers: Sequence[str], indexes: Sequence[str]) -> Column:
    return F.when(host_in(host, indexes), "index").when(host_in(host, publishers), "publisher").when(host.isin(*DOI_HOSTS), "doi").otherwise("other")


def url_tier(url: Column, publishers: Sequence[str], indexes: Sequence[str]) -> Column:
    kind = host_class(host_of(url), publishers, indexes)
    return F.when(kind == "index", 3).when(kind == "publisher", 2).otherwise(1)


def is_https_shaped(url: Column) -> Column:
    """https, with a host and without user or password."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return F.coalesce((F.lower(part("PROTOCOL")) == "https") & (F.coalesce(part("HOST"), F.lit("")) != "") & part("USERINFO").isNull(), F.lit(False))


def preprint_pdf_url(arxiv_id: Column, stable_id: Column) -> Column:
    own = F.when(F.coalesce(arxiv_id, F.lit("")) != "", arxiv_id).when(F.startswith(stable_id, F.lit("arxiv:")), F.substring(stable_id, 7, 1 << 20))
    last = F.substring_index(F.regexp_replace(F.trim(own), "/+$", ""), "/", -1)
    return F.when(F.coalesce(own, F.lit("")) != "", F.concat(F.lit("https://arxiv.org/pdf/"), last))


#: The parts of a reference: scheme, authority, path, query, fragment (RFC 3986, appendix B).
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//[^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_parts(url: Column) -> Column:
    """struct(scheme, authority with its slashes, path, query, fragment) of a URL or reference; empty where a part is not there."""
    part = lambda i: F.regexp_extract(url, f"(?s){URL_PARTS}", i)
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("authority"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))


def url_text(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    marked = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    head = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    rooted = F.when((authority != "") & (path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(head, authority, rooted, marked("?", query), marked("#", fragment))


def without_dots(segments: Column) -> Column:
    """The path of segments, with `.` and `..` taken away."""
    none = F.array().cast("array<string>")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.array_append(kept, s))
    folder = F.when(F.try_element_at(segments, F.lit(-1)).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.coalesce(F.nullif(F.array_join(F.concat(F.aggregate(segments, none, step), folder), "/"), F.lit("")), F.lit("/"))


def resolve_url(base: Column, ref: Column) -> Column:
    """ref as it reads on the page at base: absolute, with another host, rooted, relative, of the query only or empty (RFC 3986).

    User, password and port stay, dot segments go, empty segments within a relative reference's path too. A reference of
    another scheme stays as it is.
    """

    def resolved(x: Column) -> Column:
        b, r = x["base"], x["ref"]
        folder = bind(F.split(b["path"], "/", -1), lambda s: F.when(F.try_element_at(s, F.lit(-1)) == "", s).otherwise(F.slice(s, 1, F.size(s) - 1)))
        below = bind(F.concat(folder, F.split(r["path"], "/", -1)), lambda s: F.when(F.size(s) < 3, s).otherwise(F.concat(F.slice(s, 1, 1), F.filter(F.slice(s, 2, F.size(s) - 2), lambda i: i != ""), F.slice(s, -1, 1))))
        segments = F.when(F.startswith(r["path"], F.lit("/")), F.split(r["path"], "/", -1)).otherwise(below)
        query = F.when((r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        path = F.when(r["path"] == "", b["path"]).otherwise(bind(segments, without_dots))
        return (
            F.when(x["text"] == "", x["whole"]).when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), x["text"])
            .when(r["authority"] != "", url_text(b["scheme"], r["authority"], r["path"], r["query"], r["fragment"]))
            .otherwise(url_text(b["scheme"], b["authority"], path, query, r["fragment"]))
        )

    return F.when(base.isNotNull() & ref.isNotNull(), bind(F.struct(url_parts(base).alias("base"), url_parts(ref).alias("ref"), base.alias("whole"), ref.alias("text")), resolved))


#: How a landing page names its file, and how failures are told apart by their text.
META_LINK = r'(?i)citation_pdf_url"\s+content="([^"]+)"'
REFRESH_LINK = r'(?i)<meta[^>]+http-equiv=["\']?refresh["\']?[^>]+content=["\']\s*\d+\s*;\s*url=([^"\'>]+)'
FAILURES = (("auth", "api_key|auth"), ("rate", "rate limit|429"), ("connect", "reach|timeout|timed out|connect|endofstream"), ("not_found", "not found|no metadata source has"))


def pdf_link_from_page(url: Column, html: Column) -> Column:
    """File URL named by a landing page: a citation meta tag, else a refresh, else the download of a figshare page.

    Links are resolved against the page; one to the page itself is passed over.
    """
    named = lambda pattern: F.nullif(resolve_url(url, F.nullif(strip(F.regexp_extract(html, pattern, 1)), F.lit(""))), url)

    def download(p: Column) -> Column:
        path = F.regexp_replace(p["path"], "/+$", "")
        none = F.lit("")
        wanted = F.endswith(host_of(url), F.lit("figshare.com")) & ~F.endswith(path, F.lit("/download")) & (path != "")
        return F.when(wanted, url_text(p["scheme"], p["authority"], F.concat(path, F.lit("/download")), none, none))

    return F.coalesce(named(META_LINK), named(REFRESH_LINK), bind(url_parts(url), download))


#: HTTP statuses by what they mean for a download.
GONE, BLOCKED, TRANSIENT = (404, 410), (403, 418), (408, 425, 429, 500, 502, 503, 504)


def fetch_outcome(status: Column, media_type: Column) -> Column:
    """transient, gone, blocked, failed, ok, challenge (a 202 that is no PDF) or landing, in that order of precedence."""
    kind = F.trim(F.substring_index(media_type, ";", 1))
    return (
        F.when(status.isin(*TRANSIENT), "transient").when(status.isin(*GONE), "gone").when(status.isin(*BLOCKED), "blocked").when(status >= 400, "failed")
        .when(kind == "application/pdf", "ok").when(status == 202, "challenge").otherwise("landing")
    )


def failure_reason(text: Column) -> Column:
    """auth, rate, connect, not_found or other, in that order of precedence."""
    low, reason = F.lower(F.coalesce(text, F.lit(""))), F.lit("other")
    for name, pattern in reversed(FAILURES):
        reason = F.when(low.rlike(pattern), name).otherwise(reason)
    return reason
