"""Web addresses: hosts, canonical forms, public and official addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bound

# Query parameters that say nothing about the page, and paths of archived pages.
TRACKING = r"^(utm_.*|fbclid|gclid|mc_.*)$"
OLD_PATH = r"(?i)/(archive|archived|old|former|alumni)(/|$)"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/@]*@)?([^/:?#]+)", 1)), r"\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"(?i)^https?://[^/?#]+([^?#]*)", 1)


def parameters(url: Column) -> Column:
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.filter(F.split(q, "&"), lambda x: x != "")


def host_root(url: Column) -> Column:
    """The last two labels of the host."""
    labels = F.split(host(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def within(h: Column, domain: Column) -> Column:
    """The domain itself or a host below it."""
    return (h == domain) | h.endswith(F.concat(F.lit("."), domain))


def canonical(url: Column) -> Column:
    """https, no www, single slashes, no slash at the end, no tracking, sorted parameters, no fragment; '' for archives
    and for what is no web address."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    p = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "/$", "")
    keep = F.sort_array(F.filter(parameters(url), lambda x: ~F.lower(F.substring_index(x, "=", 1)).rlike(TRACKING)))
    out = F.concat(F.lit("https://"), h, p, F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise(""))
    return F.when((h == "") | p.rlike(OLD_PATH), "").otherwise(out)


def public(url: Column) -> Column:
    """An http(s) address whose host is neither local nor a private network's."""
    h = host(url)
    local = (h == "localhost") | h.endswith(".local") | h.endswith(".localhost") | h.endswith(".internal")
    private = h.rlike(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    return (h != "") & h.contains(".") & ~local & ~private


def same_document(a: Column, b: Column) -> Column:
    """Host and path agree, whatever the query and fragment."""
    clean = lambda u: F.regexp_replace(path(u), "/$", "")
    return (host(a) == host(b)) & (clean(a) == clean(b))


def addresses(text: Column, most: int = 20) -> Column:
    """Distinct addresses that a text mentions, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s\x22'<>)\]]+"), F.lit(0))), 1, most)


def source_url(url: Column) -> Column:
    """The address without its fragment, scheme and host in lower case; a leading www. stays. Null for other schemes."""
    u = F.trim(url)
    head = F.regexp_extract(u, r"(?i)^(https?://[^/?#]+)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.regexp_extract(u, r"(?i)^https?://[^/?#]+([^#]*)", 1)))


# Hosts and paths that gather or report, paths of directories and of what only looks like one, mail hosts
# of the public, campuses abroad, kinds of sources that only show where a work was found.
GATHERERS = ("academia.edu", "amacad.org", "biopharmadive.com", "cell.com", "coursicle.com", "indeed.com", "linkedin.com", "phdportal.com", "quora.com", "researchgate.net", "scispace.com", "scite.ai", "zoominfo.com", "googleadservices.com", "googlesyndication.com", "doubleclick.net")
REPORTS = r"(?i)/(?:aclick|pagead|news|events?|articles?|publications?|papers?|doi|jobs?-search|directory-entry)(?:/|$)"
DIRECTORY = r"(?i)(?:^|[/_-])(?:faculty|people|directory|faculty-and-staff|our-faculty)(?:[/_.-]|$)"
NO_DIRECTORY = r"(?i)/(?:news|stories?|events?|awards?|honors?|alumni|archive|media-experts?|research|publications?|jobs?|core-facilities)(?:/|$)|(?=[fdu])(?:faculty[-_]?led[-_]?programs?|disability[-_]?support|faculty[-_]?staff[-_]?associations?|united[-_]?way[-_]?campaign|faculty[-_]?resources?)"
PUBLIC_MAIL = ("gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "icloud.com", "proton.me", "protonmail.com")
ABROAD = r"(?i)^https?://([a-z0-9-]+\.)*(rit\.edu/(dubai|croatia)(/|$)|nyuad\.nyu\.edu/|shanghai\.nyu\.edu/|qatar\.cmu\.edu/|qatar-weill\.cornell\.edu/)"
PROVENANCE = ("GOOGLE_SCHOLAR", "OFFICIAL_PROFILE", "OFFICIAL_ALTERNATE_PROFILE", "PERSONAL_SITE", "LAB_SITE", "INSTITUTIONAL_RESEARCH_PORTAL")
SCHOLAR_HOST = r"^scholar\.google\.(com|co\.uk|com\.tr|de|fr|ca|com\.au|co\.in|co\.jp|com\.br|es|it|nl|ch|se|no|dk|fi|at|be|pl|pt|co\.nz|co\.za|com\.mx|com\.sg|com\.hk|com\.tw|co\.kr|co\.id)$"


def clickable(url: Column) -> Column:
    """An address that a page may show as a link: public and without a user's name in it."""
    return F.coalesce(public(url) & ~F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1).contains("@"), F.lit(False))


def _bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def may_recruit(url: Column) -> Column:
    """A hit that may be a recruiting page: neither a gatherer's nor a report."""
    h = F.coalesce(_bare_host(url), F.lit(""))
    return (h != "") & ~F.exists(F.array(*map(F.lit, GATHERERS)), lambda d: within(h, d)) & ~F.coalesce(path(url), F.lit("")).rlike(REPORTS)


def directory_candidate(url: Column, domain: Column) -> Column:
    """The address without parameters if it may be a directory on the domain, else ''."""
    held = bound(path(url), lambda p: p.rlike(DIRECTORY) & ~p.rlike(NO_DIRECTORY)) & (domain != "")
    ok = held & bound(_bare_host(url), lambda h: within(h, F.regexp_replace(F.lower(domain), r"^www\.", "")))
    return F.when(F.coalesce(ok, F.lit(False)), F.rtrim(F.substring_index(F.substring_index(F.trim(url), "?", 1), "#", 1), F.lit("/"))).otherwise("")


def academic_domain(domain: Column, known: Column | None = None) -> Column:
    """The domain if it's an academic one, by its ending or because it's ``known``; else ''."""
    d = F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), r"\.+$", "")
    good = d.endswith(".edu") | d.rlike(r"\.(?:ac|edu)\.[a-z]{2}$") | (F.lit(False) if known is None else known)
    return F.when(d.rlike(r"^[a-z0-9-]+(?:\.[a-z0-9-]+)+$") & ~d.isin(*PUBLIC_MAIL) & good, d).otherwise("")


def abroad(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(ABROAD)


def scholar_user(url: Column) -> Column:
    """The user of a scholar profile's address; null for other addresses."""
    user = F.regexp_extract(url, r"[?&]user=([^&#]+)", 1)
    return F.when(host(url).rlike(SCHOLAR_HOST) & (F.regexp_replace(path(url), "/+$", "") == "/citations") & (user != ""), user)


def metadata_url(doi: Column, kind: Column, url: Column) -> Column:
    """Where a work's own metadata are: its DOI, else its source unless that only shows where the work was found."""
    d, u = F.trim(F.coalesce(doi, F.lit(""))), F.trim(F.coalesce(url, F.lit("")))
    found_at = F.upper(F.trim(F.coalesce(kind, F.lit("")))).isin(*PROVENANCE) | host(u).contains("scholar.google.")
    return F.when(d != "", F.concat(F.lit("https://doi.org/"), F.regexp_replace(d, r"(?i)^https?://(?:dx\.)?doi\.org/", ""))).when(found_at, "").otherwise(u)
