"""Column functions over URLs: parts, admission, keys, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the admission rules.
PRIVATE_SUFFIXES = ["local", "internal", "localhost", "home", "lan", "test", "invalid", "example"]
SECRET_NAMES = [
    "token", "access_token", "api_key", "key", "auth", "authorization", "signature", "sig", "expires", "credential", "password",
    "client_secret", "secret", "session", "session_id", "jwt", "bearer", "id_token", "refresh_token",
]
SECRET_SEGMENTS = ["token", "key", "auth", "authorization", "signature", "sig", "expires", "credential", "password", "secret", "session", "jwt", "bearer"]
SECOND_LEVEL = ["co.uk", "com.au", "com.br", "com.cn", "com.mx", "co.jp", "co.nz", "co.za"]
TRACKING = r"(?i)^(utm_[^=]*|gclid|fbclid)(=|$)"
MAX_HOST, MAX_LABEL, DECODES = 253, 63, 4

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _URL, n)


def authority(url: Column) -> Column:
    return part(url, 2)


def host(url: Column) -> Column:
    """Lower-case host without user, port and one final dot."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")
    return F.lower(F.regexp_replace(bare, r"\.$", ""))


def path(url: Column) -> Column:
    return F.when(part(url, 3) == "", "/").otherwise(part(url, 3))


def parameters(url: Column) -> Column:
    """Query parameters as name=value strings, in order; empty pieces are dropped."""
    q = F.regexp_replace(part(url, 4), r"^\?", "")
    return F.filter(F.split(q, "&"), lambda x: x != "")


def kept_parameters(url: Column) -> Column:
    return F.filter(parameters(url), lambda x: ~x.rlike(TRACKING))


def refusal(url: Column) -> Column:
    """First reason not to read a URL; null if it is admitted. A null URL is malformed."""
    h, labels = host(url), F.split(host(url), r"\.")
    port = F.regexp_extract(authority(url), ":([0-9]*)$", 1)
    top = F.element_at(labels, -1)
    bad_label = F.exists(labels, lambda x: ~x.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$") | (F.length(x) > MAX_LABEL))
    return (
        F.when(url.contains("\\"), "backslash")
        .when(url.isNull() | ~url.rlike(_URL) | (authority(url) == ""), "malformed")
        .when(F.lower(part(url, 1)) != "https", "not_https")
        .when(authority(url).contains("@"), "credentials")
        .when(~port.isin("", "443"), "port")
        .when(h.rlike(r"^[0-9]+(\.[0-9]+){3}$") | h.startswith("["), "ip_literal")
        .when((h == "localhost") | ~h.contains("."), "not_public")
        .when(top.isin(PRIVATE_SUFFIXES), "private_suffix")
        .when(F.length(h) > MAX_HOST, "host_too_long")
        .when(bad_label, "host_malformed")
        .when(~top.rlike("^([a-z]{2,}|xn--[a-z0-9-]{2,})$"), "suffix_malformed")
    )


def safe_href(url: Column) -> Column:
    """The URL that is read: no port, fragment or tracking parameters; others keep their order."""
    kept = kept_parameters(url)
    query = F.when(F.size(parameters(url)) == F.size(kept), part(url, 4)).when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), path(url), F.when(query == "?", "").otherwise(query))


def attributable_key(url: Column) -> Column:
    """safe_href with sorted parameters and no final slash: binds citations."""
    kept = F.array_sort(kept_parameters(url))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    trimmed = F.when(path(url) == "/", "/").otherwise(F.regexp_replace(path(url), "/+$", ""))
    return F.when(refusal(url).isNull(), F.concat(F.lit("https://"), host(url), trimmed, query))


def canonical_page(url: Column) -> Column:
    """Page identity for diversity: fragment, tracking and final slashes dropped; what is no URL stays as it is."""
    kept = kept_parameters(url)
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    trimmed = F.when(path(url) == "/", "/").otherwise(F.regexp_replace(path(url), "/+$", ""))
    page = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(authority(url)), trimmed, query)
    return F.when(url.rlike(_URL), page).otherwise(url)


def conflict_page_key(url: Column) -> Column:
    """Page identity for conflicts: https only, no query at all."""
    ok = url.rlike(_URL) & (F.lower(part(url, 1)) == "https")
    return F.when(ok, F.concat(F.lit("https://"), host(url), path(url)))


def publisher_domain(url: Column) -> Column:
    """Last two labels of the host, three under a common second-level suffix; null if it is no URL."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(url.rlike(_URL) & (h != ""), F.when(F.size(labels) <= 2, h).when(last(2).isin(SECOND_LEVEL), last(3)).otherwise(last(2)))


def url_text(url: Column) -> Column:
    """Host and path, percent-decoded, with spaces for hyphens, underscores and dots; slashes part what belongs to different names."""
    raw = F.concat(host(url), F.lit(" "), path(url))
    return F.regexp_replace(F.coalesce(F.try_url_decode(raw), raw), "[-_.]+", " ")


def url_words(url: Column) -> Column:
    """Host and path, percent-decoded, as words."""
    return F.trim(F.regexp_replace(url_text(url), r"[/\s]+", " "))


def secret_name(name: Column) -> Column:
    """True if a query name is empty, not printable ASCII, still encoded after DECODES decodes, or tells of a secret."""

    def forms(n: Column) -> Column:
        parted = F.regexp_replace(F.regexp_replace(n, "([A-Z])([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
        lower = F.lower(F.regexp_replace(parted, "[ _.-]+", "_"))
        segmented = F.regexp_replace(F.regexp_replace(lower, "[^a-z0-9]+", "_"), "^_+|_+$", "")
        compact = F.regexp_replace(lower, "[^a-z0-9]+", "")
        return (
            n.rlike("[^\\x20-\\x7e]") | (compact == "") | segmented.isin(SECRET_NAMES) | compact.isin([x.replace("_", "") for x in SECRET_NAMES])
            | F.arrays_overlap(F.split(segmented, "_"), F.array(*map(F.lit, SECRET_SEGMENTS)))
        )

    bad, current = forms(name), name
    for _ in range(DECODES):
        decoded = F.try_url_decode(F.replace(current, F.lit("+"), F.lit("%2B")))
        more = current.contains("%")
        bad = bad | (more & (decoded.isNull() | (decoded == current))) | F.when(more, F.coalesce(forms(decoded), F.lit(True))).otherwise(False)
        current = F.when(more, decoded).otherwise(current)
    return F.coalesce(bad | current.contains("%"), F.lit(True))
