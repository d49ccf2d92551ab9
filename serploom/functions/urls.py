"""URL repair, canonical form and domain rules, all as native column expressions.

Functions named ``with_*`` take a DataFrame because they share intermediate columns between steps:
each step is its own projection, so nothing is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom import dims
from serploom.functions import punycode

_UNRESERVED_ESCAPE = "(?i)^%(2d|2e|3[0-9]|4[1-9a-f]|5[0-9a]|5f|6[1-9a-f]|7[0-9a]|7e)$"


def repair_url(raw: Column) -> Column:
    """A usable http(s) URL from a sloppy one, or NULL."""
    # nearly every landed URL is already in order: one anchored match and nothing else
    tidy = raw.rlike("^https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][\\x21-\\x7E]*)?$")
    # a chain in which every step mentions the one before it once
    text = F.regexp_replace(trim_ws(raw), r"[\x00-\x1F\x7F]", "")
    full = F.regexp_replace(F.regexp_replace(text, "^//", "https://"), "(?s)^(?!.*://)(?=.)", "https://")
    # host not empty, no credentials, no characters a host cannot hold, port in digits
    usable = (
        r"(?s)^((?i:https?)://(?:\[[0-9A-Fa-f:.]+\]|[^/?#@:\s<>\"\\^`{|}\[\]]+)(?::[0-9]*)?"
        r"(?:[/?#].*)?)$"
    )
    fixed = bind(F.regexp_extract(full, usable, 1), lambda u: F.when(u != "", u))
    return F.when(tidy, raw).otherwise(fixed)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it.

    Predicates pushed through a projection are inlined by the optimizer; a lambda variable keeps the
    inlined expression small.
    """
    return F.transform(F.array(value), body)[0]


# The characters Unicode counts as white space.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_ws(raw: Column) -> Column:
    return F.btrim(raw, F.lit(WHITE_SPACE))


_TRACKING_PAIR = (
    "(?i)(?<=^|&)(?:" + "|".join(dims.TRACKING_PARAMETERS) + ")(?:=[^&]*)?(?=&|$)"
)


def strip_tracking(query: Column) -> Column:
    """The query string without tracking parameters; order and spelling of the rest are kept.

    Parameter names are compared decoded; only a query with escapes pays for that.
    """

    def keep(pair: Column) -> Column:
        name = F.substring_index(pair, "=", 1)
        # a plus sign is an ordinary character in a parameter name here
        decoded = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
        return (pair != "") & ~F.lower(decoded).isin(*dims.TRACKING_PARAMETERS)

    plain = F.regexp_replace(query, _TRACKING_PAIR, "")
    return (
        F.when(query.contains("%"), F.array_join(F.filter(F.split(query, "&"), keep), "&"))
        .when(
            query.contains("&"),
            F.trim(F.regexp_replace(plain, "&{2,}", "&"), F.lit("&")),
        )
        .otherwise(plain)
    )


def normalize_escapes(path: Column) -> Column:
    """Escapes of unreserved bytes decoded, the others in upper case, broken ones kept."""
    tokens = F.regexp_extract_all(path, F.lit("(%[0-9A-Fa-f]{2}|[^%]+|%)"), F.lit(1))

    def fix(token: Column) -> Column:
        return (
            F.when(
                token.rlike(_UNRESERVED_ESCAPE),
                F.chr(F.conv(F.substring(token, 2, 2), 16, 10).cast("bigint")),
            )
            .when(token.rlike("^%[0-9A-Fa-f]{2}$"), F.upper(token))
            .otherwise(token)
        )

    return F.when(path.contains("%"), F.array_join(F.transform(tokens, fix), "")).otherwise(path)


_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def url_scheme(url: Column) -> Column:
    """Lower-case scheme, empty when there is none."""
    return F.lower(F.regexp_extract(url, f"^({_SCHEME}):", 1))


def url_authority(url: Column) -> Column:
    return F.regexp_extract(url, f"^{_SCHEME}://([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    """Lower-case host without credentials, port and one trailing dot; empty when there is none."""
    pattern = rf"^{_SCHEME}://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
    return F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 1)), r"(?<=.)\.$", "")


def url_port(url: Column) -> Column:
    return F.regexp_extract(url, f"^{_SCHEME}://[^/?#]*:([0-9]*)(?:[/?#]|$)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, f"^{_SCHEME}://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    """Query string without the question mark, NULL when there is none."""
    return F.when(url.rlike(r"^[^?#]*\?"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))


def with_canonical_url(
    df: DataFrame, url: str, out: str = "canonical_url", host_out: str | None = None, ascii_hosts: bool = False
) -> DataFrame:
    """Adds the canonical spelling of an http(s) URL (others stay as they are) and, if asked, its host.

    The parts are staged in projections of their own: each is used several times, so the optimizer
    leaves the stages apart and every string function runs once per row in generated code. Regular
    expressions and lambdas run only on URLs that have something to rewrite. With ``ascii_hosts`` a host outside
    ASCII gets its ASCII spelling, so both spellings of one host have one key; its expression is large, and filters and joins
    on the result copy it, so plans that filter on the host a lot are better off without.
    """
    c = F.col
    is_web = (
        c(url).startswith("https://")
        | c(url).startswith("http://")
        | c(url).rlike("^(?i:https?)://")
    )
    df = df.withColumn("_bare", F.when(is_web, F.substring_index(c(url), "#", 1)))
    df = df.withColumn("_rest", F.expr("substr(_bare, instr(_bare, '://') + 3)"))
    df = df.withColumn(
        "_authority", F.substring_index(F.substring_index(c("_rest"), "/", 1), "?", 1)
    )
    df = df.withColumns(
        {
            "_site": F.lower(
                F.concat(
                    F.substring_index(c("_bare"), ":", 1),
                    F.lit("://"),
                    F.substring_index(c("_authority"), "@", -1),
                )
            ),
            "_tail": F.expr("substr(_rest, length(_authority) + 1)"),
        }
    )
    df = df.withColumns(
        {
            "_site": _canonical_site(c("_site")),
            "_path": F.substring_index(c("_tail"), "?", 1),
            "_query": F.expr(
                "case when contains(_tail, '?') then substr(_tail, instr(_tail, '?') + 1) end"
            ),
        }
    )
    df = df.withColumns(
        {"_path": _canonical_path(c("_path")), "_kept": strip_tracking(c("_query"))}
    )
    query = (
        F.when(c("_query") == "", F.lit("?"))
        .when(c("_kept") != "", F.concat(F.lit("?"), c("_kept")))
        .otherwise(F.lit(""))
    )
    added = {out: F.coalesce(F.concat("_site", "_path", query), c(url))}
    if host_out:
        host = F.expr("substr(_site, instr(_site, '://') + 3)")
        added[host_out] = F.when(
            c("_site").rlike(":[0-9]*$"), F.regexp_replace(host, ":[0-9]*$", "")
        ).otherwise(host)
    df = df.withColumns(added).drop(
        "_bare", "_rest", "_authority", "_site", "_tail", "_path", "_query", "_kept"
    )
    if not ascii_hosts:
        return df
    spelled = {out: ascii_url(c(out))}
    if host_out:
        spelled[host_out] = ascii_host(c(host_out))
    return df.withColumns(spelled)


def canonical_host(url: Column) -> Column:
    """The host of a canonical web URL, as ``with_canonical_url`` gives it."""
    site = F.substring_index(F.substring_index(url, "/", 3), "://", -1)
    return F.when(site.rlike(":[0-9]*$"), F.regexp_replace(site, ":[0-9]*$", "")).otherwise(site)


def ascii_url(url: Column) -> Column:
    """A canonical web URL with its host in the ASCII spelling; others stay."""

    def spelled(x: Column) -> Column:
        host = F.regexp_extract(x, "^https?://([^:/?]*)", 1)
        tail = F.regexp_extract(x, "(?s)^https?://[^:/?]*(.*)$", 1)
        return F.concat(F.substring_index(x, "://", 1), F.lit("://"), punycode.ascii_labels(host), tail)

    foreign = punycode.is_foreign(url) & url.rlike(r"^https?://[^:/?]*[^\x00-\x7F]")
    return F.when(foreign, bind(url, spelled)).otherwise(url)


def _canonical_site(site: Column) -> Column:
    """Scheme and host without the default port or an empty one, and without one trailing dot."""

    def cut(n: int) -> Column:
        return F.substring(site, F.lit(1), F.length(site) - n)

    secure = site.startswith("https:")
    return (
        F.when(
            site.endswith(".") | site.contains(".:") | site.contains(":0"),
            F.regexp_replace(
                F.regexp_replace(
                    site, "^(https://.*):0*443$|^(http://.*):0*80$|^(.*):$", "$1$2$3"
                ),
                r"(?<=[^/])\.(:[0-9]+)?$",
                "$1",
            ),
        )
        .when(secure & site.endswith(":443"), cut(4))
        .when(~secure & site.endswith(":80"), cut(3))
        .when(site.endswith(":"), cut(1))
        .otherwise(site)
    )


def _canonical_path(path: Column) -> Column:
    return (
        F.when(path == "", F.lit("/"))
        .when(path.contains("%"), F.regexp_replace(normalize_escapes(path), "(?<=.)/$", ""))
        .when((path != "/") & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1))
        .otherwise(path)
    )


def ascii_host(host: Column) -> Column:
    """The ASCII spelling of a lower-case host; hosts in ASCII stay as they are."""
    return F.when(punycode.is_foreign(host), punycode.ascii_labels(host)).otherwise(host)


def normalize_domain(raw: Column) -> Column:
    """Bare registered form of a domain as a person would type it."""
    plain = (
        (raw == F.lower(raw))
        & ~raw.contains("/") & ~raw.contains("*") & ~raw.contains(" ") & ~raw.contains("www.")
        & ~raw.startswith(".") & ~raw.endswith(".")
        & (raw == trim_ws(raw))
    )
    bare = F.regexp_replace(
        F.lower(trim_ws(raw)),
        r"^(?:(?:\*\.)?\.?)(?:[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+).*|(.*?)\.?)$",
        "$1$2",
    )
    return F.when(plain, raw).otherwise(F.regexp_replace(bare, r"^www\.", ""))


def host_matches(host: Column, domain: Column) -> Column:
    """True when ``host`` is the domain or below it; an empty domain matches nothing."""
    h = F.lower(host)
    return bind(
        normalize_domain(domain),
        lambda d: (d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d))),
    )


def domain_filter(
    host: Column, include: Column | Sequence[str], exclude: Column | Sequence[str]
) -> Column:
    """Exclusions first; then, when there are inclusions, one of them has to match.

    The rules are array columns or plain lists; a list is folded into generated code.
    """

    def matched(rules, h: Column) -> Column:
        if isinstance(rules, Column):
            return F.coalesce(F.exists(rules, lambda d: host_matches(h, d)), F.lit(False))
        hit = F.lit(False)
        for rule in rules:
            d = normalize_domain(F.lit(rule))
            hit = hit | ((d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d))))
        return hit

    def rules(h: Column) -> Column:
        if isinstance(include, Column):
            unlimited = F.coalesce(F.size(include), F.lit(0)) <= 0
        else:
            unlimited = F.lit(not include)
        return ~matched(exclude, h) & (unlimited | matched(include, h))

    listed = not isinstance(include, Column) and not isinstance(exclude, Column)
    return rules(host) if listed else bind(host, rules)


def absolute_url(href: Column, base: str | Column = "https://duckduckgo.com") -> Column:
    start = base if isinstance(base, Column) else F.lit(base)
    return bind(
        href,
        lambda h: F.when(h.startswith("//"), F.concat(F.lit("https:"), h))
        .when(h.startswith("/"), F.concat(start, h))
        .otherwise(h),
    )


def unwrap_redirect(href: Column) -> Column:
    """The target carried by a redirect link: first of uddg, url, u, q that starts with http."""

    def parameter(link: Column, name: str) -> Column:
        raw = F.regexp_extract(link, rf"[?&]{name}=([^&#]*)", 1)
        # a plus sign is not a space in a decoded query item
        return bind(
            F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))),
            lambda value: F.when(F.lower(value).startswith("http"), value),
        )

    def target(link: Column) -> Column:
        marked = link.contains("uddg=") | link.contains("/l/?") | link.contains("redirect")
        names = ("uddg", "url", "u", "q")
        return F.when(
            marked, F.coalesce(*[parameter(link, n) for n in names], link)
        ).otherwise(link)

    return bind(href, target)


def credential_in_url(url: Column) -> Column:
    """Which part of the URL carries a credential, or NULL."""
    user = F.regexp_extract(url, r"^[^:/?#]+://([^/?#@:]+)(?::[^/?#@]*)?@", 1)
    names = F.array(*[F.lit(p) for p in dims.CREDENTIAL_PARAMETERS])
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parameters = F.transform(F.split(query, "&"), lambda pair: F.substring_index(pair, "=", 1))
    hit = F.try_element_at(
        F.filter(parameters, lambda n: F.array_contains(names, F.lower(F.coalesce(F.try_url_decode(n), n)))), F.lit(1)
    )
    return F.when(user != "", F.lit("userinfo")).when(
        hit.isNotNull(), F.concat(F.lit("the "), hit, F.lit(" parameter"))
    )


def drop_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def comparable_url(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), "/+$", "")
