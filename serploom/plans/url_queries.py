"""Registered queries over URLs and hosts, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from serploom import dims
from serploom.functions import hosts, urls
from serploom.operators.results import filter_domains_at_scale
from serploom.plans.views import sql, view
from serploom.session import load

QUERIES = {}
ORACLE = {}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- shared SQL for the canonical form ------------------------------------------------------------
def canonical_sql(source: str, url: str, keep: str) -> str:
    """SQL twin of ``with_canonical_url`` as a derived table with ``canonical_url`` and ``host``."""
    return f"""
    (select {keep}, host,
            case when scheme in ('http', 'https') and rest is not null then
              scheme || '://' || host
              || case when coalesce(port, '') = '' or try_cast(port as int) = case scheme when 'http' then 80 else 443 end
                      then '' else ':' || port end
              || case when length(npath) > 1 and npath like '%/' then substr(npath, 1, length(npath) - 1) else npath end
              || case when query = '' then '?' when coalesce(kept, '') = '' then '' else '?' || kept end
            else {url} end as canonical_url
     from (
      select *,
        case when path = '' then '/' when contains(path, '%') then
          array_to_string(list_transform(regexp_extract_all(path, '(%[0-9A-Fa-f]{{2}}|[^%]+|%)'), lambda t:
            case when regexp_matches(t, '(?i)^%(2d|2e|3[0-9]|4[1-9a-f]|5[0-9a]|5f|6[1-9a-f]|7[0-9a]|7e)$')
                 then chr(cast('0x' || substr(t, 2, 2) as int))
                 when regexp_matches(t, '^%[0-9A-Fa-f]{{2}}$') then upper(t) else t end), '')
          else path end as npath,
        array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' and not list_contains(
          [{_quoted(dims.TRACKING_PARAMETERS)}], lower(url_decode(split_part(p, '=', 1))))), '&') as kept,
        case when length(lowhost) > 1 and lowhost like '%.' then substr(lowhost, 1, length(lowhost) - 1) else lowhost end as host
      from (
       select *, lower(regexp_replace(hostport, ':[0-9]*$', '')) as lowhost,
         case when regexp_matches(hostport, ':[0-9]*$') then regexp_extract(hostport, ':([0-9]*)$', 1) end as port,
         regexp_extract(tail, '^[^?]*') as path,
         case when contains(tail, '?') then substr(tail, instr(tail, '?') + 1) end as query
       from (
        select *, regexp_replace(regexp_extract(rest, '^[^/?]*'), '^.*@', '') as hostport,
               substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) as tail
        from (
         select *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme,
                case when contains(bare, '://') then substr(bare, length(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) + 4) end as rest
         from (select *, split_part({url}, '#', 1) as bare from {source}))))))
    """


def url_canonicalize(spark, sf_dir):
    df = view(spark, sf_dir, "url_variants")
    df = urls.with_canonical_url(df, "url", host_out="host")
    return df.select("page_id", "variant", "url", "canonical_url", "host")


QUERIES["url_canonicalize"] = url_canonicalize
ORACLE["url_canonicalize"] = sql(
    f"""select page_id, variant, url, canonical_url,
    case when regexp_matches(canonical_url, '^https?://') then host end as host
    from {canonical_sql('url_variants', 'url', 'page_id, variant, url')}""",
    "url_variants",
)


def url_duplicate_groups(spark, sf_dir):
    pages = urls.with_canonical_url(load(spark, sf_dir, "pages").select("page_id", "url"), "url", ascii_hosts=True)
    return pages.groupBy("canonical_url").agg(
        F.count("*").alias("copies"), F.min("page_id").alias("first_page")
    )


QUERIES["url_duplicate_groups"] = url_duplicate_groups
ORACLE["url_duplicate_groups"] = f"""
    select canonical_url, count(*) as copies, min(page_id) as first_page
    from {canonical_sql('pages', 'url', 'page_id')} group by canonical_url"""


def url_strip_tracking(spark, sf_dir):
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    return view(spark, sf_dir, "url_variants").select(
        "page_id", "variant",
        urls.strip_tracking(query).alias("kept_query"),
        urls.normalize_escapes(path).alias("clean_path"),
    )


QUERIES["url_strip_tracking"] = url_strip_tracking
ORACLE["url_strip_tracking"] = sql(
    rf"""select page_id, variant,
      array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' and not list_contains(
        [{_quoted(dims.TRACKING_PARAMETERS)}], lower(url_decode(split_part(p, '=', 1))))), '&') as kept_query,
      array_to_string(list_transform(regexp_extract_all(regexp_extract(url, '^[^?#]*'), '(%[0-9A-Fa-f]{{2}}|[^%]+|%)'), lambda t:
        case when regexp_matches(t, '(?i)^%(2d|2e|3[0-9]|4[1-9a-f]|5[0-9a]|5f|6[1-9a-f]|7[0-9a]|7e)$')
             then chr(cast('0x' || substr(t, 2, 2) as int))
             when regexp_matches(t, '^%[0-9A-Fa-f]{{2}}$') then upper(t) else t end), '') as clean_path
    from url_variants""",
    "url_variants",
)


def url_repair(spark, sf_dir):
    return view(spark, sf_dir, "url_variants").select(
        "page_id", "variant", urls.repair_url(F.col("url")).alias("repaired")
    )


QUERIES["url_repair"] = url_repair
ORACLE["url_repair"] = sql(
    r"""select page_id, variant,
      case when full_url <> 'https://' and regexp_matches(full_url, '^(?i:https?)://[^/?#]')
             and not contains(regexp_extract(full_url, '^[A-Za-z]+://([^/?#]*)', 1), '@') then full_url end as repaired
    from (select *, case when starts_with(t, '//') then 'https:' || t when not contains(t, '://') then 'https://' || t else t end as full_url
          from (select *, regexp_replace(trim(url), '[\x00-\x1F\x7F]', '', 'g') as t from url_variants))""",
    "url_variants",
)


def domain_rules(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", urls.url_host(F.col("url")).alias("_u_host"), "url")
    host = F.col("_u_host")
    raw = F.concat(F.lit(" *."), F.upper(host), F.lit(". "))
    include = F.array(F.lit("WWW.Example.com"), F.lit("example.net"))
    exclude = F.array(F.lit("spam-farm.example.org"), F.lit(" blog.thththth.example.net"), F.lit(""))
    return pages.select(
        "page_id",
        urls.normalize_domain(raw).alias("domain"),
        urls.normalize_domain(F.col("url")).alias("pasted_domain"),
        urls.host_matches(host, F.lit("*.example.org")).alias("in_example_org"),
        urls.domain_filter(host, include, exclude).alias("admitted"),
        urls.domain_filter(host, F.array().cast("array<string>"), exclude).alias("not_excluded"),
    )


QUERIES["domain_rules"] = domain_rules
ORACLE["domain_rules"] = """
    select page_id, regexp_replace(host, '^www\\.', '') as domain, regexp_replace(host, '^www\\.', '') as pasted_domain,
      (host = 'example.org' or host like '%.example.org') as in_example_org,
      not (host = 'spam-farm.example.org' or host like '%.spam-farm.example.org') and (host = 'example.com' or host like '%.example.com'
        or host = 'example.net' or host like '%.example.net') as admitted,
      not (host = 'spam-farm.example.org' or host like '%.spam-farm.example.org') as not_excluded
    from (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host from pages)"""


def domain_filter_join(spark, sf_dir):
    pages = urls.with_canonical_url(
        load(spark, sf_dir, "pages").select("page_id", "url"), "url", host_out="host"
    )
    results = pages.select(
        (F.col("page_id") % 7).cast("int").alias("query_id"), "page_id", "host"
    )
    rules = spark.createDataFrame(
        [
            (0, "include", "example.com"),
            (1, "exclude", "*.example.net"),
            (2, "include", "example.org"),
            (2, "exclude", "spam-farm.example.org"),
            (3, "include", "www.example.net"),
            (4, "exclude", ""),
        ],
        "query_id int, kind string, domain string",
    )
    kept = filter_domains_at_scale(results, rules)
    return kept.groupBy("query_id").agg(
        F.count("*").alias("kept"), F.sum("page_id").alias("page_sum")
    )


QUERIES["domain_filter_join"] = domain_filter_join


def domain_block_list(spark, sf_dir):
    """Block and allow lists with a domain for every part and query, most of them for other hosts."""
    found = urls.with_canonical_url(load(spark, sf_dir, "pages").select("page_id", "url"), "url", host_out="host")
    each = F.explode(F.sequence(F.lit(0), F.lit(49))).alias("query_id")
    results = found.select(each, "page_id", "host")
    listed = found.select("page_id", "host").filter("page_id % 3 = 0").distinct()
    blocked = load(spark, sf_dir, "part").select(each, F.concat(F.lit("*.part-"), "p_partkey", F.lit(".example")).alias("domain"))
    some = listed.select((F.col("page_id") % 50).cast("int").alias("query_id"), "host")
    rules = (
        blocked.withColumn("kind", F.lit("exclude"))
        .unionByName(some.select("query_id", F.concat(F.lit(" "), F.upper("host"), F.lit(".")).alias("domain"), F.lit("exclude").alias("kind")))
        .unionByName(blocked.filter("query_id % 10 = 0").withColumn("kind", F.lit("include")))
        .unionByName(spark.range(50).filter("id % 20 = 0").select(F.col("id").cast("int").alias("query_id"), F.lit("example.com").alias("domain"), F.lit("include").alias("kind")))
    )
    kept = filter_domains_at_scale(results, rules)
    return kept.groupBy("query_id").agg(F.count("*").alias("kept"), F.sum("page_id").alias("page_sum"))


QUERIES["domain_block_list"] = domain_block_list
ORACLE["domain_block_list"] = r"""
    with h as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host from pages),
    b as (select cast(page_id % 50 as int) as query_id, regexp_replace(host, '^www\.', '') as domain from h where page_id % 3 = 0),
    hit as (select distinct b.query_id, h.page_id from h join b on h.host = b.domain or ends_with(h.host, '.' || b.domain)),
    r as (select cast(q.range as int) as query_id, h.* from h cross join range(50) as q)
    select r.query_id, count(*) as kept, cast(sum(r.page_id) as bigint) as page_sum
    from r left join hit on hit.query_id = r.query_id and hit.page_id = r.page_id
    where hit.page_id is null
      and case when r.query_id % 20 = 0 then r.host = 'example.com' or ends_with(r.host, '.example.com') when r.query_id % 10 = 0 then false else true end
    group by r.query_id"""
ORACLE["domain_filter_join"] = """
    with r as (select cast(page_id % 7 as int) as query_id, page_id,
                      lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host from pages)
    select query_id, count(*) as kept, cast(sum(page_id) as bigint) as page_sum from r
    where case query_id
      when 0 then host = 'example.com' or host like '%.example.com'
      when 1 then not (host = 'example.net' or host like '%.example.net')
      when 2 then (host = 'example.org' or host like '%.example.org')
                  and not (host = 'spam-farm.example.org' or host like '%.spam-farm.example.org')
      when 3 then host = 'example.net' or host like '%.example.net'
      else true end
    group by query_id"""


def redirect_unwrap(spark, sf_dir):
    encoded = F.url_encode("url")
    link = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("//duckduckgo.com/l/?uddg="), encoded, F.lit("&rut=ab")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("/redirect?u=x&url="), encoded))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("/l/?q=none&u="), encoded))
        .otherwise(F.concat(F.lit("/go/"), F.col("page_id").cast("string")))
    )
    pages = load(spark, sf_dir, "pages").select("page_id", link.alias("href"))
    target = pages.withColumn("target", urls.unwrap_redirect(F.col("href")))
    return target.select(
        "page_id", "target", urls.absolute_url(F.col("target")).alias("absolute")
    )


QUERIES["redirect_unwrap"] = redirect_unwrap
ORACLE["redirect_unwrap"] = """
    select page_id, case when page_id % 4 < 3 then url else '/go/' || page_id end as target,
           case when page_id % 4 < 3 then url else 'https://duckduckgo.com/go/' || page_id end as absolute
    from pages"""


def url_secrets(spark, sf_dir):
    decorated = F.concat(
        F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "://", "://me:pw@")).otherwise(
            F.substring_index("url", "#", 1)
        ),
        F.when(F.col("page_id") % 3 == 0, F.lit("?a=1&Access_Token=zz&sig=1#x")).otherwise(F.lit("")),
    )
    pages = load(spark, sf_dir, "pages").select("page_id", decorated.alias("url"))
    return pages.select(
        "page_id",
        urls.credential_in_url(F.col("url")).alias("withheld"),
        urls.drop_fragment(F.col("url")).alias("no_fragment"),
        urls.comparable_url(F.col("url")).alias("comparable"),
    )


QUERIES["url_secrets"] = url_secrets
ORACLE["url_secrets"] = rf"""
    with d as (select page_id, (case when page_id % 5 = 0 then replace(url, '://', '://me:pw@') else split_part(url, '#', 1) end)
        || case when page_id % 3 = 0 then '?a=1&Access_Token=zz&sig=1#x' else '' end as url from pages)
    select page_id,
      case when regexp_matches(url, '^[^:/?#]+://[^/?#@:]+(:[^/?#@]*)?@') then 'userinfo'
           when hit is not null then 'the ' || hit || ' parameter' end as withheld,
      split_part(url, '#', 1) as no_fragment, regexp_replace(lower(url), '/+$', '') as comparable
    from (select *, list_filter(list_transform(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: split_part(p, '=', 1)),
            lambda n: list_contains([{_quoted(dims.CREDENTIAL_PARAMETERS)}], lower(n)))[1] as hit from d)"""


def ascii_hosts(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", urls.url_host(F.col("url")).alias("_u_host"), "url")
    label = F.when(F.col("page_id") % 2 == 0, F.lit("bücher.")).otherwise(F.lit(""))
    pages = pages.select("page_id", F.concat(label, F.col("_u_host")).alias("host"))
    return pages.withColumn("ascii_host", urls.ascii_host(F.col("host")))


QUERIES["ascii_hosts"] = ascii_hosts
ORACLE["ascii_hosts"] = """
    select page_id, case when page_id % 2 = 0 then 'bücher.' else '' end || host as host,
           case when page_id % 2 = 0 then 'xn--bcher-kva.' else '' end || host as ascii_host
    from (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host from pages)"""


# Labels and their registered ASCII spelling.
_LABELS = {
    "bücher": "xn--bcher-kva", "münchen": "xn--mnchen-3ya", "пример": "xn--e1afmkfd", "例え": "xn--r8jz45g",
    "español": "xn--espaol-zwa", "中文": "xn--fiq228c", "δοκιμή": "xn--jxalpdlp", "परीक्षा": "xn--11b5bs3a9aj6g",
}


def url_host_spellings(spark, sf_dir):
    """Every page under a host in its own script, with upper case and another full stop, and under the ASCII spelling."""
    pages = load(spark, sf_dir, "pages").select("page_id", urls.url_host(F.col("url")).alias("host"))
    pairs = F.array(*[F.struct(F.lit(u).alias("own"), F.lit(a).alias("ascii")) for u, a in _LABELS.items()])
    pair = F.element_at(pairs, (1 + F.col("page_id") % len(_LABELS)).cast("int"))
    stop = F.when(F.col("page_id") % 2 == 0, F.lit("\u3002")).otherwise(F.lit("."))
    spelled = F.array(
        F.concat(F.lit("https://"), F.upper(pair.own), stop, F.col("host"), F.lit(":443/x")),
        F.concat(F.lit("HTTPS://"), pair.ascii, F.lit("."), F.col("host"), F.lit("./x?utm_source=a")),
    )
    each = pages.select("page_id", F.explode(spelled).alias("url"))
    keyed = urls.with_canonical_url(each, "url", host_out="host", ascii_hosts=True)
    return keyed.groupBy("canonical_url", "host").agg(F.count("*").alias("copies"), F.count_distinct("page_id").alias("pages"))


QUERIES["url_host_spellings"] = url_host_spellings
ORACLE["url_host_spellings"] = f"""
    select 'https://' || host || '/x' as canonical_url, host, 2 * count(*) as copies, count(*) as pages
    from (select page_id, [{_quoted(_LABELS.values())}][1 + page_id % {len(_LABELS)}] || '.' || lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host from pages)
    group by host"""


_ADMISSION_HOST = (
    "case page_id % 12 when 0 then 'localhost' when 1 then 'printer.LAN.' when 2 then '10.1.2.3' "
    "when 3 then '8.8.4.4' when 4 then '192.168.1.1:8080' when 5 then 'bare' when 6 then 'a_b.example.com' "
    "when 7 then '1.2.3.007' when 8 then 'x.123' when 9 then 'me:pw@{h}' else '{h}' end"
)


def url_admission(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    host = F.expr(_ADMISSION_HOST.replace("'{h}'", "h").replace("'me:pw@{h}'", "'me:pw@' || h"))
    scheme = F.expr("case page_id % 10 when 9 then 'ftp' else 'https' end")
    df = pages.withColumn("h", F.split_part("url", F.lit("/"), F.lit(3))).select(
        "page_id", F.concat(scheme, F.lit("://"), host, F.lit("/x")).alias("url")
    )
    strict = hosts.with_url_admission(df, "url")
    return hosts.with_url_admission(
        strict.withColumnRenamed("allowed", "strict_allowed"), "url", allow_private=True, out="open_reason"
    ).select("page_id", "deny_reason", "strict_allowed", F.col("allowed").alias("open_allowed"), "open_reason")


QUERIES["url_admission"] = url_admission
ORACLE["url_admission"] = (
    """
    with u as (select page_id, case page_id % 10 when 9 then 'ftp' else 'https' end as scheme, """
    + _ADMISSION_HOST.replace("'{h}'", "split_part(url, '/', 3)").replace("'me:pw@{h}'", "'me:pw@'")
    + f""" as authority from pages),
    h as (select *, rtrim(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')), '.') as host from u),
    n as (select *, regexp_matches(host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') as quad,
            regexp_matches(host, '(^|\\.)0[0-9]') as padded,
            try_cast(split_part(host, '.', 1) as int) as a, try_cast(split_part(host, '.', 2) as int) as b from h),
    o as (select *, case when scheme = 'ftp' then 'Only http and https URLs may be fetched'
                   when contains(authority, '@') then 'URLs containing credentials are not fetched' end as open_reason from n)
    select page_id, open_reason, open_reason is null as open_allowed, deny_reason, deny_reason is null as strict_allowed
    from (select *, case when open_reason is not null then open_reason
      when host in ({_quoted(dims.BLOCKED_HOSTS)}) then 'Host ' || host || ' is not fetchable'
      when regexp_matches(host, '\\.(localhost|local|internal|intranet|corp|home\\.arpa|lan|private)$') then 'Host ' || host || ' is an internal name'
      when quad and padded then 'Unparseable IP literal ' || host
      when quad and (a = 10 or (a = 192 and b = 168)) then 'Host ' || host || ' resolves to a private address'
      when quad then null
      when not regexp_matches(host, '^([a-z0-9]([a-z0-9-]*[a-z0-9])?\\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?$')
           or not regexp_matches(split_part(host, '.', -1), '[a-z]') then 'Host ' || host || ' is not a valid public hostname'
      end as deny_reason from o)"""
)


# one v4 address per event, spread over the special ranges, and the v6 forms that carry it
_V4 = (
    "select event_id, case user_id % 14 when 0 then 127 when 1 then 169 when 2 then 10 when 3 then 172 when 4 then 192 "
    "when 5 then 224 + event_id % 16 when 6 then 0 when 7 then 100 when 8 then 240 + event_id % 15 when 9 then 198 "
    "when 10 then 8 when 11 then 192 when 12 then 172 else 93 end as a, "
    "case user_id % 14 when 1 then 254 when 3 then 16 + event_id % 16 when 4 then 168 when 7 then 60 + event_id % 72 "
    "when 9 then 17 + event_id % 4 when 11 then 0 when 12 then 15 else event_id % 256 end as b, "
    "event_id % 251 as c, event_id % 241 as d, event_id % 6 as form from {events}"
)
_V4_CLASS_SQL = """
    case when a = 127 then 'loopback' when a = 169 and b = 254 then 'link_local'
         when a = 10 or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) then 'private'
         when a between 224 and 239 then 'multicast' when a = 0 and b = 0 and c = 0 and d = 0 then 'unspecified'
         when a = 100 and b between 64 and 127 then case when b = 100 and c = 100 and d = 200 then 'metadata' else 'shared' end
         when a >= 240 or a = 0 or (a = 192 and b = 0) or (a = 198 and b in (18, 19)) then 'reserved' end"""


def ip_classes(spark, sf_dir):
    load(spark, sf_dir, "events").createOrReplaceTempView("serploom_events")
    octets = spark.sql(_V4.format(events="serploom_events"))
    low = F.format_string(
        "%02x%02x:%02x%02x", *[F.col(c).cast("int") for c in ("a", "b", "c", "d")]
    )
    flipped = F.format_string(
        "%02x%02x:%02x%02x", *[(255 - F.col(c)).cast("int") for c in ("a", "b", "c", "d")]
    )
    ip = (
        F.when(F.col("form") == 0, F.concat_ws(".", *[F.col(c).cast("string") for c in "abcd"]))
        .when(F.col("form") == 1, F.concat(F.lit("::ffff:"), low))
        .when(F.col("form") == 2, F.concat(F.lit("64:ff9b::"), low))
        .when(F.col("form") == 3, F.concat(F.lit("2002:"), low, F.lit("::1")))
        .when(F.col("form") == 4, F.concat(F.lit("2001:0:1:2:3:4:"), flipped))
        .otherwise(F.concat(F.lit("2606:4700::"), low))
    )
    df = octets.select("event_id", ip.alias("ip"))
    return hosts.with_ip_class(df, "ip").select("event_id", "ip_class", "embedded_ip")


QUERIES["ip_classes"] = ip_classes
ORACLE["ip_classes"] = f"""
    select event_id,
      case when form = 5 then 'public' when form = 0 then coalesce(k, 'public') when k is null then 'public' else 'embedded' end as ip_class,
      case when form between 1 and 4 then concat_ws('.', a, b, c, d) end as embedded_ip
    from (select *, {_V4_CLASS_SQL} as k from ({_V4.format(events='events')}))"""


def admit_resolved(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", urls.url_host(F.col("url")).alias("_u_host"), "url")
    pages = pages.select("page_id", F.col("_u_host").alias("host"))
    addresses = view(spark, sf_dir, "host_addresses")
    return hosts.admit_resolved(pages, addresses).select(
        "page_id", "host", "resolved_allowed", "resolved_reason"
    )


QUERIES["admit_resolved"] = admit_resolved
ORACLE["admit_resolved"] = sql(
    """
    with j as (select host, position, case when ip like '10.%' then 'a private address' when ip like '169.254.%' then 'a link-local address'
        when ip like '100.64.%' then 'shared address space' when ip like '192.0.%' then 'a reserved address'
        when ip like '127.%' then 'a loopback address' end as words from host_addresses),
    v as (select host, min_by(words, position) as words from j where words is not null group by host)
    select page_id, p.host, v.words is null as resolved_allowed, 'Host ' || v.host || ' resolves to ' || v.words as resolved_reason
    from (select page_id, split_part(url, '/', 3) as host from pages) p left join v on p.host = v.host""",
    "host_addresses",
)


def peer_mismatch(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(
        F.col("page_id").alias("fetch_id"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host")
    )
    peer = F.when(F.col("fetch_id") % 6 == 0, F.lit(None)).when(
        F.col("fetch_id") % 6 == 1, F.lit("203.0.113.9")
    ).otherwise(F.lit("8.8.8.8"))
    fetches = pages.withColumn("peer_ip", peer)
    validated = pages.join(view(spark, sf_dir, "host_addresses"), "host").select("fetch_id", "ip")
    return hosts.peer_mismatch(fetches, validated).select("fetch_id", "refusal")


QUERIES["peer_mismatch"] = peer_mismatch
ORACLE["peer_mismatch"] = sql(
    """
    with f as (select page_id as fetch_id, split_part(url, '/', 3) as host,
        case page_id % 6 when 0 then null when 1 then '203.0.113.9' else '8.8.8.8' end as peer_ip from pages)
    select fetch_id, case when peer_ip is null then 'the connection''s address could not be verified'
      else 'the connection went to ' || peer_ip || ', which this URL''s policy did not validate' end as refusal
    from f where host in (select host from host_addresses)
      and (peer_ip is null or not exists (select 1 from host_addresses a where a.host = f.host and a.ip = f.peer_ip))""",
    "host_addresses",
)
