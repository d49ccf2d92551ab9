"""Registered queries over text, dates, categories and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from serploom import dims
from serploom.functions import labels, requests, text
from serploom.plans.views import sql, view
from serploom.session import load

QUERIES = {}
ORACLE = {}

_ENTITY_SQL = "map {" + ", ".join(
    "'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in dims.ENTITIES.items()
) + "}"
_WS = r"[\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return (
        f"case when contains({x}, '<') then replace(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), "
        f"'<[^>]*$', ''), '>', ' ') else {x} end"
    )


def decode_sql(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '(&[^;]{{0,8}};|[^&]+|&)'), "
        f"lambda t: coalesce({_ENTITY_SQL}[t], t)), '')"
    )


def text_clean(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("raw"))
    docs = load(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    both = pages.unionByName(docs)
    return both.select("kind", "id", text.clean_text(F.col("raw")).alias("clean"))


QUERIES["text_clean"] = text_clean
ORACLE["text_clean"] = f"""
    with raw as (select 'page' as kind, page_id as id, html as raw from pages union all select 'document', doc_id, text from documents),
    s as (select kind, id, {strip_sql('raw')} as t from raw), d as (select kind, id, {decode_sql('t')} as t from s)
    select kind, id, nullif({collapse_sql('t')}, '') as clean from d"""


def entity_decode(spark, sf_dir):
    raw = F.concat(F.col("text"), F.lit(" &amp;lt; &x&lt; a & b &unknown; &#39;&nbsp;"))
    return load(spark, sf_dir, "documents").select("doc_id", text.decode_entities(raw).alias("decoded"))


QUERIES["entity_decode"] = entity_decode
ORACLE["entity_decode"] = (
    "select doc_id, " + decode_sql("(text || ' &amp;lt; &x&lt; a & b &unknown; &#39;&nbsp;')") + " as decoded from documents"
)


def text_clip(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    clipped, truncated = text.clip_words(F.col("text"), 200)
    return docs.select(
        "doc_id", clipped.alias("clipped"), truncated.alias("truncated"),
        text.clip_ellipsis(F.concat(F.lit(" \n"), F.replace("text", F.lit("\n"), F.lit("\r\n"))), 120).alias("short"),
    )


QUERIES["text_clip"] = text_clip
ORACLE["text_clip"] = r"""
    select doc_id, length(text) > 200 as truncated,
      case when length(text) <= 200 then text when length(head) > 100 then head else left(text, 200) end as clipped,
      case when length(body) > 120 then left(body, 120) || '…' else body end as short
    from (select *, regexp_extract(left(text, 200), '(?s)^(.*)[\s\x{00a0}\x{2028}]', 1) as head,
                 trim(text, chr(10) || ' ' || chr(9) || chr(13)) as body from documents)"""


def text_lines(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    wide = F.concat(F.lit("\n \n"), F.replace("text", F.lit("."), F.lit(". \n\t\n\n\n ")), F.lit("\n"))
    titled = F.concat(F.lit("x\n\n  TITLE:  "), F.substring("text", 1, 12), F.lit("\nmore\n"), F.col("text"))
    return docs.select(
        "doc_id",
        text.normalize_lines(wide).alias("lines"),
        text.opens_with_title(F.concat(F.lit("# "), F.upper(F.substring_index("text", "\n", 1))), F.col("text")).alias("same_title"),
        text.opens_with_title(F.substring("text", 1, 9), F.col("text")).alias("short_title"),
        text.leading_title(titled).alias("title"),
    )


QUERIES["text_lines"] = text_lines
ORACLE["text_lines"] = rf"""
    with d as (select *, chr(10) || ' ' || chr(10) || replace(text, '.', '. ' || chr(10) || chr(9) || chr(10) || chr(10) || chr(10) || ' ') || chr(10) as wide,
        trim(regexp_replace(split_part(text, chr(10), 1), '^#+', '')) as first_line, trim(split_part(left(text, 12), chr(10), 1)) as word from documents)
    select doc_id,
      trim(regexp_replace(array_to_string(list_transform(string_split(wide, chr(10)), lambda s: {collapse_sql('s')}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) as lines,
      first_line <> '' as same_title,
      trim(left(text, 9)) <> '' and first_line <> '' and lower(strip_accents(first_line)) = lower(strip_accents(trim(regexp_replace(trim(left(text, 9)), '^#+', '')))) as short_title,
      nullif(word, '') as title
    from d"""


def text_guard(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    fenced = F.concat(F.lit("</UNTRUSTED-search-results>"), F.col("text"), F.lit("<untrusted-<untrusted-search-results>search-results>"))
    odd = F.concat(F.col("text"), F.lit("\t\"a\\b\" \u001b[2J\u0085​\r"))
    return docs.select(
        "doc_id", text.neutralize_fences(fenced).alias("safe"), text.escape_control(odd).alias("escaped")
    )


QUERIES["text_guard"] = text_guard
ORACLE["text_guard"] = r"""
    select doc_id,
      regexp_replace('</UNTRUSTED-search-results>' || text || '<untrusted-<untrusted-search-results>search-results>',
        '(?i)</?untrusted-search-results>', '[delimiter removed]', 'g') as safe,
      array_to_string(list_transform(regexp_extract_all(odd, '([\\"\p{Cc}\p{Cf}]|[^\\"\p{Cc}\p{Cf}]+)'), lambda t:
        case t when chr(92) then chr(92) || chr(92) when '"' then chr(92) || '"' when chr(10) then chr(92) || 'n' when chr(13) then chr(92) || 'r' when chr(9) then chr(92) || 't'
        else case when regexp_full_match(t, '[\p{Cc}\p{Cf}]') then chr(92) || 'u{' || printf('%02X', unicode(t)) || '}' else t end end), '') as escaped
    from (select *, text || chr(9) || '"a' || chr(92) || 'b" ' || chr(27) || '[2J' || chr(133) || chr(8203) || chr(13) as odd from documents)"""

_SECRETS = {"EXA_API_KEY": "ion de la", "JINA_API_KEY": "short", "BRAVE_SEARCH_API_KEY": "the of and"}


def _log_lines(docs):
    marker = F.element_at(F.array(*[F.lit(m) for m in dims.LEAK_MARKERS]), (1 + F.col("doc_id") % len(dims.LEAK_MARKERS)).cast("int"))
    return F.when(F.length("text") % 3 == 0, F.concat(F.col("text"), F.lit(" "), marker, F.lit("zz"))).otherwise(F.col("text"))


_LOG_LINES_SQL = (
    "(select doc_id, case when length(text) % 3 = 0 then text || ' ' || ["
    + ", ".join(f"'{m}'" for m in dims.LEAK_MARKERS)
    + f"][1 + doc_id % {len(dims.LEAK_MARKERS)}] || 'zz' else text end as line from documents)"
)
_FOUND_SQL = (
    "list_filter([" + ", ".join(f"case when contains(line, '{m}') then '{m}' end" for m in dims.LEAK_MARKERS)
    + ", " + ", ".join(f"case when contains(line, '{v}') then '{k} value' end" for k, v in _SECRETS.items() if len(v) >= 8)
    + "], lambda m: m is not null)"
)


def leak_markers(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    found = docs.select("doc_id", text.leak_markers(_log_lines(docs), _SECRETS).alias("found"))
    return found.filter(F.size("found") > 0).select("doc_id", F.array_join("found", "|").alias("markers"))


QUERIES["leak_markers"] = leak_markers
ORACLE["leak_markers"] = f"""
    select doc_id, array_to_string(list_sort(found), '|') as markers
    from (select doc_id, {_FOUND_SQL} as found from {_LOG_LINES_SQL}) where len(found) > 0"""


def leak_report(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    found = docs.select(F.explode(text.leak_markers(_log_lines(docs), _SECRETS)).alias("marker"))
    return found.groupBy("marker").agg(F.count("*").alias("lines"))


QUERIES["leak_report"] = leak_report
ORACLE["leak_report"] = f"""
    select marker, count(*) as lines from (select unnest({_FOUND_SQL}) as marker from {_LOG_LINES_SQL}) group by marker"""


def sse_last_json(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    body = (
        F.when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("event: x\ndata: {\"k\": 0}\n data:  "), F.col("props"), F.lit(" \n\ndata: [DONE]\n")))
        .otherwise(F.concat(F.lit("data: none "), F.col("props")))
    )
    return events.select("event_id", F.get_json_object(text.sse_last_json(body), "$.k").cast("int").alias("k"))


QUERIES["sse_last_json"] = sse_last_json
ORACLE["sse_last_json"] = """
    select event_id, case when event_type in ('view', 'click') then cast(regexp_extract(props, '([0-9]+)', 1) as int) end as k from events"""


# --- dates and categories ---------------------------------------------------------------------------
_SPELLINGS = [
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEE, dd MMM yyyy HH:mm:ss",
]


def parse_dates(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    spelled = F.when(F.col("event_id") % 10 == 8, F.unix_seconds("ts").cast("string")).when(
        F.col("event_id") % 10 == 9, F.lit("not a date")
    )
    for i, pattern in enumerate(_SPELLINGS):
        spelled = spelled.when(F.col("event_id") % 10 == i, F.date_format("ts", pattern))
    spelled = spelled.otherwise("")
    parsed = labels.parse_date(F.concat(F.lit(" "), spelled))
    return events.select("event_id", labels.iso_utc(parsed).alias("parsed"))


QUERIES["parse_dates"] = parse_dates
ORACLE["parse_dates"] = """
    select event_id, strftime(case event_id % 10 when 1 then date_trunc('millisecond', ts) when 2 then date_trunc('day', ts)
      when 5 then date_trunc('day', ts) when 9 then null else date_trunc('second', ts) end, '%Y-%m-%dT%H:%M:%S.%gZ') as parsed from events"""


def recency_filter(spark, sf_dir):
    reqs = view(spark, sf_dir, "requests").select("request_id", "recency", F.col("ts").cast("timestamp").alias("published_at"))
    now = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit("2024-01-31 00:00:00"))))
    kept = reqs.filter(labels.within_recency(F.col("published_at"), F.col("recency"), now))
    return kept.groupBy("recency").agg(F.count("*").alias("kept"), labels.iso_utc(F.min("published_at")).alias("oldest"))


QUERIES["recency_filter"] = recency_filter
ORACLE["recency_filter"] = sql(
    """select recency, count(*) as kept, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%gZ') as oldest from requests
    where recency = 'any' or ts >= timestamp '2024-01-31' - interval 1 day * case recency when 'day' then 1 when 'week' then 7 when 'month' then 31 else 365 end
    group by recency""",
    "requests",
)


def retry_after(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    raw = F.expr(
        "case event_id % 6 when 0 then ' ' || cast(user_id as string) when 1 then '1e30' when 2 then 'inf' "
        "when 3 then '-5' when 4 then date_format(timestampadd(SECOND, user_id, date_trunc('SECOND', ts)), \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\") else 'soon' end"
    )
    now = F.date_trunc("second", "ts")
    return events.select("event_id", labels.retry_after_ms(raw, now).alias("wait_ms"))


QUERIES["retry_after"] = retry_after
ORACLE["retry_after"] = """
    select event_id, cast(case event_id % 6 when 0 then user_id * 1000 when 1 then 86400000 when 3 then 0 when 4 then user_id * 1000 end as bigint) as wait_ms from events"""


def iso_stamps(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", labels.iso_utc(F.col("ts")).alias("stamp"))


QUERIES["iso_stamps"] = iso_stamps
ORACLE["iso_stamps"] = "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as stamp from events"


def status_categories(spark, sf_dir):
    tries = view(spark, sf_dir, "attempts").select(
        "event_id", "provider",
        F.expr("element_at(array(200, 202, 204, 400, 401, 402, 403, 404, 422, 429, 500, 503), cast(1 + event_id % 12 as int))").alias("status_code"),
        F.expr("case event_id % 5 when 0 then '{\"error\": {\"code\": \"subscription_token_invalid\"}}' when 1 then '{\"error\": {\"meta\": {\"component\": \"Authentication\"}}}' else 'x' end").alias("body"),
    )
    done = labels.with_status_category(tries, body="body")
    return done.select("event_id", "provider", "status_code", "status_category", labels.is_transient(F.col("status_category")).alias("transient"))


QUERIES["status_categories"] = status_categories
ORACLE["status_categories"] = sql(
    """with t as (select event_id, provider, event_id % 5 as b, [200, 202, 204, 400, 401, 402, 403, 404, 422, 429, 500, 503][1 + event_id % 12] as status_code from attempts),
    c as (select *, case
      when status_code in (200, 204) then 'ok' when status_code = 202 then case provider when 'duckduckgo' then 'server_error' else 'ok' end
      when status_code = 429 then 'rate_limited' when provider in ('duckduckgo', 'startpage') then 'server_error'
      when provider = 'exa' and status_code in (401, 402) then 'authentication'
      when provider in ('exa', 'searxng') and status_code = 403 then 'unsupported_request'
      when status_code in (401, 403) then 'authentication'
      when provider = 'brave' and status_code = 422 and b in (0, 1) then 'authentication'
      when status_code >= 500 then 'server_error' else 'unsupported_request' end as status_category from t)
    select event_id, provider, status_code, status_category, status_category in ('rate_limited', 'timeout', 'network', 'server_error') as transient from c""",
    "attempts",
)


def error_categories(spark, sf_dir):
    kinds = list(dims.ERROR_CATEGORIES) + ["something_else"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (1 + F.col("event_id") % len(kinds)).cast("int"))
    events = load(spark, sf_dir, "events").select(kind.alias("kind"))
    return events.groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", labels.error_category(F.col("kind")).alias("category"))


QUERIES["error_categories"] = error_categories
ORACLE["error_categories"] = (
    "select kind, count(*) as n, case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in dims.ERROR_CATEGORIES.items())
    + " else 'network' end as category from (select [" + ", ".join(f"'{k}'" for k in dims.ERROR_CATEGORIES)
    + f", 'something_else'][1 + event_id % {len(dims.ERROR_CATEGORIES) + 1}] as kind from events) group by kind"
)


# --- requests ---------------------------------------------------------------------------------------
def request_locales(spark, sf_dir):
    raw = F.col("locale")
    return view(spark, sf_dir, "requests").select(
        "request_id", requests.locale_language(raw).alias("language"), requests.locale_region(raw).alias("region"),
        requests.locale_identifier(raw).alias("identifier"),
    )


QUERIES["request_locales"] = request_locales
ORACLE["request_locales"] = sql(
    """select request_id, lower(p[1]) as language, case when length(p[2]) = 2 then upper(p[2]) end as region,
      concat_ws('-', lower(p[1]), case when length(p[2]) = 2 then upper(p[2]) end) as identifier
    from (select request_id, string_split(replace(trim(locale), '_', '-'), '-') as p from requests)""",
    "requests",
)


def digest_of(reqs):
    return requests.request_digest(
        F.col("query"), F.col("max_results_raw"), F.col("recency"), F.col("mode"),
        F.array(F.lit("B.com"), F.lit("a.com")), F.array().cast("array<string>"),
        requests.locale_identifier(F.col("locale")), F.array(F.lit("tavily"), F.lit("brave")),
    )


DIGEST_SQL = (
    "sha256(concat_ws(chr(31), lower(" + collapse_sql("query") + "), 'n=' || max_results_raw, 'recency=' || recency, 'mode=' || mode, "
    "'inc=a.com,b.com', 'exc=', 'locale=' || case trim(locale) when 'en-us' then 'en-US' when 'DE_de' then 'de-DE' when 'fr' then 'fr' else 'pt' end, "
    "'providers=brave,tavily'))"
)


def request_digests(spark, sf_dir):
    reqs = view(spark, sf_dir, "requests")
    return reqs.select("request_id", digest_of(reqs).alias("digest"))


QUERIES["request_digests"] = request_digests
ORACLE["request_digests"] = sql(f"select request_id, {DIGEST_SQL} as digest from requests", "requests")


def query_pseudonyms(spark, sf_dir):
    return view(spark, sf_dir, "requests").select(
        "request_id", requests.query_pseudonym(F.col("query"), b"serploom-key").alias("pseudonym")
    )


def _pad_sql(mask: int) -> str:
    return "unhex('" + bytes(b ^ mask for b in b"serploom-key".ljust(64, b"\0")).hex() + "')"


QUERIES["query_pseudonyms"] = query_pseudonyms
ORACLE["query_pseudonyms"] = sql(
    f"""select request_id, 'q' || regexp_replace(left(sha256({_pad_sql(0x5C)} || unhex(sha256({_pad_sql(0x36)} || encode(query)))), 16), '^0+(.)', '\\1') as pseudonym
    from requests""",
    "requests",
)


def clamped_requests(spark, sf_dir):
    reqs = view(spark, sf_dir, "requests").withColumn("chars", F.col("max_results_raw") * 3000)
    domains = F.transform(F.sequence(F.lit(0), F.col("max_results_raw")), lambda i: F.concat(i.cast("string"), F.lit(".com")))
    done = requests.clamp_requests(reqs.withColumn("include_domains", domains), "query", "max_results_raw", ["include_domains"], "chars")
    accepted, rejected = requests.split_rejects(done)
    columns = ["request_id", "clean_query", "result_limit", "provider_budget", "character_limit"]
    return accepted.select(*columns, F.lit(None).cast("string").alias("reject_reason")).unionByName(rejected.select(*columns, "reject_reason"))


QUERIES["clamped_requests"] = clamped_requests
ORACLE["clamped_requests"] = sql(
    f"""select request_id, {collapse_sql('query')} as clean_query, cast(least(greatest(max_results_raw, 1), 20) as int) as result_limit,
      cast(least(20, 2 * least(greatest(max_results_raw, 1), 20)) as int) as provider_budget,
      cast(least(greatest(max_results_raw * 3000, 1000), 50000) as int) as character_limit,
      case when trim(query) = '' then 'query must not be empty' when max_results_raw >= 20 then 'include_domains has more than 20 entries' end as reject_reason
    from requests""",
    "requests",
)
