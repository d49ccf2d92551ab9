"""Which hosts and addresses a crawl may touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom import dims
from serploom.functions.urls import bind, url_authority, url_host, url_scheme

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0?[0-9]?[0-9])"
_DOTTED_QUAD = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_STRICT_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_STRICT_QUAD = rf"^{_STRICT_OCTET}(\.{_STRICT_OCTET}){{3}}$"

# Class names in the order they are tested, with the words used in a denial.
CLASS_WORDS = {
    "loopback": "a loopback address",
    "link_local": "a link-local address",
    "private": "a private address",
    "multicast": "a multicast address",
    "unspecified": "an unspecified address",
    "metadata": "a cloud metadata address",
    "broadcast": "a broadcast address",
    "shared": "shared address space",
    "reserved": "a reserved address",
}


def is_ip_literal(host: Column) -> Column:
    return host.contains(":") | host.rlike(_DOTTED_QUAD)


def is_plausible_host(host: Column) -> Column:
    """At most 253 characters, two or more ordinary labels, a letter in the last one."""
    label = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    return (
        (F.length(host) <= 253)
        & host.rlike(rf"^({label}\.)+{label}$")
        & F.substring_index(host, ".", -1).rlike("[A-Za-z]")
    )


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a number, NULL when it is not strictly one."""
    number = F.aggregate(
        F.split(ip, r"\."),
        F.lit(0).cast("bigint"),
        lambda total, part: total * 256 + part.try_cast("bigint"),
    )
    return F.when(ip.rlike(_STRICT_QUAD), number)


def ipv4_class(number: Column) -> Column:
    """First matching class of a v4 address, NULL when it is public."""
    return bind(number, _ipv4_rules)


def _ipv4_rules(number: Column) -> Column:
    a = F.shiftright(number, 24)
    b = F.shiftright(number, 16).bitwiseAND(255)
    return (
        F.when(a == 127, F.lit("loopback"))
        .when((a == 169) & (b == 254), F.lit("link_local"))
        .when(
            (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)),
            F.lit("private"),
        )
        .when(a.between(224, 239), F.lit("multicast"))
        .when(number == 0, F.lit("unspecified"))
        .when(number == (100 << 24) + (100 << 16) + (100 << 8) + 200, F.lit("metadata"))
        .when(number == 0xFFFFFFFF, F.lit("broadcast"))
        .when((a == 100) & b.between(64, 127), F.lit("shared"))
        .when(
            (a >= 240) | (a == 0) | ((a == 192) & (b == 0)) | ((a == 198) & b.isin(18, 19)),
            F.lit("reserved"),
        )
    )


_GROUPS = "[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*"


def with_ipv6_hex(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Adds the 32 upper-case hex digits of a v6 address, NULL when it is not strictly one or names a zone.

    A dotted tail becomes two groups; each side of ``::`` is padded to four digits a group, and zeros
    fill what is left between the sides.
    """
    c = F.col
    last = F.substring_index(c(ip), ":", -1)
    octet = lambda i: F.lpad(F.hex(F.get(F.split(last, r"\."), F.lit(i)).try_cast("int")), 2, "0")
    head = F.substring(c(ip), F.lit(1), F.length(ip) - F.length(last))
    df = df.withColumn(
        "_groups",
        F.when(~c(ip).contains("."), c(ip))
        .when(last.rlike(_STRICT_QUAD), F.concat(head, octet(0), octet(1), F.lit(":"), octet(2), octet(3))),
    )
    df = df.withColumn("_right_at", F.instr("_groups", "::"))
    short = c("_right_at") > 0
    df = df.withColumns(
        {
            "_left": F.when(short, F.substring(c("_groups"), F.lit(1), c("_right_at") - 1)).otherwise(c("_groups")),
            "_right": F.when(short, F.expr("substr(_groups, _right_at + 2)")).otherwise(""),
        }
    )
    padded = lambda side: F.regexp_replace(F.regexp_replace(c(side), "([^:]+)", "000$1"), "[^:]*([^:]{4})(:|$)", "$1")
    valid = c("_left").rlike(f"^({_GROUPS})?$") & c("_right").rlike(f"^({_GROUPS})?$")
    df = df.withColumns({"_left": F.when(valid, padded("_left")), "_right": F.when(valid, padded("_right"))})
    missing = F.lit(32) - F.length("_left") - F.length("_right")
    fits = F.when(short, missing >= 4).otherwise(missing == 0)
    df = df.withColumn(out, F.when(fits, F.upper(F.concat(c("_left"), F.repeat(F.lit("0"), missing), c("_right")))))
    return df.drop("_groups", "_right_at", "_left", "_right")


def _byte(hexed: Column, i: int) -> Column:
    return F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).try_cast("int")


def ipv6_class(hexed: Column) -> Column:
    """First matching class of a v6 address given as 32 upper-case hex digits."""
    return bind(hexed, _ipv6_rules)


def _ipv6_rules(hexed: Column) -> Column:
    first, second = _byte(hexed, 0), _byte(hexed, 1)
    return (
        F.when(hexed == "0" * 31 + "1", F.lit("loopback"))
        .when((first == 0xFE) & (second.bitwiseAND(0xC0) == 0x80), F.lit("link_local"))
        .when(first.bitwiseAND(0xFE) == 0xFC, F.lit("private"))
        .when(first == 0xFF, F.lit("multicast"))
        .when(hexed == "0" * 32, F.lit("unspecified"))
        .when(hexed.startswith("20010DB8"), F.lit("reserved"))
    )


def embedded_ipv4(hexed: Column) -> Column:
    """The v4 address a transition form carries, as a number."""
    return bind(hexed, _embedded_rules)


def _embedded_rules(hexed: Column) -> Column:

    def number(start: int) -> Column:
        return F.conv(F.substring(hexed, start, 8), 16, 10).try_cast("bigint")

    low = number(25)
    return (
        F.when(hexed.startswith("0" * 20 + "FFFF"), low)
        .when(hexed.startswith("0" * 24) & ~low.isin(0, 1), low)
        .when(hexed.startswith("0064FF9B" + "0" * 16), low)
        .when(hexed.startswith("2002"), number(5))
        .when(hexed.startswith("20010000"), F.lit(0xFFFFFFFF) - low)
    )


def ipv4_text(number: Column) -> Column:
    return bind(
        number,
        lambda n: F.concat_ws(
            ".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
        ),
    )


def with_ip_class(df: DataFrame, ip: str, out: str = "ip_class") -> DataFrame:
    """Adds the class (``public`` when none applies, NULL when unparseable) and ``embedded_ip``."""
    is_v6 = F.col(ip).contains(":")
    df = df.withColumns({"_n": F.when(~is_v6, ipv4_number(F.col(ip))), "_v6": F.when(is_v6, F.col(ip))})
    df = with_ipv6_hex(df, "_v6", "_h").withColumn("_e", embedded_ipv4(F.col("_h")))
    direct = F.coalesce(ipv4_class(F.col("_n")), ipv6_class(F.col("_h")))
    inner = F.when(ipv4_class(F.col("_e")).isNotNull(), F.lit("embedded"))
    parsed = F.col("_n").isNotNull() | F.col("_h").isNotNull()
    return df.withColumns(
        {
            out: F.when(parsed, F.coalesce(direct, inner, F.lit("public"))),
            "embedded_ip": F.when(F.col("_e").isNotNull(), ipv4_text(F.col("_e"))),
        }
    ).drop("_n", "_v6", "_h", "_e")


def denial(host: Column, ip_class: Column, embedded_ip: Column) -> Column:
    """Why an address may not be contacted, NULL when it may."""
    words = F.create_map(*[F.lit(x) for pair in CLASS_WORDS.items() for x in pair])
    return (
        F.when(
            ip_class == "embedded",
            F.concat(
                F.lit("Host "), host, F.lit(" embeds a non-public address ("), embedded_ip,
                F.lit(")"),
            ),
        )
        .when(
            ip_class.isin(*CLASS_WORDS),
            F.concat(F.lit("Host "), host, F.lit(" resolves to "), F.try_element_at(words, ip_class)),
        )
    )


def with_url_admission(
    df: DataFrame, url: str, allow_private: bool = False, out: str = "deny_reason"
) -> DataFrame:
    """Adds ``allowed`` and the first rule a URL breaks, judged by its spelling alone."""
    source = F.col(url)
    df = df.withColumn(
        "_a_ip",
        bind(
            url_host(source), lambda h: F.when(is_ip_literal(h), F.regexp_replace(h, r"^\[|\]$", ""))
        ),
    )
    df = with_ip_class(df, "_a_ip", "_a_class")
    def named(host: Column) -> Column:
        suffixed = F.lit(False)
        for suffix in dims.BLOCKED_SUFFIXES:
            suffixed = suffixed | host.endswith(suffix)
        shown = F.coalesce(F.col("_a_ip"), host)
        return (
            F.when(
                host.isin(*dims.BLOCKED_HOSTS),
                F.concat(F.lit("Host "), host, F.lit(" is not fetchable")),
            )
            .when(suffixed, F.concat(F.lit("Host "), host, F.lit(" is an internal name")))
            .when(
                F.col("_a_ip").isNotNull() & F.col("_a_class").isNull(),
                F.concat(F.lit("Unparseable IP literal "), shown),
            )
            .when(
                F.col("_a_ip").isNotNull(), denial(shown, F.col("_a_class"), F.col("embedded_ip"))
            )
            .when(
                ~is_plausible_host(host),
                F.concat(F.lit("Host "), host, F.lit(" is not a valid public hostname")),
            )
        )
    name_rules = F.lit(None).cast("string") if allow_private else bind(url_host(source), named)
    reason = (
        F.when(url_scheme(source) == "", F.lit("URL has no scheme"))
        .when(
            ~url_scheme(source).isin("http", "https"),
            F.lit("Only http and https URLs may be fetched"),
        )
        .when(url_host(source) == "", F.lit("URL has no host"))
        .when(
            url_authority(source).contains("@"),
            F.lit("URLs containing credentials are not fetched"),
        )
        .otherwise(name_rules)
    )
    df = df.withColumn(out, reason).withColumn("allowed", F.col(out).isNull())
    return df.drop("_a_ip", "_a_class", "embedded_ip")


def admit_resolved(urls: DataFrame, addresses: DataFrame, host: str = "host") -> DataFrame:
    """Rows of ``urls`` with ``resolved_allowed`` and the first denial among a host's addresses.

    ``addresses(host, ip, position)``; a host with no answer is allowed. The address table is reduced
    to one row per host with partial aggregation before it meets ``urls``.
    """
    judged = with_ip_class(addresses, "ip", "_class")
    reason = denial(F.col("host"), F.col("_class"), F.col("embedded_ip"))
    # no filter on the reason: it would be pushed below the staged parsing with all stages inlined
    judged = judged.select(F.col("host").alias("_host"), "position", reason.alias("reason"))
    denied = F.when(F.col("reason").isNotNull(), F.struct("position", "reason"))
    verdicts = judged.groupBy("_host").agg(F.min(denied).alias("v"))
    return (
        urls.join(verdicts, F.col(host) == F.col("_host"), "left")
        .withColumn("resolved_reason", F.col("v.reason"))
        .withColumn("resolved_allowed", F.col("v").isNull())
        .drop("_host", "v")
    )


def peer_mismatch(fetches: DataFrame, validated: DataFrame) -> DataFrame:
    """Fetched rows whose connection cannot be trusted.

    ``fetches(fetch_id, peer_ip)``, ``validated(fetch_id, ip)``. A fetch with nothing validated is
    skipped; one with no peer address, or with an address outside the validated ones, is refused.
    """
    known = validated.select("fetch_id").distinct()
    checked = fetches.join(known, "fetch_id", "left_semi")
    pairs = validated.select("fetch_id", F.col("ip").alias("peer_ip"))
    return checked.join(pairs, ["fetch_id", "peer_ip"], "left_anti").withColumn(
        "refusal",
        F.when(
            F.col("peer_ip").isNull(), F.lit("the connection's address could not be verified")
        ).otherwise(
            F.concat(
                F.lit("the connection went to "),
                F.col("peer_ip"),
                F.lit(", which this URL's policy did not validate"),
            )
        ),
    )
