"""Operators over URLs: admission, keys, redirects, address screen, agreement."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import urls as u

#: Address blocks that no source may resolve to.
BLOCKS_V4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
BLOCKS_V6 = ["::/8", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "ff00::/8"]
MAX_HOPS = 2


def admit_urls(df: DataFrame, col: str) -> DataFrame:
    """df with admitted, reason (first failing rule, unsafe_query last), safe_href and removed (tracking parameters)."""
    c = F.col(col)
    names = F.transform(u.parameters(c), lambda x: F.substring_index(x, "=", 1))
    reason = F.coalesce(u.refusal(c), F.when(F.exists(names, u.secret_name), "unsafe_query"))
    d = df.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())
    return d.withColumn("safe_href", F.when(F.col("admitted"), u.safe_href(c))).withColumn(
        "removed", F.when(F.col("admitted"), F.size(u.parameters(c)) - F.size(u.kept_parameters(c))))


def flag_sensitive_query(df: DataFrame, col: str) -> DataFrame:
    """df with sensitive: some query name tells of a secret, or cannot be read as plain ASCII."""
    names = F.transform(u.parameters(F.col(col)), lambda x: F.substring_index(x, "=", 1))
    return df.withColumn("sensitive", F.exists(names, u.secret_name))


def url_keys(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    return df.withColumns({
        "safe_href": F.when(u.refusal(c).isNull(), u.safe_href(c)), "attributable_key": u.attributable_key(c), "canonical_page": u.canonical_page(c),
        "conflict_page_key": u.conflict_page_key(c), "publisher_domain": u.publisher_domain(c),
    })


def urls_agree(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with agree: both URLs are admitted and are the same page to read."""
    ok = u.refusal(F.col(a)).isNull() & u.refusal(F.col(b)).isNull()
    return df.withColumn("agree", F.coalesce(ok & (u.safe_href(F.col(a)) == u.safe_href(F.col(b))), F.lit(False)))


def resolve_redirects(start: DataFrame, edges: DataFrame) -> DataFrame:
    """start (url, ...) with final_url and hops after at most MAX_HOPS redirects, or a code: every target is admitted
    again, a page seen before is a loop, a further hop is over the limit. edges: from_url, to_url, one a page."""
    d = start.withColumns({"__at": F.col("url"), "__seen": F.array("url"), "hops": F.lit(0), "code": F.lit(None).cast("string")})
    for hop in range(MAX_HOPS + 1):
        e = edges.select(F.col("from_url").alias("__at"), F.col("to_url").alias("__to"))
        d = d.join(e, "__at", "left")
        on = F.col("__to").isNotNull() & F.col("code").isNull() & (F.col("hops") == hop)
        code = (
            F.when(F.lit(hop == MAX_HOPS), "redirect_limit").when(u.refusal(F.col("__to")).isNotNull(), "redirect_rejected")
            .when(F.array_contains("__seen", u.safe_href(F.col("__to"))), "redirect_loop")
        )
        d = d.withColumn("code", F.when(on, code).otherwise(F.col("code")))
        go = on & F.col("code").isNull()
        d = d.withColumns({
            "__at": F.when(go, u.safe_href(F.col("__to"))).otherwise(F.col("__at")), "hops": F.col("hops") + go.cast("int"),
            "__seen": F.when(go, F.array_append("__seen", u.safe_href(F.col("__to")))).otherwise(F.col("__seen")),
        }).drop("__to")
    done = F.col("code").isNull()
    return d.withColumn("final_url", F.when(done, F.col("__at"))).withColumn("hops", F.when(done, F.col("hops"))).drop("__at", "__seen")


@F.pandas_udf(T.StringType())
def _packed(address: pd.Series) -> pd.Series:
    """An address as sortable text: family and fixed-width hex; null if it is none. A mapped IPv4 address is an IPv6 one."""

    def one(a):
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return None
        return f"{ip.version}:{int(ip):032x}"

    return address.map(one, na_action="ignore")


def blocks(spark) -> DataFrame:
    rows = [(f"{n.version}:{int(n[0]):032x}", f"{n.version}:{int(n[-1]):032x}") for n in map(ipaddress.ip_network, BLOCKS_V4 + BLOCKS_V6)]
    return spark.createDataFrame(rows, "low string, high string")


def screen_hosts(answers: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """(host, n_answers, public, address): public if no answer is unreadable, of another family than declared, in a reserved
    block or outside 2000::/3; address is the smallest by value then, IPv4 first. answers: host, address, family if declared.

    The blocks are a fixed table of under 40 rows, sent to every task for the range join.
    """
    reserved = blocks(answers.sparkSession) if reserved is None else reserved
    family = F.col("family").cast("string") if "family" in answers.columns else F.substring("ip", 1, 1)
    a = answers.withColumn("ip", _packed("address")).select("host", "address", "ip", family.alias("family"))
    readable = F.coalesce(F.substring("ip", 1, 1) == F.col("family"), F.lit(False))
    # IPv6 addresses outside the global unicast block are refused, so reserved blocks outside it need no row
    global_ip = F.col("ip").startswith("4:") | F.col("ip").rlike("^6:[23]")
    j = a.join(F.broadcast(reserved), (F.col("ip") >= F.col("low")) & (F.col("ip") <= F.col("high")), "left")
    ok = readable & F.col("low").isNull() & global_ip
    n = a.groupBy("host").agg(F.count("*").alias("n_answers"))
    hosts = j.groupBy("host").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("public"), F.min_by("address", "ip").alias("address"))
    return n.join(hosts, "host").select("host", "n_answers", "public", F.when(F.col("public"), F.col("address")).alias("address"))
