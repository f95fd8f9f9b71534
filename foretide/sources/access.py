"""Which sources may be read: the registry, and rules on addresses."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORBIDDEN = ("disabled", "forbidden", "unknown_terms")


@F.pandas_udf(T.BooleanType())
def internal_address(host: pd.Series) -> pd.Series:
    """Private, loopback, link-local, multicast or reserved (F16); a name that is no address is not."""

    def test(h: str | None) -> bool:
        try:
            a = ipaddress.ip_address((h or "").strip("[]"))
        except ValueError:
            return (h or "").lower() == "localhost"
        return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified

    return host.map(test)


def dissected(urls: DataFrame, column: str = "url") -> DataFrame:
    """scheme, host, port, userinfo, and whether its characters are allowed."""
    u = F.col(column)
    part = lambda p: F.try_parse_url(u, F.lit(p))
    port = F.nullif(F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1), F.lit("")).cast("int")
    return urls.withColumns({"scheme": F.lower(part("PROTOCOL")), "host": F.lower(part("HOST")), "port": port, "userinfo": part("USERINFO"), "clean": ~u.rlike(r"[\s\\<>\"']")})


def allowed_hosts(sources: DataFrame) -> DataFrame:
    """Each source's host and its www twin."""
    host = F.lower(F.try_parse_url("base_url", F.lit("HOST")))
    twin = F.when(host.startswith("www."), F.substring(host, 5, 1000)).otherwise(F.concat(F.lit("www."), host))
    return sources.withColumn("host", F.explode(F.array_distinct(F.array(host, twin)))).select("source_id", "host").filter("host IS NOT NULL")


def access(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """decision and reason: the first rule that applies (F14). Columns source_id, url."""
    hosts = allowed_hosts(sources).select("source_id", "host", F.lit(True).alias("listed"))
    rows = dissected(requests).join(sources.select("source_id", "enabled", "status"), "source_id", "left").join(hosts, ["source_id", "host"], "left")
    reason = (
        F.when(F.col("status").isNull(), "UNKNOWN_SOURCE").when(~F.col("enabled") | F.col("status").isin(*FORBIDDEN), "SOURCE_DISABLED").when(F.col("host").isNull() | ~F.col("clean"), "BAD_URL")
        .when(F.col("scheme") != "https", "NOT_HTTPS").when(F.col("userinfo").isNotNull(), "USERINFO").when(F.col("port").isNotNull() & (F.col("port") != 443), "PORT")
        .when(internal_address(F.col("host")), "INTERNAL_ADDRESS").when(F.col("listed").isNull(), "HOST_NOT_LISTED")
    )
    decision = F.when(F.col("reason").isNull(), "ALLOW").when(F.col("reason") == "UNKNOWN_SOURCE", "UNKNOWN").otherwise("DENY")
    return rows.withColumn("reason", reason).withColumn("decision", decision)


def eligible(sources: DataFrame, capability: str, allow: tuple[str, ...] = ("true",)) -> DataFrame:
    """Enabled sources with a capability (F11, F12, Z12): `partial` and `unknown` only where asked for, `false` never."""
    has = F.coalesce(F.element_at("capabilities", F.lit(capability)), F.lit("unknown"))
    return sources.filter(F.col("enabled") & ~F.col("status").isin(*FORBIDDEN) & has.isin(*allow) & (has != "false"))


def rejections(sources: DataFrame, capability: str) -> DataFrame:
    """Why each of the others was not chosen."""
    has: Column = F.coalesce(F.element_at("capabilities", F.lit(capability)), F.lit("unknown"))
    reasons = F.array_compact(F.array(F.when(~F.col("enabled"), "DISABLED"), F.when(F.col("status").isin(*FORBIDDEN), "STATUS"), F.when(has != "true", F.concat(F.lit("CAPABILITY_"), F.upper(has)))))
    return sources.select("source_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)
