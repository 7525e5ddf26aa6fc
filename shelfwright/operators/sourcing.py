"""Which URLs may be used as sources: safety of the address, kind of the site, policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import domain_rows

POLICIES = ("manufacturer_only", "allow_distributors", "warn_only", "allow_all")
# Second-level names under country domains; ports and networks that no source is fetched from.
SECOND_LEVEL = "co com net org gov edu ac or ne".split()
PORTS = [22, 23, 25, 110, 143, 445, 465, 587, 993, 995, 1433, 1521, 3306, 5432, 6379, 9200, 11211, 27017, 2375, 2376, 10250]
NETWORKS = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 255.255.255.255/32".split()
NETWORKS_6 = "::/128 ::1/128 64:ff9b::/96 100::/64 2001:db8::/32 fc00::/7 fe80::/10 ff00::/8".split()
LOCAL = ["localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback"]


def with_scheme(url: Column) -> Column:
    u = F.trim(url)
    return F.when(F.contains(u, F.lit("://")) | u.rlike(r"(?i)^(javascript|data|vbscript|file|mailto|tel|sms|about|blob|ftp|gopher|ldap|ws|wss):"), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: Column) -> Column:
    authority = F.regexp_extract(with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(authority), r"\.+$", "")


def registrable(host_name: Column) -> Column:
    """'www.amazon.co.uk' as 'amazon'."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(F.trim(host_name)), r"^www[0-9]?\.", ""), r"\."), lambda p: p != "")
    second = F.try_element_at(parts, F.lit(-2))
    return F.coalesce(F.when((F.size(parts) >= 3) & second.isin(SECOND_LEVEL), F.try_element_at(parts, F.lit(-3))), second, F.try_element_at(parts, F.lit(-1)), F.lit(""))


def ipv4_number(host_name: Column) -> Column:
    parts = F.split(host_name, r"\.")
    return F.when(host_name.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), sum((F.get(parts, F.lit(k)).cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0)))


def cidr_rows() -> list[tuple[str, int, int]]:
    import ipaddress

    return [(n, int(net.network_address), int(net.broadcast_address)) for n in NETWORKS for net in [ipaddress.ip_network(n)]]


def _odd_literals(pairs):
    """Refusals of addresses that are not dotted quads: short IPv4 forms, IPv6 with embedded IPv4."""
    import ipaddress
    import socket

    import pandas as pd

    blocked = [ipaddress.ip_network(n) for n in NETWORKS + NETWORKS_6]

    def one(text):
        if not text:
            return None
        try:
            address = ipaddress.ip_address(text.strip("[]").partition("%")[0]) if ":" in text else ipaddress.ip_address(socket.inet_aton(text))
        except (ValueError, OSError):
            return "unreadable address" if ":" in text else None
        address = getattr(address, "ipv4_mapped", None) or address
        return next((str(n) for n in blocked if n.version == address.version and address in n), None)

    for hosts in pairs:
        yield pd.Series([one(x) for x in hosts], dtype="object")


def url_safety(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host, port, safe, refusal``: the first reason that an address must not be fetched, from its text alone.

    Dotted quads meet the blocked networks in a range join with a small fixed table; other numeric forms and IPv6 go
    through one Arrow function that other rows skip.
    """
    full = with_scheme(F.col(url))
    u = urls.withColumns({"host": host(F.col(url)), "scheme": F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), "port": F.regexp_extract(full, r"^[^/]*//(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)", 1).try_cast("int")})
    u = u.withColumns({"ip": ipv4_number(F.col("host")), "credentials": full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")})
    nets = u.sparkSession.createDataFrame(cidr_rows(), "network string, lo long, hi long")
    first = F.min_by("network", "lo").alias("network")
    hit = u.select("ip").where("ip is not null").distinct().join(F.broadcast(nets), F.expr("ip between lo and hi")).groupBy("ip").agg(first)
    u = u.join(hit, "ip", "left")
    odd = F.col("host").rlike(r"^\[|:") | (F.col("ip").isNull() & F.col("host").rlike(r"^(0x[0-9a-f]+|[0-9]+)(\.(0x[0-9a-f]+|[0-9]+)){0,3}$"))
    asked = u.select(F.col("host").alias("odd_host")).where(F.coalesce(F.col("host").rlike(r"^\[|:") | F.col("host").rlike(r"^(0x[0-9a-f]+|[0-9]+)(\.(0x[0-9a-f]+|[0-9]+)){0,3}$"), F.lit(False))).distinct()
    judged = asked.withColumn("odd_network", F.pandas_udf(_iterator(_odd_literals), "string")(F.col("odd_host")))
    u = u.join(judged, u["host"] == judged["odd_host"], "left")
    refusal = (
        F.when(F.trim(F.coalesce(F.col(url), F.lit(""))) == "", "empty").when(~F.col("scheme").isin("http", "https"), "scheme not allowed").when(F.col("credentials"), "credentials in the address").when(F.col("host") == "", "no host")
        .when(F.col("port").isin(PORTS) | (F.col("port") > 65535), "port not allowed").when(F.col("host").isin(LOCAL) | F.col("host").rlike(r"\.(local|internal|localhost)$"), "local host")
        .when(F.col("network").isNotNull(), F.concat(F.lit("blocked network "), F.col("network"))).when(odd & F.col("odd_network").isNotNull(), F.concat(F.lit("blocked network "), F.col("odd_network")))
    )
    return u.withColumns({"refusal": refusal, "safe": refusal.isNull()}).select(*urls.columns, "host", "port", "safe", "refusal")


def _iterator(f):
    import pandas as pd
    from collections.abc import Iterator

    def judge(hosts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from f(hosts)

    judge.__annotations__ = {"hosts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return judge


def policy(urls: DataFrame, chosen: str = "manufacturer_only", approved: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Adds ``host, registrable, category, allowed, reason, needs_review``. ``approved`` (``registrable``) overrides the categories.

    Addresses that are not safe are never allowed.
    """
    chosen = chosen if chosen in POLICIES else "manufacturer_only"
    d = F.broadcast(urls.sparkSession.createDataFrame(domain_rows(), "registrable string, category string"))
    u = url_safety(urls, url).withColumn("registrable", registrable(F.col("host"))).join(d, "registrable", "left").withColumn("category", F.when(~F.col("safe"), "unfetchable").otherwise(F.coalesce("category", F.lit("unknown"))))
    blocked = F.col("category").isin("marketplace", "distributor", "encyclopedia", "community")
    listed = F.lit(None).cast("boolean")
    if approved is not None:
        names = approved.select("registrable").distinct().withColumn("listed", F.lit(True))
        u = u.join(names, "registrable", "left")
        listed = F.coalesce("listed", F.lit(False))
    free = chosen in ("warn_only", "allow_all")
    distributor_ok = F.lit(chosen == "allow_distributors") & (F.col("category") == "distributor")
    reason = (
        F.when(~F.col("safe"), F.concat(F.lit("not fetchable: "), F.col("refusal"))).when(F.coalesce(listed, F.lit(False)), "on the approved list").when(F.lit(not free) & ~F.coalesce(listed, F.lit(True)), "not on the approved list")
        .when(F.lit(chosen == "allow_all"), "no restriction").when(F.lit(chosen == "warn_only") & blocked, "permitted with a warning").when(F.lit(chosen == "warn_only"), "permitted")
        .when(F.col("category") == "manufacturer", "manufacturer").when(distributor_ok, "distributor permitted by policy").when(blocked, F.concat(F.col("category"), F.lit(" not permitted"))).otherwise("not verified as a manufacturer")
    )
    allowed = F.col("safe") & F.when(F.coalesce(listed, F.lit(False)), True).when(F.lit(not free) & ~F.coalesce(listed, F.lit(True)), False).otherwise(F.lit(free) | ~blocked | distributor_ok)
    sure = F.coalesce(listed, F.lit(False)) | F.lit(chosen == "allow_all") | (F.lit(chosen == "warn_only") & ~blocked) | ((F.col("category") == "manufacturer") & F.coalesce(listed, F.lit(True)))
    return u.withColumns({"reason": reason, "allowed": allowed, "needs_review": ~(F.col("safe") & sure)}).select(*urls.columns, "host", "registrable", "category", "allowed", "reason", "needs_review")


def approved_domains(lines: DataFrame) -> DataFrame:
    """``value`` lines of an allow-list, # comments dropped -> ``registrable``."""
    text = F.lower(F.trim(F.regexp_replace("value", "#.*$", "")))
    return lines.select(registrable(host(text)).alias("registrable")).where("registrable <> ''").distinct()
