"""IP addresses: one key for both families, networks, masks, the client behind proxies."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Prefix kept by level of masking: level -> (IPv4 bits, IPv6 bits). Fixed values.
MASK_BITS = {1: (24, 48), 2: (16, 32), 3: (8, 16), 4: (0, 0)}
_V4 = "^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
_V6 = "^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|^(?!.*[0-9a-f]{5})(?!.*::.*::)(?!.*:::)(?=.*::)(?!:[^:])(?!.*[^:]:$)[0-9a-f:]+$"
#: An IPv4 address's key has this before its 8 hexadecimal digits (it is the address mapped into IPv6).
V4_PREFIX = "0" * 20 + "ffff"
_GROUPS = "filter(split({part}, ':'), x -> x <> '')"
_HEX = "array_join(transform({groups}, x -> lpad(x, 4, '0')), '')"

#: SQL functions of this module: name -> parameters, result, body. Spark inlines them.
SQL_FUNCTIONS = {
    "ip_hex": (
        "ip string",
        "string",
        f"""case
          when ip rlike '{_V4}' then '{V4_PREFIX}' || array_join(transform(split(ip, '[.]'), x -> lpad(lower(hex(cast(x as int))), 2, '0')), '')
          when lower(ip) rlike '{_V6}' and contains(ip, '::') and size({_GROUPS.format(part="lower(ip)")}) <= 7 then {_HEX.format(groups=_GROUPS.format(part="substring_index(lower(ip), '::', 1)"))}
            || repeat('0', 32 - 4 * size({_GROUPS.format(part="lower(ip)")})) || {_HEX.format(groups=_GROUPS.format(part="substring_index(lower(ip), '::', -1)"))}
          when lower(ip) rlike '{_V6}' and not contains(ip, '::') then {_HEX.format(groups=_GROUPS.format(part="lower(ip)"))} end""",
    ),
    # Whole hexadecimal digits of the prefix are compared as text, the bits left over as a number.
    "hex_in_network": (
        "a string, net string, bits int",
        "boolean",
        """left(a, bits div 4) = left(net, bits div 4)
          and shiftright(cast(conv(substring(a, bits div 4 + 1, 1), 16, 10) as int), 4 - bits % 4) <=> shiftright(cast(conv(substring(net, bits div 4 + 1, 1), 16, 10) as int), 4 - bits % 4)""",
    ),
    "in_cidr": (
        "ip string, net string",
        "boolean",
        """coalesce(contains(ip, ':') = contains(net, ':') and hex_in_network(ip_hex(ip), ip_hex(substring_index(net, '/', 1)),
          cast(substring_index(net, '/', -1) as int) + if(contains(net, ':'), 0, 96)), false)""",
    ),
}


def register(spark: SparkSession) -> None:
    """Make ip_hex(ip) and in_cidr(ip, network) known to the session, as temporary SQL functions."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")


def ip_key(ip: Column) -> Column:
    """32 hexadecimal digits, which sort as the addresses do; null for what is no address (or IPv6 with an IPv4 tail)."""
    register(SparkSession.active())
    return F.call_function("ip_hex", ip)


def in_cidr(ip: Column, cidr: str) -> Column:
    """Is the address in the network (of its own family)?"""
    ipaddress.ip_network(cidr, strict=False)
    register(SparkSession.active())
    return F.call_function("in_cidr", ip, F.lit(cidr))


def ipv4_number(ip: Column) -> Column:
    """The address as a bigint; null if it isn't dotted IPv4."""
    part = lambda i: F.get(F.split(ip, r"\."), F.lit(i)).cast("bigint")
    return F.when(ip.rlike(_V4), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def mask_ip(ip: Column, level: int) -> Column:
    """With the host part zeroed; unparseable addresses and unknown levels stay as they are."""
    if level not in MASK_BITS:
        return ip
    four, six = MASK_BITS[level]
    kept = four // 8
    parts = F.concat(F.slice(F.split(ip, "[.]"), 1, kept), F.array_repeat(F.lit("0"), 4 - kept))

    @F.pandas_udf("string")
    def masked(addresses: pd.Series) -> pd.Series:
        def one(a):
            try:
                return str(ipaddress.ip_network(f"{a}/{six}", strict=False).network_address)
            except ValueError:
                return a

        return addresses.map(one)

    return F.when(ip.rlike(_V4), F.array_join(parts, ".")).when(F.contains(ip, F.lit(":")), masked(ip)).otherwise(ip)


def real_ip(headers: Column, peer: Column, trusted: Column) -> Column:
    """Client address behind a trusted proxy, else the peer's."""
    get = lambda name: F.nullif(F.get(F.try_element_at(headers, F.lit(name)), F.lit(0)), F.lit(""))
    forwarded = F.get(F.filter(F.transform(F.split(F.coalesce(get("X-Forwarded-For"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return F.when(trusted, F.coalesce(get("X-Real-IP"), get("X-Client-IP"), get("CF-Connecting-IP"), get("True-Client-IP"), forwarded, peer)).otherwise(peer)
