"""IPv4 addresses and networks as numbers."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"


def ipv4_number(c: Column) -> Column:
    """The address as a number; NULL for anything that isn't a plain dotted quad (leading zeros are none)."""
    part = lambda k: F.regexp_extract(c, ADDRESS, k).cast("long")
    return F.when(c.rlike(ADDRESS), ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def network_range(item: str) -> tuple[int, int, int] | None:
    """(lowest, highest, prefix length) of an IPv4 network, host bits allowed; None if it isn't one."""
    try:
        net = ipaddress.ip_network(item, strict=False)
    except ValueError:
        return None
    if net.version != 4:
        return None
    return int(net.network_address), int(net.broadcast_address), net.prefixlen
