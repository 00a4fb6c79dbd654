"""The row schema of parsed packet-filter lines.

All parsed fields are strings. NULL means that a row has no such field; '' that it has the
field, empty or cut short.
"""

from __future__ import annotations

# Field names and their positions in the comma-separated payload.
COMMON = {"rulenr": 0, "subrulenr": 1, "anchorname": 2, "rid": 3, "interface": 4, "reason": 5, "action": 6, "dir": 7, "ipversion": 8}
IPV4 = {"tos": 9, "ecn": 10, "ttl": 11, "id": 12, "offset": 13, "ipflags": 14, "protonum": 15, "protoname": 16, "length": 17, "src": 18, "dst": 19}
PORTS = {"srcport": 20, "dstport": 21, "datalen": 22}
TCP = {"tcpflags": 23, "seq": 24, "ack": 25, "urp": 26, "tcpopts": 27}

# Protocol numbers with names of their own.
PROTOCOLS = {"6": "tcp", "17": "udp", "1": "icmp", "112": "carp"}

#: Fields in export order, with the derived ones.
PARSED = [*COMMON, *IPV4, *PORTS, *TCP]
META = ["__timestamp__", "__host__", "__digest__"]
EXPORTED = [*PARSED, "interface_display", *META]

#: The host that every row names: the log holds one firewall's lines, and callers say which.
DEFAULT_HOST = "firewall"

# Table columns, page sizes and presets.
TABLE = ["timestamp", "action", "interface", "src", "srcport", "dst", "dstport", "protoname", "label"]
PAGE_SIZES = [100, 500, 1000, 2000, 5000]
DEFAULT_PAGE = 1000
TAIL_LINES = 2000
PRESETS = {"all": None, "blocked": ("action", "block"), "allowed": ("action", "pass"), "tcp": ("protoname", "tcp"), "udp": ("protoname", "udp")}

#: Display names of fields, as filters accept them.
FIELD_NAMES = {
    "Action": "action",
    "Interface": "interface",
    "Source IP": "src",
    "Source Port": "srcport",
    "Destination IP": "dst",
    "Destination Port": "dstport",
    "Protocol": "protoname",
    "Label": "__label__",
    "Timestamp": "timestamp",
}


def field_name(shown: str) -> str:
    """The field that a display name means; any other text is a field's own name."""
    return FIELD_NAMES.get(shown, shown.lower())
