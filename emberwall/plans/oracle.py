"""The SQL side of the catalogue: what the synthetic lines parse to, straight from the events table."""

from __future__ import annotations

from ..schema import COMMON, IPV4, PARSED, PORTS, TCP

_NUMBER = """CASE WHEN event_id % 13 = 0 THEN '112' WHEN event_id % 17 = 0 THEN '2'
    WHEN event_type = 'view' THEN '17' WHEN event_type = 'signup' THEN '1' ELSE '6' END"""

#: Every field as the line has it, before any rule of the parser.
_RAW = {
    "rulenr": "CAST(event_id % 97 AS VARCHAR)",
    "subrulenr": "''",
    "anchorname": "''",
    "rid": "md5(CAST(event_id % 7 AS VARCHAR))",
    "interface": "concat('vtnet', CAST(user_id % 3 AS VARCHAR))",
    "reason": "'match'",
    "action": "CASE WHEN event_type = 'error' THEN 'block' ELSE 'pass' END",
    "dir": "CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END",
    "ipversion": "CASE WHEN event_id % 11 = 0 THEN '6' ELSE '4' END",
    "tos": "'0x0'",
    "ecn": "''",
    "ttl": "'64'",
    "id": "CAST(event_id % 65536 AS VARCHAR)",
    "offset": "'0'",
    "ipflags": "'DF'",
    "protonum": _NUMBER,
    "protoname": "'x'",
    "length": "'60'",
    "src": "concat('10.0.', CAST(user_id % 256 AS VARCHAR), '.', CAST(event_id % 256 AS VARCHAR))",
    "dst": "concat('192.168.', CAST(user_id % 4 AS VARCHAR), '.', CAST(event_id % 200 AS VARCHAR))",
    "srcport": "CAST(1024 + event_id % 60000 AS VARCHAR)",
    "dstport": "CASE event_id % 5 WHEN 0 THEN '80' WHEN 1 THEN '443' WHEN 2 THEN '22' WHEN 3 THEN '8085' ELSE '53' END",
    "datalen": "'0'",
    "tcpflags": "'S'",
    "seq": "CAST(event_id AS VARCHAR)",
    "ack": "''",
    "urp": "'64240'",
    "tcpopts": "''",
}
_LINE = (
    "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), ' Informational filterlog ', "
    + ", ',', ".join(_RAW[n] for n in PARSED)
    + ", ',', 'mss;nop')"
)


def _field(name: str) -> str:
    v4, ports = "event_id % 11 <> 0", f"event_id % 11 <> 0 AND {_NUMBER} IN ('6', '17')"
    tcp = f"event_id % 11 <> 0 AND {_NUMBER} = '6'"
    if name in COMMON:
        return _RAW[name]
    condition = v4 if name in IPV4 else ports if name in PORTS else tcp
    value = f"CASE {_NUMBER} WHEN '6' THEN 'tcp' WHEN '17' THEN 'udp' WHEN '1' THEN 'icmp' WHEN '112' THEN 'carp' ELSE {_NUMBER} END" if name == "protoname" else _RAW[name]
    assert name in COMMON or name in IPV4 or name in PORTS or name in TCP
    return f"CASE WHEN {condition} THEN {value} END"


#: l: one row for each accepted line.
WITH_L = (
    "WITH l AS (SELECT event_id, date_trunc('second', ts) AS ts, "
    + ", ".join(f"{_field(n)} AS \"{n}\"" for n in PARSED)
    + f", {_LINE} AS raw_line FROM events WHERE event_id % 50 <> 0)"
)
