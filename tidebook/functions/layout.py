"""The feed's message layouts, and reading fields out of a binary body with JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of each message type, and the fields after the common header (name@offset:bytes:kind; kinds: a alpha, u unsigned).
HEADER = "type@0:1:a locate@1:2:u tracking@3:2:u ts_ns@5:6:u"
LAYOUTS = {
    "S": (12, "code@11:1:a"),
    "H": (25, "stock@11:8:a state@19:1:a reserved@20:1:a reason@21:4:a"),
    "h": (21, "stock@11:8:a market@19:1:a action@20:1:a"),
    "A": (36, "ref@11:8:u side@19:1:a shares@20:4:u stock@24:8:a price@32:4:u"),
    "F": (40, "ref@11:8:u side@19:1:a shares@20:4:u stock@24:8:a price@32:4:u mpid@36:4:a"),
    "E": (31, "ref@11:8:u shares@19:4:u match@23:8:u"),
    "C": (36, "ref@11:8:u shares@19:4:u match@23:8:u printable@31:1:a price@32:4:u"),
    "X": (23, "ref@11:8:u shares@19:4:u"),
    "D": (19, "ref@11:8:u"),
    "U": (35, "ref@11:8:u new_ref@19:8:u shares@27:4:u price@31:4:u"),
    "P": (44, "ref@11:8:u side@19:1:a shares@20:4:u stock@24:8:a price@32:4:u match@36:8:u"),
    "Q": (40, "shares@11:8:u stock@19:8:a price@27:4:u match@31:8:u cross_type@39:1:a"),
    "B": (19, "match@11:8:u"),
    "R": (39, "stock@11:8:a market_category@19:1:a financial_status@20:1:a round_lot@21:4:u round_lots_only@25:1:a issue_class@26:1:a issue_subtype@27:2:a authenticity@29:1:a short_sale_threshold@30:1:a ipo_flag@31:1:a luld_tier@32:1:a etp_flag@33:1:a etp_leverage@34:4:u inverse@38:1:a"),
    "Y": (20, "stock@11:8:a action@19:1:a"),
    "L": (26, "mpid@11:4:a stock@15:8:a primary@23:1:a mode@24:1:a state@25:1:a"),
    "V": (35, "level1@11:8:u level2@19:8:u level3@27:8:u"),
    "W": (12, "level@11:1:a"),
    "K": (28, "stock@11:8:a release_s@19:4:u qualifier@23:1:a ipo_price@24:4:u"),
    "J": (35, "stock@11:8:a reference_price@19:4:u upper_price@23:4:u lower_price@27:4:u extension@31:4:u"),
    "I": (50, "paired@11:8:u imbalance@19:8:u direction@27:1:a stock@28:8:a far_price@36:4:u near_price@40:4:u reference_price@44:4:u cross_type@48:1:a variation@49:1:a"),
    "N": (20, "stock@11:8:a interest@19:1:a"),
    "O": (48, "stock@11:8:a eligible@19:1:a lowest_price@20:4:u highest_price@24:4:u near_price@28:4:u near_time@32:8:u lower_price@40:4:u upper_price@44:4:u"),
}
LENGTHS = {t: n for t, (n, _) in LAYOUTS.items()}


def fields(spec: str) -> list[tuple[str, int, int, str]]:
    out = []
    for f in spec.split():
        name, rest = f.split("@")
        at, n, kind = rest.split(":")
        out.append((name, int(at), int(n), kind))
    return out


def read(body: Column, at: int, n: int, kind: str) -> Column:
    """One field: text without its trailing spaces, or a big-endian number as bigint (64 bits: the bit pattern)."""
    raw = F.substring(body, at + 1, n)
    if kind == "a":
        return F.rtrim(F.decode(raw, "US-ASCII"))
    if n < 8:
        return F.conv(F.hex(raw), 16, 10).cast("long")
    high, low = F.conv(F.hex(F.substring(body, at + 1, 4)), 16, 10).cast("long"), F.conv(F.hex(F.substring(body, at + 5, 4)), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def write(value: Column, n: int, kind: str) -> Column:
    """The same field as hexadecimal text."""
    if kind == "a":
        return F.hex(F.rpad(F.coalesce(value, F.lit("")), n, " ").cast("binary"))
    return F.lpad(F.hex(F.coalesce(value.cast("long"), F.lit(0).cast("long"))), 2 * n, "0")
