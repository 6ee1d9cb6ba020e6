"""Numbers, sizes, times and options as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

K, M, G = 1 << 10, 1 << 20, 1 << 30


def pretty_number(n: Column) -> Column:
    """With a suffix; thousands of the larger ones are set off by a comma, in steps of 1000 units of 1024."""
    part = lambda unit: F.lpad(((n / unit).cast("long") % 1000).cast("string"), 3, "0")
    whole = lambda unit: (n / unit).cast("long").cast("string")
    return (
        F.when(n > 1000 * G, F.concat(whole(G), F.lit("G")))
        .when(n > G, F.concat(whole(1000 * M), F.lit(","), part(M), F.lit("M")))
        .when(n > M, F.concat(whole(1000 * K), F.lit(","), part(K), F.lit("K")))
        .when(n > K, F.concat(whole(K), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def pretty_size(n: Column) -> Column:
    return F.when(n > M, F.format_string("%.2fM", n / M)).when(n > K, F.format_string("%.0fK", n / K)).otherwise(n.cast("string"))


def pretty_time(seconds: Column) -> Column:
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(seconds % 86400 / 3600), two(seconds % 3600 / 60), two(seconds % 60))
    days = F.floor(seconds / 86400).cast("string")
    return F.when(seconds > 2 * 86400, F.concat(days, F.lit(" days "), clock)).when(seconds > 86400, F.concat(F.lit("1 day "), clock)).when(seconds >= 0, clock).otherwise("n/a")


def days_between(start: Column, end: Column) -> Column:
    """Calendar days from one time in seconds to another, in the session's time zone."""
    day = lambda t: F.to_date(F.timestamp_seconds(t))
    return F.datediff(day(end), day(start))


def parse_size(text: str) -> int:
    """``64k`` or ``4m`` in bytes; 0 if it isn't a size."""
    m = re.fullmatch(r"([0-9]+)([mk])?", text.lower())
    return int(m[1]) * {"m": M, "k": K, None: 1}[m[2]] if m else 0


def parse_retention(texts: list[str]) -> list[tuple[int, int]]:
    """``interval:age`` policies as (age, interval) in days, in the order given."""
    out = []
    for t in texts:
        m = re.fullmatch(r"([0-9]+):([0-9]+)", t)
        if not m or int(m[2]) < 1:
            raise ValueError(f"invalid retention policy {t!r}")
        out.append((int(m[2]), int(m[1])))
    return out


def parse_revisions(texts: list[str]) -> list[int]:
    """Revisions ``n`` and ranges ``a-b`` with b over a."""
    out = []
    for t in texts:
        if m := re.fullmatch(r"([0-9]+)-([0-9]+)", t):
            if int(m[2]) <= int(m[1]):
                raise ValueError(f"invalid revision range {t!r}")
            out += range(int(m[1]), int(m[2]) + 1)
        elif t.isdigit():
            out.append(int(t))
        else:
            raise ValueError(f"invalid revision {t!r}")
    return out


def parse_erasure(text: str) -> tuple[int, int]:
    """``data:parity`` shards."""
    m = re.fullmatch(r"([0-9]+):([0-9]+)", text)
    if not m or not 1 <= int(m[2]) <= int(m[1]) <= 256:
        raise ValueError(f"invalid erasure coding {text!r}")
    return int(m[1]), int(m[2])
