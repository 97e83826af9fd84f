"""Small column functions: sizes and durations for people, on/off words, colours, natural order, file name patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for on and off in settings.
ON, OFF = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


def readable_bytes(n: Column) -> Column:
    """1023 B, 1.0 KB, 2.5 MB ..."""
    out = F.concat(F.round(n, 0).cast("bigint").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def readable_seconds(n: Column) -> Column:
    """45 s, 3 min, 2 h 5 min"""
    minutes = F.floor(n / 60)
    hours = F.concat(F.floor(n / 3600).cast("string"), F.lit(" h "), F.floor(F.pmod(n, F.lit(3600)) / 60).cast("string"), F.lit(" min"))
    return F.when(n < 60, F.concat(F.round(n, 0).cast("bigint").cast("string"), F.lit(" s"))).when(n < 3600, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(hours)


def switched(value: Column) -> Column:
    """A setting's word as true, false or NULL."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*ON), True).when(v.isin(*OFF), False)


def colour(value: Column) -> Column:
    """#RRGGBB of a number that holds blue, green and red from its high byte down."""
    n = value.try_cast("bigint")
    part = lambda shift: F.lpad(F.hex(F.shiftright(n, shift).bitwiseAND(255)), 2, "0")
    return F.when(n.isNotNull(), F.concat(F.lit("#"), part(0), part(8), part(16)))


def natural(value: Column) -> list[Column]:
    """Sort keys: numbers first, by value, then texts."""
    n = value.try_cast("bigint")
    return [n.isNull().asc(), n.asc(), value.asc()]


def short(value: Column, width: int) -> Column:
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width - 1), F.lit("…"))).otherwise(value)


def glob_pattern(glob: str) -> str:
    """A regular expression for a file pattern: * within a folder, ** across folders, ? one character, {a,b} either."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
            continue
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        depth += (c == "{") - (c == "}")
        out.append({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c, "|" if c == "," and depth else re.escape(c)))
        at += 1
    return "^" + "".join(out) + "$"
