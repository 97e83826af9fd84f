"""Log lines grouped by what went wrong: one definition for batch and stream.

A line loses its prefix and becomes a row of lower-case words; which words it holds tells its kind, and words and comma-separated
parts at known places give the script, resource or plugin it names, its message and its tag. Its group is the kind, what it names,
and the message without numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.operators.text import mask

MAX_LINE, MAX_TAGS = 2048, 10
#: Words that tell failures and troubles, and what was tried in vain.
FAULTS, TROUBLES = ("error", "exception", "fatal", "assert", "exowarning"), ("warn", "warning")
TRIED, IN_VAIN = ("find", "load", "open", "locate", "demand"), ("failed", "unable", "cannot", "couldn", "not")
#: How the part of a line begins that tells what happened.
VERDICTS = ("ERROR", "WARNING", "SCRIPT_ABORT")


def _has(words: Column, *some: str) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(x) for x in some]))


def _after(words: Column, word: str) -> Column:
    """The word that follows the first ``word``."""
    return F.get(words, F.array_position(words, F.lit(word)).cast("int"))


def _first_of(words: Column, some: tuple[str, ...]) -> Column:
    return F.get(F.filter(words, lambda x: x.isin(*some)), F.lit(0))


def _from(text: Column, part: Column) -> Column:
    """``text`` from where ``part`` begins, letter case aside."""
    return F.substring(text, F.position(F.lower(part), F.lower(text)), F.lit(MAX_LINE))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _judged(ts: Column, body: Column, words: Column) -> Column:
    """A struct of what a line without its prefix tells; its kind is NULL if it tells of no trouble."""
    parts = F.split(body, r",\s*")
    one = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    named = F.get(F.filter(words, lambda x: x.rlike(r"^[\w\-]{1,32}\.[a-z0-9]{3}$")), F.lit(0))  # the first word that is a file's name
    verdict = F.get(F.filter(parts, lambda x: F.rtrim(F.substring_index(x, ":", 1)).isin(*VERDICTS)), F.lit(0))
    fault = F.coalesce(_first_of(words, FAULTS), _first_of(words, TROUBLES))
    tag = F.trim(F.substring(F.get(F.filter(parts, lambda x: x.startswith("Tag:")), F.lit(0)), 5, MAX_LINE))
    script = F.when(_after(words, "script") == "error", _after(words, "error")).otherwise(_after(words, "script"))
    gone = (_has(words, *TRIED) & _has(words, *IN_VAIN) & named.isNotNull()) | (_has(words, "resource", "resref") & (_has(words, "missing") | (_has(words, "not") & _has(words, "found"))))
    told = _from(body, F.coalesce(verdict, fault))
    tells = lambda kind, subject, message: F.struct(F.lit(kind).alias("kind"), F.coalesce(subject, F.lit("")).alias("subject"), message.alias("message"))
    case = (
        F.when(one.endswith(".nss") & _has(words, "error"), tells("compile_error", F.substring_index(one, ".nss", 1), told))
        .when(_has(words, "script") & _has(words, "took") & _has(words, "error"), tells("script_stopped", _after(words, "script"), _after(words, "error")))
        .when(_has(words, "script") & _has(words, "error"), tells("script_error", script, told))
        .when(gone, tells("missing_resource", F.coalesce(named, _after(words, "resource"), _after(words, "resref")), body))
        .when(one.startswith("nwnx_") & fault.isNotNull(), tells("nwnx", one, told))
        .when(_has(words, *FAULTS), tells("error", F.lit(""), told))
        .when(_has(words, *TROUBLES), tells("warning", F.lit(""), told))
    )
    severity = lambda c: F.when(c["kind"] == "warning", "warning").otherwise("error")
    return _let(case, lambda c: F.struct(ts.alias("ts"), c["kind"].alias("kind"), c["subject"].alias("subject"), c["message"].alias("message"), F.nullif(tag, F.lit("")).alias("tag"), severity(c).alias("severity")))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with ts, kind, subject, message, tag and severity; lines that tell of no trouble are left out.

    A prefix is a time in brackets, perhaps after a letter for the level and before an origin in parentheses. NULL, blank and
    talk lines (a bracket that begins with CHAT) match nothing; a line is cut to MAX_LINE characters.
    """
    talk = r"^(?:\[[^\]]*\] *)?\[CHAT"

    def stripped(opened: Column, head: Column, leveled: Column) -> Column:
        """The line without its prefix."""
        timed = head.rlike(r"\d:\d\d:\d\d")
        rest = F.when(timed, F.ltrim(F.substring(opened, F.length(head) + 3, F.lit(MAX_LINE)))).otherwise(opened)
        body = lambda r: F.when(leveled & r.rlike(r"^\w* ?\("), F.ltrim(F.substring(r, F.instr(r, ")") + 1, F.lit(MAX_LINE)), F.lit(": "))).otherwise(r)
        return _let(rest, lambda r: _let(body(r), lambda b: _let(F.filter(F.split(F.lower(b), r"[^\w.\-]+"), lambda x: x != ""), lambda w: _judged(F.when(timed, head), b, w))))

    def opened(raw: Column) -> Column:
        leveled = raw.rlike(r"^[A-Z] \[")
        start = F.when(leveled, F.substring(raw, 3, MAX_LINE)).otherwise(raw)
        head = lambda o: F.when(o.startswith("["), F.substring_index(F.substring(o, 2, MAX_LINE), "]", 1)).otherwise(F.lit(""))
        return _let(start, lambda o: _let(head(o), lambda h: stripped(o, h, leveled)))

    judged = _let(F.substring(F.trim(column), 1, MAX_LINE), opened)
    d = lines.where(F.col(column).rlike(r"\S") & ~F.trim(column).rlike(talk))
    return d.select("*", F.inline(F.filter(F.array(judged), lambda x: x["kind"].isNotNull())))


KEY = ("kind", "subject", "signature", "severity")


def keyed(parsed: DataFrame) -> DataFrame:
    """Parsed lines with the signature of their group; missing tables of one name are one group."""
    return parsed.withColumn("signature", F.when(F.col("subject").endswith(".2da"), F.lit("")).otherwise(mask(F.col("message"))))


def group(parsed: DataFrame, order: str) -> DataFrame:
    """(kind, subject, signature, severity, count, first_seen, last_seen, example, tags): one row per group of a batch.

    ``order`` is the column that tells the lines' order of arrival. Up to MAX_TAGS tags are listed, the first to come first:
    tags are made distinct and limited before they are gathered, so that no list grows with the lines.
    """
    k = keyed(parsed)
    sums = k.groupBy(*KEY).agg(F.count("*").alias("count"), F.min_by("ts", order).alias("first_seen"), F.max_by("ts", order).alias("last_seen"), F.min_by("message", order).alias("example"))
    tags = k.where("tag IS NOT NULL").groupBy(*KEY, "tag").agg(F.min(order).alias("at"))
    tags = tags.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("at", "tag"))).where(F.col("place") <= MAX_TAGS)
    lists = tags.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias("tags"))
    return sums.join(lists, list(KEY), "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


GROUPS = "kind string, subject string, signature string, severity string, count bigint, first_seen string, last_seen string, example string, tags array<string>"
_STATE = "count bigint, first_seen string, last_seen string, example string, tags array<string>"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    count, first, last, example, tags = state.get if state.exists else (0, None, None, None, [])
    tags = list(tags)
    for f in frames:
        f = f.sort_values("seq", kind="stable") if "seq" in f else f
        if not count:
            first, example = f["ts"].iloc[0], f["message"].iloc[0]
        count += len(f)
        times = f["ts"].dropna()
        last = times.iloc[-1] if len(times) else last
        tags = list(dict.fromkeys([*tags, *f["tag"].dropna().unique()]))[:MAX_TAGS]
    state.update((count, first, last, example, tags))
    yield pd.DataFrame([(*key, count, first, last, example, tags)], columns=[*KEY, "count", "first_seen", "last_seen", "example", "tags"])


def group_stream(lines: DataFrame, column: str = "value") -> DataFrame:
    """The streaming twin, in update mode: a group is given out anew whenever lines join it.

    State per group is a count, two times, an example and at most MAX_TAGS tags; it doesn't grow with the lines. A column ``seq``,
    if there, orders the lines of a batch.
    """
    return keyed(parse(lines, column)).groupBy(*KEY).applyInPandasWithState(_advance, GROUPS, _STATE, "update", "NoTimeout")
