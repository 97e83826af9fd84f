"""Search, linking and rewriting over texts and field values, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line, body): numbered lines of every text, from 1; NULL texts have none."""
    return df.select(id_col, F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("line", "body")).withColumn("line", F.col("line") + 1)


def grep(df: DataFrame, id_col: str, text: str, pattern: str) -> DataFrame:
    """Lines that match a regular expression; the whole text is tested first, so that others are never split."""
    return lines(df.where(F.col(text).rlike(pattern)), id_col, text).where(F.col("body").rlike(pattern))


def tokens(text: Column, pattern: str = "[a-z0-9_-]{3,32}") -> Column:
    """The distinct name-like tokens of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1)))


def link_names(texts: DataFrame, id_col: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(id, name): texts that hold a known name as a token. Distinct pairs; an equi-join on the token, which AQE splits if hot."""
    t = texts.select(id_col, F.explode(tokens(F.col(text))).alias("token"))
    n = names.select(F.lower(name).alias("token")).distinct()
    return t.join(n, "token", "left_semi").select(id_col, F.col("token").alias("name"))


def mask(text: Column, width: int = 160) -> Column:
    """A text's signature: hexadecimal and whole numbers become a mark, the rest stays, up to ``width`` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(text, r"0x\p{XDigit}+", "#"), r"\p{Digit}+", "#"), F.lit(width))


def replace_plan(values: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Rows of ``values`` that hold the whole word ``old``, with ``after``; nothing is changed yet. ``old`` and ``new`` are taken as
    they are, whatever signs they hold."""
    word = "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in old)
    put = new.replace("\\", "\\\\").replace("$", "\\$")
    pattern = rf"(?i)(^|[^A-Za-z0-9_]){word}(?=$|[^A-Za-z0-9_])"
    return values.where(F.contains(F.lower(column), F.lit(old.lower())) & F.col(column).rlike(pattern)).withColumn("after", F.regexp_replace(column, pattern, f"$1{put}"))


def rewrite(values: DataFrame, column: str, renames: DataFrame) -> DataFrame:
    """``values`` with ``column`` mapped by ``renames`` (old, new), others as they are; ``changed`` tells which."""
    r = renames.select("old", "new").distinct()
    out = values.join(r, values[column] == r["old"], "left")
    return out.withColumn("changed", F.col("new").isNotNull()).withColumn(column, F.coalesce("new", column)).drop("old", "new")


def name_sets(names: DataFrame, name: str, least: int = 2, most: int = 60) -> DataFrame:
    """(name, family): the shortest proper prefix of words that ``least`` to ``most`` names share, its words joined by _. Words are
    in lower case, parted by _ / : . - or spaces; digits that end the last word are a word of their own. Names left over are grouped
    by their first five letters and digits, if ``least`` to ``most`` share them, under the longest start common to all; else NULL."""
    n = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    ends = F.regexp_replace(F.lower("name"), r"(?U)[_\s/:.-]+$", "")
    parts = F.split(F.regexp_replace(ends, r"(?U)([^_\s/:.\-\d])(\d+)$", "$1_$2"), r"(?U)[_\s/:.-]+")
    p = n.withColumn("parts", F.array_remove(parts, "")).where(F.size("parts") > 1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.concat_ws("_", F.slice(F.col("parts"), 1, i)))
    p = p.select("name", F.explode(prefixes).alias("prefix"))
    good = p.groupBy("prefix").agg(F.count("*").alias("k")).where(F.col("k").between(least, most)).select("prefix")
    best = p.join(good, "prefix").groupBy("name").agg(F.min_by("prefix", F.length("prefix")).alias("family"))
    low = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    # names without a start join by themselves, so that they don't meet in one partition
    start = F.when(F.col("family").isNull() & (F.length("low") >= 5), F.left("low", F.lit(5))).otherwise(F.concat(F.lit("-"), "name"))
    n = n.join(best, "name", "left").withColumn("low", low).withColumn("start", start)
    left = n.where("start NOT LIKE '-%'").groupBy("start").agg(F.count("*").alias("k"), F.min("low").alias("a"), F.max("low").alias("z")).where(F.col("k").between(least, most))
    common = F.array_max(F.transform(F.sequence(F.lit(5), F.length("a")), lambda i: F.when(F.left("a", i) == F.left("z", i), i)))
    left = left.select("start", F.left("a", common).alias("common"))
    return n.join(left, "start", "left").select("name", F.coalesce("family", "common").alias("family"))


def suffix_link(names: DataFrame, name: str, suffixes: DataFrame, suffix: str, least: int = 3) -> DataFrame:
    """(name, suffix): names that end with one of ``suffixes``; the names' ends are filed, so that it is an equi-join."""
    n = names.select(F.lower(name).alias("name")).where(F.length("name") >= least).distinct()
    ends = n.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - least + 1), lambda i: F.substr(F.col("name"), i))).alias("suffix"))
    return ends.join(suffixes.select(F.lower(suffix).alias("suffix")).distinct(), "suffix", "left_semi").select("name", "suffix")


def line_diff(pairs: DataFrame, id_col: str, before: str, after: str) -> DataFrame:
    """(id, place, sign, line): lines taken out (-) and put in (+) between two texts of a row, in order; equal texts give none."""
    import difflib

    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for i, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                diff = difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), lineterm="", n=0)
                changed = [d for d in diff if d[:1] in "+-" and d[:3] not in ("+++", "---")]
                out += [(i, k, d[0], d[1:]) for k, d in enumerate(changed)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], ["id", "place", "sign", "line"])

    rows = pairs.where(~F.col(before).eqNullSafe(F.col(after))).select(F.col(id_col).cast("bigint"), F.col(before), F.col(after))
    return rows.mapInArrow(run, "id bigint, place int, sign string, line string")


def joined_labels(rows: DataFrame, key: list[str], label: str, most: int = 4, by: str = "; ") -> DataFrame:
    """(key, labels, n): the least ``most`` different labels of each key, joined; … if there are more, which ``n`` counts.

    Labels are ranked by a window that keeps ``most`` + 1 of a key on each map task, so that no list grows with the rows.
    """
    d = rows.select(*key, F.col(label).alias("label")).where("label IS NOT NULL").distinct()
    top = d.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("label"))).where(F.col("place") <= most + 1)
    lists = top.groupBy(*key).agg(F.array_sort(F.collect_list("label")).alias("all"))
    text = F.array_join(F.slice("all", 1, most), by)
    lists = lists.select(*key, F.when(F.size("all") > most, F.concat(text, F.lit(by + "…"))).otherwise(text).alias("labels"))
    return lists.join(d.groupBy(*key).agg(F.count("*").alias("n")), key)


def match_globs(names: DataFrame, name: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(name, pattern): names that a pattern with * (any characters) and ? (one) matches, letter case aside.

    Names meet only the patterns whose letters before the first such sign they begin with: their beginnings are filed for the
    lengths that occur, so that it is an equi-join. Patterns that begin with a sign meet every name, each once.
    """
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct()
    p = p.withColumn("start", F.lower(F.regexp_extract("pattern", r"^[^*?]*", 0)))
    lengths = sorted(r[0] for r in p.select(F.length("start")).distinct().collect())  # as many as a pattern is long
    n = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    filed = n.withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths] or [F.lit(0)]))).where(F.length("name") >= F.col("length")).withColumn("start", F.lower(F.left("name", F.col("length"))))
    escaped = F.regexp_replace("pattern", r"([^\p{L}\p{N}_*?])", r"\\$1")
    regex = F.concat(F.lit("(?is)^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    return filed.join(p, "start").where(F.rlike("name", regex)).select("name", "pattern").distinct()
