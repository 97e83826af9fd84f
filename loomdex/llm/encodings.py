"""Text decoded with a wrong character encoding: found by improbable character pairs, restored by inverse mappings.

Pairs of adjacent characters are counted over the whole corpus; many copies of one text count by their logarithm, so that a
text that fills much of a collection doesn't drown the others. A pair's discounted mutual information says how well its characters go
together; the maximum-scoring segments of its lack are the improbable runs of a text. Only the words of such a run are tried with
inverse mappings: encode as the encoding that was assumed, decode as the one that was meant. A mapping holds if the pairs of the
run's different words become far more probable in the corpus. Characters that were lost (U+FFFD) within a run garble a text, too.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.plans.session import cut, spread

#: The encodings that are taken for one another.
SINGLE_BYTE = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "mac_roman", "iso8859-2", "koi8-r", "iso8859-15", "cp1254", "mac_cyrillic", "iso8859-5")
#: Least share of a pair in all pairs of the corpus to count as seen; so there are at most 1 / PAIR_SHARE of them, however large
#: the corpus. What a character takes in all is counted over all pairs.
PAIR_SHARE = 5e-7
#: A pair is improbable below this discounted mutual information (nats), so far discounted where its rarer character has a
#: share of less than RARE in the corpus.
LEVEL, RARE = 0.5, 1e-3
#: Least score of an improbable run; least gain of a word per changed pair, of a text in all, and of a
#: text of which a single character changes (nats).
LEAST_RUN, PAIR_GAIN, TEXT_GAIN, LONE_GAIN = 0.5, 2.0, 4.0, 10.0
#: Copies of a text that count in full.
COPIES = 64
#: How much less improbable the runs may be in which a text is restored, once it is sure to be garbled.
WIDER = 2.5
#: Added to the count of every pair.
SMOOTH = 0.5
#: Words a worker remembers before it starts anew.
MEMORY = 200_000
EDGE = "\n"

_SPLIT = re.compile(r"[ \t\r\n]+")
_PIECE = re.compile(r"[^ \t\r\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def fold(word: str) -> str:
    """Lower case for runs of letters in capitals or with a capital first letter; capitals within a run stay, they are rare."""
    if word == (low := word.lower()) or len(low) != len(word):
        return word
    return _LETTERS.sub(lambda m: x.lower() if (x := m.group()) == x.upper() or x[1:] == x[1:].lower() else x, word)


def pairs_of(word: str) -> Iterator[tuple[str, str]]:
    w = EDGE + fold(word) + EDGE
    return zip(w, w[1:], strict=False)


class PairModel:
    """Counts of adjacent characters. Its size is bounded by PAIR_SHARE, so it can be broadcast."""

    def __init__(self, counts: dict[tuple[str, str], int], first: dict[str, int] | None = None, second: dict[str, int] | None = None):
        """counts of the pairs that count as seen; first and second: of characters over all pairs, where those are more."""
        self.pairs = counts
        self.first, self.second = Counter(first), Counter(second)
        if first is None:
            for (x, y), n in counts.items():
                self.first[x] += n
                self.second[y] += n
        self.total = max(1, sum(self.first.values()))
        self.rare = RARE * self.total
        self.lacks: dict[str, list[float]] = {}

    def information(self, x: str, y: str) -> float:
        """Discounted pointwise mutual information."""
        n = self.pairs.get((x, y), 0)
        a, b = self.first[x] or 1, self.second[y] or 1
        least = min(a, b)
        return math.log((n + SMOOTH) * self.total / (a * b)) * (n / (n + 1)) * (least / (least + self.rare)) if n else -4.0

    def lack(self, word: str) -> list[float]:
        """How much each pair of a word has less information than LEVEL; remembered."""
        if (out := self.lacks.get(word)) is None:
            if len(self.lacks) > MEMORY:
                self.lacks.clear()
            out = self.lacks[word] = [LEVEL - self.information(x, y) for x, y in pairs_of(word)]
        return out

    def improbable(self, text: str, wider: float = 0.0) -> list[tuple[int, int]]:
        """The maximum-scoring segments of the pairs' lack of information, as spans of characters; plain words end a run.
        ``wider`` is added to what each pair lacks."""
        spans, start, total, best, end = [], 0, 0.0, 0.0, -1
        for m in _PIECE.finditer(text):
            part, at = m.group(), m.start()
            if part.isascii():
                if best >= LEAST_RUN:
                    spans.append((start, end))
                total, best = 0.0, 0.0
                continue
            for i, s in enumerate(self.lack(part)):
                if total <= 0:
                    if best >= LEAST_RUN:
                        spans.append((start, end))
                    start, total, best = at + max(0, i - 1), 0.0, 0.0
                total += s + wider
                if total > best:
                    best, end = total, at + min(i + 1, len(part))
        if best >= LEAST_RUN:
            spans.append((start, end))
        return spans

    def likelihood(self, word: str) -> tuple[float, int]:
        """Log-probability of the word's pairs, and how many there are."""
        n, get = 0, self.pairs.get
        total = 0.0
        for p in pairs_of(word):
            total += math.log((get(p, 0) + SMOOTH) / self.total)
            n += 1
        return total, n


@cache
def _encode_table(name: str) -> dict[str, int]:
    """Character -> byte of an encoding; bytes it leaves undefined stand for their C1 control characters."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    if name in ("cp1252", "cp1250", "cp1254", "cp1251"):
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


@cache
def _swap_table(assumed: str, meant: str) -> dict[int, str]:
    """Character read as ``assumed`` -> character meant."""
    out = {}
    for char, b in _encode_table(assumed).items():
        try:
            out[ord(char)] = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            out[ord(char)] = chr(b)
    return out


def _from_utf8(word: str, assumed: str, last: bool) -> str | None:
    """The word with every run of foreign characters read as UTF-8; None if one isn't. ``last``: the text ends here, perhaps
    within a character."""
    table, out, at = _encode_table(assumed), [], 0
    for m in _FOREIGN.finditer(word):
        raw = bytearray()
        for c in m.group():
            b = table.get(c)
            if b is None:
                return None
            raw.append(b)
        decoder = codecs.getincrementaldecoder("utf-8")()
        try:
            text = decoder.decode(bytes(raw), not (last and m.end() == len(word)))
        except UnicodeDecodeError:
            return None
        if not text:  # nothing but the start of a character
            return None
        out += [word[at : m.start()], text]
        at = m.end()
    return "".join(out) + word[at:]


@cache
def mappings() -> tuple[tuple[str, str], ...]:
    return tuple((a, "utf-8") for a in SINGLE_BYTE) + tuple((a, m) for a in SINGLE_BYTE for m in SINGLE_BYTE if a != m)


_ORDER = {m: i for i, m in enumerate(mappings())}


class Restorer:
    """Judges and restores texts; remembers words."""

    def __init__(self, model: PairModel):
        self.model = model
        self.known: dict[tuple[str, bool], dict[tuple[str, str], tuple[float, int, str]]] = {}
        self.swaps: dict[frozenset[str], list[tuple[dict[int, str], list[tuple[str, str]]]]] = {}

    def _swaps(self, foreign: frozenset[str]) -> list[tuple[dict[int, str], list[tuple[str, str]]]]:
        """The different ways in which pairs of single-byte encodings exchange these characters for ones that the corpus knows."""
        if (out := self.swaps.get(foreign)) is None:
            ways: dict[str, tuple[dict[int, str], list[tuple[str, str]]]] = {}
            old = "".join(sorted(foreign))
            for assumed, meant in mappings():
                if meant != "utf-8" and foreign <= _encode_table(assumed).keys():
                    table = _swap_table(assumed, meant)
                    new = old.translate(table)
                    if new != old and self._known(new):
                        ways.setdefault(new, ({ord(c): table[ord(c)] for c in old}, []))[1].append((assumed, meant))
            if len(self.swaps) > MEMORY:
                self.swaps.clear()
            out = self.swaps[foreign] = list(ways.values())
        return out

    def trials(self, word: str, last: bool) -> dict[tuple[str, str], tuple[float, int, str]]:
        """For each mapping that makes the word far more probable: its gain, the characters changed, and the word restored."""
        key = (word, last)
        if key in self.known:
            return self.known[key]
        model = self.model
        old, n = model.likelihood(word)
        foreign = frozenset(c for c in word if not c.isascii())
        out = {}
        for assumed in SINGLE_BYTE:
            if not foreign <= _encode_table(assumed).keys():
                continue
            new, left = word, 3
            while left and (again := _from_utf8(new, assumed, last)) is not None and again != new:
                new, left = again, left - 1
                gain = model.likelihood(new)[0] - old if self._known(new) else 0.0
                if gain > out.get((assumed, "utf-8"), (TEXT_GAIN,))[0]:
                    out[assumed, "utf-8"] = gain, len(word) - len(new) + 1, new
        for table, ways in self._swaps(foreign):
            new = word.translate(table)
            gain, m = model.likelihood(new)
            gain -= old
            if m == n and gain >= PAIR_GAIN * self._touched(word, new):
                changed = sum(x != y for x, y in zip(word, new, strict=True)) + self._misplaced(word, new)
                out.update(dict.fromkeys(ways, (gain, changed, new)))
        if len(self.known) > MEMORY:
            self.known.clear()
        self.known[key] = out
        return out

    @staticmethod
    def _touched(old: str, new: str) -> int:
        """Pairs that hold a changed character."""
        d = [a != b for a, b in zip(old, new, strict=True)]
        return sum(a or b for a, b in zip([False, *d], [*d, False], strict=True))

    @staticmethod
    def _misplaced(old: str, new: str) -> bool:
        """Whether a changed character is no Latin letter, but stands between such letters: no rare name explains that."""
        latin = [c.isalpha() and ord(c) < 0x250 for c in old]
        return any(x != y and not latin[i] and 0 < i < len(old) - 1 and latin[i - 1] and latin[i + 1] for i, (x, y) in enumerate(zip(old, new, strict=True)))

    def _known(self, word: str) -> bool:
        """Whether the corpus knows each foreign character of a word."""
        return all(c.isascii() or self.model.first[c] > 2 or self.model.first[c.lower()] > 2 for c in word)

    @staticmethod
    def _words(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """The words with foreign characters that the spans touch, with their places."""
        words = [(m.start(), m.end(), m.group()) for m in _PIECE.finditer(text) if not m.group().isascii()]
        return [(a, b, w) for a, b, w in words if any(s < b and e > a for s, e in spans)]

    def judge(self, text: str) -> tuple[bool, str | None, str | None]:
        """(garbled?, the text restored or None, the mapping or None)."""
        spans = self.model.improbable(text)
        if not spans:
            return False, None, None
        touched = self._words(text, spans)
        score: Counter = Counter()
        changed: Counter = Counter()
        for w, last in dict.fromkeys((w, b == len(text)) for _, b, w in touched):  # a word that is repeated is no further evidence
            for m, (gain, n, new) in self.trials(w, last).items():
                if len(w) > 1 or w.isalpha() or not new.isalpha():  # a sign that stands alone hardly was a letter
                    score[m] += gain
                    changed[m] += n
        # one character alone may be a rare name's; it has to gain more
        score = Counter({m: g for m, g in score.items() if g >= (TEXT_GAIN if changed[m] > 1 else LONE_GAIN)})
        if score:
            best = max(score, key=lambda m: (round(score[m], 6), -_ORDER[m]))
            out, at = [], 0
            for a, b, w in self._words(text, self.model.improbable(text, WIDER)):  # what surely is garbled is so in weaker runs, too
                if t := self.trials(w, b == len(text)).get(best):
                    out += [text[at:a], t[2]]
                    at = b
            whole = "".join(out) + text[at:]
            return True, None if "\ufffd" in whole else whole, f"{best[1]} read as {best[0]}"
        return any("\ufffd" in w for _, _, w in touched), None, None


def count_pairs(texts: DataFrame, column: str) -> PairModel:
    """The model of a corpus: pairs tallied per batch over all different texts, summed by Spark. A text found n times counts n
    times, beyond COPIES only COPIES * (1 + ln(n / COPIES)) times."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            weights = batch.column(1)
            for n in weights.unique().to_pylist():
                some: Counter = Counter()
                for text in batch.column(0).filter(pc.equal(weights, n)).to_pylist():
                    some.update(_SPLIT.split(text))
                for w, k in some.items():
                    words[w] += k * n
            into: Counter = Counter()
            for w, k in words.items():
                if w:
                    w = EDGE + (w.lower() if w.isascii() else fold(w)) + EDGE
                    for p in zip(w, w[1:], strict=False):
                        into[p] += k
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in into], pa.string()), pa.array([y for _, y in into], pa.string()), pa.array(into.values(), pa.int64())], ["x", "y", "n"])

    n = F.count("*")
    weight = F.when(n <= COPIES, n).otherwise(F.floor(COPIES * (1 + F.log(n / COPIES)))).alias("weight")
    said = texts.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(weight)
    sums = cut(said.mapInArrow(tally, "x string, y string, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n")))
    first, second = ({r[0]: r[1] for r in sums.groupBy(c).agg(F.sum("n")).toLocalIterator()} for c in ("x", "y"))  # a row per character
    kept = sums.where(F.col("n") >= PAIR_SHARE * sum(first.values()))  # at most 1 / PAIR_SHARE
    return PairModel({(r.x, r.y): r.n for r in kept.toLocalIterator()}, first, second)


def garbled(texts: DataFrame, column: str, model: PairModel) -> DataFrame:
    """The rows of ``texts`` whose ``column`` was read with a wrong encoding, with ``restored`` and ``mapping``.

    restored is NULL where the original can't be had (characters were lost); mapping is NULL where none was found. NULL,
    empty and plain ASCII texts are never garbled. Texts are judged whole, each once per batch. Repeated rows stay repeated.
    Columns of the input named restored or mapping are dropped.
    """
    texts = texts.drop("restored", "mapping")
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = texts.schema.add("restored", "string").add("mapping", "string")
    at = texts.columns.index(column)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            rows, restored, mapping = [], [], []
            said = batch.column(at).dictionary_encode()
            judged = [restorer.judge(x) for x in said.dictionary.to_pylist()]
            for i, k in enumerate(said.indices.to_pylist()):
                bad, fixed, how = judged[k]
                if bad:
                    rows.append(i)
                    restored.append(fixed)
                    mapping.append(how)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(restored, pa.string()), pa.array(mapping, pa.string())], [*batch.schema.names, "restored", "mapping"])

    return spread(texts.where(F.col(column).rlike(r"[^\x00-\x7F]"))).mapInArrow(judge, schema)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, file_id, path, lang, text) of all texts that may be garbled: field values and the entries of localised strings."""
    fields = spark.read.parquet(f"{sf_dir}/gff_fields.parquet")
    fields = fields.where(F.col("value").isNotNull()).select(F.lit("gff_fields").alias("tbl"), "file_id", "path", F.lit(-1).cast("bigint").alias("lang"), F.col("value").alias("text"))
    strings = spark.read.parquet(f"{sf_dir}/locstrings.parquet").select("file_id", "path", F.explode("entries").alias("lang", "text"))
    strings = strings.where("text IS NOT NULL").select(F.lit("locstrings").alias("tbl"), "file_id", "path", F.col("lang").cast("bigint").alias("lang"), "text")
    return fields.unionByName(strings)


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, file_id, path, lang, restored, mapping) of every garbled text."""
    texts = corpus(spark, sf_dir)
    return garbled(texts, "text", count_pairs(texts, "text")).drop("text").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_restored(spark, sf_dir).select("tbl", "file_id", "path", "lang").distinct()
