"""Held-out evaluation texts inside a corpus: Wu-Manber search for every run of words of every item.

Texts are reduced to their letters and digits, in one unbroken stream, so that spacing, line breaks inside words, markup and
invisible characters cannot hide a passage; where words begin and end is kept beside it. Every run of MIN_WORDS words of an
item is a pattern. A shift table over blocks of characters says how far the search may jump, buckets by the block at the
end of the patterns' common length give the candidates, and comparing the stream itself and its word bounds confirms them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.plans.session import spread, written

#: An item is leaked by so many of its consecutive words.
MIN_WORDS = 12
#: Characters of a block of the shift table.
BLOCK = 5
#: Runs of words that one set of tables holds, whatever the number and length of the items; so a broadcast has some 60 MB at most.
#: More are searched by further sets over the normalised texts, which then are written once.
RUNS_PER_TABLE = 200_000

#: Letters that compatibility decomposition leaves whole, and the plain letters they stand for.
_FOLDED = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "n", "ĸ": "k"})
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|<c[^<>]{3}>", re.S)
_BBCODE = re.compile(r"\[/?(?:b|i|u|s|url|img|quote|code|color|colour|size|font|center|list|spoiler|sub|sup|\*)(?:=[^\]\n]*)?\]", re.I)
_LINK = re.compile(r"\]\([^()\s]*\)")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


def plain_words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits, without case, accents, markup, entities and invisible characters."""
    for _ in range(3):  # entities may be escaped more than once
        if "&" not in text or not _ENTITY.search(text):
            break
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _LINK.sub(" ", _BBCODE.sub(" ", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", _HIDDEN.sub("", text)).casefold())
        text = _HIDDEN.sub("", _MARKS.sub("", text)).translate(_FOLDED)
    return _WORD.findall(text.lower())


class WuManber:
    """Tables for a set of (item, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = MIN_WORDS, block: int = BLOCK):
        owners: dict[str, set[int]] = defaultdict(set)
        for item, words in items:
            for at in range(len(words) - run + 1):
                owners["".join(words[at : at + run])].add(item)
        self.patterns = dict(owners)
        self.least = min(map(len, self.patterns), default=0)  # the patterns' common length
        self.block = min(block, self.least)
        self.jump = self.least - self.block + 1
        self.shift: dict[str, int] = {}
        self.buckets: dict[str, list[tuple[str, frozenset[int]]]] = defaultdict(list)
        for p, who in self.patterns.items():
            for end in range(self.block, self.least + 1):
                b = p[end - self.block : end]
                far = self.least - end
                if far < self.shift.get(b, self.jump):
                    self.shift[b] = far
            self.buckets[p[self.least - self.block : self.least]].append((p, frozenset(who)))
        self.buckets = dict(self.buckets)

    def find(self, words: list[str]) -> set[int]:
        """The items of which ``words`` holds a run."""
        found: set[int] = set()
        if not self.patterns:
            return found
        text = "".join(words)
        ends = None
        shift, buckets, block, least, jump = self.shift.get, self.buckets, self.block, self.least, self.jump
        at, n = least, len(text)
        while at <= n:
            b = text[at - block : at]
            far = shift(b, jump)
            if far:
                at += far
                continue
            start = at - least
            for pattern, who in buckets[b]:
                if text.startswith(pattern, start):
                    if ends is None:
                        ends = {0, *accumulate(map(len, words))}
                    if start in ends and start + len(pattern) in ends:
                        found |= who
            at += 1
        return found


def _item_words(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, words) of the different items, normalised where they are."""
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [plain_words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["item_id", "words"])

    known = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return known.mapInArrow(plain, "item_id bigint, words array<string>")


def _tables(items: Iterable[tuple[int, list[str]]], run: int, most: int) -> Iterator[WuManber]:
    """Search tables for all items, each of at most ``most`` runs; a long item goes on in the next one."""
    held: list[tuple[int, list[str]]] = []
    left = most
    for item, words in items:
        at = 0
        while len(words) - at >= run:
            n = min(left, len(words) - at - run + 1)
            held.append((item, words[at : at + n + run - 1]))
            at, left = at + n, left - n
            if not left:
                yield WuManber(held, run)
                held, left = [], most
    if held:
        yield WuManber(held, run)


def leaks(corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = MIN_WORDS, most: int = RUNS_PER_TABLE) -> DataFrame:
    """(doc_id, item_id) for every document that holds at least ``run`` consecutive words of an item; distinct for each document.

    The items are a stated query set. Their runs are streamed through the driver into tables of at most ``most`` runs, which are
    broadcast one by one; where one isn't enough, the corpus is normalised and written once, and every table searches that.
    NULL and empty texts hold nothing; items shorter than ``run`` words can't leak; items that share a passage are all reported;
    repeated items count once.
    """
    spark = corpus.sparkSession
    rows = spread(corpus.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(plain_words(t)) if t else None for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    def searching(table: WuManber, split: Callable[[str], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        shared = spark.sparkContext.broadcast(table)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            engine = shared.value
            for batch in batches:
                docs, hits = [], []
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for item in sorted(engine.find(split(body))) if body else ():
                        docs.append(doc)
                        hits.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], ["doc_id", "item_id"])

        return search

    schema = "doc_id bigint, item_id bigint"
    tables = _tables(((r.item_id, r.words) for r in _item_words(items, item_id, item_text).toLocalIterator()), run, most)
    first, second = next(tables, None), next(tables, None)
    if first is None:
        return rows.select("doc_id", F.lit(None).cast("bigint").alias("item_id")).limit(0)
    if second is None:
        return rows.mapInArrow(searching(first, plain_words), schema).distinct()
    texts = written(rows.mapInArrow(plain, "doc_id bigint, text string"))
    parts = [texts.mapInArrow(searching(t, str.split), schema) for t in chain([first, second], tables)]
    return reduce(DataFrame.unionByName, parts).distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))
