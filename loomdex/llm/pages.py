"""Keyword-stuffed and link-list pages, by a hidden Markov model over lines.

Each line of a document is prose (told or programmed), a link list, a tag list or a menu (short entries or keywords). A line emits some coarse
marks of its form and its words. The model is trained here, over all documents: lines that are typical of a state give first
counts, rounds of Viterbi training over the whole corpus give the final ones. A page is flagged by the share of its
characters in lines that the model takes for no prose.

Every text is split and described once, all lines of an Arrow batch together (RE2 kernels and numpy); marks and word ids go to
a table in the checkpoint folder, which counting, training and labelling read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.plans.session import spread, written

PROSE, LINKS, TAGS, MENU, CODE, KEYWORDS = range(6)
#: The states. What is told and what is programmed are both prose, short entries and stuffed keywords both menu, but they look
#: so unlike that each is a state of its own.
STATES = ("prose", "link_list", "tag_list", "menu", "code", "keywords")
KINDS = ("prose", "link_list", "tag_list", "menu")
#: A page is flagged if more than this share of its characters is not prose.
SHARE = 0.6
#: A word counts towards its states if it is said this often in the whole corpus, and by at least this share of all words (so
#: that there are at most 1 / WORD_SHARE such words, however large the corpus); others only count towards the totals.
RARE, WORD_SHARE = 3, 5e-7
#: Rounds of Viterbi training after the first counts.
ROUNDS = 2
#: A line is keywords if so much of it is phrases repeated out of context.
STUFFED = 0.36
#: Words of a line that count in full; more share this weight.
WORDS_WEIGHT = 12

_BREAK = re.compile(r"[\r\n\u2028\u2029\x0b\x0c\x85]+|</?(?:p|div|h[1-6]|li|ul|ol|br|tr|td|th|table|hr|section|article|nav|body|html|head|title|blockquote|pre)\b[^<>]*>", re.I)
_ANCHOR = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*["']?(?://)?([^"'\s<>]+)[^<>]*>""", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,8}/\S*|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,8}\b(?=$|[\s)\]])", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?\u2026])\s+")
#: The same in RE2's syntax, for whole batches.
_R_LINES = r"[\r\n\x{2028}\x{2029}\x0b\x0c\x{85}]+"
_R_DOTTED = r"[\p{L}\p{N}]\.[\p{L}\p{N}]|://"
_R_HASH = r"(?:^|\s)#[^\s#]+"
_R_LIST_MARK = r"[;,|/•·*»>–—]|\s-\s"
_R_LABEL = r"(?i)^[^\p{L}\p{N}]*(?:tags?|labels?|keywords?|key ?words|topics?|categor(?:y|ies)|stichw(?:o|ö)rter|schlagw(?:o|ö)rter|mots[- ]cl(?:é|e)s|etiquetas|palabras clave|etichette|parole chiave|tagi|słowa kluczowe|теги|метки)\s*[:–—-]"
_R_GOODS = r"\b[A-Z]{2,5}-\d{3,}\b"
_R_CODE = r"[;{}]$|^(?://(?:\s|$|[^\s./]+(?:\s|$))|/\*|\*/|#include|\}|\{|void\b|int\b|if\s*\(|else\b|for\s*\(|return\b|object\b|string\b|float\b)"
_R_CLOSED = r"""[.!?…:]["'”’»)*_ \t]*$"""
_R_CASED = r"^\P{L}*\p{Lu}"

#: Bounds of the marks of a line's form, in their order; a mark is the number of bounds its value reaches.
BOUNDS: tuple[tuple[float, ...] | None, ...] = (
    (0.01, 0.4),  # share of addresses
    (0.01, 0.5),  # hash tags a word
    (0.01, 0.2, 0.4),  # list marks a word
    None,  # how it ends and begins: 2 * closed + cased, 4 for code
    (2, 4, 8, 20),  # words
    (0.5, 0.8),  # distinct pairs of words
    (2, 4),  # times the document says it
    None,  # 2 * stock number + label
    (0.01, 0.3, 0.6),  # words with a capital
    (0.25, 0.6, 1.0),  # words shared with the line before
    (0.12, 0.24, STUFFED),  # phrases out of context
)
MARKS = len(BOUNDS)


def split_markup(text: str) -> str:
    """A text with block markup as line breaks; links keep their address, other markup goes."""
    return "\n".join(_TAG.sub(" ", _ANCHOR.sub(r" \1 ", x)) for x in _BREAK.split(text))


def word_ids(words: pa.Array) -> np.ndarray:
    """A 64-bit id of each word, the same everywhere."""
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False).view(np.int64) if len(words) else np.zeros(0, np.int64)


@dataclass
class Lines:
    """All lines of a batch of documents: the document of each, its marks, its typical state or -1, its characters, how many words
    it has, and the ids of all words in a row."""

    doc: np.ndarray
    form: np.ndarray
    sure: np.ndarray
    chars: np.ndarray
    sizes: np.ndarray
    words: np.ndarray


def _flags(strings: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False)


def _number(strings: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(strings, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, sorted (np.unique hashes first, which takes longer on nearly distinct keys)."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _replace(strings: pa.Array, at: np.ndarray, new: list[str]) -> pa.Array:
    if not len(at):
        return strings
    mask = np.zeros(len(strings), bool)
    mask[at] = True
    return pc.replace_with_mask(strings, pa.array(mask), pa.array(new, strings.type))


def describe(texts: pa.Array) -> Lines:
    """The lines of a batch that hold anything, described all at once. NULL and blank texts have none."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = pc.fill_null(texts, "")
    tagged = np.flatnonzero(pc.match_substring(texts, "<").to_numpy(zero_copy_only=False))
    texts = _replace(texts, tagged, [split_markup(x) for x in texts.take(pa.array(tagged)).to_pylist()])
    parts = pc.split_pattern_regex(texts, _R_LINES)
    body = pc.utf8_trim_whitespace(parts.flatten())
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    holds = pc.greater(pc.binary_length(body), 0)
    body, doc = body.filter(holds), doc[holds.to_numpy(zero_copy_only=False)]
    coded = np.flatnonzero(pc.match_substring(body, "&").to_numpy(zero_copy_only=False))
    body = _replace(body, coded, [html.unescape(x).strip() or "&" for x in body.take(pa.array(coded)).to_pylist()])
    n_lines = len(body)
    length = pc.utf8_length(body).to_numpy(zero_copy_only=False).astype(np.int64)
    # addresses
    urls, plain = np.zeros(n_lines), body
    dotted = np.flatnonzero(_flags(body, _R_DOTTED))
    if len(dotted):
        rest = []
        for i, x in zip(dotted, body.take(pa.array(dotted)).to_pylist(), strict=True):
            if spans := [m.span() for m in _URL.finditer(x)]:
                urls[i] = sum(b - a for a, b in spans) / len(x)
                x = " ".join(x[a:b] for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (len(x), 0)], strict=True))
            rest.append(x)
        plain = _replace(body, dotted, rest)
    # words: an apostrophe between letters stays in its word
    joined = pc.replace_substring_regex(plain, r"([\p{L}\p{N}])['’]([\p{L}\p{N}])", "\\1\x01\\2") if _flags(plain, "['’]").any() else plain
    parts = pc.split_pattern_regex(joined, r"[^\p{L}\p{N}\x01]+")
    line, spelled = np.repeat(np.arange(n_lines), np.diff(parts.offsets.to_numpy())), parts.flatten()
    holds = pc.greater(pc.binary_length(spelled), 0)
    spelled, line = spelled.filter(holds).dictionary_encode(), line[holds.to_numpy(zero_copy_only=False)]
    shapes = spelled.dictionary
    at = spelled.indices.to_numpy(zero_copy_only=False)
    lower = pc.utf8_lower(shapes).dictionary_encode()
    word = lower.indices.to_numpy(zero_copy_only=False)[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)
    n_words = max(1, len(lower.dictionary))
    n = np.bincount(line, minlength=n_lines)
    per_word = np.maximum(n, 1)
    capitals = np.bincount(line, _flags(shapes, r"^[\p{Lu}\p{Lt}]")[at].astype(float), n_lines) / per_word if len(at) else np.zeros(n_lines)
    small = np.bincount(line, _flags(shapes, r"^\p{Ll}{1,3}$")[at].astype(float), n_lines) > 0 if len(at) else np.zeros(n_lines, bool)
    hashes, marks = _number(plain, _R_HASH) / per_word, _number(plain, _R_LIST_MARK) / per_word
    code = _flags(body, _R_CODE)
    closed, cased = _flags(body, _R_CLOSED), _flags(body, _R_CASED) & _flags(plain, r"\p{Ll}")
    label, goods = _flags(body, _R_LABEL), _flags(body, _R_GOODS)
    # how often the document says the line
    says = pc.utf8_lower(body).dictionary_encode()
    _, which, often = np.unique(doc * max(1, len(says.dictionary)) + says.indices.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    times = often[which]
    # words shared with the line before: distinct (word, line), in order, so that lines in a row stand side by side
    key = _distinct(word * (n_lines + 1) + line)
    own_line, follows = key % (n_lines + 1), np.zeros(len(key), bool)
    follows[1:] = np.diff(key) == 1
    own, both = np.bincount(own_line, minlength=n_lines), np.bincount(own_line[follows], minlength=n_lines)
    before = np.zeros(n_lines, np.int64)
    before[1:] = np.where(doc[1:] == doc[:-1], own[:-1], 0)
    same = np.where((n > 3) & (before > 0), both / np.maximum(own + before - both, 1), 0.0)
    # pairs of words: repeated within the line, and in the document
    held = line[1:] == line[:-1]
    pair_line = line[1:][held]
    _, pair = np.unique((word[:-1] * n_words + word[1:])[held], return_inverse=True)
    n_pairs = int(pair.max()) + 1 if len(pair) else 1
    pairs_of = np.bincount(pair_line, minlength=n_lines)
    different = np.bincount(_distinct(pair_line * n_pairs + pair) // n_pairs, minlength=n_lines)
    pairs = np.where(pairs_of > 2, different / np.maximum(pairs_of, 1), 1.0)
    # a refrain's sentences count once; that only raises the share of distinct pairs
    low = np.flatnonzero((n > 12) & (pairs < 0.8))
    for i, x in zip(low, plain.take(pa.array(low)).to_pylist(), strict=True):
        if len(said := _SENTENCE.split(x)) > len(set(said)):
            w = _WORD.findall(" ".join(dict.fromkeys(said)).lower())
            once = list(zip(w, w[1:], strict=False))
            pairs[i] = len(set(once)) / len(once) if len(once) > 2 else 1.0
    # phrases of two words which the document repeats, but never as part of a longer run: keywords put into ever other contexts
    _, which, often = np.unique(doc[pair_line] * n_pairs + pair, return_inverse=True, return_counts=True)
    hit = often[which] >= 3
    beside = np.zeros(len(hit), bool)
    beside[1:] |= hit[:-1] & (pair_line[1:] == pair_line[:-1])
    beside[:-1] |= hit[1:] & (pair_line[1:] == pair_line[:-1])
    stuffed = np.where(n >= 5, 2 * np.bincount(pair_line[hit & ~beside], minlength=n_lines) / (pairs_of + 1), 0.0)
    values = (urls, hashes, marks, np.where(code, 4, 2 * closed + cased), n, pairs, times, 2 * goods + label, capitals, same, stuffed)
    form = np.zeros((n_lines, MARKS), np.int8)
    for k, (v, bounds) in enumerate(zip(values, BOUNDS, strict=True)):
        form[:, k] = v if bounds is None else np.searchsorted(bounds, v, "right")
    # lines typical of a state, for the first counts alone
    sure = np.select(
        [code, urls >= 0.5, ((hashes >= 0.8) & (n > 0)) | (label & ((marks >= 0.3) | (n <= 3))) | (goods & (n <= 14)),
         ((n >= 20) & (stuffed >= STUFFED)) | ((n >= 12) & (pairs < 0.5)), (n >= 1) & (n <= 4) & (times >= 3) & ~closed,
         (n >= 6) & (urls == 0) & (hashes == 0) & (marks < 0.2) & closed & cased & (capitals < 0.5) & small],
        [CODE, LINKS, TAGS, KEYWORDS, MENU, PROSE], -1,
    ).astype(np.int8)
    return Lines(doc, form, sure, length, n, word_ids(lower.dictionary)[word] if len(word) else word)


_SCHEMA = "doc_id bigint, form binary, sure binary, chars array<bigint>, sizes array<bigint>, words array<bigint>"


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int64()))


def described(rows: DataFrame) -> DataFrame:
    """One row per document (doc_id, text) with its lines' marks and word ids."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = describe(batch.column(1))
            ends = np.bincount(x.doc, minlength=len(batch)).cumsum()
            word_ends = np.concatenate([[0], x.sizes.cumsum()])[ends]
            at = np.concatenate([[0], ends])
            form = pa.array([x.form[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
            sure = pa.array([x.sure[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
            columns = [batch.column(0), form, sure, _lists(x.chars, ends), _lists(x.sizes, ends), _lists(x.words, word_ends)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "form", "sure", "chars", "sizes", "words"])

    return rows.mapInArrow(each, _SCHEMA)


def _read(batch: pa.RecordBatch) -> Lines:
    """The lines of a batch of ``described`` rows."""
    form = np.frombuffer(b"".join(batch.column("form").to_pylist()), np.int8).reshape(-1, MARKS)
    sure = np.frombuffer(b"".join(batch.column("sure").to_pylist()), np.int8)
    chars, sizes, words = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("chars", "sizes", "words"))
    doc = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("chars")).to_numpy(zero_copy_only=False))
    return Lines(doc, form, sure, chars, sizes, words)


class Model:
    """Log-probabilities from counts. Its size is bounded by WORD_SHARE, so it can be broadcast."""

    def __init__(self, marks: np.ndarray, lines: np.ndarray, first: np.ndarray, step: np.ndarray, keys: np.ndarray, said: np.ndarray, size: np.ndarray, distinct: int):
        """Numbers by state: of each mark and value, lines, first lines, steps, and of words; keys and said are the words that
        count, size and distinct take in all."""
        k = len(STATES)
        # only how a word differs between states counts
        logs = np.log((said.reshape(-1, k) + 0.5) / (size + 0.5 * distinct + 1))
        self.words = np.vstack([logs - logs.mean(1, keepdims=True), np.zeros(k)])
        self.keys = pd.Index(keys)
        self.marks = np.log((marks + 0.5) / (lines + 3))
        self.first = np.log((first + 1) / (first + 1).sum())
        step = step + 1 + 4 * np.eye(k)
        self.step = np.log(step / step.sum(1, keepdims=True))

    def emissions(self, x: Lines) -> np.ndarray:
        """Log-probability of each line in each state: its marks, and up to WORDS_WEIGHT words' worth of its words."""
        out = sum(self.marks[k][x.form[:, k]] for k in range(MARKS))
        if len(x.words):
            at = self.keys.get_indexer(x.words)
            ends = x.sizes.cumsum()
            known = np.concatenate([[0], (at >= 0).cumsum()])
            running = np.vstack([np.zeros(len(STATES)), self.words[at].cumsum(0)])
            sizes = known[ends] - known[ends - x.sizes]
            out = out + (running[ends] - running[ends - x.sizes]) * (np.minimum(sizes, WORDS_WEIGHT) / np.maximum(sizes, 1))[:, None]
        return out

    def decode(self, x: Lines) -> np.ndarray:
        """The most probable states (Viterbi), of all documents at once, line by line."""
        if not len(x.doc):
            return np.zeros(0, np.int8)
        emit = self.emissions(x)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(x.doc) != 0]))
        lens = np.diff(np.concatenate([starts, [len(x.doc)]]))
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        left = np.searchsorted(-lens, -np.arange(lens[0]), "left")  # how many documents have a line t
        back = np.zeros((len(x.doc), len(STATES)), np.int8)
        score = self.first + emit[starts]
        for t in range(1, lens[0]):
            a = left[t]
            ways = score[:a, :, None] + self.step
            best = ways.argmax(1)
            back[starts[:a] + t] = best
            score[:a] = np.take_along_axis(ways, best[:, None, :], 1)[:, 0] + emit[starts[:a] + t]
        out = np.zeros(len(x.doc), np.int8)
        last = starts + lens - 1
        out[last] = score.argmax(1)
        for t in range(lens[0] - 1, 0, -1):
            at = starts[: left[t]] + t
            out[at - 1] = back[at, out[at]]
        return out


def _tallies(x: Lines, states: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, keys, numbers by state) of the lines whose state is known (>= 0): 0 lines, 1 first lines, 2 steps from the key,
    3 marks (16 * mark + value), 4 words."""
    k = len(STATES)

    def by(keys: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, i = np.unique(keys, return_inverse=True)
        return u, np.bincount(i * k + s, minlength=len(u) * k).reshape(-1, k)

    on = states >= 0
    s = states[on].astype(np.int64)
    start = np.concatenate([[True], np.diff(x.doc) != 0]) if len(x.doc) else np.zeros(0, bool)
    yield 0, *by(np.zeros(len(s), np.int64), s)
    yield 1, *by(np.zeros((on & start).sum(), np.int64), states[on & start].astype(np.int64))
    steps = np.flatnonzero(on[1:] & on[:-1] & ~start[1:]) + 1
    yield 2, *by(states[steps - 1].astype(np.int64), states[steps].astype(np.int64))
    for m in range(MARKS):
        u, n = by(x.form[on, m].astype(np.int64), s)
        yield 3, 16 * m + u, n
    of_word = np.repeat(states, x.sizes)
    yield 4, *by(x.words[of_word >= 0], of_word[of_word >= 0].astype(np.int64))


_BY = [f"n{s}" for s in range(len(STATES))]


def _count(table: DataFrame, model: Model | None) -> Model:
    """A model from counts over all rows of a described table: tallied per batch, summed by Spark."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), *((c, pa.int64()) for c in _BY)])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _read(batch)
            for kind, keys, n in _tallies(x, x.sure if shared.value is None else shared.value.decode(x)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys), *(pa.array(n[:, s], pa.int64()) for s in range(len(STATES)))], schema=schema)

    sums = written(table.mapInArrow(tally, "kind int, key bigint, " + ", ".join(f"{c} bigint" for c in _BY)).groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in _BY]))
    shared.unpersist()
    k = len(STATES)
    marks, lines, first, step = np.zeros((MARKS, 16, k)), np.zeros(k), np.zeros(k), np.zeros((k, k))
    for r in sums.where("kind < 4").toLocalIterator():  # some dozens of rows
        n = np.array([r[c] for c in _BY], float)
        if r.kind == 0:
            lines += n
        elif r.kind == 1:
            first += n
        elif r.kind == 2:
            step[r.key] += n
        else:
            marks[divmod(r.key, 16)] += n
    words = sums.where("kind = 4")
    total = words.agg(F.count("*").alias("distinct"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _BY]).first()
    size = np.array([total[c] for c in _BY], float)
    least = max(RARE, WORD_SHARE * size.sum())
    known = words.where(sum(F.col(c) for c in _BY) >= least).select("key", *_BY).toArrow()  # at most 1 / WORD_SHARE rows
    return Model(marks, lines, first, step, known["key"].to_numpy(), np.stack([known[c].to_numpy().astype(float) for c in _BY], 1), size, total["distinct"])


def train(table: DataFrame, rounds: int = ROUNDS) -> Model:
    """The line model of a described corpus."""
    model = _count(table, None)
    for _ in range(rounds):
        model = _count(table, model)
    return model


def line_shares(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, lines, chars, prose, link_list, tag_list, menu): characters of each document's lines by their state.

    NULL, empty and blank texts have no lines and no characters. Texts are read whole, whatever their length; repeated rows
    stay repeated; an empty corpus trains a flat model and gives no rows; extra columns are dropped.
    """
    rows = spread(corpus.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")))
    table = written(described(rows))
    shared = rows.sparkSession.sparkContext.broadcast(train(table, rounds))
    schema = pa.schema([("doc_id", pa.int64()), ("lines", pa.int32()), ("chars", pa.int64()), *((s, pa.int64()) for s in KINDS)])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _read(batch)
            states, n = shared.value.decode(x), len(batch)
            by = [np.bincount(x.doc[states == s], x.chars[states == s], n).astype(np.int64) for s in range(len(STATES))]
            by = [by[PROSE] + by[CODE], by[LINKS], by[TAGS], by[MENU] + by[KEYWORDS]]
            columns = [batch.column("doc_id"), np.bincount(x.doc, minlength=n).astype(np.int32), sum(by), *by]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    return table.mapInArrow(label, "doc_id bigint, lines int, chars bigint, " + ", ".join(f"{s} bigint" for s in KINDS))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_shares(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the pages of which more than SHARE of the characters is not prose."""
    return p9_shares(spark, sf_dir).where((F.col("chars") - F.col("prose")) > SHARE * F.col("chars")).select("doc_id")
