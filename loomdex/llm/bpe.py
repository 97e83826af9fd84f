"""Byte-level BPE over a whole corpus, by speculation and verification.

For every distinct word of a block, greedy longest match proposes tokens. A token sequence is the one that merging gives if
each adjacent pair of tokens is what merging gives for the pair alone, so the pairs of all words are tested at once, in
vectorised form, by undoing merges across the seam. Only words with a failing pair undergo exact merging.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.plans.session import spread

#: Fixed value: the pattern that splits a text into words, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words remembered by a worker; when there are more it starts anew, which changes no result.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file: itself where printable, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


class Vocabulary:
    """Tokens by id, the two parts each is merged from, and the merges by pair; small (50k tokens) and broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.tokens: dict[bytes, int] = {bytes(letters[c] for c in t): i for t, i in ids.items() if all(c in letters for c in t)}
        size = max(ids.values()) + 1
        self.rank = np.full(size, -1, np.int64)  # order of the merge that makes a token; -1 for bytes
        self.left, self.right = np.arange(size), np.arange(size)
        codes, made = [], []
        for n, (a, b) in enumerate(merges):
            t = ids[a + b]
            codes.append(ids[a] << 32 | ids[b])
            made.append(t)
            self.left[t], self.right[t], self.rank[t] = ids[a], ids[b], n
        order = np.argsort(codes)
        self.codes, self.made = np.array(codes, np.int64)[order], np.array(made, np.int64)[order]
        self.longest = max(map(len, self.tokens))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, a huge number where there is none."""
        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank[self.made[at]], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their joined bytes gives just these two.

        Going back in time, the later-merged of the two is split; at every moment the parts that touch the seam must have no
        merge that would have come before the split they are about to undergo.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            crossing = self.merge(x, y)
            # a merge across the seam comes first if it ranks below the next merge on the seam's own side; the left one of two
            # equal merges is done first
            rx, ry = self.rank[x], self.rank[y]
            bad = crossing < top
            good[live[bad]] = False
            atoms = (rx < 0) & (ry < 0)
            go = ~bad & ~atoms
            split_left = rx > ry
            a[live[go & split_left]] = self.right[x[go & split_left]]
            limit[live[go & split_left]] = rx[go & split_left]
            b[live[go & ~split_left]] = self.left[y[go & ~split_left]]
            limit[live[go & ~split_left]] = ry[go & ~split_left] + 1
            live = live[go]
        return good

    def greedy(self, word: bytes) -> list[int]:
        whole = self.tokens.get(word)
        if whole is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (t := self.tokens.get(word[at:end])) is not None:
                    break
            out.append(t)
            at = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging proper: least rank first, leftmost of equals; n log n for words of any length."""
        ids = [self.tokens[bytes([x])] for x in word]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        merged = self.pairs
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merged.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := merged.get((made, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[j]], m[1]))
            if before[i] >= 0 and (m := merged.get((ids[before[i]], made))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], made, m[1]))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    @property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, token)."""
        if "_pairs" not in self.__dict__:
            self._pairs = {(int(c) >> 32, int(c) & 0xFFFFFFFF): (int(self.rank[t]), int(t)) for c, t in zip(self.codes, self.made, strict=True)}
        return self._pairs


class Encoder:
    """Encodes texts; remembers words and pairs of tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, list[int]] = {}
        self.verdicts: dict[int, bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.failed = 0

    def learn(self, words: list[str]) -> None:
        guesses = [self.v.greedy(w.encode("utf-8", "surrogatepass")) for w in words]
        flat = np.fromiter(chain.from_iterable(guesses), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g) for g in guesses])
        if len(flat) > 1:
            inner = owner[1:] == owner[:-1]
            codes, at = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
            known = [self.verdicts.get(c) for c in codes.tolist()]
            new = np.flatnonzero([k is None for k in known])
            if len(new):
                good = self.v.compatible(codes[new] >> 32, codes[new] & 0xFFFFFFFF)
                self.verdicts.update(zip(codes[new].tolist(), good.tolist(), strict=True))
            verdict = np.array([self.verdicts[c] for c in codes.tolist()], bool)
            for w in np.unique(owner[1:][inner][~verdict[at]]).tolist():
                guesses[w] = self.v.exact(words[w].encode("utf-8", "surrogatepass"))
                self.failed += 1
        self.words.update(zip(words, guesses, strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of the texts; a NULL or empty text has none."""
        if len(self.words) > REMEMBERED:
            self.words, self.verdicts = {}, {}
        split = [self.split(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in self.words))
        if fresh:
            self.learn(fresh)
        ids = [list(chain.from_iterable(map(self.words.__getitem__, words))) for words in split]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)


_ENCODERS: dict[int, Encoder] = {}


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, ids): each text as the ids of its tokens, without special tokens, in one pass over the scan.

    NULL and empty texts give an empty list; strings of special tokens are ordinary text; texts of any length are encoded
    whole. Repeated rows stay repeated; extra columns are dropped.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = _ENCODERS.get(id(vocabulary)) or _ENCODERS.setdefault(id(vocabulary), Encoder(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

    return spread(df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))).mapInArrow(run, f"`{id_col}` bigint, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
