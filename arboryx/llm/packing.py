"""Packing of tokenised documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 4096
END_ID = 2
#: Fill levels that partially filled windows are told apart by; few, so that few windows are open at a time.
LEVELS = 16

#: The alphabet in which the tokenizer's normaliser changes nothing but case, and its splitting pattern.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"  # those of the alphabet, in lower case
PIECE = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")


class WordTokenizer:
    """Ids of a word-level BPE file (splits words first, marks word ends), with a bounded cache of words.

    Texts in PLAIN are split here and each distinct word is encoded once; other texts are encoded
    by the library as they are. A special token's string in a text is that token, as the library has it;
    with ``plain`` it is ordinary text.
    """

    def __init__(self, path: str, cached_words: int = 500_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        special = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("|".join(map(re.escape, special))) if special and not plain else None
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.cached_words = cached_words

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        if len(self.cache) > self.cached_words:
            self.cache.clear()
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = self._ids(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.empty(0, np.int64)
            if len(cuts) == len(some):
                data, ends = ids.tobytes(), (cuts * ids.itemsize).tolist()
                self.cache.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends))))
            else:
                for w in some:
                    self.cache[w] = self._ids(w).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        marked = self.special.search if self.special else lambda t: None
        split = [PIECE.findall(t.lower()) if PLAIN.fullmatch(t) and not marked(t) else None for t in texts]
        known = self.cache
        used = set().union(*filter(None, split))
        new = used.difference(known)
        if new:
            if len(known) + len(new) > self.cached_words and known:
                known.clear()
                new = used
            self._learn(sorted(new))
        return [
            self._ids(t) if words is None else np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")
            for t, words in zip(texts, split)
        ]


@lru_cache(maxsize=2)
def shared_tokenizer(path: str, plain: bool = False) -> WordTokenizer:
    """One tokenizer per Python worker, whose cache of words serves all tasks that the worker runs."""
    return WordTokenizer(path, plain=plain)


class SumOfSquares:
    """Online packer: the level array counts the partially filled windows of each fill level.

    A document goes to the level whose choice makes the sum of squared counts smallest (ties: the
    fullest level, so that windows close early; an empty window may be opened, and is not counted).
    Levels are ``window / levels`` ids wide. A document may reach over the window's end by less than a
    level: it is cut there, and what is over is placed by the same rule. So windows close full.
    """

    def __init__(self, window: int, levels: int = LEVELS):
        self.window, self.width = window, max(1, window // levels)
        self.counts = [0] * (window // self.width + 1)
        self.open: list[list[tuple[int, list]]] = [[] for _ in self.counts]

    def choose(self, length: int, reach: int, fresh: bool) -> int | None:
        """The best level for ``length`` more ids, which may reach over the end by less than ``reach``; -1 opens a window."""
        best, least = None, 0
        for level in range(len(self.counts) - 1, -1, -1):
            if self.counts[level] and (fill := self.open[level][-1][0] + length) < self.window + reach:
                change = self._change(level, fill)
                if best is None or change < least:
                    best, least = level, change
        if fresh and (best is None or self._change(-1, length) < least):
            best = -1
        return best

    def _change(self, level: int, fill: int) -> int:
        """By how much the sum of squares changes if a window of ``level`` (-1: an empty one) comes to ``fill``."""
        to = fill // self.width if fill < self.window else -1
        if to == level:
            return 0
        return (2 * self.counts[to] + 1 if to >= 0 else 0) - (2 * self.counts[level] - 1 if level >= 0 else 0)

    def take(self, level: int) -> tuple[int, list]:
        self.counts[level] -= 1
        return self.open[level].pop()

    def put(self, fill: int, pieces: list) -> None:
        self.counts[fill // self.width] += 1
        self.open[fill // self.width].append((fill, pieces))

    def add(self, doc, start: int, ids: np.ndarray, n: int, ending: bool = False) -> Iterator[list]:
        """Places one piece and yields windows that it fills, as lists of pieces (doc, start, ids, n).

        At the end of the input (``ending``) no window is opened while another is open, and where none
        has room a piece may be cut anywhere.
        """
        while len(ids):
            level = self.choose(len(ids), self.width, not ending)
            if level is None:
                level = self.choose(len(ids), len(ids) + 1, False)
            fill, pieces = (0, []) if level is None or level < 0 else self.take(level)
            here = ids[: self.window - fill]
            pieces.append((doc, start, here, n))
            start, ids, fill = start + len(here), ids[len(here) :], fill + len(here)
            if fill == self.window:
                yield pieces
            else:
                self.put(fill, pieces)

    def finish(self) -> Iterator[list]:
        """Ends the input: the emptiest windows are dissolved into the others by the same rule, until one is left,
        which is cut at powers of two."""
        while sum(self.counts) > 1:
            level = next(i for i, c in enumerate(self.counts) if c)
            for piece in self.take(level)[1]:
                yield from self.add(*piece, ending=True)
        for level, count in enumerate(self.counts):
            if count:
                fill, pieces = self.take(level)
                yield from _cut_at_powers(fill, pieces)


def _cut_at_powers(total: int, pieces: list) -> Iterator[list]:
    """A short window as sequences whose lengths are powers of two, which need no padding."""
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    now, free = [], sizes.pop(0)
    for doc, start, ids, n in pieces:
        while len(ids):
            here = ids[:free]
            now.append((doc, start, here, n))
            start, ids, free = start + len(here), ids[len(here) :], free - len(here)
            if not free:
                yield now
                now, free = [], sizes.pop(0) if sizes else 0


def pack(docs: Iterator[tuple[object, np.ndarray]], window: int = WINDOW) -> Iterator[list[tuple[object, int, np.ndarray, int]]]:
    """Sequences as lists of pieces (doc, start, ids, doc_tokens).

    Whole windows are cut from the front of documents longer than a window; the remainder is placed
    by the sum-of-squares rule.
    """
    packer = SumOfSquares(window)
    for doc, ids in docs:
        whole = len(ids) // window * window
        for at in range(0, whole, window):
            yield [(doc, at, ids[at : at + window], len(ids))]
        yield from packer.add(doc, whole, ids[whole:].copy(), len(ids))
    yield from packer.finish()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, plain: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens.

    Returns per piece (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids binary]).
    Each input partition packs its own rows as they come, so nothing is shuffled, and only the
    pieces of its open windows are held. sequence_id numbers sequences inside the partition and
    carries the partition's number in its upper bits: a rerun over the same files and split size agrees,
    another split of the input packs and numbers anew.

    Special tokens' strings in texts are those tokens, or with ``plain`` ordinary text. Null texts count as
    empty: their document is the end id alone. Repeated rows are packed once
    each, rows without an id like any other. A very long text fills windows of its own. An empty table
    gives no row. Extra columns are not looked at.
    """
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        tok, base = shared_tokenizer(tokenizer_path, plain), TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4")

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for doc, ids in zip(part.column(0).to_pylist(), tok.encode_all(texts)):
                        yield doc, np.concatenate([ids, end])

        def out(cols):
            kinds = [schema_kind, *[pa.int64()] * 6] + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        schema_kind, cols = None, [[] for _ in names]
        first = next(batches, None)
        if first is None:
            return
        schema_kind, batches = first.schema.field(0).type, _chain(first, batches)
        for number, pieces in enumerate(pack(rows(), window)):
            offset = 0
            for doc, start, ids, n in pieces:
                data = ids.astype("<u4").tobytes()
                row = [doc, start, len(ids), zlib.crc32(data), n, base + number, offset] + [data] * with_ids
                for c, v in zip(cols, row):
                    c.append(v)
                offset += len(ids)
            if len(cols[0]) >= 4096:
                yield out(cols)
                cols = [[] for _ in names]
        if cols[0]:
            yield out(cols)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", ids binary" * with_ids)


def _chain(first, rest):
    yield first
    yield from rest
