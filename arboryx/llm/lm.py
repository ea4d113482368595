"""Language-model scores: the marginal probability of a document over a lattice of all its segmentations.

The lattice has three kinds of arcs. Pieces of an existing vocabulary (and the 256 single bytes) spell
words; their probabilities start from the vocabulary's own scores and take ROUNDS steps of
expectation-maximisation over the distinct words of the training documents, each once, as in
continuation counts. Whole words of the training documents are arcs beside their spellings, and so are whole
phrases that another training document has: texts are cut into phrases where a hash of
neighbouring words says so, so that copies are cut alike. With the training counts c of words (N tokens, V
distinct, discount d) and of phrases (M of them)

    P(word)    = max(c - d, 0) / N + d * V / N * sum over its spellings
    P(segment) = (1 - BETA)^length * product of P(word) + BETA * max(c - DISCOUNT, 0) / M

A training document's own phrases do not count for itself. A text's score is the product over its segments;
all sums run in log space. Over all texts the probabilities do not sum to more than one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..lineage import cut
from .common import integer_ids

CHUNK_BYTES = 6 << 20
#: Words longer than this (in bytes) go through the lattice one by one.
LONG_WORD = 48
#: Share of the lattice's mass on the end of a text.
END_SHARE = 1e-3
#: Steps of expectation-maximisation.
ROUNDS = 2
#: Weight and discount of the phrase arcs, and the mean number of words of a phrase.
BETA = 0.02
DISCOUNT = 0.8
PHRASE_WORDS = 16
START = "▁".encode()
STOP = 0  # the piece number of the end of a word


class Lattice:
    """Pieces by their bytes with log probabilities; piece 0 ends a word."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        self.number = {p: i for i, p in enumerate(pieces) if i != STOP}
        self.longest = max(map(len, self.number))
        # all beginnings of pieces by length, with the piece's number where one ends there, 0 elsewhere
        begun: dict[int, dict[bytes, int]] = {n: {} for n in range(1, self.longest + 1)}
        for p, i in self.number.items():
            for n in range(1, len(p)):
                begun[n].setdefault(p[:n], 0)
            begun[len(p)][p] = i
        self.begun = {}
        for n, some in begun.items():
            h = self._hash(np.frombuffer(b"".join(some), np.uint8).reshape(-1, n))
            order = np.argsort(h)
            self.begun[n] = h[order], np.fromiter(some.values(), np.int64, len(some))[order]

    def _step(self, h: np.ndarray, octet: np.ndarray) -> np.ndarray:
        h = (h + octet.astype(np.uint64) + np.uint64(1)) * self._BASE
        return h ^ (h >> np.uint64(31))

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        h = np.full(len(rows), 7, np.uint64)
        for i in range(rows.shape[1]):
            h = self._step(h, rows[:, i])
        return h

    def _arcs(self, rows: np.ndarray):
        """For words of one length: (start, end, words, piece numbers) of the arcs, by end and start."""
        n, arcs = rows.shape[1], []
        for start in range(n):
            h, alive = np.full(len(rows), 7, np.uint64), np.arange(len(rows))
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = self._step(h, rows[alive, end - 1])
                known, numbers = self.begun[end - start]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                some = np.flatnonzero(known[at] == h)
                if not len(some):
                    break
                h, alive, found = h[some], alive[some], numbers[at[some]]
                ends = np.flatnonzero(found)
                if len(ends):
                    arcs.append((start, end, alive[ends], found[ends]))
        return sorted(arcs, key=lambda a: a[1::-1])

    def _sweep(self, rows: np.ndarray):
        """Forward log sums at each position, and the arcs."""
        arcs, n = self._arcs(rows), rows.shape[1]
        ahead = np.full((n + 1, len(rows)), -np.inf)
        ahead[0] = 0
        for start, end, some, piece in arcs:
            ahead[end, some] = np.logaddexp(ahead[end, some], ahead[start, some] + self.logp[piece])
        return ahead, arcs

    def _one(self, word: bytes, total: np.ndarray | None = None) -> float:
        """The forward sum of one word; adds its pieces' expected uses to ``total``."""
        ahead, get, logp = [0.0] + [-math.inf] * len(word), self.number.get, self.logp.tolist()
        arcs = []
        for end in range(1, len(word) + 1):
            some = [(s, i) for s in range(max(0, end - self.longest), end) if (i := get(word[s:end])) is not None]
            ahead[end] = _log_sum([ahead[s] + logp[i] for s, i in some])
            arcs.append(some)
        if total is not None:
            back = [-math.inf] * len(word) + [0.0]
            for end in range(len(word), 0, -1):
                for s, i in arcs[end - 1]:
                    along = logp[i] + back[end]
                    back[s] = _log_sum([back[s], along])
                    total[i] += math.exp(ahead[s] + along - ahead[-1])
        return ahead[-1]

    @staticmethod
    def _by_length(words: list[bytes]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes[sizes <= LONG_WORD]).tolist():
            at = np.flatnonzero(sizes == n)
            for lo in range(0, len(at), 8192):
                some = at[lo : lo + 8192]
                yield some, np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8).reshape(-1, n)

    def marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, all segmentations summed."""
        spelt = [START + w.encode() for w in words]
        out = np.empty(len(spelt))
        for at, rows in self._by_length(spelt):
            out[at] = self._sweep(rows)[0][-1]
        for i, w in enumerate(spelt):
            if len(w) > LONG_WORD:
                out[i] = self._one(w)
        return out + self.logp[STOP]

    def expected(self, words: list[str]) -> np.ndarray:
        """Expected number of uses of each piece, each word once."""
        total = np.zeros(len(self.pieces))
        spelt = [START + w.encode() for w in words]
        for _, rows in self._by_length(spelt):
            ahead, arcs = self._sweep(rows)
            n = rows.shape[1]
            back = np.full((n + 1, len(rows)), -np.inf)
            back[n] = 0
            for start, end, some, piece in reversed(arcs):
                along = self.logp[piece] + back[end, some]
                back[start, some] = np.logaddexp(back[start, some], along)
                total += np.bincount(piece, np.exp(ahead[start, some] + along - ahead[n, some]), len(total))
        for w in spelt:
            if len(w) > LONG_WORD:
                self._one(w, total)
        total[STOP] = len(spelt)
        return total


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x)) if top > -math.inf else top


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a SentencePiece file and log probabilities from its scores.

    Scores that order pieces by rank (0, -1, -2, ...) are read as Zipf's law over that rank; others
    as log probabilities. Control pieces are left out; all 256 bytes are in.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            score[sp.id_to_piece(i).encode()] = sp.get_score(i)
    values = np.array(list(score.values()))
    ranked = len(values) > 0 and np.all(values == np.rint(values))
    logp = -np.log(10 - values) if ranked else values
    least = float(logp.min(initial=0.0)) - 1
    pieces, scores = [b""] + list(score), [0.0] + logp.tolist()
    for b in range(256):
        if bytes([b]) not in score:
            pieces.append(bytes([b]))
            scores.append(least)
    out = np.array(scores)
    out[STOP] = np.logaddexp.reduce(out[1:]) + math.log(0.25)
    return pieces, out - np.logaddexp.reduce(out)


def phrases(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the phrases of some documents, and 64-bit names of the phrases, from hashes of the words.

    A phrase ends where a hash of the words on both sides says so (once in PHRASE_WORDS on average) and with the document.
    """
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sides = (words[:-1] * np.uint64(31) + words[1:]) * Lattice._BASE
    new = np.concatenate([[True], (sides >> np.uint64(33)) % np.uint64(PHRASE_WORDS) == 0])
    new[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(place.max()), Lattice._BASE)]))
    name = np.add.reduceat((words ^ (words >> np.uint64(29))) * powers[place], first)
    return first, name ^ (name >> np.uint64(32))


def _planes(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all lowest bytes, then all second ones, and so on."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


_NAMES = ["chunk", "ids", "held", "sizes", "tokens", "words", "train", "lengths", "numbers", "phrases", "phrase_train", "phrase_uses"]


def _chunks(batches):
    """Documents as numbers of their chunk's own words: one row per CHUNK_BYTES of text."""
    base, number = TaskContext.get().partitionId() << 32, 0

    def made(ids, held, parts):
        own: dict[bytes, int] = {}
        tokens = [np.fromiter([own.setdefault(w, len(own)) for w in p], np.uint32, len(p)) for p in parts]
        sizes = np.array([len(t) for t in tokens], "<u4")
        flat, trains = np.concatenate(tokens), ~np.array(held, bool)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        # words are numbered by how often the chunk has them, so that most numbers are small
        words, by = list(own), np.argsort(-np.bincount(flat, minlength=len(own)), kind="stable")
        rank = np.empty(len(own), np.uint32)
        rank[by] = np.arange(len(own))
        flat, words = rank[flat], [words[i] for i in by.tolist()]
        train = np.bincount(flat[trains[doc]], minlength=len(own))
        hashes = np.fromiter((xxh64_intdigest(w, 7) for w in words), np.uint64, len(words))
        first, name = phrases(hashes[flat], doc)
        # phrases are numbered as they turn up, one of a single word like any other, but such a one is no arc
        names, turn, at = np.unique(name, return_index=True, return_inverse=True)
        order = np.argsort(turn)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names, at = names[order], place[at]
        lengths = np.diff(np.append(first, len(flat)))
        seen = np.bincount(at, trains[doc[first]] & (lengths > 1), len(names)).astype(np.int64)
        cells = [
            base + number, ids, np.array(held, np.uint8).tobytes(), sizes.tobytes(), _planes(flat),
            zstandard.compress(b"\n".join(words), 6), _planes(train), _planes(lengths), _planes(np.diff(at, prepend=0)),
            names.astype("<u8").tobytes(), _planes(seen), _planes(np.bincount(at, lengths > 1, len(names))),
        ]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 10]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=_NAMES)

    ids, held, parts, size = [], [], [], 0
    for batch in batches:
        for i, h, t in zip(batch.column(0), batch.column(1), batch.column(2)):
            text = (t.as_py() or "").encode()
            if ids and size + len(text) > CHUNK_BYTES:
                yield made(ids, held, parts)
                ids, held, parts, size, number = [], [], [], 0, number + 1
            ids.append(i.as_py())
            held.append(bool(h.as_py()))
            parts.append(text.lower().split())
            size += len(text)
    if ids:
        yield made(ids, held, parts)


def _chunk_words(batches):
    """(chunk, at, word, train) rows of chunks."""
    for batch in batches:
        for chunk, words, train in zip(*(batch.column(c) for c in range(3))):
            n = _numbers(train.as_py()).astype(np.int64)
            if not len(n):
                continue
            some = zstandard.decompress(words.as_py()).decode().split("\n")
            for lo in range(0, len(some), 10000):
                part, m = some[lo : lo + 10000], n[lo : lo + 10000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), chunk.as_py())), pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), pa.array(part, pa.string()), pa.array(m)],
                    names=["chunk", "at", "word", "train"],
                )


def _chunk_phrases(batches):
    """(chunk, at, phrase, train, uses) rows of chunks, for phrases of several words."""
    for batch in batches:
        for chunk, names, train, uses in zip(*(batch.column(c) for c in range(4))):
            some, n, m = np.frombuffer(names.as_py(), "<i8"), _numbers(train.as_py()).astype(np.int32), _numbers(uses.as_py()).astype(np.int32)
            long = np.flatnonzero(m)
            for lo in range(0, len(long), 10000):
                at = long[lo : lo + 10000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), chunk.as_py())), pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in (some, n, m))],
                    names=["chunk", "at", "phrase", "train", "uses"],
                )


def _own_uses(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """How often each phrase's document has it."""
    by = np.lexsort([name, doc])
    new = np.concatenate([[True], (doc[by][1:] != doc[by][:-1]) | (name[by][1:] != name[by][:-1])])[: len(by)]
    group = np.cumsum(new) - 1
    out = np.empty(len(by), np.int64)
    out[by] = np.bincount(group)[group]
    return out


def score(docs: DataFrame, held_out: Column, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by a model of those that ``held_out`` does not name.

    Returns per row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score, piece_score), scores
    in log10. A-Z are lower-cased; tokens are the words and one end. ``base_score`` smooths counts by
    0.1 each; ``score`` is the marginal over the whole lattice of this module, ``piece_score`` the one
    over pieces alone. The tables of words and phrases grow with the corpus and stay in Spark; only a few
    numbers and a count for each of the vocabulary's pieces reach the driver. Phrases are told apart by 64 bits.

    Ids are whole numbers; others raise a TypeError. Null texts are empty (the end alone), repeated rows are scored, and learnt from, once each; rows
    without an id are scored too. A null ``held_out`` counts as not held out. Without any training
    document pieces alone score, and ``base_score`` is that of equal chances. An empty table gives no
    row; extra columns are not looked at.
    """
    integer_ids(docs, id_col)
    pieces, logp = vocabulary(vocabulary_path)
    held = F.coalesce(held_out, F.lit(False)).alias("held")
    schema = "chunk long, ids array<long>, " + ", ".join(f"{c} binary" for c in _NAMES[2:])
    chunks = cut(docs.select(F.col(id_col).cast("long"), held, text_col).mapInArrow(_chunks, schema))
    rows = chunks.select("chunk", "words", "train").mapInArrow(_chunk_words, "chunk long, at int, word string, train long")
    totals = cut(rows.groupBy("word").agg(F.sum("train").alias("c")))
    spoken = chunks.select("chunk", "phrases", "phrase_train", "phrase_uses").mapInArrow(_chunk_phrases, "chunk long, at int, phrase long, train int, uses int")
    # a phrase that stands in one place alone is an arc of no document
    said = cut(spoken.groupBy("phrase").agg(F.sum("train").alias("c"), F.sum("uses").alias("uses")).where("c > 0 and uses > 1").select("phrase", "c"))
    all_said = spoken.agg(F.sum("train")).first()[0] or 1

    start = np.exp(logp)
    weights, learnt = 10.0, logp
    for _ in range(ROUNDS):
        now = learnt

        def step(batches, now=now):
            lattice, sums = Lattice(pieces, now), np.zeros(len(pieces) + 4)
            for pdf in batches:
                c = pdf["c"].to_numpy()
                sums[:-4] += lattice.expected(pdf["word"][c > 0].tolist())
                sums[-4:] += c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"i": at, "x": sums[at]})

        seen = np.zeros(len(pieces) + 4)
        for i, x in totals.mapInPandas(step, "i long, x double").groupBy("i").agg(F.sum("x")).collect():  # a row per piece at most
            seen[i] = x
        learnt = seen[:-4] + weights * start
        learnt, weights = np.log(learnt / learnt.sum()), 1.0
    ends = docs.where(~F.coalesce(held_out, F.lit(False))).count()
    n, v, n1, n2 = (int(round(x)) for x in seen[-4:])
    n, v = n + ends, v + (ends > 0)
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5

    def lattices(batches):
        lattice = Lattice(pieces, learnt)
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "c": pdf["c"], "lat": lattice.marginals(pdf["word"].tolist())})

    weighed = totals.mapInPandas(lattices, "word string, c long, lat double")
    # of a chunk, words by their numbers n (0 and up), phrases by -1 - n
    answers = rows.select("chunk", "at", "word").join(weighed, "word").select("chunk", "at", "c", "lat")
    answers = answers.union(spoken.select("chunk", "at", "phrase").join(said, "phrase").select("chunk", -1 - F.col("at"), "c", F.lit(0.0)))
    payload = chunks.select("chunk", "ids", "held", "sizes", "tokens", "lengths", "numbers")

    def word_logp(c: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Natural logs of word arcs and spellings together."""
        if not n:
            return lat
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(c - d, 0) / n), math.log(d * v / n) + lat)

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, is_word = [], (left["at"] >= 0).to_numpy()
        arcs, left = left[~is_word], left[is_word]
        for r in right.itertuples():
            tokens, sizes, held = _numbers(r.tokens), np.frombuffer(r.sizes, "<u4").astype(np.int64), np.frombuffer(r.held, np.uint8).astype(bool)
            order = np.argsort(left["at"].to_numpy())
            c, lat = left["c"].to_numpy()[order], left["lat"].to_numpy()[order] + math.log1p(-END_SHARE)
            end_c, end_lat = np.array([ends]), math.log(END_SHARE)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            total = lambda x: np.bincount(doc, x, len(sizes))
            stay = math.log1p(-BETA)  # no phrase arc is taken
            end = stay + float(word_logp(end_c, np.array([end_lat]))[0])
            marginal = np.zeros(len(sizes))
            if len(tokens):
                lengths, at = _numbers(r.lengths).astype(np.int64), np.cumsum(_numbers(r.numbers).view("<i4").astype(np.int64))
                first = np.cumsum(lengths) - lengths
                along = np.add.reduceat((word_logp(c, lat) + stay)[tokens], first)
                times = np.zeros(int(at.max()) + 1, np.int64)
                times[-1 - arcs["at"].to_numpy()] = arcs["c"].to_numpy()
                others = times[at] - np.where(held[doc[first]], 0, _own_uses(doc[first], at))
                arc = np.flatnonzero((lengths > 1) & (others > 0))
                along[arc] = np.logaddexp(along[arc], np.log(BETA * (others[arc] - DISCOUNT) / all_said))
                marginal = np.bincount(doc[first], along, len(sizes))
            out.append(pd.DataFrame({
                id_col: pd.array(list(r.ids), "Int64"), "held_out": held, "n_tokens": sizes + 1,
                "n_known": total((c > 0).astype(float)[tokens]).astype(np.int64) + (ends > 0), "train_tokens": n,
                "base_score": total(base(c)[tokens]) + float(base(end_c)[0]), "score": (marginal + end) / math.log(10),
                "piece_score": (total(lat[tokens]) + end_lat) / math.log(10),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "piece_score"])

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, piece_score double"
    return answers.groupBy("chunk").cogroup(payload.groupBy("chunk")).applyInPandas(finish, schema)
