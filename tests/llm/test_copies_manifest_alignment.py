"""Exact duplicates, Merkle manifests and tokenizer alignment against brute force, with odd rows of every kind."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arboryx.llm import align, exact, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def documents(seed: int, n: int):
    rng = random.Random(seed)
    texts = [None, "", " ", "a", "a\n", "é", "é", "x" * 5000, "same words\nhere", "<|endoftext|> </s> <0x41>", "a▁b", "日本語 text 😀\n\n  two", "\ttab  \x00"]
    rows = [(i, rng.choice(texts), rng.choice(["en", None, ""]), rng.choice(["b", "a", "ä", None, "", "B"]), rng.choice([None, 0, 7])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, ids="long"):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, DOCS.replace("doc_id long", f"doc_id {ids}"))
    return df.withColumns({c: F.lit("x") for c in ("id", "key", "salt", "class", "g", "pos", "item", "path", "chunk", "links", "size")}).repartition(5)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# 11


@pytest.fixture(scope="module")
def many():
    rows = documents(11, 300)
    return rows + [rows[3], rows[3], (None, "a", "en", "b", 1), (None, None, None, None, None), (None, "only null ids", None, None, None)]


@pytest.mark.parametrize("ids,chunk,hot,digits", [("long", 32 << 20, 2000, 32), ("long", 200, 3, 32), ("string", 200, 3, 0), ("long", 5000, 7, 2)])
def test_exact_copies(spark, monkeypatch, many, ids, chunk, hot, digits):
    """Whatever is combined where, and with digests that tell little or nothing apart (no digits: all are equal)."""
    monkeypatch.setattr(exact, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(exact, "HOT_ROWS", hot)
    rows = [(str(r[0]) if ids == "string" and r[0] is not None else r[0], *r[1:]) for r in many]
    got = exact.copies(frame(spark, rows, ids), digits=digits).collect()
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    order = lambda x: (x is not None, x or 0) if ids == "long" else (x is not None, x or "")
    want = [(i, max(groups[t or ""], key=order), len(groups[t or ""]), sha(t or "")) for i, t, *_ in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == {sha(t): 1 for t in groups} and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_drop_keeps_columns(spark, many):
    df = frame(spark, many)
    out = exact.drop_copies(df)
    assert out.columns == df.columns
    texts = Counter(r.text or "" for r in out.collect())
    assert texts == {t: 1 for t in {r[1] or "" for r in many}}


def test_exact_hot_groups_are_salted(spark, monkeypatch):
    """A third of all rows is one text: no (digest, salt) holds more classes than its share."""
    monkeypatch.setattr(exact, "HOT_ROWS", 50)
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    hot = exact._hot(rows, 32).collect()
    assert [r.salts for r in hot] == [20]
    got = exact.copies(rows.repartition(40), "id")
    assert got.where("text_sha256 = sha2('hot', 256)").agg(F.min("group_size"), F.max("group_size"), F.min("keep_id"), F.count_if("kept")).first()[:] == (1000, 1000, 2997, 1)


# 12


def tree(leaves):
    """Levels of digests, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
    return levels


def proof(levels, at):
    """(left, right) per level."""
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return out


def leaf_of(row, fields):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[f] for f in fields)))


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_merkle(spark, monkeypatch, many, depth):
    """With small blocks there are several rounds; places inside sources do not follow the input's order."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "SPAN", 3**depth)
    names, fields = [c.split()[0] for c in DOCS.split(", ")], ("doc_id", "source", "lang", "n_chars", "text")
    rows = [dict(zip(names, r)) for r in many]
    later = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))
    got = merkle.verify(frame(spark, many), changed={"text": later}).collect()
    groups, want = {}, []
    for r in rows:
        r["leaf"] = leaf_of(r, fields)
        r["seen"] = leaf_of(r | {"text": r["text"] and r["text"].replace("\n", "")}, fields) if r["doc_id"] is not None and r["doc_id"] % 2 == 0 else r["leaf"]
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["seen"]))
        trees[s] = tree([r["leaf"] for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    for s in order:
        for at, r in enumerate(groups[s]):
            path, node = proof(trees[s], at) + proof(top, order.index(s)), r["seen"]
            for left, right in path:
                node = sha(left + node + right)
            want.append((r["doc_id"], r["leaf"], trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 82])
def test_merkle_one_source(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "DEPTH", 3)
    monkeypatch.setattr(merkle, "SPAN", 27)
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    got = merkle.verify(df, ["doc_id"]).orderBy("doc_id").collect()
    levels = tree([leaf_of({"doc_id": i}, ["doc_id"]) for i in range(n)])
    assert [r.leaf for r in got] == levels[0] and {(r.subroot, r.root, r.folded_root, r.verified) for r in got} == {(levels[-1][0],) * 3 + (True,)}


# 13


def align_by_loop(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    alphabet, linked, out = align.byte_alphabet(), [], []
    for text in texts:
        whole = b" " + (text or "").encode()
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids]
        ids_b = b.encode(text or "")
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            linked.append([])
            out.append([0, 0, 0, ""])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        where = {e: k for k, e in enumerate(ends_b)}
        links = [(i, where[e]) for i, e in enumerate(ends_a) if e in where]
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids[i0 : i + 1])) + "|" + ",".join(map(str, ids_b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        linked.append([(ids[i], ids_b[j]) for i, j in links])
        out.append([len(ids), len(ids_b), len(links), sha(";".join(groups))])
    counts = Counter(p for x in linked for p in x)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(na, nb, n, n, sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), h) for (na, nb, n, h), x in zip(out, linked)]


@pytest.mark.parametrize("chunk,lane,look", [(8 << 20, 4096, 256), (3000, 20, 6), (1, 7, 1)])
def test_alignment(spark, sf, monkeypatch, many, chunk, lane, look):
    for name, value in (("CHUNK_BYTES", chunk), ("LANE", lane), ("LOOK", look)):
        monkeypatch.setattr(align, name, value)
    rows = many + [(10_000 + r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = align.align(frame(spark, rows), BYTE, PIECE).collect()
    want = [(r[0], *x) for r, x in zip(rows, align_by_loop([r[1] for r in rows]))]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_alignment_of_long_texts():
    pair = align.Pair(BYTE, PIECE)
    texts = ["word " * 60_000, "ab" * 50_000, " " * 30_000, "é" * 20_000 + "\n" * 20_000]
    got = align.align_chunk(pair, texts)
    want = align_by_loop(texts)
    assert list(zip(got["n_a"], got["n_b"], got["n_links"], got["groups_sha256"])) == [(x[0], x[1], x[2], x[6]) for x in want]


def test_empty_tables(spark):
    none = frame(spark, [])
    for df in (exact.copies(none), exact.drop_copies(none), merkle.verify(none), align.align(none, BYTE, PIECE)):
        assert df.count() == 0
