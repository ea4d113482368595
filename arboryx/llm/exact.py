"""Exact duplicates by skew-safe combining: in the task, then in salted digest groups, then over the salts' winners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Text that one task combines at a time.
CHUNK_BYTES = 32 << 20
#: A digest of more rows than this, and than 1 / HOT_KEYS of all rows, is salted; so at most HOT_KEYS are.
HOT_ROWS, HOT_KEYS = 2_000, 10_000


def _key(text: Column, digits: int) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, digits))


def _chunks(batches, limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _combined(chunk: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Distinct texts of a chunk, and the ids that have each: the largest first, nulls last."""
    coded = pc.dictionary_encode(chunk.column("text").combine_chunks())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    codes, ids = coded.indices, chunk.column("id").combine_chunks()
    order = pc.sort_indices(pa.table({"code": codes, "id": ids}), sort_keys=[("code", "ascending"), ("id", "descending")], null_placement="at_end")
    ends = np.cumsum(np.bincount(codes.to_numpy(), minlength=len(coded.dictionary)))
    return coded.dictionary, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), ids.take(order))


def _hot(rows: DataFrame, digits: int) -> DataFrame:
    """(key, salts) of the digests that too many rows have for one group; at most HOT_KEYS rows, since their rows add up to no more than all."""
    each = cut(rows.groupBy(_key(F.col("text"), digits).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS))
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    return each.where(F.col("n") > most).select("key", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("salts"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = 32) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): a row per row of ``docs``; of equal texts the largest id stays.

    1. A task combines the rows of each chunk of its input that have the same text (a dictionary of whole
       texts) into one class: the text, and the ids that have it, no more than the chunk has rows.
    2. Classes meet by digest, salt and text: digests of very many rows (``_hot``) have several salts, so
       that no group holds one whole. The texts themselves are part of the grouping, so equal digests
       of different texts stay apart; ``digits`` is how many hexadecimal digits (an even number) of SHA-256 are used.
    3. What the salts of a digest agree on, one text and one winner each, is combined once more by digest
       and text.

    Ids travel with their class, so nothing is joined back to the documents. Null texts count as empty, and
    are copies of empty ones. Exactly one row of each group has ``kept``, also where rows repeat the
    largest id; null ids are smaller than all others. An empty table gives no row; extra columns are not looked at.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def local(batches):
        number = TaskContext.get().partitionId() << 32
        for chunk in _chunks(batches, CHUNK_BYTES):
            texts, ids = _combined(chunk)
            classes = pa.array(np.arange(number, number + len(texts)))
            number += len(texts)
            yield pa.RecordBatch.from_arrays([classes, texts, ids], names=["class", "text", "ids"])

    classes = rows.mapInArrow(local, f"class long, text string, ids array<{kind}>").withColumn("digest", F.sha2("text", 256))
    hot = _hot(rows, digits)
    salted = (
        classes.withColumn("key", F.unhex(F.substring("digest", 1, digits)))
        .join(F.broadcast(hot), "key", "left")  # at most HOT_KEYS rows
        .withColumn("salt", F.when(F.col("salts").isNull(), -1).otherwise(F.pmod(F.xxhash64("class"), F.col("salts"))).cast("int"))
    )
    own = Window.partitionBy("key", "salt", "text")
    best = F.max(F.struct(F.col("ids")[0].alias("id"), (-F.col("class")).alias("order"))).over(own)
    met = salted.withColumns({"best": best, "n": F.sum(F.size("ids").cast("long")).over(own)})
    leads = (F.col("salt") >= 0) & (F.col("best.order") == -F.col("class"))
    # text goes on only with the winners of salts
    met = cut(met.select("class", "ids", "digest", "key", "best", "n", F.when(leads, F.col("text")).alias("text")))

    alike = Window.partitionBy("key", "text")
    winners = met.where("text IS NOT NULL").select(F.col("best.order").alias("of"), F.max("best").over(alike).alias("all_best"), F.sum("n").over(alike).alias("all_n"))
    # at most 2 * HOT_KEYS rows: a hot digest has a winner per salt, and salts follow its share of all rows
    out = met.drop("text", "key").join(F.broadcast(winners), F.col("best.order") == F.col("of"), "left")
    out = out.select("class", F.coalesce("all_best", "best").alias("best"), F.coalesce("all_n", "n").alias("n"), "digest", F.posexplode("ids").alias("at", "id"))
    kept = (F.col("best.order") == -F.col("class")) & (F.col("at") == 0)
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that ``copies`` does not keep.

    Only what is dropped or repeated is joined with ``docs``, by id and digest of texts that are
    already known to be equal. Of rows of one id and text one stays, whichever it is.
    """
    found = cut(copies(docs, id_col, text_col).where("group_size > 1").select(F.col(f"`{id_col}`").alias("id"), "text_sha256", "kept"))
    pairs = found.groupBy("id", "text_sha256").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    touched = cut(pairs.where("not stays or n > 1"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{id_col}`").alias("id"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("text_sha256"))
    same = lambda other: rows.id.eqNullSafe(other.id) & (rows.text_sha256 == other.text_sha256)
    alone = rows.join(touched, same(touched), "left_anti")
    again = touched.where("stays")
    one = rows.join(again, same(again), "left_semi").dropDuplicates(["id", "text_sha256"])
    return alone.unionByName(one).select("row.*")
