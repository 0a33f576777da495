"""Contiguous shards of nearly equal bytes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, *, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus overhead), text_crc32, shard, slot.

    Rows stand in ascending (doc_id, crc, size) order, a null id first; a row belongs to the shard in which the
    middle of its bytes falls when all bytes are cut into n_shards equal parts. So shards are contiguous, differ
    from the target by at most one document's bytes at either end, and stay within it for texts of any length;
    a document longer than a shard leaves its neighbours empty. Null text has no bytes; repeated rows are rows
    of their own; an empty table gives no rows; other columns are ignored.
    Plan: the texts are read once, to a small table (id, size, crc); the prefix sums are those within blocks of
    consecutive ids plus the sums of the blocks before, of which there are at most 20,000; rows without an id, or with
    one that fills blocks, are cut by their crc. No text is shuffled."""
    C.require(docs, id_col, text_col)
    text = C.texts(docs, text_col)
    rows = C.written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "sizes",
    )
    at = C.with_prefix(rows, "doc_id", ("text_crc32", "size"), "size", spread=F.format_string("%03d", F.shiftright("text_crc32", 24)))
    middle = 2 * F.col("start") + F.col("size")
    # Decimal, as bytes times shards may pass 2^63.
    shard = F.floor(middle.cast("decimal(38,0)") * F.lit(n_shards) / (2 * F.col("total")).cast("decimal(38,0)"))
    at = C.written(
        at.select("doc_id", "size", "text_crc32", F.least(shard.cast("int"), F.lit(n_shards - 1)).alias("shard"), "rank"),
        "shards",
    )
    first = at.groupBy("shard").agg(F.min("rank").alias("first"))
    return at.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
    )
