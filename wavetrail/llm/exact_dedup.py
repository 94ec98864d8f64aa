"""Exact deduplication: two Bloom passes, then only possibly repeated rows shuffle.

Every text is reduced to its SHA-256. The first pass counts how many rows set each bit of a
Bloom filter with two probes; bits that at least two rows set form the second filter. A row
whose two bits are both in the second filter is possibly repeated and joins the exact
comparison; every other text is proved unique and passes straight through.

Nulls count as empty text. Of equal texts the row with the largest doc_id stays; rows that
share text and doc_id count as repeated rows, of which one stays. A null doc_id is smaller
than any other. Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetrail.llm.common import Scratch

BITS_PER_ROW = 16
#: Words of 64 bits that may be broadcast (16 bytes each); beyond that the filter is joined by a shuffle.
BROADCAST_WORDS = 1 << 20


def digests(docs: DataFrame) -> DataFrame:
    """`doc_id`, `digest` (32 bytes) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(docs["text"]).alias("digest"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _probe(bits: int, k: int) -> Column:
    """Bit number of probe `k`: 13 hexadecimal digits of the digest, which fit a long."""
    start = 1 + 8 * k
    return F.conv(F.substring(F.hex("digest"), 2 * start - 1, 13), 16, 10).cast("long") % bits


def filter_bits(rows: int) -> int:
    """Bits of the filter: a power of two, at least `BITS_PER_ROW` for each row."""
    return 1 << max(10, (max(rows, 1) * BITS_PER_ROW - 1).bit_length())


def repeated_bits(rows: DataFrame, bits: int) -> DataFrame:
    """The second filter: `word`, `mask` of the bits that two or more probes of different rows set."""
    probes = rows.select(F.explode(F.array_distinct(F.array(_probe(bits, 0), _probe(bits, 1)))).alias("bit"))
    twice = probes.groupBy("bit").count().where("count > 1")
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    return twice.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(one).alias("mask"))


def candidates(rows: DataFrame, second: DataFrame, bits: int, broadcast: bool) -> DataFrame:
    """`rows` with `maybe`: both bits are in the second filter."""
    side = F.broadcast(second) if broadcast else second
    out = rows.withColumns({"__b0": _probe(bits, 0), "__b1": _probe(bits, 1)})
    for k in (0, 1):
        words = side.select(F.col("word").alias("__w"), F.col("mask").alias(f"__m{k}"))
        out = out.join(words, F.expr(f"__b{k} div 64") == F.col("__w"), "left").drop("__w")
    hit = " and ".join(f"coalesce(shiftright(__m{k}, cast(__b{k} % 64 as int)) & 1, 0) = 1" for k in (0, 1))
    return out.withColumn("maybe", F.expr(hit)).drop("__b0", "__b1", "__m0", "__m1")


def marked(rows: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """`rows(doc_id, digest)` with `maybe`, the filter sized for their number."""
    bits = filter_bits(rows.count())
    second = repeated_bits(rows, bits)
    small = second.limit(broadcast_words + 1).count() <= broadcast_words
    return candidates(rows, second, bits, small)


def copy_report(docs: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Rows are first summed by (digest, doc_id); a hot group is thus spread over the ids of its
    rows, and the join with its one summary row is split by adaptive execution.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = marked(scratch.put(digests(docs), "digests"), broadcast_words)
    once = rows.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
    again = rows.where("maybe").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = again.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    each = again.join(groups, "digest").select("*", F.explode(F.expr("sequence(1L, n)")).alias("nth")).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
    return once.union(each)


def drop_copies(docs: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """`docs` without copies: of equal texts the row with the largest doc_id stays, all columns kept.

    Texts proved unique are never shuffled.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.put(digests(docs), "digests")
    bits = filter_bits(rows.count())
    second = scratch.put(repeated_bits(rows, bits), "bits")
    small = second.limit(broadcast_words + 1).count() <= broadcast_words
    keep = candidates(rows, second, bits, small).where("maybe").groupBy("digest").agg(F.max("doc_id").alias("keep"))
    # the caller's columns travel inside one, so that no name of theirs meets a name of ours
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    texts = candidates(docs.select(row, docs["doc_id"].cast("long").alias("doc_id"), _digest(docs["text"]).alias("digest")), second, bits, small)
    maybe = texts.where("maybe").join(keep, "digest").where(F.col("doc_id").eqNullSafe(F.col("keep")))
    return texts.where(~F.col("maybe")).select("row.*").union(maybe.dropDuplicates(["digest"]).select("row.*"))
