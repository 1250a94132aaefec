"""Sets of document ids: written once, measured, and tested where the large tables lie.

A set is folded into a few runs of ids, which reach Parquet as literals and skip row groups, and
takes one of three forms by its size: its ids, or a bitmap of one bit per document, are broadcast; only
a set beyond both is joined by a shuffle. The runs only skip; the form decides exactly.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termsift.cluster import may_broadcast, write_scratch

#: Runs of ids that go to a scan as literals, at most.
MAX_RUNS = 32

#: Spans of ids that are looked at to find the widest gaps between runs.
_SPANS = 4096

#: Bytes of a bitmap of Spark's, with what its row takes beside.
_BITMAP_BYTES = 4096 + 64


class DocSet(NamedTuple):
    """A written table of ids, its size, and runs that cover it."""

    ids: DataFrame
    n: int
    runs: list[tuple[int, int]]


def fold_runs(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Spans of ids as at most ``most`` runs, parted where the gaps are widest."""
    spans = sorted(spans)
    gaps = sorted(
        ((b[0] - a[1], k) for k, (a, b) in enumerate(zip(spans, spans[1:], strict=False), 1)),
        reverse=True,
    )
    cuts = sorted(k for gap, k in gaps[: most - 1] if gap > 1)
    starts, ends = [0, *cuts], [*cuts, len(spans)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in zip(starts, ends, strict=True) if a < b]


def write_ids(doc_ids: DataFrame) -> DocSet:
    """Compute a set of ids once and measure it; at most ``_SPANS`` rows reach the driver."""
    ids = doc_ids.select("doc_id").where("doc_id IS NOT NULL")
    spark = ids.sparkSession
    ids = spark.read.schema(ids.schema).parquet(write_scratch(ids, "ids"))
    n, low, high = ids.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    if not n:
        return DocSet(ids, 0, [])
    shift = 0
    while (high >> shift) - (low >> shift) >= _SPANS:
        shift += 1
    spans = ids.groupBy(F.shiftright("doc_id", shift)).agg(F.min("doc_id"), F.max("doc_id"))
    return DocSet(ids, n, fold_runs([(a, b) for _, a, b in spans.collect()], MAX_RUNS))


def in_runs(doc_id: Column, runs: list[tuple[int, int]]) -> Column:
    """Whether an id lies in one of the runs: a literal predicate, so that statistics skip the rest."""
    found = F.lit(False)
    for low, high in runs:
        found = found | doc_id.between(low, high) if low < high else found | (doc_id == low)
    return found


# -- bitmaps --------------------------------------------------------------------------------------


def bitmaps(doc_ids: DataFrame, *keys: str) -> DataFrame:
    """One bit per document, per ``keys``: (keys, _bucket, _bits), a row per 32,768 ids."""
    bucket = F.bitmap_bucket_number(F.col("doc_id")).alias("_bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("doc_id"))).alias("_bits")
    return doc_ids.groupBy(*keys, bucket).agg(bits)


def may_broadcast_bitmaps(rows: int, text_bytes: int = 0) -> bool:
    return may_broadcast(rows, rows * _BITMAP_BYTES + text_bytes)


def _has_bit() -> Column:
    position = "bitmap_bit_position(doc_id)"
    byte = f"ascii(decode(substring(_bits, cast({position} div 8 as int) + 1, 1), 'ISO-8859-1'))"
    return F.expr(f"(shiftright({byte}, cast({position} % 8 as int)) & 1) = 1")


def test_bits(rows: DataFrame, bits: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, doc_id, ...) whose document is in broadcast ``bitmaps``. No row is moved."""
    with_bucket = rows.withColumn("_bucket", F.bitmap_bucket_number(F.col("doc_id")))
    joined = with_bucket.join(F.broadcast(bits), [*keys, "_bucket"])
    return joined.where(_has_bit()).select(*rows.columns)


test_bits.__test__ = False  # no test of pytest's


def keep_documents(rows: DataFrame, docs: DocSet) -> tuple[DataFrame, bool]:
    """Rows of the documents in a set, and whether none of them had to be shuffled."""
    found = rows.where(in_runs(F.col("doc_id"), docs.runs))
    if may_broadcast(docs.n):
        return found.join(F.broadcast(docs.ids), "doc_id", "left_semi"), True
    buckets = docs.ids.select(F.bitmap_bucket_number(F.col("doc_id"))).distinct().count()
    if may_broadcast_bitmaps(buckets):
        return test_bits(found, bitmaps(docs.ids)), True
    return found.join(docs.ids, "doc_id", "left_semi"), False
