"""Fixity audit of WARC replicas by Merkle trees over ordered ranges of offsets.

Each replica is a set of files, and a file is records at offsets. Records are hashed; the records that
begin in a range of 64 KiB, in their order and with offset, length, id and digest, are a leaf;
16 ranges are a node, and so on up to the file; 16 files are a node, up to one root. Two replicas are
compared from their roots downwards, and only children of nodes that differ are looked at.

Of the files that hold a differing range the records are then set against each other by id, so that a
lost or added record is not held against everything that lies behind it:

* ``missing``, ``extra``: an id that only the first, only the second replica has;
* ``changed``: another length or content;
* ``moved``: a whole record that follows another whole record than before, or lies in another file; of
  a run of records that moved together, the first, and the one that now follows the place it left;
* ``shifted``: a whole record before which bytes were put in or left out that belong to no record.

Nulls, ties, repeats: null url and html are empty; rows without an id have one id below all others;
records of the same id are paired by content first and then in their order; extra columns are
ignored; an empty replica has no root, and all records of the other are missing or extra. A very
long record is one leaf by itself; no record leaves its task, only digests do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termsift.llm.common import scratch_dropped, stored

#: Ids per file, bytes of a range, and children per node; the last two as numbers of bits.
IDS_PER_FILE = 1000
RANGE_BITS = 16
FAN_BITS = 4

#: The id of records that have none.
NO_ID = -(1 << 62)


def warc_record(url: Column, html: Column, page_id: Column) -> Column:
    """A WARC resource record as bytes."""
    body = F.encode(F.coalesce(html, F.lit("")), "utf-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8"))


def warc_records(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (page_id, url, html): ``id, record``."""
    record = warc_record(F.col("url"), F.col("html"), F.col("page_id"))
    return pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("id"), record.alias("record"))


def place_records(records: DataFrame) -> DataFrame:
    """Records (id, record) in files of ``IDS_PER_FILE`` ids, one behind the other.

    Ordered by id, or by a column ``place`` where there is one.
    """
    if "place" not in records.columns:
        records = records.withColumn("place", F.col("id").cast("double"))
    number = F.expr(f"(id - pmod(id, {IDS_PER_FILE}L)) DIV {IDS_PER_FILE}L").alias("file")
    sized = records.select(
        number, "id", "place", "record", F.octet_length("record").cast("long").alias("_bytes")
    )
    before = Window.partitionBy("file").orderBy("place", "id", "record")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_bytes").over(before), F.lit(0).cast("bigint")).alias("offset")
    return sized.select("file", offset, "id", "record")


def digests(records: DataFrame) -> DataFrame:
    """Records (file, offset, id, record) by length and digest."""
    return records.select(
        "file", "offset", "id",
        F.octet_length("record").cast("long").alias("bytes"),
        F.sha2("record", 256).alias("digest"),
    )


# -- trees ----------------------------------------------------------------------------------------


def ranges(hashed: DataFrame) -> DataFrame:
    """Leaves: (file, part, hash) of the records that begin in a range of offsets, in their order."""
    own = F.array_sort(F.collect_list(F.struct("offset", "bytes", "id", "digest")))
    named = F.transform(own, lambda r: F.concat_ws(":", r["offset"], r["bytes"], r["id"], r["digest"]))
    part = F.shiftright("offset", RANGE_BITS).alias("part")
    return hashed.groupBy("file", part).agg(F.sha2(F.array_join(named, ","), 256).alias("hash"))


def parents(nodes: DataFrame, by: str) -> DataFrame:
    """The level above of nodes (file, part, hash): at most 16 parts of a file, or 16 files."""
    other = "part" if by == "file" else "file"
    children = F.array_sort(F.collect_list(F.struct(by, "hash")))
    named = F.transform(children, lambda c: F.concat_ws("=", c[by], c["hash"]))
    above = nodes.groupBy(other, F.shiftright(by, FAN_BITS).alias("_up")).agg(
        F.sha2(F.array_join(named, ","), 256).alias("hash")
    )
    return above.withColumnRenamed("_up", by).select("file", "part", "hash")


def steps(leaves: list[DataFrame]) -> list[str]:
    """What to gather from level to level until every replica has a root: parts first, then files.

    Below zero and above it the root has a node each, since shifting keeps the sign.
    """
    ends = [leaf.agg(F.max("part"), F.min("file"), F.max("file")).first() for leaf in leaves]
    ends = [e for e in ends if e[0] is not None]
    if not ends:
        return []
    part, low, high = max(e[0] for e in ends), min(e[1] for e in ends), max(e[2] for e in ends)
    out = []
    while part:
        out.append("part")
        part >>= FAN_BITS
    while low < -1 or high > 0:
        out.append("file")
        low, high = low >> FAN_BITS, high >> FAN_BITS
    return out


def tree(leaf: DataFrame, gather: list[str]) -> list[DataFrame]:
    """Levels of (file, part, hash), written, from the ranges up."""
    levels = [leaf]
    for by in gather:
        levels.append(stored(parents(levels[-1], by), "level"))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.withColumnRenamed("hash", "hash_b")
    both = a.join(b, ["file", "part"], "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("hash_b"))).select("file", "part")


def differing_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ranges (file, part) in which two replicas (file, offset, id, bytes, digest) differ."""
    leaves = [stored(ranges(side), "level") for side in (a, b)]
    gather = steps(leaves)
    trees = [tree(leaf, gather) for leaf in leaves]
    bad = _differing(trees[0][-1], trees[1][-1])
    for level in range(len(gather) - 1, -1, -1):
        by = gather[level]
        bad = stored(bad, "branches").withColumnRenamed(by, "_up")
        other = "part" if by == "file" else "file"
        below = [
            levels[level].withColumn("_up", F.shiftright(by, FAN_BITS)).join(bad, [other, "_up"], "left_semi")
            for levels in trees
        ]
        bad = _differing(*below)
    return bad


# -- records --------------------------------------------------------------------------------------


def _numbered(side: DataFrame, *keys: str) -> DataFrame:
    return side.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("file", "offset")))


def _named(side: DataFrame, name: str, *keys: str) -> DataFrame:
    columns = [F.col(c).alias(f"{c}_{name}") for c in ("file", "offset", "bytes", "pad")]
    return side.select(*keys, *columns)


def compare_records(a: DataFrame, b: DataFrame) -> DataFrame:
    """Damage between the records of two replicas (file, offset, id, bytes, digest)."""
    sides = []
    for side in (a, b):
        before = Window.partitionBy("file").orderBy("offset", "id", "digest")
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        # bytes of a file up to a record that belong to no record
        pad = F.col("offset") - F.coalesce(F.sum("bytes").over(before), F.lit(0))
        sides.append(_numbered(side.withColumn("pad", pad), "id", "digest"))
    keys = ["id", "digest", "_nth"]
    whole = _named(sides[0], "a", *keys).join(_named(sides[1], "b", *keys), keys)

    def last(name: str, what: str) -> Column:
        return F.lag(what).over(Window.partitionBy(f"file_{name}").orderBy(f"offset_{name}", *keys))

    key = F.struct(*keys)
    placed = whole.withColumns({
        "_before_a": last("a", key), "_before_b": last("b", key),
        "_pad_a": F.col("pad_a") - F.coalesce(last("a", "pad_a"), F.lit(0)),
        "_pad_b": F.col("pad_b") - F.coalesce(last("b", "pad_b"), F.lit(0)),
    })
    moved = (F.col("file_a") != F.col("file_b")) | ~F.col("_before_a").eqNullSafe(F.col("_before_b"))
    kind = F.when(moved, "moved").when(F.col("_pad_a") != F.col("_pad_b"), "shifted")
    columns = ["id", "kind", *[f"{c}_{name}" for name in "ab" for c in ("file", "offset", "bytes")]]
    out_of_place = placed.withColumn("kind", kind).where("kind IS NOT NULL").select(*columns)
    left = [
        _numbered(side.drop("_nth").join(whole.select(*keys[:2], f"file_{name}", f"offset_{name}").withColumnsRenamed(
            {f"file_{name}": "file", f"offset_{name}": "offset"}), [*keys[:2], "file", "offset"], "left_anti"), "id")
        for side, name in zip(sides, "ab", strict=True)
    ]
    other = _named(left[0], "a", "id", "_nth").join(_named(left[1], "b", "id", "_nth"), ["id", "_nth"], "full")
    kind = F.when(F.col("file_b").isNull(), "missing").when(F.col("file_a").isNull(), "extra")
    damaged = other.withColumn("kind", kind.otherwise("changed")).select(*columns)
    return out_of_place.unionByName(damaged)


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Damage between two replicas of records (file, offset, id, record).

    A row per damaged record: ``id, kind`` (as seen from ``a``), and its file, offset and bytes in either.
    """
    with scratch_dropped(a.sparkSession):
        sides = [stored(digests(side), "digests", keep=True) for side in (a, b)]
        files = differing_ranges(*sides).select("file").distinct()
        files = stored(files, "damaged_files", keep=True)
    bad = [side.join(files, "file", "left_semi") for side in sides]
    found = compare_records(*bad)
    return found.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))


def damaged_copy(pages: DataFrame) -> DataFrame:
    """Records of a replica of ``pages`` with known damage, as (id, record, place).

    Changed, truncated, lost and added records, and some that changed places with the next one.
    """
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    changed = F.concat(F.lit("#"), F.substring(html, 2, 1 << 30))
    cut = F.substring(html, F.lit(1), (F.length(html) / 2).cast("int"))
    kept = pages.select("page_id", "url", "html").where(~F.coalesce(page % 101 == 7, F.lit(False)))
    damaged = F.when(page % 97 == 13, changed).when(page % 89 == 3, cut).otherwise(F.col("html"))
    kept = kept.withColumn("html", damaged)
    added = pages.where(page % 103 == 5).select((-1 - page).alias("page_id"), "url", "html")
    records = warc_records(kept.unionByName(added))
    late = F.when(F.col("id") % 211 == 20, 1.5).otherwise(0.0)
    return records.withColumn("place", F.col("id") + late)


def audit_pages(pages: DataFrame) -> DataFrame:
    """The audit of ``pages`` against its damaged copy."""
    a, b = place_records(warc_records(pages)), place_records(damaged_copy(pages))
    return audit(a, b).withColumnRenamed("id", "page_id")


ORACLE = f"""WITH copy AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN '#' || substring(coalesce(html, ''), 2)
    WHEN page_id % 89 = 3 THEN left(coalesce(html, ''), length(coalesce(html, '')) // 2)
    ELSE html END AS html FROM pages WHERE page_id % 101 <> 7
  UNION ALL SELECT -1 - page_id, url, html FROM pages WHERE page_id % 103 = 5),
both_sides AS (SELECT 'a' AS side, page_id, url, html, page_id::DOUBLE AS place FROM pages
  UNION ALL SELECT 'b', page_id, url, html, page_id + CASE WHEN page_id % 211 = 20 THEN 1.5 ELSE 0 END FROM copy),
record AS (SELECT side, page_id, place, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: '
    || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM both_sides),
placed AS (SELECT *, strlen(record)::BIGINT AS bytes, floor(page_id / {IDS_PER_FILE}.0)::BIGINT AS file,
    coalesce(sum(strlen(record)) OVER (PARTITION BY side, floor(page_id / {IDS_PER_FILE}.0) ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM record),
a AS (SELECT * FROM placed WHERE side = 'a'), b AS (SELECT * FROM placed WHERE side = 'b'),
whole AS (SELECT a.page_id,
    lag(a.page_id) OVER (PARTITION BY a.file ORDER BY a."offset") AS before_a,
    lag(a.page_id) OVER (PARTITION BY b.file ORDER BY b."offset") AS before_b
  FROM a JOIN b USING (page_id) WHERE a.record = b.record),
moved AS (SELECT page_id FROM whole WHERE before_a IS DISTINCT FROM before_b)
SELECT page_id, CASE WHEN b.record IS NULL THEN 'missing' WHEN a.record IS NULL THEN 'extra'
    WHEN a.record = b.record THEN 'moved' ELSE 'changed' END AS kind,
  a.file AS file_a, a."offset" AS offset_a, a.bytes AS bytes_a,
  b.file AS file_b, b."offset" AS offset_b, b.bytes AS bytes_b
FROM a FULL JOIN b USING (page_id)
WHERE a.record IS DISTINCT FROM b.record OR page_id IN (SELECT page_id FROM moved)"""
