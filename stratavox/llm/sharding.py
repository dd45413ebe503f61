"""Operator 10: Hilbert-curve sharding. DataFrame functions only.

Three metadata dimensions (size of the text, language, source) are quantised
to four bits each; rows are ordered by the index of their cell on a Hilbert
curve and the order is cut into runs, so a shard covers a compact region and a
reader can skip shards by the ranges of its metadata. The law is ``rows``:
counts of shards differ by one at most.

The global position of a row comes from counts of (cell, bucket) and a rank
within the bucket. A bucket is a slice of the text's CRC and of the id's, and
their number grows with the rows, so a cell or a group of copies that holds a
third of all rows is spread over as many buckets as it needs. Only totals of
cells (at most 4,096 rows) meet in one task.

Cases: a null text has size 1 and CRC 0, as the empty text; null metadata fall
into the code of the empty string; equal rows keep an order by id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratavox.llm.common import table, written

BITS = 4
SHARDS = 16
#: Buckets of a cell: by CRC of the text, then by CRC of the id, as many again for
#: every so many rows.
TEXT_BUCKETS, ID_BUCKETS, ROWS_PER_TURN = 8, 32, 8_000_000


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Index of a cell on the Hilbert curve: undo excess work, then Gray-encode."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = (index << 1) | ((v >> b) & 1)
    return index


def curve_table(spark: SparkSession) -> DataFrame:
    """(cell, curve) for all 4,096 cells of the three dimensions."""
    side = 1 << BITS
    rows = [(((a << BITS) | b) << BITS | c, hilbert_index((a, b, c), BITS)) for a in range(side) for b in range(side) for c in range(side)]
    return spark.createDataFrame(rows, "cell int, curve int")


def _code(c: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")), F.lit(1 << BITS)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    size = F.octet_length(raw).cast("long") + 1
    level = F.least(F.length(F.bin(size)) - 1, F.lit((1 << BITS) - 1)).cast("int")  # whole binary logarithm
    rows = docs.select(F.col(id_col).alias("_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"), level.alias("_a"), _code(F.col(lang_col)).alias("_b"), _code(F.col(source_col)).alias("_c"))
    rows = rows.select("_id", "size", "text_crc32", F.expr(f"(_a << {2 * BITS}) | (_b << {BITS}) | _c").alias("cell"))
    # 4,096 rows at any input size, so this table is always small enough to broadcast
    rows = written(rows.join(F.broadcast(curve_table(spark)), "cell").drop("cell"), "shards")
    turns = max(1, -(-rows.count() // ROWS_PER_TURN))
    own = F.crc32(F.encode(F.coalesce(F.col("_id").cast("string"), F.lit("")), "UTF-8"))
    rows = rows.withColumn("bucket", F.pmod(F.col("text_crc32"), F.lit(TEXT_BUCKETS)) * (ID_BUCKETS * turns) + F.pmod(own, F.lit(ID_BUCKETS * turns)))
    counts = rows.groupBy("curve", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = counts.select("curve", "bucket", before.alias("inner"))
    cells = rows.groupBy("curve").agg(F.count("*").alias("n"))
    w = Window.orderBy("curve")  # at most 4,096 rows
    cells = cells.select("curve", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    offsets = inner.join(F.broadcast(cells), "curve").select("curve", "bucket", (F.col("inner") + F.col("outer")).alias("start"), "total")
    rank = F.row_number().over(Window.partitionBy("curve", "bucket").orderBy("text_crc32", "_id")) - 1
    placed = rows.withColumn("_r", rank).join(offsets, ["curve", "bucket"]).withColumn("_at", F.col("_r") + F.col("start"))
    placed = placed.withColumn("shard", F.expr(f"cast((_at * {shards}) div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents")).drop("curve")


_CRC_STEP = "list_transform({}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_CRC_TABLE = "range(256)"
for _ in range(8):
    _CRC_TABLE = _CRC_STEP.format(_CRC_TABLE)
_SIDE = range(1 << BITS)
_CURVE = ", ".join(f"({a}, {b}, {c}, {hilbert_index((a, b, c), BITS)})" for a in _SIDE for b in _SIDE for c in _SIDE)
#: CRC-32 is worked out byte by byte, and the order over the whole table at once.
OP10_SQL = f"""
WITH tb AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, '') AS own FROM documents),
s AS (SELECT DISTINCT v FROM (SELECT text AS v FROM d UNION ALL SELECT lang FROM d UNION ALL SELECT source FROM d UNION ALL SELECT own FROM d)),
h AS (SELECT v, list_transform(list_filter(string_split(regexp_replace(hex(v), '(..)', '\\1 ', 'g'), ' '), lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT) AS b FROM s),
crc AS MATERIALIZED (SELECT v, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS k FROM h, tb),
curve(a, b, c, curve) AS (VALUES {_CURVE}),
r AS (SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS size, x.k AS text_crc32, l.k % {1 << BITS} AS b, o.k % {1 << BITS} AS c, i.k AS own
  FROM d JOIN crc x ON x.v = text JOIN crc l ON l.v = lang JOIN crc o ON o.v = source JOIN crc i ON i.v = own),
p AS (SELECT r.*, curve.curve, (text_crc32 % {TEXT_BUCKETS}) * {ID_BUCKETS} * m + own % ({ID_BUCKETS} * m) AS bucket, total
  FROM r JOIN curve ON curve.a = least(length(bin(size)) - 1, {(1 << BITS) - 1}) AND curve.b = r.b AND curve.c = r.c, (SELECT count(*) AS total, greatest(1, ceil(count(*) / {ROWS_PER_TURN}))::BIGINT AS m FROM r)),
n AS (SELECT *, row_number() OVER (ORDER BY curve, bucket, text_crc32, doc_id) - 1 AS pos FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * {SHARDS} // total)::INTEGER AS shard, (pos - ((pos * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM n
"""
