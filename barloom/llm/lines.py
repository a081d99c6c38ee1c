"""Line deduplication by range-partitioned hashes, in DataFrame functions only.

Every line that is long enough becomes one narrow row: two 64-bit hashes of its key, the document and its position.
The rows are dealt in ranges of the hash and sorted by document and position inside it, so one pass over a group meets the
document that keeps the line first and counts the others as they come.  What goes back are bitmaps of the
documents that lose lines, 64 lines to a word and only the words that differ from "keep all"; no text takes part.

A hash that holds more than its share of all rows is cut into blocks by document; the few sums of such blocks are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, table
from barloom.llm.stored import stored

# Fixed by the task: what is stripped from a line, and the lines that count.
SPACE = " \t\n\x0b\x0c\r"
LEAST_LENGTH = 20
LEAST_DOCS = 3
# A hash with more than 1/SHARES of all rows is cut into blocks of about that size; there are fewer than SHARES such hashes.
SHARES = 1000
ROW = ["doc_id", "print"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, print, text``: rows that share an id are told apart by the hash of their text."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, print, pos, h1, h2`` for every line whose key is long enough; ``pos`` counts all lines from 0."""
    lines = identified(docs, id_col, text_col).select(*ROW, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select(*ROW, "pos", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key")).where(F.length("key") >= least_length)
    return keys.select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_lines(rows: DataFrame, least_docs: int = LEAST_DOCS, shares: int = SHARES) -> DataFrame:
    """``doc_id, print, pos`` of the lines to drop: those of a key in ``least_docs`` documents or more, but for the largest id."""
    key = ["h1", "h2"]
    shares = max(shares, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    heavy = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total)).where(F.col("_n") * shares > F.col("_total"))
    # Fewer than ``shares`` rows.
    heavy = heavy.select(*key, F.ceil(F.col("_n") * shares / F.col("_total")).cast("int").alias("_blocks"))
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("_block", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_blocks")), F.lit(0)).cast("int"))
    group = Window.partitionBy(*key, "_block")
    inside = group.orderBy(F.desc_nulls_last("doc_id"), "pos")
    # The ranges of (h1, h2, _block) are what the windows ask for, so there is one shuffle and one sort.
    swept = (
        dealt.repartitionByRange(*key, "_block")
        .withColumn("_top", F.first("doc_id").over(inside))
        .withColumn("_new", (F.row_number().over(inside) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(inside)))
        .withColumn("_seen", F.sum(F.col("_new").cast("int")).over(inside))
        .withColumn("_docs", F.max("_seen").over(group))
    )
    swept = swept.select(*ROW, "pos", *key, "_block", "_blocks", "_seen", "_top", "_docs")
    lost = (F.col("_docs") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("_top"))
    cold = swept.where("_blocks IS NULL").where(lost).select(*ROW, "pos")
    hot = stored(swept.where("_blocks IS NOT NULL").select(*ROW, "pos", *key, "_seen", "_block", "_top", "_docs"), "hot-lines")
    blocks = hot.groupBy(*key, "_block").agg(F.first("_top").alias("_top"), F.first("_docs").alias("_docs"))
    whole = blocks.groupBy(*key).agg(F.max("_top").alias("_top"), F.sum("_docs").alias("_docs"))
    hot = hot.drop("_top", "_docs").join(F.broadcast(whole), key).where(lost).select(*ROW, "pos")
    return cold.unionByName(hot)


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """``doc_id, print, n_dropped, keep``: for each document that loses lines the words of 64 lines in which it does.

    A set bit is a line that stays; words that are not there keep all their lines.
    """
    word = F.floor(F.col("pos") / 64).cast("int").alias("word")
    bits = dropped.groupBy(*ROW, word).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    bits = bits.select(*ROW, F.bit_count("bits").alias("n"), F.struct("word", F.bitwise_not("bits").alias("keep")).alias("part"))
    return bits.groupBy(*ROW).agg(F.sum("n").cast("bigint").alias("n_dropped"), F.sort_array(F.collect_list("part")).alias("keep"))


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Compressed keep bitmaps of the documents that lose lines, as a written table: ``doc_id, print, n_dropped, keep``.

    A document is a ``doc_id``: rows that share one count once and keep or lose lines alike; null ids are one document below
    all others.  ``print`` is the XXH64 of the text.  Null and empty texts are one empty line, which is never dropped; other
    columns are not read; an empty table gives no rows.
    """
    rows = stored(line_rows(docs, id_col, text_col, least_length), "lines")
    return stored(keep_bitmaps(repeated_lines(rows, least_docs)), "line-bitmaps")


def without_lines(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every row of ``docs``; the bitmaps meet their document, Spark knows their size."""
    # Filled up to one word for each 64 lines here, so that a line finds its bit by position after the join.
    filled = F.expr("flatten(transform(keep, (w, i) -> concat(array_repeat(-1L, w.word - if(i = 0, 0, keep[greatest(i, 1) - 1].word + 1)), array(w.keep))))")
    dense = maps.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "n_dropped", filled.alias("_words")).distinct()
    met = identified(docs, id_col, text_col).join(dense, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left")
    lines = split_lines(F.col("text"))
    stays = F.filter(lines, lambda line, i: F.coalesce(F.getbit(F.get("_words", F.shiftright(i, 6)), F.pmod(i, F.lit(64))), F.lit(1)) == 1)
    kept = F.when(F.col("_words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return met.select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept_text"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the hash of what is left of every document."""
    docs = table(spark, sf_dir, "documents")
    return without_lines(docs, bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line,
             translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT key, MAX(doc_id) AS top FROM l WHERE length(key) >= 20 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.line, k.top IS NOT NULL AND k.top <> l.doc_id AS gone FROM l LEFT JOIN k ON k.key = l.key)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
