"""Line dedup: lines that many documents share stay only in the last document that holds them.

Only DataFrame and SQL functions run here. A line travels as a 128-bit hash of its key, its document and its position,
never as text. The rows are range-partitioned by hash with a secondary sort by document (descending) and position, and
streamed: the first row of each document in a hash's run counts, the first of all names the document that keeps the line.
A salt of the document in the range key deals a line which a third of the corpus shares over many tasks, their number
growing with the rows; the salts' counts and firsts are summed, and the verdict goes back to the rows of each salt.

What comes back for each document is a compressed keep bitmap: words of 64 lines, a bit for each line that stays, with
all words left out that keep all their lines. A text is split once and rebuilt in one pass over its lines. Only
the texts that lose lines need to meet their bitmaps: a bit table of bounded size (`common.sieve`) tells nearly all others
apart as they are scanned, which are then not shuffled. Where most texts lose lines, all are shuffled once.

Defined cases: a null or empty text is one empty line and is never changed. A null doc_id is a document of its own kind:
its lines are counted as of one document and lose to any other doc_id. Repeated rows of one doc_id count as one document
and all lose (or keep) the same lines. Ties cannot arise between different doc_ids. Extra columns pass through `dedup`.
Very long texts and any number of dropped lines cost time in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sieve

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased. lower() is used where it cannot touch anything but A-Z."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_rows(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, row_hash, pos, h1, h2) for each line whose key has at least min_chars code points."""
    # Hashed and split below the generator, so that neither is done again for each line; the outer form adds no filter that splits once more.
    whole = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.split("text", "\n", -1).alias("lines"))
    lines = whole.select("doc_id", "row_hash", F.posexplode_outer("lines").alias("pos", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key", F.lit(11)).alias("h2"))


def keep_words(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, salt_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, row_hash, keep): the keep bitmap of each text that loses lines, as array<struct<word, bits>> in word order.

    salt_rows: rows of one line that a task takes, about; a line of any number of rows is dealt over that many more salts.
    """
    lines = materialize(line_rows(docs, min_chars), "lines")
    salts = max(32, lines.count() // salt_rows)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc_nulls_last("doc_id"), "pos")
    first = F.row_number().over(order) == 1
    # Written down, so that the joins' sides are plain shuffles.
    runs = materialize(
        lines.select("h1", "h2", salt, "doc_id", "pos").repartitionByRange("h1", "h2", "salt")
        .select("h1", "h2", "salt", "doc_id", (first | ~F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id"))).alias("fresh"))
        .where("fresh").groupBy("h1", "h2", "salt").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")),
        "runs",
    )
    shared = runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")).where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    verdicts = runs.select("h1", "h2", "salt").join(shared, ["h1", "h2"])
    lost = lines.select("h1", "h2", salt, "doc_id", "row_hash", "pos").join(verdicts, ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = lost.groupBy("doc_id", "row_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps, joined by line feeds; a text without a bitmap stays as it is."""

    def own(w: Column, i: Column) -> Column:
        """A word's bits, after as many full words as are left out before it."""
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"])
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - before - 1), F.array(w["bits"]))

    def stay(lines: Column, words: Column) -> Column:
        return F.filter(lines, lambda _, i: F.getbit(F.coalesce(F.get(words, F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), i % 64) == 1)

    # The words are bound as a value once: in the inner function an expression would be worked out again for each line.
    bound = F.transform(F.array(F.flatten(F.transform(keep, own))), lambda words: F.array_join(stay(F.split(text, "\n", -1), words), "\n"))
    return F.when(keep.isNull(), text).otherwise(F.get(bound, F.lit(0)))


def dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with all their columns, text replaced by the kept lines, and `_keep` added: the keep bitmap (null: all lines stay)."""
    text = F.coalesce(docs["text"], F.lit(""))
    keep = materialize(keep_words(docs.select("doc_id", text.alias("text")), min_chars, min_docs), "keep")
    keep = keep.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_row"), F.col("keep").alias("_keep"))
    touched, others = sieve(docs, F.xxhash64(text), keep, "_row")
    own = touched.join(keep.hint("merge"), touched["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce(touched["text"], F.lit(""))) == F.col("_row")), "left")
    met = own.select(*[kept_text(touched["text"], F.col("_keep")).alias("text") if c == "text" else touched[c] for c in docs.columns], "_keep")
    return met.union(others.select(*[others[c] for c in docs.columns], F.lit(None).cast(met.schema["_keep"].dataType)))


def digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256, and keep_bitmap: the bitmap's words as number:hex, separated by commas."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))).cast("long").alias("n_lines"))
    out = dedup(base, min_chars, min_docs)
    n_dropped = F.coalesce(F.aggregate("_keep", F.lit(0), lambda acc, w: acc + 64 - F.bit_count(w["bits"])), F.lit(0)).cast("long")
    bitmap = F.coalesce(F.array_join(F.transform("_keep", lambda w: F.concat_ws(":", w["word"].cast("string"), F.hex(w["bits"]))), ","), F.lit(""))
    return out.select("doc_id", "n_lines", n_dropped.alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"), bitmap.alias("keep_bitmap"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS lost FROM keyed k LEFT JOIN shared s USING (key)),
words AS (
  SELECT doc_id, string_agg(word || ':' || hex(18446744073709551615::UBIGINT - bits), ',' ORDER BY word) AS keep_bitmap FROM (
    SELECT doc_id, (pos - 1) // 64 AS word, sum(1::HUGEINT << ((pos - 1) % 64)::INT)::UBIGINT AS bits FROM judged WHERE lost GROUP BY 1, 2) t GROUP BY doc_id)
SELECT j.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256,
       coalesce(any_value(w.keep_bitmap), '') AS keep_bitmap
FROM judged j LEFT JOIN words w ON w.doc_id = j.doc_id GROUP BY j.doc_id
"""
