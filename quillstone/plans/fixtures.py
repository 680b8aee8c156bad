"""The driver's tables seen as orders, passages, questions and recognised words; each with the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import romanise as rom
from quillstone.functions.romanise import romanise
from quillstone.operators import keyword
from quillstone.operators import index as stored_index
from quillstone.sources.snapshots import Snapshots
from quillstone.sources.stored import scratch

#: Characters of recognised pages that a task takes.
PER_TASK = 1 << 22

#: Indexes by session, folder and kind: built once, as at ingest, and used by every query.
_INDEXES: dict[tuple[str, str, str], keyword.Index] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """All orders, or those of few numbers (goid)."""
    # the subject is cut out before the join, which so sends no texts
    documents = table(spark, d, "documents").select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("subject"))
    placed = table(spark, d, "orders")
    if only is not None:  # on both sides, as the planner takes a semi join to one side alone
        documents = documents.join(only, F.col("doc_id") == F.col("goid"), "left_semi")
        placed = placed.join(only, F.col("o_orderkey") == F.col("goid"), "left_semi")
    joined = documents.join(placed, F.col("doc_id") == F.col("o_orderkey"))
    return joined.select(
        F.col("doc_id").alias("goid"), F.col("o_custkey").cast("string").alias("go_no"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("go_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("go_date_iso"),
        "subject", F.col("source").alias("department"),
        F.col("o_orderstatus").alias("section"), F.col("o_orderpriority").alias("category"), F.when(F.col("doc_id") % 10 != 0, 1).otherwise(0).alias("ocr_ok"),
    )


def passages(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("goid"), (F.col("doc_id") % 3 + 1).cast("int").alias("page"), F.lit(0).alias("ord"), text.alias("text"),
        F.size(F.split(text, " ")).alias("n_words"), F.lit("ocr").alias("kind"), *[(F.col("doc_id") % m * 10).cast("int").alias(c) for c, m in (("box_x", 40), ("box_y", 60), ("box_w", 70), ("box_h", 30))],
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), "text")


def index(spark: SparkSession, d: str, kind: str = "words") -> keyword.Index:
    """The stored index of all passages: of their words, of phonetic keys, or of phonetic keys of both scripts (romanised)."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _INDEXES:
        if kind == "words":
            _INDEXES[key] = keyword.build(passages(spark, d))
        else:
            _INDEXES[key] = keyword.phonetic_index(passages(spark, d) if kind == "phonetic" else hindi(passages(spark, d)), romanise)
    return _INDEXES[key]


def maintained(spark: SparkSession, d: str) -> keyword.Index:
    """An index grown in five loads; then a tenth of the passages is replaced under their ids, and a tenth is taken out."""
    key = (spark.sparkContext.applicationId, d, "maintained")
    if key not in _INDEXES:
        rows, folder = passages(spark, d).select("chunk_id", "text"), scratch(spark)
        for step in range(5):
            stored_index.change(spark, folder, rows.where(F.col("chunk_id") % 5 == step), batch=step)
            Snapshots(spark, folder).clear(keep=1)  # segments that have been merged; nothing reads older versions
        old = rows.where("chunk_id % 10 = 3")
        stored_index.change(spark, folder, old.withColumn("text", F.concat("text", F.lit(" amended by a later order"))), old, batch=5)
        _INDEXES[key] = stored_index.change(spark, folder, gone=rows.where("chunk_id % 10 = 7"), batch=6)
    return _INDEXES[key]


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """The recognised words as whole TSV pages (goid, page, value)."""
    line = F.concat_ws("\t", F.lit("5"), "page", "block", "par", "line", "word", "x", "y", "w", "h", "conf", "text")
    made = words(spark, d).withColumn("words", F.struct("line", "word", line.alias("l")))
    return made.groupBy("goid", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("words")), lambda s: s["l"]), "\n").alias("value"))


def hindi(rows: DataFrame, column: str = "text") -> DataFrame:
    """Every third row with some of its Latin letters in Devanagari."""
    return rows.withColumn(column, F.when(F.col(rows.columns[0]) % 3 == 0, F.translate(column, "kmnprstl", "कमनपरसतल")).otherwise(F.col(column)))


#: All that romanising knows, and four alphabets of 26 that together hold it, each with consonants, signs, vowels and marks.
KNOWN = [*rom.CONSONANTS, *rom.COMPOSED, *rom.SIGNS, *rom.VOWELS, *rom.MARKS, rom.VIRAMA, rom.NUKTA_SIGN]
ALPHABETS = ["".join(KNOWN[(k + 4 * i) % len(KNOWN)] for i in range(26)) for k in range(4)]


def devanagari(spark: SparkSession, d: str) -> DataFrame:
    """(word, script): the words of documents, each in all four alphabets."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    script = F.explode(F.array(*[F.translate("word", "abcdefghijklmnopqrstuvwxyz", a) for a in ALPHABETS])).alias("script")
    return table(spark, d, "documents").select(word).distinct().select("word", script)


def words(spark: SparkSession, d: str) -> DataFrame:
    # dealt as whole texts, so that no grouping of an order's words sends words; to tasks small enough to sort their words in memory
    documents = table(spark, d, "documents")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (documents.agg(F.sum("n_chars")).first()[0] or 0) // PER_TASK)
    lines = documents.select(F.col("doc_id").alias("goid"), "text").repartition(tasks, "goid").select("goid", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    each = lines.select("goid", "line", F.posexplode(F.split("l", " ")).alias("word", "text")).where("text <> ''")
    n = F.char_length("text")
    return each.select(
        "goid", F.lit(1).alias("page"), F.floor(F.col("line") / 10).cast("int").alias("block"), F.lit(1).alias("par"), "line", "word",
        (F.col("word") * 10).alias("x"), (F.col("line") * 20).alias("y"), (n * 7).alias("w"), F.lit(15).alias("h"), (n * 13 % 101).cast("double").alias("conf"), "text",
    )


SQL = r"""
orders_ as (
  select doc_id as goid, o_custkey::varchar as go_no, strftime(o_orderdate, '%d-%m-%Y') as go_date, strftime(o_orderdate, '%Y-%m-%d') as go_date_iso,
    string_split(coalesce(text, ''), chr(10))[1] as subject, source as department, o_orderstatus as section,
    o_orderpriority as category, (case when doc_id % 10 <> 0 then 1 else 0 end)::int as ocr_ok
  from documents join orders on doc_id = o_orderkey),
passages_ as (
  select doc_id as chunk_id, doc_id as goid, (doc_id % 3 + 1)::int as page, 0 as ord, coalesce(text, '') as text, len(string_split(coalesce(text, ''), ' '))::int as n_words, 'ocr' as kind,
    (doc_id % 40 * 10)::int as box_x, (doc_id % 60 * 10)::int as box_y, (doc_id % 70 * 10)::int as box_w, (doc_id % 30 * 10)::int as box_h
  from documents),
questions_ as (select item_id as qid, text as question, text from benchmark),
lines_ as (select doc_id as goid, generate_subscripts(ls, 1) - 1 as line, unnest(ls) as l from (select doc_id, string_split(text, chr(10)) as ls from documents)),
words_ as (
  select goid, 1 as page, (line // 10)::int as block, 1 as par, line::int as line, word::int as word, (word * 10)::int as x, (line * 20)::int as y,
    (length(t) * 7)::int as w, 15 as h, (length(t) * 13 % 101)::double as conf, t as text
  from (select goid, line, generate_subscripts(ws, 1) - 1 as word, unnest(ws) as t from (select goid, line, string_split(l, ' ') as ws from lines_)) where t <> '')
"""
