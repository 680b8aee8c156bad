"""A stream of recognised pages that keeps passages, pages, references and both indexes up to date.

Which orders have been taken in is state, kept by order, so a micro-batch reads nothing of what is there already.  Everything a
micro-batch writes goes by its number: relations into a folder of that number that a repetition overwrites, ids and index
segments into ledgers that know the last number.  A micro-batch that is repeated after a failure so ends as if it had run
once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.functions import embed as em
from quillstone.functions import text as tx
from quillstone.functions.romanise import romanise
from quillstone.operators import catalog, chunking, ids, index
from quillstone.sources import readers
from quillstone.sources.snapshots import Snapshots
from quillstone.sources.stored import on_the_way, written

PAGES = "goid long, page int, value string"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FirstOnly(StatefulProcessor):
    """Lets the pages of an order through in the micro-batch that first has any, and none later."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "since int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.taken.exists():
            self.taken.update((1,))
            found = pd.concat(list(rows))  # an order's pages; what comes of one page goes on as one row
            yield found if not found.duplicated("page").any() else found.groupby(["goid", "page"], as_index=False, dropna=False)["value"].agg(lambda v: "\n".join(v.dropna()))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.taken.update((0,))

    def close(self) -> None:
        pass


def page_files(spark: SparkSession, incoming: str, most: int | None = None) -> DataFrame:
    """A stream of page files <goid>/page-<n>.tsv: (goid, page, value), one row a page; `most` files a micro-batch."""
    source = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "page-*.tsv")
    rows = (source.option("maxFilesPerTrigger", most) if most else source).text(incoming)
    return rows.select(readers.order_of(F.col("_metadata.file_path")).alias("goid"), readers.page_of(F.col("_metadata.file_path")).alias("page"), "value").where("goid is not null")


def take_in(batch: DataFrame, folder: str, number: int, orders: DataFrame | None = None, encoder=None) -> None:
    """Passages, pages, references, vectors and index segments of a batch of pages (goid, page, value) of new orders.

    Without `orders` there are no references and no subject passages, without an encoder no vectors.
    """
    spark = batch.sparkSession

    def stored(rows: DataFrame, name: str) -> DataFrame:
        return written(rows, f"{folder}/{name}/batch={number}")

    with on_the_way(spark):
        # the one action on the stream's own rows; a page's words stay in its row, so they are neither written nor sent
        paged = written(chunking.paged(readers.listed_words(batch))).where("words > 0")
        if paged.isEmpty():
            return
        rows = chunking.passages_of(paged).drop("word_ids", "mean_conf")
        if orders is not None:
            rows = rows.unionByName(chunking.subject_passages(orders.join(paged.select("goid").distinct(), "goid", "left_semi")))
        passages = stored(ids.numbered(rows, f"{folder}/ids", number), "passages")
        pages = stored(chunking.pages_of(paged), "pages")
    if orders is not None:
        refs = catalog.references(pages, orders).withColumn("target_goid", F.lit(None).cast("long"))
        stored(catalog.resolve(refs, orders), "references")
    if encoder is not None:
        stored(passages.select("chunk_id", em.embed(F.col("text"), encoder).cast("array<float>").alias("embedding")), "vectors")
    index.change(spark, f"{folder}/words", passages, batch=number)
    index.change(spark, f"{folder}/phonetic", passages, tokens=tx.phonetic_tokens(romanise(F.col("text"))), batch=number)


def start(pages: DataFrame, folder: str, checkpoint: str, orders: DataFrame | None = None, encoder=None) -> StreamingQuery:
    """Runs over what there is of a stream of pages (goid, page, value); see `page_files`.

    A checkpoint that is new, or lost, begins with the orders that already have passages, and numbers its batches on from
    the last one.
    """
    spark = pages.sparkSession
    # where this checkpoint's numbers begin is itself a ledger, so that a restart finds it again
    begins = Snapshots(spark, f"{checkpoint}/begins")
    version, state = begins.current()
    if not version:
        state = {"after": ids.last_batch(spark, f"{folder}/ids")}
        begins.commit(0, state)
    # not what a failed first batch of this checkpoint may have written
    known = readers.relation(spark, f"{folder}/passages", "goid long, batch long").where(F.col("batch") <= state["after"]).select("goid").distinct()
    fresh = pages.groupBy("goid").transformWithStateInPandas(FirstOnly(), PAGES, "Append", "None", initialState=known.groupBy("goid"))

    def batch(rows: DataFrame, number: int) -> None:
        take_in(rows, folder, state["after"] + 1 + number, orders, encoder)

    # a query keeps the settings that it starts with; those of the session stay as they were
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE_STORE[0]) if before is None else spark.conf.set(STATE_STORE[0], before)
