"""The engine's surface: search, answers, orders, facets and evaluation over stored relations."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import embed as em
from quillstone.functions.romanise import romanise
from quillstone.operators import catalog, evals, fusion, grounding, keyword, vector
from quillstone.operators.filters import predicate
from quillstone.sources import readers
from quillstone.sources.stored import scratch, written


@dataclass
class Config:
    """Tunables; the environment overrides the defaults.  `replies` is a folder in which replies are kept for later runs."""

    phonetic_weight: float = field(default_factory=lambda: float(os.environ.get("PHONETIC_WEIGHT", "0")))
    min_cosine: float = field(default_factory=lambda: float(os.environ.get("MIN_COSINE", grounding.MIN_COSINE)))
    min_coverage: float = field(default_factory=lambda: float(os.environ.get("MIN_COVERAGE", grounding.MIN_COVERAGE)))
    expand_subjects: bool = field(default_factory=lambda: os.environ.get("EXPAND_SUBJECTS") == "1")
    per_order: int = 2
    replies: str | None = field(default_factory=lambda: os.environ.get("REPLIES"))
    tries: int = 3
    channel_depth: int = 50


class Engine:
    """Relations as DataFrames and stored indexes; every method answers with a DataFrame, for one question or many.

    Indexes that are not given are built by the first search that needs them.
    """

    def __init__(self, spark: SparkSession, orders: DataFrame, passages: DataFrame, pages: DataFrame | None = None, refs: DataFrame | None = None, vectors: DataFrame | None = None, encoder=None, config: Config | None = None, words: keyword.Index | None = None, phonetic: keyword.Index | None = None):
        self.spark, self.orders, self.passages = spark, orders, passages
        self.pages = pages if pages is not None else catalog.empty(spark, "pages")
        self.refs = refs if refs is not None else catalog.empty(spark, "references")
        self.vectors, self.encoder, self.config = vectors, encoder or em.hashing(), config or Config()
        self._words, self._phonetic = words, phonetic

    @property
    def words(self) -> keyword.Index:
        self._words = self._words or keyword.build(self.passages)
        return self._words

    @property
    def phonetic(self) -> keyword.Index:
        self._phonetic = self._phonetic or keyword.phonetic_index(self.passages, romanise)
        return self._phonetic

    @cached_property
    def _strays(self) -> bool:
        """Whether there are passages without an order, which no search may find; looked up once."""
        return not self.passages.join(self.orders.select("goid"), "goid", "left_anti").isEmpty()

    @classmethod
    def load(cls, spark: SparkSession, folder: str, **more) -> Engine:
        read = lambda n: spark.read.parquet(f"{folder}/{n}").drop("batch")
        indexes = {"words": keyword.load(spark, f"{folder}/words"), "phonetic": keyword.load(spark, f"{folder}/phonetic")}
        return cls(spark, read("orders"), read("passages"), read("pages"), read("references"), readers.vectors(spark, f"{folder}/vectors"), **indexes, **more)

    def questions(self, texts: str | list[str]) -> DataFrame:
        texts = [texts] if isinstance(texts, str) else texts
        return self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, question string")

    def search(self, questions: DataFrame | str | list[str], limit: int = 10, **filters) -> DataFrame:
        """Hybrid search: position, passage and order columns, score, bm25, cosine, lexical_coverage, matched_by per question."""
        questions = questions if isinstance(questions, DataFrame) else self.questions(questions)
        only = keyword.allowed(self.passages, self.orders, predicate(**filters) if any(filters.values()) else F.lit(True)) if any(filters.values()) or self._strays else None
        depth = self.config.channel_depth
        channels = {"keyword": written(keyword.keyword_search(self.words, questions, depth, only))}
        if self.vectors is not None:
            asked = questions.select("qid", em.embed(F.col("question"), self.encoder).alias("embedding"))
            channels["vector"] = written(vector.vector_search(self.vectors, asked, depth, only))
        weights = {}
        if self.config.phonetic_weight > 0:
            channels["phonetic"] = keyword.phonetic_search(self.phonetic, questions, depth, romanise, only)
            weights["phonetic"] = self.config.phonetic_weight
        fused = fusion.fuse(channels, weights, limit)
        found = fusion.diversify(fusion.hydrate(fused, self.passages.select("chunk_id", "goid", "page"), self.orders.select("goid", "go_no")), limit, self.config.per_order)
        # texts and the other columns only of the rows that stay
        rows = fusion.hydrate(found.drop("goid", "page", "go_no"), self.passages, self.orders).join(questions, "qid")
        rows = rows if "vector" in channels else rows.withColumn("cosine", F.lit(None).cast("double"))
        return fusion.decorate(rows, list(channels))

    def _answered(self, questions: DataFrame, limit: int, provider: grounding.Provider, **filters) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The decisions, the checked quotes behind them, and the passages that were shown."""
        results = written(self.search(questions, limit, **filters))
        if self.config.expand_subjects:
            swapped = fusion.expand_subjects(results, self.passages, limit).select("qid", F.col("place").alias("position"), "chunk_id")
            own = [c for c in self.passages.columns if c in results.columns]
            results = results.drop("position", *[c for c in own if c != "goid"]).dropDuplicates(["qid", "goid"]).join(swapped.join(self.passages.select(*own), "chunk_id"), ["qid", "goid"])
        gate = grounding.relevance(questions, results, min_cosine=self.config.min_cosine, min_coverage=self.config.min_coverage)
        asked = grounding.prompts(questions.join(gate.where("relevant"), "qid", "left_semi"), results)
        # a provider is asked once a prompt, and an error counts as a reply
        raw = grounding.ask_once(asked, provider, self.config.replies or scratch(self.spark), self.config.tries)
        errors = raw.where("error is not null").select("qid", "error")
        parsed = written(grounding.parse(raw.where("error is null").select("qid", "raw")))
        quotes = parsed.select("qid", F.posexplode("quotes").alias("i", "q")).select("qid", "i", "q.n", "q.text")
        checked = grounding.verify(quotes, results)
        return grounding.decide(parsed, checked, gate).join(errors, "qid", "left"), checked, results

    def ask(self, questions: DataFrame | str | list[str], limit: int = 6, provider: grounding.Provider = grounding.extractive, **filters) -> DataFrame:
        """Grounded answers with their quotes, dropped quotes and passages, or refusals; the provider sees only questions that pass the relevance gate."""
        questions = questions if isinstance(questions, DataFrame) else self.questions(questions)
        return grounding.answered(*self._answered(questions, limit, provider, **filters)).withColumn("provider", F.lit(provider.__name__))

    def answer_details(self, gold: DataFrame, provider: grounding.Provider = grounding.extractive, limit: int = 6) -> DataFrame:
        """(qid, language, unanswerable, found, n_quotes, n_dropped, cited_expected_order, cited, answer, error) of gold questions, asked as one batch."""
        decided, checked, _ = self._answered(gold.select("qid", "question"), limit, provider)
        cited = checked.where("reason is null").groupBy("qid").agg(F.array_sort(F.collect_set("goid")).alias("cited"))
        accept = F.coalesce("accept_goids", F.array("expect_goid"))
        rows = gold.join(decided, "qid").join(cited, "qid", "left").withColumn("cited", F.when(F.col("found"), F.coalesce("cited", F.array().cast("array<long>"))).otherwise(F.array().cast("array<long>")))
        return rows.select(
            "qid", "language", "unanswerable", "found", F.col("kept").alias("n_quotes"), F.col("dropped").alias("n_dropped"),
            F.coalesce(F.arrays_overlap("cited", accept), F.lit(False)).alias("cited_expected_order"), "cited", "answer", "error",
        )

    def evaluate_answers(self, gold: DataFrame, provider: grounding.Provider = grounding.extractive) -> DataFrame:
        """Answer metrics of gold questions; a batch has no time of its own for each, so the median time is null."""
        return evals.answer_metrics(self.answer_details(gold, provider).withColumn("seconds", F.lit(None).cast("double")))

    def order(self, goid: int) -> dict[str, DataFrame]:
        own = F.col("goid") == goid
        return {
            "order": self.orders.where(own), "pages": self.pages.where(own).orderBy("page"), "passages": self.passages.where(own).orderBy("page", "ord"),
            "mentions": self.refs.where(own).select("ref_text", "ref_year", "page"), "related": fusion.related(self.orders, self.orders.where(own)),
        }

    def facets(self) -> DataFrame:
        return catalog.facets(self.orders)

    def health(self) -> DataFrame:
        return catalog.totals(self.orders)

    def evaluate(self, gold: DataFrame) -> DataFrame:
        """Retrieval metrics of gold questions (qid, question, ...), all in one plan."""
        able, unable = gold.where("not unanswerable").select("qid", "question"), gold.where("unanswerable").select("qid", "question")
        declined = grounding.relevance(unable, self.search(unable, 6), min_cosine=self.config.min_cosine, min_coverage=self.config.min_coverage).select("qid", (~F.col("relevant")).alias("declined"))
        return evals.retrieval_metrics(evals.retrieval_details(gold, self.search(able, 5)), declined)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row: whether retrieval has been evaluated (ran) with its metrics, and the metrics of answers as a struct, null if never asked."""
    metrics, answers = (readers.stored_json(spark, f"{folder}/{n}.json") for n in ("eval", "answers"))
    whole = spark.range(1).select(F.lit(metrics is not None).alias("ran"))
    if metrics is not None:
        whole = whole.crossJoin(metrics.drop("details"))  # one row each
    if answers is None:
        return whole.withColumn("answers", F.lit(None).cast("struct<n:long>"))
    answers = answers.drop("details")
    return whole.crossJoin(answers.select(F.struct(*answers.columns).alias("answers")))
