"""Relevance gate, prompts, model answers and verified quotes, for batches of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators.once import once

MIN_COSINE, MIN_COVERAGE = 0.40, 0.20
#: What a refusal says; NOT_FOUND is this engine's own.
OFF_TOPIC = "The orders that matched are about a different matter than this question."
UNSUPPORTED = "No passage in these orders supported an answer to this question."
NOT_FOUND = "The indexed orders do not appear to cover this."
BOX = ("box_x", "box_y", "box_w", "box_h")
REPLY = "answer string, quotes array<struct<n:string,text:string>>, same_subject boolean, found boolean"


def relevance(questions: DataFrame, results: DataFrame, head: int = 3, min_cosine: float = MIN_COSINE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(qid, relevant, reason) from the first results' cosine and coverage; a question without results is not relevant."""
    best = results.where(F.col("position") <= head).groupBy("qid").agg(F.max("cosine").alias("cos"), F.coalesce(F.max("lexical_coverage"), F.lit(0.0)).alias("cov"), F.count(F.lit(1)).alias("n"))
    # halves go to the even digit
    percent = F.concat(F.lit("term overlap "), F.bround(F.col("cov") * 100, 0).cast("int").cast("string"), F.lit("%"))
    similar = F.concat(F.lit("semantic similarity "), F.format_string("%.2f", F.bround("cos", 2)))
    detail = F.when(F.col("cos").isNull(), percent).otherwise(F.concat(percent, F.lit(", "), similar))
    near, overlap = F.coalesce(F.col("cos") >= min_cosine, F.lit(False)), F.col("cov") >= min_coverage
    reason = F.when(F.col("n").isNull(), "nothing matched the question").when(near, similar).when(overlap, percent).otherwise(F.concat(F.lit("closest passages are not relevant ("), detail, F.lit(")")))
    return questions.select("qid").join(best, "qid", "left").select("qid", F.coalesce(near | overlap, F.lit(False)).alias("relevant"), reason.alias("reason"))


def prompts(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, prompt): the numbered excerpts of each question's results."""
    where = F.when(F.col("kind") == "subject", "subject line").otherwise(F.concat(F.lit("page "), F.col("page")))
    about = F.when((F.col("kind") != "subject") & (F.coalesce("subject", F.lit("")) != ""), F.concat(F.lit("\nThat order is about: "), F.col("subject"))).otherwise("")
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    part = F.concat(F.lit("["), F.col("position"), F.lit("] Government Order "), none("go_no"), F.lit(", dated "), none("go_date"), F.lit(", "), where, F.lit(", category "), none("category"), about, F.lit("\n"), F.col("text"))
    parts = results.select("qid", "position", part.alias("part")).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "part"))), lambda s: s["part"]), "\n\n").alias("excerpts"))
    return questions.join(parts, "qid").select("qid", F.concat("excerpts", F.lit("\n\nQuestion: "), "question", F.lit("\n\nJSON:")).alias("prompt"))


Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def ask(asked: DataFrame, provider: Provider) -> DataFrame:
    """(qid, raw): the provider's replies; it maps batches of (qid, prompt) on the executors."""
    return asked.select("qid", "prompt").mapInPandas(provider, "qid long, raw string")


def ask_once(asked: DataFrame, provider: Provider, folder: str, tries: int = 3, pause: float = 0.0) -> DataFrame:
    """(qid, raw, error): the provider's replies, each prompt asked once for all runs that share the folder; see `operators.once`.

    Prompts are told apart by their digest and the provider's name; questions with one prompt share its reply.
    """
    keyed = asked.select("qid", "prompt", F.concat_ws(":", F.lit(provider.__name__), F.sha2("prompt", 256)).alias("key"))

    def call(row: dict) -> str:
        return next(iter(provider(iter([pd.DataFrame({"qid": [0], "prompt": [row["prompt"]]})]))))["raw"].iloc[0]

    return keyed.join(once(keyed.select("key", "prompt"), call, folder, tries, pause), "key").select("qid", F.col("value").alias("raw"), "error")


def extractive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a language model: quotes the first words of the first excerpt."""
    import json

    for b in batches:
        def reply(prompt: str) -> str:
            body = prompt.split("\n\nQuestion:")[0].split("\n\n[2]")[0].split("\n")[-1]
            quote = " ".join(body.split()[:12])
            return json.dumps({"answer": quote, "quotes": [{"n": 1, "text": quote}], "same_subject": True, "found": True})

        yield pd.DataFrame({"qid": b["qid"], "raw": b["prompt"].map(reply)})


def parse(raw: DataFrame) -> DataFrame:
    """(qid, answer, quotes, same_subject, found): strict JSON, else the outermost braces, else the raw text as answer.

    A `found` that is not given is true, one that is null false; text without braces is an answer without quotes.
    """
    whole = F.try_parse_json("raw")
    span = F.nullif(F.regexp_extract("raw", r"(?s)\{.*\}", 0), F.lit(""))
    chosen = F.when(whole.isNotNull(), F.col("raw")).otherwise(span)
    rows = raw.withColumn("j", F.from_json(chosen, REPLY))
    return rows.select(
        "qid", F.when(chosen.isNull(), F.col("raw")).otherwise(F.coalesce("j.answer", F.lit(""))).alias("answer"),
        F.coalesce("j.quotes", F.array().cast("array<struct<n:string,text:string>>")).alias("quotes"), F.col("j.same_subject").alias("same_subject"), F.coalesce("j.found", ~F.coalesce(F.array_contains(F.json_object_keys(chosen), "found"), F.lit(False))).alias("found"),
    )


def verify(quotes: DataFrame, results: DataFrame) -> DataFrame:
    """Quotes (qid, i, n, text) with reason: null if the cited result has the quote's words in their order, and then where that is.

    Case does not count, nor that capitals spell some letters with several: STRASSE is found in Straße.
    """
    form = lambda: tx.match_form(tx.spelt_out(F.col("text")))
    counts = results.groupBy("qid").agg(F.count(F.lit(1)).alias("held"))
    n = F.expr("try_cast(n as int)")
    cited = results.select("qid", F.col("position").alias("cited"), "chunk_id", "goid", "page", "go_no", "go_date", *[c for c in BOX if c in results.columns], form().alias("hay"))
    rows = quotes.withColumn("cited", n).join(counts, "qid", "left").join(cited, ["qid", "cited"], "left").withColumn("needle", form())
    reason = (
        F.when(F.col("cited").isNull(), "no excerpt number").when((F.col("cited") < 1) | (F.col("cited") > F.coalesce("held", F.lit(0))), "excerpt number out of range")
        .when(F.char_length(F.replace(tx.match_form(F.col("text")), F.lit(" "))) < 8, "quote too short to verify").when(~F.contains("hay", "needle"), "not found verbatim in the cited excerpt")
    )
    where = [c for c in ("chunk_id", "goid", "page", "go_no", "go_date", *BOX) if c in cited.columns]
    return rows.select("qid", "i", "n", "text", reason.alias("reason"), *[F.when(reason.isNull(), F.col(c)).alias(c) for c in where])


def decide(parsed: DataFrame, checked: DataFrame, gate: DataFrame) -> DataFrame:
    """(qid, found, answer, reason, kept, dropped, off_topic): an answer stands only on a verified quote of the right subject."""
    counts = checked.groupBy("qid").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("dropped"))
    rows = gate.join(parsed, "qid", "left").join(counts, "qid", "left")
    off = F.coalesce(~F.col("same_subject"), F.lit(False))
    kept = F.coalesce("kept", F.lit(0))
    found = F.col("relevant") & F.coalesce("found", F.lit(False)) & (kept > 0) & ~off
    return rows.select(
        "qid", found.alias("found"), F.when(~F.col("relevant"), NOT_FOUND).when(found, F.trim("answer")).when(off, OFF_TOPIC).otherwise(UNSUPPORTED).alias("answer"),
        F.when(~F.col("relevant") | found, F.col("reason")).when(off, "the closest orders are about a different subject").otherwise("the model produced no quote that survived verification").alias("reason"),
        F.when(found, kept).otherwise(0).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"), off.alias("off_topic"),
    )


def answered(decided: DataFrame, checked: DataFrame, results: DataFrame) -> DataFrame:
    """The decisions with what they rest on: quotes (with passage, order, page, date and box), dropped_quotes (with reason), passages.

    Quotes are given where an answer was found, dropped ones and the passages always, in their order.
    """
    in_order = lambda by, value: F.transform(F.sort_array(F.collect_list(F.struct(by, value.alias("q")))), lambda s: s["q"])
    box = F.array(*[F.col(c) for c in BOX]) if set(BOX) <= set(checked.columns) else F.lit(None).cast("array<int>")
    kept = checked.where("reason is null").groupBy("qid").agg(in_order("i", F.struct("chunk_id", "goid", "page", "go_no", "go_date", "text", box.alias("box"))).alias("quotes"))
    dropped = checked.where("reason is not null").groupBy("qid").agg(in_order("i", F.struct("n", "text", "reason")).alias("dropped_quotes"))
    passages = results.groupBy("qid").agg(in_order("position", F.struct(*[c for c in results.columns if c not in ("qid", "question")])).alias("passages"))
    rows = decided.join(kept, "qid", "left").join(dropped, "qid", "left").join(passages, "qid", "left")
    none = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    quotes = F.when(F.col("found"), none(kept, "quotes")).otherwise(F.array().cast(kept.schema["quotes"].dataType))
    return rows.withColumns({"quotes": quotes, "dropped_quotes": none(dropped, "dropped_quotes"), "passages": none(passages, "passages")})
