"""Every query of the engine by name, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import catalog, chunking, evals, fusion, grounding, keyword, vector
from quillstone.operators.filters import predicate
from quillstone.plans import fixtures as fx
from quillstone.plans.oracles import ORACLES
from quillstone.sources.stored import written

#: Filters alone and together, by a name.
SELECTIONS = {
    "department": {"department": "src6"}, "goid": {"goid": 7}, "go_no": {"go_no": "1"},
    "all": {"department": "src6", "go_no": "1", "category": "1-URGENT", "date_from": "1993-06-01", "date_to": "1998-01-31"},
}
FILTERS = {"category": "1-URGENT", "date_from": "1994-01-01", "date_to": "1997-12-31"}


def _keyword(s, d, k=10, **filters):
    only = keyword.allowed(fx.passages(s, d), fx.orders(s, d), predicate(**filters)) if filters else None
    # written, so that the planner knows how few rows are joined with all texts, and sends no texts
    return written(keyword.keyword_search(fx.index(s, d), fx.questions(s, d), k, only))


def keyword_top(s, d):
    return _keyword(s, d).withColumn("bm25", F.round("bm25", 6))


def keyword_filtered(s, d):
    return _keyword(s, d, **FILTERS).withColumn("bm25", F.round("bm25", 6))


def maintained_search(s, d):
    """The index grown by increments, against passages as they are in the end."""
    return keyword.keyword_search(fx.maintained(s, d), fx.questions(s, d), 10).withColumn("bm25", F.round("bm25", 6))


def maintained_terms(s, d):
    return fx.maintained(s, d).terms


def keyword_of_long_words(s, d):
    """Questions of a text's long words alone: mostly few enough for bounds to rule spans out."""
    asked = fx.questions(s, d).select("qid", F.array_join(F.filter(F.split("question", " "), lambda w: F.char_length(w) >= 9), " ").alias("question"))
    return keyword.keyword_search(fx.index(s, d), asked, 10).withColumn("bm25", F.round("bm25", 6))


def filtered_orders(s, d):
    """The orders that each selection leaves, in one pass over the orders."""
    which = F.filter(F.array(*[F.when(predicate(**f), F.lit(n)) for n, f in SELECTIONS.items()]), lambda n: n.isNotNull())
    return fx.orders(s, d).select(F.explode(which).alias("selection"), "goid", "go_no", "department", "category", "go_date_iso")


def keyword_in_department(s, d):
    """A search within one department and a part of the order number."""
    return _keyword(s, d, department="src6", go_no="1").withColumn("bm25", F.round("bm25", 6))


def romanised_words(s, d):
    """Every word, put into four alphabets that together hold all Devanagari letters, signs, marks and digits, in Latin letters again."""
    from quillstone.functions.romanise import romanise

    return fx.devanagari(s, d).select("word", "script", romanise(F.col("script")).alias("latin"))


def phonetic_top(s, d):
    return keyword.phonetic_search(fx.index(s, d, "phonetic"), fx.questions(s, d), 10).withColumn("bm25", F.round("bm25", 6))


def phonetic_romanised(s, d):
    """Questions in Latin letters against passages of which every third is partly in Devanagari."""
    from quillstone.functions.romanise import romanise

    return keyword.phonetic_search(fx.index(s, d, "romanised"), fx.questions(s, d), 10, romanise).withColumn("bm25", F.round("bm25", 6))


def phonetic_keys(s, d):
    words = fx.table(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return words.withColumn("key", tx.phonetic_key(F.col("word")))


def _vectors(s, d):
    return fx.table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_top(s, d):
    v = _vectors(s, d)
    found = vector.vector_search(v, v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding")), 10)
    return found.withColumn("cosine", F.round("cosine", 6))


def vector_filtered(s, d):
    v = _vectors(s, d)
    only = v.where("label = 3").select("chunk_id")
    found = vector.vector_search(v, v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding")), 10, only)
    return found.withColumn("cosine", F.round("cosine", 6))


def vector_cells(s, d):
    """The search of `vector_top` over cells."""
    v = _vectors(s, d)
    asked = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    return vector.vector_search(vector.cells(v), asked, 10).withColumn("cosine", F.round("cosine", 6))


def vector_cells_filtered(s, d):
    v = _vectors(s, d)
    asked = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    return vector.vector_search(vector.cells(v), asked, 10, v.where("label = 3").select("chunk_id")).withColumn("cosine", F.round("cosine", 6))


def _hybrid(s, d, limit=10):
    questions, passages, orders = fx.questions(s, d), fx.passages(s, d), fx.orders(s, d)
    v = _vectors(s, d)
    asked = questions.join(v, F.col("qid") == F.col("chunk_id")).select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    channels = {"keyword": written(keyword.keyword_search(fx.index(s, d), questions)), "vector": written(vector.vector_search(v, asked))}
    found = fusion.diversify(fusion.hydrate(written(fusion.fuse(channels, limit=limit)), passages.select("chunk_id", "goid", "page"), orders.select("goid", "go_no")), limit)
    # texts only of the rows that stay
    rows = written(found).join(passages.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")
    return fusion.decorate(rows, list(channels))


def hybrid_search(s, d):
    return _hybrid(s, d).select("qid", "position", "chunk_id", "goid", "go_no", "page", "score", "bm25", "cosine", "lexical_coverage", "matched_by")


def fused_ranks(s, d):
    questions = fx.questions(s, d)
    v = _vectors(s, d)
    asked = questions.join(v, F.col("qid") == F.col("chunk_id")).select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    fused = fusion.fuse({"keyword": keyword.keyword_search(fx.index(s, d), questions), "vector": vector.vector_search(v, asked)}, {"vector": 0.6}, 5)
    return fused.select("qid", "chunk_id", "rank_keyword", "rank_vector", F.round("score", 9).alias("score"), "place")


def lexical_coverage(s, d):
    q, p = fx.questions(s, d), fx.passages(s, d)
    # texts first: the planner takes two joined tables for too large to be broadcast
    return _keyword(s, d).join(p.select("chunk_id", "text"), "chunk_id").join(q.select("qid", "question"), "qid").select("qid", "chunk_id", tx.coverage(F.col("question"), F.col("text")).alias("lexical_coverage"))


def related_orders(s, d):
    orders = fx.orders(s, d)
    return fusion.related(orders, orders.where("goid % 50 = 0"))


def subject_expansion(s, d):
    orders, body = fx.orders(s, d), fx.passages(s, d)
    subject = body.withColumns({"chunk_id": F.col("chunk_id") + 10_000_000, "kind": F.lit("subject")})
    body = body.unionByName(body.withColumns({"chunk_id": F.col("chunk_id") + 20_000_000, "ord": F.lit(1)}))
    hits = _keyword(s, d, 6).join(orders.select("goid"), F.col("chunk_id") == F.col("goid"), "left_semi")
    hits = hits.select("qid", F.col("chunk_id").alias("goid"), F.col("rank").alias("position"))
    results = hits.join(subject.select("goid", "chunk_id", "kind"), "goid").select("qid", "chunk_id", "goid", "kind", (1.0 / (60 + F.col("position"))).alias("score"), "position", F.lit("keyword").alias("matched_by"))
    return fusion.expand_subjects(results, body, 6).withColumn("score", F.round("score", 9))


def _loads(s, d):
    orders = fx.orders(s, d).withColumn("load_seq", F.lit(1))
    again = orders.where("goid % 2 = 0").withColumns({"load_seq": F.lit(2), "department": F.lit("renamed"), "subject": F.concat(F.lit("new "), "subject"), "section": F.lit(None).cast("string")})
    return orders.unionByName(again)


def upsert_orders(s, d):
    return catalog.upsert_orders(_loads(s, d)).select("goid", "go_no", "subject", "department", "section", "category")


def merged_orders(s, d):
    """The upserts of `upsert_orders`, the second load merged by key into the buckets of the first."""
    from quillstone.sources.keyed import Keyed, upserted
    from quillstone.sources.stored import scratch

    table = Keyed(s, scratch(s), "goid", "goid long, go_no string, subject string, department string, section string, category string", buckets=16)
    loads = _loads(s, d).select("load_seq", "goid", "go_no", "subject", "department", "section", "category")
    for seq in (1, 2):
        table.change(loads.where(F.col("load_seq") == seq), upserted())
    return table.read()


def _tallied(s, d):
    """Counts kept by differences: all orders come in, then every third moves to another category and is indexed, then every seventh goes."""
    from quillstone.operators import tallies
    from quillstone.sources.stored import scratch

    orders = fx.orders(s, d).select("goid", "category", "department", "go_date_iso", "ocr_ok")
    move = lambda df: df.withColumns({"category": F.when(F.col("goid") % 3 == 0, "moved").otherwise(F.col("category")), "ocr_ok": F.when(F.col("goid") % 3 == 0, 1).otherwise(F.col("ocr_ok"))})
    third, gone = orders.where("goid % 3 = 0"), move(orders).where("goid % 7 = 0")
    kept = tallies.open_(s, scratch(s))
    for batch, (before, after) in enumerate(((None, orders), (third, move(third)), (gone, None))):
        tallies.change(kept, before, after, batch=batch)
    return kept.read()


def maintained_facets(s, d):
    from quillstone.operators import tallies

    return tallies.facets(_tallied(s, d))


def maintained_totals(s, d):
    from quillstone.operators import tallies

    return tallies.totals(_tallied(s, d))


def replace_pages(s, d):
    return catalog.replace(fx.table(s, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def not_yet_indexed(s, d):
    return catalog.not_yet(fx.orders(s, d).select("goid", "go_no"), fx.table(s, d, "labels").select(F.col("doc_id").alias("goid")))


def mark_indexed(s, d):
    return catalog.mark_indexed(fx.orders(s, d).select("goid", "ocr_ok"), fx.table(s, d, "labels").select(F.col("doc_id").alias("goid")))


def _cited(text):
    n = lambda m: (F.col("goid") * m + 100).cast("string")
    return F.concat(text, F.lit(" No. "), n(7), F.lit("/XX-"), n(3), F.lit("/2019, Number: "), n(1), F.lit("/20 संख्या-"), n(7), F.lit("/XX-"), n(3), F.lit("/2019"))


def _cited_pages(s, d):
    return fx.passages(s, d).select("goid", "page", _cited(F.col("text")).alias("text"))


def citations(s, d):
    return catalog.references(_cited_pages(s, d), fx.orders(s, d))


def resolved_references(s, d):
    orders = fx.orders(s, d)
    refs = fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("goid"), F.col("l_linenumber").alias("page"), F.concat_ws("/", F.substring(F.col("l_partkey").cast("string"), 1, 2), F.substring(F.col("l_partkey").cast("string"), 3, 9)).alias("ref_text"), F.when(F.col("l_linenumber") == 7, F.col("l_suppkey")).alias("target_goid"))
    return catalog.resolve(refs, orders)


def resolved_count(s, d):
    return catalog.resolved_count(resolved_references(s, d))


def totals(s, d):
    return catalog.totals(fx.orders(s, d))


def departments(s, d):
    return catalog.departments(fx.orders(s, d))


def facets(s, d):
    return catalog.facets(fx.orders(s, d))


def passage_stats(s, d):
    return catalog.passage_stats(fx.passages(s, d))


def sample_passages(s, d):
    return catalog.sample(fx.passages(s, d).where(F.col("n_words").between(25, 900)).select("chunk_id", "page"), "chunk_id", 40, per="page", most=15)


def crop_boxes(s, d):
    p = fx.passages(s, d)
    return catalog.crop_box(p, p.select("goid", "page", F.lit(600).alias("img_w"), F.lit(500).alias("img_h")))


def recognised_lines(s, d):
    return chunking.lines(fx.words(s, d)).select("goid", "block", "line", "text", "n", "x", "y", "x2", "y2", F.size("word_ids").alias("ids"))


def packed_passages(s, d):
    p = chunking.passages(fx.words(s, d))
    return p.select("goid", "ord", "text", "n_words", "box_x", "box_y", "box_w", "box_h", F.size("word_ids").alias("ids"))


def page_assembly(s, d):
    return chunking.assembled(fx.words(s, d)).select("goid", F.char_length("text").alias("chars"), "words", F.round("mean_conf", 1).alias("mean_conf"))


def subject_passages(s, d):
    return chunking.subject_passages(fx.orders(s, d)).select("goid", "text", "n_words", "kind")


def numbered_passages(s, d):
    p = fx.passages(s, d).drop("chunk_id")
    both = p.unionByName(p.withColumn("kind", F.lit("subject")).where("goid % 2 = 0"))
    return chunking.number(both).select("chunk_id", "goid", "kind")


def persistent_ids(s, d):
    """Passages numbered in three loads, the second of which is repeated."""
    from quillstone.operators import ids
    from quillstone.sources.stored import scratch

    made, folder = fx.passages(s, d).drop("chunk_id"), scratch(s)
    loads = [ids.numbered(made.where(F.col("goid") % 3 == b), folder, b) for b in (0, 1, 1, 2)]
    return loads[0].unionByName(loads[2]).unionByName(loads[3]).select("chunk_id", "goid")


def streamed_passages(s, d):
    """Passages as the maintaining stream leaves them, after pages have come in several micro-batches and some of them twice."""
    from quillstone.sources.stored import removed, scratch
    from quillstone.streaming import maintain

    incoming, folder = scratch(s), scratch(s)
    pages, even = fx.page_rows(s, d), F.col("goid") % 2 == 0

    def run():
        rows = s.readStream.schema(maintain.PAGES).option("recursiveFileLookup", True).parquet(incoming)
        maintain.start(rows, f"{folder}/data", f"{folder}/stream").awaitTermination()

    first = written(pages.where(even), f"{incoming}/first")
    run()
    # these pages come again beside the others; their first files have been taken in
    written(first.unionByName(pages.where(~even)), f"{incoming}/second")
    removed(s, f"{incoming}/first")
    run()
    return s.read.parquet(f"{folder}/data/passages").select("goid", "ord", "text", "n_words", "box_x", "box_y", "box_w", "box_h")


def clean_lines(s, d):
    line = fx.table(s, d, "documents").select(F.col("doc_id").alias("goid"), F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return line.select("goid", "line", tx.clean_line(F.col("l")).alias("cleaned"), tx.is_furniture(tx.clean_line(F.col("l"))).alias("furniture"), tx.language(F.col("l")).alias("language"))


def number_keys(s, d):
    o = fx.orders(s, d)
    c = F.concat_ws("-", F.lit("No. संख्या"), "go_no", "section", F.lit("É/_"), "go_date")
    return o.select("goid", tx.number_key(c).alias("number"), tx.loose_number_key(F.col("go_date")).alias("loose"), tx.fold_digits(F.concat(F.lit("१२"), "go_no")).alias("folded"))


def iso_dates(s, d):
    o = fx.orders(s, d)
    raw = F.when(F.col("goid") % 5 == 0, F.concat(F.lit("99-9-"), F.substring("go_date", 7, 4))).when(F.col("goid") % 7 == 0, F.regexp_replace("go_date", "-", "/")).otherwise(F.col("go_date"))
    return o.select("goid", tx.iso_date(raw).alias("iso"))


def https_urls(s, d):
    p = fx.table(s, d, "pages")
    raw = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "/", r"\\")).when(F.col("page_id") % 4 == 1, F.concat(F.lit(" "), F.regexp_replace("url", "^https?://[^/]*", ""))).when(F.col("page_id") % 4 == 2, F.regexp_replace("url", "^https?://[^/]*/", "")).otherwise(F.col("url"))
    return p.select("page_id", tx.https_url(raw, "https://example.org").alias("pdf_url"))


def match_forms(s, d):
    return fx.passages(s, d).select("chunk_id", F.md5(tx.match_form(F.col("text")).cast("binary")).alias("digest"))


def _results(s, d, k=6):
    """Keyword results with everything the answer operators read."""
    q = fx.questions(s, d)
    hits = written(_keyword(s, d, k).withColumnRenamed("rank", "position").join(fx.passages(s, d), "chunk_id"))
    # the planner can't see how few orders these are of, and would send all
    o = fx.orders(s, d, written(hits.select("goid").distinct()))
    rows = hits.join(o, "goid").join(q.select("qid", "question"), "qid")
    return written(rows.withColumns({"cosine": F.when(F.col("qid") % 3 == 0, F.round(F.col("chunk_id") % 70 / 100, 2)), "lexical_coverage": tx.coverage(F.col("question"), F.col("text"))}))


def relevance_gate(s, d):
    return grounding.relevance(fx.questions(s, d), _results(s, d))


def prompts(s, d):
    return grounding.prompts(fx.questions(s, d).select("qid", "question"), _results(s, d)).select("qid", F.md5(F.col("prompt").cast("binary")).alias("digest"))


def _echo(batches):
    import hashlib

    for b in batches:
        yield b.assign(raw=b["prompt"].map(lambda p: hashlib.md5(p.encode()).hexdigest()))[["qid", "raw"]]


def replies(s, d):
    """Every prompt put to a provider through the ledger, by two runs."""
    from quillstone.sources.stored import scratch

    asked, folder = grounding.prompts(fx.questions(s, d).select("qid", "question"), _results(s, d)), scratch(s)
    grounding.ask_once(asked.where("qid % 2 = 0"), _echo, folder)
    return grounding.ask_once(asked, _echo, folder).select("qid", F.col("raw").alias("digest"), "error")


def _raw(s, d):
    """Replies that quote the benchmark text, in several states of repair."""
    q = fx.questions(s, d)
    quote = F.when(F.col("qid") % 7 == 3, F.lit("ab, c")).otherwise(F.upper("text"))
    n = F.when(F.col("qid") % 11 == 5, F.lit("none")).when(F.col("qid") % 13 == 6, F.lit("99")).otherwise(F.lit("1"))
    body = F.to_json(F.struct(F.concat(F.lit(" says "), "qid").alias("answer"), F.array(F.struct(n.alias("n"), quote.alias("text"))).alias("quotes"), (F.col("qid") % 6 != 1).alias("same_subject")))
    return q.select("qid", F.when(F.col("qid") % 5 == 2, F.concat(F.lit("Here: "), body, F.lit(" done"))).when(F.col("qid") % 5 == 4, F.lit("plain words")).otherwise(body).alias("raw"))


def parsed_replies(s, d):
    p = grounding.parse(_raw(s, d))
    return p.select("qid", "answer", F.size("quotes").alias("n_quotes"), "same_subject", "found")


def _checked(s, d, results):
    quotes = grounding.parse(_raw(s, d)).select("qid", F.posexplode("quotes").alias("i", "q")).select("qid", "i", "q.n", "q.text")
    return grounding.verify(quotes, results)


def verified_quotes(s, d):
    return _checked(s, d, _results(s, d)).select("qid", "i", "reason", "chunk_id")


def decisions(s, d):
    results = _results(s, d)
    return grounding.decide(grounding.parse(_raw(s, d)), _checked(s, d, results), grounding.relevance(fx.questions(s, d), results))


def answers(s, d):
    """Whole answers: cited quotes with their boxes, dropped quotes with reasons, and the passages shown."""
    results = _results(s, d)
    checked = _checked(s, d, results)
    rows = grounding.answered(grounding.decide(grounding.parse(_raw(s, d)), checked, grounding.relevance(fx.questions(s, d), results)), checked, results)
    quote = lambda q: F.concat_ws("|", q["chunk_id"], q["goid"], q["page"], q["go_no"], q["go_date"], F.array_join(q["box"], ","), q["text"])
    lost = lambda q: F.concat_ws("|", q["n"], q["reason"], q["text"])
    return rows.select(
        "qid", "found", "answer", "off_topic", F.array_join(F.transform("quotes", quote), ";").alias("quotes"), F.array_join(F.transform("dropped_quotes", lost), ";").alias("dropped_quotes"),
        F.array_join(F.transform("passages", lambda p: p["chunk_id"].cast("string")), ",").alias("passages"),
    )


def _gold(s, d):
    q = fx.questions(s, d)
    return q.select("qid", "question", F.when(F.col("qid") % 3 == 0, "hi").otherwise("en").alias("language"), (F.col("qid") * 3).alias("expect_goid"), (F.col("qid") % 3 + 1).cast("int").alias("expect_page"), (F.col("qid") % 5 == 0).alias("unanswerable"), F.when(F.col("qid") % 2 == 0, F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.col("qid") + i * 17)).alias("accept_goids"))


def retrieval_details(s, d):
    return evals.retrieval_details(_gold(s, d), _results(s, d, 5))


def retrieval_metrics(s, d):
    gold, results = _gold(s, d), _results(s, d)
    declined = grounding.relevance(gold.where("unanswerable"), results).select("qid", (~F.col("relevant")).alias("declined"))
    return evals.retrieval_metrics(evals.retrieval_details(gold, results), declined)


def retrieval_misses(s, d):
    return evals.misses(retrieval_details(s, d)).select("qid", "language")


def answer_metrics(s, d):
    c = fx.table(s, d, "conversations")
    return evals.answer_metrics(c.select(
        (F.col("conv_id") % 4 == 0).alias("unanswerable"), F.when(F.col("conv_id") % 17 == 3, "error").alias("error"), (F.col("turn") % 2 == 0).alias("found"), (F.col("turn") % 3).alias("n_quotes"),
        (F.col("turn") % 2).alias("n_dropped"), (F.col("conv_id") % 3 == 1).alias("cited_expected_order"), F.round(F.char_length("text") / 10, 1).alias("seconds"),
    ))


def _gate_pages(s, d):
    """Pages of twenty lines."""
    w = fx.words(s, d).withColumn("page", F.floor(F.col("line") / 20).cast("int") + 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "word", "text"))), lambda x: x["text"]), " ")
    pages = w.groupBy("goid", "page").agg(F.count(F.lit(1)).alias("words"), F.round(F.avg("conf"), 1).alias("mean_conf"), text.alias("text"))
    return pages.withColumns({"text": _cited(F.col("text")), "seconds": F.col("words") / 100})


def gate_rows(s, d):
    return evals.gate_rows(_gate_pages(s, d), fx.orders(s, d)).select("goid", "pages", "chars", "words", "mean_conf", "low_pages", "devanagari_pct", "has_date_token", "secs_per_page", "go_refs_found", "category")


def gate_totals(s, d):
    return evals.gate_totals(evals.gate_rows(_gate_pages(s, d), fx.orders(s, d)))


def page_stats(s, d):
    return evals.page_stats(fx.words(s, d))


def batch_summary(s, d):
    return evals.batch_summary(_gate_pages(s, d))


def event_windows(s, d):
    from quillstone.streaming.ingest import event_counts

    done = event_counts(fx.table(s, d, "events"))
    return done.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


NAMES = [
    keyword_top, keyword_filtered, filtered_orders, keyword_in_department, romanised_words, keyword_of_long_words, maintained_search, maintained_terms, phonetic_top, phonetic_romanised, phonetic_keys, vector_top, vector_filtered, vector_cells, vector_cells_filtered, hybrid_search, fused_ranks, lexical_coverage, related_orders, subject_expansion,
    upsert_orders, merged_orders, maintained_facets, maintained_totals, replace_pages, not_yet_indexed, mark_indexed, citations, resolved_references, resolved_count, totals, departments, facets, passage_stats, sample_passages, crop_boxes,
    recognised_lines, packed_passages, page_assembly, subject_passages, numbered_passages, persistent_ids, streamed_passages, clean_lines, number_keys, iso_dates, https_urls, match_forms,
    relevance_gate, prompts, replies, parsed_replies, verified_quotes, decisions, answers, retrieval_details, retrieval_metrics, retrieval_misses, answer_metrics, gate_rows, gate_totals, page_stats, batch_summary, event_windows,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, q in ORACLES.items() if n in queries()}
