"""The registered queries: each operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import text as T
from strandweave.operators import anchors, annotations, concepts, embedding, engines, lexical, library, maps, passages, pruned, reader, reports, rhythm
from strandweave.session import Corpus, Session
from strandweave.shared import shared_folder, stored
from strandweave.sources import tables as S
from strandweave.sources import versions
from strandweave.sources.files import ImportAnnotations, without_book
from strandweave.streaming import rhythm as stream

FLOOR = 0.35
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Engines: every passage is a seed.


@query
def plain_topk(spark: SparkSession, d: str) -> DataFrame:
    v = S.vec_chunks(spark, d)
    return _six(engines.plain(v, v), "similarity")


@query
def pruned_topk(spark, d):
    """The picks of `plain_topk`, by blocks in the order of what they can reach."""
    v = S.vec_chunks(spark, d)
    return _six(pruned.nearest(v, v, engines.K), "similarity").drop("multiplied")


@query
def corpus_rank(spark, d):
    v = S.vec_chunks(spark, d)
    ranked = engines.corpus_rank(engines.plain(v, v, 3), v, v)
    return ranked.select("seed_id", "id", "pos", "rank", F.col("corpus_size").cast("long").alias("corpus_size"))


@query
def best_match_gate(spark, d):
    v = S.vec_chunks(spark, d)
    return engines.noise_gate(v, v, FLOOR).select(F.col("id").alias("seed_id"))


@query
def band_pool(spark, d):
    v = S.vec_chunks(spark, d)
    return _six(engines.band_pool(v, v), "similarity")


@query
def band_mmr(spark, d):
    v = S.vec_chunks(spark, d)
    return _six(engines.band(v, v), "similarity", "score")


@query
def spread_dpp(spark, d):
    v = S.vec_chunks(spark, d)
    return _six(engines.spread(v, v), "similarity", "score")


@query
def spread_facility(spark, d):
    v = S.vec_chunks(spark, d)
    return _six(engines.spread(v, v, select="facility"), "similarity", "score")


@query
def echo(spark, d):
    v = S.vec_chunks(spark, d)
    return _six(engines.echo(v, v, min_sim=0.0), "similarity", "score").drop("distance")


@query
def walk(spark, d):
    v = S.vec_chunks(spark, d)
    return _six(engines.walk(v, v), "similarity", "hop_similarity")


def _two_spaces(spark, d):
    v = S.vec_chunks(spark, d)
    return v.join(S.structural_chunks(spark, d).select("id", F.col("vec").alias("svec")), "id")


@query
def structural_gap(spark, d):
    v = _two_spaces(spark, d)
    return _six(engines.structural(v, v), "similarity", "structural", "gap")


@query
def marks_best(spark, d):
    return _six(engines.marks_recall(S.vec_chunks(spark, d), S.marks(spark, d)), "similarity")


@query
def fused(spark, d):
    v, two = S.vec_chunks(spark, d), _two_spaces(spark, d)
    # The concept graph is of the passages that also have a vector, in the vectors' books.
    books = v.select("id", "book_id")
    chunks = S.text_chunks(spark, d).drop("book_id").join(books, "id")
    bridges = S.edges(spark, d).join(books.select(F.col("id").alias("provenance")), "provenance", "left_semi")
    graph = stored(concepts.graph_weights(stored(concepts.chunk_concepts(chunks), "concepts"), bridges), "concept-graph")
    paths = {
        "band": engines.band(v, v, k=12), "concept": stored(concepts.page_rank(graph, books, k=12), "concept-picks"),
        "marks": engines.marks_recall(v, S.marks(spark, d), k=12), "structural": engines.structural(two, two, k=12),
    }
    return _six(engines.fuse(paths, v, v), "similarity", "score")


@query
def intra_list_div(spark, d):
    v = S.vec_chunks(spark, d)
    return _six(engines.intra_list_diversity(engines.plain(v, v), v), "ild")


@query
def jaccard_matrix(spark, d):
    """Overlap of the engines' pick sets for each seed."""
    v, two = S.vec_chunks(spark, d), _two_spaces(spark, d)
    paths = {"plain": engines.plain(v, v), "marks": engines.marks_recall(v, S.marks(spark, d)), "structural": engines.structural(two, two)}
    every = None
    for name, picks in paths.items():
        part = picks.select("seed_id", F.lit(name).alias("engine"), "id")
        every = part if every is None else every.unionByName(part)
    sets = every.groupBy("seed_id", "engine").agg(F.collect_set("id").alias("ids"))
    side = lambda s: sets.select("seed_id", F.col("engine").alias(f"engine_{s}"), F.col("ids").alias(f"ids_{s}"))
    both = side("a").join(side("b"), "seed_id").where("engine_a < engine_b")
    return both.select(
        "seed_id", "engine_a", "engine_b",
        F.size(F.array_intersect("ids_a", "ids_b")).alias("shared"), F.size(F.array_union("ids_a", "ids_b")).alias("total"),
    )


@query
def eval_engines(spark, d):
    """Quality figures of two engines over all seeds."""
    v = S.vec_chunks(spark, d)
    rows = None
    book = v.select("id", "book_id")
    # Of the band only the rows to the sixteenth count: tasks keep no others.
    for name, picks in (("plain", engines.plain(v, v)), ("band_pool", engines.band_pool(v, v, pool=16 - engines.SKIP_TOP))):
        p = picks.join(book, "id").join(book.select(F.col("id").alias("seed_id"), F.col("book_id").alias("seed_book")), "seed_id")
        per = p.groupBy("seed_id").agg(
            F.count("*").alias("k"), F.countDistinct("book_id").alias("books"), F.sum((F.col("book_id") != F.col("seed_book")).cast("int")).alias("crossing")
        )
        one = v.select(F.col("id").alias("seed_id")).join(per, "seed_id", "left").agg(
            F.avg(F.coalesce("k", F.lit(0))).alias("mean_k"), F.avg(F.col("k").isNull().cast("int")).alias("empty_rate"),
            F.avg(F.col("books") / F.col("k")).alias("book_spread"), (F.sum("crossing") / F.sum("k")).alias("cross_book_rate"),
        ).select(F.lit(name).alias("engine"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return _six(rows, "mean_k", "empty_rate", "book_spread", "cross_book_rate")


# Lexical engines.


@query
def distinctive_terms(spark, d):
    return lexical.LexicalIndex(S.text_chunks(spark, d)).distinctive_terms()


@query
def lexical_theme(spark, d):
    index = lexical.LexicalIndex(S.text_chunks(spark, d))
    themes = S.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return lexical.lexical(index, lexical.theme_terms(themes)).drop("terms")


@query
def lexical_chunk(spark, d):
    chunks = S.text_chunks(spark, d)
    index = lexical.LexicalIndex(chunks)
    asked = index.distinctive_terms().select(F.col("id").alias("seed_id"), "term")
    return lexical.lexical(index, asked, books=chunks).drop("terms")


@query
def hybrid_rrf(spark, d):
    v, chunks = S.vec_chunks(spark, d), S.text_chunks(spark, d)
    index = lexical.LexicalIndex(chunks, v)
    asked = index.distinctive_terms().select(F.col("id").alias("seed_id"), "term")
    fused_ = lexical.reciprocal_fusion(engines.plain(v, v, 50), lexical.lexical(index, asked, 50, passage_seeds=True))
    return fused_.select("seed_id", "id", "pos", "why", F.round("score", 9).alias("score"))


# Concepts.


@query
def concept_vocab(spark, d):
    return concepts.vocabulary(S.text_chunks(spark, d)).select("gram", "mass")


@query
def chunk_concepts(spark, d):
    return concepts.chunk_concepts(S.text_chunks(spark, d))


@query
def concept_graph_weights(spark, d):
    return _six(concepts.graph_weights(concepts.chunk_concepts(S.text_chunks(spark, d)), S.edges(spark, d)), "w")


@query
def concept_ppr(spark, d):
    chunks = S.text_chunks(spark, d)
    graph = stored(concepts.graph_weights(stored(concepts.chunk_concepts(chunks), "concepts"), S.edges(spark, d)), "concept-graph")
    return concepts.page_rank(graph, chunks.select("id", "book_id"))


@query
def concept_theme(spark, d):
    """Passages by the walk from themes, with the concepts that each theme names."""
    graph = stored(concepts.graph_weights(stored(concepts.chunk_concepts(S.text_chunks(spark, d)), "concepts"), S.edges(spark, d)), "concept-graph")
    themes = S.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    picks = concepts.shared_labels(concepts.theme_rank(graph, themes), graph, concepts.matched_nodes(graph, themes))
    return picks.select("seed_id", "id", "similarity", "pos", F.array_join("concepts", ", ").alias("concepts"))


@query
def passage_graph(spark, d):
    found = concepts.passage_graphs(S.text_chunks(spark, d))
    edges = F.transform("edges", lambda e: F.format_string("%d-%d:%d", e["a"], e["b"], e["n"]))
    return found.select("id", F.array_join("concepts", ", ").alias("concepts"), F.array_join(edges, ", ").alias("edges"))


@query
def cooccurrence_edges(spark, d):
    return concepts.co_occurrence(concepts.chunk_concepts(S.text_chunks(spark, d)))


@query
def edges_dedupe(spark, d):
    e = S.edges(spark, d)
    return concepts.distinct_edges(e.unionByName(e))


# Corpus views.


@query
def books_index(spark, d):
    docs, labels = S.table(spark, d, "documents"), S.table(spark, d, "labels")
    noted = labels.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n_marks"))
    return (
        docs.groupBy("source").agg(F.count("*").alias("n_chunks")).join(noted, "source", "left")
        .select(F.col("source").alias("book_id"), "n_chunks", F.coalesce("n_marks", F.lit(0)).alias("n_marks"))
    )


@query
def state_snapshot(spark, d):
    c = S.table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@query
def chat_msg_ids(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.row_number().over(w) - 1
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string")).alias("msg_id"), "role")


@query
def usage_ledger(spark, d):
    e = S.table(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 3).alias("tokens"))


@query
def chunkmap_nn(spark, d):
    v = S.vec_chunks(spark, d)
    near = engines.plain(v, v, 1).select("seed_id", F.col("id").alias("nearest"), F.round("similarity", 6).alias("similarity"))
    return near.join(v.select(F.col("id").alias("seed_id"), "book_id"), "seed_id")


@query
def page_ingest_title(spark, d):
    p = S.table(spark, d, "pages")
    title = F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(title, "<[^>]+>", ""), r"\s+", " "))
    return p.select("page_id", plain.alias("title"), T.slug(plain).alias("slug"))


@query
def eval_recall_mrr(spark, d):
    """Retrieval of the documents that hold each benchmark passage: recall at 1, 5, 8 and reciprocal rank."""
    bench, docs = S.table(spark, d, "benchmark"), S.table(spark, d, "documents")
    quotes = bench.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    gold = anchors.contained(quotes, docs.select(F.col("doc_id").alias("book_id"), "text")).select(F.col("quote_id").alias("seed_id"), F.col("book_id").alias("id"))
    found = lexical_theme(spark, d)
    best = gold.join(found, ["seed_id", "id"], "left").groupBy("seed_id").agg(F.min("pos").alias("rank"))
    at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")
    return _six(best.agg(F.count("*").alias("queries"), at(1), at(5), at(8), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr")), "recall_1", "recall_5", "recall_8", "mrr")


# Reading rhythm.


def _words(spark, d):
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("passage"), T.word_count(F.col("text")).alias("words"))


def _features(spark, d):
    return rhythm.features(S.reading_events(S.table(spark, d, "events")), _words(spark, d))


@query
def rhythm_features(spark, d):
    return _six(_features(spark, d), "attentive_ms", "ms_per_word", "first_pass_ms_per_word", "max_dwell_ms")


@query
def rhythm_scores(spark, d):
    return _six(rhythm.scores(_features(spark, d)), "attentive_ms")


@query
def rhythm_candidates(spark, d):
    labels = S.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("passage"))
    # A dozen passages a book, so that a session comes back to some.
    events = S.reading_events(S.table(spark, d, "events"), SESSION_DAYS).withColumn("passage", F.col("passage") % 12)
    found = rhythm.candidates(events, _words(spark, d), labels)
    return _six(found.withColumn("signals", F.array_join("signals", ",")), "attentive_ms")


@query
def rhythm_baseline(spark, d):
    return _six(rhythm.baseline(_features(spark, d)), "med", "spread")


@query
def heat_portrait(spark, d):
    return rhythm.heat(_features(spark, d))


#: Days of a session where sessions are compared; runs of the stream that the log comes in, and how late an event may be.
SESSION_DAYS, WAVES, LATE_DAYS = 10, 3, 2


@query
def rhythm_stream(spark, d):
    """Visits and dead spans of each session from the log as a stream.

    The log comes in waves, shuffled by up to LATE_DAYS; each wave is a run that goes on from the state the run before left.
    A last tick moves the watermark past all sessions, so that visits still open are given out.
    """
    events = S.reading_events(S.table(spark, d, "events"), SESSION_DAYS)
    late = LATE_DAYS * 86_400_000_000
    came = F.col("t") + F.pmod(F.xxhash64("event_id"), F.lit(late))
    log = stored(events.withColumn("came", came), "stream-log")
    ends = log.agg(F.min("came").alias("low"), F.max("came").alias("high"), F.max("t").alias("last")).first()
    low, high, last = (ends[c] or 0 for c in ("low", "high", "last"))
    folder, shape = shared_folder(spark, "stream"), log.drop("came").schema
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for wave in range(WAVES + 1):
            first, end = (low + (high - low + 1) * k // WAVES for k in (wave, wave + 1))
            part = log.where((F.col("came") >= first) & (F.col("came") < end)).drop("came")
            if wave == WAVES:
                after = last + late + stream.GAP_MS * 1000 + 1_000_000
                part = spark.createDataFrame([(-1, None, after, "tick", None, -1, False)], shape).withColumn("session", F.current_date())
            part.write.mode("append").parquet(f"{folder}/in")
            flow = stream.intervals(spark.readStream.schema(shape).parquet(f"{folder}/in"), f"{LATE_DAYS} days")
            flow.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(stream.INTERVALS).parquet(f"{folder}/rows")


# Text to units.


def _books(spark, d):
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), "text")


@query
def chunk_blocks(spark, d):
    return passages.blocks(_books(spark, d), "\n").select("book_id", "pos", "kind", "words")


@query
def word_counts(spark, d):
    docs = S.table(spark, d, "documents")
    t = F.col("text")
    return docs.select("doc_id", T.word_count(t).alias("words"), F.size(T.lexical_tokens(t)).alias("tokens"), F.size(T.bag(t)).alias("bag"), F.round(T.prose_ratio(t), 6).alias("prose"))


@query
def boilerplate_filter(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.where(T.is_boilerplate(F.col("text"))).select("doc_id")


@query
def chunk_accumulate(spark, d):
    return passages.passages(_books(spark, d), "\n").select("book_id", "n", "words", "start", "end")


def _units(spark, d):
    p = passages.passages(_books(spark, d), "\n")
    return p.withColumn("id", F.format_string("%d#%04d", "book_id", "n"))


@query
def parents_link(spark, d):
    large = passages.passages(_books(spark, d), "\n", passages.PARENT_TARGET, passages.PARENT_OVERLAP)
    return _six(passages.link_parents(_units(spark, d), large.withColumn("id", F.format_string("%d#P%04d", "book_id", "n"))), "overlap")


@query
def propositions(spark, d):
    return passages.sentences(_units(spark, d)).select("book_id", "id", "n", F.length("text").alias("n_chars"))


@query
def sections_greedy(spark, d):
    return passages.sections(S.text_chunks(spark, d))


@query
def neighbours(spark, d):
    return passages.neighbours(S.text_chunks(spark, d))


@query
def toc(spark, d):
    docs = S.table(spark, d, "documents")
    return passages.contents(docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("id"), F.col("lang").alias("heading")))


@query
def semantic_cuts(spark, d):
    return passages.semantic_cuts(S.vec_chunks(spark, d))


@query
def lenient_replies(spark, d):
    """The values in replies made of conversations: bare, fenced, with prose and stray brackets, with a broken fence before, nested, and none."""
    c = S.table(spark, d, "conversations").where("text is not null")
    value = F.to_json(F.struct(F.col("conv_id").alias("id"), F.col("text").alias("said"), F.struct(F.col("turn"), F.array(F.lit("]}"), F.lit("{")).alias("odd")).alias("in")))
    fence = lambda x: F.concat(F.lit("```json\n"), x, F.lit("\n```"))
    forms = (
        value, fence(value), F.concat(F.lit("So {not json} and [this: "), F.lit("neither}, but \n"), value, F.lit("\n stands. }")),
        F.concat(F.lit("First:\n"), fence(F.lit('{"id": 1,,}')), F.lit("\nbetter:\n"), fence(value), F.lit("\ndone")), F.concat(F.lit("["), value, F.lit(", {}]")), F.lit("nothing } here {"),
    )
    kind = (F.col("conv_id") + F.col("turn")) % len(forms)
    reply = F.coalesce(*(F.when(kind == k, form) for k, form in enumerate(forms)))
    found = c.select("conv_id", "turn", kind.alias("kind"), T.lenient_json(reply).alias("v"))
    at = lambda path, kind: F.coalesce(F.try_variant_get("v", f"$.{path}", kind), F.try_variant_get("v", f"$[0].{path}", kind))
    return found.select("conv_id", "turn", "kind", at("id", "long").alias("id"), F.md5(at("said", "string")).alias("said"), at("in.turn", "long").alias("inner"))


@query
def marks_versioned(spark, d):
    """Marks in a table of versions, after a change that takes values out and moves rows, a deletion, and a book put in another's place."""
    marks = S.table(spark, d, "labels").join(S.table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("mark_id"), F.col("source").alias("book_id"), "quality", F.col("lang").alias("note"))
    table = versions.BookTable(spark, shared_folder(spark, "marks"), marks.schema)
    n = F.col("mark_id")
    table.replace(marks)
    moved = F.when(n % 5 == 0, F.array(F.lit("quality"), F.lit("note"))).when(n % 7 == 0, F.array(F.lit("book_id")))
    table.update(marks.select("mark_id", F.lit("moved").alias("book_id"), F.lit(None).cast("int").alias("quality"), F.lit("x").alias("note"), moved.alias("fields")).where("fields is not null"), "mark_id")
    table.delete(marks.where(n % 11 == 0).select("mark_id"), "mark_id")
    table.replace(marks.where("book_id = 'src1' and quality = 1"))
    return table.read()


@query
def uploads_named(spark, d):
    """Ids of pages that come as uploads of few names, some of which are in use."""
    n = F.col("page_id")
    uploads = S.table(spark, d, "pages").select(n.alias("upload_id"), F.concat(F.when(n % 9 == 0, F.lit("Big Book (2).PDF")).when(n % 9 == 1, F.lit("???.epub")).otherwise(F.concat(F.lit("in/Übung "), (n % 4).cast("string"), F.lit(".v1.pdf")))).alias("filename"))
    used = S.table(spark, d, "documents").select(F.concat(F.lit("big-book-2"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("-"), F.col("doc_id").cast("string"))).otherwise(F.lit(""))).alias("book_id")).where("book_id not like '%-0'")
    return versions.unique_ids(uploads, used.unionByName(spark.createDataFrame([("bung-3-v1",), ("bung-3-v1-2",), ("book-2",)], "book_id string")))


# Anchors and notes.


@query
def detect_book(spark, d):
    quotes = S.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return anchors.contained(quotes, _books(spark, d))


@query
def anchor_exact(spark, d):
    """Where each benchmark passage lies in every document that holds it."""
    quotes = S.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    books = _books(spark, d)
    held = anchors.contained(quotes, books).select("quote_id", "book_id").join(quotes, "quote_id").join(books, "book_id")
    return held.select("quote_id", "book_id", (F.expr("locate(quote, text)") - 1).cast("long").alias("start"), F.length("quote").cast("long").alias("n_chars"))


@query
def anchor_typos(spark, d):
    """Benchmark passages with a planted wrong letter, found again in every document that holds them."""
    quotes = S.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    books = _books(spark, d)
    held = anchors.contained(quotes, books).select("quote_id", "book_id").join(quotes, "quote_id")
    n, none = F.length("quote"), F.lit(None).cast("string")
    wrong = F.concat(F.substr("quote", F.lit(1), F.floor(n / 2)), F.lit("~"), F.substr("quote", F.floor(n / 2) + 2))
    asked = held.select((F.col("quote_id") * 10**9 + F.col("book_id")).alias("quote_id"), "book_id", wrong.alias("quote"), none.alias("prefix"), none.alias("suffix"))
    return anchors.resolve_all(asked, books).select("quote_id", "start", "end", "tier")


@query
def anchor_chunks_for(spark, d):
    """Passages that each resolved quote touches."""
    spans = anchor_exact(spark, d).select(
        F.concat_ws(":", F.col("quote_id").cast("string"), F.col("book_id").cast("string")).alias("span_id"), "book_id", "start", (F.col("start") + F.col("n_chars")).alias("end")
    )
    return anchors.chunks_for(spans, _units(spark, d))


@query
def orphan_candidates(spark, d):
    quotes = S.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return _six(anchors.orphan_candidates(quotes, S.text_chunks(spark, d)), "overlap")


@query
def md_highlights(spark, d):
    """Annotations imported from conversations as if they were exports."""
    c = S.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("=="), "text", F.lit("==")).alias("content"))
    spark.udtf.register("import_annotations", ImportAnnotations)
    c.createOrReplaceTempView("strandweave_exports")
    return spark.sql("SELECT conv_id, turn, i.* FROM strandweave_exports, LATERAL import_annotations('x.md', content) i")


# Model callables, contexts and reader views.


def _cache(spark, d):
    """A cache that knows the texts of labelled documents."""
    known = S.table(spark, d, "documents").join(S.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return known.select(library.content_hash(F.col("text")).alias("hash"), F.lit("cached").alias("value")).distinct()


@query
def enrich_pending(spark, d):
    return library.pending(S.text_chunks(spark, d), _cache(spark, d)).select("hash", F.length("text").alias("n_chars"))


@query
def enrich_cached(spark, d):
    """A stand-in model says how long a text is."""
    return library.enrich(S.text_chunks(spark, d), _cache(spark, d), lambda texts: [str(len(t)) for t in texts]).select("id", "value")


@query
def verdicts_kept(spark, d):
    """Picks that a stand-in judge, which looks at the texts' lengths, holds genuine."""
    v, t = S.vec_chunks(spark, d), S.text_chunks(spark, d)
    picks = engines.plain(v, v)
    pairs = picks.join(t.select("id", "text"), "id").join(t.select(F.col("id").alias("seed_id"), F.col("text").alias("seed_text")), "seed_id")
    say = lambda a, b: [(len(y) % 4 != 0, "high" if len(x + y) % 5 == 0 else "low", len(y) % 7 / 8) for x, y in zip(a, b)]
    return library.confirmed(picks, library.judge(pairs, say)).select("seed_id", "id", "pos", "forced_risk", "confidence")


@query
def rag_context(spark, d):
    v = S.vec_chunks(spark, d)
    made = library.contexts(engines.plain(v, v, 6), S.text_chunks(spark, d))
    return made.select("seed_id", F.length("context").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("digest"))


def _notes(spark, d):
    c = S.table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.concat(F.lit("<sutra>"), "text", F.lit("</sutra>\n"), "role", F.lit("(corr)")).alias("text"))


@query
def note_records(spark, d):
    return library.note_records(_notes(spark, d))


@query
def note_edges(spark, d):
    """Edges of notes whose edges follow several seeds, of conversations: each turn a seed, or for assistants an edge."""
    c = S.table(spark, d, "conversations").where("text is not null")
    records = c.select(F.col("conv_id").alias("note_id"), F.col("turn").cast("int").alias("n"), F.when(F.col("role") == "assistant", "edge").when(F.col("turn") % 3 == 0, "seed").otherwise("voice").alias("role"), "text")
    return concepts.note_edges(records)


@query
def book_of_import(spark, d):
    """The document that holds most of the benchmark passages of an import, every five of which come together."""
    quotes = S.table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 5).alias("import_id"), F.col("item_id").alias("quote_id"), F.upper("text").alias("quote"))
    return anchors.detected_books(quotes, _books(spark, d))


@query
def note_seeds(spark, d):
    return library.note_seed(library.note_records(_notes(spark, d)))


@query
def mark_colours(spark, d):
    share = lambda k: F.element_at("embedding", k).cast("double") + 0.5
    return S.table(spark, d, "embeddings").select("vec_id", library.nearest_colour(share(1), share(2), share(3)).alias("colour"))


@query
def pinned_orphans(spark, d):
    """Each benchmark passage pinned to its best candidate document."""
    docs = S.table(spark, d, "documents")
    asked = S.table(spark, d, "benchmark").select(F.col("item_id").alias("mark_id"), F.col("text").alias("quote"))
    best = anchors.orphan_candidates(asked.withColumnRenamed("mark_id", "quote_id"), S.text_chunks(spark, d), 1).select(F.col("quote_id").alias("mark_id"), "id")
    whole = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("book_id"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return library.pinned(asked.join(best, "mark_id"), whole, _books(spark, d))


@query
def catalog_titles(spark, d):
    name = F.concat_ws("-", F.col("source"), F.col("lang"))
    return S.table(spark, d, "documents").select(library.title_of(name).alias("title")).distinct()


@query
def edges_digest(spark, d):
    return library.digest(S.edges(spark, d))


def _levels(spark, d):
    """Passages, and as their parents the books, whose vector is the mean of their passages'."""
    v = S.vec_chunks(spark, d)
    n = len(v.limit(1).collect()[0]["vec"]) if not v.isEmpty() else 0
    number = F.substring("book_id", 2, 9).cast("long")
    books = v.groupBy("book_id").agg(F.array(*(F.avg(F.col("vec")[i]) for i in range(n))).alias("vec"))
    parent = 10**9 + number
    low = v.select(F.lit("chunk").alias("level"), "id", F.when(F.col("id") % 10 < 9, parent).otherwise(F.lit(-1)).cast("long").alias("parent_id"), "book_id", "vec")
    return low.unionByName(books.select(F.lit("parent").alias("level"), parent.alias("id"), F.lit(None).cast("long").alias("parent_id"), "book_id", "vec"))


@query
def chunk_map_nodes(spark, d):
    return maps.chunk_map(stored(_levels(spark, d), "levels"))[0]


@query
def chunk_map_edges(spark, d):
    return maps.chunk_map(stored(_levels(spark, d), "levels"))[1]


@query
def concept_map(spark, d):
    chunks = S.text_chunks(spark, d)
    return maps.concept_map(stored(concepts.chunk_concepts(chunks), "concepts"), chunks)[0]


@query
def map_2d(spark, d):
    return _six(library.flat_map(S.vec_chunks(spark, d)), "x", "y")


# Samples, reports and reader views.

DAY_BUDGET = 25_000.0


@query
def sample_systematic(spark, d):
    """Forty evenly spaced documents; the limit is the sampler's feature."""
    return reports.systematic_sample(S.table(spark, d, "documents"), "doc_id", 40).select("doc_id", "lang")


@query
def readiness_report(spark, d):
    chunks = S.text_chunks(spark, d)
    return reports.readiness(S.vec_chunks(spark, d), chunks, S.marks(spark, d), S.structural_chunks(spark, d), concepts.chunk_concepts(chunks))


@query
def eval_report(spark, d):
    v, two = S.vec_chunks(spark, d), _two_spaces(spark, d)
    marks = S.marks(spark, d)
    usable = marks.where(~F.col("orphaned")).select(F.col("target").alias("seed_id"), (F.col("target") + 1).alias("id"))
    structural = engines.structural(two, two).select("seed_id", "id", "pos", "similarity")
    plain = stored(engines.plain(v, v), "plain")
    # The best match is the nearest.
    noise = {"plain": plain.where("pos = 1").select("seed_id", (F.col("similarity") >= FLOOR).alias("gave"))}
    made = reports.engine_report({"plain": plain, "structural": structural}, v, v, noise, usable)
    return _six(made, "mean_k", "empty_rate", "book_spread", "cross_book_rate", "mean_rank_pct", "ild", "noise_fp_rate", "bridge_recall")


@query
def compare_models(spark, d):
    return reports.compare_spaces(S.vec_chunks(spark, d), S.structural_chunks(spark, d))


@query
def embed_leaderboard(spark, d):
    """Two retrieval models, BM25 and shared words, against the documents that hold each benchmark passage."""
    chunks = S.text_chunks(spark, d)
    quotes = S.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    gold = anchors.contained(quotes, _books(spark, d)).select(F.col("quote_id").alias("seed_id"), F.col("book_id").alias("id"))
    themes = quotes.select(F.col("quote_id").alias("id"), F.col("quote").alias("text"))
    found = {
        "bm25": lexical.lexical(lexical.LexicalIndex(chunks), lexical.theme_terms(themes), 10),
        "shared_words": anchors.orphan_candidates(quotes, chunks, 10).withColumnRenamed("quote_id", "seed_id"),
    }
    return _six(reports.retrieval_report(found, gold), "recall_1", "recall_3", "recall_5", "recall_10", "mrr", "mean_rank")


@query
def usage_budget(spark, d):
    return reports.usage_report(usage_ledger(spark, d), DAY_BUDGET)


@query
def log_summary(spark, d):
    made = reports.logged_summary(S.reading_events(S.table(spark, d, "events")))
    listed = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return made.select("book", "total", "sessions", listed.alias("by_type"))


@query
def dwell_portrait(spark, d):
    characters = S.table(spark, d, "documents").select(F.col("doc_id").alias("passage"), F.col("lang").alias("character"))
    return reports.portrait(rhythm.scores(_features(spark, d)), characters)


@query
def concept_counts(spark, d):
    chunks = S.text_chunks(spark, d)
    return reader.concept_counts(concepts.chunk_concepts(chunks), chunks)


@query
def concept_sites(spark, d):
    chunks = S.text_chunks(spark, d)
    return reader.concept_sites(concepts.chunk_concepts(chunks), chunks)


@query
def section_texts(spark, d):
    made = passages.section_texts(S.text_chunks(spark, d))
    return made.select("book_id", "section", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def semantic_passages(spark, d):
    words = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.word_count(F.col("text")).alias("words"))
    return passages.semantic_passages(S.vec_chunks(spark, d).join(words, "id"))


@query
def highlight_runs(spark, d):
    """Lines of documents, cut where benchmark passages in them begin and end."""
    lines = S.table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("pos", "x"))
    before = Window.partitionBy("book_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("x") + 1).over(before), F.lit(0))
    runs = lines.select("book_id", start.alias("start"), "x").select("book_id", "start", (F.col("start") + F.length("x")).alias("end"))
    spans = anchor_exact(spark, d).select("book_id", F.col("quote_id").alias("span_id"), "start", (F.col("start") + F.col("n_chars")).alias("end"))
    return reader.highlighted_runs(runs, spans)


@query
def session_list(spark, d):
    c = S.table(spark, d, "conversations")
    return reader.sessions(c.select(F.col("conv_id").alias("target"), F.col("turn").alias("n"), "role", F.col("text").alias("content")))


@query
def doc_summaries(spark, d):
    return S.table(spark, d, "documents").select("doc_id", reader.summary(F.col("text")).alias("summary"))


@query
def labels_merged(spark, d):
    """Labels after an update that takes quality from toxic documents."""
    labels = S.table(spark, d, "labels")
    return reader.merged(labels, labels.where("toxic = 1").select("doc_id", F.lit(0).alias("quality")), "doc_id")


# Sessions: every engine behind the contract.

_PICK = ("seed_id", "id", "pos", "similarity", "rank", "corpus_size", "score", "path", "why")


def _session(spark, d, *needs) -> Session:
    v = S.vec_chunks(spark, d)
    corpus = Corpus(v)
    if "texts" in needs:
        corpus.texts = S.text_chunks(spark, d)
    if "second" in needs:
        corpus.second = S.structural_chunks(spark, d).select("id", F.col("vec").alias("svec"))
    if "marks" in needs:
        corpus.marks = S.marks(spark, d)
    if "links" in needs:
        books = v.select("id", "book_id")
        corpus.links = stored(concepts.chunk_concepts(S.text_chunks(spark, d).drop("book_id").join(books, "id")), "concepts")
        corpus.edges = S.edges(spark, d).join(books.select(F.col("id").alias("provenance")), "provenance", "left_semi")
    return Session(corpus)


def _connected(engine: str, *needs, **params):
    def run(spark, d):
        session = _session(spark, d, *needs)
        return session.connect(engine, session.passages(), **params).select(*_PICK)

    run.__name__ = f"connect_{engine}"
    return query(run)


_connected("plain")
_connected("band")
_connected("spread")
_connected("echo", min_sim=0.0)
_connected("walk", k=4)
_connected("structural", "second")
_connected("marks", "marks")
_connected("lexical", "texts")
_connected("hybrid", "texts")
_connected("concept", "links")
_connected("fused", "links", "marks", "second")


@query
def wander(spark, d):
    session = _session(spark, d)
    return session.wander(session.passages(), 3)


@query
def engine_list(spark, d):
    rows = [(e["key"], i, ",".join(e["needs"]), e["gated"]) for i, e in enumerate(_session(spark, d).engines())]
    return spark.createDataFrame(rows, "engine string, place int, needs string, gated boolean")


@query
def theme_embedding(spark, d):
    themes = S.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    got = embedding.theme_seeds(themes).select("id", F.posexplode("vec").alias("k", "x"))
    return got.groupBy("id").agg(F.round(F.sum(F.col("k") * F.col("x")), 6).alias("moment"), F.sum((F.col("x") != 0).cast("int")).alias("n"))


@query
def corpus_embedding(spark, d):
    docs = S.text_chunks(spark, d)
    got = embedding.embed(docs).select("id", F.posexplode("vec").alias("k", "x"))
    return got.groupBy("id").agg(F.round(F.sum(F.col("k") * F.col("x")), 6).alias("moment"), F.sum((F.col("x") != 0).cast("int")).alias("n"))


# Annotations.


def _whole(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("book_id"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))


def _imported(spark, d):
    """Each benchmark passage as a quote of every document that holds it, and of one that may not."""
    quotes = S.table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("quote"))
    held = anchors.contained(quotes.withColumnRenamed("item", "quote_id"), _books(spark, d)).select(F.col("quote_id").alias("item"), "book_id")
    every = held.unionByName(quotes.select("item", F.col("item").alias("book_id"))).distinct().join(quotes, "item")
    # Numbers made of an item and a book are no keys where books have long ids: pairs are numbered, evenly, and written with their numbers.
    number = F.col("item") * 1000000 + F.col("book_id")
    return stored(every.select((F.monotonically_increasing_id() * 2).alias("quote_id"), "book_id", "quote", F.lit("").alias("note"), number.alias("number")), "imported")


@query
def annotations_created(spark, d):
    asked = _imported(spark, d).withColumns({"prefix": F.lit(None).cast("string"), "suffix": F.lit(None).cast("string")})
    return annotations.anchored(asked, _books(spark, d), _whole(spark, d)).select(F.col("number").alias("quote_id"), "target", "start", "end", "orphaned", F.size("chunk_ids").alias("n_chunks"))


@query
def import_counts(spark, d):
    # Found once: the pairs are used for the import, for its repetition and for what is known.
    pairs = _imported(spark, d).drop("number")
    again = pairs.withColumn("quote_id", F.col("quote_id") + 1)
    known = annotations.with_hash(pairs.where("book_id % 3 = 0"), annotations.PAGE_OF_MARKDOWN)
    return annotations.import_report(pairs.unionByName(again), known, _books(spark, d), _whole(spark, d))


def _annotations(spark, d):
    docs = S.table(spark, d, "labels").join(S.table(spark, d, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("annotation_id"), F.when(F.col("quality") == 1, F.col("source")).alias("book_id"), F.concat_ws("#", "source", F.col("doc_id").cast("string")).alias("target"),
        F.when(F.col("toxic") == 1, "ai").alias("source"), F.col("n_chars").alias("created"), (F.col("doc_id") % 5 == 0).alias("orphaned"),
    )


@query
def annotations_listed(spark, d):
    return annotations.listed(_annotations(spark, d), source="reader", orphaned=False).select("annotation_id", "target")


@query
def book_annotations(spark, d):
    return annotations.of_books(_annotations(spark, d))


@query
def mark_passages(spark, d):
    """Marks that name passages in several ways, some of which there aren't."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    n = F.col("doc_id")
    made = S.table(spark, d, "labels").select(
        n.alias("mark_id"), F.when(n % 3 == 0, F.array(n + 10**9, n + 1, n + 2)).alias("chunk_ids"), F.when(n % 3 == 1, n + 3).alias("target"), (n % 7).alias("passage_id")
    )
    return annotations.mark_targets(made, docs)


@query
def sparks_labelled(spark, d):
    n = F.col("doc_id")
    acts = S.table(spark, d, "labels").select(F.lit("b").alias("book_id"), n.alias("passage_id"), F.when(F.col("quality") == 1, "keep").otherwise("dismiss").alias("action"), F.lit("slow").alias("evidence"))
    kept, labels = annotations.sparks(acts)
    return labels.join(kept.select("passage_id", "note"), "passage_id", "left").select("passage_id", "label", "note")


@query
def selection_anchors(spark, d):
    spans = anchor_exact(spark, d).select(
        F.concat_ws(":", F.col("quote_id").cast("string"), F.col("book_id").cast("string")).alias("span_id"), "book_id", "start", (F.col("start") + F.col("n_chars")).alias("end")
    )
    return annotations.selection_anchor(spans, _books(spark, d))


@query
def book_payload(spark, d):
    return annotations.book_rows(S.text_chunks(spark, d))


@query
def log_cleared(spark, d):
    left = without_book(S.reading_events(S.table(spark, d, "events")), 7)
    return left.groupBy("book").agg(F.count("*").alias("n"))


@query
def compare_basis(spark, d):
    """Structural picks, with whether the nearest by surface have them too."""
    v, two = S.vec_chunks(spark, d), _two_spaces(spark, d)
    basis = engines.plain(v, v).select("seed_id", "id", F.lit(True).alias("both"))
    return engines.structural(two, two).select("seed_id", "id", "pos").join(basis, ["seed_id", "id"], "left").select("seed_id", "id", "pos", F.coalesce("both", F.lit(False)).alias("shared"))


@query
def doc_graph(spark, d):
    return concepts.shared_concepts(stored(concepts.chunk_concepts(S.text_chunks(spark, d)), "concepts"))


@query
def section_heads(spark, d):
    docs = S.table(spark, d, "documents")
    return passages.section_heads(docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("id"), "text", F.col("lang").alias("heading"), (F.col("doc_id") % 97).cast("int").alias("page")))
