"""Engines by name behind one contract: `Session(corpus).connect(engine, seeds, k, **params)`.

Every pick has seed_id, id, pos, similarity (to the seed, four places), rank (0-based place in the
whole corpus by similarity), corpus_size, score, path and why, and then the engine's own columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators import annotations, concepts, engines, lexical, reports
from strandweave.operators.reader import clip
from strandweave.shared import stored

DEFAULT, K = "band", engines.K
WHY_TERMS, WHY_CLIP, WHY_CONCEPTS = 6, 80, 3
BY_SURFACE = "the seed has no vector of its own in this space: asked by its surface"


@dataclass
class Corpus:
    """Tables of a corpus: vectors (id, book_id, author, vec) and what further engines need.

    texts: id, book_id, text.  second: id, svec.  marks: see `engines.marks_recall`.  links and edges: see
    `concepts.graph_weights`.  floor: the noise gate's least best match, none for no gate.
    """

    vectors: DataFrame
    texts: DataFrame | None = None
    second: DataFrame | None = None
    marks: DataFrame | None = None
    links: DataFrame | None = None
    edges: DataFrame | None = None
    floor: float | None = None

    def both_spaces(self) -> DataFrame:
        return self.vectors.join(self.second, "id")


class Engine(NamedTuple):
    """run(corpus, seeds, k, **params) gives seed_id, id, pos and more; `why` and `score` are columns over those and the contract's."""

    label: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]
    defaults: dict[str, Any]
    why: Callable[[], Column]
    score: Callable[[], Column]
    gated: bool = True
    #: What picks are joined with at the end by its first column, so that texts do not travel with them.
    texts: Callable[[Corpus], DataFrame] | None = None


def _two(column: str) -> Column:
    return F.format_string("%.2f", F.col(column))


def _place() -> Column:
    return F.concat(F.lit("#"), (F.col("rank") + 1).cast("string"))


def _terms() -> Column:
    more = F.size("terms") - WHY_TERMS
    listed = F.array_join(F.slice("terms", 1, WHY_TERMS), ", ")
    return F.concat(F.lit("keyword match: "), listed, F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(F.lit("")))


def _via() -> Column:
    """The rarest shared concepts, bridges said to be such."""
    plain = F.transform(F.slice("concepts", 1, WHY_CONCEPTS), lambda x: F.when(F.startswith(x, F.lit("edge:")), F.concat(F.substr(x, F.lit(6)), F.lit(" (bridge)"))).otherwise(x))
    return F.array_join(plain, ", ")


def _asked(corpus: Corpus, index: lexical.LexicalIndex, seeds: DataFrame, n_terms: int) -> DataFrame:
    own = seeds.select(F.col("id").alias("seed_id"))
    return index.distinctive_terms(n_terms).select(F.col("id").alias("seed_id"), "term").join(own, "seed_id", "left_semi")


def _lexical(corpus: Corpus, seeds: DataFrame, k: int, n_terms: int = lexical.QUERY_TERMS, exclude_same_book: bool = False) -> DataFrame:
    index = lexical.LexicalIndex(corpus.texts, seeds)
    return lexical.lexical(index, _asked(corpus, index, seeds, n_terms), k, corpus.texts if exclude_same_book else None, passage_seeds=True)


def _hybrid(corpus: Corpus, seeds: DataFrame, k: int, rrf_k: int = 60, pool: int = 50, exclude_same_book: bool = False) -> DataFrame:
    dense = engines.plain(seeds, corpus.vectors, pool) if not exclude_same_book else engines.band_pool(seeds, corpus.vectors, 0, pool, -2.0, 2.0)
    fused = lexical.reciprocal_fusion(dense, _lexical(corpus, seeds, pool, exclude_same_book=exclude_same_book), k, rrf_k)
    return fused.withColumnsRenamed({"why": "found", "score": "fused"})


def _concept(corpus: Corpus, seeds: DataFrame, k: int) -> DataFrame:
    graph = stored(concepts.graph_weights(corpus.links, corpus.edges), "concept-graph")
    found = concepts.page_rank(graph, corpus.vectors.select("id", "book_id"), k).withColumnRenamed("similarity", "activation")
    found = found.join(seeds.select(F.col("id").alias("seed_id")), "seed_id", "left_semi")
    return concepts.shared_labels(found, graph)


def _placed_marks(corpus: Corpus) -> DataFrame:
    """The marks with the passage each lies on as target: the first of its chunk_ids there is, else its target, else its passage_id."""
    marks = corpus.marks
    if "chunk_ids" not in marks.columns:
        return marks
    if "passage_id" not in marks.columns:
        marks = marks.withColumn("passage_id", F.lit(None).cast(corpus.vectors.schema["id"].dataType))
    return marks.drop("target").join(annotations.mark_targets(marks, corpus.vectors).withColumnRenamed("id", "target"), "mark_id")


def _marks(corpus: Corpus, seeds: DataFrame, k: int, min_sim: float = 0.25) -> DataFrame:
    return engines.marks_recall(seeds, _placed_marks(corpus), k, min_sim).withColumnRenamed("similarity", "mark_similarity")


def _structural(corpus: Corpus, seeds: DataFrame, k: int, min_sim: float = 0.20) -> DataFrame:
    """A seed without a vector in the second space, or with nought there, asks with its own vector, if that is as long; `fallback` says so."""
    real = F.coalesce(F.exists("svec", lambda x: x != 0), F.lit(False))
    long = F.broadcast(corpus.second.where(F.col("svec").isNotNull()).limit(1).select(F.size("svec").alias("n")))
    asked = seeds.join(corpus.second, "id", "left").join(long).withColumn("fallback", ~real)
    asked = asked.where(real | (F.size("vec") == F.col("n"))).withColumn("svec", F.when(real, F.col("svec")).otherwise(F.col("vec"))).drop("n")
    found = engines.structural(asked.drop("fallback"), corpus.both_spaces(), k, min_sim).drop("similarity")
    return found.join(asked.select(F.col("id").alias("seed_id"), "fallback"), "seed_id")


def _fused(corpus: Corpus, seeds: DataFrame, k: int, rank_k: int = 10) -> DataFrame:
    paths = {"band": engines.band(seeds, corpus.vectors, k=12)}
    if corpus.links is not None and corpus.edges is not None:
        paths["concept"] = _concept(corpus, seeds, 12)
    if corpus.marks is not None:
        paths["marks"] = engines.marks_recall(seeds, _placed_marks(corpus), 12)
    if corpus.second is not None:
        paths["structural"] = _structural(corpus, seeds, 12)
    return engines.fuse({n: stored(p.select("seed_id", "id", "pos"), f"path-{n}") for n, p in paths.items()}, seeds, corpus.vectors, k, rank_k)


_BAND = {"skip_top": engines.SKIP_TOP, "pool": engines.POOL, "min_sim": engines.MIN_SIM, "exclude_same_book": True, "exclude_same_author": False}
_similar = lambda: F.col("similarity")

#: The engines in their order.
ENGINES: dict[str, Engine] = {
    "band": Engine(
        "Resonance band", ("vectors",), lambda c, s, k, **p: engines.band(s, c.vectors, k, **p), {"weight": engines.MMR_LAMBDA, **_BAND},
        lambda: F.concat(F.lit("in the resonance band — "), _place(), F.lit(" of "), F.col("corpus_size").cast("string"), F.lit(" by similarity, past the obvious top matches, from another book")),
        _similar,
    ),
    "spread": Engine(
        "Set spread", ("vectors",), lambda c, s, k, **p: engines.spread(s, c.vectors, k, **p).withColumnRenamed("score", "gain"), {"select": "dpp", **_BAND},
        lambda: F.concat(
            F.lit("set-spread pick "), F.col("pos").cast("string"), F.lit(" — covers "), F.col("covers").cast("string"), F.lit(" of "), F.col("band_size").cast("string"),
            F.lit(" band passages, sim "), _two("similarity"), F.lit(", "), _place(), F.lit(" of "), F.col("corpus_size").cast("string"), F.lit(" by similarity"),
        ),
        lambda: F.col("gain"),
    ),
    "plain": Engine(
        "Nearest", ("vectors",), lambda c, s, k: engines.plain(s, c.vectors, k), {}, lambda: F.concat(_place(), F.lit(" nearest by surface similarity")), _similar, gated=False
    ),
    "lexical": Engine("Keywords", ("texts",), _lexical, {"n_terms": lexical.QUERY_TERMS, "exclude_same_book": False}, _terms, lambda: F.col("weight"), gated=False),
    "hybrid": Engine("Dense and keyword", ("vectors", "texts"), _hybrid, {"rrf_k": 60, "pool": 50, "exclude_same_book": False}, lambda: F.col("found"), lambda: F.col("fused")),
    "echo": Engine(
        "Echo in the book", ("vectors",), lambda c, s, k, **p: engines.echo(s, c.vectors, k, **p), {"gap": 12, "min_sim": 0.30, "weight": 0.6, "pool": engines.POOL},
        lambda: F.concat(F.lit("same book, "), F.col("distance").cast("string"), F.lit(" passages away — sim "), _two("similarity")), _similar,
    ),
    "concept": Engine(
        "Concept walk", ("links", "edges"), _concept, {}, lambda: F.concat(F.lit("via concepts: "), _via()), lambda: F.col("activation")
    ),
    "walk": Engine(
        "Walk", ("vectors",), lambda c, s, k, **p: engines.walk(s, c.vectors, k, **p).withColumn("pos", F.col("hop")), {"skip_top": engines.SKIP_TOP, "min_sim": engines.MIN_SIM, "revisit_books": False},
        lambda: F.concat(F.lit("hop "), F.col("hop").cast("string"), F.lit(" from "), F.col("from_id").cast("string"), F.lit(" — sim "), _two("hop_similarity"), F.lit(" to the previous step")),
        lambda: F.col("hop_similarity"),
    ),
    "marks": Engine(
        "Your marks", ("vectors", "marks"), _marks, {"min_sim": 0.25},
        lambda: F.when(F.trim("note") != "", F.concat(F.lit("your note — “"), clip(F.trim("note"), WHY_CLIP), F.lit("”"))).otherwise(
            F.concat(F.lit("your highlight — “"), clip(F.trim("quote"), WHY_CLIP), F.lit("”"))
        ),
        lambda: F.col("mark_similarity"), texts=lambda c: c.marks.select("mark_id", "quote", "note"),
    ),
    "structural": Engine(
        "Same move", ("vectors", "second"), _structural, {"min_sim": 0.20},
        lambda: F.concat(F.lit("same move ("), _two("structural"), F.lit(" structural vs "), _two("similarity"), F.lit(" surface)"), F.when(F.col("fallback"), F.lit(f" — {BY_SURFACE}")).otherwise(F.lit(""))),
        lambda: F.col("structural"),
    ),
    "fused": Engine("All paths", ("vectors",), _fused, {"rank_k": 10}, lambda: F.regexp_replace("paths", r"\+", " + "), lambda: F.col("fused")),
}

CONTRACT = "seed_id long, id long, pos int, similarity double, rank long, corpus_size long, score double, path string, why string"
#: Scores so small that four places would tie them.
SIX_PLACES = ("lexical", "hybrid", "concept")


def contract(picks: DataFrame, seeds: DataFrame, chunks: DataFrame, key: str, texts: DataFrame | None = None) -> DataFrame:
    """`picks` of the engine `key` with the contract's columns, joined with `texts` by its first column; a seed without a vector has no similarity and no rank."""
    engine = ENGINES[key]
    own = {"score": "weight"} if key == "lexical" else {"score": "fused"} if key == "fused" else {"score": "engine_score"}
    rows = stored(picks.withColumnsRenamed({k: v for k, v in own.items() if k in picks.columns}).drop("similarity"), f"picks-{key}")
    dot = F.aggregate(F.zip_with("s_vec", "c_vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    pair = rows.select("seed_id", "id").join(seeds.select(F.col("id").alias("seed_id"), F.col("vec").alias("s_vec")), "seed_id")
    pair = stored(pair.join(chunks.select("id", F.col("vec").alias("c_vec")), "id").select("seed_id", "id", dot.alias("similarity")), f"similar-{key}")
    ranks = engines.corpus_rank(pair, seeds, chunks).select("seed_id", "id", "similarity", "rank")
    both = rows.join(ranks, ["seed_id", "id"], "left").withColumn("corpus_size", F.lit(chunks.count()))
    extras = [c for c in rows.columns if c not in ("seed_id", "id", "pos")]
    if texts is not None:
        both = both.join(texts, texts.columns[0])
        extras += texts.columns[1:]
    return both.select(
        "seed_id", "id", F.col("pos").cast("int").alias("pos"), F.round("similarity", 4).alias("similarity"), F.col("rank").cast("long").alias("rank"),
        F.col("corpus_size").cast("long").alias("corpus_size"), F.round(engine.score(), 6 if key in SIX_PLACES else 4).alias("score"),
        F.lit(key).alias("path"), engine.why().alias("why"), *extras,
    )


class Session:
    """Searches one corpus."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    def engines(self) -> list[dict]:
        """Every engine with its label, needs and default parameters, in order."""
        return [{"key": k, "label": e.label, "needs": list(e.needs), "params": dict(e.defaults), "gated": e.gated} for k, e in ENGINES.items()]

    @staticmethod
    def key(engine: str | None) -> str:
        """The engine's name, or the default's for an unknown one."""
        return engine if engine in ENGINES else DEFAULT

    def params(self, engine: str | None, k: int = K, **given) -> dict:
        """What a search would run with: defaults, known names taken over in the default's type, and k.  Unknown names are left out."""
        defaults = ENGINES[self.key(engine)].defaults
        typed = {n: (str(v).lower() in ("1", "true", "yes")) if isinstance(defaults[n], bool) else type(defaults[n])(v) for n, v in given.items() if n in defaults and v is not None}
        return defaults | typed | {"k": int(k)}

    def connect(self, engine: str | None, seeds: DataFrame, k: int = K, **given) -> DataFrame:
        """Picks of all `seeds` (id, book_id, author, vec; with passages' ids where they are passages).  k under 1 gives none."""
        key = self.key(engine)
        missing = [n for n in ENGINES[key].needs if getattr(self.corpus, n) is None]
        if missing:
            raise ValueError(f"{key} needs {', '.join(missing)}")
        params = self.params(key, k, **given)
        if params["k"] < 1:
            return seeds.sparkSession.createDataFrame([], CONTRACT)
        if ENGINES[key].gated:
            seeds = engines.noise_gate(seeds, self.corpus.vectors, self.corpus.floor)
        engine = ENGINES[key]
        return contract(engine.run(self.corpus, seeds, **params), seeds, self.corpus.vectors, key, engine.texts(self.corpus) if engine.texts else None)

    def concept_theme(self, themes: DataFrame, k: int = K) -> DataFrame:
        """seed_id, id, pos, score, path, why, concepts: the concept walk from free text (`themes`: id, text), which needs no vector."""
        if self.corpus.links is None or self.corpus.edges is None:
            raise ValueError("concept needs links, edges")
        graph = stored(concepts.graph_weights(self.corpus.links, self.corpus.edges), "concept-graph")
        found = concepts.shared_labels(concepts.theme_rank(graph, themes, max(0, k)), graph, concepts.matched_nodes(graph, themes))
        why = F.concat(F.lit("theme matches concepts: "), _via())
        return found.select("seed_id", "id", F.col("pos").cast("int").alias("pos"), F.round("similarity", 6).alias("score"), F.lit("concept").alias("path"), why.alias("why"), "concepts")

    def ready(self) -> DataFrame:
        """engine, ready, reason."""
        c, none = self.corpus, self.corpus.vectors.limit(0)
        empty = c.vectors.sparkSession.createDataFrame([], "target long, quote string, note string, orphaned boolean")
        return reports.readiness(c.vectors, c.texts or none, c.marks if c.marks is not None else empty, c.second or none, c.links if c.links is not None else none)

    def passages(self, ids: DataFrame | None = None) -> DataFrame:
        """Passages as seeds: all, or those of `ids` (id)."""
        return self.corpus.vectors if ids is None else self.corpus.vectors.join(ids.select("id").distinct(), "id", "left_semi")

    def random_passages(self, n: int = 1, seed: int = 7) -> DataFrame:
        """`n` passages chosen evenly by the hash of their ids, the same for the same `seed`; the limit is the feature."""
        return self.corpus.vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)

    def wander(self, seeds: DataFrame, steps: int = 3, confirm: Callable[[DataFrame], DataFrame] | None = None, **params) -> DataFrame:
        """seed_id, step, from_id, id: from each seed to its best pick, and on from there.

        The best is the first that `confirm` (picks to picks with pos, as `library.confirmed` gives) holds
        genuine, else the band's first.  A line ends where a passage has no pick; each step's state is written.
        """
        at = seeds.select(F.col("id").alias("seed_id"), F.col("id").alias("from_id"))
        out = None
        for step in range(1, steps + 1):
            here = self.passages(at.select(F.col("from_id").alias("id")))
            picks = engines.band(here, self.corpus.vectors, **params)
            best = picks.where("pos = 1").select(F.col("seed_id").alias("from_id"), F.col("id").alias("next"))
            if confirm is not None:
                sure = confirm(picks).where("pos = 1").select(F.col("seed_id").alias("from_id"), F.col("id").alias("sure"))
                best = best.join(sure, "from_id", "left").select("from_id", F.coalesce("sure", "next").alias("next"))
            moved = stored(at.join(best, "from_id").select("seed_id", F.lit(step).alias("step"), "from_id", F.col("next").alias("id")), f"wander-{step}")
            out = moved if out is None else out.unionByName(moved)
            at = moved.select("seed_id", F.col("id").alias("from_id"))
        return out
