"""Concepts by tf-idf, the concept graph, and personalised PageRank over it."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.text import CONCEPT_STOP_WORDS, concept_tokens
from strandweave.operators.blocked import LEAST, MOST_PLACES, Block, best, best_places, block_pairs, kept, places
from strandweave.operators.reader import short_label
from strandweave.shared import stored

VOCABULARY, PER_CHUNK, MIN_DF, MAX_SHARE = 160, 6, 3, 0.40
BRIDGE_WEIGHTS = {"note": 1.5, "authored": 1.5, "judged": 1.0}
ALPHA, STEPS, MIN_ACTIVATION = 0.15, 30, 1e-6
MAX_NODES = 4096


#: Sums of grams by hash; corpora of fewer grams are counted outright.
BUCKETS, FEW_GRAMS = 1 << 18, 1 << 22


def tokens_of(chunks: DataFrame, stop_words: Sequence[str] = tuple(CONCEPT_STOP_WORDS)) -> DataFrame:
    """id, t: the words of passages after stop words go, stored; a corpus's own furniture may be among those."""
    return stored(chunks.select("id", concept_tokens(F.col("text"), stop_words).alias("t")), "concept-tokens")


def grams_of(tokens: DataFrame) -> DataFrame:
    """id, gram: a row for each word and each adjacent pair."""
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t")), lambda a, b: F.concat(a, F.lit(" "), b)))
    return tokens.select("id", F.explode(F.concat("t", F.coalesce(pairs, F.array().cast("array<string>")))).alias("gram"))


def vocabulary(chunks: DataFrame, size: int = VOCABULARY, stop_words: Sequence[str] = tuple(CONCEPT_STOP_WORDS)) -> DataFrame:
    """gram, idf, mass of the `size` heaviest grams (six places; ties alphabetical): a bounded list.

    A gram's mass is the sum of its tf times ln(n / df).  Few grams can be among the heaviest: how often those of one hash
    occur together bounds each one's total, and a total bounds a mass.  Only grams that reach the least mass of
    the list are counted by passage; what is left out cannot be in it.
    """
    return _heaviest(tokens_of(chunks, stop_words), size)


def _heaviest(tokens: DataFrame, size: int) -> DataFrame:
    n, grams = tokens.count(), grams_of(tokens)
    hashed = grams.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)))
    # At most BUCKETS rows.
    sums = stored(hashed.groupBy("bucket").agg(F.count("*").alias("most")), "gram-sums")

    def heaviest(least: int) -> DataFrame:
        reached = hashed.join(F.broadcast(sums.where(F.col("most") >= least).select("bucket")), "bucket", "left_semi")
        counts = reached.groupBy("id", "gram").agg(F.count("*").alias("tf")).groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        usual = counts.where((F.col("df") >= MIN_DF) & (F.col("df") <= F.greatest(F.lit(4), F.floor(F.lit(MAX_SHARE * n)))))
        weighed = usual.withColumn("idf", F.ln(F.lit(n) / F.col("df"))).select("gram", "idf", F.round(F.col("total") * F.col("idf"), 6).alias("mass"))
        return stored(weighed.orderBy(F.desc("mass"), "gram").limit(size), "vocabulary")

    # The heaviest buckets' grams tell a mass that the list's last reaches, and so how often a gram must occur.
    top = sums.orderBy(F.desc("most")).limit(8 * size).agg(F.min("most").alias("least"), F.count("*").alias("n")).first()
    if n <= 2 * MIN_DF or not top["n"] or sums.agg(F.sum("most").alias("n")).first()["n"] <= FEW_GRAMS:
        return heaviest(MIN_DF)
    first = heaviest(top["least"])
    known = first.agg(F.min("mass").alias("mass"), F.count("*").alias("n")).first()
    # One less, for what rounding may add.
    least = max(MIN_DF, int(known["mass"] / math.log(n / MIN_DF)) - 1) if known["n"] == size else MIN_DF
    return first if least >= top["least"] else heaviest(least)


def chunk_concepts(chunks: DataFrame, size: int = VOCABULARY, stop_words: Sequence[str] = tuple(CONCEPT_STOP_WORDS)) -> DataFrame:
    """id, pos, label: each passage's concepts by weight (ties to the later gram), stored."""
    w = Window.partitionBy("id").orderBy(F.desc("w"), F.desc("gram"))
    tokens = tokens_of(chunks, stop_words)
    # At most `size` rows.
    held = grams_of(tokens).join(F.broadcast(_heaviest(tokens, size).select("gram", "idf")), "gram")
    known = held.groupBy("id", "gram", "idf").agg(F.count("*").alias("tf")).withColumn("w", F.round(F.col("tf") * F.col("idf"), 6))
    return stored(known.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= PER_CHUNK).select("id", "pos", F.col("gram").alias("label")), "chunk-concepts")


def graph_weights(links: DataFrame, edges: DataFrame) -> DataFrame:
    """id, node, w: concept links and bridges, damped by 1 / ln(2 + passages of the node)."""
    kind = F.create_map(*(F.lit(x) for pair in BRIDGE_WEIGHTS.items() for x in pair))
    own = links.select("id", F.col("label").alias("node"), F.lit(1.0).alias("w"))
    bridges = edges.select(F.col("provenance").alias("id"), F.concat(F.lit("edge:"), "target").alias("node"), kind[F.col("origin")].alias("w"))
    one = own.unionByName(bridges).groupBy("id", "node").agg(F.max("w").alias("w"))
    counts = one.groupBy("node").agg(F.count("*").alias("n"))
    return one.join(counts, "node").select("id", "node", (F.col("w") / F.ln(2 + F.col("n"))).alias("w"))


def dense(entries: Column, n: int) -> Column:
    """An array of `n` places from (place, value) entries; noughts elsewhere."""
    held = F.map_from_entries(entries)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(held, i), F.lit(0.0)))


class Walk(NamedTuple):
    """What walks over a concept graph share: the nodes in order, two steps among them as a matrix, each passage's entries (j, out, back), and each node's greatest `back`."""

    nodes: list[str]
    move: np.ndarray
    rows: DataFrame
    most: np.ndarray

    def listed(self, rows: DataFrame) -> DataFrame:
        """`rows` with entries as arrays j, out and back of one length: shorter ones are filled up with a node past the last."""
        most = rows.agg(F.max(F.size("held")).alias("n")).first()["n"] or 1
        none = {"j": F.lit(len(self.nodes)), "out": F.lit(0.0), "back": F.lit(0.0)}
        filled = lambda c: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.coalesce(F.get("held", i)[c], none[c])).alias(c)
        return rows.select(*(c for c in rows.columns if c != "held"), *map(filled, none))

    def shares(self, block: Block, *names: str) -> Block:
        """A block's rows with the shares told as matrices of all nodes, made where they are multiplied: they are many times the entries."""
        made = {}
        for name in names:
            whole = np.zeros((len(block["j"]), len(self.nodes) + 1))
            whole[np.arange(len(whole))[:, None], block["j"]] = block[name]
            made[name] = whole[:, :-1]
        return block | made


def _walk(graph: DataFrame) -> Walk | None:
    """The walk over `graph`, none for a graph without links.  Over MAX_NODES nodes are refused, so that the matrix has a fixed bound."""
    nodes = [r["node"] for r in graph.select("node").distinct().orderBy("node").limit(MAX_NODES + 1).collect()]
    if len(nodes) > MAX_NODES:
        raise ValueError(f"over {MAX_NODES} concepts and bridge targets: pass a smaller vocabulary or fewer targets")
    if not nodes:
        return None
    # At most MAX_NODES rows: a node's sum, of which any share of the passages may be a part, combines before it is shuffled.
    place = graph.sparkSession.createDataFrame(list(zip(nodes, range(len(nodes)))), "node string, j int")
    of_node = graph.groupBy("node").agg(F.sum("w").alias("of_node")).join(F.broadcast(place), "node")
    of_chunk = Window.partitionBy("id")
    both = graph.join(F.broadcast(of_node), "node").withColumns({"out": F.col("w") / F.sum("w").over(of_chunk), "back": F.col("w") / F.col("of_node")})
    left = both.select("id", F.col("j").alias("a"), "back")
    move, most = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    # Pairs of one passage's few nodes, summed to one row a node pair.
    pairs = left.join(both.select("id", F.col("j").alias("b"), "out"), "id").groupBy("a", "b")
    for r in pairs.agg(F.sum(F.col("back") * F.col("out")).alias("m"), F.max("back").alias("most")).collect():
        move[r["a"], r["b"]] = r["m"]
        most[r["a"]] = max(most[r["a"]], r["most"])
    return Walk(nodes, move, both.groupBy("id").agg(F.collect_list(F.struct("j", "out", "back")).alias("held")), most)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("seed_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


#: Passages of a first block that are looked at before the others; pairs of seeds and passages that are computed in double precision together.
HEAD, PRECISE = 256, 1 << 14
#: What single precision and rounding may take from an activation, as a part of it and outright.
ROUGH, ROUNDED = 1e-4, 1e-9
_PICKS = "seed_id long, id long, similarity double"


class Asked:
    """A block of seeds by node, and which of a seed's nodes a passage must have one of to reach a floor.

    An activation is a sum over the passage's nodes.  Those that the seed has not add no more than the seed's greatest such
    products, and a node that it has no more than its own greatest; seeds need not be looked at by nodes whose sum with that stays under the floor.
    """

    def __init__(self, s: Block, most: np.ndarray, width: int):
        own = s["out"] > 0
        reach = s["mass"] * most
        others = np.where(own, 0.0, reach)
        take = min(width, others.shape[1])
        rest = np.partition(others, others.shape[1] - take, axis=1)[:, others.shape[1] - take :].sum(axis=1)
        self.row, self.node = np.nonzero(own)
        value = reach[self.row, self.node]
        # A seed's least first, each with the sum up to it.
        order = np.lexsort((value, self.row))
        row, total = self.row[order], np.cumsum(value[order])
        first = np.searchsorted(row, row)
        before = np.where(first > 0, total[first - 1], 0.0)
        self.reach = np.empty(len(order))
        self.reach[order] = (total - before + rest[row]) * (1 + ROUGH)
        order = np.argsort(self.node, kind="stable")
        self.row, self.node, self.reach = self.row[order], self.node[order], self.reach[order]

    def by_node(self, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(node, seeds) that must be looked at, where seeds have these floors."""
        kept_ = self.reach >= floor[self.row]
        row, node = self.row[kept_], self.node[kept_]
        cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]) if len(node) else []
        for low, high in zip(cuts, cuts[1:]):
            yield int(node[low]), row[low:high]


def reached(s: Block, c: Block, asked: Asked, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, passage, activation) of all pairs that share a node and may reach the seed's floor; some others too.

    Seeds and passages are multiplied node by node, so that most pairs, which share none or only frequent ones, are not.
    """
    n = s["mass32"].shape[1]
    width, rows = len(c["j"]), np.arange(len(c["j"]))
    whole = np.zeros((width, n + 1), np.float32)
    whole[rows[:, None], c["j"]] = c["back"]
    have, entry = np.nonzero(c["back"] > 0)
    node = c["j"][have, entry]
    order = np.argsort(node, kind="stable")
    have, starts = have[order], np.searchsorted(node[order], np.arange(n + 2))
    least = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
    found = [np.zeros(0, np.int64)]
    for k, mine in asked.by_node(floor):
        there = have[starts[k] : starts[k + 1]]
        if not len(there):
            continue
        part_of = whole[there, :-1].T
        step = max(1, MOST_PLACES // len(there))
        for low in range(0, len(mine), step):
            few = mine[low : low + step]
            i, j = np.divmod(places(s["mass32"][few] @ part_of >= least[few, None]), len(there))
            found.append(few[i] * width + there[j])
    i, j = np.divmod(np.unique(np.concatenate(found)), max(1, width))
    back, at = np.where(c["back"] > 0, c["back"], 0.0), np.minimum(c["j"], n - 1)
    act = np.concatenate([np.zeros(0), *((s["mass"][i[x : x + PRECISE, None], at[j[x : x + PRECISE]]] * back[j[x : x + PRECISE]]).sum(axis=1) for x in range(0, len(i), PRECISE))])
    return i, j, act


def page_rank(graph: DataFrame, books: DataFrame, k: int = 8) -> DataFrame:
    """seed_id, id, similarity (activation), pos: every passage's personalised PageRank neighbours.

    The walk alternates between passages and nodes.  Two steps among nodes are one small matrix,
    whose size is the vocabulary's and the bridges', not the corpus's; it is summed on the cluster.
    Over MAX_NODES of them are refused, so that the matrix has a fixed bound.
    Each seed's walk is then a vector over nodes, and activations are block products.
    """
    walk = _walk(graph)
    if walk is None:
        return graph.sparkSession.createDataFrame([], f"{_PICKS}, pos int")
    # After STEPS synchronous steps activations come from the nodes of the step before.
    total, step = np.zeros_like(walk.move), np.eye(len(walk.nodes))
    rounds = (STEPS - 2) // 2
    for i in range(rounds + 1):
        total += ((1 - ALPHA) if i == rounds else (1 - ALPHA) * ALPHA) * step
        step = (1 - ALPHA) ** 2 * step @ walk.move
    rows = walk.listed(walk.rows.join(books, "id"))
    nodes = Walk(walk.nodes, walk.move[:0], None, walk.most)

    def look(s: Block, c: Block, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed's place, passage's id, activation) of each seed's best that reach its floor, the best first."""
        # No part of an activation is negative, so single precision is wrong by far less than a ten-thousandth: it only tells
        # which pairs may reach what the seed has got.
        i, j, act = reached(s, c, s["asked"], np.maximum(floor, MIN_ACTIVATION) * (1 - ROUGH) - ROUNDED)
        value = np.round(act, 9)
        good = (act >= MIN_ACTIVATION) & (value >= floor[i]) & (s["book_id"][i] != c["book_id"][j]) & (s["id"][i] != c["id"][j])
        i, j, value = i[good], c["id"][j[good]], value[good]
        at, _ = best_places(i, value, j, k)
        return i[at], j[at], value[at]

    def work(s: Block, c: Block):
        if "mass" not in s:
            s |= nodes.shares(s, "out")
            s["mass"] = (1 - ALPHA) * (s["out"] @ total)
            s["mass32"] = s["mass"].astype(np.float32)
            s["asked"] = Asked(s, nodes.most, c["j"].shape[1])
        made, floor = [], s.get(LEAST)
        if floor is None:
            # A few passages give a floor for the others of the first block.
            head, c = ({n: v[part] for n, v in c.items()} for part in (slice(HEAD), slice(HEAD, None)))
            made.append(look(s, head, np.full(len(s["id"]), -np.inf)))
            floor = np.full(len(s["id"]), -np.inf)
            number, first, held = np.unique(made[0][0], return_index=True, return_counts=True)
            full = held == k
            floor[number[full]] = made[0][2][first[full] + k - 1]
        made.append(look(s, c, floor))
        i, j, value = map(np.concatenate, zip(*made))
        return {"seed_id": s["id"][i], "id": j, "similarity": value}

    return _best(block_pairs(rows, rows, work, _PICKS, best(k)), k)


def _named(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z'\-]{2,})"), F.lit(1)))


def matched_nodes(graph: DataFrame, themes: DataFrame) -> DataFrame:
    """seed_id, node: nodes of the graph whose names share a word with a theme (id, text).  Nodes are a bounded vocabulary."""
    bare = F.regexp_replace("node", "^edge:", "")
    words = graph.select("node").distinct().select("node", F.explode(_named(bare)).alias("word"))
    asked = themes.select(F.col("id").alias("seed_id"), F.explode(_named(F.col("text"))).alias("word"))
    return asked.join(words, "word").select("seed_id", "node").distinct()


def theme_rank(graph: DataFrame, themes: DataFrame, k: int = 8) -> DataFrame:
    """seed_id, id, similarity (activation), pos: passages that a walk from the nodes of each theme (id, text) activates.

    The walk sets out from all nodes that share a word with the theme alike, and only passages with one of
    them are picks.  A theme that names no node, is empty or null has none.  Themes of one id are one theme.
    """
    walk = _walk(graph)
    if walk is None:
        return graph.sparkSession.createDataFrame([], f"{_PICKS}, pos int")
    # The walk starts at nodes, which are active at odd steps only, so that STEPS / 2 of their states count.
    total, step = np.zeros_like(walk.move), np.eye(len(walk.nodes))
    for _ in range(STEPS // 2):
        total += ALPHA * step
        step = (1 - ALPHA) ** 2 * step @ walk.move
    place = F.create_map(*(F.lit(x) for pair in zip(walk.nodes, range(len(walk.nodes))) for x in pair))
    starts = matched_nodes(graph, themes).withColumn("j", place[F.col("node")])
    starts = starts.groupBy(F.col("seed_id").alias("id")).agg(dense(F.collect_list(F.struct("j", F.lit(1.0))), len(walk.nodes)).alias("vec"))

    nodes = Walk(walk.nodes, walk.move[:0], None, walk.most)

    def work(s: Block, c: Block):
        c = nodes.shares(c, "back")
        act = (1 - ALPHA) * (s["vec"] / s["vec"].sum(axis=1, keepdims=True)) @ total @ c["back"].T
        act[(s["vec"] @ (c["back"] > 0).T.astype(float) == 0) | (act < MIN_ACTIVATION)] = -np.inf
        return kept(s, c, np.round(act, 9), k)

    return _best(block_pairs(starts, walk.listed(walk.rows).select("id", "j", "back"), work, _PICKS, best(k)), k)


def co_occurrence(links: DataFrame, partners: int = 4, least: int = 2) -> DataFrame:
    """a, b, n: each concept's most frequent partners, undirected, once."""
    left, right = links.select("id", F.col("label").alias("a")), links.select("id", F.col("label").alias("b"))
    pairs = left.join(right, "id").where("a != b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    top = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= partners)
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").distinct()


def shared_labels(picks: DataFrame, graph: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """`picks` with concepts: the nodes a pick shares with its seed, the rarest first.  A passage has few nodes.

    `asked` (seed_id, node) has the nodes of seeds that are no passages.
    """
    counts = graph.groupBy("node").agg(F.count("*").alias("n"))
    mine = lambda key: graph.select(F.col("id").alias(key), "node")
    both = picks.select("seed_id", "id").join(mine("seed_id") if asked is None else asked, "seed_id").join(mine("id"), ["id", "node"]).join(counts, "node")
    lists = both.groupBy("seed_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "node"))), lambda x: x["node"]).alias("concepts"))
    return picks.join(lists, ["seed_id", "id"])


def shared_concepts(links: DataFrame, k: int = 4, least: int = 2) -> DataFrame:
    """seed_id, id, shared, pos: each passage's `k` partners that share most concepts, `least` or more; the limit bounds the graph.

    Concepts are a bounded vocabulary, so a passage is a row of noughts and ones and numbers shared are block products.
    """
    names = [r["label"] for r in links.select("label").distinct().orderBy("label").limit(MAX_NODES).collect()]
    place = {n: i for i, n in enumerate(names)}

    def marked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vecs = np.zeros((part.num_rows, max(1, len(place))))
            for row, labels in zip(vecs, part.column("labels").to_pylist()):
                row[[place[x] for x in labels]] = 1
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(vecs), pa.list_(pa.float64()))], names=["id", "vec"])

    rows = links.groupBy("id").agg(F.collect_set("label").alias("labels")).mapInArrow(marked, "id long, vec array<double>")

    def work(s: Block, c: Block):
        # Small whole numbers are exact in single precision.
        shared = s["vec"].astype(np.float32) @ c["vec"].T.astype(np.float32)
        return kept(s, c, shared, k, lambda i, j: s["id"][i] != c["id"][j], least)

    found = block_pairs(rows, rows, work, "seed_id long, id long, similarity double", best(k))
    w = Window.partitionBy("seed_id").orderBy(F.desc("similarity"), "id")
    top = found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    return top.select("seed_id", "id", F.col("similarity").cast("long").alias("shared"), "pos")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, provenance, origin)."""
    return edges.select("source", "target", "provenance", "origin").distinct()


#: Characters of a seed's text that name it.
SOURCE = 80


def note_edges(records: DataFrame) -> DataFrame:
    """source, target, relation, text, provenance, origin: an edge for each edge note that says something (note_id, n, role, text).

    Its source is the last seed text before it in its note, clipped, or the note itself; its target is the first sentence.
    """
    before = Window.partitionBy("note_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    seed = F.last(F.when((F.col("role") == "seed") & (F.col("text") != ""), F.col("text")), True).over(before)
    found = records.where(F.col("role").isin("seed", "edge")).withColumn("seed", seed).where((F.col("role") == "edge") & (F.col("text") != ""))
    clipped = F.when(F.length("seed") > SOURCE, F.concat(F.substring("seed", 1, SOURCE), F.lit("…"))).otherwise(F.coalesce("seed", F.col("note_id").cast("string")))
    one_line = F.trim(F.regexp_replace("text", r"\s+", " "))
    name = F.concat(F.col("note_id").cast("string"), F.format_string("#a%03d", F.col("n")))
    return found.select(clipped.alias("source"), short_label(F.col("text")).alias("target"), F.lit("correlate").alias("relation"), one_line.alias("text"), name.alias("provenance"), F.lit("note").alias("origin"))


def judged_edges(label: str, confirmed: DataFrame) -> DataFrame:
    """Edges to append for picks that a judge confirmed (id, book_id, author, title, bridge, articulation, confidence)."""
    told = lambda c: F.when(F.col(c) != "", F.col(c))
    target = F.concat(F.coalesce(told("author"), F.lit("Unknown")), F.lit(" — "), F.coalesce(told("title"), F.col("book_id")))
    said = F.trim(F.regexp_replace(F.coalesce("articulation", F.lit("")), r"\s+", " "))
    return confirmed.select(
        F.lit(label).alias("source"), target.alias("target"), F.lit("evokes").alias("relation"), said.alias("text"), F.col("id").cast("string").alias("provenance"),
        F.lit("judged").alias("origin"), "bridge", "confidence",
    )


#: A passage's own graph: frequent grams looked at, nodes and edges kept.
LOOKED_AT, NODES, EDGES = 40, 8, 12


def passage_graphs(chunks: DataFrame, stop_words: Sequence[str] = tuple(CONCEPT_STOP_WORDS)) -> DataFrame:
    """id, concepts (labels), edges (a, b, n: places of two labels and the sentences with both): each passage's own graph.

    Of the most frequent grams (ties to the earlier), pairs of words come before words; a gram that holds a
    chosen one or is held by it is left out.  Edges are by number of sentences, ties to the earlier one.
    Null and empty texts have no concepts.  Rows of one id are taken as one passage's, so ids must be distinct.
    """
    t = chunks.select("id", "text").repartition("id").select("id", "text", concept_tokens(F.col("text"), stop_words).alias("t"))
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t")), lambda a, b: F.concat(a, F.lit(" "), b)))
    grams = t.select("id", F.posexplode(F.concat("t", F.coalesce(pairs, F.array().cast("array<string>")))).alias("at", "gram"))
    counted = grams.groupBy("id", "gram").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "at")
    top = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= LOOKED_AT)
    order = F.struct((~F.contains("gram", F.lit(" "))).alias("single"), F.col("r"), F.col("gram"))
    listed = top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["gram"]).alias("ranked"))

    def choose(kept_: Column, gram: Column) -> Column:
        clash = F.exists(kept_, lambda x: F.contains(x, gram) | F.contains(gram, x))
        return F.when((F.size(kept_) < NODES) & ~clash, F.concat(kept_, F.array(gram))).otherwise(kept_)

    none = F.array().cast("array<string>")
    chosen = chunks.select("id", F.lower("text").alias("text")).join(listed, "id", "left").select(
        "id", "text", F.aggregate(F.coalesce("ranked", none), none, choose).alias("concepts")
    )
    sentences = F.split("text", r"(?<=[.!?])\s+")
    marked = chosen.withColumn("s", sentences).select("id", "concepts", F.transform("concepts", lambda g: F.transform("s", lambda x: F.contains(x, g))).alias("in"))

    def edge(a: Column, b: Column) -> Column:
        both = F.zip_with(F.element_at("in", a + 1), F.element_at("in", b + 1), lambda x, y: x & y)
        return F.struct((-F.size(F.filter(both, lambda x: x))).alias("less"), F.array_position(both, True).alias("first"), a.alias("a"), b.alias("b"))

    after = lambda a: F.when(a + 1 < F.size("concepts"), F.transform(F.sequence(a + 1, F.size("concepts") - 1), lambda b: edge(a, b)))
    every = F.when(F.size("concepts") > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size("concepts") - 2), after)))
    real = F.filter(F.coalesce(every, F.array().cast("array<struct<less:int,first:bigint,a:int,b:int>>")), lambda e: e["less"] < 0)
    ranked = F.slice(F.array_sort(real), 1, EDGES)
    return marked.select("id", "concepts", F.transform(ranked, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), (-e["less"]).alias("n"))).alias("edges"))
