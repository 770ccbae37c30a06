"""The retrieval engines over vectors: from every seed, what else in the corpus?

`seeds` and `chunks` have id, book_id, author, vec (unit length, doubles); a seed that is a passage
shares its id.  Every engine returns seed_id, id, pos (1-based), similarity and its own columns.
Null book or author of a seed excludes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.blocked import FEW_PAIRS, Allowed, Block, Products, best, best_of, block_pairs, blocks_of, in_files, kept, places, products, read_block, sums, tiles, unpack, whole
from strandweave.shared import stored

K, SKIP_TOP, POOL = 8, 8, 120
MMR_LAMBDA, MIN_SIM, DEDUP_SIM = 0.4, 0.15, 0.97
FOUND = "seed_id long, id long, similarity double"


def _same(seed: Block, chunk: Block, column: str) -> Allowed:
    """Whether the rows and columns told are of one book or author; a null or empty one is like none."""
    a, b = seed[column], chunk[column]
    name = f"\0known {column}"
    if name not in seed:
        seed[name] = np.array([x is not None and x != "" for x in a], bool)
    return lambda i, j: seed[name][i] & _equal(a, b, i, j)


def _equal(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a[i] is b[j]; many are compared by numbers for the values."""
    if len(i) <= len(a) + len(b):
        return np.array(a[i] == b[j], bool)
    _, codes = np.unique(np.concatenate([a, b]).astype(str), return_inverse=True)
    return codes[i] == codes[len(a) + j]


def _other(seed: Block, chunk: Block) -> Allowed:
    return lambda i, j: seed["id"][i] != chunk["id"][j]


def ranked(found: DataFrame, limit: int, order: str = "similarity") -> DataFrame:
    """The `limit` best of each seed over all blocks, with pos."""
    w = Window.partitionBy("seed_id").orderBy(F.desc(order), "id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)


def _only(seeds: DataFrame, chunks: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with their ids and the columns that are asked for: no others are written and read; one table stays one."""
    asked = seeds.select("id", *columns)
    return asked, asked if seeds is chunks else chunks.select("id", *columns)


def plain(seeds: DataFrame, chunks: DataFrame, k: int = K) -> DataFrame:
    """Nearest passages, the seed itself left out."""
    seeds, chunks = _only(seeds, chunks, "vec")

    def work(s: Block, c: Block):
        return kept(s, c, Products(s, c), k, _other(s, c))

    return ranked(block_pairs(seeds, chunks, work, FOUND, best(k)), k)


def best_match(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """seed_id, best: the highest similarity to a passage other than the seed."""
    return plain(seeds, chunks, 1).select("seed_id", F.col("similarity").alias("best"))


def noise_gate(seeds: DataFrame, chunks: DataFrame, floor: float | None) -> DataFrame:
    """Seeds whose best match reaches the floor, or that have none to judge by."""
    if floor is None:
        return seeds
    low = best_match(seeds, chunks).where(F.col("best") < floor)
    return seeds.join(low, seeds["id"] == low["seed_id"], "left_anti")


def band_pool(
    seeds: DataFrame, chunks: DataFrame, skip_top: int = SKIP_TOP, pool: int = POOL, min_sim: float = MIN_SIM,
    dedup_sim: float = DEDUP_SIM, exclude_same_book: bool = True, exclude_same_author: bool = False,
) -> DataFrame:
    """The middle band: eligible passages past the first `skip_top`, at most `pool`; pos counts eligible ones."""
    apart = [column for column, asked in (("book_id", exclude_same_book), ("author", exclude_same_author)) if asked]
    seeds, chunks = _only(seeds, chunks, "vec", *apart)

    def work(s: Block, c: Block):
        alike = [_same(s, c, column) for column in apart]
        ok = (lambda i, j: ~np.any([same(i, j) for same in alike], axis=0)) if alike else None
        return kept(s, c, Products(s, c), skip_top + pool, ok, min_sim, dedup_sim)

    return ranked(block_pairs(seeds, chunks, work, FOUND, best(skip_top + pool)), skip_top + pool).where(F.col("pos") > skip_top)


def mmr(sims: np.ndarray, vecs: np.ndarray, k: int, weight: float) -> list[tuple[int, float]]:
    """(row, score) by maximal marginal relevance; ties go to the earlier row."""
    gram, near, left, out = vecs @ vecs.T, None, np.ones(len(sims), bool), []
    while left.any() and len(out) < k:
        score = weight * sims - (0 if near is None else (1 - weight) * near)
        best = int(np.argmax(np.where(left, score, -np.inf)))
        out.append((best, float(score[best])))
        left[best] = False
        near = gram[best].copy() if near is None else np.maximum(near, gram[best])
    return out


def facility(sims: np.ndarray, vecs: np.ndarray, k: int, alpha: float = 3.0) -> list[tuple[int, float]]:
    """(row, gain) by facility location over the cosine matrix."""
    gram, covered, left, out = vecs @ vecs.T, np.zeros(len(sims)), np.ones(len(sims), bool), []
    while left.any() and len(out) < k:
        gains = np.maximum(gram - covered[:, None], 0).sum(axis=0)
        best = int(np.argmax(np.where(left, np.round(gains, 12), -np.inf)))
        out.append((best, float(gains[best])))
        left[best] = False
        covered = np.maximum(covered, gram[:, best])
    return out


def dpp(sims: np.ndarray, vecs: np.ndarray, k: int, alpha: float = 3.0, least: float = 1e-10) -> list[tuple[int, float]]:
    """(row, log gain) by greedy MAP of a determinantal point process with quality exp(alpha * similarity).

    The kernel is a Gram matrix, so conditional variances are squared lengths of residuals.
    """
    rest = np.exp(alpha * np.round(sims, 4))[:, None] * vecs
    left, out = np.ones(len(sims), bool), []
    while left.any() and len(out) < k:
        lengths = np.where(left, (rest * rest).sum(axis=1), -np.inf)
        best = int(np.argmax(lengths))
        if lengths[best] <= least:
            break
        out.append((best, float(np.log(lengths[best]))))
        left[best] = False
        axis = rest[best] / np.sqrt(lengths[best])
        rest = rest - np.outer(rest @ axis, axis)
    return out


def coverage(vecs: np.ndarray, picks: list[int]) -> np.ndarray:
    """For each pick, how many other rows have it as their nearest pick."""
    others = np.setdiff1d(np.arange(len(vecs)), picks)
    nearest = np.argmax(vecs[others] @ vecs[picks].T, axis=1) if len(others) else np.zeros(0, int)
    return np.bincount(nearest, minlength=len(picks))


#: Bytes of vectors that a task holds at a time, while it chooses among bands.
HELD_BYTES = 1 << 26


def _select(band: DataFrame, chunks: DataFrame, pick: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], extra: str = "") -> DataFrame:
    """Runs `pick(similarities, vectors)` on each seed's band in its order, whose size is bounded by its pool.

    It gives the rows chosen (`at`), their score and the columns of `extra`.  A few blocks of vectors are joined; many
    are written to files, from which a task of many seeds reads the vectors it needs, so that no vector is shuffled.
    """
    vecs = whole(chunks.select("id", "vec")).where(F.col("id").isNotNull())
    n = blocks_of(vecs)
    few = n * n <= FEW_PAIRS
    # A row a block.
    stand = [] if few else [tuple(r) for r in in_files(vecs, "c", n).orderBy("cb").collect()]
    names = ("seed_id", "id", "pos", "similarity")
    rows = band.join(vecs, "id").select(*names, "vec") if few else band.select(*names, F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
    schema = f"seed_id long, id long, pos int, similarity double, score double{extra}"
    columns = [c.split()[0] for c in extra.split(",") if c]

    def chosen(seed: np.ndarray, ids: np.ndarray, sims: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch | None:
        made = []
        cuts = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1], True])
        for low, high in zip(cuts, cuts[1:]):
            got = pick(sims[low:high], vecs[low:high])
            at = np.asarray(got["at"], int) + low
            made.append([seed[at], ids[at], np.arange(1, len(at) + 1, dtype=np.int32), sims[at], np.asarray(got["score"], float), *(got[c] for c in columns)])
        arrays = [np.concatenate(x) for x in zip(*made)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[*names, "score", *columns])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        seed, ids, sims = (table.column(c).to_numpy() for c in ("seed_id", "id", "similarity"))
        if few:
            yield chosen(seed, ids, sims, unpack(pa.StructArray.from_arrays([table.column("vec").chunk(0)], names=["vec"]))["vec"])
            return
        block, at = table.column("block").to_numpy(), {p[0]: p[1:] for p in stand}
        dim = read_block(*stand[0][1:])["vec"].shape[1]
        cuts = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1], True])
        room, first = max(1, HELD_BYTES // (8 * dim)), 0
        while first < len(cuts) - 1:
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + room, "right")) - 1)
            part = slice(cuts[first], cuts[last])
            held, known = np.zeros((cuts[last] - cuts[first], dim)), np.zeros(cuts[last] - cuts[first], bool)
            order = np.argsort(block[part], kind="stable")
            numbers, starts = np.unique(block[part][order], return_index=True)
            for number, mine in zip(numbers.tolist(), np.split(order, starts[1:])):
                if number in at:
                    # A block's rows are in the order of their ids.
                    found = read_block(*at[number])
                    place = np.minimum(np.searchsorted(found["id"], ids[part][mine]), len(found["id"]) - 1)
                    held[mine], known[mine] = found["vec"][place], found["id"][place] == ids[part][mine]
            if known.any():
                yield chosen(seed[part][known], ids[part][known], sims[part][known], held[known])
            first = last

    tasks = max(n, 2 * band.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "seed_id").sortWithinPartitions("seed_id", "pos").mapInArrow(run, schema)


def _picked(chosen: list[tuple[int, float]]) -> dict[str, np.ndarray]:
    return {"at": [c[0] for c in chosen], "score": [c[1] for c in chosen]}


def band(seeds: DataFrame, chunks: DataFrame, k: int = K, weight: float = MMR_LAMBDA, floor: float | None = None, **params) -> DataFrame:
    """The middle band, thinned to `k` by maximal marginal relevance."""
    pool = band_pool(noise_gate(seeds, chunks, floor), chunks, **params)
    return _select(pool, chunks, lambda sims, vecs: _picked(mmr(sims, vecs, k, weight)))


def spread(seeds: DataFrame, chunks: DataFrame, k: int = K, select: str = "dpp", weight: float = MMR_LAMBDA, **params) -> DataFrame:
    """A diverse set out of the band, whose rows compete in MMR order; `covers` counts the band around each pick."""
    if select not in ("dpp", "facility"):
        raise ValueError(f"unknown selection {select!r}")
    chooser = dpp if select == "dpp" else facility

    def pick(sims: np.ndarray, vecs: np.ndarray) -> dict[str, np.ndarray]:
        order = np.array([i for i, _ in mmr(sims, vecs, len(sims), weight)])
        vecs = vecs[order]
        picks = chooser(sims[order], vecs, k)
        at = [c[0] for c in picks]
        return {"at": order[at], "score": [c[1] for c in picks], "covers": coverage(vecs, at), "band_size": np.full(len(at), len(order), np.int32)}

    return _select(band_pool(seeds, chunks, **params), chunks, pick, ", covers long, band_size int")


def echo(seeds: DataFrame, chunks: DataFrame, k: int = K, gap: int = 12, min_sim: float = 0.30, weight: float = 0.6, pool: int = POOL) -> DataFrame:
    """Passages of the seed's own book, at least `gap` places away, thinned by maximal marginal relevance; with their heading, if passages have one."""
    places = Window.partitionBy("book_id").orderBy("id")
    placed = chunks.withColumn("place", F.row_number().over(places).cast("long"))
    asked = seeds.join(placed.select("id", "place"), "id", "left")

    def work(s: Block, c: Block):
        same = _same(s, c, "book_id")
        # A seed without a place, which is no passage, is far from none.
        here, there = s["place"].astype(float), c["place"].astype(float)
        return kept(s, c, Products(s, c), pool, lambda i, j: same(i, j) & ~(np.abs(here[i] - there[j]) < gap), min_sim, DEDUP_SIM)

    found = ranked(block_pairs(asked, placed, work, FOUND, best(pool)), pool)
    picked = _select(found, chunks, lambda sims, vecs: _picked(mmr(sims, vecs, k, weight)))
    place = lambda key, name: placed.select(F.col("id").alias(key), F.col("place").alias(name))
    away = F.abs(F.col("there") - F.col("here")).alias("distance")
    if "heading" in chunks.columns:
        picked = picked.join(chunks.select("id", "heading"), "id")
        return picked.join(place("seed_id", "here"), "seed_id").join(place("id", "there"), "id").select("seed_id", "id", "pos", "similarity", "score", away, "heading")
    return picked.join(place("seed_id", "here"), "seed_id").join(place("id", "there"), "id").select("seed_id", "id", "pos", "similarity", "score", away)


def walk(seeds: DataFrame, chunks: DataFrame, hops: int = 4, skip_top: int = SKIP_TOP, min_sim: float = MIN_SIM, revisit_books: bool = False) -> DataFrame:
    """Hop by hop to new books: at each, past the `skip_top` best eligible passages, the next one.

    One pass over the corpus a hop, for all seeds at once, whose state is written after each;
    similarity is to the original seed.  With `revisit_books` a hop without a new book goes to the best
    passage of another book seen before, not picked yet, that comes after `skip_top` new ones.
    """
    state = seeds.select("id", "vec", F.array("book_id").alias("books"), F.array().cast("array<long>").alias("picked"), F.col("vec").alias("origin"))
    out = None
    for hop in range(1, hops + 1):

        def work(s: Block, c: Block):
            if not revisit_books:
                seen = s["seen"]
                made = kept(s, c, Products(s, c), skip_top + 1, lambda i, j: ~np.any([_equal(seen[:, x], c["book_id"], i, j) for x in range(seen.shape[1])], axis=0), min_sim, DEDUP_SIM)
                return made | {"again": np.zeros(len(made["id"]), bool)}
            sims = s["vec"] @ c["vec"].T
            near = (sims >= min_sim) & (sims < DEDUP_SIM)
            keep, back = near.copy(), near.copy()
            # A block's books as numbers: a seed's few are looked up, not compared with each passage's.
            names, book = np.unique(c["book_id"].astype(str), return_inverse=True)
            number = {name: k for k, name in enumerate(names)}
            for r in range(len(sims)):
                gone = np.zeros(len(names), bool)
                gone[[number[b] for b in s["books"][r] if b in number]] = True
                seen = gone[book]
                keep[r] &= ~seen
                last = number.get(s["books"][r][-1], -1) if s["books"][r] else -1
                back[r] &= seen & (book != last) & ~np.isin(c["id"], s["picked"][r])
            # What goes back to seen books is told from all that come after, so nothing is left out by bounds then.
            fresh = kept({"id": s["id"]}, c, np.where(keep, sims, -np.inf), skip_top + 1)
            fresh["again"] = np.zeros(len(fresh["id"]), bool)
            # All that come after the skip_top-th new one may be the best of those left: their number is the chunk block's.
            old = kept({"id": s["id"]}, c, np.where(back, sims, -np.inf), sims.shape[1])
            old["again"] = np.ones(len(old["id"]), bool)
            return {n: np.concatenate([fresh[n], old[n]]) for n in fresh}

        # Books have no fixed number, so they travel as one string.
        asked = state.select("id", "vec", F.array_join("books", "\u0001").alias("books"), F.array_join(F.transform("picked", lambda x: x.cast("string")), ",").alias("picked"))

        def split(s: Block, c: Block, inner=work):
            if "seen" not in s:
                books = [b.split("\u0001") if b else [] for b in s["books"]]
                s["books"], s["picked"] = books, [[int(x) for x in p.split(",") if x] for p in s["picked"]]
                most = max(map(len, books), default=0) or 1
                # Filled up with what no book is called.
                s["seen"] = np.array([b + ["\u0001"] * (most - len(b)) for b in books], object).reshape(len(books), most)
            return inner(s, c)

        found = block_pairs(asked, chunks.select("id", "book_id", "vec"), split, f"{FOUND}, again boolean", None if revisit_books else best(skip_top + 1))
        step = ranked(found.where("not again"), skip_top + 1).drop("again")
        if revisit_books:
            found = stored(found, f"walk-found-{hop}")
            step = stored(ranked(found.where("not again"), skip_top + 1).drop("again"), f"walk-step-{hop}")
            last = step.where(F.col("pos") == skip_top).select("seed_id", F.col("similarity").alias("s"), F.col("id").alias("i")) if skip_top else None
            old = found.where("again").join(step.where(F.col("pos") == skip_top + 1).select("seed_id"), "seed_id", "left_anti")
            if last is not None:
                after = (F.col("similarity") < F.col("s")) | ((F.col("similarity") == F.col("s")) & (F.col("id") > F.col("i")))
                old = old.join(last, "seed_id").where(after).drop("s", "i")
            step = step.where(F.col("pos") == skip_top + 1).unionByName(ranked(old, 1).drop("again").withColumn("pos", F.lit(skip_top + 1)))
        step = step.where(F.col("pos") == skip_top + 1).select(F.col("seed_id"), F.col("id").alias("to"), F.col("similarity").alias("hop_similarity"))
        state = (
            state.join(step.withColumnRenamed("seed_id", "own"), F.col("id") == F.col("own"))
            .join(chunks.select(F.col("id").alias("to"), F.col("book_id").alias("to_book"), F.col("vec").alias("to_vec")), "to")
            .select(
                "id", F.col("to_vec").alias("vec"), F.array_append("books", F.col("to_book")).alias("books"),
                F.array_append("picked", F.col("to")).alias("picked"), "origin", "hop_similarity", "to",
            )
        )
        # Written, as it is used by the hop's rows and by the next hop.
        state = stored(state, f"walk-{hop}")
        similarity = F.aggregate(F.zip_with("origin", "vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        row = state.select(
            F.col("id").alias("seed_id"), F.col("to").alias("id"), F.lit(hop).alias("hop"), similarity.alias("similarity"), "hop_similarity",
            F.when(F.size("picked") > 1, F.element_at("picked", -2)).otherwise(F.col("id")).alias("from_id"),
        )
        out = row if out is None else out.unionByName(row)
        state = state.select("id", "vec", "books", "picked", "origin")
    return out


def marks_recall(seeds: DataFrame, marks: DataFrame, k: int = K, min_sim: float = 0.25) -> DataFrame:
    """Passages whose reader annotations are near the seed: each by its best usable mark (ties to the earlier)."""
    usable = marks.where(~F.col("orphaned") & ((F.col("quote") != "") | (F.col("note") != "")))
    by_target = usable.select(F.col("mark_id").alias("id"), "target", "vec")

    def work(s: Block, c: Block):
        # Marks of a target stand together, the earlier first: its best one counts, and of targets the best k.
        order = np.lexsort((c["id"], c["target"]))
        c = {n: v[order] for n, v in c.items()}
        targets, starts = np.unique(c["target"], return_index=True)
        own = targets if len(targets) < len(order) else None
        i, j, value = best_of(Products(s, c, starts=None if own is None else starts), targets, k, s, lambda i, j: s["id"][i] != targets[j], min_sim)
        at = starts[j]
        if own is not None:
            stops = np.append(starts[1:], len(order))[j]
            at = np.array([low + int(np.argmax(np.einsum("d,nd->n", s["vec"][r], c["vec"][low:high]))) for r, low, high in zip(i, at, stops)], np.int64)
        return {"seed_id": s["id"][i], "mark_id": c["id"][at], "id": targets[j], "similarity": value}

    # Marks are dealt by target, so that one block has all of a target's.
    found = block_pairs(seeds.select("id", "vec"), by_target, work, "seed_id long, mark_id long, id long, similarity double", best(k), F.xxhash64("target"))
    nearest = Window.partitionBy("seed_id", "id").orderBy(F.desc("similarity"), "mark_id")
    one = found.withColumn("r", F.row_number().over(nearest)).where("r = 1").drop("r")
    return ranked(one, k)


def structural(seeds: DataFrame, chunks: DataFrame, k: int = K, min_sim: float = 0.20) -> DataFrame:
    """Nearest in a second vector space (svec) across books; `gap` is how much nearer than in the first."""
    seeds, chunks = _only(seeds, chunks, "book_id", "vec", "svec")

    def work(s: Block, c: Block):
        other, same = _other(s, c), _same(s, c, "book_id")
        i, j, value = best_of(Products(s, c, "svec"), c["id"], k, s, lambda i, j: other(i, j) & ~same(i, j), min_sim, DEDUP_SIM)
        surface = np.einsum("nd,nd->n", s["vec"][i], c["vec"][j])
        return {"seed_id": s["id"][i], "id": c["id"][j], "similarity": surface, "structural": value}

    found = block_pairs(seeds, chunks, work, "seed_id long, id long, similarity double, structural double", best(k, "structural"))
    return ranked(found, k, "structural").withColumn("gap", F.col("structural") - F.col("similarity"))


#: Scores that differ by no more are one score; passages (so many that a byte counts them) and seeds that are counted together.
SAME_SCORE, COUNTED = 1e-12, (255, 1024)
#: Passages left open that are looked at together.
MOST_OPEN = 1 << 16


def _cuts(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least whole numbers of what is surely over `high`, and of what may not be under `low`, where numbers lose their fractions."""
    end = np.iinfo(np.int16).max
    # Numbers under one lose theirs upwards.
    over = np.floor(high) + np.where(high < 0, 2, 1)
    return tuple(np.nan_to_num(np.clip(x, -end, end), nan=end).astype(np.int16) for x in (over, np.trunc(low)))


def before(sims: np.ndarray | Products, ids: np.ndarray, scores: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """For each row and pick (its similarity and id; NaN for none) the number of passages before it: those nearer, and of equals those of smaller id.

    Single precision tells most; only passages that it can't tell from the pick are multiplied in double.
    """
    sims = products(sims)
    (n, width), apart = sims.shape, SAME_SCORE + sims.slack
    out = np.zeros(scores.shape[::-1], np.int64)
    lowest = np.where(np.isnan(scores), np.inf, scores).min(axis=1, initial=np.inf) - apart
    # Half the bytes are compared twice as fast.
    sims, scale = (sims.scaled(), float(np.float32(sims.scale))) if sims.scale else (sims, 0.0)
    if scale:
        high, least = _cuts((scores + apart) * scale, (scores - apart) * scale)
    held, sparse, bounds = [], True, None

    def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        gap = sims.exact(i, j)[:, None] - scores[i]
        return (gap > SAME_SCORE) | ((np.abs(gap) <= SAME_SCORE) & (ids[j][:, None] < picked[i]))

    def settle() -> None:
        """Counts the passages that single precision left open for a pick and that are before it."""
        i, j, value = (np.concatenate(x) for x in zip(*held))
        hit = first(i, j) & ~(value[:, None] >= bounds[0].T[i])
        for k in range(len(out)):
            out[k] += np.bincount(i[hit[:, k]], minlength=n)
        held.clear()

    for left, low, part in tiles(sims, COUNTED):
        own = slice(left, left + part.shape[1])
        if bounds is None:
            if scale:
                lowest, bounds = lowest * scale, [x.T.copy() for x in (high, least)]
            else:
                bounds = [np.nextafter((scores + add).astype(part.dtype), part.dtype.type(end)).T.copy() for add, end in ((apart, np.inf), (-apart, -np.inf))]
            lowest = np.nextafter(lowest.astype(part.dtype), part.dtype.type(-np.inf))
            room = np.empty((4, part.size), np.int16)
        # Where picks are near the top, few passages reach any; rows without such picks are not asked again.
        sparse = sparse or low == 0
        reach = part >= lowest[own] if sparse else None
        sparse = sparse and np.count_nonzero(reach) * 32 <= part.size
        if sparse:
            j, i = np.divmod(places(reach), part.shape[1])
            gap = (part[j, i].astype(float) / scale if scale else part[j, i])[:, None] - scores[i + left]
            hit = gap > apart
            near = np.flatnonzero((~hit & (gap >= -apart)).any(axis=1))
            hit[near] |= (gap[near] >= -apart) & first(i[near] + left, j[near] + low)
            for k in range(len(out)):
                out[k, own] += np.bincount(i[hit[:, k]], minlength=part.shape[1])
            continue
        above, near, open_ = (x.view(bool)[: part.size].reshape(part.shape) for x in room[1:])
        if scale:
            whole_ = room[0][: part.size].reshape(part.shape)
            np.copyto(whole_, part, casting="unsafe")
            part = whole_
        open_[:] = False
        for k, (most, fewest) in enumerate(zip(*bounds)):
            np.greater_equal(part, most[own], out=above)
            out[k, own] += np.add.reduce(above.view(np.uint8), axis=0, dtype=np.uint8)
            np.greater_equal(part, fewest[own], out=near)
            np.not_equal(near, above, out=near)
            np.logical_or(open_, near, out=open_)
        j, i = np.divmod(places(open_), part.shape[1])
        held.append((i + left, j + low, part[j, i]))
        if sum(len(x[0]) for x in held) > MOST_OPEN:
            settle()
    if held:
        settle()
    return out.T


def corpus_rank(picks: DataFrame, seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """`picks` with rank (0-based place among all passages by similarity, ties by id) and corpus_size.

    Each block counts, for every pick, its passages before it; counts are summed.
    """
    picks = stored(picks, "picks")
    listed = picks.groupBy("seed_id").agg(F.sort_array(F.collect_list(F.struct("similarity", "id"))).alias("picks"))
    # Lists of one length travel as a matrix: shorter ones are filled up.
    listed = stored(listed, "ranked-picks")
    most = listed.agg(F.max(F.size("picks")).alias("n")).first()["n"] or 0
    if not most:
        return picks.withColumns({"rank": F.lit(None).cast("long"), "corpus_size": F.lit(chunks.count())})
    filled = lambda field, none: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.coalesce(F.get("picks", i)[field], F.lit(none)))
    lists = listed.select("seed_id", filled("similarity", float("nan")).alias("reached"), filled("id", -1).alias("picked"), F.size("picks").alias("held"))
    asked = seeds.select("id", "vec").join(lists, F.col("id") == F.col("seed_id")).select("id", "vec", "reached", "picked", "held")

    def work(s: Block, c: Block):
        own, k = np.nonzero(np.arange(s["reached"].shape[1])[None, :] < s["held"][:, None])
        return {"seed_id": s["id"][own], "id": s["picked"][own, k].astype(np.int64), "n": before(Products(s, c), c["id"], s["reached"], s["picked"])[own, k]}

    counted = block_pairs(asked, chunks.select("id", "vec"), work, "seed_id long, id long, n long", sums("n"))
    ranks = counted.groupBy("seed_id", "id").agg(F.sum("n").alias("rank"))
    return picks.join(ranks, ["seed_id", "id"]).withColumn("corpus_size", F.lit(chunks.count()))


PATH_WEIGHTS = {"marks": 1.5, "structural": 1.2, "concept": 1.1, "band": 1.0}


def fuse(paths: dict[str, DataFrame], seeds: DataFrame, chunks: DataFrame, k: int = K, rank_k: int = 10) -> DataFrame:
    """Weighted reciprocal fusion of paths (seed_id, id, pos): relevance times surprise, then spread to `k`."""
    every = None
    for name, picks in paths.items():
        part = picks.select("seed_id", "id", F.lit(name).alias("path"), (F.lit(PATH_WEIGHTS[name]) / (rank_k + F.col("pos") - 1)).alias("contrib"))
        every = part if every is None else every.unionByName(part)
    merged = every.groupBy("seed_id", "id").agg(
        F.sum("contrib").alias("relevance"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("contrib")).alias("c"), "path"))), lambda x: x["path"]).alias("paths"),
    )
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("book_id").alias(f"{p}_book"), F.col("vec").alias(f"{p}_vec"))
    rows = merged.join(side(seeds, "s"), F.col("seed_id") == F.col("s_id")).join(side(chunks, "c"), F.col("id") == F.col("c_id"))
    similarity = F.aggregate(F.zip_with("s_vec", "c_vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("similarity", similarity).where((F.col("similarity") < DEDUP_SIM) & (F.col("similarity") >= MIN_SIM))
    crossing = (F.col("s_book").isNotNull() & (F.col("s_book") != F.col("c_book"))).cast("double")
    rows = rows.withColumn("score", F.col("relevance") * (1 + 0.25 * crossing + 0.5 * (1 - F.col("similarity"))))
    top = Window.partitionBy("seed_id").orderBy(F.desc("score"), "id")
    rows = rows.select("seed_id", "id", "similarity", "score", F.array_join("paths", "+").alias("paths"))
    rows = stored(rows.withColumn("pos", F.row_number().over(top)).where(F.col("pos") <= 3 * k), "fused-rows")

    def thin(scores: np.ndarray, vecs: np.ndarray) -> dict[str, np.ndarray]:
        if len(scores) <= k:
            return {"at": range(len(scores)), "score": scores}
        rest, q = vecs[1:], scores[1:]
        gram = rest @ rest.T * (q / q.max())[None, :]
        covered, left, chosen = np.zeros(len(rest)), np.ones(len(rest), bool), [0]
        for _ in range(k - 1):
            gains = np.where(left, np.maximum(gram - covered[:, None], 0).sum(axis=0), -np.inf)
            best = int(np.argmax(gains))
            left[best] = False
            covered = np.maximum(covered, gram[:, best])
            chosen.append(best + 1)
        at = sorted(chosen)
        return {"at": at, "score": scores[at]}

    # The score stands for the similarity, as it is what rows are thinned by.
    picked = _select(rows.select("seed_id", "id", "pos", F.col("score").alias("similarity")), chunks, thin).select("seed_id", "id", "pos", "score")
    return picked.join(rows.drop("pos", "score"), ["seed_id", "id"]).select("seed_id", "id", "pos", "similarity", "score", "paths")


def intra_list_diversity(picks: DataFrame, chunks: DataFrame) -> DataFrame:
    """seed_id, ild: one minus the mean cosine of different picks, null for fewer than two.

    The mean over pairs comes from the length of the picks' vector sum, without pairs of rows; a task has all picks of a seed.
    """

    def pick(sims: np.ndarray, vecs: np.ndarray) -> dict[str, np.ndarray]:
        n, total = len(vecs), vecs.sum(axis=0)
        return {"at": [0], "score": [1 - (total @ total - np.einsum("nd,nd->", vecs, vecs)) / (n * (n - 1)) if n > 1 else np.nan]}

    own = Window.partitionBy("seed_id").orderBy("id")
    listed = picks.select("seed_id", "id", F.row_number().over(own).alias("pos"), F.lit(0.0).alias("similarity"))
    return _select(listed, chunks, pick).select("seed_id", F.when(~F.isnan("score"), F.col("score")).alias("ild"))
