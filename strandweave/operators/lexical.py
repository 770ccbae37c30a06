"""BM25 over an inverted index kept as tables, and its fusion with a dense ranking.

Scores are rounded to six places before they are ranked, so that the order of a sum never decides
a tie; ties go to the smaller id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.text import STOP_WORDS, lexical_tokens, lexical_words
from strandweave.operators.blocked import BLOCK_ROWS, LEAST, Block, best, best_places, block_pairs, places
from strandweave.shared import open_folder, shared_folder, stored

K1, B, QUERY_TERMS = 1.5, 0.75, 12
#: Parts of a score are counted in steps of 1 / STEPS, of which there are at most (K1 + 1) * STEPS; what rounding may add.
STEPS, SLACK = 32, 1e-5
#: Queries that touch no more postings are scored outright; terms asked for are broadcast up to so many rows.
FEW_POSTINGS, BROADCAST_ROWS = 1 << 24, 1 << 16
#: Where all passages are seeds: seeds of a block, seeds scored at a time.
SEED_ROWS, SCORED_ROWS = 16_384, 64
#: Terms that more than one passage in so many of a block has are rows of a matrix, at most so many; pairs that are computed in double precision together.
FREQUENT, MATRIX_ROWS, PAIRS = 50, 8192, 1 << 16
#: The commonest terms, which are broadcast; words that are counted together.
COMMON_TERMS, WORDS = 1 << 16, 1 << 20
#: The code of a row that tells a passage's book; bits of a number that tells which terms a pick shares.
BOOK, BITS = -1, 62


class LexicalIndex:
    """postings (id, term, tf, dl, part), stored, and df (term, df, idf, most) of passages (id, text).

    `part` is what a term adds to a passage's score, before its idf, and `most` a term's largest part: a bound that tells which of a
    query's terms can bring a passage among the best.  The corpus is tokenized once.  With `asking` (id) only those passages'
    distinctive terms can be asked for.
    """

    def __init__(self, chunks: DataFrame, asking: DataFrame | None = None):
        # Texts are dealt by id, as they are smaller than their terms; counting a passage's terms then needs no shuffle.
        texts = chunks.select("id", "text").where("text is not null").repartition("id")
        own = F.lit(True)
        if asking is not None:
            texts, own = texts.join(asking.select("id").distinct().withColumn("own", F.lit(True)), "id", "left"), F.coalesce("own", F.lit(False))
        words = texts.select("id", own.alias("own"), "text").sortWithinPartitions("id").select("id", "own", lexical_words(F.col("text")).alias("words"))
        spark, schema = chunks.sparkSession, f"id {chunks.schema['id'].dataType.simpleString()}, own boolean, term string, tf long, dl int"
        # A task writes its postings itself, as their terms are numbered there already; what a task that failed has written isn't read.
        files = [(r["path"], r["words"]) for r in words.mapInArrow(_written(shared_folder(spark, "postings")), "path string, words long").collect()]
        rows = spark.read.schema(schema).parquet(*(path for path, _ in files)) if files else spark.createDataFrame([], schema)
        n, total = chunks.count(), sum(words for _, words in files)
        avgdl = total / max(1, n)
        tf = F.col("tf")
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
        self.n = n
        self.postings = rows.withColumn("part", part)
        df = self.postings.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most"))
        self.df = stored(df.withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))), "terms")
        sizes = self.df.groupBy(F.floor(F.log2("df")).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()
        self.common_from, held = 1 << (sizes[0]["size"] + 1 if sizes else 0), 0
        for size, count in sizes:
            held += count
            if held > COMMON_TERMS:
                break
            self.common_from = 1 << size
        #: Terms of `common_from` passages or more.
        self.common = self.df.where(F.col("df") >= self.common_from)

    def distinctive_terms(self, k: int = QUERY_TERMS) -> DataFrame:
        """id, term, weight, pos: each passage's terms of highest tf times idf (six places; ties alphabetical)."""
        w = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
        # Rarer terms' idf lies between two: of those only the ones that may be among a passage's `k` need their own.
        known = self.postings.where("own").join(F.broadcast(self.common.select("term", "idf")), "term", "left").select("id", "term", "tf", "idf")
        idf = lambda df: math.log1p((self.n - df + 0.5) / (df + 0.5))
        near = stored(known.mapInArrow(_heaviest(k, idf(max(1, self.common_from - 1)), idf(1)), known.schema), "heaviest")
        rare = near.where("idf is null").drop("idf").hint("merge").join(self.df.where(F.col("df") < self.common_from).select("term", "idf"), "term")
        weighed = near.where("idf is not null").unionByName(rare).select("id", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("weight"))
        return weighed.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)

    def scores(self, queries: DataFrame, best: int | None = None) -> DataFrame:
        """seed_id, id, score, n_terms, terms for queries (seed_id, term), each term once.

        With `best` only passages that can be among a query's `best`, and all that are: one term's `best` largest
        parts already are that many passages of at least so high a score.  Terms whose bounds together stay below it bring no passage
        in by themselves; they are looked up for passages that the others brought in, and whose bound is high enough.
        """
        asked = queries.select("seed_id", "term").distinct().join(self.df, "term").select("seed_id", "term", "idf", "df", (F.col("idf") * F.col("most")).alias("bound"))
        asked = stored(asked, "asked")
        size = asked.agg(F.count("*").alias("rows"), F.sum("df").alias("postings")).first()
        value = (F.col("idf") * F.col("part")).alias("value")

        def with_postings(terms: DataFrame, keys: list[str]) -> DataFrame:
            # Postings outgrow what their files' size tells the planner: they are never broadcast.
            return F.broadcast(terms).join(self.postings, keys) if size["rows"] <= BROADCAST_ROWS and keys == ["term"] else terms.join(self.postings.hint("merge"), keys)

        whole = (F.sum("value").alias("value"), F.count("*").alias("n_terms"), F.array_sort(F.collect_list("term")).alias("terms"))
        if best is None or (size["postings"] or 0) <= FEW_POSTINGS:
            found = with_postings(asked.select("seed_id", "term", "idf"), ["term"]).select("seed_id", "id", "term", value).groupBy("seed_id", "id").agg(*whole)
            return found.select("seed_id", "id", F.round("value", 6).alias("score"), "n_terms", "terms").where("score > 0")
        # Parts of the terms asked for, counted by size: the largest size that `best` of them have at least.
        part_size = F.floor(F.col("part") * STEPS).cast("int").alias("size")
        sized = with_postings(asked.select("term").distinct(), ["term"]).groupBy("term", part_size).agg(F.count("*").alias("c"))
        held = sized.groupBy("term").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "c"))).alias("held"))
        asked = asked.join(held, "term")
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("size"))
        upto = F.aggregate("held", start, lambda s, x: F.when(s["n"] >= best, s).otherwise(F.struct((s["n"] + x["c"]).alias("n"), (-x["less"]).alias("size"))))
        sure = F.when(upto["n"] >= best, F.col("idf") * upto["size"] / STEPS).otherwise(F.lit(0.0))
        own, rising = Window.partitionBy("seed_id"), Window.partitionBy("seed_id").orderBy("bound", "term")
        asked = asked.withColumn("sure", sure).withColumns({"least": F.max("sure").over(own) - SLACK, "low": F.sum("bound").over(rising)}).withColumn("needed", F.col("low") >= F.col("least"))
        asked = stored(asked.withColumn("rest", F.sum(F.when(~F.col("needed"), F.col("bound")).otherwise(0.0)).over(own)).drop("held"), "asked-bounds")
        brought = with_postings(asked.where("needed"), ["term"]).select("seed_id", "id", "term", "rest", "least", value)
        found = brought.groupBy("seed_id", "id").agg(*whole, F.first("rest").alias("rest"), F.first("least").alias("least"))
        found = found.where(F.col("value") + F.col("rest") >= F.col("least")).select("seed_id", "id", "value", "terms")
        others = asked.where(~F.col("needed"))
        if not others.isEmpty():
            found = stored(found, "brought")
            looked_up = with_postings(found.select("seed_id", "id").join(others.select("seed_id", "term", "idf"), "seed_id"), ["id", "term"])
            both = found.unionByName(looked_up.select("seed_id", "id", value, F.array("term").alias("terms")))
            found = both.groupBy("seed_id", "id").agg(F.sum("value").alias("value"), F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"))
        return found.select("seed_id", "id", F.round("value", 6).alias("score"), F.size("terms").cast("long").alias("n_terms"), "terms").where("score > 0")


    def passage_picks(self, queries: DataFrame, k: int, books: DataFrame | None = None) -> DataFrame:
        """seed_id, id, score, n_terms, terms: the `k` best passages (ties to the smaller id) for queries (seed_id, term) of passages.

        A seed is the passage of its id, and left out; with `books` (id, book_id) so is its whole book.  Blocks of
        postings meet blocks of seeds in files, and a task keeps the best of its seeds: no pair is a row before it is a pick.
        """
        place = (F.row_number().over(Window.partitionBy("seed_id").orderBy("term")) - 1).cast("int")
        asked = stored(queries.select("seed_id", "term").distinct().withColumn("place", place), "asked")
        terms = asked.select("term").distinct().join(self.df.where("df > 1"), "term").select("term", "df", "idf", F.monotonically_increasing_id().alias("code"))
        # A term of one passage brings only the seed itself.
        terms = stored(terms, "asked-terms")
        seeds = asked.join(terms, "term").select(F.col("seed_id").alias("id"), "code", "idf", "place")
        # Most postings are of the commonest terms: only the others' travel to their terms.
        common = terms.where(F.col("df") >= self.common_from)
        left = self.postings.join(F.broadcast(common.select("term", "code")), "term", "left").select("id", "term", "part", "code")
        rare = terms.where(F.col("df") < self.common_from).select("term", F.col("code").alias("own_code"))
        brought = self.postings.join(F.broadcast(self.common.select("term")), "term", "left_anti").hint("merge").join(rare, "term").select(F.col("own_code").alias("id"), F.col("id").alias("doc"), "part")
        parts = left.where("code is not null").select(F.col("code").alias("id"), F.col("id").alias("doc"), "part").unionByName(brought)
        if books is not None:
            number = stored(books.where("book_id is not null").select("book_id").distinct().withColumn("book", F.monotonically_increasing_id()), "book-numbers")
            of = stored(books.join(number, "book_id").select(F.col("id").alias("own"), "book"), "books-of")
            seeds = seeds.join(of, F.col("id") == F.col("own")).drop("own")
            # A passage's book is a row of its block, and does not travel with its postings.
            parts = parts.unionByName(of.select(F.lit(BOOK).alias("id"), F.col("own").alias("doc"), F.col("book").cast("double").alias("part")))
        blocks = (max(1, -(-asked.select("seed_id").distinct().count() // SEED_ROWS)), max(1, -(-self.n // BLOCK_ROWS)))
        longest = asked.agg(F.max("place")).first()[0] or 0
        words = [f"hits{i}" for i in range(longest // BITS + 1)]
        # By what share a sum of so many positive numbers in single precision may be wrong, twice over.
        share = 1 - (longest + 4) * 2.0**-22
        schema = ", ".join(["seed_id long", "id long", "score double", *(f"{w} long" for w in words)])
        found = block_pairs(seeds, parts, _score_block(k, words, books is not None, share, SCORED_ROWS, FREQUENT), schema, best(k, "score"), F.xxhash64("doc"), blocks, _by_code)
        w = Window.partitionBy("seed_id").orderBy(F.desc("score"), "id")
        found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
        listed = asked.groupBy("seed_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("listed"))
        hit = lambda i: F.getbit(F.get(F.array(*words), F.floor(i / BITS).cast("int")), i % BITS) == 1
        named = F.array_sort(F.filter("listed", lambda x, i: hit(i)))
        return found.join(listed, "seed_id").select("seed_id", "id", F.round("score", 6).alias("score"), F.size(named).cast("long").alias("n_terms"), named.alias("terms"))


def _term_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, own, term, tf, dl of rows (id, own, words) in the order of ids; rows of one id are one passage.

    Words are told from terms once for each distinct one of a piece.
    """
    stop = pa.array(STOP_WORDS)

    def counted(ids: pa.Array, own: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
        known = ids.dictionary_encode()
        doc = known.indices.to_numpy()
        found = words.flatten().dictionary_encode()
        terms, code = found.dictionary, found.indices.to_numpy()
        left_out = pc.or_(pc.or_(pc.less(pc.utf8_length(terms), 2), pc.match_substring_regex(terms, "^[0-9]+$")), pc.is_in(terms, stop))
        good = ~left_out.to_numpy(zero_copy_only=False)[code]
        of = np.repeat(doc, words.value_lengths().to_numpy()).astype(np.int64)[good]
        long = np.bincount(of, minlength=len(known.dictionary)).astype(np.int32)
        key = of * max(1, len(terms)) + code[good]
        key.sort()
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        of, term = np.divmod(key[starts], max(1, len(terms)))
        first = own.take(pa.array(np.searchsorted(doc, of)))
        arrays = [known.dictionary.take(pa.array(of)), first, pa.DictionaryArray.from_arrays(term.astype(np.int32), terms), pa.array(np.diff(np.append(starts, len(key)))), pa.array(long[of])]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "own", "term", "tf", "dl"])

    held = None
    for part in parts:
        rows = pa.Table.from_batches([part])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        if not len(rows):
            continue
        columns = [c.chunk(0) for c in rows.columns]
        # Whole passages up to so many words, one at least; the last one may go on in the next rows.
        firsts = np.flatnonzero(np.diff(columns[0].dictionary_encode().indices.to_numpy())) + 1
        at, upto = 0, np.cumsum(columns[2].value_lengths().to_numpy())
        while len(firsts) and at < firsts[-1]:
            ends = firsts[firsts > at]
            most = np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS, "right")
            end = int(ends[max(0, np.searchsorted(ends, most, "right") - 1)])
            yield counted(*(c[at:end] for c in columns))
            at = end
        held = rows.slice(at)
    if held is not None:
        yield counted(*(c.chunk(0) for c in held.columns))


def _written(folder: str):
    """Writes the postings of rows (id, own, words) to one file, and tells its path and how many words it counts."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, words, uri = None, 0, f"{folder}/{uuid.uuid4().hex}.parquet"
        for part in _term_counts(parts):
            if out is None:
                fs, path = open_folder(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = pq.ParquetWriter(path, part.schema, filesystem=fs, store_schema=False)
            out.write_batch(part)
            words += pc.sum(part.column("tf")).as_py() or 0
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "words": [words]})

    return write


def _heaviest(k: int, least: float, most: float):
    """Keeps the rows (id, term, tf, idf) that may be among the `k` of highest tf times idf of their id; a null idf lies between `least` and `most`."""

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tf, idf = part.column("tf").to_numpy(), part.column("idf").to_numpy(zero_copy_only=False)
            low, high = (tf * np.where(np.isnan(idf), x, idf) for x in (least, most))
            doc = part.column("id").dictionary_encode().indices.to_numpy()
            at, place = best_places(doc, low, np.zeros(len(doc), np.int8), k)
            bound = np.full(int(doc.max(initial=-1)) + 1, -np.inf)
            bound[doc[at[place == k - 1]]] = low[at[place == k - 1]]
            yield part.filter(pa.array(high >= bound[doc] - 1e-5))

    return keep


def _by_code(postings: pa.Table) -> pa.Table:
    """A block of postings (id: code, doc, part) in the order of codes and passages, with each passage's place in the block."""
    code, doc = postings["id"].to_numpy(), postings["doc"].to_numpy()
    place = np.unique(doc, return_inverse=True)[1].astype(np.int32)
    return postings.append_column("place", pa.array(place)).take(pa.array(np.lexsort((place, code))))


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) of every place in ranges of `size` from `first`."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + np.repeat(first - np.cumsum(size) + size, size)


class _Postings:
    """A block of postings met by a block of seeds (id, code, idf, place, in the order of ids): which terms both have, and scores of pairs."""

    def __init__(self, s: Block, c: Block, by_book: bool):
        if "rows" not in s:
            s["rows"] = np.unique(s["id"], return_index=True)
            s["codes"] = np.unique(s["code"], return_index=True, return_inverse=True)
        self.s, (self.ids, self.first) = s, s["rows"]
        self.n_terms = np.diff(np.append(self.first, len(s["id"])))
        place = c["place"]
        self.width = int(place.max()) + 1 if len(place) else 0
        self.docs, self.books = np.zeros(self.width, np.int64), None
        self.docs[place] = c["doc"]
        if by_book:
            own = c["id"] == BOOK
            self.books = np.full(self.width, -1, np.int64)
            self.books[place[own]] = c["part"][own].astype(np.int64)
        self.place, self.part = place, c["part"]
        starts = np.flatnonzero(np.diff(c["id"], prepend=BOOK - 1))
        codes, sizes = c["id"][starts], np.diff(np.append(starts, len(place)))
        most = np.maximum.reduceat(self.part, starts) if len(starts) else np.zeros(0)
        #: Postings by term and passage, in order.
        self.keys = np.repeat(np.arange(len(codes)), sizes) * self.width + place
        # Of each distinct term of the seeds: its place among the block's terms, its postings and the most that one adds.
        own, at, self.term = s["codes"]
        spot = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        there = codes[spot] == own if len(codes) else np.zeros(len(own), bool)
        self.spot, self.idf = np.where(there, spot, -1), s["idf"][at]
        self.size = np.where(there, sizes[spot], 0) if len(codes) else np.zeros(len(own), int)
        self.start = np.where(there, starts[spot], 0) if len(codes) else self.size
        self.most = np.where(there, most[spot], 0.0) * self.idf if len(codes) else np.zeros(len(own))

    def allowed(self, row: np.ndarray, j: np.ndarray) -> np.ndarray:
        other = self.ids[row] != self.docs[j]
        if self.books is None:
            return other
        return other & (self.books[j] >= 0) & (self.s["book"][self.first[row]] != self.books[j])

    def exact(self, row: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of pairs to six places, and (pair, place of the term) of the terms that each shares."""
        pair, entry = _ranges(self.first[row], self.n_terms[row])
        term = self.term[entry]
        good = self.spot[term] >= 0
        pair, entry, term = pair[good], entry[good], term[good]
        wanted = self.spot[term] * self.width + j[pair]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted if len(at) else np.zeros(0, bool)
        pair, entry, term, at = pair[hit], entry[hit], term[hit], at[hit]
        score = np.bincount(pair, self.idf[term] * self.part[at], len(row))
        # Halves go up, as in SQL.
        return np.floor(score * 1e6 + 0.5) / 1e6, pair, self.s["place"][entry]


def _score_block(k: int, words: list[str], by_book: bool, share: float, step: int, part_of: int):
    """The `k` best scores of a block of seeds in a block of postings, as `_by_code` makes it.

    A seed's terms of many passages in the block are added up as rows of a matrix in single precision, `step` seeds at a time; the other
    terms' postings one by one.  Seeds whose frequent terms together don't reach what the seed has got are looked at only where
    they have another term.  All that may be among the best is then computed in double precision.
    """

    def work(s: Block, c: Block) -> dict[str, np.ndarray]:
        b, made = _Postings(s, c, by_book), []
        n, width = len(b.ids), b.width
        row = np.repeat(np.arange(n), b.n_terms)
        least = s[LEAST][b.first] if LEAST in s else np.full(n, -np.inf)
        # Sums of positive numbers are wrong by a share; least scores are rounded to six places.
        floor = (np.maximum(least, 1e-6) - 6e-7) * share

        def choose(i: np.ndarray, j: np.ndarray) -> None:
            good = b.allowed(i, j)
            i, j = i[good], j[good]
            for low in range(0, len(i), PAIRS):
                a, d = i[low : low + PAIRS], j[low : low + PAIRS]
                score, pair, hits = b.exact(a, d)
                good = (score > 5e-7) & (score >= least[a])
                at, _ = best_places(a, np.where(good, score, -np.inf), b.docs[d], k)
                at = at[good[at]]
                bits = np.zeros((len(words), len(a)), np.int64)
                np.bitwise_or.at(bits, (hits // BITS, pair), np.int64(1) << (hits % BITS))
                made.append((b.ids[a[at]], b.docs[d[at]], score[at], *(x[at] for x in bits)))

        frequent = b.size > width // part_of
        if np.count_nonzero(frequent) > MATRIX_ROWS:
            frequent = b.size > np.partition(b.size, -MATRIX_ROWS)[-MATRIX_ROWS]
        reach = np.bincount(row, b.most[b.term], n)
        many = np.bincount(row, np.where(frequent, b.most, 0.0)[b.term], n)
        alive = reach >= floor
        heavy = alive & (many >= floor)
        # Postings of the other terms.
        entry = np.flatnonzero(alive[row] & (b.size > 0)[b.term] & ~frequent[b.term])
        which, posting = _ranges(b.start[b.term[entry]], b.size[b.term[entry]])
        own, j = row[entry][which], b.place[posting]
        value = b.idf[b.term[entry]][which] * b.part[posting]
        light = ~heavy[own]
        cells, cell = np.unique(own[light] * width + j[light], return_inverse=True)
        i = cells // max(1, width)
        near = np.bincount(cell, value[light], len(cells)) + many[i] >= floor[i]
        choose(i[near], cells[near] % max(1, width))
        # Seeds that frequent terms may bring passages, those with like numbers of such terms together.
        rows = np.flatnonzero(heavy)
        if len(rows):
            names = np.cumsum(frequent) - 1
            listed = np.flatnonzero(frequent)
            matrix = np.zeros((len(listed) + 1, width), np.float32)
            which, posting = _ranges(b.start[listed], b.size[listed])
            matrix[which, b.place[posting]] = b.idf[listed][which] * b.part[posting]
            entry = np.flatnonzero(heavy[row] & frequent[b.term])
            held = np.bincount(row[entry], minlength=n)
            rows = rows[np.argsort(held[rows], kind="stable")]
            order = np.zeros(n, int)
            order[rows] = np.arange(len(rows))
            at = order[row[entry]]
            by = np.argsort(at, kind="stable")
            at, name = at[by], names[b.term[entry[by]]]
            ends = np.cumsum(held[rows])
            column = np.arange(len(at)) - (ends - held[rows])[at]
            places_of = np.full((len(rows), int(held[rows[-1]])), len(listed))
            places_of[at, column] = name
            own, j, value = order[own[~light]], j[~light], value[~light].astype(np.float32)
            by = np.argsort(own, kind="stable")
            own, j, value = own[by], j[by], value[by]
            room = np.empty((step, width), np.float32)
            for low in range(0, len(rows), step):
                mine = rows[low : low + step]
                wide = int(held[mine[-1]])
                score = matrix[places_of[low : low + step, 0]]
                for x in range(1, wide):
                    score += np.take(matrix, places_of[low : low + step, x], axis=0, out=room[: len(mine)], mode="clip")
                first, last = np.searchsorted(own, (low, low + len(mine)))
                np.add.at(score.reshape(-1), (own[first:last] - low) * width + j[first:last], value[first:last])
                least_of = floor[mine].astype(np.float32)
                found = places(score >= least_of[:, None])
                if len(found) > (2 * k + 64) * len(mine) and k < width:
                    # A first block: what as many other passages reach is a floor.
                    score[~b.allowed(mine[:, None], np.arange(width)[None, :])] = 0.0
                    kth = np.partition(score, width - k, axis=1)[:, width - k].astype(float)
                    least_of = np.maximum(least_of, ((kth * share - 1e-6) * share).astype(np.float32))
                    found = places(score >= least_of[:, None])
                i, d = np.divmod(found, width)
                choose(mine[i], d)
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), *(np.zeros(0, np.int64) for _ in words))]
        return dict(zip(("seed_id", "id", "score", *words), map(np.concatenate, zip(*(made or none)))))

    return work


def theme_terms(themes: DataFrame) -> DataFrame:
    """seed_id, term of free texts (id, text)."""
    return themes.select(F.col("id").alias("seed_id"), F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("term"))


def lexical(index: LexicalIndex, queries: DataFrame, k: int = 8, books: DataFrame | None = None, passage_seeds: bool = False) -> DataFrame:
    """The best `k` passages of each query, with the terms they share.

    With `passage_seeds` a seed is the passage of its id, and left out; with `books` (id, book_id) so is its whole book.
    """
    left_out = passage_seeds or books is not None
    found = index.passage_picks(queries, k, books) if left_out else index.scores(queries, k)
    w = Window.partitionBy("seed_id").orderBy(F.desc("score"), "id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("seed_id", "id", "pos", "score", "n_terms", "terms")


def reciprocal_fusion(dense: DataFrame, words: DataFrame, k: int = 8, rrf_k: int = 60) -> DataFrame:
    """Fuses two ranked lists (seed_id, id, pos): full outer join, sum of 1 / (rrf_k + rank)."""
    d = dense.select("seed_id", "id", F.col("pos").alias("dense_rank"))
    both = d.join(words.select("seed_id", "id", F.col("pos").alias("lexical_rank")), ["seed_id", "id"], "full")
    part = lambda c: F.coalesce(1 / (rrf_k + F.col(c)), F.lit(0.0))
    last = F.lit(10**9)
    w = Window.partitionBy("seed_id").orderBy(F.desc("score"), F.coalesce("dense_rank", last), F.coalesce("lexical_rank", last), "id")
    why = (
        F.when(F.col("dense_rank").isNull(), F.format_string("keyword only #%d", "lexical_rank"))
        .when(F.col("lexical_rank").isNull(), F.format_string("dense only #%d", "dense_rank"))
        .otherwise(F.format_string("dense #%d + keyword #%d", "dense_rank", "lexical_rank"))
    )
    scored = both.withColumn("score", part("dense_rank") + part("lexical_rank")).withColumn("why", why)
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
