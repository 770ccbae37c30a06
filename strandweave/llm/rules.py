"""Quality rules: an isolation forest on rule statistics.

Every text gets counts that quality rules look at: words, repeated word windows, repeated lines, symbols, kinds
of characters.  Their ratios are the features.  Trees are grown by random cuts on small samples of
labelled rows; a document that few cuts part from the rest has a short path and a high score.  The score
above which documents go is calibrated on all labelled rows that pass the base rules, good ones weighing more.

Words are runs of other than the six ASCII white space characters.  Null and empty texts have no words and fail the base
rules.  Rows of a repeated doc_id are judged each by its own text; such an id's label is its largest, and it is
used with all its rows.  Without labelled rows of label 1 only the base rules reject.  An empty table
gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import batches, column, read_table, stored, trained

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
TREES, SAMPLE, DEPTH = 200, 256, 8
#: Labelled rows that the forest may draw its samples from; the threshold is calibrated on all of them.
FIT_ROWS = 20_000
#: The share of good rows on either side that doesn't count as their usual range, and a feature's least weight.
OUTSIDE, LEAST_WEIGHT = 0.001, 0.02
GOOD_WEIGHT = 20.0
BINS = 4096
SEED = 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_same", "n_pure", "upper", "lower", "digit", "mark", "longest")
FEATURES = ("mean_word", "longest_share", "symbol_share", "dup_share", "repeat_share", "distinct_share", "same_share", "pure_share", "upper_share", "digit_share", "mark_share", "line_words")

_KINDS: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Kind of each code point: 0 upper-case or title-case letter, 1 other letter, 2 number, 3 white space, 4 the rest."""
    global _KINDS
    if _KINDS is None:
        of = {"Lu": 0, "Lt": 0, "Ll": 1, "Lo": 1, "Lm": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Zl": 3, "Zp": 3}
        _KINDS = np.array([of.get(unicodedata.category(chr(c)), 4) for c in range(sys.maxunicode + 1)], np.uint8)
        _KINDS[list(SPACE)] = 3
    return _KINDS


def repeated(ids: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-1] * np.int64(len(ids)) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, at, times = np.unique(pairs[:-1] * np.int64(len(ids)) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[at] > 1)
    marked = np.zeros(len(ids), bool)
    for step in range(3):
        marked[twice + step] = True
    return int(marked.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of the whole text."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return (0,) * len(COUNTS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    row: dict[bytes, int] = {}
    ids = np.array([row.setdefault(w, len(row)) for w in words], np.int64)
    kind = np.bincount(kinds()[np.frombuffer(text.encode("utf-32-le"), "<u4")], minlength=5)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    pure = sum(map(bytes.isalpha, row)) + sum(not w.isascii() and w.decode().isalpha() for w in row)
    return (
        len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(ids),
        len(lines), len(row), int((ids[1:] == ids[:-1]).sum()), pure, int(kind[0]), int(kind[1]), int(kind[2]), int(kind[4]), max(map(len, row)),
    )


def features(c: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS."""
    v = dict(zip(COUNTS, c.T.astype(np.float64)))
    words, lines, distinct = np.maximum(v["n_words"], 1), np.maximum(v["n_lines"], 1), np.maximum(v["n_distinct"], 1)
    chars = np.maximum(v["word_chars"], 1)
    return np.stack(
        [
            v["word_chars"] / words, np.log1p(v["longest"]), v["n_symbols"] / words, v["n_dup_lines"] / lines, v["n_repeat_words"] / words,
            # Texts of any length are alike in this share: the number of different words grows as a power of the number of words.
            np.log1p(distinct) / np.log1p(words), v["n_same"] / words, v["n_pure"] / distinct,
            v["upper"] / chars, v["digit"] / chars, v["mark"] / chars, np.log1p(words / lines),
        ],
        axis=1,
    )


def usual_length(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays: node i has the children 2i+1 and 2i+2; a leaf's feature is -1."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, length: np.ndarray, sample: int):
        self.feature, self.cut, self.length, self.sample = feature, cut, length, sample

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + 1 + (x[rows, f] >= cut[at]), at)
            total += length[at]
        return total / len(self.feature)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: sooner parted from the rest."""
        return 2.0 ** (-self.paths(x) / usual_length(self.sample))


def grow(good: np.ndarray, labelled: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """Trees over samples of the rows of label 1.

    A cut is drawn evenly from the node's part of the box of all labelled rows, so that what lies where no
    good row does is parted at once, and in a feature chosen by the share of the box that good rows leave empty.
    """
    rng = np.random.default_rng(seed)
    size = 2 ** (DEPTH + 1) - 1
    sample = min(sample, len(good))
    box = labelled.min(axis=0), labelled.max(axis=0)
    usual = np.quantile(good, 1 - OUTSIDE, axis=0) - np.quantile(good, OUTSIDE, axis=0)
    weight = np.maximum(1 - usual / np.maximum(box[1] - box[0], 1e-12), LEAST_WEIGHT)
    feature, cut, length = np.full((trees, size), -1, np.int64), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, good[rng.choice(len(good), sample, replace=False)], *box)]
        while todo:
            node, depth, rows, low, high = todo.pop()
            chance = np.where(high > low, weight, 0.0)
            if depth == DEPTH or len(rows) < 2 or not chance.any():
                length[t, node] = depth + usual_length(len(rows))
                continue
            f = int(rng.choice(len(chance), p=chance / chance.sum()))
            at = high[f] - (high[f] - low[f]) * rng.random()
            feature[t, node], cut[t, node] = f, at
            right, above, below = rows[:, f] >= at, low.copy(), high.copy()
            above[f] = below[f] = at
            todo += [(2 * node + 1, depth + 1, rows[~right], low, below), (2 * node + 2, depth + 1, rows[right], above, high)]
    return Forest(feature, cut, length, sample)


class RuleModel:
    """A forest and the bin of its score above which documents go; without a forest none goes."""

    def __init__(self, forest: Forest | None, last_bin: int = BINS):
        self.forest, self.last_bin = forest, last_bin

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(x) if self.forest and len(x) else np.zeros(len(x))

    def kept(self, score: np.ndarray) -> np.ndarray:
        return bins(score) <= self.last_bin


def bins(score: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, score * BINS).astype(np.int64)


def best_bin(good: np.ndarray, bad: np.ndarray) -> int:
    """The last bin to keep, from the numbers of rows of label 1 and 0 in each bin.

    It makes GOOD_WEIGHT times the share of good rows lost, and the share of bad rows kept, least; of equals it is the middle one.
    """
    lost = 1 - np.cumsum(good) / max(1, good.sum())
    left = np.cumsum(bad) / max(1, bad.sum())
    cost = GOOD_WEIGHT * lost + left
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return int(best[len(best) // 2])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


_BASE = COUNTS[:5]
_STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", x array<double>"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the features of every whole text, for columns doc_id, text."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            # One text at a time: a batch of long ones is never held as words.
            c = np.array([counts(t.as_py()) for t in part.column("text")], np.int64).reshape(-1, len(COUNTS))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * len(FEATURES)), pa.array(features(c).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c[:, i]) for i in range(len(_BASE))), x], names=["doc_id", *_BASE, "x"])

    return docs.select("doc_id", "text").mapInArrow(counted, _STATISTICS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> RuleModel:
    """The forest, grown on at most `fit_rows` labelled rows, chosen by their ids' hash, and its threshold, from all labelled rows.

    Only rows that pass the base rules count.  The driver gets the forest and two numbers a bin.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    labelled = stored(stats.where(~base_failed()).select("doc_id", "x").join(marked, "doc_id"), "rules-labelled")
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(fit_rows)

    def grown(table: pa.Table) -> Forest | None:
        x, label = _matrix(table.column("x").combine_chunks()), table.column("quality").to_numpy()
        order = np.lexsort([*x.T, label])
        x, label = x[order], label[order]
        return grow(x[label == 1], x) if (label == 1).sum() > 1 else None

    forest = trained(sample, grown)
    if forest is None:
        return RuleModel(None)

    def binned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = bins(forest.score(_matrix(part.column("x")))) * 2 + part.column("quality").to_numpy()
            which, n = np.unique(got, return_counts=True)
            yield from batches({"bin": (which, pa.int64()), "n": (n, pa.int64())})

    seen = np.zeros((BINS, 2))
    for row in labelled.select("x", "quality").mapInArrow(binned, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        seen[row["bin"] // 2, row["bin"] % 2] = row["n"]
    return RuleModel(forest, best_bin(seen[:, 1], seen[:, 0]))


def judged(stats: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the forest's score."""

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score = model.score(_matrix(part.column("x")))
            arrays = [part.column(c) for c in ("doc_id", *_BASE)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(score, pa.float64()), pa.array(model.kept(score))], names=["doc_id", *_BASE, "score", "usual"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", score double, usual boolean"
    got = stats.mapInArrow(judge, schema)
    return got.select("doc_id", *_BASE, base_failed().alias("base_failed"), (~base_failed() & F.col("usual")).alias("kept"), "score")


def accepted(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of `docs` that pass the base rules and the forest, with all their columns."""

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            c = np.array([counts(t.as_py()) for t in column(part, "text")], np.int64).reshape(-1, len(COUNTS))
            passed = (c[:, 0] >= LEAST_WORDS) & (100 * c[:, 4] <= MOST_REPEATED * c[:, 0])
            yield part.filter(pa.array(passed & model.kept(model.score(features(c)))))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the rules' verdict on all `documents`."""
    stats = stored(statistics(read_table(spark, sf_dir, "documents")), "rules-statistics")
    return judged(stats, fit(stats, read_table(spark, sf_dir, "labels"))).drop("score")
