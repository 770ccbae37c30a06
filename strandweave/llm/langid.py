"""Language identification: averaged hashed subword embeddings under a linear softmax.

The letter runs of a text, lower-cased and between edge marks, are cut into character n-grams of
1 to 4; each is hashed to an embedding.  A text is the mean of its n-grams' embeddings, and a
linear softmax gives the language.  Both are trained by stochastic gradient descent in numpy, on
whole texts and on short windows of them.  As the model is linear in the n-grams, a word's summed
logits are kept and a text costs one lookup a word.

Rejection is calibrated on windows left out of training: a temperature makes the score a
probability, and the limit is the score that all but a small share of right answers reach.

A null text, or one without a letter, is `und` with score 0 and is rejected.  Without training
rows every text is `und`.  A null doc_id passes through and isn't held out; repeated rows are
predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.bpe import LETTER, code_point_classes
from strandweave.llm.common import column, read_table, trained, within_bytes

BUCKETS, DIMS, LONGEST = 1 << 15, 16, 4
TRAIN_ROWS = 1500
EPOCHS, RATE = 4, 0.5
WINDOWS_EACH, WINDOW_WORDS = 2, 12
#: Share of right answers on left-out windows that rejection may cost, and the highest limit.
LOSS, HIGHEST = 0.001, 0.5
#: What the training rows' counts may hold together, in bytes; further rows are left out of training.
TRAIN_BYTES = 64 << 20
CACHE_ENTRIES = 600_000
#: Longer words are dropped from the cache after each run of texts, so that it is bounded in bytes.
KEPT_CHARACTERS = 256
TEXTS_AT_ONCE = 128
UNDETERMINED = "und"
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
OPEN, CLOSE = ord("<"), ord(">")


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words' numbers) of the n-grams of all letter runs in white space parts, each run in edge marks."""
    # A white space part holds no newline.
    points = np.frombuffer(("\n".join(words).lower() + "\n").encode("utf-32-le"), "<u4")
    letter = code_point_classes()[points] == LETTER
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = ~letter[at - 1] | (at == 0)
    last = ~letter[at + 1]
    run = np.cumsum(first)
    place = np.arange(len(at)) + 2 * run - 1  # after the marks of the runs before and its own
    marked = np.empty(len(at) + 2 * int(run[-1]), np.uint64)
    owner_run, owner = np.empty(len(marked), np.int64), np.empty(len(marked), np.int64)
    word = np.cumsum(points == ord("\n"))[at]
    for where, value, of in ((place, points[at], slice(None)), (place[first] - 1, OPEN, first), (place[last] + 1, CLOSE, last)):
        marked[where], owner_run[where], owner[where] = value, run[of], word[of]
    inner = np.zeros(len(marked), bool)
    inner[place] = True  # an edge mark alone says nothing
    out, of_word = [], []
    mixed = marked.copy()
    for n in range(1, LONGEST + 1):
        if n > 1:
            mixed = mixed[:-1] * _FACTORS[0] + marked[n - 1 :]
        good = inner if n == 1 else owner_run[: len(mixed)] == owner_run[n - 1 :]
        h = (mixed[good] + np.uint64(n)) * _FACTORS[1]
        out.append(((h ^ (h >> np.uint64(31))) * _FACTORS[0] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        of_word.append(owner[: len(mixed)][good])
    return np.concatenate(out), np.concatenate(of_word)


class LanguageModel:
    def __init__(self, languages: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float = 1.0, limit: float = 0.0):
        self.languages, self.logits, self.bias = languages, logits, bias
        self.temperature, self.limit = temperature, limit
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.languages) + 1))
        self.used = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "sums", "used")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _learn(self, words: list[str]) -> None:
        """Adds the words' summed logits and numbers of n-grams."""
        first, n = self.used, len(words)
        self.used += n
        while first + n > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.rows.update(zip(words, range(first, first + n)))
        buckets, of = subwords(words)
        for k in range(len(self.languages)):
            self.sums[first : first + n, k] = np.bincount(of, self.logits[buckets, k], n)
        self.sums[first : first + n, -1] = np.bincount(of, minlength=n)

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, probability, accepted) of each whole text."""
        out = [(UNDETERMINED, 0.0, False)] * len(texts)
        for at in range(0, len(texts) if self.languages else 0, TEXTS_AT_ONCE):
            if self.used > CACHE_ENTRIES:
                self._forget()
            words = [(t or "").split() for t in texts[at : at + TEXTS_AT_ONCE]]
            if missing := list(set().union(*words).difference(self.rows)):
                self._learn(missing)
            for i, some in enumerate(words, at):
                total = self.sums[list(map(self.rows.__getitem__, some))].sum(axis=0)
                if total[-1]:
                    z = (total[:-1] / total[-1] + self.bias) / self.temperature
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    best = int(np.argmax(p))
                    out[i] = self.languages[best], float(p[best]), bool(p[best] >= self.limit)
            for word in missing:
                if len(word) > KEPT_CHARACTERS:
                    del self.rows[word]
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predict_all([text])[0]


Sample = tuple[np.ndarray, np.ndarray, str, bool]


def samples(text: str, lang: str, seed: int) -> list[Sample]:
    """(buckets, shares, language, for calibration only) of the whole text and of some windows of it.

    Every fifth seed's text only calibrates.
    """
    words, rng = text.split(), np.random.default_rng(seed)
    taken = [words]
    for _ in range(WINDOWS_EACH if words else 0):
        first = int(rng.integers(len(words)))
        taken.append(words[first : first + int(rng.integers(1, WINDOW_WORDS + 1))])
    out: list[Sample] = []
    for part in taken:
        if len(grams := subwords(part)[0]):
            at, counts = np.unique(grams, return_counts=True)
            out.append((at, counts / len(grams), lang, seed % 5 == 4))
    return out


def train(rows: list[Sample], seed: int = 3) -> LanguageModel:
    """SGD over the samples in the given order, then calibration."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    labelled = [(at, weight, languages.index(lang), check) for at, weight, lang, check in rows]
    fitting = [r for r in labelled if not r[3]] or labelled
    n = len(languages)
    table = rng.uniform(-1, 1, (BUCKETS, DIMS)) / DIMS
    out, bias = np.zeros((DIMS, n)), np.zeros(n)
    share = np.maximum(np.bincount([f[2] for f in fitting], minlength=n) / len(fitting), 1e-9)
    steps, done = EPOCHS * len(fitting), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fitting)).tolist():
            at, weight, label, _ = fitting[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = weight @ table[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            # Rarer languages weigh as much as frequent ones.
            p *= min(4.0, 1 / (n * share[label]))
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.01 * rate * p
            table[at] -= rate * len(at) ** 0.5 * np.outer(weight, back)
    return calibrate(LanguageModel(languages, table @ out, bias), [r for r in labelled if r[3]])


def calibrate(model: LanguageModel, checking: list[tuple[np.ndarray, np.ndarray, int, bool]]) -> LanguageModel:
    """Sets the temperature of least log loss and the rejection limit."""
    if not checking:
        return model
    z = np.array([weight @ model.logits[at] + model.bias for at, weight, _, _ in checking])
    labels = np.array([r[2] for r in checking])

    def softmax(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(softmax(t)[np.arange(len(labels)), labels], 1e-300)).mean()
    model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    p = softmax(model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == labels]
    model.limit = min(HIGHEST, float(np.quantile(right, LOSS))) if len(right) else 0.0
    return model


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Trains on at most `train_rows` documents with a language that aren't held out, chosen by their ids' hash.

    The sample is bounded in rows and, by TRAIN_BYTES, in bytes whatever the input; one task trains on it.
    """
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    ids = named.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = []
            for doc_id, lang, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                for k, (at, weight, _, check) in enumerate(samples(text, lang, zlib.crc32(str(doc_id).encode()) // 4)):
                    got.append((doc_id, k, lang, at.astype("<i4").tobytes(), weight.astype("<f4").tobytes(), check))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)], names=["doc_id", "k", "lang", "at", "weight", "check"])

    # A bounded broadcast, of at most train_rows ids; a repeated id trains once, with its least text.
    one = named.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r"))
    counts = one.select("doc_id", "r.lang", "r.text").mapInArrow(counted, "doc_id long, k long, lang string, at binary, weight binary, check boolean")
    bounded = within_bytes(counts, [F.xxhash64("doc_id"), "doc_id", "k"], F.octet_length("at") + F.octet_length("weight"), TRAIN_BYTES)

    def of_table(table: pa.Table) -> LanguageModel:
        rows = table.sort_by([("doc_id", "ascending"), ("k", "ascending")]).to_pylist()
        return train([(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["weight"], "<f4").astype(np.float64), r["lang"], r["check"]) for r in rows])

    return trained(bounded, of_table)


PREDICTED = "doc_id long, lang_pred string, score double, accepted boolean"


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """PREDICTED for columns doc_id, text."""

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = model.predict_all(part.column("text").to_pylist())
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(predict, PREDICTED)


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs` whose language the model accepts, with all their columns."""

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = column(part, "text").to_pylist()
            yield part.filter(pa.array([g[2] for g in model.predict_all(texts)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the language of all `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    got = predicted(docs, fit(docs))
    return got.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "accepted")
