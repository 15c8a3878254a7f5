"""Hidden Markov language model over words, trained by Baum-Welch across partitions.

Symbols. The `top` most frequent training words (and the end of a text) are symbols of their own;
every other word belongs to one of `classes` hash classes, and P(word) = P(class | state) times
P(word | class), the second factor being the add-0.1 relative frequency within the class, with one
place for unseen words. So every text has a proper probability and unseen words need no special case.

Training. Word counts cover all training texts (partial counts per task, summed by word). All texts are
then encoded once, as symbol numbers in a Parquet table of the shared folder. Each round of Baum-Welch
runs forward-backward over all training texts inside the tasks and sums expected counts over
partitions; the driver only receives the sums, (top + classes) rows of one number per state, and
normalises them. A training text is cut into runs of `run` tokens: the first starts from the initial
distribution, the others from the distribution of run starts, which is learnt alike. Expected counts
are made in single precision and rounded to 4 digits before use, so the order of summation hardly
matters; scoring is in double precision.

Scoring. The scaled forward recursion runs over each whole text, exactly, for all texts of a batch
side by side; the log10 of the scale factors sums to the state part of log10 P(text).

Vocabulary. The `known` most frequent words are broadcast (a fixed number of entries). All other words
of a text are looked up by a join with the count table, keyed by word, and summed by row, so nothing
that grows with the corpus is broadcast or collected. Such a word is rare by construction (it ranks
below `known`), so no join key holds a large share of the rows.

Null and empty texts consist of the end token alone. Rows are told apart by id and a hash of the text:
repeated rows have equal sums and each keeps its row. A null id counts as the empty text for the fold.
An empty training set gives N = V = 0 and uniform symbols. Only the id is carried of other columns.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tripwire.llm.common import crc_of_id, lower_words, table, written

STATES = 8
TOP = 8192
CLASSES = 1024
KNOWN = 1 << 17
ROUNDS = 5
RUN = 64
FOLDS = 10
END = b" "  # no word contains a space
ADD = 0.1


# ---------------------------------------------------------------- counts


def word_counts(texts: DataFrame, text: str = "text", flush: int = 250_000) -> DataFrame:
    """(word, n) over all texts, one end token per text; tasks send partial counts of bounded size."""

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf[text]:
                seen.update(lower_words(t))
                seen[END] += 1
                if len(seen) > flush:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    return texts.select(text).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": list(seen.keys()), "n": np.fromiter(seen.values(), np.int64, len(seen))})


class Vocabulary:
    """The broadcast part of the vocabulary and the totals that turn counts into probabilities."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, top: int, classes: int,
                 class_total: np.ndarray, class_distinct: np.ndarray):
        self.words, self.top, self.classes, self.n_symbols = words, top, classes, top + classes
        self.counts, self.total, self.distinct = counts, total, distinct
        self.base_norm = total + ADD * (distinct + 1)
        self.class_norm = class_total + ADD * (class_distinct + 1)
        self.index = None

    def prepare(self) -> None:
        """Tables of a Python worker, built at first use."""
        if self.index is None:
            self.index = {w: i for i, w in enumerate(self.words)}
            rest = self.counts[self.top:]
            group = np.fromiter((class_of(w, self.classes) for w in self.words[self.top:]), np.int64, len(rest))
            self.symbol = np.concatenate([np.arange(min(self.top, len(self.words))), self.top + group]).astype(np.int64)
            own = np.zeros(min(self.top, len(self.words)))
            self.base_log = np.log10((self.counts + ADD) / self.base_norm)
            self.class_log = np.concatenate([own, np.log10((rest + ADD) / self.class_norm[group])])

    def encode(self, text) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Vocabulary places (-1: not broadcast), symbols, and the words that are not broadcast."""
        self.prepare()
        words = lower_words(text)
        words.append(END)
        place = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        other = np.flatnonzero(place < 0)
        symbols = self.symbol[place] if len(self.symbol) else np.zeros(len(words), np.int64)
        rest = [words[i] for i in other.tolist()]
        if rest:
            symbols[other] = self.top + np.fromiter((class_of(w, self.classes) for w in rest), np.int64, len(rest))
        return place, symbols, rest


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word) % classes


def vocabulary(counts: DataFrame, top: int = TOP, classes: int = CLASSES, known: int = KNOWN) -> Vocabulary:
    """Reads at most `known` words, `classes` sums, some hundred steps and two totals to the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the most frequent words by steps of their count: the lowest step that keeps the sum within `known`
    step = F.floor(F.log2("n") * 32)
    room, least = known, 1 << 62
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r["step"]):
        room -= r["v"]
        if room < 0:
            break
        least = r["step"]
    often = counts.filter((step >= least) | (F.col("word") == F.lit(END))).toPandas()
    often = often.assign(end=often["word"].map(lambda w: bytes(w) != END)).sort_values(["end", "n", "word"], ascending=[True, False, True])
    words, n = [bytes(w) for w in often["word"]], often["n"].to_numpy(np.int64)
    if END not in words[:1]:
        words, n = [END, *words], np.concatenate([[0], n])  # no training text at all
    total_of, distinct_of = np.zeros(classes), np.zeros(classes)
    sums = counts.groupBy(F.pmod(F.crc32("word"), F.lit(classes)).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    total_of[sums["c"].to_numpy(np.int64)] = sums["n"]
    distinct_of[sums["c"].to_numpy(np.int64)] = sums["v"]
    for w, c in zip(words[:top], n[:top].tolist()):  # symbols of their own are in no class
        total_of[class_of(w, classes)] -= c
        distinct_of[class_of(w, classes)] -= c > 0
    return Vocabulary(words, n, int(total), int(distinct), top, classes, total_of, distinct_of)


# ---------------------------------------------------------------- the model


class Hmm:
    """start (states), again (states at run starts), move (states x states), emit (symbols x states)."""

    def __init__(self, start, again, move, emit):
        self.start, self.again, self.move, self.emit = start, again, move, emit

    @classmethod
    def first(cls, states: int, frequency: np.ndarray, seed: int = 7) -> "Hmm":
        """Sticky states with strongly perturbed symbol frequencies: Baum-Welch starts well apart."""
        rnd = np.random.default_rng(seed)
        emit = (frequency[:, None] + 1e-9) * np.exp(1.5 * rnd.standard_normal((len(frequency), states)))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        even = np.full(states, 1 / states)
        return cls(even, even, move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start, again, move, emit, frequency: np.ndarray) -> "Hmm":
        """Relative expected counts; one pseudo-count per state is spread like the symbol frequencies."""
        emit = emit + (frequency[:, None] + 1e-6)
        norm = lambda x: (x + 0.01) / (x + 0.01).sum(-1, keepdims=True)
        return cls(norm(start), norm(again), norm(move), emit / emit.sum(0))

    def expected(self, runs: np.ndarray, firsts: np.ndarray, sums: dict) -> None:
        """Forward-backward over runs (n, length; -1 pads the end); adds expected counts to `sums`."""
        n, length = runs.shape
        states, real = len(self.start), np.float32
        pad = (runs < 0).T
        look = np.where(pad, len(self.emit), runs.T)
        emit = np.vstack([self.emit, np.ones(states)]).astype(real)  # a pad says nothing about the state
        move, one = self.move.astype(real), np.ones(states, real)
        alpha, seen, scale = np.empty((length, n, states), real), np.empty((length, n, states), real), np.empty((length, n, 1), real)
        a = np.where(firsts[:, None], self.start, self.again).astype(real)
        for t in range(length):
            if t:
                a = a @ move
            np.take(emit, look[t], axis=0, out=seen[t])
            a = np.multiply(a, seen[t], out=alpha[t])
            scale[t, :, 0] = a @ one
            a /= scale[t]
        beta = np.ones((n, states), real)
        for t in range(length - 1, -1, -1):
            weighted = seen[t]
            weighted *= beta
            weighted /= scale[t]
            alpha[t] *= beta  # the state posteriors
            if t:
                inner = np.where(pad[t][:, None], real(0), weighted) if pad[t].any() else weighted
                sums["move"] += self.move * (alpha[t - 1].T @ inner)
                beta = weighted @ move.T
        sums["start"] += alpha[0][firsts].sum(0)
        sums["again"] += alpha[0][~firsts].sum(0)
        at = look.ravel()
        for k in range(states):
            sums["emit"][:, k] += np.bincount(at, alpha[:, :, k].ravel(), len(self.emit) + 1)[:-1]

    def log10_of(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 P(symbols) of each text by the scaled forward recursion over its whole length."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.int64)
        size = size[order]
        begin = np.cumsum(size) - size
        found = np.zeros(len(texts))
        a = np.tile(self.start, (len(texts), 1))
        active = len(texts)
        for t in range(int(size[0]) if len(texts) else 0):
            while size[active - 1] <= t:
                active -= 1
            a = a[:active] @ self.move if t else a[:active]
            a = a * self.emit[flat[begin[:active] + t]]
            scale = a.sum(1)
            a /= scale[:, None]
            found[:active] += np.log10(scale)
        out = np.empty(len(texts))
        out[order] = found
        return out


def baum_welch(encoded: DataFrame, frequency: np.ndarray, symbols: str = "symbols", states: int = STATES,
               rounds: int = ROUNDS, run: int = RUN) -> Hmm:
    """Rounds of expected counts over all encoded texts (int16 symbol numbers as binary)."""
    spark = encoded.sparkSession
    model = Hmm.first(states, frequency)
    columns = [f"s{k}" for k in range(states)]
    schema = "place long, " + ", ".join(f"{c} double" for c in columns)
    n = len(frequency)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def expect(batches):
            m = now.value
            sums = {"start": np.zeros(states), "again": np.zeros(states), "move": np.zeros((states, states)), "emit": np.zeros((n, states))}
            runs, firsts = [], []

            def work():
                packed = np.full((len(runs), run), -1, np.int64)
                for i, r in enumerate(runs):
                    packed[i, :len(r)] = r
                m.expected(packed, np.array(firsts), sums)
                runs.clear()
                firsts.clear()

            for pdf in batches:
                for cell in pdf[symbols]:
                    seq = np.frombuffer(cell, "<i2")
                    for i in range(0, len(seq), run):
                        runs.append(seq[i:i + run])
                        firsts.append(i == 0)
                        if len(runs) == 1024:
                            work()
            if runs:
                work()
            rows = np.vstack([sums["emit"], sums["move"], sums["start"], sums["again"]])
            some = np.flatnonzero(rows.any(1))
            yield pd.DataFrame({"place": some} | {c: rows[some, k] for k, c in enumerate(columns)})

        parts = encoded.select(symbols).mapInPandas(expect, schema)
        got = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        rows = np.zeros((n + states + 2, states))
        rows[got["place"].to_numpy(np.int64)] = np.round(got[columns].to_numpy(float), 4)
        model = Hmm.from_counts(rows[-2], rows[-1], rows[n:n + states], rows[:n], frequency)
    return model


def symbol_frequency(v: Vocabulary) -> np.ndarray:
    """Share of each symbol among the training tokens; even where there are none."""
    own = np.zeros(v.top)
    own[:min(v.top, len(v.counts))] = v.counts[:v.top]
    of_class = np.maximum(0.0, v.class_norm - ADD)  # counts of the class and a little for unseen words
    both = np.concatenate([own, of_class]) + 1e-3
    return both / both.sum()


# ---------------------------------------------------------------- scoring


def encode(docs: DataFrame, shared, keep: str, text: str = "text", slice_rows: int = 500) -> DataFrame:
    """`keep` columns (a schema) plus counts and sums over broadcast words, symbols (int16 as binary),
    and the other words with their numbers; a task holds the results of `slice_rows` texts at a time."""
    names = [c.split()[0] for c in keep.split(", ")]
    made = ["n_tokens", "n_known", "base", "inner", "symbols", "words", "times"]

    def read(batches):
        v = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), slice_rows):
                part, rows = pdf.iloc[i:i + slice_rows], []
                for t in part[text]:
                    place, symbols, rest = v.encode(t)
                    here, others = place[place >= 0], Counter(rest)
                    rows.append((len(place), int((v.counts[here] > 0).sum()), v.base_log[here].sum(), v.class_log[here].sum(),
                                 symbols.astype("<i2").tobytes(), list(others), list(others.values())))
                yield pd.concat([part[names].reset_index(drop=True), pd.DataFrame(rows, columns=made)], axis=1)

    schema = keep + ", n_tokens long, n_known long, base double, inner double, symbols binary, words array<binary>, times array<long>"
    return docs.select(*names, text).mapInPandas(read, schema)


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", states: int = STATES,
          top: int = TOP, classes: int = CLASSES, known: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    The model learns from the rows for which `held_out` is false.
    """
    spark = docs.sparkSession
    counts = written(word_counts(docs.filter(~held_out), text), "word-counts")
    vocab = vocabulary(counts, top, classes, known)
    shared = spark.sparkContext.broadcast(vocab)
    id_type = docs.schema[doc_id].dataType.simpleString()
    # ids pass through Python as text: a long column with nulls would become floating point there
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), held_out.alias("held_out"), F.xxhash64(doc_id, text).alias("row_key"), text)
    encoded = written(encode(rows, shared, "doc_id string, held_out boolean, row_key long", text), "encoded")
    encoded = encoded.withColumn("doc_id", F.col("doc_id").cast(id_type))
    model = spark.sparkContext.broadcast(baum_welch(encoded.filter(~F.col("held_out")), symbol_frequency(vocab), "symbols", states, rounds))

    @F.pandas_udf("double")
    def forward(cells: pd.Series) -> pd.Series:
        return pd.Series(model.value.log10_of([np.frombuffer(c, "<i2") for c in cells]))

    # the other words with their counts; one that the table lacks was never seen. Equal rows share a
    # key and its words, so their sums are made once.
    norm = F.element_at(F.array(*[F.lit(float(x)) for x in vocab.class_norm]), (F.pmod(F.crc32("word"), F.lit(classes)) + 1).cast("int"))
    c = F.coalesce("n", F.lit(0))
    rare = encoded.select("doc_id", "row_key", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("times"))).alias("o"))
    rare = rare.select("doc_id", "row_key", "o.*")
    sums = rare.join(counts, "word", "left").groupBy(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"), F.sum("times").alias("all"),
        F.sum(F.col("times") * F.log10((c + ADD) / F.lit(float(vocab.base_norm)))).alias("b"),
        F.sum(F.col("times") * F.log10((c + ADD) / norm)).alias("m"))
    own = encoded.select("doc_id", "held_out", "row_key", "n_tokens", "n_known", "base", "inner", forward("symbols").alias("log10"),
                         F.aggregate("times", F.lit(0).cast("long"), lambda a, n: a + n).alias("open"))
    both = own.join(sums, (own["row_key"] == sums["key"]) & own["doc_id"].eqNullSafe(sums["id"]), "left")
    copies = F.when(F.col("open") > 0, F.col("all") / F.col("open")).otherwise(F.lit(1.0))  # rows that share the key
    add = lambda name: F.coalesce(F.col(name) / copies, F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + add("k")).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + add("b")).alias("base_score"),
        (F.col("log10") + F.col("inner") + add("m")).alias("score"))


def op4_hmm_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, F.pmod(crc_of_id(F.col("doc_id")), F.lit(FOLDS)) == 0)
