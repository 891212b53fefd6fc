"""Language-model scores of whole texts: a log-bilinear model trained with noise-contrastive estimation.

Words are counted over all learning documents in a distributed table. Every
word has a *kind*: the end, one of the ``singles`` most frequent words, or the
class of all other words that end in the same three bytes (hashed to
``endings`` classes). The ``head`` most frequent words are *members* of their
class; the words of a class that are not in the head, met or not, share its
last member. A word's probability given the two words before it is

    P(kind | two kinds) x P(member | kind, kind before) x share of the word

and each factor is normalised exactly, so that the vocabulary is the whole
counted one and every word's probability depends on its context. The first two
factors are log-bilinear: the contexts' embeddings give a predicted embedding
whose product with a kind's (a member's) embedding, plus a bias, is its score.
The normaliser over all kinds is one matrix product for all pairs of context
kinds, that over members is one for all kinds before. The share of a word in
the last member goes by its count plus one, with one place for words not met.

Training runs in rounds over the documents' words as numbers. A hash of id and
text deals documents to rounds and, within a round, to shards of a bounded
number of words; a shard trains a copy of the model in the order of that hash,
copies are averaged, and the next round starts from the average. So neither
the layout of the input nor the number of tasks has a say in the result, and
a larger input has more shards, not longer ones (beyond ``most_shards``,
longer ones). Parameters of members are averaged by how often a shard touched
them, so that rare words are not diluted by shards that never met them.

Counts of the head (words of up to 64 bytes) are broadcast; those of all other
words are joined by a shuffle, so no count is lost and nothing that is sent or
held grows with the vocabulary.

Defined results: a null text is an empty one: its end only; rows that repeat
an id are scored each; rows that repeat id and text are learned from as one of
their number's weight; null ids learn; words of equal count enter the head in
the order of a hash; with nothing to learn from, every token has the
probability of an even draw among all kinds; very long texts are one row of
two bytes a word while training; other columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import batch_of, map_batches, map_slices, words
from .store import written

END = 0
HEAD_BYTES = 64
#: Bytes at a word's end that decide its class.
ENDING = 3
#: Where sums of squared gradients of kinds begin.
START = 1e-4


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows."""

    def step():
        def apply(batch):
            coded, _ = words(batch.column(0))
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)) if len(coded) else np.zeros(0, np.int64)
            return pa.record_batch([coded.dictionary, pa.array(n, pa.int64())], ["word", "n"])

        return apply

    rows = map_slices(docs.select(F.col(text_col).alias("text")), step, "word string, n long", budget=8 << 20)
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(vocabulary: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
    """The ``most`` most frequent words, most frequent first; among equal counts a hash decides."""
    own = vocabulary.where(F.octet_length("word") <= HEAD_BYTES).withColumn("level", F.floor(F.log2("n") * 16))
    levels = sorted(((r["level"], r["k"]) for r in own.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # under 1,000 rows
    held, cut, share, among = 0, None, 0.0, 1
    for level, k in levels:
        if held >= most:
            break
        cut, share, among = level, min(1.0, (most - held) / k), k
        held += k
    if cut is None:
        return [], np.zeros(0, np.int64)
    # of the last level, which may hold any number of words, those of the largest counts
    last = own.where(F.col("level") == cut)
    least = 0
    if share < 1:
        by_count = sorted(((r["n"], r["k"]) for r in last.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True) if cut < 160 else []
        left = most - (held - dict(levels)[cut])
        for n, k in by_count:  # a level below 2**10 holds under 100 counts
            least, share, among = n, min(1.0, left / k), k
            left -= k
            if left <= 0:
                break
    draw = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    bound = min(1.0, share + 6 * (share / among) ** 0.5 + 20 / among) * (1 << 30)  # enough of them, and not many more
    near = (F.col("n") > least) | ((F.col("n") == least) & (draw < bound)) if least else draw < bound
    rows = own.where((F.col("level") > cut) | ((F.col("level") == cut) & near)).select("word", "n", draw.alias("h")).collect()
    rows = sorted(((r["n"], r["h"], r["word"]) for r in rows), key=lambda x: (-x[0], x[1], x[2].encode()))[:most]
    return [w for _, _, w in rows], np.array([n for n, _, _ in rows], np.int64)


def ending_class(endings: int) -> Column:
    """The class of a word, as ``Coder`` has it."""
    return (F.crc32(F.substring(F.col("word").cast("binary"), -ENDING, ENDING)) % endings).cast("int")


class Coder:
    """Words as units: the end, the single words, and the members of the classes, each class's last for its other words."""

    def __init__(self, head: list[str], counts: np.ndarray, singles: int, endings: int):
        self.head = pa.array(head, pa.string())
        self.counts = counts
        self.singles, self.endings = min(singles, len(head)), endings
        self.first = 1 + self.singles  # the first kind that is a class
        own = np.array([zlib.crc32(w.encode()[-ENDING:]) % endings for w in head[self.singles :]], np.int64)
        order = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=endings) + 1
        self.starts = self.first + np.concatenate([[0], np.cumsum(sizes)])  # of each class's units
        self.rest = self.starts[1:] - 1
        self.kind_of = np.concatenate([np.arange(self.first), self.first + np.repeat(np.arange(endings), sizes)])
        self.unit_of = np.arange(1, len(head) + 1)
        # members keep the order of counts; the class number lifts them over the rest units before
        self.unit_of[self.singles + order] = self.first + np.arange(len(own)) + own[order]
        self.word_of = np.full(self.units, -1)
        self.word_of[self.unit_of] = np.arange(len(head))

    @property
    def kinds(self) -> int:
        return self.first + self.endings

    @property
    def units(self) -> int:
        return int(self.starts[-1])

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
        """For all tokens of the texts, ends included: the unit; the texts' offsets; the words; and the words' places among the tokens."""
        coded, at = words(column)
        n = len(at) - 1
        known = coded.dictionary
        place = pc.fill_null(pc.index_in(known, self.head), -1).to_numpy().astype(np.int64)
        unit = np.where(place >= 0, self.unit_of[place] if len(self.unit_of) else 0, 0)
        other = np.flatnonzero(place < 0)
        if len(other):
            ends = pc.binary_slice(known.take(pa.array(other)).cast(pa.binary()), -ENDING).dictionary_encode()
            classes = np.array([zlib.crc32(x) % self.endings for x in ends.dictionary.to_pylist()], np.int64)
            unit[other] = self.rest[classes[ends.indices.to_numpy()]]
        where = np.arange(len(coded)) + np.repeat(np.arange(n), np.diff(at))
        offsets = at + np.arange(n + 1)
        units = np.zeros(offsets[-1], np.int64)
        if len(coded):
            units[where] = unit[coded.indices.to_numpy()]
        return units, offsets, coded, where

    @staticmethod
    def contexts(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two tokens before each; before a text's first token stand ends."""
        one = np.concatenate([[END], kinds[:-1]])
        two = np.concatenate([[END, END], kinds[:-2]])[: len(kinds)]
        heads = offsets[:-1]
        one[heads] = END
        two[heads] = END
        second = heads + 1
        two[second[second < offsets[1:]]] = END
        return one, two


def _groups(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``at``, and where in it each distinct number begins."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    return order, np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class LogBilinear:
    """The two log-bilinear factors.

    Of kinds: R1, R2 (embeddings as the word before and the one before that),
    Q (as target) and b (biases). Of members: S (of the kind before) and M,
    whose last column is the bias.
    """

    DENSE = ("R1", "R2", "Q", "b", "S")

    def __init__(self, coder: Coder, unit_counts: np.ndarray, dim: int = 16, member_dim: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.kind_of, self.first, self.starts = coder.kind_of, coder.first, coder.starts
        k, u = coder.kinds, coder.units
        mass = unit_counts + 1.0
        by_kind = np.bincount(self.kind_of, mass, k)
        self.noise = by_kind / by_kind.sum()
        self.log_noise, self.cumulated_kinds = np.log(self.noise).astype(np.float32), np.cumsum(self.noise)
        self.member_noise = mass / by_kind[self.kind_of]  # within the kind
        self.log_member_noise, self.cumulated = np.log(self.member_noise).astype(np.float32), np.cumsum(mass)
        self.kind_mass = by_kind
        self.alone = np.diff(np.concatenate([np.arange(self.first), self.starts])) == 1
        p = {
            "R1": rng.normal(0, 0.1, (k, dim)), "R2": rng.normal(0, 0.1, (k, dim)), "Q": rng.normal(0, 0.1, (k, dim)), "b": np.log(self.noise),
            "S": rng.normal(0, 0.3, (k, member_dim)), "M": np.concatenate([np.zeros((u, member_dim)), np.log(self.member_noise)[:, None]], axis=1),
        }
        self.params = {n: x.astype(np.float32) for n, x in p.items()}
        # sums of squared gradients: of every number for kinds, of a row for members
        self.sums = {n: np.full(self.params[n].shape, START, np.float32) for n in ("R1", "R2", "Q", "b")}
        self.sums |= {n: np.full(len(self.params[n]), 0.1, np.float32) for n in ("S", "M")}
        self.touched = np.zeros(u, np.float32)

    def train(self, one: np.ndarray, two: np.ndarray, units: np.ndarray, weight: np.ndarray, rng: np.random.Generator, batch: int = 2048) -> None:
        """One pass of noise-contrastive estimation over tokens with their contexts and weights."""
        kinds = self.kind_of[units]
        one, two, weight = one.astype(np.uint16), two.astype(np.uint16), weight.astype(np.float32)
        inner = np.flatnonzero((kinds >= self.first) & ~self.alone[kinds])
        for at in range(0, len(units), batch):
            to = at + batch
            self._kinds(one[at:to], two[at:to], kinds[at:to].astype(np.uint16), weight[at:to], rng)
        for at in range(0, len(inner), batch):
            own = inner[at : at + batch]
            self._members(one[own], units[own], kinds[own], weight[own], rng)

    def _kinds(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray, weight: np.ndarray, rng: np.random.Generator, noise: int = 32, rate: float = 0.2) -> None:
        """The noise words of a batch are shared by its tokens."""
        p = self.params
        log_noise = self.log_noise + np.float32(np.log(noise))
        x = np.minimum(np.searchsorted(self.cumulated_kinds, rng.random(noise)), len(self.noise) - 1).astype(np.uint16)
        q, qx = p["Q"][w], p["Q"][x]
        predicted = p["R1"][h1] + p["R2"][h2]
        own = np.einsum("ij,ij->i", predicted, q) + p["b"][w] - log_noise[w]
        other = predicted @ qx.T
        other += p["b"][x] - log_noise[x]
        share = weight / weight.sum()
        up = share * _sigmoid(-own)  # 1 - P(data)
        down = _sigmoid(other)
        down *= -share[:, None]
        g = up[:, None] * q + down @ qx
        self._kind_rows("Q", "b", np.concatenate([w, x]), np.concatenate([up[:, None] * predicted, down.T @ predicted]), np.concatenate([up, down.sum(axis=0)]), rate)
        self._kind_rows("R1", None, h1, g, None, rate)
        self._kind_rows("R2", None, h2, g, None, rate)

    def _kind_rows(self, name: str, bias: str | None, at: np.ndarray, rows: np.ndarray, more: np.ndarray | None, rate: float) -> None:
        order, heads = _groups(at)
        own = at[order[heads]]
        for n, g in ((name, rows), (bias, more)):
            if n is not None:
                g = np.add.reduceat(g[order], heads, axis=0)
                sums = self.sums[n][own] + g * g
                self.sums[n][own] = sums
                self.params[n][own] += np.float32(rate) * g / np.sqrt(sums)

    def _members(self, h1: np.ndarray, w: np.ndarray, kinds: np.ndarray, weight: np.ndarray, rng: np.random.Generator, noise: int = 2, rate: float = 0.1) -> None:
        """The noise words of a token come from its kind."""
        p, n = self.params, len(w)
        start, stop = self.starts[kinds - self.first], self.starts[kinds - self.first + 1]
        draw = self.cumulated[start - 1] + rng.random((noise, n)) * self.kind_mass[kinds]
        x = np.clip(np.searchsorted(self.cumulated, draw, side="right"), start, stop - 1)
        at = np.concatenate([w, x.ravel()])
        m = p["M"][at].reshape(noise + 1, n, -1)  # the last column is the bias
        s = p["S"][h1]
        score = np.einsum("ij,kij->ki", s, m[:, :, :-1]) + m[:, :, -1] - (self.log_member_noise[at].reshape(noise + 1, n) + np.float32(np.log(noise)))
        share = weight * np.float32(n / weight.sum())
        g = _sigmoid(score)
        g *= -share
        g[0] += share
        gs = np.einsum("ki,kij->ij", g, m[:, :, :-1])
        gm = np.empty_like(m)
        np.multiply(g[:, :, None], s, out=gm[:, :, :-1])
        gm[:, :, -1] = g
        for name, rows, grad in (("M", at.astype(np.uint16) if len(p["M"]) <= 1 << 16 else at, gm.reshape(len(at), -1)), ("S", h1, gs)):
            order, heads = _groups(rows)
            own = rows[order[heads]]
            grad = np.add.reduceat(grad[order], heads, axis=0)
            sums = self.sums[name][own] + np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
            self.sums[name][own] = sums
            p[name][own] += grad * (np.float32(rate) / np.sqrt(sums))[:, None]
            if name == "M":
                self.touched[own] += 1

    # Copies of the model as flat numbers that can be added up.

    def _parts(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What is averaged by tokens, and what by touches."""
        dense = [self.params[n] for n in self.DENSE] + [self.sums[n] for n in self.DENSE]
        return dense, [self.params["M"], self.sums["M"]]

    def state(self) -> np.ndarray:
        dense, sparse = self._parts()
        return np.concatenate([x.ravel() for x in (*dense, *sparse)])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for x in (y for part in self._parts() for y in part):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.touched[:] = 0
        return self

    def weighed(self, start: np.ndarray, tokens: int) -> np.ndarray:
        """This copy for a sum of copies: tokens, touches, and parameters as changes since ``start`` times their weight."""
        moved = self.state() - start
        dense, sparse = self._parts()
        n = sum(x.size for x in dense)
        weights = np.concatenate([np.full(n, tokens, np.float32), *[np.repeat(self.touched, x.size // len(x)) for x in sparse]])
        return np.concatenate([np.array([tokens], np.float32), self.touched, moved * weights])

    def averaged(self, start: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The state after ``start`` that a sum of weighed copies means."""
        u = len(self.touched)
        tokens, touches, moved = total[0], total[1 : 1 + u], total[1 + u :]
        dense, sparse = self._parts()
        n = sum(x.size for x in dense)
        weights = np.concatenate([np.full(n, max(tokens, 1), np.float32), *[np.repeat(np.maximum(touches, 1), x.size // len(x)) for x in sparse]])
        return (start + moved / weights).astype(np.float32)

    # Scores.

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each context kind adds to each kind's score (bias in the first), and the log-normaliser of each pair of contexts."""
        p = self.params
        a = p["R1"] @ p["Q"].T + p["b"]
        b = p["R2"] @ p["Q"].T
        top_a, top_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        z = np.log(np.exp((a - top_a).astype(np.float64)) @ np.exp((b - top_b).astype(np.float64)).T) + top_a + top_b.T
        return a, b, z.astype(np.float32)

    def member_normalisers(self) -> np.ndarray:
        """For each kind before and each class, the log-normaliser of its members."""
        out = np.zeros((len(self.params["S"]), len(self.starts) - 1), np.float32)
        for c, (lo, hi) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            own = self.params["M"][lo:hi]
            scores = (self.params["S"] @ own[:, :-1].T + own[:, -1]).astype(np.float64)
            top = scores.max(axis=1)
            out[:, c] = np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top
        return out


@dataclass
class LanguageModel:
    coder: Coder
    vocabulary: DataFrame
    lbl: LogBilinear
    total: int  # N: tokens learned from
    distinct: int  # V: distinct ones
    ends: int
    rest_mass: np.ndarray  # of each class: tokens of its words that are not in the head
    rest_words: np.ndarray  # and how many words those are


def coded(docs: DataFrame, coder: Coder, id_col: str, text_col: str, rounds: int, shards: int) -> DataFrame:
    """(key, times, units, shard, round): every document's units; rows alike in id and text are put together batch by batch."""
    shared = docs.sparkSession.sparkContext.broadcast((coder.head.to_pylist(), coder.counts, coder.singles, coder.endings))
    wide = np.uint16 if coder.units <= 1 << 16 else np.uint32

    def step():
        mine = Coder(*shared.value)

        def apply(batch):
            keys, first, times = np.unique(batch.column(1).to_numpy(), return_index=True, return_counts=True)
            units, offsets, _, _ = mine.tokens(batch.column(0).take(pa.array(first)))
            flat = units.astype(wide).tobytes()
            ends = (offsets * np.dtype(wide).itemsize).tolist()
            return pa.record_batch([pa.array(keys), pa.array(times.astype(np.int64)), pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["key", "times", "units"])

        return apply

    rows = map_slices(docs.select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key")), step, "key long, times long, units binary")
    return rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(shards)).cast("int")).withColumn("round", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(rounds)).cast("int"))


def train(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    singles: int = 511,
    endings: int = 512,
    head: int = 65_023,
    dim: int = 16,
    member_dim: int = 8,
    seed: int = 1,
    rounds: int = 3,
    shard_tokens: int = 2_000_000,
    most_shards: int = 4096,
) -> LanguageModel:
    spark = docs.sparkSession
    own = docs.where(learn).select(F.col(id_col), F.col(text_col))
    vocabulary = written(count_words(own, text_col), "vocabulary")
    sums = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = own.count()
    total = int(sums["n"]) + ends
    names, counts = frequent(vocabulary, head)
    coder = Coder(names, counts, singles, endings)
    mass, distinct = np.zeros(endings, np.int64), np.zeros(endings, np.int64)
    for r in vocabulary.groupBy(ending_class(endings).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():  # a row a class
        mass[r["c"]], distinct[r["c"]] = r["n"], r["k"]
    in_head = np.array([zlib.crc32(w.encode()[-ENDING:]) % endings for w in names], np.int64)
    mass -= np.bincount(in_head, counts, endings).astype(np.int64)
    distinct -= np.bincount(in_head, minlength=endings)
    unit_counts = np.zeros(coder.units)
    unit_counts[END], unit_counts[coder.unit_of], unit_counts[coder.rest] = ends, counts, mass
    lbl = LogBilinear(coder, unit_counts, dim, member_dim, seed)
    if total:
        shards = int(min(most_shards, max(1, -(-total // shard_tokens))))
        rows = written(coded(own, coder, id_col, text_col, rounds, shards), "coded", ["round"])
        state = lbl.state()
        for turn in range(rounds):
            state = _round(spark, rows.where(F.col("round") == turn), coder, unit_counts, (dim, member_dim, seed), state, turn, shards)
        lbl.load(state)
    return LanguageModel(coder, vocabulary, lbl, total, int(sums["v"]) + (ends > 0), ends, mass, distinct)


#: Copies that one task adds up.
FAN_IN = 16


def _round(spark, rows: DataFrame, coder: Coder, unit_counts: np.ndarray, sizes: tuple, state: np.ndarray, turn: int, shards: int) -> np.ndarray:
    """The state after all shards have trained on their rows of a round."""
    shared = spark.sparkContext.broadcast((coder.head.to_pylist(), coder.counts, coder.singles, coder.endings, unit_counts, state))
    dim, member_dim, seed = sizes
    dealt = rows.select("shard", "key", "times", "units").repartition(shards, "shard").sortWithinPartitions("shard", "key")

    def fit(batches):
        *names, counts, start = shared.value
        mine = Coder(*names)
        model, shard, rng, tokens = None, None, None, 0
        held: list[tuple] = []  # documents not yet trained on: key, units, times

        def learn():
            nonlocal tokens
            units = np.concatenate([u for _, u, _ in held]).astype(np.int64)
            lengths = np.array([len(u) for _, u, _ in held])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            one, two = Coder.contexts(mine.kind_of[units], offsets)
            weight = np.repeat(np.array([t for _, _, t in held], np.float64), lengths)
            model.train(one, two, units, weight, rng)
            tokens += int(weight.sum())

        def done():
            if held:
                learn()
            return pa.record_batch([pa.array([shard // FAN_IN], pa.int64()), pa.array([shard], pa.int64()), pa.array([model.weighed(start, tokens).tobytes()], pa.binary())], ["g", "shard", "model"])

        size = 0
        for batch in batches:
            wide = np.uint16 if mine.units <= 1 << 16 else np.uint32
            for own, key, times, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own != shard:
                    if shard is not None:
                        yield done()
                    shard, tokens, held, size = own, 0, [], 0
                    model, rng = LogBilinear(mine, counts, dim, member_dim, seed).load(start), np.random.default_rng([seed, turn, own])
                if held and held[-1][0] == key:  # the same document from another batch
                    held[-1] = (key, held[-1][1], held[-1][2] + times)
                    continue
                if size >= 1 << 16:
                    learn()
                    held, size = [], 0
                units = np.frombuffer(raw, wide)
                held.append((key, units, times))
                size += len(units)
        if shard is not None:
            yield done()

    copies, left = map_batches(dealt, fit, "g long, shard long, model binary"), shards
    while True:
        copies = written(copies.groupBy("g").applyInArrow(_added, "g long, shard long, model binary"), "copies")
        left = -(-left // FAN_IN)
        if left == 1:
            break
    rows_ = copies.collect()  # one row, of a size that follows from the parameters
    lbl = LogBilinear(coder, unit_counts, dim, member_dim, seed)
    shared.destroy()
    return lbl.averaged(state, np.frombuffer(rows_[0]["model"], np.float32)) if rows_ else state


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")
    total = np.sum([np.frombuffer(x, np.float32) for x in table.column("model").to_pylist()], axis=0, dtype=np.float64)
    g = table.column("g")[0].as_py()
    return pa.table({"g": pa.array([g // FAN_IN], pa.int64()), "shard": pa.array([g], pa.int64()), "model": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) for every row of docs."""
    coder, lbl = model.coder, model.lbl
    base_log = float(np.log10(model.total + model.distinct + 1))
    rest_logs = np.log10(model.rest_mass + model.rest_words + 1.0)
    parts = (lbl.tables(), lbl.member_normalisers(), lbl.params["S"], lbl.params["M"])
    shared = docs.sparkSession.sparkContext.broadcast((coder.head.to_pylist(), coder.counts, coder.singles, coder.endings, parts, rest_logs, model.ends))
    schema = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("own", pa.float64()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])

    def step():
        names, counts, singles, endings, ((a, b, z), members, s, m), rest, ends = shared.value
        mine = Coder(names, counts, singles, endings)
        # of each unit: log10 of its count + 1, whether it is known, and whether other words share it
        logs, held = np.zeros(mine.units), np.zeros(mine.units, bool)
        logs[END], held[END] = np.log10(ends + 1.0), ends > 0
        logs[mine.unit_of], held[mine.unit_of] = np.log10(counts + 1.0), True
        shares = np.zeros(mine.units, bool)
        shares[mine.rest] = True
        state = {"rid": TaskContext.get().partitionId() << 33}

        def scores(one, two, units):
            kinds = mine.kind_of[units]
            p = a[one, kinds].astype(np.float64) + b[two, kinds] - z[one, two]
            inner = np.flatnonzero(kinds >= mine.first)
            h, u, c = one[inner], units[inner], kinds[inner] - mine.first
            p[inner] += np.einsum("ij,ij->i", s[h], m[u, :-1]) + m[u, -1] - members[h, c]
            p /= np.log(10)
            p[inner] -= np.where(shares[u], rest[c], 0.0)
            return p

        def apply(batch):
            n = batch.num_rows
            units, offsets, coded_, where = mine.tokens(batch.column(1))
            one, two = Coder.contexts(mine.kind_of[units], offsets)
            p = np.concatenate([scores(one[k : k + 65536], two[k : k + 65536], units[k : k + 65536]) for k in range(0, len(units), 65536)])
            total = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  every text has its end
            # words that are not in the head, each once a text
            doc_of = np.repeat(np.arange(n), np.diff(offsets))
            rare = np.flatnonzero(shares[units])
            code = np.zeros(len(units), np.int64)
            code[where] = coded_.indices.to_numpy() if len(coded_) else 0
            pairs, times = np.unique(doc_of[rare] * (len(coded_.dictionary) + 1) + code[rare], return_counts=True)
            cuts = np.searchsorted(pairs // (len(coded_.dictionary) + 1), np.arange(n + 1)).astype(np.int32)
            texts = coded_.dictionary.take(pa.array(pairs % (len(coded_.dictionary) + 1), pa.int64()))
            state["rid"] += n
            return batch_of(
                schema, np.arange(state["rid"] - n, state["rid"]), batch.column(0), np.diff(offsets), total(held[units].astype(np.int64)),
                total(logs[units] - base_log), total(p), pa.ListArray.from_arrays(cuts, texts), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
            )

        return apply

    ddl = "rid long, id long, n long, known long, base double, own double, rare array<string>, times array<int>"
    rows = written(map_slices(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), step, ddl, budget=2 << 20), "scored")
    pairs = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = pairs.join(model.vocabulary.hint("merge"), "word").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("met"))
    out = rows.drop("rare", "times").join(met, "rid", "left")
    more, met_n = F.coalesce("more", F.lit(0.0)), F.coalesce("met", F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + met_n).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("own") + more).alias("score"))
