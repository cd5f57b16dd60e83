"""Class-based bigram language model with Brown classes (operator 9).

The exchange algorithm places units: the ``WORDS`` most frequent words of the training texts, and the other
words of one shape (last letters, length, kind of characters) as one unit. It counts every bigram of units. The
``FIRST`` most frequent words and the shapes move first, one by one, to the class that gives the training text the
highest likelihood, until a round moves none; the other words are inserted in the order of their counts, and then all
units move again. The bigrams stay in a table that tasks read. Units move in parts of ``PART``: while a part moves, the
classes of all other units stand still, so the driver needs only the part's own bigrams and its counts beside each class,
which has a fixed bound, and moves units as if it held all bigrams. Every other word of ``LEAST`` training tokens, however many such words there are, is put into
the class under which its own contexts are likeliest. Only rarer and unseen words keep their shape's class. All words thus
have classes, and

    P(word | previous) = P(class | class of previous) * (count + 1) / (mass of the class + 1)

where a class's mass is the sum of (count + 1) over its words, and the one left over is for its unseen
words. Class transitions are smoothed towards the class shares, so each conditional distribution sums to
one over known words and one unseen word for each class.

Words don't fit one machine. Tasks first gather the words of a chunk of documents. Units' counts and classes are known
everywhere. Of each other distinct word goes one row, with the classes before and after its training occurrences; these
rows meet at the word, where its count and class are found, and return to their chunk, which has the documents as places
in its list of words. So the documents' classes are written, their bigrams summed, and the sums of each document made. A
word that meets elsewhere has less than 1 / WORDS of all tokens, and one row for each chunk, not for each document;
the numbers of parts grow with the tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words that are units of their own, the most frequent of these that move first; units of shapes; classes.
WORDS, FIRST, SHAPES, CLASSES = 16_000, 500, 512, 48
#: Exchange counts bigrams with a shape or one of this many most frequent words: of all words and the end, so it counts all.
FRAMES = WORDS + 1
#: Units that move as one part; bigrams of units in a row of their table.
PART, ROW_PAIRS = 2048, 1 << 16
#: Deals of the pairs at least; each is summed in one task.
DEALS = 16
#: Rounds of exchange of frames at most, and of all units; weight of the class shares in a class's transitions.
ROUNDS, ALL_ROUNDS, PRIOR = 12, 1, 48.0
#: Training tokens of one part of the words' exchange.
PART_TOKENS = 4_000_000
#: Least training count of a word that gets a class of its own contexts.
LEAST = 2
#: The end of a document: no word holds white space.
END = b"\n"
#: Text bytes of a chunk of documents, about; entries of a worker's memo of words.
CHUNK_BYTES, MEMO = 14 << 20, 300_000
SEED = 42


def tokens(raw: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    words = raw.lower().split()
    words.append(END)
    return words


def word_key(word: bytes) -> int:
    """A signed 64-bit hash that stands for a word (two of 10**8 words share one with chance 0.0003)."""
    h = xxhash.xxh64_intdigest(word, SEED)
    return h - (1 << 64) if h >> 63 else h


def shape(word: bytes) -> int:
    """The number of the word's shape."""
    core = word.rstrip(b".,;:!?")
    kind = (core.isalpha() << 2) | (core.isdigit() << 1) | (len(core) != len(word))
    return crc32(core[-2:] + bytes((min(len(core) // 3, 4), kind))) % SHAPES


class Model:
    """Tables that score tokens; small enough to send to all tasks. ``units`` numbers words by key; shapes come after them."""

    def __init__(self, units: dict[int, int], counts: np.ndarray, classes: np.ndarray, log_move: np.ndarray, log_mass: np.ndarray):
        self.units, self.counts, self.classes, self.log_move, self.log_mass = units, counts, classes, log_move, log_mass

    def unit_memo(self) -> common.Memo:
        own, n, digest = {k & (1 << 64) - 1: i for k, i in self.units.items()}, len(self.units), xxhash.xxh64_intdigest

        def make(w: bytes) -> int:
            unit = own.get(digest(w, SEED))
            return n + shape(w) if unit is None else unit

        return common.Memo(make, MEMO)

    def units_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keys and units of many distinct words."""
        keys = np.fromiter(map(word_key, words), np.int64, len(words))
        own = np.fromiter(self.units, np.int64, len(self.units))
        order = np.argsort(own)
        at = order[np.minimum(np.searchsorted(own, keys, sorter=order), len(own) - 1)]
        units = np.fromiter(self.units.values(), np.int64, len(own))[at]
        others = np.flatnonzero(own[at] != keys)
        units[others] = np.fromiter((len(own) + shape(words[i]) for i in others.tolist()), np.int64, len(others))
        return keys, units

    def class_score(self, classes: np.ndarray) -> float:
        """Sum of log10 P(class | class before) / (mass + 1): all of the model but the words' counts."""
        before = np.empty_like(classes)
        before[0], before[1:] = classes[-1], classes[:-1]  # a document begins after an end
        return float(self.log_move[before, classes].sum() - self.log_mass[classes].sum())


class Exchange:
    """The exchange algorithm over sparse bigram counts, of some units at a time."""

    def __init__(self, units: int, classes: int):
        self.units, self.k = units, classes
        self.at = np.full(units, -1)
        self.right, self.left = np.zeros((units, classes)), np.zeros((units, classes))  # counts before and after each class
        self.table = np.zeros((classes, classes))
        self.heat = np.zeros((classes, classes))  # the table's entropies

    def load(self, part: np.ndarray, right: np.ndarray | float, left: np.ndarray | float, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        """Take the units that move next: their counts before and after the classes of all other units, and ``n`` of unit ``a``
        before unit ``b`` among themselves."""
        self.own = np.bincount(a[a == b], n[a == b], self.units)
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        self.after = np.searchsorted(a[by_a], np.arange(self.units + 1)), b[by_a], n[by_a].astype(float)
        self.before = np.searchsorted(b[by_b], np.arange(self.units + 1)), a[by_b], n[by_b].astype(float)
        self.right[part], self.left[part] = right, left
        for counts, unit, other in ((self.right, a, b), (self.left, b, a)):
            placed = self.at[other] >= 0
            cells = unit[placed].astype(np.int64) * self.k + self.at[other[placed]]
            counts += np.bincount(cells, n[placed], self.units * self.k).reshape(self.units, self.k)

    @staticmethod
    def entropy(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    def _shift(self, u: int, c: int, sign: float) -> None:
        """Count unit ``u`` as one of class ``c`` among its neighbours' counts, or no longer."""
        starts, units, n = self.before
        part = slice(starts[u], starts[u + 1])
        self.right[units[part], c] += sign * n[part]
        starts, units, n = self.after
        part = slice(starts[u], starts[u + 1])
        self.left[units[part], c] += sign * n[part]

    def _put(self, c: int, r: np.ndarray, l: np.ndarray, own: float, sign: float) -> None:
        self.table[c] += sign * r
        self.table[:, c] += sign * l
        self.table[c, c] += sign * own
        self.heat[c], self.heat[:, c] = self.entropy(self.table[c]), self.entropy(self.table[:, c])

    def _counts(self, u: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Counts of the unit before and after the classes, without itself, and of itself after itself."""
        r, l, own, c = self.right[u].copy(), self.left[u].copy(), self.own[u], self.at[u]
        if c >= 0:
            r[c] -= own
            l[c] -= own
        return r, l, own

    def enter(self, u: int, c: int) -> None:
        """Put a unit that has no class into one."""
        r, l, own = self._counts(u)
        self._put(c, r, l, own, 1.0)
        self.at[u] = c
        self._shift(u, c, 1.0)

    def best(self, r: np.ndarray, l: np.ndarray, own: float) -> int:
        """The class in which a unit outside all classes gives the highest likelihood."""
        table, heat, entropy = self.table, self.heat, self.entropy
        rows = entropy(table + r).sum(1) - heat.sum(1)
        cols = entropy(table + l[:, None]).sum(0) - heat.sum(0)
        d = table.diagonal()
        both = entropy(d + r + l + own) - entropy(d + r) - entropy(d + l) + entropy(d)
        rs, cs = table.sum(1), table.sum(0)
        r_all, l_all = r.sum() + own, l.sum() + own
        return int(np.argmax(rows + cols + both - entropy(rs + r_all + l) - entropy(cs + l_all + r) + entropy(rs + l) + entropy(cs + r)))

    def insert(self, units: np.ndarray) -> None:
        for u in units.tolist():
            self.enter(u, self.best(*self._counts(u)))

    def round(self, units: np.ndarray) -> int:
        """Move units one by one to their best classes; how many moved."""
        moved = 0
        for u in units.tolist():
            c, (r, l, own) = self.at[u], self._counts(u)
            self._put(c, r, l, own, -1.0)
            best = self.best(r, l, own)
            if best != c:
                self._shift(u, c, -1.0)
                r, l = self.right[u].copy(), self.left[u].copy()
                self._put(best, r, l, own, 1.0)
                self._shift(u, best, 1.0)
                self.at[u] = best
                moved += 1
            else:
                self._put(c, r, l, own, 1.0)
        return moved

    def run(self, size: np.ndarray, first: np.ndarray | None, rounds: int, all_rounds: int, part: int, load) -> np.ndarray:
        """Classes of all units, given their counts and what loads a part; those without counts are in class 0."""
        order = np.argsort(-size, kind="stable")
        seen = order[size[order] > 0]
        begin = seen if first is None else seen[np.isin(seen, first)]
        rest = seen[~np.isin(seen, begin)]
        parts = lambda units: (units[i : i + part] for i in range(0, len(units), part))
        load(begin)
        for i, u in enumerate(begin.tolist()):
            self.enter(u, i % self.k)
        for _ in range(rounds):
            if not self.round(begin):
                break
        for units in parts(rest):
            load(units)
            self.insert(units)
        for _ in range(all_rounds if len(rest) else 0):
            moved = 0
            for units in parts(seen):
                load(units)
                moved += self.round(units)
            if not moved:
                break
        return np.maximum(self.at, 0)


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, units: int, classes: int, first: np.ndarray | None = None, rounds: int = ROUNDS, all_rounds: int = ALL_ROUNDS) -> np.ndarray:
    """Classes of units from their sparse bigram counts: units of ``first`` (None: all) move first, then the others are
    inserted and all move. Units without counts are in class 0."""
    made = Exchange(units, classes)
    made.load(np.arange(units), 0.0, 0.0, a, b, n)
    return made.run(np.bincount(a, n, units) + np.bincount(b, n, units), first, rounds, all_rounds, units, lambda part: None)


def _training(held: int, folds: int):
    """Whether a row (id as text) is for training; rows with a null id are."""
    return lambda one: one is None or crc32(str(one).encode()) % folds != held


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), common.utf8(batch.column(1).to_pylist()))


def word_counts(docs: DataFrame, held: int, folds: int) -> DataFrame:
    """key, c, shape of every training word."""
    training = _training(held, folds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(map(word_key, words), pa.int64()), pa.array(counts.values(), pa.int64()), pa.array(map(shape, words), pa.int32())], ["key", "c", "shape"])

        counts: Counter = Counter()
        for one, raw in _texts(batches):
            if training(one):
                counts.update(tokens(raw))
                if len(counts) > MEMO:
                    yield flush()
                    counts = Counter()
        if counts:
            yield flush()

    made = docs.mapInArrow(work, "key long, c long, shape int")
    return made.groupBy("key").agg(F.sum("c").alias("c"), F.max("shape").alias("shape"))


def unit_bigrams(docs: DataFrame, model: Model, frames: int, held: int, folds: int) -> DataFrame:
    """Counts of units a before b in training texts, with a shape or one of the first ``frames`` units; a text begins after an end.

    A row has many pairs (a * units + b) and their counts as bytes; no pair is in two rows.
    """
    training, words, total = _training(held, folds), len(model.units), len(model.units) + SHAPES
    deals = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), DEALS)

    def merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, which = np.unique(np.concatenate(pairs), return_inverse=True)
        return every, np.bincount(which, np.concatenate(counts), len(every)).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.unit_memo()
        end = np.array([memo[END]])
        pairs, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        line, size = [end], 0

        def add() -> tuple[np.ndarray, np.ndarray]:
            ids = np.concatenate(line)
            new = (ids[:-1] * total + ids[1:]).astype(np.int32)
            if frames < words:
                frame = (ids < frames) | (ids >= words)
                new = new[frame[:-1] | frame[1:]]
            new, n = np.unique(new, return_counts=True)
            return merged([pairs, new], [counts, n])

        for one, raw in _texts(batches):
            if training(one):
                own = tokens(raw)
                line.append(np.fromiter(map(memo.__getitem__, own), np.int64, len(own)))
                size += len(own)
                if size > 1_000_000:
                    pairs, counts = add()
                    line, size = [end], 0
        if size:
            pairs, counts = add()
        # a row for each deal of the pairs: their number doesn't matter to Spark
        deal = pairs % deals
        order = np.argsort(deal, kind="stable")
        stops = np.searchsorted(deal[order], np.arange(deals + 1))
        for k in range(deals):
            for i in range(stops[k], stops[k + 1], ROW_PAIRS):
                at = order[i : min(i + ROW_PAIRS, stops[k + 1])]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x[at].tobytes()], pa.binary()) for x in (pairs, counts))], ["deal", "pair", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deals_: dict[int, list] = {}  # pairs, counts, how many of them, and how many there were when summed last
        for batch in batches:
            for k, pair, n in zip(*(c.to_pylist() for c in batch.columns)):
                deal = deals_.setdefault(k, [[], [], 0, 0])
                deal[0].append(np.frombuffer(pair, "<i4"))
                deal[1].append(np.frombuffer(n, "<i8"))
                deal[2] += len(deal[0][-1])
                if deal[2] > 2 * deal[3] + ROW_PAIRS:
                    pairs, counts = merged(*deal[:2])
                    deal[:] = [pairs], [counts], len(pairs), len(pairs)
        for pairs, counts, _, _ in deals_.values():
            pair, n = merged(pairs, counts)
            for i in range(0, len(pair), ROW_PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array([x[i : i + ROW_PAIRS].astype(t).tobytes()], pa.binary()) for x, t in ((pair, "<i4"), (n, "<i8"))], ["pair", "n"])

    dealt = docs.mapInArrow(common.tidy(work), "deal int, pair binary, n binary").repartition(deals, "deal")
    return dealt.mapInArrow(common.tidy(pack), "pair binary, n binary")


def _pairs(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Units a and b and the counts of rows of bigrams."""
    for batch in batches:
        for pair, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = np.divmod(np.frombuffer(pair, "<i4"), np.int32(total))
            yield a, b, np.frombuffer(n, "<i8")


def exchange_written(bigrams: DataFrame, units: int, classes: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``exchange`` gives for a written table of bigrams, of which only parts come to the driver, and the classes' bigrams."""
    made = Exchange(units, classes)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(units)
        for a, b, n in _pairs(batches, units):
            size += np.bincount(a, n, units) + np.bincount(b, n, units)
        yield pa.RecordBatch.from_arrays([pa.array([size.tobytes()], pa.binary())], ["size"])

    def load(part: np.ndarray) -> None:
        local, at, k = np.full(units, -1, np.int32), made.at.astype(np.int32), len(part)
        local[part] = np.arange(k)
        outside = np.where(local < 0, at, -1)  # classes of the others

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides, inner = np.zeros((2, k * classes)), [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
            for a, b, n in _pairs(batches, units):
                mine = local[a], local[b]
                for side, (own, other) in enumerate(((mine[0], outside[b]), (mine[1], outside[a]))):
                    at_ = np.flatnonzero((own >= 0) & (other >= 0))
                    if len(at_):
                        sides[side] += np.bincount(own[at_] * classes + other[at_], n[at_], k * classes)
                at_ = np.flatnonzero((mine[0] >= 0) & (mine[1] >= 0))
                inner.append((mine[0][at_] * np.int32(k) + mine[1][at_], n[at_]))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sides, *map(np.concatenate, zip(*inner)))], ["sides", "pair", "n"])

        # a row for each task, of which the table's size, bounded by the units, gives some
        found = bigrams.mapInArrow(work, "sides binary, pair binary, n binary").collect()
        sides = sum((np.frombuffer(r["sides"]) for r in found), np.zeros(2 * k * classes)).reshape(2, k, classes)
        pair, n = (np.frombuffer(b"".join(r[x] for r in found), t) for x, t in (("pair", np.int32), ("n", np.int64)))
        del found
        order = np.argsort(pair)
        made.load(part, *sides, part[pair[order] // k], part[pair[order] % k], n[order])

    size = sum((np.frombuffer(r["size"]) for r in bigrams.mapInArrow(sizes, "size binary").collect()), np.zeros(units))
    return made.run(size, first, ROUNDS, ALL_ROUNDS, PART, load), made.table


def _logs(moves: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the transitions, smoothed towards the shares, and of the shares."""
    move = (moves + PRIOR * share / share.sum()) / (moves.sum(1, keepdims=True) + PRIOR)
    return np.log10(move), np.log10(share)


def _shifted(classes: np.ndarray, sizes, by: int = 1) -> np.ndarray:
    """Each document's classes moved on by one place (or back, by -1), around its end."""
    out, ends = np.roll(classes, by), np.cumsum(sizes)
    starts = ends - sizes
    if by == 1:
        out[starts] = classes[ends - 1]
    else:
        out[ends - 1] = classes[starts]
    return out


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def fit(docs: DataFrame, held: int, folds: int) -> tuple[Model, int, int]:
    """The model, the number of training tokens, and of distinct ones; ``docs`` has an id and a text."""
    words = word_counts(docs, held, folds).persist()
    by_shape = words.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    n, v = sum(r["c"] for r in by_shape), sum(r["v"] for r in by_shape)
    frequent = words.orderBy(F.desc("c"), "key").limit(WORDS).collect()  # the exchange's vocabulary, a fixed number
    words.unpersist()
    units = {r["key"]: i for i, r in enumerate(frequent)}
    units.setdefault(word_key(END), len(units))
    counts, mass = np.zeros(len(units), np.int64), np.zeros(len(units) + SHAPES)
    for r in by_shape:
        mass[len(units) + r["shape"]] = r["c"] + r["v"]
    for r in frequent:
        counts[units[r["key"]]] = r["c"]
        mass[units[r["key"]]] = r["c"] + 1
        mass[len(units) + r["shape"]] -= r["c"] + 1
    total = len(units) + SHAPES
    bigrams, path = common.keep_written(unit_bigrams(docs, Model(units, counts, None, None, None), FRAMES, held, folds), "bigrams")
    classes, moves = exchange_written(bigrams, total, CLASSES, np.append(np.arange(min(FIRST, FRAMES, len(units))), np.arange(len(units), total)))
    common.remove(docs.sparkSession, path)
    return Model(units, counts, classes, *_logs(moves, np.bincount(classes, mass, CLASSES) + 1)), n, v


def _packed(word: np.ndarray) -> bytes:
    """Places of words as compressed bytes: the number of them, then planes of their bytes."""
    return len(word).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(word.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(body: bytes) -> np.ndarray:
    n = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def insert(shapes: np.ndarray, counts: np.ndarray, before: np.ndarray, after: np.ndarray, log_move: np.ndarray, log_mass: np.ndarray) -> np.ndarray:
    """The classes of words: those under which their training contexts are likeliest, the shape's class on ties.

    ``shapes`` has the classes of the words' shapes; rows of ``before`` and ``after`` count classes of neighbours.
    """
    gain = before @ log_move + after @ log_move.T - counts[:, None] * log_mass
    rows = np.arange(len(gain))
    best = gain.argmax(1)
    return np.where(gain[rows, best] > gain[rows, shapes] + 1e-9, best, shapes)


def score_texts(df: DataFrame, held: int = 2, folds: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row.

    Training rows are those whose crc32 of the id as text, modulo ``folds``, isn't ``held``; a null id
    trains. A null text counts as empty: one token, the end. Repeated rows train and are scored as rows of
    their own. Without training rows all counts are 0 and every token has the same probability.
    """
    spark = df.sparkSession
    common.small_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    model, n, v = fit(docs, held, folds)
    common.sweep(spark)  # the shuffles of the fit are done
    shared = spark.sparkContext.broadcast(model)
    training = _training(held, folds)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, serial = shared.value, TaskContext.get().partitionId(), 0
        n_units, id_kind = len(model.units), pa.null()
        names = ["key", "chunk", "place", "c", "class", "body"]
        number = _Numbers()
        texts, own, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk, rows = part << 32 | serial, len(number)
            word = np.concatenate(texts)
            keys, unit = model.units_of(list(number))
            classes = model.classes[unit].astype(np.uint8)
            later = unit >= n_units
            sizes = np.array([o[2] for o in own])
            trains = np.repeat([not o[1] for o in own], sizes)
            train = np.bincount(word[trains], minlength=rows)
            # classes before and after each training occurrence of a word that exchange hasn't placed
            each = classes[word]
            context = np.stack([_shifted(each, sizes), _shifted(each, sizes, -1)], axis=1)
            at = np.flatnonzero(trains & later[word])
            at = at[np.argsort(word[at], kind="stable")]
            places = np.flatnonzero(later)
            offsets = pa.array(np.concatenate([[0], np.cumsum(train[places])]) * 2, pa.int32())
            bodies = pa.Array.from_buffers(pa.binary(), len(places), [None, offsets.buffers()[1], pa.py_buffer(context[at].tobytes())])
            for i in range(0, len(places), 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(i, 50_000) for x in (pa.array(keys[places]), pa.array(np.full(len(places), chunk)), pa.array(places, pa.int32()), pa.array(train[places], pa.int64()), pa.array(classes[places], pa.int16()), bodies)], names)
            # the documents' own values, words and units, under a key of their own and a count that no word has
            values = pa.RecordBatch.from_arrays([pa.array([o[i] for o in own], k) for i, k in enumerate((id_kind, pa.bool_(), pa.int64()))], ["id", "held_out", "n_tokens"])
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), values.schema) as writer:
                writer.write_batch(values)
            known = np.where(later, -1, unit).astype("<i4").tobytes()
            for kind, body in ((-1, sink.getvalue().to_pybytes()), (-2, _packed(word)), (-3, known)):
                yield pa.RecordBatch.from_arrays([pa.array([word_key(b"\0 %d" % chunk)]), pa.array([chunk]), pa.array([-1], pa.int32()), pa.array([kind]), pa.array([0], pa.int16()), pa.array([body], pa.binary())], names)

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for one, raw in _texts([batch]):
                words = tokens(raw)
                texts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                own.append((one, not training(one), len(words)))
                size += len(raw) + 500
                if size > CHUNK_BYTES:
                    yield from flush()
                    number, texts, own, size, serial = _Numbers(), [], [], 0, serial + 1
        if own:
            yield from flush()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The training count and the class of each word, for every chunk that has it; rows come in the order of keys."""
        model = shared.value

        def contexts(rows: pa.Table, which: np.ndarray, n: int) -> np.ndarray:
            """Counts of the classes before and after the words that ``which`` numbers."""
            is_word = rows["c"].to_numpy() >= 0
            bodies = rows["body"].combine_chunks()
            lengths = pa.compute.fill_null(pa.compute.binary_length(bodies), 0).to_numpy(zero_copy_only=False) // 2 * is_word
            seen = np.frombuffer(b"".join(b for b, w in zip(bodies.to_pylist(), is_word.tolist()) if w and b), np.uint8).reshape(-1, 2)
            at = np.repeat(which, lengths) * CLASSES
            return np.stack([np.bincount(at + seen[:, i], minlength=n * CLASSES).reshape(-1, CLASSES) for i in (0, 1)])

        def placed(rows: pa.Table, carried: np.ndarray | int) -> pa.RecordBatch:
            key, c, kind = (rows[x].to_numpy() for x in ("key", "c", "class"))
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            is_word = c >= 0
            total = np.where(is_word, np.bincount(which, weights=np.maximum(c, 0))[which].astype(np.int64), c)
            around = contexts(rows, which, len(starts))
            around[:, 0] += carried
            old = kind[starts]
            own = total[starts] >= LEAST
            classes = np.where(own, insert(old, total[starts], *around, model.log_move, model.log_mass), old)
            first = np.zeros(len(key), bool)
            first[starts] = True
            body = pa.compute.if_else(pa.array(is_word), pa.scalar(None, pa.binary()), rows["body"].combine_chunks())
            return pa.RecordBatch.from_arrays([rows["chunk"].combine_chunks(), rows["place"].combine_chunks(), pa.array(total), pa.array(classes[which], pa.int16()), pa.array(first & (total > 0)), body], ["chunk", "place", "c", "class", "first", "body"])

        kept, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if kept is not None and kept["key"][0].as_py() == rows["key"][0].as_py() == rows["key"][-1].as_py() and rows["c"][0].as_py() >= 0:
                # a word that goes on: only its counts, places and contexts' sums are kept
                carried = carried + contexts(rows, np.zeros(len(rows), np.int64), 1)[:, 0]
                rows = rows.set_column(rows.schema.get_field_index("body"), "body", pa.nulls(len(rows), pa.binary()))
            kept = rows if kept is None else pa.concat_tables([kept, rows])
            last = kept["key"][-1].as_py()
            done = int(np.searchsorted(kept["key"].to_numpy(), last))
            if done:
                yield placed(kept.slice(0, done), carried)
                kept, carried = kept.slice(done), 0
        if kept is not None:
            yield placed(kept, carried)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_TOKENS))
    gathered = docs.mapInArrow(gather, "key long, chunk long, place int, c long, class short, body binary")
    met = gathered.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(place, "chunk long, place int, c long, class short, first boolean, body binary")

    def finish(data: pa.Table) -> pa.Table:
        """The sums of a chunk's documents, their classes in order, and how many words of each class the chunk is first to have."""
        kind = data["c"].to_numpy()
        body = lambda k: data["body"][int(np.flatnonzero(kind == k)[0])].as_py()
        own, word, unit = pa.ipc.open_stream(body(-1)).read_all(), _unpacked(body(-2)), np.frombuffer(body(-3), "<i4")
        of_words = kind >= 0
        at = data["place"].to_numpy()[of_words]
        model, c, classes = shared.value, np.zeros(len(unit), np.int64), np.zeros(len(unit), np.uint8)
        known = unit >= 0
        c[known], classes[known] = model.counts[unit[known]], model.classes[unit[known]]
        c[at], classes[at] = kind[of_words], data["class"].to_numpy()[of_words]
        firsts = np.bincount(classes[at[data["first"].to_numpy()[of_words]]], minlength=CLASSES)
        sizes, docs_n = own["n_tokens"].to_numpy(), own.num_rows
        doc = np.repeat(np.arange(docs_n), sizes)
        n_known = np.bincount(doc, weights=(c > 0)[word], minlength=docs_n)
        logs = np.bincount(doc, weights=np.log10(c + 1.0)[word], minlength=docs_n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        path = pa.Array.from_buffers(pa.binary(), docs_n, [None, offsets.buffers()[1], pa.py_buffer(classes[word].tobytes())])
        return pa.table({"id": own["id"], "held_out": own["held_out"], "n_known": n_known.astype(np.int64), "logs": logs, "path": path, "firsts": pa.array([firsts.astype("<i8").tobytes()] + [None] * (docs_n - 1), pa.binary())})

    made = met.repartition(parts, "chunk").groupBy("chunk").applyInArrow(finish, f"id {id_type}, held_out boolean, n_known long, logs double, path binary, firsts binary")
    paths, _ = common.keep_written(made, "classes")

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class bigrams of training rows, then distinct words of each class."""
        total = np.zeros(CLASSES * CLASSES + CLASSES, np.int64)
        for batch in batches:
            for held_out, path, firsts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not held_out:
                    each = np.frombuffer(path, np.uint8).astype(np.int64)
                    total[:-CLASSES] += np.bincount(_shifted(each, [len(each)]) * CLASSES + each, minlength=CLASSES * CLASSES)
                if firsts:
                    total[-CLASSES:] += np.frombuffer(firsts, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "n"])

    total = np.zeros(CLASSES * CLASSES + CLASSES)
    for r in paths.select("held_out", "path", "firsts").mapInArrow(moves, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    table = total[:-CLASSES].reshape(CLASSES, CLASSES)
    total[-CLASSES:] += np.bincount(model.classes[: len(model.units)], model.counts > 0, CLASSES)
    final = spark.sparkContext.broadcast(Model({}, model.counts[:0], model.classes[:0], *_logs(table, table.sum(0) + total[-CLASSES:] + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, logs = batch.column(3).to_pylist(), batch.column(2).to_numpy()
            tokens_n = np.array([len(p) for p in every], np.int64)
            got = logs + np.array([final.value.class_score(np.frombuffer(p, np.uint8)) for p in every], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens_n), batch.column(4), pa.array(np.full(len(every), n, np.int64)), pa.array(logs - tokens_n * np.log10(n + v + 1.0)), pa.array(got), pa.array(10.0 ** (-got / tokens_n))], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    out = paths.select("id", "held_out", "logs", "path", "n_known").mapInArrow(score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return out.withColumnRenamed("id", id_col)


def op9_brown(spark, sf_dir):
    return score_texts(common.table(spark, sf_dir, "documents"))
