"""Benchmark decontamination by latent semantic retrieval (operator 8).

Passages of the corpus are TF-IDF vectors over hashed words. A randomised singular value decomposition
of all of them (one pass that sums A'(A Omega), then the Nystroem form on the driver, of fixed size)
gives a latent space; the benchmark's items have a fixed share of the weight, so that their own
directions are in it.

Every window of every document, at a step of a few words and longer than the item, that holds one of an item's rarest
words (without any of which it can't hold enough) is compared with the item in the latent space: by the inner product with
the item's vector of what the window has of the item's words. A candidate needs what the item's least words in this sense
give, as many of them as must be held, so no window that would be verified is lost, and words beside a passage can't turn
it away (as they turn the cosine of a whole window, which is stated for each finding). Of a candidate the shared words are
counted, and the longest common subsequence of item and window must cover most of the item, and of an item's answer, if it
states one.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Buckets of hashed words; dimensions of the latent space and further columns of the random matrix.
BUCKETS, RANK, MORE = 2048, 40, 8
#: Passages added to the corpus for word weights, so that those of a few passages are nearly even.
FEW = 200
#: Words of a passage for the statistics; words between windows.
PASSAGE, STEP = 64, 8
#: Least share of an item's words in order, and of its answer's.
SAME, SAME_ANSWER = 0.8, 0.8
#: With the answer word for word, a paraphrase needs only this share of the item.
PARAPHRASE = 0.65
#: Low bits of word hashes (as a number of values) by which a window's words are first compared with items.
SHARED = 1 << 14
#: Items of a block, which are compared together, and blocks that one pass over the documents broadcasts.
ITEMS, BLOCKS = 1000, 8
#: Words of documents that a task looks at together, a multiple of passages and steps.
STREAM = 1 << 17
#: Low bits (as a number of values) by which words of items are first looked up.
LOOKUP = 1 << 16
#: Vectors of tasks that are added up together.
FAN = 64
SEED = 7
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_ANSWER = re.compile(r"(?im)^\s*(?:answer|a)\s*:\s*(.+)$")


def word_ids(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in lower case, without ASCII marks."""
    words = (text or "").lower().encode().translate(None, _MARKS).split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; bits of one integer stand for the places in ``a``."""
    places: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    everyone = (1 << len(a)) - 1
    v = everyone
    for x in b:
        if u := v & places.get(x, 0):
            v = (v + u | v - u) & everyone
    return len(a) - v.bit_count()


class Space:
    """Word weights and the latent basis."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray):
        #: The latent vector of one word of each bucket, and of no word.
        self.words = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)

    def vector(self, ids: np.ndarray) -> np.ndarray:
        return self.words[ids % BUCKETS].sum(0)

    def cosine(self, a: np.ndarray, b: np.ndarray) -> float:
        x, y = self.vector(a), self.vector(b)
        return float(x @ y / max(float(np.linalg.norm(x) * np.linalg.norm(y)), 1e-9))


def hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """row and ids (the word hashes as bytes) of every document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([word_ids(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["row", "ids"])

    return docs.select("row", text_col).mapInArrow(common.tidy(work), "row long, ids binary")


def _streams(batches: Iterator[pa.RecordBatch], most: int = STREAM, overlap: int = 0) -> Iterator[tuple]:
    """Rows, all their word hashes in a row, each row's number of words, and the place of its first word in the document.

    Some documents come at a time; long ones in parts, each with the first ``overlap`` words of the next.
    """
    for batch in batches:
        parts, size = [], 0
        for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for begin in range(0, max(len(raw) // 4, 1), most):
                part = raw[4 * begin : 4 * (begin + most + overlap)]
                parts.append((row, part, len(part) // 4, begin))
                size += len(part) // 4
                if size >= most:
                    yield _stream(parts)
                    parts, size = [], 0
        if parts:
            yield _stream(parts)


def _stream(parts: list[tuple]) -> tuple:
    return [p[0] for p in parts], np.frombuffer(b"".join(p[1] for p in parts), np.uint32), np.array([p[2] for p in parts]), [p[3] for p in parts]


def _passages(n_words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each passage (or step), and each document's number of these."""
    count = -(-n_words // length)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.cumsum(n_words) - n_words, count) + inside * length, count


def _matrix(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Word counts of passages by bucket."""
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    flat = which * BUCKETS + ids % BUCKETS
    return np.bincount(flat, minlength=len(starts) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)


def _summed(df: DataFrame, work, size: int) -> np.ndarray:
    """The sum over all tasks of the vectors that ``work`` gives, ``size`` long: fixed blocks of it are added up in Spark, of
    ``FAN`` tasks at a time, level by level, so that no group grows with the number of tasks."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = work(batches)
        if total is not None:
            parts = [total[i : i + 4096] for i in range(0, size, 4096)]
            task = pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32())
            yield pa.RecordBatch.from_arrays([task, pa.array(range(len(parts)), pa.int32()), pa.array([x.astype("<f8").tobytes() for x in parts], pa.binary())], ["task", "block", "part"])

    def add(data: pa.Table) -> pa.Table:
        total = np.zeros(len(data["part"][0].as_py()) // 8)
        for x in data["part"]:
            total += np.frombuffer(x.as_py(), "<f8")
        return pa.table({"task": data["task"].slice(0, 1), "block": data["block"].slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    schema, tasks = "task int, block int, part binary", df.rdd.getNumPartitions()
    level = df.mapInArrow(common.tidy(blocks), schema)
    while True:
        level = level.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task", "block").applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    out = np.zeros(size)
    for r in level.collect():  # a row for each block
        part = np.frombuffer(r["part"], "<f8")
        out[r["block"] * 4096 : r["block"] * 4096 + len(part)] = part
    return out


def fit(rows: DataFrame, items: DataFrame) -> tuple[Space, np.ndarray]:
    """The latent space of all passages, and how many passages have a word of each bucket; both tables are hashed."""
    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS + 1)
        for _, ids, n_words, _ in _streams(batches):
            starts, _ = _passages(n_words, PASSAGE)
            if len(starts):
                seen = np.zeros((len(starts), BUCKETS), bool)
                seen[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids)))), ids % BUCKETS] = True
                total[:-1] += seen.sum(0)
                total[-1] += len(starts)
        return total

    df = _summed(rows, frequencies, BUCKETS + 1)
    idf = np.log((df[-1] + FEW) / (df[:-1] + 1)) ** 2  # words of most passages say little of where a passage comes from
    omega = np.random.default_rng(SEED).standard_normal((BUCKETS, RANK + MORE)).astype(np.float32)
    weight = idf.astype(np.float32)

    def sketched(x: np.ndarray) -> np.ndarray:
        x = x * weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x.T @ (x @ omega)

    def sketch(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((BUCKETS, RANK + MORE))
        for _, ids, n_words, _ in _streams(batches):
            starts, _ = _passages(n_words, PASSAGE)
            if len(starts):
                total += sketched(_matrix(ids, starts))
        return total.ravel()

    y = _summed(rows, sketch, BUCKETS * (RANK + MORE)).reshape(BUCKETS, -1)
    # the items together weigh as much as all passages
    def items_sketch(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS * (RANK + MORE) + 1)
        for _, ids, n_words, _ in _streams(batches):
            n_words = n_words[n_words > 0]
            if len(n_words):
                total[:-1] += sketched(_matrix(ids, np.cumsum(n_words) - n_words)).ravel()
                total[-1] += len(n_words)
        return total

    theirs = _summed(items, items_sketch, BUCKETS * (RANK + MORE) + 1)
    y += theirs[:-1].reshape(BUCKETS, -1) * max(df[-1], 1) / max(theirs[-1], 1)
    # Nystroem: S = A'A is about Y (Omega' Y)^-1 Y'
    q, _ = np.linalg.qr(y)
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-30)
    half = (y @ vectors[:, keep]) / np.sqrt(values[keep]) if keep.any() else np.zeros((BUCKETS, 1))
    u, s, _ = np.linalg.svd(q.T @ half, full_matrices=False)
    return Space(idf, (q @ u)[:, :RANK]), df[:-1]


class Block:
    """Items that are compared together: what each needs, which words it has, and where to look for it.

    An item of n words that needs r of them can't be where none of its n - r + 1 rarest words is, so only windows
    with one of these are compared.
    """

    def __init__(self, items: list[tuple], common_: np.ndarray, space: Space):
        self.items = [i for i in items if len(i[1])]
        #: Steps of an item's windows, without the one more that lets it begin within a step.
        self.steps = np.array([-(-(len(own) + STEP - 1) // STEP) for _, own, _ in self.items], np.int64)
        self.counted = [np.unique(own, return_counts=True) for _, own, _ in self.items]
        # a little less, as shares are rounded
        self.need = np.array([(PARAPHRASE if len(answer) else SAME) * len(own) - 1e-6 for _, own, answer in self.items])
        #: What a word adds to the latent inner product of a window and an item that has it, by the low bits of its hash, in
        #: parts of the item's largest; and the least that the words which a window must hold can add.
        self.near, self.least = np.zeros((SHARED + 1, len(self.items)), np.uint8), np.zeros(len(self.items), np.int64)
        rare = []
        for j, (_, own, _) in enumerate(self.items):
            adds = np.maximum(space.words[own % BUCKETS] @ space.vector(own), 0).astype(float)
            adds = np.minimum(np.ceil(adds * 255 / max(adds.max(), 1e-30)), 255).astype(np.uint8)
            np.maximum.at(self.near[:, j], own % SHARED, adds)
            self.least[j] = np.sort(adds)[: int(np.ceil(self.need[j]))].sum()
            order = np.argsort(common_[own % BUCKETS], kind="stable")
            rare += [(w, j) for w in np.unique(own[order[: len(own) - int(np.ceil(self.need[j])) + 1]]).tolist()]
        rare.sort()
        self.rare, self.rare_item = np.array([r[0] for r in rare], np.uint32), np.array([r[1] for r in rare], np.int64)
        self.lookup = np.zeros(LOOKUP, bool)
        self.lookup[self.rare % LOOKUP] = True

    def windows(self, ids: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (by the step where they begin) and items of which they hold a rare word."""
        hits = np.flatnonzero(self.lookup[ids % LOOKUP])
        lo, hi = (np.searchsorted(self.rare, ids[hits], side) for side in ("left", "right"))
        n = hi - lo
        step = np.repeat(np.searchsorted(starts, hits, "right") - 1, n)
        item = self.rare_item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        begin = np.maximum(step - self.steps[item], first[step])
        n = step - begin + 1
        w = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        cells = np.unique(w * len(self.items) + np.repeat(item, n))
        return cells // len(self.items), cells % len(self.items)

    def candidates(self, low: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether windows (low bits of their words) are near enough in the latent space to hold the items ``of``."""
        return self.near[low, of[:, None]].sum(1) >= self.least[of]


def search(rows: DataFrame, space: Space, blocks: list[Block]) -> DataFrame:
    """row, item, cosine, same, at for each document and item that pass all checks (the best window of a pair).

    Items are triples of a key (long), word hashes, and the answer's word hashes.
    """
    shared = rows.sparkSession.sparkContext.broadcast((space, blocks))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, blocks = shared.value
        overlap = max((int(b.steps.max() + 1) * STEP for b in blocks if len(b.steps)), default=0)
        for names, ids, n_words, begins in _streams(batches, overlap=overlap):
            starts, count = _passages(n_words, STEP)
            if not len(starts):
                continue
            end_word = np.repeat(np.cumsum(n_words), count)
            first = np.repeat(np.cumsum(count) - count, count)
            doc = np.repeat(np.arange(len(count)), count)
            low = np.append(ids % SHARED, SHARED)
            best: dict[tuple[int, int], tuple] = {}
            for block in blocks:
                windows, of = block.windows(ids, starts, first) if block.items else (np.zeros(0, np.int64),) * 2
                for steps in np.unique(block.steps[of]).tolist():
                    mine = block.steps[of] == steps
                    for part in np.array_split(np.flatnonzero(mine), -(-int(mine.sum()) // 20_000)):
                        w, i = windows[part], of[part]
                        place = starts[w][:, None] + np.arange((steps + 1) * STEP)
                        good = block.candidates(low[np.where(place < end_word[w][:, None], place, len(ids))], i)
                        for w, i in zip(w[good].tolist(), i[good].tolist()):
                            key, own, answer = block.items[i]
                            words = ids[starts[w] : min(starts[w] + (steps + 1) * STEP, end_word[w])]
                            if shared_words(*block.counted[i], words) < block.need[i]:
                                continue
                            found = verified(own, answer, words)
                            if found and ((int(doc[w]), key) not in best or found > best[int(doc[w]), key][1]):
                                d = int(doc[w])
                                best[d, key] = space.cosine(own, words[: steps * STEP]), found, begins[d] + int(starts[w] - (end_word[w] - n_words[d]))
            if best:
                hits = [(names[d], key, *v) for (d, key), v in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array([h[j] for h in hits], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], ["row", "item", "cosine", "same", "at"])

    return rows.mapInArrow(common.tidy(work), "row long, item long, cosine double, same double, at long")


def shared_words(words: np.ndarray, times: np.ndarray, ids: np.ndarray) -> int:
    """How many words of an item (distinct ones in order, and how often it has each) can be matched one to one with others."""
    at = np.minimum(np.searchsorted(words, ids), len(words) - 1)
    return int(np.minimum(np.bincount(at[words[at] == ids], minlength=len(words)), times).sum())


def verified(item: np.ndarray, answer: np.ndarray, words: np.ndarray) -> float:
    """The share of the item that the words hold in order, or 0 if that is too little."""
    theirs = words.tolist()
    same = common_subsequence(item.tolist(), theirs) / len(item)
    if len(answer):
        told = common_subsequence(answer.tolist(), theirs) / len(answer)
        return same if same >= SAME and told >= SAME_ANSWER or same >= PARAPHRASE and told == 1 else 0.0
    return same if same >= SAME else 0.0


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it holds: id, item_id, cosine, same, at (word where the window begins).

    Ids may be of any type; the texts of items of one id are items each. ``same`` is the share of the item's words that the
    window holds in order. Null and empty texts hold nothing, and
    such items are held by nothing; repeated rows are found each. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    named = docs.select(id_col, F.xxhash64(id_col, text_col).alias("row"), text_col)
    asked = items.select(F.col(item_col).alias("item_id"), F.xxhash64(item_col, item_text).alias("row"), F.col(item_text).alias("__text")).dropDuplicates(["row"])
    rows, _ = common.keep_written(hashed(named, text_col), "hashed")
    asked = common.checkpoint(asked)
    n = asked.count()
    if not n:
        return named.select(id_col, F.lit(None).cast(asked.schema["item_id"].dataType).alias("item_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("cosine", "double"), ("same", "double"), ("at", "long")))).where("false")
    space, held = fit(rows, hashed(asked, "__text"))
    out, blocks = None, -(-n // ITEMS)
    for b in range(0, blocks, BLOCKS):
        made = []
        for k in range(b, min(b + BLOCKS, blocks)):  # about ITEMS rows each
            part = asked.where(F.pmod("row", F.lit(blocks)) == k).select("row", "__text").collect()
            made.append(Block([(r[0], word_ids(r[1]), word_ids(" ".join(_ANSWER.findall(r[1] or "")))) for r in part], held, space))
        found = search(rows, space, made)
        out = found if out is None else out.unionByName(found)
    found = out.join(asked.select(F.col("row").alias("item"), "item_id"), "item")
    found = found.groupBy("row", "item_id").agg(F.max(F.struct("same", "cosine", "at")).alias("x"))
    return named.select(id_col, "row").join(found, "row").select(id_col, "item_id", "x.cosine", "x.same", "x.at")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; all their columns."""
    named = docs.withColumn("__row", F.xxhash64(id_col, text_col))
    bad = leaks(docs.select(F.xxhash64(id_col, text_col).alias("__row"), text_col), items, "__row", text_col).select("__row").distinct()
    return named.join(bad, "__row", "left_anti").drop("__row")


def op8_decontaminate(spark, sf_dir):
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
