"""Content-addressed store of token ids (operator 10).

Each document's id stream is cut where a rolling hash of the last ids meets a mask, so equal passages
tend to give equal chunks wherever they stand. The store is a folder of Parquet tables:

``objects/kind=0``  key, body   each distinct chunk once: its ids under the SHA-256 of the bytes
``objects/kind=1``  key, body   each distinct recipe once: its chunks' hashes under the SHA-256 of these
``documents``       doc_id, root, n_tokens, part, before   in order of doc_id, in range parts
``manifest``        level, node, hash, n   Merkle tree over the chunk hashes, one root at the top level

Ids are little-endian unsigned integers of 16 bits if the vocabulary allows, else of 32 (``item`` in the
manifest). Reading hashes every chunk and recipe anew and compares. A document's CRC-32 follows from its
chunks' CRC-32s and lengths, so the chunks need not travel to be checked.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Entries of a worker's memo of words; words longer than this many bytes are not kept.
MEMO_WORDS, MEMO_BYTES = 300_000, 48
#: Texts whose new words are encoded at a time: those that come again later are known by then.
TEXTS = 250
#: Marks after a word that its letters don't join: ASCII ones without the apostrophe, after which letters may be a unit.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
#: Ids that the rolling hash sees (a power of two); least, usual and most ids of a chunk; ids that are hashed at a time.
WINDOW, LEAST, USUAL, MOST, MARKED = 8, 64, 512, 2048, 1 << 14
#: Chunk hashes under one leaf of the Merkle tree, about; children of an inner node (2 to this power).
LEAF, FAN_BITS = 1024, 8


class _Known(dict):
    """Ids of words; words that it lacks are noted, time after time, and have None."""

    def __init__(self):
        super().__init__()
        self.lost: list[bytes] = []

    def __missing__(self, word: bytes) -> None:
        self.lost.append(word)


class WordEncoder:
    """Ids of whole texts from a tokenizer whose units never reach across ASCII white space.

    The library encodes each distinct word; a text's ids are the join of its words' ids. This holds for
    vocabularies that drop white space and split by pattern, which ``__init__`` checks on the settings.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        dropped = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        self.by_word = dropped and all(" " not in t["content"] for t in spec["added_tokens"])
        kinds = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lower = "Lowercase" in kinds
        #: Where one of these is, A-Z aren't lowered ahead of the library: beginnings of special strings, and lead bytes of
        #: the marks that compose with letters, with small ones perhaps where they don't with large ones.
        self.marks = [t["content"][:2].encode() for t in spec["added_tokens"]] + [b"\xcc", b"\xcd"]
        self.library = Tokenizer.from_file(path)
        #: Without the steps that leave words of small ASCII letters as they are, if the settings have no others; else None.
        self.small = None
        split = [a for a in steps[0].get("pattern", {}).get("Regex", "").split("|") if not a.startswith("'")] if dropped else []
        as_is = split[:1] in (["[\\p{L}]+"], ["\\p{L}+"]) and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in steps[1:]] == [("ByteLevel", False, False)]
        as_is &= all(n.get("type") in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": "\\s+"} for n in (spec["normalizer"] or {}).get("normalizers", []))
        if self.by_word and as_is and not spec["post_processor"] and not any(t["content"].isalpha() for t in spec["added_tokens"]):
            self.small = Tokenizer(self.library.model)
            self.small.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab, suffix = self.library.get_vocab(), spec["model"].get("end_of_word_suffix")
        #: Ids that end a unit, if the vocabulary marks these.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.kind = "<u2" if len(self.ends) <= 65_536 else "<u4"
        self.known, self.before = _Known(), _Known()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[bytes], library) -> list[bytes]:
        """Ids of words of letters only, many in one text: each is one unit and so ends at the first id
        that ends a unit. A group where the ends don't number the words is encoded word by word."""
        out: list[bytes] = []
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, found in zip(groups, library.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(stops) == len(group):
                raw, stops = ids.tobytes(), stops.tolist()
                out += [raw[a:b] for a, b in zip([0, *stops], stops)]
            else:
                out += self._ids([w.decode() for w in group])
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian integers of ``kind``."""
        if not self.by_word:
            return self._ids([t.decode() for t in texts])
        return [ids for i in range(0, len(texts), TEXTS) for ids in self._encode(texts[i : i + TEXTS])]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > MEMO_WORDS:  # two generations: words in use move on
            self.before, self.known = self.known, _Known()
        known, before = self.known, self.before
        known.lost = lost = []
        rows: list[tuple] = []
        for t in texts:  # one text's words at a time, which the processor's caches hold
            n = len(lost)
            ids = list(map(known.__getitem__, (t.lower() if self.lower and not any(m in t for m in self.marks) else t).split()))
            rows.append((ids, True) if len(lost) > n else (b"".join(ids), False))
        if not lost:
            return [ids for ids, _ in rows]
        new = set(lost)
        made = {w: before[w] for w in new if w in before}
        new.difference_update(made)
        plain, other, ended = set(), set(), []
        for w in new:
            if w.isalpha():
                plain.add(w)
                continue
            base = w.rstrip(MARKS)
            if base.isalpha() or self.letters(base):
                plain.add(base)
                if len(base) < len(w):
                    other.add(w[len(base) :])
                    ended.append((w, len(base)))
            else:
                other.add(w)
        small = {w for w in plain if w.isalpha() and w.islower()} if self.small else set()
        of_small, of_plain = (lambda ws, library=library: self._word_ids(ws, library) for library in (self.small, self.library))
        for words_, ids_of in ((small, of_small), (plain - small, of_plain), (other, lambda ws: self._ids([w.decode() for w in ws]))):
            for memo in (known, before):  # parts of new words
                made.update([(w, memo[w]) for w in words_ if w in memo])
            asked = list(words_.difference(made))
            made.update(zip(asked, ids_of(asked)))
        made.update([(w, made[w[:cut]] + made[w[cut:]]) for w, cut in ended])
        known.update(made)
        for w in other:
            if len(w) > MEMO_BYTES:
                del known[w]
        found = map(made.__getitem__, lost)
        return [b"".join([next(found) if x is None else x for x in ids]) if some else ids for ids, some in rows]

    def letters(self, word: bytes) -> bool:
        """Whether a word is letters only, before and after the library normalizes it, and so one unit that marks don't join."""
        if word.isalpha():  # ASCII
            return True
        text = word.decode()
        if not text.isalpha():
            return False
        made = unicodedata.normalize("NFC", text)
        return (made.lower() if self.lower else made).isalpha()


_encoders: dict[str, WordEncoder] = common.kept_by(__name__)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last ``WINDOW`` ids asks for a cut."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    usual, found = np.uint32(USUAL - LEAST), [np.zeros(0, np.int64)]
    for start in range(0, len(ids), MARKED):
        before = min(WINDOW - 1, start)
        rolled = mixed[start - before : start + MARKED]
        step = 1
        while step < WINDOW:  # sums over twice as many ids
            wide = rolled.copy()
            wide[step:] += rolled[:-step] * np.uint64(pow(0xBF58476D1CE4E5B9, step, 1 << 64))
            rolled, step = wide, 2 * step
        high = (rolled[before:] >> np.uint64(40)).astype(np.uint32)
        found.append(np.flatnonzero(high // usual * usual == high) + start + 1)
    return np.concatenate(found)


def cuts(marked: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids: at marks, but at least and at most so far apart.

    The least length hides the marks whose window reaches back before the stream.
    """
    ends, start = [], 0
    for mark in [*marked, n]:
        while mark - start > MOST:
            start += MOST
            ends.append(start)
        if mark - start >= LEAST or mark == n and mark > start:
            start = mark
            ends.append(start)
    return ends


def write_store(df: DataFrame, vocabulary: str, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write the store to ``path``.

    A null text counts as empty: with ``end_id`` it has that one id, else none. Repeated rows are kept,
    each with its own place; equal ids are ordered by their recipe. An empty table gives an empty store.
    Columns other than the two named are not read.
    """
    spark = df.sparkSession
    common.small_batches(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    kind = encoder(vocabulary).kind
    item = int(kind[2])
    end = b"" if end_id is None else int(end_id).to_bytes(item, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, serial = encoder(vocabulary), TaskContext.get().partitionId(), 0
        seen: set[bytes] = set()
        for batch in batches:
            streams = [x + end for x in enc.encode(common.utf8(batch.column(1).to_pylist()))]
            marked = marks(np.frombuffer(b"".join(streams), kind))
            lengths = np.array([len(x) // item for x in streams], np.int64)
            stops = np.cumsum(lengths)
            split = np.searchsorted(marked, stops, side="right").tolist()
            kinds, keys, bodies, roots, first, base = [], [], [], [], 0, 0
            for ids, n, last in zip(streams, lengths.tolist(), split):
                start, recipe = 0, b""
                for stop in cuts((marked[first:last] - base).tolist(), n):
                    body = ids[item * start : item * stop]
                    sha = hashlib.sha256(body).digest()
                    recipe += sha
                    start = stop
                    if sha not in seen:
                        seen.add(sha)
                        kinds.append(0)
                        keys.append(sha)
                        bodies.append(body)
                first, base = last, base + n
                roots.append(root := hashlib.sha256(recipe).digest())
                if root not in seen:
                    seen.add(root)
                    kinds.append(1)
                    keys.append(root)
                    bodies.append(recipe)
            more, rows = len(kinds), len(roots)
            keys += [b"%d/%d" % (part, serial + i) for i in range(rows)]
            serial += rows
            if len(seen) > 300_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([
                pa.array(kinds + [2] * rows, pa.int32()), pa.array(keys, pa.binary()), pa.array(bodies + roots, pa.binary()),
                pa.concat_arrays([pa.nulls(more, batch.column(0).type), batch.column(0)]), pa.concat_arrays([pa.nulls(more, pa.int64()), pa.array(lengths)]),
            ], ["kind", "key", "body", id_col, "n_tokens"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*batch.schema.names, "before"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    made = df.select(id_col, text_col).mapInArrow(common.tidy(work), f"kind int, key binary, body binary, {id_col} {id_type}, n_tokens long")
    made = made.repartition(parts, "key").dropDuplicates(["kind", "key"])
    made.write.partitionBy("kind").option("compression", "lz4").parquet(f"{path}/objects")
    rows = spark.read.schema(made.schema).parquet(f"{path}/objects").where("kind = 2").select(id_col, F.col("body").alias("root"), "n_tokens")
    rows = rows.repartitionByRange(parts, id_col, "root").sortWithinPartitions(id_col, "root").withColumn("part", F.spark_partition_id())
    rows.mapInArrow(common.tidy(place), f"{id_col} {id_type}, root binary, n_tokens long, part int, before long").write.parquet(f"{path}/documents")
    merkle(objects(spark, path, 0)).withColumn("item", F.lit(item)).write.parquet(f"{path}/manifest")
    common.remove(spark, f"{path}/objects/kind=2")


def objects(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """The chunks (0) or recipes (1) of a store."""
    return spark.read.schema("kind int, key binary, body binary").parquet(f"{path}/objects").where(F.col("kind") == kind).select("key", "body")


def merkle(chunks: DataFrame) -> DataFrame:
    """The Merkle tree over chunk hashes: leaves hold the sorted hashes that share their first bits."""
    n = chunks.count()
    bits = 0
    while n >> bits > LEAF:
        bits += 1
    prefix = F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long")
    level = chunks.select(F.shiftright(prefix, 32 - bits).alias("node"), F.hex("key").alias("h"))
    level = level.groupBy("node").agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))).cast("binary"), 256).alias("hash"), F.count("*").alias("n"))
    levels = [level.select(F.lit(0).alias("level"), "node", "hash", "n")]
    while bits > 0:
        step = min(bits, FAN_BITS)
        bits -= step
        below = levels[-1].select(F.shiftright("node", step).alias("node"), F.struct("node", "hash").alias("child"), "n")
        level = below.groupBy("node").agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list("child")), lambda c: c["hash"])).cast("binary"), 256).alias("hash"), F.sum("n").alias("n"))
        levels.append(level.select(F.lit(len(levels)).alias("level"), "node", "hash", "n"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def verify_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the Merkle tree of the chunks as stored is the manifest's."""
    key = ["level", "node", "hash", "n"]
    kept, now = spark.read.parquet(f"{path}/manifest").select(key), merkle(objects(spark, path, 0)).select(key)
    return kept.exceptAll(now).isEmpty() and now.exceptAll(kept).isEmpty()


def _shift_tables(bits: int = 40) -> np.ndarray:
    """For each power of two of zero bytes, what these make of a CRC-32, by the CRC's four bytes."""
    step = np.zeros(32, np.uint64)  # the CRC of each single bit after one zero bit
    step[0] = 0xEDB88320
    step[1:] = 1 << np.arange(31, dtype=np.uint64)

    def apply(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where(v >> np.uint64(i) & np.uint64(1), matrix[i], np.uint64(0))
        return out

    for _ in range(3):
        step = apply(step, step)
    byte, out = np.arange(256, dtype=np.uint64), []
    for _ in range(bits):
        out.append([apply(step, byte << np.uint64(8 * k)) for k in range(4)])
        step = apply(step, step)
    return np.array(out, np.uint64)


def joined_crc(before: np.ndarray, after: np.ndarray, n_bytes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32s of two byte strings in a row from the CRC-32 of each and the length of the second."""
    out = before.astype(np.uint64)
    for k in range(int(n_bytes.max()).bit_length() if len(n_bytes) else 0):
        at = (n_bytes >> k & 1).astype(bool)
        v = out[at]
        out[at] = tables[k][0][v & np.uint64(255)] ^ tables[k][1][v >> np.uint64(8) & np.uint64(255)] ^ tables[k][2][v >> np.uint64(16) & np.uint64(255)] ^ tables[k][3][v >> np.uint64(24)]
    return out ^ after.astype(np.uint64)


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The documents of a store: id, start, n_tokens, ids_crc32, intact (and ids, if wanted).

    ``start`` counts the ids of all documents before it in id order; ``ids_crc32`` and ``ids`` are of the
    ids as unsigned 32-bit integers. ``intact`` says that every chunk and the recipe have the hashes
    that name them; if a chunk is lost or changed it is false and n_tokens and ids_crc32 are null.
    """
    item = (spark.read.parquet(f"{path}/manifest").select("item").first() or [2])[0]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            wide = [np.frombuffer(x, f"<u{item}").astype("<u4").tobytes() for x in bodies]
            good = [hashlib.sha256(x).digest() == k for k, x in zip(batch.column(0).to_pylist(), bodies)]
            columns = [batch.column(0), pa.array([len(x) for x in wide], pa.int64()), pa.array([zlib.crc32(x) for x in wide], pa.int64()), pa.array(good)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(wide, pa.binary())] * with_ids, ["sha", "n_bytes", "crc", "good"] + ["ids"] * with_ids)

    chunks = objects(spark, path, 0).mapInArrow(common.tidy(digest), "sha binary, n_bytes long, crc long, good boolean" + ", ids binary" * with_ids)
    recipes = objects(spark, path, 1)
    count = (F.octet_length("body") / 32).cast("int")
    wanted = recipes.where(count > 0).select(F.col("key").alias("root"), (F.sha2("body", 256) == F.lower(F.hex("key"))).alias("named"), F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("at"), F.col("body").substr(i * 32 + 1, F.lit(32)).alias("sha")))).alias("c"))
    found = wanted.select("root", "named", "c.at", "c.sha").join(chunks, "sha", "left")
    one = F.struct("at", F.coalesce("n_bytes", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), *(["ids"] * with_ids))
    parts = found.groupBy("root").agg(F.sort_array(F.collect_list(one)).alias("parts"), F.min(F.col("named") & F.coalesce("good", F.lit(False))).alias("intact"))
    parts = parts.select("root", "intact", F.col("parts.n").alias("n"), F.col("parts.crc").alias("crc"), *([F.unhex(F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"])))).alias("ids")] * with_ids))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shift_tables()
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy()
            n, crc = (pa.compute.list_flatten(batch.column(i)).to_numpy() for i in (2, 3))
            start, total, out = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.uint64)
            for k in range(int(sizes.max()) if len(sizes) else 0):
                rows = np.flatnonzero(sizes > k)
                at = start[rows] + k
                out[rows] = joined_crc(out[rows], crc[at], n[at], tables)
                total[rows] += n[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total // 4), pa.array(out.astype(np.int64)), *batch.columns[4:]], ["root", "intact", "read", "ids_crc32", *batch.schema.names[4:]])

    whole = parts.mapInArrow(common.tidy(combine), "root binary, intact boolean, read long, ids_crc32 long" + ", ids binary" * with_ids)
    docs = spark.read.parquet(f"{path}/documents")
    base, total = [], 0
    for r in docs.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row for each part
        base.append((r["part"], total))
        total += r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    none = F.col("n_tokens") == 0  # its recipe has no chunk
    out = docs.join(bases, "part").join(whole, "root", "left").withColumn("intact", none | (F.coalesce("intact", F.lit(False)) & (F.col("read") == F.col("n_tokens"))))
    read, crc = (F.when(none, F.lit(0).cast("long")).when(F.col("intact"), F.col(c)).alias(c) for c in ("read", "ids_crc32"))
    return out.select(id_col, (F.col("base") + F.col("before")).alias("start"), read.alias("n_tokens"), crc, "intact", *(["ids"] * with_ids))


def op10_token_store(spark, sf_dir):
    return stored(common.table(spark, sf_dir, "documents"))


def stored(docs: DataFrame) -> DataFrame:
    """Write the documents to a new store in the shared folder and read them back from its files."""
    import public_tokenizers

    path = common.fresh_path(docs.sparkSession, "token-store")
    write_store(docs, public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    return read_store(docs.sparkSession, path)
