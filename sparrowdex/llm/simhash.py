"""SimHash near-duplicates by bit-sliced comparison (operator 7).

A fingerprint has a bit set where over half of the hashes of a text's word shingles have it. Two
fingerprints are linked when they differ in few bits (the radius). With 2 * radius blocks of bits at
least half of the blocks of a linked pair agree, so each distinct fingerprint goes to one
bucket for every choice of that many blocks. A bucket that holds too many fingerprints is dealt out
again by parts of its other bits: of radius + 1 parts one must agree. Each level only adds exact
conditions that some bucket of every linked pair meets, so no link is lost and no cap is needed; at
the last level a bucket's free bits bound its size.

In a bucket the fingerprints stand as vertical bit planes: plane b holds bit b of all of them as one
long integer. The distances of one fingerprint to all others are counted at once by carry-save
adders over the planes, and a block is abandoned when every counter has passed the radius. A bucket
yields the edges of a spanning forest, never all pairs; components are found by label propagation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED, BITS = 42, 64
#: Fingerprints that a bucket may hold before it is dealt out further.
BUCKET = 2048
#: Fingerprints compared with one integer operation.
BLOCK = 4096


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, A-Z lower-cased; of all words if they are fewer."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have; 0 of none."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the 64 bits as a signed long). A null text counts as empty: no words, fingerprint 0."""
    common.small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(raw, size)) for raw in common.utf8(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(work, f"{id_col} {id_type}, fp long")


def planes_of(fps: list[int]) -> list[int]:
    """Vertical planes: bit i of plane b is bit b of fingerprint i."""
    bits = np.unpackbits(np.array(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def within(fp: int, planes: list[int], everyone: int, radius: int) -> int:
    """A mask of the fingerprints of a block that differ from ``fp`` in at most ``radius`` bits.

    The counters are bit-sliced: digit d of all distances is one integer, planes are added with carries,
    and ``passed`` collects those that are surely beyond the radius. The block is abandoned once all are.
    """
    digits = [0] * radius.bit_length()
    passed = 0
    for b, plane in enumerate(planes):
        carry = plane ^ everyone if fp >> b & 1 else plane
        for d, digit in enumerate(digits):
            if not carry:
                break
            digits[d], carry = digit ^ carry, digit & carry
        passed |= carry
        if b % 8 == 7:
            # digits compared with the radius, from the highest
            more, equal = 0, everyone
            for d in range(len(digits) - 1, -1, -1):
                if radius >> d & 1:
                    equal &= digits[d]
                else:
                    more |= equal & digits[d]
                    equal &= ~digits[d]
            passed |= more
            if passed == everyone:
                return 0
    return everyone & ~passed


def forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (smaller, larger) that join the linked fingerprints of a bucket, at most one less than these."""
    fps = sorted(set(fps))
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for start in range(0, len(fps), BLOCK):
        block = fps[start : start + BLOCK]
        planes, everyone = planes_of(block), (1 << len(block)) - 1
        for i, fp in enumerate(fps[: start + len(block)]):
            mask = within(fp, planes, everyone, radius)
            if i >= start:
                mask &= ~((1 << i - start + 1) - 1)
            while mask:
                j = start + (mask & -mask).bit_length() - 1
                mask &= mask - 1
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((fps[i], fps[j]))
    return edges


def bucket_edges(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges a, b between distinct fingerprints ``fp`` that differ in at most ``radius`` bits: a spanning forest of each bucket."""
    if not 1 <= radius <= 8:
        raise ValueError("blocks of bits serve radii 1 to 8")
    blocks = 2 * radius
    width = BITS // blocks
    spans = [(i * width, BITS if i == blocks - 1 else (i + 1) * width) for i in range(blocks)]
    u = lambda x: x - (1 << 64) if x >> 63 else x  # noqa: E731  as a signed long
    mask = lambda bits: u(sum(1 << b for b in bits))
    first = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        bits = [b for i in chosen for b in range(*spans[i])]
        first.append((n, bits, [b for b in range(BITS) if b not in bits]))
    fp = F.col("fp")
    rows = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(n).alias("way"), fp.bitwiseAND(F.lit(mask(bits))).alias("key")) for n, bits, _ in first))).alias("x")).select("fp", F.col("x.way").alias("way"), F.col("x.key").alias("key"))
    free, done = {n: rest for n, _, rest in first}, []
    for level in range(3):
        held = rows.groupBy("way", "key").agg(F.count("*").alias("held")).where("held > 1")
        rows = rows.join(held, ["way", "key"])
        last = level == 2
        done.append(rows if last else rows.where(F.col("held") <= BUCKET))
        if last:
            break
        # deal what is too full out by parts of its free bits
        ways, nxt = [], {}
        for way, bits in free.items():
            step = -(-len(bits) // (radius + 1))
            for p in range(radius + 1):
                part = bits[p * step : (p + 1) * step]
                code = len(nxt)
                nxt[code] = [b for b in bits if b not in part]
                ways.append((way, code, mask(part)))
        table = F.broadcast(distinct.sparkSession.createDataFrame(ways, "way int, next int, bits long"))  # fixed by the radius
        full = rows.where(F.col("held") > BUCKET).join(table, "way")
        rows, free = full.select("fp", F.col("next").alias("way"), F.col("key").bitwiseOR(fp.bitwiseAND(F.col("bits"))).alias("key")), nxt
    buckets = done[0].withColumn("level", F.lit(0))
    for n, more in enumerate(done[1:], 1):
        buckets = buckets.unionByName(more.withColumn("level", F.lit(n)))
    buckets = buckets.groupBy("level", "way", "key").agg(F.collect_list("fp").alias("fps"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for fps in batch.column(0).to_pylist() for e in forest([f & (1 << 64) - 1 for f in fps], radius)]
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return buckets.select("fps").mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges a, b: root is the least node that can be reached.

    Large-star and small-star steps in turn; every few rounds the lineage is cut at a checkpoint.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = common.checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    while True:
        # large star: a node's larger neighbours take its least neighbour
        least = both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both(edges).join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours take the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = common.checkpoint(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_duplicates(df: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the least id that links reach) for each row.

    A null text counts as empty; texts without words have fingerprint 0 and are linked like any
    other. Repeated rows and ids stay rows of their own. An empty table gives no rows.
    """
    marked = common.checkpoint(fingerprints(df, size, id_col, text_col))
    distinct = common.checkpoint(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    linked = components(bucket_edges(distinct.select("fp"), radius))
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(member, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similar shingle sets: bands of minima, and minima of a band.
BANDS, MINIMA = 12, 4
#: Sets of one slice of a band's members and their bytes, about; members to which all slices of a band compare.
SIDE, SIDE_BYTES, LEADERS = 512, 8 << 20, 3
#: Fingerprints of one side of a comparison of a band's members; bits in which those of similar sets may differ.
WIDE, FAR = 4096, 22
#: Least number of minima that agree in one byte: of similar sets about 38.5 of 48 do, fewer than this with a chance of 0.00001.
ALIKE = 26
#: Parts into which rows of one band and key are dealt for a join.
SALTS = 32
_FACTORS = (np.random.default_rng(11).integers(1 << 62, size=BANDS * MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def set_sketch(raw: bytes, size: int) -> tuple[bytes, int, list[int], int, bytes]:
    """Sorted 32-bit shingle hashes, a hash of these, band keys, the fingerprint of the distinct shingles, and a byte of each minimum of a text."""
    hashes = np.unique(shingle_hashes(raw, size))
    body = np.unique(hashes.astype(np.uint32)).tobytes()
    least = np.full(BANDS * MINIMA, np.uint64((1 << 64) - 1))
    for start in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[start : start + 4096, None] * _FACTORS).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(least[i : i + MINIMA].tobytes(), i) for i in range(0, len(least), MINIMA)]
    return body, xxhash.xxh64_intdigest(body, SEED), keys, fingerprint(hashes), (least >> np.uint64(32)).astype(np.uint8).tobytes()


def similar_forest(sets: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Places of pairs that join all sets of at least this Jaccard similarity: a spanning forest of the links.

    Pairs whose sizes rule that out, and pairs that are joined already, are not looked at.
    """
    sizes = np.array([len(s) // 4 for s in sets])
    starts = np.cumsum(sizes) - sizes
    # shingles numbered within the bucket, so that one set's can be marked and counted in all others
    names, every = np.unique(np.frombuffer(b"".join(sets), np.uint32), return_inverse=True)
    marked = np.zeros(len(names), bool)
    root = np.arange(len(sets))
    edges = []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[(root[rest] != root[i]) & (small >= similarity * large)]
        if not len(rest):
            continue
        own = every[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        for j in rest.tolist():
            if root[j] == root[i]:
                continue
            both = np.count_nonzero(marked[every[starts[j] : starts[j] + sizes[j]]])
            if both >= similarity * (sizes[i] + sizes[j] - both):
                root[root == root[j]] = root[i]
                edges.append((i, j))
        marked[own] = False
    return edges


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of sorted 32-bit hashes have at least this Jaccard similarity."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def far_pairs(left: list[tuple], right: list[tuple] | None, radius: int, similarity: float) -> Iterator[np.ndarray]:
    """Pairs of members of two blocks (of one, if ``right`` is None) that could be similar and weren't compared or joined
    yet, as rows (smaller, larger) of arrays, so that no block's pairs stand in memory at once.

    A member is (id, fingerprint, component, slice, size, minima). The other side stands in bit planes.
    """
    other = left if right is None else right
    if not left or not other:
        return
    planes, everyone = planes_of([m[1] for m in other]), (1 << len(other)) - 1
    names, components_, slices, sizes = (np.array([m[k] for m in other], np.int64) for k in (0, 2, 3, 4))
    minima = np.frombuffer(b"".join(m[5] for m in other), np.uint8).reshape(len(other), -1)
    pairs, held = [], 0
    for i, (name, fp, component, part, size, least) in enumerate(left):
        mask = within(fp, planes, everyone, radius)
        if right is None:
            mask &= ~((1 << i + 1) - 1)
        if mask:
            j = np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(-(-len(other) // 8), "little"), np.uint8), bitorder="little"))
            j = j[(components_[j] != component) & (slices[j] != part) & (np.minimum(sizes[j], size) >= similarity * np.maximum(sizes[j], size))]
            j = j[(minima[j] == np.frombuffer(least, np.uint8)).sum(1) >= ALIKE]
            pairs.append(np.stack([np.minimum(names[j], name), np.maximum(names[j], name)], 1))
            held += len(j)
            if held >= 65_536:
                yield np.concatenate(pairs)
                pairs, held = [], 0
    if held:
        yield np.concatenate(pairs)


def similar_groups(df: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and component_id of each row: rows are linked when the Jaccard similarity of their word shingles reaches
    ``similarity``, far beyond the few bits that blocks of a fingerprint allow.

    Bands of minima of the shingle hashes bring similar sets together (a pair of similarity 0.8 misses all with chance
    0.002); equal sets are one member. A band's members are dealt into slices of bounded size, each with the same few
    leaders. In a slice the sets of all pairs that aren't joined yet are compared. Where a band has several slices and its
    members aren't all joined by then, fingerprints are compared across slices, bit-sliced, and the sets of only those pairs
    that are near enough (similar sets differ in about 10 of 64 bits, in more than ``FAR`` with a chance of 0.00002), agree in
    enough minima, and are in different components. Texts without words are alike. An empty table gives no rows.
    """
    spark = df.sparkSession
    common.small_batches(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    signed = lambda x: np.array(x, np.uint64).view(np.int64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [set_sketch(raw, size) for raw in common.utf8(batch.column(1).to_pylist())]
            keys = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * BANDS, pa.array(signed([k for r in rows for k in r[2]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed([r[1] for r in rows])), keys, pa.array(signed([r[3] for r in rows])), pa.array([r[4] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.binary())], [id_col, "member", "keys", "fp", "minima", "body"])

    rows, _ = common.keep_written(df.select(id_col, text_col).mapInArrow(common.tidy(sketch), f"{id_col} {id_type}, member long, keys array<long>, fp long, minima binary, body binary"), "sketches")
    # equal bodies may come from other 64-bit hashes that agree in 32 bits: one of their fingerprints serves all
    members = common.checkpoint(rows.groupBy("member").agg(F.min(id_col).alias("least_id"), F.min("keys").alias("keys"), F.min("fp").alias("fp"), F.min("minima").alias("minima"), F.max(F.octet_length("body")).alias("size")))
    banded = members.select("member", "fp", "size", F.posexplode("keys").alias("band", "key"))
    lead = [F.min_by("member", F.xxhash64("member", "band", F.lit(i))) for i in range(LEADERS)]
    slices = F.ceil(F.greatest(F.col("held") / SIDE, F.col("bytes") / SIDE_BYTES)).cast("int")
    held = banded.groupBy("band", "key").agg(F.count("*").alias("held"), F.sum("size").alias("bytes"), F.array_distinct(F.array(*lead)).alias("leaders"))
    held = common.checkpoint(held.where("held > 1").select("band", "key", "held", "leaders", slices.alias("slices")))
    salted = lambda t: t.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)))
    spread = lambda t: t.withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
    keys = ["band", "key", "salt"]
    own = F.pmod("member", "slices").cast("int")
    shared = common.checkpoint(salted(banded).join(spread(held.select("band", "key", "held", "slices")), keys).select("member", "fp", "size", "band", "key", "held", "slices", own.alias("slice")))
    leaders = held.where("slices > 1").select(F.explode("leaders").alias("member"), "band", "key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    seats = shared.select("member", "band", "key", "slice").unionByName(leaders).distinct()
    bodies = rows.select("member", "body").join(shared.select("member").distinct(), "member", "left_semi").dropDuplicates(["member"])
    # sorted rows stream to Python: no list of a slice's sets is built in the JVM
    seated = bodies.join(seats, "member").repartition("key", "band", "slice").sortWithinPartitions("key", "band", "slice", "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at in common.together(batches, 3):
            if len(at) > 1:
                yield edges_batch([(at[i][0], at[j][0]) for i, j in similar_forest([m[1] for m in at], similarity)])

    edges = common.checkpoint(seated.select("key", "band", "slice", "member", "body").mapInArrow(common.tidy(compare), "a long, b long").distinct())
    common.sweep(spark)
    linked = components(edges)
    common.sweep(spark)
    if held.where("slices > 1").isEmpty():
        return grouped(rows, members, linked, id_col)
    # bands of several slices whose members aren't all joined
    placed = shared.where("slices > 1").join(linked, F.col("member") == F.col("node"), "left").select("member", "fp", "size", "band", "key", "held", "slice", F.coalesce("root", "member").alias("component"))
    placed = placed.join(members.select("member", "minima"), "member")
    placed = common.checkpoint(placed)
    common.sweep(spark)
    open_ = placed.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band", "key")
    left = salted(placed).join(spread(open_), keys).drop("salt")
    sides = F.ceil(F.col("held") / WIDE).cast("int")
    mine = F.pmod(F.xxhash64("member", F.lit(1)), sides).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), sides - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")))
    dealt = left.select("key", "band", F.explode(blocks).alias("side"), mine.alias("mine"), "member", "fp", "component", "slice", "size", "minima")
    dealt = dealt.select("key", "band", "side.i", "side.j", "mine", "member", "fp", "component", "slice", "size", "minima")
    dealt = dealt.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j", "member")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j), all_ in common.together(batches, 4):
            split: dict[int, list] = {i: [], j: []}
            for mine, member, fp, *rest in all_:
                split[mine].append((member, fp & (1 << 64) - 1, *rest))
            for found in far_pairs(split[i], None if i == j else split[j], FAR, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    # written, so that Spark knows their size; the sets of no other members are read
    pairs, _ = common.keep_written(dealt.mapInArrow(common.tidy(candidates), "a long, b long").distinct(), "pairs")
    common.sweep(spark)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    bodies = rows.select("member", "body").join(asked, "member", "left_semi").dropDuplicates(["member"])
    both = pairs.join(bodies.select(F.col("member").alias("a"), F.col("body").alias("x")), "a").join(bodies.select(F.col("member").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "x", "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            yield edges_batch([(p, q) for p, q, s, t in zip(a, b, x, y) if similar(s, t, similarity)])

    more = common.checkpoint(both.mapInArrow(common.tidy(verify), "a long, b long"))
    common.sweep(spark)
    if not more.isEmpty():
        linked = components(edges.union(more))
        common.sweep(spark)
    return grouped(rows, members, linked, id_col)


def grouped(rows: DataFrame, members: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    """id and component_id of each row from its member's component."""
    rooted = members.join(linked, members["member"] == linked["node"], "left").select("member", "least_id", F.coalesce("root", "member").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.select(id_col, "member").join(rooted.join(least, "root").select("member", "component_id"), "member").select(id_col, "component_id")


def edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def op7_simhash(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "documents"))
