"""Sharding by minimax contiguous partition (operator 4).

Rows with equal texts form one atom that is never split. Atoms stand in the order of a 60-bit digest
of their text. The smallest capacity for which a greedy walk along that order needs no more than the
wanted shards is found by binary search, and the order is cut within that capacity.

The driver never holds the atoms: it holds sums of digest ranges. A capacity between what is surely
enough (ranges taken as atoms) and what is surely too little (ranges taken as divisible) can only be
settled by ranges near a cut, so only these are split further, until no such range is left. That
gives the exact optimum over atoms from a bounded number of range sums.

An atom larger than an even share would force its size on all shards, so such atoms, fewer than
the shards, get a shard each, largest first; the minimax partition deals out the rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the digest; bits of the first ranges; more bits at each split.
DIGEST_BITS, FIRST_BITS, MORE_BITS = 60, 13, 5
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def walk(ends: np.ndarray, capacity: int, shards: int, atomic: np.ndarray | None = None, at: int = 0) -> list[int] | None:
    """Greedy cuts of ordered sizes with running totals ``ends`` at a capacity: the totals at which
    each shard ends, or None if more shards are needed.

    With ``atomic``, sizes where it is false may be divided anywhere. ``at`` is the total to start from.
    """
    total, out = int(ends[-1]), []
    if at >= total:
        return out
    for _ in range(shards):
        i = int(np.searchsorted(ends, at + capacity, side="right"))  # sizes that fit whole
        stop = int(ends[i - 1]) if i else 0
        if atomic is not None and i < len(ends) and not atomic[i]:
            stop = at + capacity
        stop = max(stop, at)
        if stop == at and at < total:
            return None
        out.append(at := stop)
        if at >= total:
            return out
    return None


def least_capacity(sizes: np.ndarray, shards: int, atomic: np.ndarray | None = None) -> int:
    """The smallest whole capacity at which the walk succeeds."""
    ends = np.cumsum(sizes)
    low, high = -(-int(ends[-1]) // shards), int(ends[-1])
    if atomic is None:
        low = max(low, int(sizes.max()))
    while low < high:
        middle = (low + high) // 2
        if walk(ends, middle, shards, atomic) is None:
            low = middle + 1
        else:
            high = middle
    return low


def boundaries(atoms: DataFrame, shards: int) -> tuple[list[int], int]:
    """Digests at which shards after the first begin, and the capacity; ``atoms`` has ``key`` and ``bytes``."""
    spark = atoms.sparkSession

    def sums(rows: DataFrame, bits: int) -> list:
        return rows.groupBy(F.shiftright("key", DIGEST_BITS - bits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("m")).collect()

    # a segment: first digest, bits, sum, atoms, largest atom
    parts = sorted((r["p"] << (DIGEST_BITS - FIRST_BITS), FIRST_BITS, r["b"], r["n"], r["m"]) for r in sums(atoms, FIRST_BITS))
    if not parts:
        return [], 0
    while True:
        sizes, whole = np.array([p[2] for p in parts], np.int64), np.array([p[3] == 1 or p[1] >= DIGEST_BITS for p in parts])
        enough = least_capacity(sizes, shards)
        too_little = max(least_capacity(sizes, shards, whole), max(p[4] for p in parts))
        ends = np.cumsum(sizes)
        if too_little >= enough:
            break
        # ranges that a cut can fall into at any capacity that is still open
        starts = ends - sizes
        last = np.array(walk(ends, enough, shards, whole))
        lowest = least_cuts(ends, sizes, too_little, len(last))
        near = np.zeros(len(parts), bool)
        for a, b in zip(lowest, last):
            near |= (starts <= b) & (ends >= a)
        near &= ~whole
        if not near.any():
            break
        by_bits: dict[int, list[int]] = {}
        for i in np.flatnonzero(near):
            by_bits.setdefault(parts[i][1], []).append(parts[i][0] >> (DIGEST_BITS - parts[i][1]))
        fine = [p for p, n in zip(parts, near) if not n]
        for bits, prefixes in by_bits.items():
            chosen = F.broadcast(spark.createDataFrame([(p,) for p in prefixes], "p long"))  # ranges near the cuts of the shards
            rows = atoms.join(chosen, F.shiftright("key", DIGEST_BITS - bits) == F.col("p"), "left_semi")
            more = min(bits + MORE_BITS, DIGEST_BITS)
            fine += [(r["p"] << (DIGEST_BITS - more), more, r["b"], r["n"], r["m"]) for r in sums(rows, more)]
        parts = sorted(fine)
    cut = even_cuts(ends, enough, shards)
    at = [int(np.searchsorted(ends, c, side="right")) for c in cut[:-1]]
    return [parts[i][0] for i in at], enough


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts within the least capacity, each as near an even share of what is left as the rest allows:
    the greedy walk alone would leave the last shard short."""
    total, at, out = int(ends[-1]), 0, []
    for left in range(shards, 0, -1):
        if at >= total:
            break
        share = at + (total - at) / left
        i = int(np.searchsorted(ends, share))
        near = sorted((int(e) for e in ends[max(0, i - 1) : i + 1] if at < e <= at + capacity), key=lambda e: abs(e - share))
        at = next((e for e in near if walk(ends, capacity, left - 1, at=e) is not None), None) or walk(ends, capacity, left, at=at)[0]
        out.append(at)
    return out


def least_cuts(ends: np.ndarray, sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Totals below which the cuts at this capacity can't lie: each shard may end one range early."""
    at, out = 0, []
    for _ in range(shards):
        i = int(np.searchsorted(ends, at + capacity, side="right"))
        at = max(at, int(ends[i - 1]) if i else 0)
        out.append(at)
    return out


def shard_rows(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row.

    A null text has size 16 and the crc32 of no bytes, and stands with the empty texts. Repeated rows
    are separate members of one atom. In a shard, rows stand by digest, then id; slots count from 0 without gaps.
    With fewer atoms than shards, the last shards are empty; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.conv(F.substring(F.sha2(text, 256), 1, DIGEST_BITS // 4), 16, 10).cast("long")
    rows = common.checkpoint(df.select(F.col(id_col), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")))
    atoms = common.checkpoint(rows.groupBy("key").agg(F.sum("size").alias("bytes")))

    # atoms above an even share of what is left
    largest = [(r["key"], r["bytes"]) for r in atoms.orderBy(F.desc("bytes"), "key").limit(shards).collect()]
    left, alone = atoms.agg(F.sum("bytes")).first()[0] or 0, []
    for k, size in largest:
        if len(alone) < shards - 1 and size * (shards - len(alone)) > left:
            alone.append(k)
            left -= size
    rest = atoms.where(~F.col("key").isin(alone)) if alone else atoms
    begin, _ = boundaries(rest, shards - len(alone))

    shard = F.lit(len(alone))
    for b in begin:
        shard = shard + (F.col("key") >= b).cast("int")
    for i, k in enumerate(alone):
        shard = F.when(F.col("key") == k, i).otherwise(shard)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.withColumn("shard", shard.cast("int")).repartitionByRange(n, "shard", "key", id_col).sortWithinPartitions("shard", "key", id_col)
    placed = common.checkpoint(ranged.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).cast("int").alias("part")
    counts = sorted(map(tuple, placed.groupBy("shard", part).agg(F.count("*")).collect()))  # a row for each part and each cut
    starts, passed, before = [], 0, {}
    for s, p, c in counts:
        before.setdefault(p, 0)
        starts.append((s, p, passed, before[p]))
        before[p] += c
        passed += c
    first = {}
    for s, _, passed, _ in starts:
        first.setdefault(s, passed)
    shift = F.broadcast(df.sparkSession.createDataFrame([(s, p, passed - first[s] - inside) for s, p, passed, inside in starts], "shard int, part int, shift long"))
    out = placed.withColumn("part", part).join(shift, ["shard", "part"])
    slot = F.col("place").bitwiseAND((1 << 33) - 1) + F.col("shift")
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_shards(spark, sf_dir):
    return shard_rows(common.table(spark, sf_dir, "documents"), shards=40)
