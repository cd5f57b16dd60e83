"""Token counts by prefix dynamic programming (operator 1).

For a byte-level BPE vocabulary the encoding of a prefix is the encoding of a shorter prefix plus one
token, and that token is the only vocabulary entry that (a) ends the prefix and (b) stays a
separate neighbour of the shorter prefix's last token when the two are encoded together. Running
along a piece of text this gives the exact token count of *every* prefix, which answers "how many
tokens are the first n bytes" and "how many bytes fit a budget of n tokens" without encoding again.

A document's table is a byte string of signed 8-bit differences, one for each UTF-8 byte: the sum of
the first n is the token count of the first n bytes. Within a multi-byte character the count of the
last whole character holds. The tables of pieces are kept in a bounded memo, so a document's
table is a join of byte strings. New pieces of a batch of documents go through the program together,
one end after the other, as arrays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Entries of the memos of one Python worker, of two generations each; slots for pairs of tokens (a power of 2).
MEMO_UNITS, MEMO_PAIRS, PAIRS = 250_000, 100_000, 1 << 21
#: Length of the longest units that are kept in the memo and of the longest pieces that are taken together; how many of these.
MEMO_BYTES, PIECES = 64, 20_000
#: An odd multiplier that spreads keys over a table.
HASH = 0x2545F4914F6CDD1D
#: The fixed split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same, but a run of white space stays with the piece after it: only then does a prefix that
#: ends within a unit never change how the text before the unit is split.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
UNIT = rf"\s+(?=\s\S)(?: \p{{L}}+| \p{{N}}+| [^\s\p{{L}}\p{{N}}]+|\s(?:{WORD}))|{SPLIT}"


def _bytes_to_chars() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of all prefixes under one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("prefix counts need a byte-level BPE vocabulary without normalizer or prefix space")
        if model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("prefix counts need plain merges")
        back = {c: b for b, c in _bytes_to_chars().items()}
        raw = lambda s: bytes(back[c] for c in s)
        vocab = {raw(s) for s in model["vocab"] if all(c in back for c in s)}
        merges = (m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = sorted(vocab)
        if len(vocab) > 65_535 or len(vocab & {bytes([b]) for b in range(256)}) < 256:
            raise ValueError("prefix counts need all 256 bytes and at most 65,535 tokens")
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names)) or r"(?!)")  # the leftmost, of these the longest
        self.split = regex.compile(SPLIT).findall
        self.units = regex.compile(UNIT).findall
        self.double = re.compile(r"\s\s").search
        self.edges = [None] * len(self.tokens)
        self.apart = common.Memo(self.stay_apart, MEMO_PAIRS)
        self.alone = common.Memo(lambda t: self.merged(self.tokens[t])[0] == [self.tokens[t]], MEMO_PAIRS)
        self.runs = common.Memo(self.run_counts, MEMO_PAIRS)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._build_trie()
        #: While one of these is not whole, its apostrophe is a piece of its own.
        self.shortened = {c: self.steps_of(c, [0, *(self.count(c[:n]) for n in range(1, len(c) + 1))]) for c in ("'re", "'ve", "'ll")}

    def merged(self, piece: bytes) -> tuple[list[bytes], list, list]:
        """Plain BPE of a short byte string, with the history of its first and of its last part:
        (part, rank of the merge that formed it, rank of the merge that ended it)."""
        parts, rank, never = [piece[i : i + 1] for i in range(len(piece))], self.rank, 1 << 30
        first, last = [[parts[0], -1, never]], [[parts[-1], -1, never]]
        while len(parts) > 1:
            least, at = min((rank.get(ab, never), i) for i, ab in enumerate(zip(parts, parts[1:])))
            if least == never:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            for edge, now in ((first, parts[0]), (last, parts[-1])):
                if edge[-1][0] != now:
                    edge[-1][2] = least
                    edge.append([now, least, never])
        return parts, first, last

    def edges_of(self, token: int) -> list:
        """The histories of a token's first and last part."""
        if self.edges[token] is None:
            self.edges[token] = self.merged(self.tokens[token])[1:]
        return self.edges[token]

    def stay_apart(self, pair: int) -> bool:
        """Whether two tokens, side by side, are encoded as these two: no merge crosses between them."""
        rank = self.rank.get
        for x, x_from, x_to in self.edges_of(pair >> 16)[1]:
            for y, y_from, y_to in self.edges_of(pair & 65_535)[0]:
                crossing = rank((x, y))
                if crossing is not None and crossing < x_to and crossing <= y_to and x_from < y_to and y_from < x_to:
                    return False
        return True

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of the byte prefixes of one piece, from 0 bytes to all; time grows with its length.

        ``alive`` has the starts from which a token could still end here, the longest first.
        """
        child, token_at, alone, apart = self.child.get, self.token_at, self.alone, self.apart
        counts, last, alive = [0], [0], []
        for end, byte in enumerate(piece):
            alive.append((end, 0))
            alive = [(start, node) for start, at in alive if (node := child(at << 8 | byte)) is not None]
            for start, node in alive:
                token = token_at[node]
                if token >= 0 and (apart[last[start] << 16 | token] if start else alone[token]):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def _found(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """Children of trie nodes by a byte, -1 for none; the edges stand in a hash table with open addresses."""
        keys = nodes << 8 | bytes_
        at = (keys * HASH >> 20) & self.mask
        held = self.edge_keys[at]
        out = np.where(held == keys, self.edge_nodes[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.edge_keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.edge_nodes[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out

    def _build_trie(self) -> None:
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for number, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                node = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = number
        self.tokens_at = np.array(self.token_at, np.int64)
        size = 1 << (4 * len(self.child)).bit_length()
        self.mask = size - 1
        self.edge_keys, self.edge_nodes = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        keys, nodes = np.array(list(self.child), np.int64), np.array(list(self.child.values()), np.int64)
        at = (keys * HASH >> 20) & self.mask
        while len(keys):
            free = self.edge_keys[at] < 0
            places, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[places >= 0]
            self.edge_keys[at[first]], self.edge_nodes[at[first]] = keys[first], nodes[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, nodes, at = keys[rest], nodes[rest], (at[rest] + 1) & self.mask
        self.alone_at = np.full(len(self.tokens), -1, np.int8)
        self.pair_keys, self.pair_apart = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def _allowed(self, before: np.ndarray, first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each token can follow the token before it, or stand alone where it is the first."""
        out = np.zeros(len(tokens), bool)
        own = tokens[first]
        for t in np.unique(own[self.alone_at[own] < 0]).tolist():
            self.alone_at[t] = self.merged(self.tokens[t])[0] == [self.tokens[t]]
        out[first] = self.alone_at[own] > 0
        pairs = before[~first] << 16 | tokens[~first]
        at = (pairs * HASH >> 20) & (PAIRS - 1)
        good, missing = self.pair_apart[at], self.pair_keys[at] != pairs
        if missing.any():
            asked, which = np.unique(pairs[missing], return_inverse=True)
            told = np.fromiter(map(self.stay_apart, asked.tolist()), bool, len(asked))
            good[missing] = told[which]
            at = (asked * HASH >> 20) & (PAIRS - 1)  # a newer pair takes an older one's place
            _, one = np.unique(at, return_index=True)
            self.pair_keys[at[one]], self.pair_apart[at[one]] = asked[one], told[one]
        out[~first] = good
        return out

    def piece_tables(self, pieces: list[str]) -> list[bytes]:
        """Tables of short pieces: the steps of the dynamic program run over the ends, for all pieces at once."""
        raws = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        order = np.argsort(-lengths, kind="stable")
        lengths, n, most = lengths[order], len(raws), int(lengths.max(initial=0))
        text = np.zeros((n, most), np.int64)
        text[np.arange(most) < lengths[:, None]] = np.frombuffer(b"".join([raws[i] for i in order.tolist()]), np.uint8)
        counts, last = np.zeros((n, most + 1), np.int64), np.zeros((n, most + 1), np.int64)
        row, start, node = (np.zeros(0, np.int64) for _ in range(3))
        for end in range(1, most + 1):
            active = int(np.searchsorted(-lengths, -end, side="right"))
            keep = row < active
            row = np.concatenate([row[keep], np.arange(active)])
            start = np.concatenate([start[keep], np.full(active, end - 1)])
            node = self._found(np.concatenate([node[keep], np.zeros(active, np.int64)]), text[row, end - 1])
            alive = node >= 0
            row, start, node = row[alive], start[alive], node[alive]
            token = self.tokens_at[node]
            at = np.flatnonzero(token >= 0)
            at = at[np.argsort(row[at], kind="stable")]  # the longest token of each piece first
            place = np.flatnonzero(np.append(True, row[at][1:] != row[at][:-1])) if len(at) else at
            while len(place):
                c = at[place]
                good = self._allowed(last[row[c], start[c]], start[c] == 0, token[c])
                done = c[good]
                counts[row[done], end], last[row[done], end] = counts[row[done], start[done]] + 1, token[done]
                place = place[~good] + 1
        # differences at the ends of characters
        ends = np.ones((n, most + 1), bool)
        ends[:, 1:most] = (text[:, 1:] & 192) != 128
        place = np.maximum.accumulate(np.where(ends, np.arange(most + 1), 0), axis=1)
        steps = np.diff(np.take_along_axis(counts, place, axis=1), axis=1).astype(np.int8)
        flat, out = steps.tobytes(), [b""] * n
        for i, (at, size) in enumerate(zip(order.tolist(), lengths.tolist())):
            out[at] = flat[i * most : i * most + size]
        return out

    @staticmethod
    def steps_of(text: str, at: list[int]) -> bytes:
        """Differences of the counts at the ends of the characters, by bytes."""
        return b"".join(b"\0" * (len(c.encode()) - 1) + (b - a).to_bytes(1, signed=True) for c, a, b in zip(text, at, at[1:]))

    def piece_table(self, piece: str) -> bytes:
        """The table of one piece, short or long."""
        raw = piece.encode()
        at = self.piece_counts(raw)
        return self.steps_of(piece, [at[0], *(at[n] for n, follows in enumerate(raw[1:] + b"a", 1) if follows & 192 != 128)])

    def pieces_of(self, unit: str) -> list[str]:
        """The pieces whose tables make up that of a unit without a run of white space."""
        if unit.isalpha() or unit[0] == " " and unit[1:].isalpha():
            return [unit]
        return self.split(unit)

    def run_table(self, unit: str, tables: dict[str, bytes]) -> bytes:
        """The table of a unit that begins with two or more white spaces: while only these are seen, they are one
        piece; what follows takes the last of them away."""
        run = unit[: len(unit) - len(unit.lstrip())]
        if len(run) <= MEMO_BYTES:
            counts = self.runs[run]
        else:
            counts = self.run_counts(run)
        steps = self.steps_of(run, counts)
        if len(run) == len(unit):
            return steps
        rest = unit[len(run) - 1 :]
        table = b"".join([tables[p] for p in self.split(rest)])
        first = len(rest[:2].encode())
        then = counts[-2] + int(np.frombuffer(table[:first], np.int8).sum()) - counts[-1]
        return steps + b"\0" * (len(rest[1].encode()) - 1) + then.to_bytes(1, signed=True) + table[first:]

    def run_counts(self, run: str) -> list[int]:
        """Token counts of the prefixes of a run of white space, from none to all characters."""
        raw, ends = self.piece_counts(run.encode()), [0]
        for c in run:
            ends.append(ends[-1] + len(c.encode()))
        return [raw[n] for n in ends]

    def add_units(self, units: set[str]) -> None:
        """Tables of units that aren't known yet, made together."""
        known, old = self.known, self.old
        again = units.intersection(old)
        known.update((u, old[u]) for u in again)
        plan, wanted = {}, set(self.shortened)
        for unit in units - again:
            if len(unit) > 1 and unit[0].isspace() and unit[1].isspace():
                rest = unit.lstrip()
                plan[unit] = None
                wanted.update(self.split(unit[len(unit) - len(rest) - 1 :]) if rest else ())
            else:
                plan[unit] = self.pieces_of(unit)
                wanted.update(plan[unit])
        tables = dict(self.shortened)
        short = [p for p in wanted - self.shortened.keys() if len(p) <= MEMO_BYTES]
        for i in range(0, len(short), PIECES):
            tables.update(zip(short[i : i + PIECES], self.piece_tables(short[i : i + PIECES])))
        tables.update((p, self.piece_table(p)) for p in wanted if p not in tables)
        for unit, pieces in plan.items():
            if pieces is None:
                known[unit] = self.run_table(unit, tables)
            else:
                known[unit] = tables[pieces[0]] if len(pieces) == 1 else b"".join([tables[p] for p in pieces])

    def count(self, text: str) -> int:
        return sum(self.piece_counts(p.encode())[-1] for p in self.split(text))

    def units_of(self, text: str) -> list[str]:
        """Units of a text without special strings: no prefix that ends within one changes how the text before it is split."""
        if self.double(text) or text[:1].isspace() or text[-1:].isspace():
            return self.units(text)
        out = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append("\n")
            first, *rest = line.split(" ")
            out.append(first)
            out += [" " + w for w in rest]
        return out

    def tables(self, texts: list[str]) -> list[bytes]:
        """Signed 8-bit differences of the token count, one for each UTF-8 byte of each text."""
        if len(self.known) > MEMO_UNITS:  # two generations: units in use move on
            self.old, self.known = self.known, {}
        special = {i for i, t in enumerate(texts) if self.special.search(t)}
        units = [[] if i in special else self.units_of(t) if t else [] for i, t in enumerate(texts)]
        new = set().union(*units).difference(self.known)
        if new:
            self.add_units(new)
        known = self.known.__getitem__
        out = [b"".join(map(known, u)) for u in units]
        for i in special:
            out[i] = self.table(texts[i])
        for unit in [u for u in new if len(u) > MEMO_BYTES]:
            self.known.pop(unit, None)
        return out

    def table(self, text: str) -> bytes:
        """The table of one text with special strings: each counts as one token once whole; before that it is ordinary text."""
        out, begin = [], 0
        for found in self.special.finditer(text):
            before, special = text[begin : found.start()], found[0]
            at = len(before)  # the last word and the blanks before it are what the partial string could change
            while at and not before[at - 1].isspace():
                at -= 1
            while at and before[at - 1].isspace():
                at -= 1
            base, total = self.count(before[at:]), [0]
            total += [self.count(before[at:] + special[:n]) - base for n in range(1, len(special))] + [1]
            out += [self.tables([before])[0], b"".join((b - a).to_bytes(1, signed=True) for a, b in zip(total, total[1:]))]
            begin = found.end()
        return b"".join([*out, *self.tables([text[begin:]])])


def counts_at(table: bytes) -> np.ndarray:
    """Token counts at every byte prefix, 0 to all, from a document's table."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)])


def fits(table: bytes, budget: int, raw: bytes) -> int:
    """The most bytes that a prefix of whole characters can have with at most ``budget`` tokens; 0 bytes always fit."""
    ends = np.append((np.frombuffer(raw, np.uint8) & 192) != 128, True)  # places where a character begins or the text ends
    return int(np.flatnonzero((counts_at(table) <= budget) & ends)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_token_counts(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", keep_tables: bool = False) -> DataFrame:
    """One row for each row of ``df``: id, n_bytes, n_tokens, over_limit, limit_bytes, and the table if kept.

    ``limit_bytes`` is the longest prefix, in bytes at the end of a character, with at most
    ``limit`` tokens. A null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each;
    an empty input gives an empty result; columns other than the two named are not read.
    """
    common.small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    extra = ", prefix_table binary" if keep_tables else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_of = counter(vocabulary).tables
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tables = tables_of(texts)
            n_bytes = list(map(len, tables))
            steps = [np.frombuffer(t, np.int8) for t in tables]
            n_tokens = [int(s.sum(dtype=np.int64)) for s in steps]
            cut = [n if k <= limit else fits(t, limit, x.encode()) for n, k, t, x in zip(n_bytes, n_tokens, tables, texts)]
            out = {id_col: batch.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())}
            out |= {"over_limit": pa.array([k > limit for k in n_tokens], pa.bool_()), "limit_bytes": pa.array(cut, pa.int64())}
            if keep_tables:
                out["prefix_table"] = pa.array(tables, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return df.select(id_col, text_col).mapInArrow(work, f"{id_col} {id_type}, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long{extra}")


def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    return prefix_token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)
