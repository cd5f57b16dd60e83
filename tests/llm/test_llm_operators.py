"""Each corpus operator against brute force, and on nulls, empty and very long texts, repeated rows, empty tables and
columns with clashing names."""

import hashlib
import math
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparrowdex.llm import brown, common, decontaminate, matroska, mixing, pii, quality, sharding, simhash, token_counts, token_store

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The white house. Don't we'll  see\n\n 'tis <|endoftext|> now", "", None, "the white house", "the white house", "été ñandú 日本語  　 x", "  lead and trail  ", "word " * 6000, "x" * 5000,
    "call +1 (017) 555-7713 or a.b@example.com", "A B C D E F G H I J K L M N", "\t\n \x0b", "!!! ??? $$$ 123 456", "The white house. Don't we'll  see now", "!!<|endoftext|><|endof",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, 2, 0.5, "z") for i, t in enumerate(TEXTS)] + [(3, "the white house", "en", 1, 2, 0.5, "z"), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, n_tokens int, score double, body string").repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("doc_id < 0")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_token_counts(docs, none):
    library = Tokenizer.from_file(BYTE)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.prefix_token_counts(docs, BYTE).collect())
    assert got == Counter((i, len((t or "").encode()), size(t), size(t) > 512) for i, t in pairs(docs))
    assert token_counts.prefix_token_counts(none, BYTE).count() == 0
    tables = token_counts.prefix_token_counts(docs, BYTE, limit=5, keep_tables=True).where("doc_id < 7").collect()
    for r in tables:
        text, counts = TEXTS[r["doc_id"]] or "", token_counts.counts_at(r["prefix_table"])
        for n in range(len(text) + 1):
            assert counts[len(text[:n].encode())] == size(text[:n]), (text, n)
        fits = max(n for n in range(len(text) + 1) if size(text[:n]) <= 5)
        assert size((text.encode()[: r["limit_bytes"]]).decode()) <= 5 and r["limit_bytes"] >= len(text[:fits].encode())


def test_token_counts_of_odd_texts():
    library, counter = Tokenizer.from_file(BYTE), token_counts.counter(BYTE)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = np.random.default_rng(7)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\u3000", "\xa0", "'s", "'re", "'", "the", "word", "Été", "日本", "12", "²", "!!", "$$", "<|endoftext|>", "<|endof", "😀", "x" * 70, "İ", " " * 9]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 12))) for _ in range(3000)]
    for n, (text, table) in enumerate(zip(texts, counter.tables(texts))):
        counts = token_counts.counts_at(table)
        assert len(table) == len(text.encode()) and counts[-1] == size(text), text
        if n < 200:
            assert all(counts[len(text[:k].encode())] == size(text[:k]) for k in range(len(text))), text


def test_long_runs_take_linear_time():
    library, counter = Tokenizer.from_file(BYTE), token_counts.counter(BYTE)
    for text in ("x" + " " * 20_000 + "y", "\n" * 20_000, "a" * 20_000, "<|endoftext|>" * 3000):
        began = time.perf_counter()
        counts = token_counts.counts_at(counter.tables([text])[0])
        assert time.perf_counter() - began < 2 and counts[-1] == len(library.encode(text, add_special_tokens=False).ids)


def test_quality(spark, docs, none, sf):
    table = lambda n: common.table(spark, sf, n)
    model = quality.train(table("documents"), table("labels"))
    rows = quality.score(table("documents"), model).where("held_out").join(table("labels"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    got = quality.score(docs, model, keep=("lang",)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.score(none, model).count() == 0
    flat = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, flat).collect()} == {0.5}


def test_quality_model_learns_an_interaction():
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_mixing(spark, docs, none, sf):
    all_docs, labelled = mixing.labelled_languages(spark, sf)
    got = mixing.mix(all_docs.select("doc_id", "text"), labelled, mixing.WEIGHTS).collect()
    totals = defaultdict(float)
    for r in got:
        assert r["rate"] >= 0 and abs(sum(r["domain_p"].values()) - 1) < 1e-9
        for k, p in r["domain_p"].items():
            totals[k] += r["rate"] * r["tokens"] * p
    whole = sum(r["tokens"] for r in got)
    for k, w in mixing.WEIGHTS.items():
        assert abs(totals[k] / whole - w) < 1e-4
    kept = mixing.mix(all_docs, labelled, mixing.WEIGHTS, keep_all=True)
    assert kept.where("copies < 1").count() == 0 and kept.count() == all_docs.count()
    small = mixing.mix(docs, docs.select("doc_id", "lang"), {"en": 1.0})
    assert small.count() == docs.count() and small.where("text IS NULL").first()["tokens"] == 0
    assert mixing.mix(none, none.select("doc_id", "lang"), {"en": 1.0}).count() == 0


def test_mixing_clips_at_zero(spark):
    members = spark.createDataFrame([(1, 100, 1, [1.0, 0.0]), (2, 100, 1, [0.0, 1.0])], "row long, tokens long, same long, p array<double>")
    steps = mixing.solve(members, np.array([300.0, 0.0]))
    rates = [r[0] for r in members.orderBy("row").select(mixing.rate(steps)).collect()]
    assert abs(rates[0] - 3) < 0.01 and 0 <= rates[1] < 0.01


def test_rates_meet_every_target_that_can_be_met(spark):
    """The optimum of the least squares is then 0."""
    rng = np.random.default_rng(9)
    for n in range(3):
        tokens, p = rng.integers(20, 200, 12), rng.dirichlet([0.6] * 3, 12)
        target = (tokens * np.maximum(0, rng.normal(1, 1, 12))) @ p
        members = spark.createDataFrame([(i, int(t), 1, [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "row long, tokens long, same long, p array<double>")
        rates = np.array([r[0] for r in members.orderBy("row").select(mixing.rate(mixing.solve(members, target))).collect()])
        scale = np.where(target > 0, target, target.sum())
        error = lambda r: np.linalg.norm(((tokens * r) @ p - target) / scale)
        assert (rates >= 0).all() and error(rates) <= 1e-5


def test_mixing_keeps_users_columns(spark):
    df = spark.createDataFrame([(1, "the cat", 7, "en"), (2, "le chat", 8, "fr")], "doc_id long, text string, row int, lang string")
    got = mixing.mix(df, df.select("doc_id", "lang"), {"en": 0.5, "fr": 0.5})
    assert {(r["doc_id"], r["row"]) for r in got.collect()} == {(1, 7), (2, 8)}


def test_shards(docs, none):
    got = sharding.shard_rows(docs, 4).collect()
    texts = dict(pairs(docs))
    assert len(got) == docs.count()
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        slots[r["shard"]].append(r["slot"])
        of_text[text].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())
    assert sharding.shard_rows(none, 4).count() == 0


def test_least_capacity_is_the_optimum(spark):
    rng = np.random.default_rng(1)
    old = sharding.FIRST_BITS
    sharding.FIRST_BITS = 3
    try:
        for n in (5, 300):
            sizes = rng.integers(1, 100, n)
            keys = rng.integers(0, 1 << 60, n)
            atoms = spark.createDataFrame(list(zip(map(int, keys), map(int, sizes))), "key long, bytes long")
            ordered = sizes[np.argsort(keys)]
            best = next(c for c in range(1, 100_000) if c >= ordered.max() and sharding.walk(np.cumsum(ordered), c, 7) is not None)
            begin, capacity = sharding.boundaries(atoms, 7)
            shard = np.searchsorted(np.array(begin), keys, side="right")
            assert capacity == best and np.bincount(shard, sizes).max() <= best
    finally:
        sharding.FIRST_BITS = old


def test_pseudonyms(spark, docs, none):
    texts = ["card 4111111111111111 and 4111 1111 1111 1111, not 4111111111111112", "on 2021-02-28, 31/12/1999, 12/31/1999, 05/17/2004, 02/29/2000, not 2021-02-30", "123-45-6789 899-99-9999 not 000-12-3456", "DE89370400440532013000 GB82WEST12345698765432", "ip 144.137.247.239 not 300.1.1.1 nor 4.0.", "+1 (017) 555-7713 x.y-9é@mail7.example.com", "", None, "word " * 20000 + "4111111111111111"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)] + [(0, texts[0], "p")], "doc_id long, text string, pii string")
    out = pii.pseudonymise(df, "key")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 10 and [len(rows[i]["pii"]) for i in range(9)] == [2, 4, 2, 2, 1, 2, 0, 0, 1]
    new = rows[0]["text"]
    assert "not 4111111111111112" in new and rows[0]["pii"][0]["value"] == rows[8]["pii"][0]["value"] == rows[0]["pii"][1]["value"].replace(" ", "")
    digits = [int(d) for d in rows[0]["pii"][0]["value"]]
    assert (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    assert "not 2021-02-30" in rows[1]["text"] and "31/12/1999" not in rows[1]["text"] and "05/17/2004" not in rows[1]["text"]
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out.select("doc_id", "text"), "key", invert=True).collect()}
    assert back == dict(enumerate(texts))
    assert pii.pseudonymise(none, "key").count() == 0 and pii.pseudonymise(docs, "key").count() == docs.count()


def test_more_formats_are_pseudonymised(spark):
    texts = ["call +44 20 7946 0958 or 030 1234567", "02/29/2000 and 02/29/1904, not 02/29/1900", "at 2001:db8::8a2e:370:7334 and FE80:0:0:0:1:2:3:4, not std::vec nor a::b", "+49 (30) 901820, +44 20 7946 0958", "room 0301 12345 at 12:30:45"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymise(df, "key")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [[p["kind"] for p in rows[i]["pii"]] for i in range(5)] == [["phone_abroad", "phone_trunk"], ["date", "date"], ["ipv6", "ipv6"], ["phone_abroad", "phone_abroad"], ["phone_trunk"]]
    assert rows[0]["pii"][0]["value"] == rows[3]["pii"][1]["value"] != "+44 20 7946 0958" and "not std::vec nor a::b" in rows[2]["text"] and "not 02/29/1900" in rows[1]["text"]
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(out.select("doc_id", "text"), "key", invert=True).collect()} == dict(enumerate(texts))
    years = spark.createDataFrame([(f"02/29/{y}",) for y in range(1904, 2100, 4)], "text string")
    assert pii.pseudonymise(years, "key").select("text").distinct().count() == 49


def test_numbers_are_those_of_a_plain_feistel_network(spark):
    def plain(digits, key, kind):
        n = len(digits)
        half = n // 2
        x, y, m, k = int(digits[:half]), int(digits[half:]), 10**half, 10 ** (n - half)
        for i in range(pii.ROUNDS):
            mixed = int(hashlib.sha256(f"{key}|{kind}|{n}|{i}|{y}".encode()).hexdigest()[:15], 16)
            x, y, m, k = y, (x + mixed) % m, k, m
        return f"{x:0{half}d}{y:0{n - half}d}"

    values = ["0175557713", "9999999999", "0000000000", "1234567890"]
    rows = spark.createDataFrame([(i, f"+1 ({v[:3]}) {v[3:6]}-{v[6:]}") for i, v in enumerate(values)], "doc_id long, text string")
    got = {r["doc_id"]: "".join(c for c in r["text"] if c.isdigit()) for r in pii.pseudonymise(rows, "k3y").collect()}
    assert got == {i: "1" + plain(v, "k3y", "phone") for i, v in enumerate(values)}


def test_feistel_is_a_permutation(spark):
    dates = spark.range(pii.DAYS).select(pii.feistel(F.floor(F.col("id") / 229), F.col("id") % 229, F.lit(319), F.lit(229), "k", "date", F.lit(0), False).alias("s"))
    assert dates.distinct().count() == pii.DAYS
    three = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x", False).alias("d"))
    assert three.distinct().count() == 1000 and three.where(F.length("d") != 3).count() == 0


def test_matroska(docs, none):
    got = matroska.media_features(matroska.to_media(docs)).collect()
    texts = defaultdict(list)
    for i, t in pairs(docs):
        texts[i].append(matroska.payload(t))
    for r in got:
        body = texts[r["doc_id"]][0]
        assert r["payload_bytes"] == len(body) and r["payload_sha256"] == hashlib.sha256(body).hexdigest() and r["tail_crc32"] == zlib.crc32(body[-64:])
    assert len(got) == docs.count() and matroska.media_features(matroska.to_media(none)).count() == 0
    assert matroska.packet_table(matroska.to_media(docs.where("doc_id = 7"))).agg(F.sum("size")).first()[0] == 30016


def test_matroska_reads_what_it_does_not_write():
    frames = [b"a" * 300, b"b" * 20, b"c" * 7]
    head = matroska.vint(1) + (5).to_bytes(2, "big")
    xiph = head + b"\x02\x02" + b"\xff\x2d" + b"\x14" + b"".join(frames)
    ebml = matroska.block_body(1, 5, frames)
    m = matroska
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, xiph) + m.number(m.BLOCK_DURATION, 9))
    unknown = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m.number(m.TIMESTAMP, 100) + m.element(0xEC, b"void") + group + m.element(m.SIMPLE_BLOCK, ebml)
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + unknown
    media = m.demux(data)
    assert [data[p.start : p.start + p.size] for p in media.packets] == frames * 4 and media.clusters == 2
    assert {p.time_ns for p in media.packets} == {105 * 10**6}
    for bad in (b"", data[:-3], b"\0" * 20):
        with pytest.raises(ValueError):
            m.demux(bad)


def brute_fingerprint(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = defaultdict(set)
    for i, t in pairs(docs):
        fps[brute_fingerprint(t, 3)].add(i)
    near = {f: {g for g in fps if (f ^ g).bit_count() <= 2} for f in fps}
    for r in got:
        f = int(r["fingerprint"], 16)
        reach, todo = set(), [f]
        while todo:
            if (x := todo.pop()) not in reach:
                reach.add(x)
                todo += near[x]
        ids = {i for x in reach for i in fps[x] if i is not None}
        assert r["doc_id"] in fps[f] and r["component_id"] == (min(ids) if ids else None)
    assert len(got) == docs.count() and simhash.near_duplicates(none).count() == 0


def test_bit_slices_and_full_buckets(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = set(base)
    for b in base[:15]:
        for _ in range(20):
            fps.add(b := b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps = sorted(fps)
    near = lambda a, b, r: (a ^ b).bit_count() <= r

    def classes(edges):
        root = {f: f for f in fps}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in edges:
            root[find(a)] = find(b)
        groups = defaultdict(set)
        for f in fps:
            groups[find(f)].add(f)
        return sorted(map(sorted, groups.values()))

    for r in (0, 1, 2, 3, 7, 24):
        planes = simhash.planes_of(fps)
        for f in fps[:20]:
            mask = simhash.within(f, planes, (1 << len(fps)) - 1, r)
            assert [i for i in range(len(fps)) if mask >> i & 1] == [i for i, g in enumerate(fps) if near(f, g, r)]
    want = classes([(a, b) for a in fps for b in fps if near(a, b, 2)])
    assert classes(simhash.forest(fps, 2)) == want
    old, simhash.BUCKET = simhash.BUCKET, 3
    try:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        edges = simhash.bucket_edges(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 2).collect()
    finally:
        simhash.BUCKET = old
    assert classes([(e["a"] % (1 << 64), e["b"] % (1 << 64)) for e in edges]) == want


def test_similar_groups(spark):
    rng = np.random.default_rng(3)
    rows, sets = [], {}
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for c in range(6):
            own = list(words)
            for k in rng.integers(0, 150, c):
                own[k] = f"x{g}{c}{k}"
            rows.append((len(rows), " ".join(own)))
    rows += [(100, rows[0][1]), (101, ""), (102, None), (0, rows[0][1])]
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for i in sets:
        for j in sets:
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    old = simhash.SIDE, simhash.WIDE, simhash.LEADERS
    try:
        for simhash.SIDE, simhash.WIDE, simhash.LEADERS in (old, (2, 2, 3), (2, 3, 1)):  # in slices only a few pairs meet
            got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert len(got) == len(rows) and all(r["component_id"] == find(r["doc_id"]) for r in got)
    finally:
        simhash.SIDE, simhash.WIDE, simhash.LEADERS = old
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_groups_with_repeated_lines(spark):
    rng, rows = np.random.default_rng(8), []
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words + words[100:112] * 200))]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    assert all(len(a & b) >= 0.9 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 15)).tolist(), rng.integers(0, 6, rng.integers(0, 15)).tolist()
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        assert decontaminate.common_subsequence(a, b) == row[-1]


def test_decontamination(spark, docs, none, sf):
    table = lambda n: common.table(spark, sf, n)
    texts, items = pairs(table("documents")), [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    planted = {(i, k) for i, t in texts for k, x in items if x.lower() in (t or "").lower()}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table("documents"), table("benchmark")).collect()}
    assert planted and planted <= got
    for i, k in got - planted:  # what else is found holds most words of the item in order
        own, theirs = decontaminate.word_ids(dict(items)[k]).tolist(), decontaminate.word_ids(dict(texts)[i]).tolist()
        assert decontaminate.common_subsequence(own, theirs) >= 0.8 * len(own)
    words = items[0][1].split()
    changed = " ".join(w if n % 9 else "other" for n, w in enumerate(words))
    more = spark.createDataFrame([(1, "some words before " + changed + " and after it"), (2, " ".join(reversed(words))), (3, None), (4, ""), (1, "unrelated text with the same id")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(more, table("benchmark")).collect()} == {(1, items[0][0])}
    assert sorted(r["text"] or "" for r in decontaminate.clean(more, table("benchmark")).collect()) == sorted(["", "", " ".join(reversed(words)), "unrelated text with the same id"])
    assert decontaminate.leaks(none, table("benchmark")).count() == 0
    assert decontaminate.clean(docs, table("benchmark").where("item_id < 0")).count() == docs.count()


def test_items_among_repeated_words_are_found(spark, sf):
    items = common.table(spark, sf, "benchmark")
    rows = [(r["item_id"], f"host{r['item_id']} " * 60 + r["text"] + f" host{r['item_id']}" * 60) for r in items.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {(i, i) for i, _ in rows} <= got


def test_paraphrases_long_texts_and_text_ids(spark, sf, monkeypatch):
    """Items with words replaced, left out and put in, against the longest common subsequence of the whole text; one is deep in a long text."""
    rng = np.random.default_rng(13)
    items = common.table(spark, sf, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("item_id"), "text")
    rows, held = [], {}
    new = lambda: f"qq{rng.integers(1 << 40)}"
    for r in items.collect():
        for kind in range(3):
            words = [w for t in r["text"].split() for w in ([t] if rng.random() > 0.14 else [[new()], [], [t, new()]][kind])]
            text = " ".join([new() for _ in range(rng.integers(80))] + words + [new() for _ in range(rng.integers(80))])
            own = decontaminate.word_ids(r["text"]).tolist()
            held[f"d{len(rows)}", r["item_id"]] = decontaminate.common_subsequence(own, decontaminate.word_ids(text).tolist()) >= decontaminate.SAME * len(own)
            rows.append((f"d{len(rows)}", text))
    first = items.orderBy("item_id").first()
    rows.append(("long", " ".join(f"n{i}" for i in range(decontaminate.STREAM - 20)) + " " + first["text"] + " z" * 200_000))
    held["long", first["item_id"]] = True
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), items).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    wanted = {k for k, v in held.items() if v}
    assert got <= wanted and len(got) >= 0.9 * len(wanted) and ("long", first["item_id"]) in got
    assert next(r["at"] for r in found if r["doc_id"] == "long") in range(decontaminate.STREAM - 60, decontaminate.STREAM)


def test_the_latent_space_decides_candidates_and_loses_none(spark, sf):
    """Every window that holds an item is among the candidates, few others are, and without directions all windows are."""
    d = decontaminate
    tables = [common.table(spark, sf, n) for n in ("documents", "benchmark")]
    texts, items = ([r["text"] for r in t.select("text").collect()] for t in tables)
    rng = np.random.default_rng(3)
    for text in items:  # kept by four words in five, between repeated words
        words = [w for w in text.split() if rng.random() < 0.85]
        texts.append("the " * 40 + " ".join(words) + " and" * 40)
    space, held = d.fit(*(d.hashed(t.select(F.lit(1).cast("long").alias("row"), "text"), "text") for t in tables))
    asked = [(j, d.word_ids(t), d.word_ids("")) for j, t in enumerate(items)]
    block, blind = d.Block(asked, held, space), d.Block(asked, held, d.Space(np.ones(d.BUCKETS), np.zeros((d.BUCKETS, 1))))
    cells = passed = holding = 0
    for text in texts:
        ids = d.word_ids(text)
        starts = np.arange(0, len(ids), d.STEP)
        if not len(ids):
            continue
        w, of = block.windows(ids, starts, np.zeros(len(starts), np.int64))
        low = np.append(ids % d.SHARED, d.SHARED)
        for w, i in zip(w.tolist(), of.tolist()):
            end = min(starts[w] + (block.steps[i] + 1) * d.STEP, len(ids))
            window, one = low[None, starts[w] : end], np.array([i])
            near = bool(block.candidates(window, one)[0])
            cells, passed = cells + 1, passed + near
            assert blind.candidates(window, one)[0]
            if d.verified(asked[i][1], asked[i][2], ids[starts[w] : end]):
                holding += 1
                assert near
    assert holding and passed < holding + 0.05 * cells


def test_answers_decide_paraphrases():
    ids = decontaminate.word_ids
    item = "one two three four five six seven eight nine ten answer forty two"
    kept = "one two three x five six y eight nine z answer forty two"
    assert decontaminate.verified(ids(item), ids("forty two"), ids(kept)) > 0.7 and decontaminate.verified(ids(item), ids("forty two"), ids(kept.replace("forty", "twelve"))) == 0
    assert decontaminate.verified(ids(item), ids(""), ids(kept)) == 0


def test_language_model(docs, none, sf, spark):
    got = brown.score_texts(docs).collect()
    counts = Counter()
    trains = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    rows = pairs(docs)
    for i, t in rows:
        if trains(i):
            counts.update(brown.tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        words = brown.tokens((t or "").encode())
        want[i, not trains(i), len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert brown.score_texts(none).count() == 0
    held = brown.score_texts(common.table(spark, sf, "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_scores_are_those_of_a_brute_force_class_bigram(spark, monkeypatch):
    monkeypatch.setattr(brown, "WORDS", 8)  # read on the driver only
    monkeypatch.setattr(brown, "FRAMES", 3)
    k = brown.CLASSES
    rng = np.random.default_rng(12)
    names = ["The", "of", "on", "cat", "dog", "mat", "hat", "one.", "two", "see,", *(f"w{i}" for i in range(40))]
    rows = [(i, " ".join(names[j] for j in np.minimum(rng.zipf(1.4, rng.integers(0, 30)) - 1, len(names) - 1))) for i in range(60)] + [(61, None), (5, "of the cat"), (None, "cat on mat")]
    trains = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    lines = [(i, trains(i), brown.tokens((t or "").encode())) for i, t in rows]
    count = Counter(w for _, train, line in lines if train for w in line)
    top = sorted(count, key=lambda w: (-count[w], brown.word_key(w)))[:8]
    top += [brown.END] * (brown.END not in top)
    unit = lambda w: top.index(w) if w in top else len(top) + brown.shape(w)
    total, frame = len(top) + brown.SHAPES, lambda u: u < 3 or u >= len(top)
    stream = [brown.END] + [w for _, train, line in lines if train for w in line]
    pairs = Counter((x, y) for x, y in zip(map(unit, stream), map(unit, stream[1:])) if frame(x) or frame(y))
    a, b, n = (np.array(x) for x in zip(*((x, y, pairs[x, y]) for x, y in sorted(pairs))))
    start = brown.exchange(a, b, n, total, k, np.array([0, 1, 2, *range(len(top), total)])).tolist()

    def smoothed(moves, mass):
        share = sum(mass)
        return [[math.log10((moves[c, d] + brown.PRIOR * mass[d] / share) / (sum(moves[c, e] for e in range(k)) + brown.PRIOR)) for d in range(k)] for c in range(k)], [math.log10(m) for m in mass]

    first = Counter()
    for (x, y), times in pairs.items():
        first[start[x], start[y]] += times
    mass = [1 + sum(count[w] + 1 for w in count if start[unit(w)] == c) for c in range(k)]
    move, log_mass = smoothed(first, mass)
    around = lambda line: zip(line[-1:] + line[:-1], line, line[1:] + line[:1])
    final = {}
    for w in {w for _, _, line in lines for w in line}:
        final[w] = start[unit(w)]
        if w not in top and count[w] >= brown.LEAST:
            gain = [sum(move[start[unit(p)]][c] + move[c][start[unit(q)]] for _, train, line in lines if train for p, x, q in around(line) if x == w) - count[w] * log_mass[c] for c in range(k)]
            best = max(range(k), key=lambda c: gain[c])
            final[w] = best if gain[best] > gain[final[w]] + 1e-9 else final[w]
    moves = Counter((final[p], final[w]) for _, train, line in lines if train for p, w, _ in around(line))
    mass = [1 + sum(count[w] + 1 for w in count if final[w] == c) for c in range(k)]
    move, log_mass = smoothed(moves, mass)
    want = sorted((str(i), round(sum(move[final[p]][final[w]] + math.log10(count[w] + 1) - log_mass[final[w]] for p, w, _ in around(line)), 6)) for i, _, line in lines)
    got = brown.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # adjacent documents of a task make bigrams of units across an end, which always stands between
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == want


def test_rare_words_of_one_shape_get_classes_of_their_contexts(spark):
    rng, rows = np.random.default_rng(6), ["lo big hi", "hi bag lo"] * 200
    names = ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) + "en" for _ in range(1200)]
    for i, w in enumerate(names):  # less than a thousandth of the tokens each
        rows += [f"lo {w} hi" if i % 2 else f"hi {w} lo"] * 3
    numbers = [i for i in range(8 * len(rows)) if zlib.crc32(str(i).encode()) % 7 != 2][: len(rows)]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    asked = [(held[0], f"lo {names[1]} hi"), (held[1], f"hi {names[1]} lo")]
    got = {r["doc_id"]: r["score"] for r in brown.score_texts(spark.createDataFrame([*zip(numbers, rows), *asked], "doc_id long, text string").repartition(3)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_bigrams_of_two_words_beyond_the_first_ones_decide_classes(spark):
    """Words whose neighbours are all beyond the most frequent words still get classes from them."""
    rng, texts = np.random.default_rng(8), [f"f{j}" for j in range(520)] * 30  # 500 words move first
    for _ in range(150):
        x, y = rng.integers(0, 30, (2, 4))
        texts.append(f"g{x[3]} " + " ".join(f"a{i} b{j}" for i, j in zip(x[:3], y[:3])) + f" g{y[3]}")
    numbers = [i for i in range(2 * len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    asked = [(held[0], "g1 a1 b1 a2 b2 g2"), (held[1], "g1 a1 a2 b1 b2 g2")]
    got = {r["doc_id"]: r["score"] for r in brown.score_texts(spark.createDataFrame([*zip(numbers, texts), *asked], "doc_id long, text string").repartition(3)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_exchange_in_parts_moves_units_as_one_with_all_bigrams(spark, monkeypatch):
    monkeypatch.setattr(brown, "PART", 7)  # read on the driver only
    rng, units, k = np.random.default_rng(9), 40, 5
    table = rng.integers(0, 9, (units, units)) * (rng.random((units, units)) < 0.4)
    table[11] = table[:, 11] = 0
    a, b = np.nonzero(table)
    n, mixed, first = table[a, b], rng.permutation(len(a)), np.array([0, 1, 2, 3, 38, 39])
    rows = [((a * units + b)[part].astype("<i4").tobytes(), n[part].astype("<i8").tobytes()) for part in np.array_split(mixed, 6)]
    for all_rounds in (1, 3):
        monkeypatch.setattr(brown, "ALL_ROUNDS", all_rounds)
        at, moves = brown.exchange_written(spark.createDataFrame([(bytearray(x), bytearray(y)) for x, y in rows], "pair binary, n binary").repartition(4), units, k, first)
        assert at.tolist() == brown.exchange(a, b, n, units, k, first, brown.ROUNDS, all_rounds).tolist()
        assert moves.ravel().tolist() == np.bincount(at[a] * k + at[b], n, k * k).tolist()


def test_class_model_sums_to_one():
    rng = np.random.default_rng(5)
    units, bigrams = 30, rng.integers(0, 20, (30, 30)).astype(float)
    a, b = np.nonzero(bigrams)
    classes = brown.exchange(a, b, bigrams[a, b], units, 5, np.arange(8), all_rounds=50)

    def likelihood(c):
        one = np.zeros((units, 5))
        one[np.arange(units), c] = 1
        t = one.T @ bigrams @ one
        log = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return log(t) - log(t.sum(0)) - log(t.sum(1))

    best = likelihood(classes)
    for u in range(units):
        for c in range(5):
            other = classes.copy()
            other[u] = c
            assert likelihood(other) <= best + 1e-6


def test_token_store(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(WORD)
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, WORD, path)
    got = sorted(token_store.read_store(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    start, rows = 0, defaultdict(list)
    for i, t in pairs(docs):
        rows[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    ids_in_order = [r["doc_id"] for r in got]
    assert ids_in_order == sorted(ids_in_order, key=lambda x: (x is not None, x)) and len(got) == docs.count()
    for r in got:
        raw = [np.array(x, "<u4").tobytes() for x in rows[r["doc_id"]]]
        assert r["start"] == start and bytes(r["ids"]) in raw and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["n_tokens"] == len(r["ids"]) // 4 and r["intact"]
        start += r["n_tokens"]
    assert token_store.verify_manifest(spark, path)
    empty = f"file://{tmp_path}/empty"
    token_store.write_store(none, WORD, empty)
    assert token_store.read_store(spark, empty).count() == 0


def test_token_store_notices_changes(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string"), WORD, path)
    chunks = token_store.objects(spark, path, 0).collect()
    changed = [(0, c["key"], c["body"] if n else bytes(c["body"])[:-2] + b"\x07\x00") for n, c in enumerate(chunks)]
    recipes = [(1, c["key"], c["body"]) for c in token_store.objects(spark, path, 1).collect()]
    spark.createDataFrame(changed + recipes, "kind int, key binary, body binary").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/objects")
    assert sorted(r["intact"] for r in token_store.read_store(spark, path).collect()) == [False, True]


def test_chunks_follow_content():
    rng = np.random.default_rng(6)
    body = rng.integers(0, 40_000, 20_000)

    def chunks(ids):
        out, start = [], 0
        for stop in token_store.cuts(token_store.marks(ids).tolist(), len(ids)):
            out.append(ids[start:stop].tobytes())
            start = stop
        assert b"".join(out) == ids.tobytes()
        return out

    a, b = chunks(body), chunks(np.concatenate([rng.integers(0, 40_000, 300), body]))
    assert len(set(a) & set(b)) > 0.9 * len(a) and max(map(len, a)) <= token_store.MOST * body.itemsize
    both = token_store.joined_crc(np.array([zlib.crc32(b"abc"), 0]), np.array([zlib.crc32(b"defg"), zlib.crc32(b"x")]), np.array([4, 1]), token_store._shift_tables())
    assert both.tolist() == [zlib.crc32(b"abcdefg"), zlib.crc32(b"x")]


def test_words_are_looked_up_a_text_at_a_time():
    enc = token_store.WordEncoder(WORD)
    texts = [b" ".join(b"word%d," % ((i * 31 + k * k) % 5000) for k in range(2000)) for i in range(200)]
    first = enc.encode(texts)
    tracemalloc.start()
    try:
        again = enc.encode(texts)
        held = tracemalloc.get_traced_memory()[1] - sum(map(len, again))
    finally:
        tracemalloc.stop()
    assert again == first and held < 2_000_000  # 400,000 words take over 16 MB
    # words of small letters by the shorter way, others by the library's, and words that come again before they are known
    odd = ["Naïve naïve café CAFÉ don't x1y z's, Zebra zebra. ΣΑΣ ſt <|endoftext|> zebra", "", "Zebra zebra zebra, qua qua", "ﬁ İstanbul é, é. 'tis"] * 120
    odd = [f"{t} {'abcdefghij'[n % 10] * (n % 7)}{n}" for n, t in enumerate(odd)]
    library = Tokenizer.from_file(WORD)
    assert token_store.WordEncoder(WORD).encode([t.encode() for t in odd]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in odd]
    assert enc.small and enc._word_ids([b"zebra", b"quagga", b"a"], enc.small) == enc._word_ids([b"zebra", b"quagga", b"a"], enc.library)


def test_marks_are_the_rolling_hash_of_each_place():
    ids, mask = np.random.default_rng(3).integers(49_000, size=2 * token_store.MARKED + 1000).astype("<u2"), (1 << 64) - 1
    mixed = [x ^ x >> 29 for x in ((int(i) + 1) * 0x9E3779B97F4A7C15 & mask for i in ids)]
    rolled = [sum(mixed[i - j] * pow(0xBF58476D1CE4E5B9, j) for j in range(min(token_store.WINDOW, i + 1))) & mask for i in range(len(ids))]
    want = [i + 1 for i, x in enumerate(rolled) if (x >> 40) % (token_store.USUAL - token_store.LEAST) == 0]
    assert token_store.marks(ids).tolist() == want
    assert token_store.marks(ids[:0]).tolist() == []


def test_bigrams_are_dealt_and_summed_as_arrays(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(k * k) % 40}" for k in rng.integers(60, size=int(rng.integers(30))))) for i in range(200)]
    trains = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    lines = [brown.tokens(t.encode()) for i, t in rows if trains(i)]
    top = sorted({w for line in lines for w in line} | {brown.END})[:12] + [brown.END]
    top = list(dict.fromkeys(top))
    model = brown.Model({brown.word_key(w): n for n, w in enumerate(top)}, None, None, None, None)
    unit = lambda w: top.index(w) if w in top else len(top) + brown.shape(w)
    words = sorted({w for line in lines for w in line})
    keys, units = model.units_of(words)
    assert keys.tolist() == list(map(brown.word_key, words)) and units.tolist() == list(map(unit, words)) == [model.unit_memo()[w] for w in words]
    want = Counter((unit(a), unit(b)) for line in lines for a, b in zip([brown.END, *line], line))
    made = brown.unit_bigrams(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), model, brown.FRAMES, 2, 7)
    plan = made._jdf.queryExecution().toString()
    assert "Aggregate" not in plan  # no row for each pair in the JVM
    got, total = Counter(), len(top) + brown.SHAPES
    for r in made.collect():
        for pair, n in zip(np.frombuffer(r["pair"], "<i4").tolist(), np.frombuffer(r["n"], "<i8").tolist()):
            assert divmod(pair, total) not in got
            got[divmod(pair, total)] = n
    assert got == want
    assert brown.unit_bigrams(spark.createDataFrame([], "doc_id long, text string"), model, brown.FRAMES, 2, 7).count() == 0
