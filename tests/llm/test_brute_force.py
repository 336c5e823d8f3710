"""Operators against plain Python on small tables."""

import bisect
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chunkwell.llm import bpe, chat, common, components, fingerprint, line_dedup, mixing, simhash_dedup, toxicity, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, sf):
    return common.table(spark, sf, "documents")


def test_cascade_is_exact(spark):
    keys = [(f"host{i}.example", i % 7 == 0) for i in range(3000)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    for bits in (4, 12):  # few bits make many levels
        cascade = url_filters.Cascade(universe, bits_per_key=bits)
        assert universe.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    assert len(cascade.levels) >= 2


def test_mixing_contract(spark, sf):
    rows = mixing.op4_mixing(spark, sf).join(docs(spark, sf).select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    weights = dict(zip(sorted(sizes), [3, 1, 2] * len(sizes)))
    left, want, goal = set(sizes), {}, 1.5 * sum(sizes.values())
    while left:
        level = (goal - sum(want.values())) / sum(weights[s] for s in left)
        full = {s for s in left if weights[s] * level > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in full} if full else {s: weights[s] * level for s in left}
        left = left - full if full else set()
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * goal
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK
    again = mixing.op4_mixing(spark, sf).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.op4_mixing(spark, sf).collect())


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 100, 257):
        frame = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), 17).alias("p"))
        assert sorted(r["p"] for r in frame.collect()) == list(range(n))


def test_mix_stage_takes_whole_words(spark, sf):
    documents = docs(spark, sf)
    original = {r["doc_id"]: r["text"] for r in documents.collect()}
    total = 0
    for r in mixing.mix_stage(spark, documents, sf).collect():
        words = WORD.findall(r["text"])
        total += len(words)
        assert set(words) <= set(WORD.findall(original[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    size = sum(len(WORD.findall(t)) for t in original.values())
    assert abs(total - 1.5 * size) < 0.05 * size


def test_bpe_is_the_library(spark, sf):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(0x500), *range(0x1E00, 0x2100), *range(0x3040, 0x3100), 0x1F600, 0x130, 0x3A3, 0xFA6C, 0x558, 0x11DE0]]
    texts = [r["text"] for r in docs(spark, sf).collect()]
    texts += ["", " ", "aaaa aaaaa " * 50, "<|startoftext|>Hello<|endoftext|>x", "<|STARTOFTEXT|>", "ΑΣ. it's we'LL 1234 ½", "!" * 999, "a" * 5000]
    texts += ["".join(rng.choice(pool) for _ in range(60)) for _ in range(500)]
    for group in bpe.pieces(texts):
        for text, (n, ids, decoded) in zip(group, own.encode_batch(group)):
            want = library.encode(text, add_special_tokens=False).ids
            assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False))


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, threshold):
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= threshold:
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fps}


def test_simhash(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in docs(spark, sf).collect()}
    got = {r["doc_id"]: r for r in simhash_dedup.op9_simhash_dedup(spark, sf).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    heads = brute_components(set(fps.values()), 2)
    least = {}
    for i, f in fps.items():
        least[heads[f]] = min(i, least.get(heads[f], i))
    assert {i: r["component_id"] for i, r in got.items()} == {i: least[heads[f]] for i, f in fps.items()}


def test_anchor_links_lose_nothing(spark):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(12):  # chains and stars of near fingerprints, also across the halves and the sign
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.add(base)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    pairs = simhash_dedup.links(spark.createDataFrame(signed, "fp long"), 2)
    linked = {r["u"] & (1 << 64) - 1: r["v"] & (1 << 64) - 1 for r in components.components(pairs).collect()}
    want, groups, mine = brute_components(fps, 2), {}, {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
        mine.setdefault(linked.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    for a, b in ((r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in pairs.collect()):
        assert bin(a ^ b).count("1") <= 2


def test_cell_of_many_is_a_tree():
    base = np.zeros(1, np.uint64)
    fp = np.array([0] + [1 << b for b in range(40)], np.uint64).view(np.int64)
    links = simhash_dedup.cell_links(fp, np.ones(len(fp), bool), 2)
    assert len(links) == len(fp) - 1 and base[0] == 0


def test_golay_replicas():
    rng = np.random.default_rng(1)
    fp = rng.integers(-(2**63), 2**63 - 1, 50)
    anchor, index, home = simhash_dedup.replicas(fp)
    for k in range(50):
        mine = anchor[index == k]
        assert len(set(mine)) == len(mine) and home[index == k].sum() == 1
    #: two bits away: the home of one is among the other's anchors
    for k in range(50):
        other = np.array([int(fp[k]) ^ (1 << 5) ^ (1 << 30)], np.int64)
        a, _, h = simhash_dedup.replicas(other)
        assert a[h][0] in anchor[index == k]


def test_components_of_a_path(spark):
    n = 300
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["u"]: r["v"] for r in components.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


def test_line_dedup(spark, sf):
    rows = docs(spark, sf).collect()
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for r in rows:
        for line in r["text"].split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(r["doc_id"])
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = {}
    for r in rows:
        lines = r["text"].split("\n")
        kept = [x for x in lines if gone.get(key(x), r["doc_id"]) == r["doc_id"]]
        want[r["doc_id"]] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.op10_line_dedup(spark, sf).collect()}
    assert got == want
    stage = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup_stage(spark, docs(spark, sf), sf).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in stage.items()} == {i: w[2] for i, w in want.items()}


def test_full_filters_change_nothing(spark, sf, monkeypatch):
    want = sorted(map(str, line_dedup.op10_line_dedup(spark, sf).collect()))
    monkeypatch.setattr(line_dedup, "seen_again", lambda d, *a: spark.sparkContext.broadcast(np.full(1 << (line_dedup.LEAST_BITS - 3), 255, np.uint8)))
    assert sorted(map(str, line_dedup.op10_line_dedup(spark, sf).collect())) == want


def test_fingerprints(spark, sf):
    rows = docs(spark, sf).orderBy(F.col("doc_id").desc()).collect()
    got = {r["doc_id"]: r for r in fingerprint.op7_fingerprints(spark, sf).collect()}
    for i, r in enumerate(rows):
        text, after = r["text"], rows[(i + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after["text"][:half]
        mine = got[r["doc_id"]]
        assert mine["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and mine["n_chars"] == len(text)
        bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert abs(mine["near_edited"] - bits(mine["fingerprint"], mine["edited_fingerprint"])) < 1e-12
        assert abs(mine["near_next"] - bits(mine["fingerprint"], got[after["doc_id"]]["fingerprint"])) < 1e-12
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.9 * len(got)
    for i, r in got.items():
        close = sum(bits(r["fingerprint"], o["fingerprint"]) >= 1 - fingerprint.RADIUS / 64 for o in got.values()) - 1
        assert r["n_near"] == (close if i % fingerprint.ASKED == 0 else None)


def test_many_ranges_are_one_order(spark, monkeypatch):
    monkeypatch.setattr(fingerprint.cuts, "__defaults__", (1 << 16, 3))
    frame = spark.createDataFrame([(i * 7 % 101, f"text {i} of many words") for i in range(101)], "doc_id long, text string")
    rows = fingerprint.with_next(frame).filter("ghost = 0")
    assert rows.count() == 101 and rows.select("bucket").distinct().count() > 10
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.fingerprint_documents(frame).collect()}
    texts = {i * 7 % 101: f"text {i} of many words" for i in range(101)}
    for i, t in texts.items():
        after, half = texts[(i - 1) % 101], len(t) // 2
        assert found[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_rank_among_many_bounds(spark):
    """As bisect has it, with all bounds as constants: what is made of them for each row would grow as rows times bounds."""
    rng = random.Random(3)
    place = lambda: (rng.randrange(-40, 40), rng.randrange(-3, 3))
    frame = spark.createDataFrame([(place(),) for _ in range(300)], "p struct<i:long,h:long>")
    for n in (0, 1, 2, 3, 4, 7, 8, 200, 5000):
        bounds = sorted({place() if n < 5000 else (rng.getrandbits(60), 0) for _ in range(n)})
        ranked = frame.select("p", fingerprint.rank_among(F.col("p"), bounds).alias("rank"))
        assert all(r["rank"] == bisect.bisect_right(bounds, tuple(r["p"])) for r in ranked.collect())
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        assert not n or not any(x in plan for x in ("arrays_zip", "slice(", "split("))


def test_block_tables_find_all(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fps for _ in range(4)]
    frame = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    got = {(r["query"] & (1 << 64) - 1, r["fp"] & (1 << 64) - 1) for r in fingerprint.near(frame, frame).collect()}
    assert got == {(a, b) for a in fps for b in fps if bin(a ^ b).count("1") <= fingerprint.RADIUS}


def test_toxic_words_are_learnt(spark, tmp_path):
    rng = random.Random(4)
    plain = ["river", "stone", "green", "paper", "window", "quiet", "morning", "garden", "letter", "silver"]
    bad = ["foulword", "vileterm", "nastyone"]
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        words = [rng.choice(plain) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(20, 120))]
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        marks.append((i, 0, int(toxic)))
    documents, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scored = toxicity.score_documents(documents, toxicity.fit(documents, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in scored) > 0.97 * len(scored)
    #: a word's hash does not depend on what stands around it
    a, b = toxicity.word_hashes(["foulword"])[0], toxicity.word_hashes(["x Foulword, y"])[0]
    assert a[0] == b[1]


def test_segments_decode_as_one_pass(spark, sf, monkeypatch):
    talks = chat.as_transcripts(common.table(spark, sf, "conversations"))
    model = chat.train(talks)
    got = {(r["conv_id"], r["seq"]): r["roles"] for r in chat.parse(talks.drop("role"), model).collect()}
    monkeypatch.setattr(chat, "SEGMENT", 2)
    assert {(r["conv_id"], r["seq"]): r["roles"] for r in chat.parse(talks.drop("role"), model).collect()} == got
    #: lines with a marker have its role
    for r in talks.collect():
        family, _ = chat.marker(r["fragment"].split("\n")[0])
        if family < len(chat.ROLES):
            assert got[r["conv_id"], r["seq"]][0] == r["role"]


def test_pipeline_decisions(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    frame, seen = docs(spark, sf), []
    for name, stage in corpus_pipeline.STAGES:
        frame = common.cut(stage(spark, frame, sf))
        seen.append((name, frame.count()))
    assert [n for n, _ in seen] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "bpe"]
    assert seen[0][1] >= 0.8 * docs(spark, sf).count() and seen[2][1] < seen[1][1]
    assert frame.filter("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == seen[-1][1]


def test_toxic_words_share_no_counts(spark):
    """Words that would share a cell of 2^20 keep counts of their own, and so do all of a large vocabulary."""
    cells = {}
    for i in range(20000):
        h = int(toxicity.word_hashes([f"w{i}"])[0][0]) >> 3 & ((1 << 20) - 1)
        if h in cells:
            break
        cells[h] = i
    foul, plain = f"w{i}", f"w{cells[h]}"
    rows, marks = [], []
    for i in range(600):
        toxic = i % 6 == 0
        rows.append((i, " ".join(["some", "words", "here", foul if toxic else plain] * 5)))
        marks.append((i, 0, int(toxic)))
    documents, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scored = toxicity.score_documents(documents, toxicity.fit(documents, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert scored and all(r["predicted"] == r["toxic"] for r in scored)


def test_texts_without_evidence_are_kept(spark, tmp_path):
    """Also if the fold of the logistic function has no toxic label."""
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % toxicity.FOLDS
    rows = [(i, ["", "common words", None][i % 3]) for i in range(300)]
    toxic = [i for i in range(300) if fold(i) > toxicity.FITTED][:3]
    rows = [(i, "foul " * 9 if i in toxic else t) for i, t in rows]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in toxicity.toxicity_stage(spark, documents, str(tmp_path)).collect()}
    assert kept >= {i for i in range(300)} - {*toxic}
