"""The methods themselves against plain Python: Kneser-Ney, Viterbi, TF-IDF, blocks and permutations, pivots, SimHash; and long texts."""

import itertools
import math
import random
import re
import struct
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

from chunkwell.llm import bpe, chat, common, embedding_dedup, fingerprint, licenses, line_dedup, mixing, simhash_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = -(1 << 63)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(*values, kinds=None):
    """Spark's xxhash64: each value's XXH64 with the one before as seed; longs as 8 bytes, ints as 4, strings as UTF-8."""
    h = 42
    for i, v in enumerate(values):
        kind = kinds[i] if kinds else "q"
        raw = v.encode() if kind == "s" else struct.pack("<" + kind, v)
        h = xxhash.xxh64_intdigest(raw, h)
    return signed(h)


def test_kneser_ney(spark):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        toxic = int(i % 4 == 0)
        words = [f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randint(0, 40))] + ["vile"] * (toxic * rng.randint(0, 3))
        rng.shuffle(words)
        rows.append((" ".join(words), toxic))
    counted = spark.createDataFrame(rows, "text string, toxic int").mapInArrow(toxicity.count, toxicity.COUNTS)
    model = toxicity.learn(counted)
    n, contexts = (Counter(), Counter()), {}
    for text, toxic in rows:
        words = text.split()
        n[toxic].update(words)
        for a, b in zip([None, *words], words):
            contexts.setdefault(b, set()).add(a)
    v, c, d = len(contexts), sum(map(len, contexts.values())), toxicity.DISCOUNT

    def p(word, k):
        shared = (len(contexts.get(word, ())) + 0.5) / (c + 0.5 * (v + 1))
        total = sum(n[k].values())
        return (max(n[k][word] - d, 0) + d * len(n[k]) * shared) / total

    for k in (0, 1):  # with one place for unseen words it is a distribution
        assert abs(sum(p(w, k) for w in [*contexts, "unseen"]) - 1) < 1e-9
    texts = [r[0] for r in rows] + ["vile w1 never w2", "", "VILE! vile"]
    for text, got in zip(texts, model.difference(texts)):
        words = re.findall(r"\w+", text.lower())
        logs = [math.log(p(w, 1) / p(w, 0)) for w in words]
        want = sum(math.copysign(max(abs(x) - toxicity.ZONE, 0), x) for x in logs) / (len(words) + toxicity.LENGTH)
        assert abs(got - want) < 1e-9
    assert toxicity.beyond and model.difference(["vile"])[0] > 0


def test_portions_of_a_text_count_as_one(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{i % 17}" for i in range(500))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "w1 w2", None]), pa.array([1, 0, 0])], ["text", "toxic"])

    def total():
        out = Counter()
        for b in toxicity.count(iter([batch])):
            for prev, word, n0, n1 in zip(*(c.to_pylist() for c in b.columns)):
                out[prev, word] += n0 * 1000 + n1
        return out

    want = total()
    monkeypatch.setattr(toxicity.groups, "__defaults__", (64,))
    assert total() == want


@pytest.mark.parametrize("bound", [3, 15])
def test_words_beyond_the_broadcast_are_joined(spark, monkeypatch, tmp_path, bound):
    """Scores and decisions are the same whether workers hold all words that differ or few of them."""
    rng = random.Random(3)
    plain, foul = [f"w{i}" for i in range(400)], [f"vile{i}" for i in range(30)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(0, 60))] + [foul[min(int(rng.paretovariate(0.6)), 29)] for _ in range(4 * toxic)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), i, "x"))
        marks.append((i, 0, int(toxic)))
    rows += [(None, None, 0, None), (None, "vile1 vile2 vile1", 0, None), (7, rows[7][1], 7, "x"), (601, "", None, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, _row long, _difference string")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = common.table(spark, str(tmp_path), "labels")

    def found():
        scorer = toxicity.fit(documents, labels)
        scores = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["predicted"], r["score"]) for r in toxicity.score_documents(documents, scorer).collect()))
        kept = toxicity.toxicity_stage(spark, documents, str(tmp_path))
        assert kept.columns == documents.columns
        return scorer, scores, sorted(map(repr, kept.collect()))

    all_known, want, kept = found()
    assert all_known.model.tail is None and 0 < len(kept) < len(rows)
    monkeypatch.setattr(toxicity, "BROADCAST_WORDS", bound)
    scorer, got, also = found()
    assert len(scorer.model.keys) <= bound and scorer.model.tail.count() and also == kept
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))
    none = documents.limit(0)
    assert toxicity.score_documents(none, scorer).count() == 0


def test_viterbi_is_the_best_of_all_paths(spark, monkeypatch):
    rng = random.Random(6)
    lines = ["User: hi?", "ok", "", "Assistant: " + "long " * 50, "- item", "system: x", "why?", "Bob: hello"]
    rows = [(c, s, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 2))), rng.choice(chat.ROLES)) for c in range(6) for s in range(rng.randint(1, 4))]
    rows += [(None, None, "User: alone\nthen", None), (None, 3, "x?", None)]
    talks = spark.createDataFrame(rows, "conv_id long, seq long, fragment string, role string")
    model = chat.train(talks)
    monkeypatch.setattr(chat, "SEGMENT", 2)
    got = {(r["conv_id"], r["seq"]): r["roles"] for r in chat.parse(talks.drop("role"), model).collect()}

    def weigh(path, seen, begins):
        out = model.start[path[0]]
        for a, b, begin in zip(path, path[1:], begins[1:]):
            out += model.steps[begin][a, b]
        return out + sum(model.emit[k][r, int(f)] for r, x in zip(path, seen) for k, f in enumerate(chat.features(x)))

    for group in [[r for r in rows if r[0] == c] for c in range(6)] + [[r] for r in rows if r[0] is None]:
        seen = [x for r in sorted(group, key=lambda r: r[1] or 0) for x in r[2].split("\n")]
        begins = [i == 0 for r in sorted(group, key=lambda r: r[1] or 0) for i, _ in enumerate(r[2].split("\n"))]
        best = max(weigh(p, seen, begins) for p in itertools.product(range(3), repeat=len(seen)))
        mine = [chat.ROLES.index(x) for r in sorted(group, key=lambda r: r[1] or 0) for x in got[r[0], r[1]]]
        assert abs(weigh(mine, seen, begins) - best) < 1e-9


def test_unmarked_turns_have_their_role(spark, sf):
    """Held out conversations; saying the most frequent role always is right for three in five of the turns without a marker."""
    talks = chat.as_transcripts(common.table(spark, sf.replace("sf0.001", "sf0.1"), "conversations"))
    held = talks.filter(chat.fold(talks.conv_id) == chat.HELD_OUT)
    got = {(r["conv_id"], r["seq"]): r["role"] for r in chat.parse(held.drop("role"), chat.train(talks.filter(chat.fold(talks.conv_id) != chat.HELD_OUT))).collect()}
    marked, bare, roles = [], [], Counter()
    for r in held.collect():
        unmarked = chat.marker(r["fragment"].split("\n")[0])[0] == chat.NONE
        (bare if unmarked else marked).append(got[r["conv_id"], r["seq"]] == r["role"])
        roles[r["role"]] += unmarked
    assert all(marked) and len(bare) > 100 and max(roles.values()) < 0.65 * len(bare) and sum(bare) >= 0.9 * len(bare)


def test_words_taken_by_blocks(spark, sf):
    """Packing, draws, permutations and the join in plain Python; the draw decides in which shards a document's words are put out."""
    per_shard, documents = 40, common.table(spark, sf, "documents")
    rows = documents.collect()
    found = {seed: {r["doc_id"]: r for r in mixing.mixed_documents(documents, per_shard, seed).collect()} for seed in (mixing.SEED, 5)}
    names = sorted({r["source"] for r in rows})
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
    tie = {r["doc_id"]: xxhash.xxh64_intdigest(r["text"], 42) for r in rows}
    signed = lambda x: x - (x >> 63 << 64)
    first, quota = 0, {}
    for rank, source in enumerate(names, 1):
        mine = [r["doc_id"] for r in rows if r["source"] == source]
        total, target = sum(size[i] for i in mine), found[5][mine[0]]["target"]
        blocks = math.ceil(total / mixing.BLOCK)
        slots = min(blocks * mixing.MOST, int(math.floor(target * blocks / total + 0.5)))
        quota[rank] = (mine, blocks, slots, first)
        first += slots

    def permuted(x, n, rank):
        for turn in range(1, mixing.ROUNDS + 1):
            k = spark_hash(mixing.SEED, turn, rank, kinds="iii") % n
            other = (k - x) % n
            if spark_hash(mixing.SEED, turn, rank, max(x, other), kinds="iiiq") >> 7 & 1:
                x = other
        return x

    for seed, got in found.items():
        drawn = {rank: [] for rank in quota}
        for slot in range(first):
            ticket = spark_hash(seed, slot, kinds="iq") % first
            drawn[next(k for k, (_, _, n, f) in quota.items() if f <= ticket < f + n)].append(slot // per_shard)
        last = -(-first // per_shard)
        for rank, (mine, blocks, slots, _) in quota.items():
            shards = (drawn[rank] + [last] * slots)[:slots]
            at = {}
            for i, shard in enumerate(shards):
                at.setdefault(permuted(i % blocks, blocks, rank), []).append(shard)
            start = 0
            for i in sorted(mine, key=lambda i: (spark_hash(i, signed(tie[i]), kinds="qq") % mixing.SALTS, i, signed(tie[i]))):
                words = Counter(w // mixing.BLOCK for w in range(start, start + size[i]))
                mine_at = [s for b in words for s in at.get(b, ())]
                assert got[i]["taken"] == sum(n * len(at.get(b, ())) for b, n in words.items())
                assert (got[i]["first_shard"], got[i]["last_shard"]) == (min(mine_at, default=None), max(mine_at, default=None))
                start += size[i]
    one, other = found.values()
    assert all(one[i]["taken"] == other[i]["taken"] for i in one)
    assert sum(one[i]["first_shard"] != other[i]["first_shard"] for i in one) > len(one) // 2


def test_tf_idf_of_all_terms(spark):
    rng = random.Random(8)
    pool = [f"word{i}" for i in range(30)] + ["the", "under", "license", "rights", "all", "of"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    headers = [t for _, t in licenses.TEMPLATES]
    for k in range(30):
        at = rng.randrange(len(texts))
        words = licenses.TERM.findall(headers[k % len(headers)].lower())
        words.insert(rng.randrange(len(words) + 1), rng.choice(pool))
        texts[at] += rng.choice(["\n", " "]) + " ".join(words) + rng.choice(["\n", " "]) + rng.choice(pool)
    rows = [(i, f"d/{i}.txt", t) for i, t in enumerate(texts)] + [(None, None, None)]
    got = {r["id"]: (r["own_licence"], r["own_score"]) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    held = Counter(w for t in texts for w in set(licenses.TERM.findall(t.lower())))
    weigh = lambda c: {w: n * (math.log((2 + len(texts)) / (1 + held[w])) + 1) for w, n in c.items()}
    found = 0
    for i, text in enumerate(texts):
        words, best = licenses.TERM.findall(text.lower()), []
        for name, template in licenses.TEMPLATES:
            v = weigh(licenses.terms(template))
            n = sum(licenses.terms(template).values())
            runs = [words[p : p + n] for p in range(max(len(words) - n, 0) + 1)] + [licenses.TERM.findall(x.lower()) for x in text.split("\n")]
            for run in runs:
                w = weigh(Counter(run))
                if w:
                    cos = sum(x * w.get(t, 0) for t, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values()))
                    best.append((cos, name))
        score = max(best)[0] if best else 0.0
        if score >= licenses.LEAST + 1e-9:
            found += 1
            assert abs(got[i][1] - score) < 1e-9 and got[i][0] in {n for c, n in best if c > score - 1e-9}
        elif score < licenses.LEAST - 1e-9:
            assert got[i] == (None, 0.0)
    assert found > 10 and got[None] == (None, 0.0)


@pytest.mark.parametrize("homes", [4096, 30, 8])
def test_pivots_lose_no_link(spark, monkeypatch, homes):
    """Over 20 pivots; with few homes for a task there are many tasks, and cells of several."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 40))
    vectors = [(centres[rng.integers(10)] + rng.normal(size=40) * rng.choice([0.05, 0.15, 0.3])).astype(np.float32).tolist() for _ in range(300)]
    vectors += [rng.normal(size=n).astype(np.float32).tolist() for n in [40] * 120 + [7] * 60]
    vectors += [None, [], [0.0] * 40, *vectors[:5]]
    monkeypatch.setattr(embedding_dedup, "HOMES", homes)
    monkeypatch.setattr(embedding_dedup, "HOMES_ROOT", 0)
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame).collect()}
    units = [np.array(v) / np.linalg.norm(v) if v and any(v) else None for v in vectors]
    up, links = list(range(len(vectors))), [0] * len(vectors)
    for i, j in itertools.combinations(range(len(vectors)), 2):
        a, b = units[i], units[j]
        if a is not None and b is not None and len(a) == len(b) and a @ b >= embedding_dedup.COSINE:
            links[i] += 1
            links[j] += 1
            up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    assert got == {i: (links[i], up[i]) for i in range(len(vectors))} and sum(links) > 500


def test_pivots_keep_entries_out_of_cells():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    x = embedding_dedup.unit(centres[rng.integers(40, size=2000)] + rng.normal(size=(2000, 16)) * 0.3)
    pivots = embedding_dedup.Pivots(x[:45].tolist(), math.sqrt(0.1))
    home, member = pivots.place(x)
    assert member[np.arange(2000), home].all() and member.mean() < 0.5
    i, j = np.nonzero(x @ x.T >= 0.95)
    assert member[j, home[i]].all()  # each link is found in the home cell of either
    low = pivots.bound(x)
    assert (low @ low.T >= x @ x.T - 1e-5).all()


def brute_simhash(text):
    words = WORD.findall(text.lower())
    terms = Counter(zip(words, words[1:])) if len(words) > 1 else Counter((w,) for w in words)
    votes = [0] * 64
    for term, n in terms.items():
        h = spark_hash(*term, kinds="s" * len(term)) & (1 << 64) - 1
        weight = n * min(sum(map(len, term)), fingerprint.HEAVIEST)
        for b in range(64):
            votes[b] += weight if h >> b & 1 else -weight
    return f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"


def test_simhash_bit_by_bit(spark, sf):
    rows = sorted(common.table(spark, sf, "documents").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.op7_fingerprints(spark, sf).collect()}
    for i, r in enumerate(rows):
        text, half = r["text"], len(r["text"]) // 2
        edited = text[: len(text) - half] + rows[(i + 1) % len(rows)]["text"][:half]
        assert got[r["doc_id"]]["fingerprint"] == brute_simhash(text)
        assert got[r["doc_id"]]["edited_fingerprint"] == brute_simhash(edited)


def test_repeated_and_null_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fingerprint.cuts, "__defaults__", (1 << 16, 5))
    rows = [(None, f"null {i} of some words") for i in range(60)] + [(7, f"seven {i} of some words") for i in range(60)] + [(i + 100, f"other {i} text") for i in range(30)] + [(7, "the same")] * 3
    placed = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).filter("ghost = 0").collect()
    per = Counter(r["bucket"] for r in placed)
    assert len(placed) == len(rows) and len({r["bucket"] for r in placed if r["doc_id"] == 7}) > 3 and max(per.values()) < 60
    found = fingerprint.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -spark_hash(r[1], kinds="s")))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want[i, fingerprint_sha(t[: len(t) - half] + after[:half])] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in found) == want


def fingerprint_sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_filters_grow_with_the_lines(spark, monkeypatch):
    """Few lines that occur once are suspected, also where the filter has as few positions as it may."""
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 8)
    monkeypatch.setattr(line_dedup, "CHUNK_BITS", 6)
    rows = [(i, "\n".join([f"a line of its own, number {i * 50 + k}" for k in range(50)] + ["a line that many documents hold"])) for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert line_dedup.filter_bits(documents) == 16
    twice = line_dedup.seen_again(documents).value
    once = [f"a line of its own, number {k}".encode() for k in range(10000)]
    assert line_dedup.suspected(once, twice).mean() < 0.1 and line_dedup.suspected([b"a line that many documents hold"], twice).all()


TEXT = "Plain words, some Ünïcödé and 123 digits\nand lines that end. "


def test_long_texts_go_through_in_portions():
    """Portions give what the whole text gives."""
    text = TEXT * 30000  # 1.8 million characters
    own = bpe.load(bpe.default_path())
    n, ids, decoded = own.encode_batch([text])[0]
    one = own.encode_words([TEXT * 3])[0]
    assert n == one[0] * 10000 and ids == " ".join([one[1]] * 10000) and decoded == " ".join([one[2]] * 10000)
    assert "".join(common.portions(text, 1 << 16)) == text and max(map(len, common.portions(text, 1 << 16))) <= 1 << 16
    assert b"\n".join(line_dedup.blocks(text)) == text.encode()
    words = text.split()
    hashes = np.concatenate(list(simhash_dedup.shingle_hashes(text, 3)))
    assert len(hashes) == len(words) - 2
    want = Counter(xxhash.xxh64_intdigest(" ".join("".join(c.lower() if c.isascii() else c for c in w) for w in words[i : i + 3]).encode(), 42) for i in range(1000))
    assert set(hashes.tolist()) >= set(want)


def test_a_text_of_100_mb_takes_bounded_memory():
    """Numbers of bytes above the text's own and its encodings' stay under some times its size."""
    text = TEXT * 1_600_000
    assert len(text.encode()) > 100_000_000
    tracemalloc.start()
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    assert model.difference([text])[0] == 0
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.reset_peak()
    assert sum(len(h) for h in simhash_dedup.shingle_hashes(text[: 20 << 20], 3)) > 0
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
