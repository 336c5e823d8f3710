"""The stages of the pipeline, each against plain Python on what the one before it kept."""

import itertools
import re
from collections import Counter

import pytest

from chunkwell.llm import bpe, common, simhash_dedup, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark):
    """Rows before and after each stage."""
    sf = "/root/testdata/sf0.001"
    frame, out = common.table(spark, sf, "documents"), {}
    for name, stage in STAGES.items():
        before = frame.collect()
        frame = common.cut(stage(spark, frame, sf))
        out[name] = before, frame.collect()
    return spark, sf, out


def test_toxicity_goes_by_the_score(kept):
    spark, sf, out = kept
    before, after = out["toxicity"]
    documents = common.table(spark, sf, "documents")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(documents, toxicity.fit(documents, common.table(spark, sf, "labels"))).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if score[r["doc_id"]] < 0.5)
    assert {r["doc_id"]: r for r in after}.items() <= {r["doc_id"]: r for r in before}.items()


def test_lines_go_but_in_the_largest_document(kept):
    before, after = kept[2]["line_dedup"]
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for r in before:
        for line in r["text"].split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(r["doc_id"])
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if gone.get(key(x), r["doc_id"]) == r["doc_id"]) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)


def test_one_of_each_group_of_near_copies_stays(kept):
    before, after = kept[2]["simhash_dedup"]

    def shingles(text):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text)]
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}

    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    up = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if up[a] != up[b] and len(sets[a] & sets[b]) >= simhash_dedup.SIMILARITY * len(sets[a] | sets[b]):
            least, most = sorted((up[a], up[b]))
            up = {i: least if u == most else u for i, u in up.items()}
    assert sorted(r["doc_id"] for r in after) == sorted(set(up.values())) and len(after) < len(before)
    assert {r["doc_id"]: r for r in after}.items() <= {r["doc_id"]: r for r in before}.items()


def test_mixed_texts_are_runs_of_their_documents(kept):
    before, after = kept[2]["mixing"]
    words = {r["doc_id"]: WORD.findall(r["text"]) for r in before}
    source, size, taken = {r["doc_id"]: r["source"] for r in before}, Counter(), Counter()
    for r in before:
        size[r["source"]] += len(words[r["doc_id"]])
    per = Counter()
    for r in after:
        mine, whole = WORD.findall(r["text"]), iter(words[r["doc_id"]])
        assert all(w in whole for w in mine)  # in their order
        taken[source[r["doc_id"]]] += len(mine)
        per[r["doc_id"]] += len(mine)
    assert all(n <= 2 * len(words[i]) for i, n in per.items())
    weights, full, goal = dict(zip(sorted(size), [3, 1, 2] * len(size))), {}, 1.5 * sum(size.values())
    while True:
        rest = [s for s in size if s not in full]
        level = (goal - sum(full.values())) / max(sum(weights[s] for s in rest), 1)
        new = {s: 2 * size[s] for s in rest if weights[s] * level > 2 * size[s]}
        if not new:
            break
        full |= new
    for s in size:
        assert abs(taken[s] - full.get(s, weights[s] * level)) <= 3 * 128


def test_ids_are_the_librarys(kept):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    before, after = kept[2]["bpe"]
    want = Counter()
    for r in before:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in after) == want and all(r["n_tokens"] == len(r["ids"]) for r in after)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string"


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, None, None, None, None, "s", "i"), (1, "", "en", "a", 0, "s", "i"), (None, "words of a text", "en", "a", 15, "s", "i"), (None, "words of a text", "en", "a", 15, "s", "i"), (2, "x" * 30 + "\n" + "y " * 400, "en", None, None, "s", "i")]
    for name, data in (("odd", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0, None), (None, 1, 1)][: len(data)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        if not data:
            assert got == []
        else:  # the empty texts and the repeated row go, as near copies and in the mix
            assert {r["doc_id"] for r in got} <= {None, 2} and all(r["n_tokens"] == len(r["ids"]) for r in got) and sum(r["doc_id"] == 2 for r in got) >= 1
