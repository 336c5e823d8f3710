"""BPE encoding and decoding with a vocabulary file, by numpy merge rounds over many words at once.

The file has the layout of the tokenizers library: a normaliser (NFC, white space to
one space, lower case), a split into letters, single digits and other signs, bytes as
letters, merges with word ends, and special tokens that are cut out of the raw text first.

Words of a batch that are not in the cache are encoded together: the symbols of all are
one flat array with word numbers beside it. A round finds each neighbouring pair's
rank by binary search among the sorted pair keys, merges in each word the leftmost
pairs of lowest rank, and closes the gaps. Rounds end when no pair has a rank.

Memory: a batch has a bounded number of bytes, the cache a bounded number of words and a task's life, and
new words go through the rounds in slices. A long text is encoded in portions, cut before white space, which is in no word; a
word is processed whole, however long.

Nulls: a null text is an empty one, which has no ids: the digest of ids and text is that of the
empty string. Repeated rows, null ids and further columns make no difference. An empty
table gives an empty result. Lone surrogates do not occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, release, small_batches, table

#: Words kept in a worker's cache, and words that go through the merge rounds together.
CACHE, SLICE = 120_000, 30_000
#: Characters of a group of texts and of a portion of a long one.
GROUP = 1 << 19
FIRST, SECOND = itemgetter(0), itemgetter(1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter for each byte: printable ones of Latin-1 stand for themselves, the rest for those from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = re.compile(as_sets(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]))
        self.wide = re.compile("[\U00010000-\U0010ffff]")
        self.split_wide = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.path, self.library = path, None
        self.unknown = Unassigned()
        letters = byte_letters()
        self.bytes = {ord(c): b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        self.base = max(self.names) + 1
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.r_[order, len(order)], made[order]
        self.digits = [str(i) for i in range(self.base)]
        self.texts = [self.names.get(i, "") for i in range(self.base)]
        self.digits += ["\n" + x for x in self.digits]
        self.texts += ["\n" + x for x in self.texts]
        self.cache: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def look(self, pairs: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted keys, by binary search, or one past them."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, at, len(self.keys))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of each word's.

        A round looks up only those pairs that the last one changed.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        sym = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[flat[ends]]
        done_sym, done_word = [], []
        never = len(self.keys)
        at = np.full(len(sym), never)
        at[:-1] = np.where(word[:-1] == word[1:], self.look(sym[:-1] * self.base + sym[1:]), never)
        while len(sym):
            rank = self.ranks[at]  # of the pair that begins at a symbol
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(word)])
            live = low < never
            if not live.all():  # finished words leave the arrays
                keep = np.repeat(live, lengths)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
                low, lengths = low[live], lengths[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lengths))
            #: of overlapping hits (the same symbol again and again) every other one counts, from the left
            near = np.diff(hit) == 1
            if near.any():
                first = np.r_[True, ~near]
                begin = hit[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]
                hit = hit[(hit - begin) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))  # where the merged symbols stand once the gaps are closed
            sym, word, at = sym[keep], word[keep], at[keep]
            changed = np.zeros(len(sym), bool)
            changed[now] = True
            changed[now[now > 0] - 1] = True
            if changed[-1]:
                at[-1], changed[-1] = never, False
            turn = np.flatnonzero(changed)
            at[turn] = np.where(word[turn] == word[turn + 1], self.look(sym[turn] * self.base + sym[turn + 1]), never)
        ids = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        of = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Put words into the cache, with their ids and tokens, each joined by spaces."""
        for i in range(0, len(words), SLICE):
            part = words[i : i + SLICE]
            ids, counts = self.merge([w.encode() for w in part])
            marked = ids.copy()
            marked[np.r_[0, np.cumsum(counts)[:-1]]] += self.base  # a new line before each word's first
            marked = marked.tolist()
            ids, tokens = (" ".join(map(names.__getitem__, marked))[1:].split(" \n") for names in (self.digits, self.texts))
            self.cache.update(zip(part, zip(ids, tokens)))

    def words(self, text: str) -> list[str]:
        """Words of a text; a special token is a word of its own."""
        out: list[str] = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(part)
            elif part:
                if part.isascii():
                    out += self.split.findall(part.lower())
                elif self.unknown.search(part):
                    out += self.newer(part)
                else:
                    part = lower(unicodedata.normalize("NFC", part))
                    out += (self.split_wide if self.wide.search(part) else self.split).findall(part)
        return out

    def newer(self, part: str) -> list[str]:
        """Words of a text with characters younger than Python's Unicode tables: the library's own tables split it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(self.bytes[ord(c)] for c in w).decode() for w, _ in split]

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, the ids joined by spaces and the decoded text."""
        if any(len(t) > 2 * GROUP for t in texts):
            return [self.encode_long(t) if len(t) > 2 * GROUP else self.encode_words([t])[0] for t in texts]
        return self.encode_words(texts)

    def encode_words(self, texts: list[str]) -> list[tuple[int, str, str]]:
        if len(self.cache) > CACHE // 2:  # what is used again moves on from the old half
            self.old, self.cache = self.cache, {}
        each = list(map(self.words, texts))
        self.cache.update({token: (str(i), token) for token, i in self.special.items()})
        missing = set(chain.from_iterable(each)).difference(self.cache)
        known = missing.intersection(self.old)
        self.cache.update(zip(known, map(self.old.__getitem__, known)))
        self.learn(list(missing - known))
        out = []
        for words in each:
            found = list(map(self.cache.__getitem__, words))
            ids = " ".join(map(FIRST, found))
            out.append((ids.count(" ") + bool(ids), ids, " ".join(map(SECOND, found))))
        return out

    def encode_long(self, text: str) -> tuple[int, str, str]:
        found = []
        for part in portions(text, GROUP):
            found += self.encode_words([part])
        n, ids, decoded = zip(*(x for x in found if x[0])) if any(x[0] for x in found) else ((), (), ())
        return sum(n), " ".join(ids), " ".join(decoded)

    def forget(self) -> None:
        """At a task's end: what the next one in this worker may not need."""
        self.cache, self.old = {}, {}
        release()

    def encode(self, text: str) -> list[int]:
        ids = self.encode_batch([text])[0][1]
        return [int(i) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the file names no decoder; unknown ids have none."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def as_sets(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N} and \s written out for characters up to U+FFFF, for ``re``, which makes bitmaps of them."""

    def written(test) -> str:
        return "".join(re.escape(chr(c)) for c in range(0x10000) if test(chr(c)))

    space = regex.compile(r"\s")
    sets = {r"\p{L}": written(lambda c: unicodedata.category(c)[0] == "L"), r"\p{N}": written(lambda c: unicodedata.category(c)[0] == "N"), r"\s": written(space.match)}
    out = pattern
    for name, members in sets.items():
        out = out.replace(f"[{name}]", f"[{members}]") if f"[{name}]" in out else out
        out = out.replace(name, members)
    return out


class Unassigned:
    """Finds characters that Python's own tables do not know, about which those of ``regex`` and the tokenizers library differ."""

    def __init__(self):
        free = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn"]
        self.low = re.compile("[" + "".join(map(re.escape, map(chr, free))) + "]")  # a bitmap
        self.high = re.compile("[\U00010000-\U0010ffff]")

    def search(self, text: str) -> bool:
        if self.low.search(text):
            return True
        return bool(self.high.search(text)) and any(unicodedata.category(c) == "Cn" for c in self.high.findall(text))


def lower(text: str) -> str:
    """Letter by letter: other than in ``str.lower``, a sigma at a word's end is no special case."""
    if text.isascii() or "Σ" not in text:
        return text.lower()
    return "".join(map(str.lower, text))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def pieces(texts: list[str], most: int = GROUP) -> Iterator[list[str]]:
    """Texts in groups of about ``most`` characters; one text is never split."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group


def encode_documents(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Ids and decoded text of each document; as digests unless ``full``."""
    path = path or default_path()
    small_batches(documents.sparkSession)

    names = ["doc_id", "n_tokens", "ids", "decoded"] if full else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            for group in pieces(texts):
                n, ids, decoded = zip(*bpe.encode_batch(group))
                if full:
                    flat = np.fromstring(" ".join(filter(None, ids)), np.int32, sep=" ")
                    columns = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())]
                else:
                    columns = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in part], pa.string()) for part in (ids, decoded)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(n, pa.int64()), *columns], names)
                at += len(group)
        bpe.forget()

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, " + ("ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string")
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def bpe_stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text, and the text that they decode to."""
    return encode_documents(documents, full=True)


QUERIES = {"op8_bpe": op8_bpe}
SQL: dict[str, str] = {}
