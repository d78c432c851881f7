"""Token ids and token counts of whole texts, exactly as the tokenizer's own library gives them.

White space separates words in the vocabularies with word ends, so a text's ids are those of its words in order.
Words repeat: each worker keeps the ids of those it has met, for a bounded number of words. Counting adds a first
tier in front, a broadcast table with the lengths of the most frequent words of the whole input.
"""

from __future__ import annotations

import json
from collections import Counter
from heapq import nlargest

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from fieldorder.llm.common import MEMO, hold, map_rows

#: Words in the broadcast table: the bound on its size.
FREQUENT = 65_536

#: Separators that str.split knows and the library may not, or the other way: such texts are encoded whole.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "᠎", "﻿")

#: Words that a worker remembers: half of them met lately, half from before.
WORDS = 800_000

#: Characters of text that one round of lookups covers.
ROUND = 1_000_000


class WholeTexts:
    """sentencepiece models: no memo, since pieces may span words."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]


def latin(text: str) -> bool:
    """Whether a text has no character above U+00FF, so that lower case is made character by character."""
    return text.isascii() or max(text) < "Ā"


class WordMemo:
    """tokenizers files: words by memo where white space is dropped between words, else whole texts."""

    def __init__(self, blob: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tok = Tokenizer.from_str(blob.decode())
        config = json.loads(blob)
        self.special = tuple(x["content"] for x in config["added_tokens"])
        first = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.split = None
        if config["model"].get("end_of_word_suffix") and first.get("behavior") == "Removed" and first.get("invert"):
            self.split = regex.compile(first["pattern"]["Regex"]).findall
            self.final = np.zeros(self.tok.get_vocab_size(), bool)  # ids that end a word
            end = config["model"]["end_of_word_suffix"]
            self.final[[i for t, i in self.tok.get_vocab().items() if t.endswith(end)]] = True
            # for lower-case parts that are split already: the same model without normalizer and pattern
            self.bare = Tokenizer(self.tok.model)
            self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are one word each, encoded in one go and cut at the ids that end a word."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(some):
                out += self.library(some)
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def plain(self, text: str) -> bool:
        """Whether the text's ids are those of its words in order."""
        return self.split is not None and not any(x in text for x in (*self.special, *ODD_SPACE))

    def learn(self, words: list[str]) -> None:
        """Put words into the memo; many words share parts between letters and signs."""
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        plain, others = [], []
        for w in words:
            (plain if latin(w) else others).append(w)
        self.words.update(zip(others, self.library(others)))
        parts = {w: self.split(w.lower()) for w in plain}
        new = list({p for ps in parts.values() for p in ps if p not in self.pieces})
        self.pieces.update(zip(new, self.together(new)))
        get = self.pieces.__getitem__
        self.words.update({w: get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps)) for w, ps in parts.items()})

    def ids(self, texts: list[str]) -> list[bytes]:
        # Latin texts in lower case, as the library makes them: fewer words to learn
        split = [(t.lower() if latin(t) else t).split() if self.plain(t) else None for t in texts]
        if len(self.words) > WORDS // 2:  # words in use come back from the older half, the others are forgotten
            self.before, self.words = self.words, {}
        memo, before = self.words, self.before
        found = [None if ws is None else list(map(memo.get, ws)) for ws in split]
        missing = {w for ws, got in zip(split, found) if ws and None in got for w, x in zip(ws, got) if x is None}
        known = missing & before.keys()
        memo.update({w: before[w] for w in known})
        if len(known) < len(missing):
            self.learn(list(missing - known))
        get = memo.__getitem__
        out = []
        for t, ws, got in zip(texts, split, found):
            if ws is not None and None in got:
                got = [get(w) if x is None else x for w, x in zip(ws, got)]
            out.append(self.library([t])[0] if ws is None else b"".join(got))
        return out


_ENCODERS: dict[int, WordMemo | WholeTexts] = {}


def encoder(file: Broadcast):
    """The worker's encoder for a broadcast tokenizer file, made once and kept over tasks."""
    hold(_ENCODERS)
    name, blob = file.value
    key = hash((name, len(blob), blob[-64:]))
    if key not in _ENCODERS:
        _ENCODERS[key] = WholeTexts(blob) if name.endswith(".model") else WordMemo(blob)
    return _ENCODERS[key]


def tokenizer_file(spark: SparkSession, path: str) -> Broadcast:
    """Ship the vocabulary file (a few MB whatever the input), so executors need no copy of their own."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((path, f.read()))


def rounds(texts: list[str]):
    """(from, to) of consecutive texts with about ROUND characters together."""
    at = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= ROUND:
            yield at, i + 1
            at, chars = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def ids_of(file: Broadcast, part: list[tuple], end: int | None = None):
    """(row number, ids) of rows with a text: little-endian unsigned 32-bit, ``end`` appended; null counts as empty."""
    last = b"" if end is None else np.array([end], "<u4").tobytes()
    enc, texts = encoder(file), [t or "" for (t,) in part]
    for a, b in rounds(texts):
        yield from ((a + i, x + last) for i, x in enumerate(enc.ids(texts[a:b])))


def token_ids(docs: DataFrame, path: str, end: int | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit), ``end`` appended to each; null text counts as empty."""
    file = tokenizer_file(docs.sparkSession, path)
    return map_rows(docs, lambda part: ids_of(file, part, end), ["text"], ["doc_id"], "ids binary")


# ---- token counts


def shrink(counts: Counter, k: int) -> Counter:
    """Keep at most k counters, each lower by what the next one has (Misra and Gries)."""
    if len(counts) <= k:
        return counts
    cut = nlargest(k + 1, counts.values())[-1]
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def frequent_words(docs: DataFrame, k: int = FREQUENT) -> list[str]:
    """The most frequent words of all texts: each task keeps k counters, summaries are merged in a tree.

    Every word with more than one k-th of all words is found. No row per word leaves a task.
    """

    def count(batches):
        import pyarrow as pa

        c: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    c.update((text or "").split())
                    if len(c) > 4 * k:
                        c = shrink(c, k)
        c = shrink(c, k)
        if c:
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(c)], pa.list_(pa.string())), pa.array([list(c.values())], pa.list_(pa.int64()))], names=["w", "n"]
            )

    def merge(a, b):
        return shrink(a + b, k)

    parts = docs.select("text").mapInArrow(count, "w array<string>, n array<long>")
    found = parts.rdd.map(lambda r: Counter(dict(zip(r[0], r[1])))).treeAggregate(Counter(), merge, merge, depth=3)
    return [w for w, _ in found.most_common(k)]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, k: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text, one row per row of ``docs``.

    Null counts as empty: no bytes, no tokens. Repeated rows and ids get a row each. Texts with special strings or
    unusual separators go through the library whole, however long.
    """
    sc = docs.sparkSession.sparkContext
    file = tokenizer_file(docs.sparkSession, path)
    first: dict[str, int] = {}
    if not path.endswith(".model"):
        own = WordMemo(file.value[1])
        if own.split is not None:
            words = [w for w in frequent_words(docs, k) if own.plain(w)]
            first = {w: len(x) // 4 for w, x in zip(words, own.ids(words))}
    tier = sc.broadcast(first)

    def rows(part):
        enc, get, texts = encoder(file), tier.value.get, [t or "" for (t,) in part]
        for a, b in rounds(texts):
            some = texts[a:b]
            known, rest = [], []
            for t in some:
                if not isinstance(enc, WordMemo) or not enc.plain(t):
                    known.append(0)
                    rest.append(t)
                    continue
                words = t.split()
                got = list(map(get, words))
                misses = [w for w, g in zip(words, got) if g is None] if None in got else []
                known.append(sum(got) if not misses else sum(g for g in got if g is not None))
                rest.append(" ".join(misses))
            for i, x in enumerate(enc.ids(rest)):
                n = known[i] + len(x) // 4
                yield a + i, len(some[i].encode("utf-8", "surrogatepass")), n, n > limit

    return map_rows(docs, rows, ["text"], ["doc_id"], "n_bytes long, n_tokens long, over_limit boolean")
