"""Ranked lexical search: each item's best documents, found by grouping documents by the terms they share with it.

Documents are read once into postings of the items' terms. They are then searched in blocks of bounded size. In a
block every term has a bitmap of its documents; an item's bitmaps, transposed, give every document a mask of matched
terms, and documents of one mask form a group. A mask's score cannot exceed the sum of its terms' largest parts, so
masks are evaluated by descending maximum until the next one cannot reach the item's k-th best score so far. A task
keeps k documents per item over all its blocks, and those of all tasks are merged; no pair of item and document is
ever a row.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from fieldorder.llm.common import hold, map_rows, written

#: Bytes of item texts that are searched for at once (the bound on what is broadcast); more go in several rounds.
ITEM_BYTES = 8_000_000

#: Documents, postings and bytes of bitmaps of a block.
BLOCK_DOCS, BLOCK_POSTINGS, BLOCK_BYTES = 8_192, 2_000_000, 64_000_000

#: Bytes of text that are split into terms at a time.
PIECE = 1_000_000

#: A-Z to lower case; all of ASCII but digits and letters to spaces; what is not ASCII stays.
FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))


def terms(text: str | None):
    """Lists of the terms of a text, piece by piece (UTF-8)."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def weight(total: int, holding: int) -> int:
    """A term's weight: ``total`` documents have terms, ``holding`` of them hold this one."""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * holding + 1)))


class Block:
    """Documents in the order that breaks ties, their postings sorted by term, and a bitmap per term."""

    def __init__(self, ids: list, n: np.ndarray, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray, total: int, words: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        self.ids = [ids[i] for i in order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = np.array([75 + 25 * int(x) * total // words for x in n[order]], np.int64)  # a document's share may pass 64 bits on the way
        doc = place[np.repeat(np.arange(len(ids)), lengths)]
        by = np.lexsort((doc, term))
        self.doc, tf, term = doc[by], tf[by].astype(np.int64), term[by]
        self.part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc])
        self.term, self.start = np.unique(term, return_index=True)
        self.end = np.append(self.start[1:], len(term))
        self.most = np.maximum.reduceat(self.part, self.start) if len(term) else np.empty(0, np.int64)
        self.width = -(-len(ids) // 8)
        self.bits = np.zeros(len(self.term) * self.width, np.uint8)
        if len(term):
            at = np.repeat(np.arange(len(self.term)), self.end - self.start) * self.width + (self.doc >> 3)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            self.bits[at[first]] = np.bitwise_or.reduceat((128 >> (self.doc & 7)).astype(np.uint8), first)
        self.bits = self.bits.reshape(len(self.term), self.width)

    def search(self, wanted: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """``best`` with the block's documents merged in: (-score, id is null, id), at most k."""
        at = np.minimum(np.searchsorted(self.term, wanted), max(0, len(self.term) - 1))
        here = self.term[at] == wanted if len(self.term) else np.zeros(len(wanted), bool)
        at, weights = at[here], weights[here]
        if not len(at):
            return best
        bits = self.bits[at]
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, 0), count=len(self.ids)))
        for rows in np.array_split(docs, -(-len(docs) * len(at) // BLOCK_BYTES)):  # a very long item takes fewer documents at a time
            best = self.by_mask(at, weights, bits, rows, best, k)
        return best

    def by_mask(self, at: np.ndarray, weights: np.ndarray, bits: np.ndarray, docs: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        held = np.unpackbits(bits, axis=1, count=len(self.ids))[:, docs]  # term by document
        masks = np.packbits(held, axis=0)
        masks = np.vstack([masks, np.zeros((-len(masks) % 8, len(docs)), np.uint8)]).T
        masks = np.ascontiguousarray(masks).view(np.uint64)
        order = np.lexsort(masks.T)
        new = np.any(masks[order[1:]] != masks[order[:-1]], axis=1)
        first = np.concatenate([[0], np.flatnonzero(new) + 1])
        limit = (weights * self.most[at]).astype(float) @ held[:, order[first]].astype(float)
        limit = limit * (1 + 1e-9) + 1  # sums of doubles may be a little low
        count = np.diff(np.append(first, len(order)))
        down = np.argsort(-limit, kind="stable")
        done, step = 0, 4 * k
        while done < len(down):
            least = -best[-1][0] if len(best) == k else 1
            some = down[done:]
            some = some[: np.searchsorted(-limit[some], -least, "right")]
            some = some[: np.searchsorted(np.cumsum(count[some]), step, "left") + 1]
            if not len(some):
                break
            picked = np.sort(docs[np.concatenate([order[first[g] : first[g] + count[g]] for g in some])])
            score = np.zeros(len(picked), np.int64)
            for t, w in zip(at, weights):
                a, b = self.start[t], self.end[t]
                p = np.minimum(np.searchsorted(self.doc[a:b], picked), b - a - 1) + a
                score += np.where(self.doc[p] == picked, w * self.part[p], 0)
            good = np.flatnonzero(score >= least)
            good = good[np.argsort(-score[good], kind="stable")[:k]]  # documents lie in the order that breaks ties
            best = sorted([*best, *((-int(score[g]), self.ids[picked[g]] is None, self.ids[picked[g]]) for g in good)])[:k]
            done, step = done + len(some), 4 * step
        return best


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n, term, tf of every document with a term: counts of the numbered terms only."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def rows(part):
        hold(None)
        get = known.value.get
        for i, (text,) in enumerate(part):
            n, found = 0, Counter()
            for words in terms(text):
                n += len(words)
                found.update(map(get, words))
            found.pop(None, None)
            if n:
                yield i, n, list(found), list(found.values())

    return map_rows(docs, rows, ["text"], ["doc_id"], "n long, term array<int>, tf array<long>")


def search_some(docs: DataFrame, items: list[tuple], id_type: T.DataType, k: int) -> DataFrame:
    """item_id, doc_id, score of at most k documents per item and task; ``items``: (id, Counter of terms)."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted(set().union(*[c for _, c in items])))}
    found = written(postings(docs, number), "postings")
    total, words = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(found.select(F.explode("term").alias("term")).groupBy("term").count().collect())  # a row per term of the items
    plan = []
    for item, counts in items:
        own = sorted((number[t], c) for t, c in counts.items() if number[t] in holding)
        plan.append((item, np.array([t for t, _ in own], np.int64), np.array([c * weight(total, holding[t]) for t, c in own], np.int64)))
    plan = spark.sparkContext.broadcast(plan)
    n_docs = max(1, min(BLOCK_DOCS, 8 * BLOCK_BYTES // max(1, len(number))))
    doc_type = docs.schema["doc_id"].dataType
    out = pa.schema([("item_id", to_arrow_type(id_type)), ("doc_id", to_arrow_type(doc_type)), ("score", pa.int64())])

    def run(batches):
        best: list[list[tuple]] = [[] for _ in plan.value]
        held: list[pa.RecordBatch] = []

        def search():
            t = pa.Table.from_batches(held)
            flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            lengths = np.array(pc.list_value_length(t.column("term")).to_pylist(), np.int64)
            block = Block(t.column("doc_id").to_pylist(), t.column("n").to_numpy(), lengths, flat("term"), flat("tf"), total, words)
            for i, (_, wanted, weights) in enumerate(plan.value):
                best[i] = block.search(wanted, weights, best[i], k)
            held.clear()

        rows = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                many = part.column(part.schema.get_field_index("term")).flatten()
                if held and (rows + part.num_rows > n_docs or size + len(many) > BLOCK_POSTINGS):
                    search()
                    rows = size = 0
                held.append(part)
                rows, size = rows + part.num_rows, size + len(many)
        if held:
            search()
        flat = [(item, i, -s) for (item, _, _), b in zip(plan.value, best) for s, _, i in b]
        cols = list(zip(*flat)) if flat else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    return found.where(F.size("term") > 0).mapInArrow(run, schema)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0.

    ``docs`` (doc_id, text), ``items`` (item_id, text); other columns are not read. Null and empty texts have no
    terms: such documents count nowhere and such items get no rows. Every row of ``docs`` is a document of its own,
    repeated rows and ids too; equal scores go by ascending id, null last. Rows of ``items`` with one id make up one
    item with the terms of all its different texts (repeated rows count once); a null id is an item like any other.
    Empty tables give no rows. Weights are taken in doubles, everything else in integers.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    rounds = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES))
    id_type = items.schema["item_id"].dataType
    found = None
    for turn in range(rounds):
        some: dict = {}
        for item, text in items.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == turn).toLocalIterator():  # about ITEM_BYTES
            c = some.setdefault(item, Counter())
            for words in terms(text):
                c.update(words)
        listed = sorted(((i, c) for i, c in some.items() if c), key=lambda x: (x[0] is None, x[0]))
        if listed:
            part = search_some(docs, listed, id_type, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = f"item_id {id_type.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
        found = spark.createDataFrame([], kinds)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
