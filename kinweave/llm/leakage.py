"""Passages of evaluation items inside training documents, by suffix arrays of the training shards.

The documents of a partition are taken in shards; a shard becomes one array of word numbers whose suffixes are sorted by doubling: the ranks of all stretches of 1, 2, 4, ...
words are kept, up to the length of the longest item. Every suffix of the test items is then looked up by binary search, first for its first ``least`` words, which gives the range
of all suffixes of the shard that begin with them; how far each of these matches is read off the ranks, a power of two words at a time.

The documents are read once and never shuffled. The test items are written as blocks of bounded size to the shared folder, from where each task
reads one block after the other; nothing of them is broadcast or gathered.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import skew_join
from kinweave.plans.staging import stage

LEAST = 13
#: Characters of test items in one block, and words after which a shard of training text is closed; a Python worker holds a block, and 4 bytes a word and doubling of a shard.
BLOCK_CHARS, SHARD_WORDS = 16_000_000, 2_000_000

_BREAK = re.compile(r"<\s*/?\s*(?:br|p|div|li|ul|ol|tr|td|th|table|h\d|math|title|section)\b[^<>]*>", re.I)
_TAG = re.compile(r"<\s*/?\s*[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_UNSEEN = re.compile("[͏؜᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_DIVIDED = re.compile("(?<=[^\\W_])[-­‐‑¬][ \t\xa0\r]*\n\\s*(?=[^\\W_])")
_NUMERAL = re.compile(r"\(\s*\d+\s*[a-z]{0,2}'*(?:\s*[,;/–-]\s*\d+\s*[a-z]{0,2}'*)*\s*\)")
_MARK = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]")
_WORD = re.compile(r"[^\W_]+")
_STROKED = re.compile("[æœøłđðıŀŧħ]")
_LETTERS = str.maketrans({"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i", "ŀ": "l", "ŧ": "t", "ħ": "h"})


def words(text: str | None) -> list[str]:
    """The words of a text as compared: letter case, accents, ligatures, punctuation, white space, mark-up, entities, unseen characters, divisions at
    line ends and reference numerals in round brackets make no difference."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub("", _BREAK.sub(" ", text))
    if text.isascii():
        text = text.lower()
        if "-" in text:
            text = _DIVIDED.sub("", text)
    else:
        text = _UNSEEN.sub("", text)
        text = _DIVIDED.sub("", text).replace("­", "").casefold()
        if not text.isascii():
            text = _MARK.sub("", unicodedata.normalize("NFKD", text)).casefold()
            if _STROKED.search(text):
                text = text.translate(_LETTERS)
    if "(" in text:
        text = _NUMERAL.sub(" ", text)
    return _WORD.findall(text)


class Numbers(dict):
    """Words numbered from 1 as they are asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        return n


class Block:
    """A block of test items: their words as numbers of a vocabulary of its own, 0 after each item, and where ``least`` words begin that no other item has."""

    def __init__(self, items: list[tuple[int, list[str], list[int]]]):
        self.items = items
        known: dict[str, int] = {}
        flat, owner, at, unique = [], [], [], []
        for item, ws, places in items:
            base = len(flat)
            flat += [known.setdefault(w, len(known) + 1) for w in ws] + [0]
            owner += [item] * (len(ws) + 1)
            at += range(len(ws) + 1)
            unique += [base + p for p in places]
        self.words = list(known)
        self.flat, self.owner, self.at = np.array(flat, dtype="int64"), np.array(owner, dtype="int64"), np.array(at, dtype="int64")
        self.unique = np.zeros(len(flat) + 1, bool)
        self.unique[unique] = True


class Shard:
    """The suffix array of some documents: ``array`` in the order of the suffixes, and ``ranks[j]`` of the ``2**j`` words that begin at each position.

    ``vocabulary`` maps words to numbers from 1; 0 stands behind each document. Suffixes are sorted by as many words as ``longest`` at least, or wholly.
    """

    def __init__(self, docs: list[tuple[int, np.ndarray]], vocabulary: dict[str, int], longest: int):
        self.docs, self.vocabulary = docs, vocabulary
        self.text = np.concatenate([x for _, d in docs for x in (d, np.zeros(1, dtype="int32"))])
        self.ends = np.cumsum([len(d) + 1 for _, d in docs])
        self.ranks, self.keys, width = [self.text.astype("int32")], [], 1
        while width < longest:
            keys, rank = np.unique(self._pairs(self.ranks[-1], width), return_inverse=True)
            self.keys.append(keys)
            self.ranks.append((rank + 1).astype("int32"))
            width *= 2
            if len(keys) == len(self.text):
                break
        self.array = np.argsort(self.ranks[-1], kind="stable")

    @staticmethod
    def _pairs(rank: np.ndarray, width: int) -> np.ndarray:
        after = np.zeros(len(rank), dtype="int64")
        after[: max(0, len(rank) - width)] = rank[width:]
        return (rank.astype("int64") << 32) | after

    def test_ranks(self, block: Block) -> list[np.ndarray]:
        """Ranks of all stretches of the items among those of the shard, 0 for one that the shard does not have; each is one binary search."""
        mine = np.array([0, *(self.vocabulary.get(w, 0) for w in block.words)], dtype="int64")
        out = [mine[block.flat]]
        for j, keys in enumerate(self.keys):
            last = out[-1]
            after = np.zeros(len(last), dtype="int64")
            after[: max(0, len(last) - (1 << j))] = last[1 << j :]
            key = (last << 32) | after
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out.append(np.where((last > 0) & (after > 0) & (keys[at] == key), at + 1, 0))
        return out

    def narrow(self, lo: np.ndarray, hi: np.ndarray, length: int, j: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within ranges of suffixes that agree in ``length`` words, those that go on with a stretch of ``2**j`` words of the wanted rank: binary search in all ranges at once."""
        out = []
        for upper in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = np.where(open_, (a + b) // 2, 0)
                v = self.ranks[j][np.minimum(self.array[mid] + length, len(self.text) - 1)]
                go = open_ & ((v <= wanted) if upper else (v < wanted))
                a, b = np.where(go, mid + 1, a), np.where(open_ & ~go, mid, b)
            out.append(a)
        return out[0], out[1]

    def matches(self, block: Block, least: int) -> list[tuple[int, int, int, int, int]]:
        """Document, item, words, place in the document and in the item of the longest match of each pair that begins with ``least`` words of that item alone."""
        test = self.test_ranks(block)
        start = np.flatnonzero(block.unique[:-1] & (test[0] > 0))
        lo, hi = np.zeros(len(start), dtype="int64"), np.full(len(start), len(self.array), dtype="int64")
        done = 0
        while done < least and len(start):
            j = min((least - done).bit_length(), len(test)) - 1
            wanted = test[j][start + done]
            some = wanted > 0
            start, (lo, hi) = start[some], self.narrow(lo[some], hi[some], done, j, wanted[some])
            some = lo < hi
            start, lo, hi = start[some], lo[some], hi[some]
            done += 1 << j
        if not len(start):
            return []
        n = hi - lo
        t = np.repeat(start, n)
        x = self.array[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        before = (t > 0) & (x > 0)  # a match that goes on to the left is part of a longer one
        whole = before & block.unique[t - 1] & (test[0][t - 1] == self.text[x - 1]) & (self.text[x - 1] > 0)
        t, x = t[~whole], x[~whole]
        length = np.full(len(t), least)
        top = len(test) - 1
        for j in range(top, -1, -1):
            going = np.arange(len(t))
            while len(going):
                at, to = t[going] + length[going], x[going] + length[going]
                inside = (at < len(block.flat)) & (to < len(self.text))
                going, at, to = going[inside], at[inside], to[inside]
                same = (test[j][at] == self.ranks[j][to]) & (test[j][at] > 0)
                going = going[same]
                length[going] += 1 << j
                if j < top:
                    break
        doc = np.searchsorted(self.ends, x, side="right")
        place, owner, item_at = x - np.concatenate([[0], self.ends[:-1]])[doc], block.owner[t], block.at[t]
        order = np.lexsort((item_at, place, -length, owner, doc))
        first = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(owner[order]) != 0)])]
        return [(self.docs[d][0], *r) for d, *r in zip(doc[first].tolist(), owner[first].tolist(), length[first].tolist(), place[first].tolist(), item_at[first].tolist())]


_MATCH = "doc_id long, item_id long, n_words int, doc_word int, item_word int"


def _blocks(path: str) -> Iterator[Block]:
    """The blocks of test items, one file each."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    for part in ds.dataset(inner, filesystem=where, format="parquet").get_fragments():
        rows = part.to_table(columns=["item_id", "words", "places"]).to_pylist()
        if rows:
            yield Block([(r["item_id"], r["words"], r["places"]) for r in rows])


def _search(path: str, blocks: int, least: int, longest: int, shard_words: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = list(_blocks(path)) if blocks == 1 else None  # a single block is read once a task

        def flush() -> pd.DataFrame:
            rows = []
            if held and longest >= least:
                shard = Shard(held, known, longest)
                for block in kept if kept is not None else _blocks(path):
                    rows += shard.matches(block, least)
            return pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "doc_word", "item_word"])

        held, known, size = [], Numbers(), 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ws = words(text)
                held.append((doc, np.fromiter(map(known.__getitem__, ws), dtype="int32", count=len(ws))))
                size += len(ws)
                if size >= shard_words:
                    yield flush()
                    held, known, size = [], Numbers(), 0
        if held:
            yield flush()

    return search


def item_blocks(items: DataFrame, least: int, block_chars: int) -> tuple[DataFrame, int, int]:
    """The written blocks of test items (``item_id``, ``words``, ``places`` from which ``least`` words stand in no other item), their number, and the words of the longest item."""
    own = items.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("item_id is not null and text is not null").distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": [words(t) for t in pdf["text"]]})

    own = stage(own.mapInPandas(split, "item_id long, words array<string>").withColumn("row", F.monotonically_increasing_id()), "items")
    place = F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("place")
    gram = own.where(F.size("words") >= least).select("item_id", "row", "words", place).select("item_id", "row", "place", F.array_join(F.slice("words", F.col("place") + 1, least), " ").alias("gram"))
    once = gram.groupBy("gram").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a = b").select("gram")
    places = gram.join(once, "gram").groupBy("row").agg(F.collect_list("place").alias("places"))  # at most the words of an item
    chars, longest = own.agg(F.coalesce(F.sum(F.length(F.array_join("words", " "))), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    blocks = max(1, -(-chars // block_chars))
    kept = own.join(places, "row").select("item_id", "words", F.col("places").cast("array<int>").alias("places"))
    return stage(kept.repartition(blocks, "item_id"), "blocks"), blocks, longest


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every pair of a document and a test item that share ``least`` words in a row which stand in no other item.

    Columns: ``doc_id``, ``item_id``, ``n_words`` (longest verbatim match that begins with such words), ``doc_word``, ``item_word`` (where it begins,
    counted in words). NULL and empty texts match nothing; rows without an id are left out; an item or document given twice counts once.
    Items shorter than ``least`` words match nothing. Other columns are ignored. Empty tables give no rows.
    """
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("doc_id is not null")
    written, blocks, longest = item_blocks(items, least, block_chars)
    every = docs.mapInPandas(_search(written._staged_path, blocks, least, longest, shard_words), _MATCH)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return every.groupBy("doc_id", "item_id").agg(best).selectExpr("doc_id", "item_id", "m.n_words n_words", "-m.d doc_word", "-m.i item_word")


def without_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents that hold no passage of an item (see :func:`leaks`); rows without an id stay."""
    bad = stage(leaks(documents, items, least).select("doc_id").distinct(), "leaking")
    return skew_join(documents, bad, "doc_id", "left_anti")
