"""Evaluation passages inside a corpus: n-gram hash set scan, verification by alignment, removal of spans or documents."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.session import materialize, partitions_for

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n\s*(?=[^\W\d_])")
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Typographic signs that keep a text of a Latin script from one byte a letter.
_SIGNS = "\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2020\u2022\u2026\u2039\u203a\u20ac"
#: One byte a letter: letters and digits in lower case, everything else a blank.
_LEVEL = bytes(ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 and ord(c.lower()) < 256 else 32 for c in map(chr, range(256)))


@dataclass(frozen=True)
class LeakRule:
    """Settings of the search."""

    n: int = 5  # words of a n-gram
    share: float = 0.3  # of an item's words, in at most two places
    places: int = 2
    formula_share: float = 0.02  # n-grams that stand in more than this share of the distinct texts without the rest of the item are formulas
    formula_least: int = 3  # and in more than so many documents, for small corpora
    rare: float = 0.45  # rare n-grams a covered word: words that merely recur in other order have few
    edited: float = 0.6  # where so much of an item is covered, many words may have been changed,
    rare_edited: float = 0.25  # and so few rare n-grams suffice
    gap: int = 9  # words that may be changed between two matches
    least_place: float = 0.1  # of an item's words that a place must cover: shorter scraps are no leak
    drift: int = 3  # words that may be put in or left out there
    inserted: int = 16  # words a page header may put in between
    most_words: int = 5_000_000  # words of the items that are broadcast at once: about 100 bytes each


def plain(text: str) -> str:
    """Text without markup, entities, invisible characters and hyphenation at line ends."""
    if "-" in text:
        text = _BROKEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        for sign in _INVISIBLE:
            if sign in text:
                text = text.replace(sign, "")
    return text


def words(text: str) -> list[str]:
    """Lower-case words of the plain text: ``_WORD`` over its lower case, by byte tables where every letter is one byte."""
    text = plain(text)
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        level = text
        for sign in _SIGNS:
            level = level.replace(sign, " ")
        try:
            raw = level.encode("latin-1")
        except UnicodeEncodeError:
            return _WORD.findall(text.lower())
    return raw.translate(_LEVEL).decode("latin-1").split()


#: Odd multipliers, one a place of an n-gram, from the fractional part of the golden ratio.
_MIX = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1)) for k in range(64)]


def gram_hashes(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words that all have a number; 0 stands for a word without one."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    strange = np.concatenate([[0], np.cumsum(ids == 0)])
    at = np.flatnonzero(strange[n:] == strange[:m])
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h ^= ids[at + k].astype(np.uint64) * _MIX[k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return at, h


class ItemIndex:
    """The items' words and n-grams by number. Built once on the driver; what is broadcast grows with the items only."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.n = n
        self.names = [name for name, _ in items]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(p)], np.int64) for _, p in items]
        each = [gram_hashes(w, n)[1] for w in self.words]
        self.table = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]))
        self.grams = [np.searchsorted(self.table, h) for h in each]  # numbers of an item's n-grams, in order
        pairs = [np.stack([np.unique(g), np.full(len(np.unique(g)), i)]) for i, g in enumerate(self.grams)]
        flat = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
        flat = flat[:, np.argsort(flat[0], kind="stable")]
        self.start = np.searchsorted(flat[0], np.arange(len(self.table) + 1))
        self.of = flat[1]  # items of n-gram g: of[start[g]:start[g + 1]]

    def number(self, text: list[str]) -> np.ndarray:
        """The numbers of words, 0 for words of no item."""
        return np.fromiter(map(self.vocab.get, text, repeat(0)), np.int64, len(text))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number) of the document's n-grams that items have."""
        at, h = gram_hashes(ids, self.n)
        if not len(at) or not len(self.table):
            return at[:0], np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.table, h), len(self.table) - 1)
        same = self.table[k] == h
        return at[same], k[same]

    def items_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``numbers``, item) of every item of every n-gram."""
        count = self.start[numbers + 1] - self.start[numbers]
        which = np.repeat(np.arange(len(numbers)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return which, self.of[np.repeat(self.start[numbers], count) + inside]


def _carried(at: np.ndarray, length: int, rule: LeakRule) -> bool:
    """TRUE if n-grams of an item at these positions run through so much of it that they are a leak, not a formula; a few words
    between them may be changed."""
    step = np.diff(at)
    covered = rule.n + int(np.where(step > rule.n + rule.gap, rule.n, step).sum())
    return covered >= rule.share * length and len(at) >= rule.rare_edited * covered


def _least(length: int, rule: LeakRule) -> float:
    """n-grams that a document must share with an item of so many words at the least."""
    return min(rule.rare * rule.share, rule.rare_edited * rule.edited) * length


def _scanner(broadcast, rule: LeakRule):
    """First pass: the n-grams each document shares with the items, without those of items it carries as a leak would; the
    text too if an item might reach its share."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = broadcast.value
        least = np.array([max(1.0, _least(len(w), rule)) for w in index.words])
        for batch in batches:
            ids, marks, hits, texts = [], [], [], []
            for doc, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                numbers = np.unique(index.hits(index.number(words(text)))[1])
                if not len(numbers):
                    continue
                which, items = index.items_of(numbers)
                count = np.bincount(items, minlength=len(least))
                near = np.flatnonzero(count >= least)
                whole = [i for i in near if _carried(np.flatnonzero(np.isin(index.grams[i], numbers)), len(index.words[i]), rule)]
                ids.append(doc)
                marks.append(mark)
                if whole:
                    numbers = np.delete(numbers, which[np.isin(items, whole)])
                hits.append(numbers.astype(np.int32))
                texts.append(text if len(near) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "mark", "hits", "text"])

    return scan


def align(doc: np.ndarray, item: np.ndarray, rule: LeakRule, formula: set[int]) -> list[tuple[int, int, set[int]]]:
    """Places where the item runs through the document, both as numbers of words: (first word, last word, item words covered), best
    first.

    Matches of three words are chained while both texts move on together. Item words of a formula count only beside at
    least eight others.
    """
    m = 3
    at: dict[int, list[int]] = defaultdict(list)
    for k, g in zip(*(x.tolist() for x in gram_hashes(item, m))):
        at[g].append(k)
    where, h = gram_hashes(doc, m)
    same = np.isin(h, np.fromiter(at, np.uint64, len(at)))
    chains: list[list] = []
    open_: list[list] = []
    for b, g in zip(where[same].tolist(), h[same].tolist()):
        open_ = [c for c in open_ if b - c[1] <= rule.inserted]
        for a in at[g]:
            for c in reversed(open_):
                db, da = b - c[1], a - c[3]
                if 0 <= da <= rule.gap and 0 <= db and (db <= rule.gap and abs(da - db) <= rule.drift or da <= 6):
                    c[1], c[3] = b, a
                    c[4].update(range(a, a + m))
                    break
            else:
                chains.append([b, b, a, a, set(range(a, a + m))])
                open_.append(chains[-1])
    places = []
    for c in chains:
        free = c[4] - formula
        places.append((c[0], c[1] + m - 1, c[4] if len(free) >= 8 else free))
    return sorted(places, key=lambda p: (-len(p[2]), p[0]))


def formula_words(index: ItemIndex, common: np.ndarray, n: int) -> list[set[int]]:
    """Per item the words inside formula sentences: runs of more than n usual n-grams."""
    out = []
    for grams in index.grams:
        usual, inside, k = common[grams].tolist(), set(), 0
        while k < len(usual):
            j = k
            while j < len(usual) and usual[j]:
                j += 1
            if j - k > n:
                inside.update(range(k, j + n - 1))
            k = max(j, k + 1)
        out.append(inside)
    return out


def _verifier(broadcast, usual, rule: LeakRule):
    """Second pass: which items run through a document, and where."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (common, formulas) = broadcast.value, usual.value
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "item_id": [], "share": [], "spans": []}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = index.number(words(text))
                at, numbers = index.hits(ids)
                at, numbers = at[~common[numbers]], numbers[~common[numbers]]
                which, items = index.items_of(numbers)
                for i in np.unique(items):
                    item = index.words[i]
                    mine = which[items == i]
                    if len(mine) < _least(len(item), rule):
                        continue
                    covered: set[int] = set()
                    spans: list[tuple[int, int]] = []
                    for first, last, cover in align(ids, item, rule, formulas[i]):
                        if len(spans) == rule.places:
                            break
                        new = cover - covered
                        if len(new) >= rule.least_place * len(item) and len(new) >= 0.7 * len(cover):
                            covered |= new
                            spans.append((first, last))
                    inside = np.zeros(len(mine), bool)
                    for first, last in spans:
                        inside |= (at[mine] >= first) & (at[mine] <= last)
                    seen = len(np.unique(numbers[mine[inside]]))
                    told = rule.rare_edited if len(covered) >= rule.edited * len(item) else rule.rare
                    if len(covered) >= rule.share * len(item) and seen >= told * len(covered):
                        out["doc_id"].append(doc)
                        out["item_id"].append(index.names[i])
                        out["share"].append(len(covered) / len(item))
                        out["spans"].append([{"first": f, "last": e} for f, e in spans])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["item_id"], pa.string()), pa.array(out["share"], pa.float64()),
                 pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names=list(out))

    return verify


def find_leaks(documents: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """(doc_id, item_id, share, spans) of every document of (doc_id, text) that carries at least ``share`` of the words of an
    item of (item_id, passage), in order, in one or two places; spans are numbers of the document's words.

    Whole texts are scanned once against a broadcast table of the items' n-grams (64-bit hashes; what they find is verified word by
    word); items are taken in blocks of at most ``most_words`` words, so the broadcast has a bound. The document frequency of the
    n-grams, counted over distinct texts that do not carry the item itself, tells formulas from leaks, so a leak may
    stand in any share of the table. Only documents that may hold a case keep their text for the second pass.
    NULL and empty texts and items of fewer words than an n-gram have no cases; repeated documents have one each; empty
    tables give none.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    distinct = docs.select("mark").distinct().count()
    sized = items.select("item_id", "passage").where("passage is not null").dropDuplicates(["item_id", "passage"])
    size = F.size(F.split("passage", r"\s+"))
    words_all = sized.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-words_all // rule.most_words))
    out = None
    for block in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == block) if blocks > 1 else sized
        index = ItemIndex(sorted((r.item_id, r.passage) for r in mine.collect()), rule.n)
        broadcast = spark.sparkContext.broadcast(index)
        hits = materialize(docs.mapInArrow(_scanner(broadcast, rule), "doc_id long, mark long, hits array<int>, text string"), "leak-hits")
        limit = max(rule.formula_share * distinct, rule.formula_least)
        once = hits.where("size(hits) > 0").groupBy("mark").agg(F.first("hits").alias("hits"))
        frequent = once.select(F.explode("hits").alias("g")).groupBy("g").count().where(F.col("count") > limit)
        common = np.zeros(len(index.table), bool)
        common[[r.g for r in frequent.select("g").collect()]] = True  # at most as many as the broadcast table has
        usual = spark.sparkContext.broadcast((common, formula_words(index, common, rule.n)))
        found = hits.where("text is not null").select("doc_id", "text")
        found = found.repartition(partitions_for(found.count(), 2_000, spark.sparkContext.defaultParallelism))
        found = found.mapInArrow(_verifier(broadcast, usual, rule), "doc_id long, item_id string, share double, spans array<struct<first: int, last: int>>")
        found = materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The plain text without the words of the spans (numbers of words, inclusive)."""
    base = plain(text)
    at = [m.span() for m in _WORD.finditer(base.lower())]
    keep, pos = [], 0
    for first, last in sorted(spans):
        start, end = at[first][0], at[min(last, len(at) - 1)][1]
        if start >= pos:
            keep.append(base[pos:start])
        pos = max(pos, end)
    return "".join([*keep, base[pos:]])


def _cutter(text_at: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(batch.columns) - 1).to_pylist()
            texts = [t if t is None else without_spans(t, [(s["first"], s["last"]) for s in where]) for t, where in zip(batch.column(text_at).to_pylist(), spans)]
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(len(batch.columns) - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return cut


def remove_leaks(documents: DataFrame, leaks: DataFrame, how: str = "spans") -> DataFrame:
    """The corpus without leaked documents (``documents``), or with the leaked words cut out of their plain text (``spans``);
    other documents, and all other columns, stay as they are. Documents of one doc_id are all cut alike; rows without doc_id stay.

    Only documents with leaks pass through Python; the others are kept by an anti-join.
    """
    hit = leaks.select("doc_id").distinct()
    kept = documents.join(hit, "doc_id", "left_anti").select(*documents.columns)
    if how == "documents":
        return kept
    spans = leaks.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("_spans"))  # at most two places an item
    joined = documents.join(spans, "doc_id").select(*documents.columns, "_spans")
    cut = joined.mapInArrow(_cutter(documents.columns.index("text")), documents.schema)
    return kept.unionByName(cut)
