"""Documents into containers of fixed capacity: pattern packing by non-negative least squares over the length histogram."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.session import materialize

#: Default vocabulary; the path is a parameter of ``count_tokens``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's rule for cutting text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class PackRule:
    """Settings of the packing. ``tries``: (length classes, most documents of a pattern); each is planned, the plan of fewest
    containers is taken, of equal ones that which places more documents by patterns."""

    tries: tuple[tuple[int, int], ...] = ((128, 4), (384, 3), (768, 2))
    most_lengths: int = 65_536  # lengths that the driver tells apart a container kind; beyond, it plans in units of several tokens
    most_kinds: int = 64  # more kinds of containers are an error, none is dropped
    block_rows: int = 50_000


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n"])

    return count


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n): tokens of every whole text; 0 for NULL and empty texts."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counter(path), "doc_id long, n long")


def nnls(rows: np.ndarray, b: np.ndarray, weight: np.ndarray, batch: int = 16, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares of histogram ``b`` by patterns: (numbers of the patterns used, their repeat counts).

    A pattern is a row of class numbers, 0 standing for none; so the gradient of all patterns is a lookup, and only the columns of
    those in use are ever built. An active-set method: the patterns of steepest descent enter, ``batch`` at a time, and
    those that would become negative leave. It ends when no pattern improves the fit by more than ``tol`` of it.
    """
    weight = np.where(np.arange(len(b)) > 0, weight, 0.0)
    y = b * weight
    used, x, a = np.zeros(0, int), np.zeros(0), np.zeros((len(b), 0))
    inside = np.zeros(len(rows), bool)
    before = None
    while not inside.all():
        rest = y - a @ x
        now = float(rest @ rest)
        slope = (rest * weight)[rows].sum(axis=1)
        slope[inside] = -np.inf
        k = min(batch, int((~inside).sum()))
        enter = np.argpartition(-slope, k - 1)[:k]
        enter = enter[slope[enter] > 1e-9 * max(1.0, np.abs(y).max(initial=0.0))]
        if not len(enter) or before is not None and before - now <= tol * before:
            break
        before = now
        columns = np.zeros((len(b), len(enter)))
        for q in range(rows.shape[1]):
            np.add.at(columns, (rows[enter, q], np.arange(len(enter))), 1.0)
        inside[enter] = True
        used, x, a = np.concatenate([used, enter]), np.concatenate([x, np.zeros(len(enter))]), np.concatenate([a, columns * weight[:, None]], axis=1)
        while len(used):
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] += 1e-8
            z = np.linalg.solve(gram, a.T @ y)
            bad = z < 0
            if not bad.any():
                x = z
                break
            x = x + np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)) * (z - x)
            out = bad & (x <= 1e-10)
            out = out if out.any() else bad & (x <= x[bad].min())
            inside[used[out]] = False
            used, x, a = used[~out], x[~out], a[:, ~out]
    return used, x


def patterns(bins: int, most: int, present: np.ndarray) -> np.ndarray:
    """All descending rows of at most ``most`` length classes that fill ``bins`` classes exactly, padded with 0; classes without
    documents are left out."""
    usable = np.flatnonzero(present)
    usable = usable[usable > 0]
    out = [np.zeros((0, most), int)]

    def fill(head: list[int], rest: int) -> None:
        left = most - len(head)
        top = head[-1] if head else rest
        if rest <= top and present[rest]:
            out.append(np.array([[*head, rest, *[0] * (left - 1)]]))
        if left < 2:
            return
        if left == 2:  # the last two classes at once
            g = usable[(2 * usable >= rest) & (usable < rest) & (usable <= top)]
            g = g[present[rest - g]]
            out.append(np.column_stack([*[np.full(len(g), h) for h in head], g, rest - g]))
            return
        for g in usable[(left * usable >= rest) & (usable < rest) & (usable <= top)]:
            fill([*head, int(g)], rest - int(g))

    fill([], bins)
    return np.unique(np.concatenate(out), axis=0)


class Plan:
    """Where the r-th piece of every length goes. Entries (length, first rank, how many, start): the piece of rank r goes to container
    start + r - first rank. Their number depends on lengths and patterns, not on documents. Containers below
    ``by_pattern`` were opened by patterns; ``placed`` is the number of pieces that patterns ask for."""

    def __init__(self, capacity: int, counts: np.ndarray, bins: int, most: int):
        self.capacity = capacity
        self.left = counts.astype(np.int64).copy()  # pieces by length, 0..capacity
        self.next = np.zeros(capacity + 1, np.int64)
        self.entries: list[tuple[int, int, int, int]] = []
        self.containers = self.placed = 0
        self.spaces: list[int] = []  # sorted; the containers that have so much room are in ``ranges``
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self._by_patterns(min(bins, capacity), most)
        self.by_pattern = self.containers
        self._best_fit()
        self.entries.sort()

    @classmethod
    def best(cls, capacity: int, counts: np.ndarray, rule: PackRule = PackRule()) -> Plan:
        """The plan of fewest containers over the rule's tries."""
        tries = dict.fromkeys((min(bins, capacity), most) for bins, most in rule.tries)
        return min((cls(capacity, counts, bins, most) for bins, most in tries), key=lambda p: (p.containers, -p.placed))

    def _take(self, low: int, high: int, n: int) -> list[tuple[int, int, int]]:
        """The n longest pieces left of lengths low..high as (length, first rank, how many)."""
        out = []
        for length in range(high, low - 1, -1):
            k = min(n, int(self.left[length]))
            if k:
                out.append((length, int(self.next[length]), k))
                self.left[length] -= k
                self.next[length] += k
                n -= k
            if not n:
                break
        return out

    def _add(self, space: int, start: int, n: int) -> None:
        if space not in self.ranges:
            insort(self.spaces, space)
            self.ranges[space] = []
        self.ranges[space].append((start, n))

    def _by_patterns(self, bins: int, most: int) -> None:
        """Containers of a few documents whose length classes fill them, as often as least squares fit the histogram.

        A class stands for its longest length, so a pattern always fits, but its documents are shorter and leave room. Therefore
        the last document of a pattern is not taken from its class: the room is kept, and the piece that fills it best by its
        exact length comes with ``_best_fit``, for which the fit has left pieces of about that length.
        """
        capacity = self.capacity
        edge = [capacity * g // bins for g in range(bins + 1)]  # class g holds lengths edge[g-1]+1 .. edge[g]
        have = np.array([0] + [int(self.left[edge[g - 1] + 1: edge[g] + 1].sum()) for g in range(1, bins + 1)])
        rows = patterns(bins, most, have > 0)
        if not len(rows):
            return
        used, x = nnls(rows, have.astype(float), 0.2 + np.arange(bins + 1) / bins)  # long documents are harder to place later
        spare = have.copy()
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            classes = [int(g) for g in rows[used[j]] if g]
            need = np.bincount(classes, minlength=bins + 1)
            asks = need > 0
            n = min(int(round(x[j])), int((spare[asks] // need[asks]).min()))
            if n <= 0:
                continue
            spare -= n * need
            self.placed += n * len(classes)
            change: dict[int, int] = {0: 0}  # where along the containers the filled length changes, and by how much
            for g in classes[:-1] or classes:
                at, before = 0, 0
                for length, rank, k in self._take(edge[g - 1] + 1, edge[g], n):
                    self.entries.append((length, rank, k, self.containers + at))
                    change[at] = change.get(at, 0) + length - before
                    at, before = at + k, length
            cuts = sorted(change)
            filled = 0
            for at, end in zip(cuts, [*cuts[1:], n]):
                filled += change[at]
                if filled < capacity:
                    self._add(capacity - filled, self.containers + at, end - at)
            self.containers += n

    def _best_fit(self) -> None:
        """What is left, longest first, each into the fullest container that has room: in counts, not piece by piece."""
        spaces, ranges, add = self.spaces, self.ranges, self._add
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                i = bisect_left(spaces, length)
                if i < len(spaces):
                    space = spaces[i]
                    start, n = ranges[space].pop()
                    if not ranges[space]:
                        del ranges[space], spaces[i]
                    k = min(n, int(self.left[length]))
                    self._put(length, k, start)
                    add(space - length, start, k)
                    if k < n:
                        add(space, start + k, n - k)
                    continue
                each = self.capacity // length
                k = max(1, int(self.left[length]) // each)
                each = min(each, int(self.left[length]))
                for _ in range(each):
                    self._put(length, k, self.containers)
                if self.capacity - each * length:
                    add(self.capacity - each * length, self.containers, k)
                self.containers += k

    def _put(self, length: int, n: int, start: int) -> None:
        self.entries.append((length, int(self.next[length]), n, start))
        self.next[length] += n
        self.left[length] -= n


def pieces_of(tokens: DataFrame, kinds: list[tuple[str, int]], most_lengths: int = PackRule.most_lengths) -> DataFrame:
    """(plan, container_kind, capacity_tokens, doc_id, piece_no, start_token, n_tokens, size): whole documents, or cuts of those that
    alone exceed the capacity, once for every kind of (name, capacity); ``plan`` is the kind's place in the list, ``size`` the
    length in units of the plan."""
    rows = [F.struct(F.lit(i).alias("plan"), F.lit(k).alias("container_kind"), F.lit(int(c)).cast("long").alias("capacity_tokens"), F.lit(unit_of(c, most_lengths)).cast("long").alias("unit")) for i, (k, c) in enumerate(kinds)]
    each = F.array(*rows) if kinds else F.array().cast("array<struct<plan: int, container_kind: string, capacity_tokens: long, unit: long>>")
    c = F.col("capacity_tokens")
    cut = tokens.where("n > 0").select("doc_id", "n", F.explode(each).alias("_c")).select("doc_id", "n", "_c.*")
    numbered = cut.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / c).cast("int"))))
    start = F.col("piece_no") * c
    whole = numbered.withColumn("start_token", start).withColumn("n_tokens", F.least(c, F.col("n") - start))
    size = F.least(F.ceil(F.col("n_tokens") / F.col("unit")), F.floor(c / F.col("unit")))  # a piece that fills all units stands alone
    return whole.select("plan", "container_kind", "capacity_tokens", "doc_id", "piece_no", "start_token", "n_tokens", size.cast("int").alias("size"))


def unit_of(capacity: int, most_lengths: int) -> int:
    """Tokens of a unit in which containers of a capacity are planned: 1 up to ``most_lengths`` tokens."""
    return -(-capacity // most_lengths)


OUT = "container_kind string, container_id long, doc_id long, piece_no int, start_token long, n_tokens long, capacity_tokens long, by_pattern boolean"


def _placer(broadcast):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = broadcast.value
        for batch in batches:
            plan, size, rank = (batch.column(c).to_numpy() for c in ("plan", "size", "rank"))
            out, told = np.zeros(len(plan), np.int64), np.zeros(len(plan), bool)
            for p in np.unique(plan):
                m = plan == p
                key, first, start, opened = plans[p]
                at = np.searchsorted(key, size[m] * np.int64(1 << 45) + rank[m], side="right") - 1
                out[m] = start[at] + rank[m] - first[at]
                told[m] = out[m] < opened
            yield pa.RecordBatch.from_arrays([batch.column("container_kind"), pa.array(out), *[batch.column(c) for c in ("doc_id", "piece_no", "start_token", "n_tokens", "capacity_tokens")], pa.array(told)],
                                             names=["container_kind", "container_id", "doc_id", "piece_no", "start_token", "n_tokens", "capacity_tokens", "by_pattern"])

    return place


def pack(tokens: DataFrame, capacities: DataFrame, rule: PackRule = PackRule()) -> DataFrame:
    """An assignment of documents (doc_id, n) to containers of every kind of (container_kind, capacity_tokens): (container_kind,
    container_id, doc_id, piece_no, start_token, n_tokens, capacity_tokens, by_pattern); the last tells whether a pattern opened the container.

    No container holds more than its capacity; a document is cut only if it alone exceeds the capacity, and then in full
    containers and one rest. Documents of 0 tokens (NULL or empty texts) need no room and have no rows. Repeated rows of
    ``tokens`` are packed as often as they come. Kinds with NULL or non-positive capacity, or without name, are left out; a kind given
    with several capacities is packed once for each, with containers numbered from 0 in each.

    The driver sees one count a length and kind, at most ``most_lengths`` of them (larger containers are planned in units of several
    tokens), and plans from it: repeat counts of few-document patterns by non-negative least squares, rounded; what remains is
    packed best-fit in counts, into room left by the patterns too. Pieces are ranked within their length in blocks, so
    that a length of any frequency spreads over tasks, and find their container by rank.
    """
    spark = tokens.sparkSession
    sound = capacities.where("container_kind is not null and capacity_tokens >= 1")
    rows = sound.select("container_kind", F.col("capacity_tokens").cast("long").alias("c")).distinct().limit(rule.most_kinds + 1).collect()
    if len(rows) > rule.most_kinds:
        raise ValueError(f"more than {rule.most_kinds} kinds of containers")
    kinds = sorted((r.container_kind, r.c) for r in rows)
    pieces = materialize(pieces_of(tokens, kinds, rule.most_lengths), "pieces")
    histogram = pieces.groupBy("plan", "size").count().toArrow()
    plan, size, count = (histogram.column(c).to_numpy() for c in ("plan", "size", "count"))
    plans: dict[int, tuple] = {}
    for i, (_, c) in enumerate(kinds):
        units = c // unit_of(c, rule.most_lengths)
        counts = np.zeros(units + 1, np.int64)
        counts[size[plan == i]] = count[plan == i]
        if counts.any():
            p = Plan.best(units, counts, rule)
            e = np.array(p.entries, np.int64).reshape(-1, 4)
            plans[i] = (e[:, 0] * (1 << 45) + e[:, 1], e[:, 1], e[:, 3], p.by_pattern)
    broadcast = spark.sparkContext.broadcast(plans)  # grows with lengths and patterns, not with documents
    blocks = max(1, int(count.sum()) // rule.block_rows)
    keys = ["plan", "size", "block"]
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)))
    before = Window.partitionBy("plan", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "piece_no")) - 1
    ranked = blocked.withColumn("local", local).join(offsets, keys)
    return ranked.withColumn("rank", (F.col("offset") + F.col("local")).cast("long")).drop("offset", "local", "block").mapInArrow(_placer(broadcast), OUT)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind and capacity: containers, the least number that the tokens need, documents, tokens, the share of unused room, and the share
    of containers that patterns opened. Pieces are first summed per container, before documents are counted."""
    keys = ["container_kind", "capacity_tokens"]
    each = packed.groupBy(*keys, "container_id").agg(F.sum("n_tokens").alias("n"), F.count_if(F.col("piece_no") == 0).alias("d"), F.max("by_pattern").alias("p"))
    used = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("containers"), F.sum("d").alias("documents"), F.sum("n").alias("tokens"), F.avg(F.col("p").cast("int")).alias("p"))
    room = F.col("containers") * F.col("capacity_tokens")
    return used.select(*keys, "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), "documents", "tokens",
                       F.round(1 - F.col("tokens") / room, 6).alias("unused_share"), F.round("p", 6).alias("pattern_share"))
