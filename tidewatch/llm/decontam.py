"""Benchmark decontamination with a generalised suffix automaton.

The words of all items of a block go into one automaton. A document's words are
streamed through it; at each word the automaton knows the longest item passage
that ends there, and so every window that does."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import by_slices, free_name

WINDOW = 10
BLOCK_WORDS = 50_000

_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words: digits, letters a-z and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACE).split() if text else []


class ItemAutomaton:
    """Suffix automaton over the word ids of several items.

    ``outputs[state]`` lists (window length, items) of the windows that end in
    the state: for windows of the full length, the state that holds the
    passage of exactly that length; for shorter items, the state that holds
    the whole item. ``above[state]`` leads to the next state with outputs
    along the suffix links."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        found: dict[int, dict[int, set[str]]] = {}
        for name, ids in coded:
            need = min(window, len(ids))
            state, length = 0, 0
            for c in ids:
                state, length = self.next[state][c], length + 1
                while self.size[self.link[state]] >= need:
                    state = self.link[state]
                    length = min(length, self.size[state])
                if length >= need:
                    found.setdefault(state, {}).setdefault(need, set()).add(name)
        self.outputs = {s: [(n, tuple(sorted(names))) for n, names in sorted(o.items())] for s, o in found.items()}
        self.above = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.size.__getitem__):
            up = self.link[s]
            self.above[s] = up if up in self.outputs else self.above[up]
        self.shortest = min((min(window, len(ids)) for _, ids in coded), default=0)
        pairs = {(a, b) for _, ids in coded for a, b in zip(ids, ids[1:])}
        self.pairs = np.zeros(1 << 20, dtype=bool)
        if pairs:
            a, b = np.array(sorted(pairs), dtype=np.int64).T
            self.pairs[pair_slot(a, b)] = True

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._split(last, q, c)
        cur = self._state({}, 0, size[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1)
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _state(self, edges: dict[int, int], link: int, size: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.link) - 1

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [start, end) word spans inside window occurrences; the items."""
        spans: list[list[int]] = []
        names: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, names
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        for start, end in self._runs(ids):
            self._walk(ids[start:end].tolist(), start, spans, names)
        return spans, names

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches in which every adjacent pair of words also stands in an
        item. A window lies in one of them, so nothing else is streamed."""
        known = ids >= 0
        if self.shortest > 1:
            on = known[:-1] & known[1:]
            on[on] = self.pairs[pair_slot(ids[:-1][on], ids[1:][on])]
            extra = 1
        else:
            on, extra = known, 0
        if not on.any():
            return
        edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end + extra - start >= self.shortest:
                yield start, end + extra

    def _walk(self, ids: list[int], base: int, spans: list[list[int]], names: set[str]) -> None:
        state, length = 0, 0
        for i, c in enumerate(ids, base + 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            best, at = 0, state if state in self.outputs else self.above[state]
            while at > 0:
                for need, owners in self.outputs[at]:
                    if need <= length:
                        best = max(best, need)
                        names.update(owners)
                at = self.above[at]
            if best:
                start = i - best
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append([start, i])


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 1_000_003 + b) * 2_654_435_761 >> 7) & ((1 << 20) - 1)


_OUT = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_ARROW = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))]


def _scanner(auto, keys: list[str]):
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton: ItemAutomaton = auto.value
        counts, spans, items = [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            hit, names = automaton.scan(words)
            counts.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in hit])
            items.append(sorted(names))
        cols = [batch.column(k) for k in keys] + [pa.array(v, t) for v, (_, t) in zip((counts, spans, items), _ARROW)]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, *(n for n, _ in _ARROW)])

    return by_slices(scan)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> list[DataFrame]:
    """Items dealt by a hash into blocks of about ``block_words`` words. Items
    longer than a block are cut into pieces that overlap by a window less one
    word, which keeps every window whole."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = F.regexp_extract_all(F.coalesce(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.lit(word), F.lit(0))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).filter(F.size("words") > 0)
    step = block_words  # a rest below the window has all its windows in the piece before, and would count as a short item
    cut = F.expr(f"transform(sequence(0, greatest(0, size(words) - {window}) div {step}), i -> slice(words, int(i * {step} + 1), {step + window - 1}))")
    pieces = items.select("item", F.explode(cut).alias("words"))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // block_words)
    return [pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == b) for b in range(n)]


def _sent(spark: SparkSession, block: DataFrame, window: int):
    """The automaton of a block as a broadcast."""
    items = [(r.item, [w.encode() for w in r.words]) for r in block.toLocalIterator()]
    return spark.sparkContext.broadcast(ItemAutomaton(items, window))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row columns doc_id and text, n_words, spans, items) for every document.

    ``spans`` are merged [start, end) word positions inside any occurrence of a
    window of the benchmark, ``items`` the ids of the items whose windows occur.
    A window is ``window`` consecutive words of an item, or a shorter item as a
    whole. Null and empty texts have no words; items without words have no
    window; a null item id counts as the id ''; repeated items are one item.
    An empty benchmark hits nothing.

    Only one block's automaton (``block_words`` words at most, plus the pieces
    a hash deals unevenly) is sent to the executors at a time."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    empty = base.select("*", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long").alias("n_words"),
                        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    parts = []
    for block in item_blocks(benchmark, block_words, window):
        auto = _sent(spark, block, window)
        parts.append(base.mapInArrow(_scanner(auto, ["doc_id", "text"]), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text string, {_OUT}"))
    if not parts:
        return empty
    if len(parts) == 1:
        return parts[0]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    n = len(parts)  # repeated rows come n times each; their results are equal
    grouped = stacked.groupBy("doc_id", "text").agg(
        (F.count(F.lit(1)) / n).cast("int").alias("_copies"), F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = F.expr("""aggregate(array_sort(spans), cast(array() as array<struct<start:int,end:int>>), (acc, s) ->
        if(size(acc) > 0 and s.start <= element_at(acc, -1).end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))),
           concat(acc, array(s))))""")
    return grouped.withColumn("spans", merged).select("doc_id", "text", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "_copies"))).drop("col")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _cut(texts: list[str | None], spans: list) -> list[str | None]:
    out = []
    for text, hits in zip(texts, spans):
        if hits:
            raw = text.encode("utf-8", "surrogatepass")
            flat, at, bounds = raw.translate(_SPACE), 0, []
            for word in flat.split():
                start = flat.index(word, at)
                at = start + len(word)
                bounds.append((start, at))
            keep, done = [], 0
            for h in hits:
                keep.append(raw[done:bounds[h["start"]][0]])
                done = bounds[h["end"] - 1][1]
            text = b"".join([*keep, raw[done:]]).decode("utf-8", "surrogatepass")
        out.append(text)
    return out


def _cleaner(auto, names: list[str], min_span: int, max_coverage: float):
    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton: ItemAutomaton = auto.value
        texts, kept, cuts = batch.column("text").to_pylist(), [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            hits, _ = automaton.scan(words)
            if sum(b - a for a, b in hits) <= max_coverage * len(words):  # 0 <= 0 without words
                kept.append(i)
                cuts.append([{"start": a, "end": b} for a, b in hits if b - a >= min_span])
        rows = batch.take(pa.array(kept, pa.int64()))
        text = pa.array(_cut([texts[i] for i in kept], cuts), pa.string())
        return pa.RecordBatch.from_arrays([text if c == "text" else rows.column(c) for c in names], names=names)

    return by_slices(clean)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_span: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without benchmark passages; columns of ``docs``.

    Spans of at least ``min_span`` words are cut out of the text. A document of
    whose words more than ``max_coverage`` lie in hits of any length is removed
    whole. Shorter spans (whole short items) stay in other documents. Nulls and
    empty texts stay. With one block of items a text is scanned and cut in one
    Python worker; with more, the spans of all blocks have to meet first."""
    blocks = item_blocks(benchmark, block_words)
    if len(blocks) == 1:
        names, types = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(_cleaner(_sent(docs.sparkSession, blocks[0], WINDOW), names, min_span, max_coverage), types)
    names, hits = docs.columns, free_name(docs, "spans")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    others = [F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")]
    packed = docs.select(F.struct("doc_id", *others).alias("doc_id"), "text")
    found = contamination(packed, benchmark, block_words=block_words)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    kept = found.filter((F.col("n_words") == 0) | (covered <= max_coverage * F.col("n_words")))
    kept = kept.withColumn("spans", F.filter("spans", lambda s: s["end"] - s["start"] >= min_span))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.array(_cut(batch.column("text").to_pylist(), batch.column(hits).to_pylist()), pa.string())
        return pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in names], names=names)

    flat = kept.select(*[F.col("text") if c == "text" else F.col("doc_id").getField(c).alias(c) for c in names], F.col("spans").alias(hits))
    return flat.mapInArrow(by_slices(cut), types)
