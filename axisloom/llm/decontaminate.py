"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of words of every test item. A document's words are streamed through it once; after each
word it knows the longest run that ends there and is part of some item. A window is `window` consecutive words of an
item, or the whole item if it is shorter; a word is hit if it lies inside an occurrence of a window.

Test items are a bounded input: they are dealt into blocks of BLOCK_BYTES of text, one automaton each, and documents
pass the blocks one after another in the same task, with no shuffle; one small benchmark is one block. A block is the
only thing that a worker holds beside its batch of documents.

Null and empty texts have no words and no hits. Items without words, null ones included, match nothing; an item with a
null id hits words but isn't counted. Items that repeat, in id or text, count once for each id. Documents are judged
row by row, so repeated rows and null ids get rows of their own. Other columns pass untouched; names may clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import PLAIN, binary, dropped, free_name, map_arrow, plain_words, saved

#: Text of test items that one automaton holds at most, about.
BLOCK_BYTES = 4 << 20
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


class Automaton:
    """Generalised suffix automaton of (item id, words)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: state -> {window length: ids of the items that have this window}, for windows among the state's own runs.
        own: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, words in items:
            n, s = min(window, len(words)), 0
            for i, w in enumerate(words):
                s = self.next[s][w]
                if i + 1 >= n:
                    t = s
                    while self.length[self.link[t]] >= n:
                        t = self.link[t]
                    own[t][n] |= {name} if name is not None else set()
        self.own = {s: sorted((n, frozenset(ids)) for n, ids in x.items()) for s, x in own.items()}
        #: The nearest state above that has windows, or -1; the shortest match that has a window, or a large number.
        self.up, self.least = [-1] * len(self.next), [1 << 60] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.link[s]
            self.up[s] = above if above in self.own else self.up[above]
            self.least[s] = 1 if self.up[s] >= 0 else self.own[s][0][0] if s in self.own else 1 << 60

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(w)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, w, known)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit stretches [start, end) of `words`, and the ids of items with occurring windows."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        s = long = 0
        for i, w in enumerate(words):
            t = nxt[s].get(w)
            if t is None:
                while s and t is None:
                    s = link[s]
                    t = nxt[s].get(w)
                if t is None:
                    long = 0
                    continue
                long = length[s]
            s = t
            long += 1
            if long >= least[s]:
                widest, state = 0, s
                while state >= 0:
                    for n, ids in self.own.get(state, ()):
                        if n <= long:
                            widest = max(widest, n)
                            found |= ids
                    state = self.up[state]
                start = i + 1 - widest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """`text` without the words of `spans` and what stands between them; the rest keeps its bytes."""
    at = [m.span() for m in _WORD.finditer(text.translate(PLAIN))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[str | None, list[bytes]]], bool]]:
    """The items by blocks, each with whether it is the last. The table is a stated query set; the driver holds a block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), binary("text").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for k in range(n):
        yield [(i, w) for i, t in items.where(part == k).toLocalIterator() if (w := plain_words(bytes(t)))], k == n - 1


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, spans: str = "spans", items: str = "items", words: str = "n_words", trimmed: str | None = None, shortest: int = 1) -> DataFrame:
    """`docs` with hit stretches of words, the ids of items with occurring windows (sorted as strings), and the number of
    words; as column `trimmed`, if named, also the text without stretches of `shortest` words or more (null: nothing to cut)."""
    text = free_name(docs, "bytes")
    if trimmed:
        docs = docs.withColumn(trimmed, F.lit(None).cast("binary"))
    out = docs.withColumns({text: binary("text"), spans: F.array().cast("array<array<int>>"), items: F.array().cast("array<string>"), words: F.lit(0).cast("long")})
    before = None
    for block, last in _blocks(benchmark):
        automaton = Automaton(block, window)

        def run(b: pa.RecordBatch, automaton: Automaton = automaton, last: bool = last) -> pa.RecordBatch:
            at = [b.schema.get_field_index(c) for c in (text, spans, items, words)]
            new = b.schema.get_field_index(trimmed) if trimmed and last else None
            got = {i: [] for i in (*at[1:], *([new] if new is not None else []))}
            for t, old, ids in zip(*(b.column(i).to_pylist() for i in at[:3]), strict=True):
                w = plain_words(t)
                hit, found = automaton.match(w)
                hits = merged([*map(tuple, old), *hit])
                got[at[1]].append(hits)
                if new is not None:
                    long = [h for h in hits if h[1] - h[0] >= shortest]
                    got[new].append(cut(t, long) if long else None)
                got[at[2]].append(sorted(found.union(ids)))
                got[at[3]].append(len(w))
            return pa.record_batch([pa.array(got[i], f.type) if i in got else b.column(i) for i, f in enumerate(b.schema)], schema=b.schema)

        out = map_arrow(out, run, StructType(out.schema.fields))
        if not last:  # a worker holds the automaton of one block; the next block is a pass of its own
            out = saved(out)
            if before is not None:
                dropped(before)
            before = out
    return out.drop(text)


def n_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row."""
    found = matches(docs.select("doc_id", "text"), benchmark, window)
    hit = n_hit("spans")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, shortest: int = 1, coverage: float = 0.5) -> DataFrame:
    """`docs` without what they share with the test items, in their own columns.

    Hit stretches of `shortest` words or more are cut out of the text, n_chars (where there is one) follows. Rows of
    which more than the share `coverage` of all words is hit go. Rows without hits stay as they are, to the byte.
    """
    spans, items, words, out, raw = (free_name(docs, x) for x in ("spans", "items", "words", "out", "trimmed"))
    found = matches(docs, benchmark, window, spans, items, words, raw, shortest)
    found = found.where(n_hit(spans) <= F.col(words) * coverage)
    text = F.when(F.col(raw).isNotNull(), F.decode(raw, "UTF-8")).otherwise(F.col("text"))
    found = found.withColumn(out, text).withColumn("text", F.col(out))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(raw).isNotNull(), F.length(out)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def digest(ids: set[str]) -> str:
    """items_sha256 of a set of ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
