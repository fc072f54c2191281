"""Problem 8: evaluation texts inside training texts, by a hash-join of canonical template windows.

Words become typed placeholders: a number, a unit, or a name, which is any word that is no plain word of the items
(so the type of a word does not depend on its case or place, and equal words always get equal types). Windows of six
canonical words are hashed, and Spark joins those of documents and items. A passage of twelve words with one word
altered, added or dropped keeps six words at one of its ends, so windows find all of them. Then slots are compared:
where all slots of a window hold the item's own words, the passage is checked word by word from the window outwards;
where each slot of the item always goes with one other value over a run of twelve words, the passage is a
re-parameterised question.

What travels to the tasks has a fixed size: one bit map of the items' plain words and one of their windows, which
keeps the windows that no item has out of the join. A word that the first holds by chance counts as plain on both
sides, which loses no passage; a window that the second holds by chance meets nothing in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.visible import plain_words, visible_words
from covermill.session import Scratch, small_side

#: Successive words of an item that a document must hold, and the words of a window: half of them.
PASSAGE, WINDOW = 12, 6
#: A window with fewer plain words is hashed by its own words, as placeholders alone would meet anything.
LEAST_PLAIN = 3
#: Bits of a bit map, as a power of two: 2 MB each.
MAP_BITS = 24
#: Words that a task remembers the hashes of.
MOST_KNOWN = 1 << 20
_NUMBER, _UNIT, _NAME = 0, 1, 2

# fixed values: units of measure that are taken for slots
UNITS = frozenset("mm cm dm m km ft in yd mi mg g kg t ml cl dl l ha km2 m2 s ms h min kmh mph hz khz mhz w kw mw v kv a k pa kpa bar j kj".split())


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def bit_map(hashes: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A map of ``2**bits`` bits with those of ``hashes(h)`` set; a row for each 64 bits goes to the driver."""
    bit = F.expr(f"h & {(1 << bits) - 1}L")
    rows = hashes.where("h is not null").select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for r in rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["at"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class _Words:
    """Hashes and canonical codes of words: 0 to 2 for slots, the word's hash for plain ones."""

    def __init__(self, plain: np.ndarray):
        self.plain = plain
        self.codes: dict[str, int] = {}
        self.raw: list[int] = []
        self.canon: list[int] = []

    def _new(self, word: str) -> int:
        at, h = len(self.raw), _hash(word)
        low = h & (64 * len(self.plain) - 1)
        if any(ch.isdigit() for ch in word):
            code = _NUMBER
        elif word in UNITS:
            code = _UNIT
        else:
            code = max(h, _NAME + 1) if int(self.plain[low >> 6]) >> (low & 63) & 1 else _NAME
        self.codes[word] = at
        self.raw.append(h)
        self.canon.append(code)
        return at

    def code(self, word: str) -> int:
        if len(self.raw) > MOST_KNOWN:
            self.__init__(self.plain)
        at = self.codes.get(word)
        return self.canon[self._new(word) if at is None else at]

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.raw) > MOST_KNOWN:
            self.__init__(self.plain)
        get, new = self.codes.get, self._new
        at = np.array([i if (i := get(w)) is not None else new(w) for w in words], dtype=np.int64)
        return np.array(self.raw, dtype=np.uint64)[at], np.array(self.canon, dtype=np.uint64)[at]


def _keys(raw: np.ndarray, canon: np.ndarray) -> np.ndarray:
    """A hash of each window: of its canonical words, or of its own words where too few are plain."""
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    a, b = np.zeros(n, dtype=np.uint64), np.full(n, 77, dtype=np.uint64)
    plain = np.zeros(n, dtype=np.int8)
    for k in range(WINDOW):
        c, r = canon[k : k + n], raw[k : k + n]
        a = (a ^ (c + np.uint64(1))) * base
        a ^= a >> np.uint64(29)
        b = (b ^ (r + np.uint64(3))) * base
        b ^= b >> np.uint64(31)
        plain += c > _NAME
    return np.where(plain >= LEAST_PLAIN, a, b)


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of each item, and hashes of its plain words: those that it writes in lower case."""
    for pdf in batches:
        lower = [sorted({int(np.uint64(_hash(w)).view(np.int64)) for token in t.split() if token[:1].islower() for w in plain_words(token)}) for t in pdf["text"]]
        yield pd.DataFrame({"item_id": pdf["item_id"], "words": [plain_words(t) for t in pdf["text"]], "plain": lower})


def _item_windows(plain: np.ndarray):
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(plain)
        for pdf in batches:
            rows = [(i, k, p) for i, w in zip(pdf["item"], pdf["words"]) for p, k in enumerate(_keys(*words.of(list(w))).view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["item", "key", "p"])

    return windows


def _document_windows(plain: np.ndarray, keys: np.ndarray):
    """The words of each document with windows that an item may have, and these windows."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(plain)
        for pdf in batches:
            docs = [(d, ws) for d, t in zip(pdf["doc_id"], pdf["text"]) if t and len(ws := visible_words(t)) >= WINDOW]
            out = []
            if docs:
                raw, canon = words.of([w for _, ws in docs for w in ws])
                starts = np.cumsum([0, *(len(ws) for _, ws in docs)])
                every = _keys(raw, canon)
                hit = np.flatnonzero(_in_map(keys, every))
                owner = np.searchsorted(starts, hit, side="right") - 1
                inside = hit + WINDOW <= starts[owner + 1]
                hit, owner = hit[inside], owner[inside]
                for o in np.unique(owner):
                    own = hit[owner == o]
                    out.append((docs[o][0], docs[o][1], every[own].view(np.int64).tolist(), (own - starts[o]).tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "words", "keys", "places"])

    return windows


def _near(item: list[str], doc: list[str]) -> bool:
    """Whether ``doc`` begins with ``item``, one word altered, added or dropped at most."""
    k = 0
    while k < len(item) and k < len(doc) and item[k] == doc[k]:
        k += 1
    if k == len(item):
        return True
    rest = item[k:]
    altered = len(doc) > k and doc[k + 1 : k + len(rest)] == rest[1:]
    return altered or doc[k + 1 : k + 1 + len(rest)] == rest or doc[k : k + len(rest) - 1] == rest[1:]


def _holds(item: list[str], doc: list[str], p: int, j: int) -> bool:
    """Whether the equal windows at ``p`` and ``j`` are the first or last half of a passage."""
    n = PASSAGE - WINDOW
    after = item[p + WINDOW : p + PASSAGE]
    if len(after) == n and _near(after, doc[j + WINDOW : j + PASSAGE + 1]):
        return True
    before = item[max(0, p - n) : p]
    return len(before) == n and _near(before[::-1], doc[max(0, j - n - 1) : j][::-1])


def _slots(item: list[str], doc: list[str]) -> str | None:
    """What the slots of two stretches of equal canonical words hold: the item's own words (``own``), one other value
    for each of the item's (``other``), or ``None`` where one value of the item goes with two."""
    mapped: dict[str, str] = {}
    for a, b in zip(item, doc):
        if mapped.setdefault(a, b) != b:
            return None
    return "own" if item == doc else "other"


def _judged(item: list[str], doc: np.ndarray, places: list[tuple[int, int]], code) -> str | None:
    """``passage`` or ``template`` by the windows ``(p, j)`` that item and document share, or ``None``. Only the words
    around them are looked at; ``code`` gives the canonical code of a word."""
    around = lambda j: doc[max(0, j - PASSAGE) : j + 2 * PASSAGE].tolist()
    for p, j in places:
        near = around(j)
        at = min(j, PASSAGE)
        if _slots(item[p : p + WINDOW], near[at : at + WINDOW]) == "own" and _holds(item, near, p, at):
            return "passage"
    ends: dict[int, int] = {}
    same = lambda p, j: item[p] == doc[j] or code(item[p]) == code(doc[j])
    for p, j in sorted(places):
        # windows inside the diagonal's last run; a window of few plain words is no anchor, as it is hashed by its own
        if j + WINDOW <= ends.get(j - p, 0) or sum(code(w) > _NAME for w in item[p : p + WINDOW]) < LEAST_PLAIN or not all(same(p + k, j + k) for k in range(WINDOW)):
            continue
        lo, hi = 0, WINDOW
        while p - lo > 0 and j - lo > 0 and same(p - lo - 1, j - lo - 1):
            lo += 1
        while p + hi < len(item) and j + hi < len(doc) and same(p + hi, j + hi):
            hi += 1
        ends[j - p] = j + hi
        if lo + hi >= PASSAGE and _slots(item[p - lo : p + hi], doc[j - lo : j + hi].tolist()) == "other":
            return "template"
    return None


def _judge(plain: np.ndarray):
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = _Words(plain).code
        for pdf in batches:
            rows = []
            for doc_id, item, doc, own, places in zip(pdf["doc_id"], pdf["item"], pdf["words"], pdf["item_words"], pdf["places"]):
                kind = _judged(own.tolist(), doc, [(x["p"], x["j"]) for x in places], code)
                if kind:
                    rows.append((doc_id, item, kind))
            yield pd.DataFrame(rows, columns=["doc_id", "item", "kind"])

    return judge


def leaks(scratch: Scratch, docs: DataFrame, items: DataFrame, map_bits: int = MAP_BITS) -> DataFrame:
    """``doc_id, item_id, kind``: documents that hold a passage of an item (``passage``), or an item's template with
    other values in its slots (``template``); a pair that is both is a passage.

    Documents are read once and not shuffled; only those with a window of some item go on. The items' windows are
    broadcast only where they are few; else both sides are shuffled by window, where Spark splits common ones, as it
    does those of an item that leaks into very many documents. Null and blank texts hold nothing; items of fewer than
    twelve words cannot be held; items with equal words leak together. Extra columns are ignored.
    """
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    own = scratch.keep(texts.mapInPandas(_item_words, "item_id long, words array<string>, plain array<long>").where("size(words) > 0"))
    plain = bit_map(own.select(F.explode("plain").alias("h")), map_bits)
    one = scratch.keep(own.groupBy("words").agg(F.min("item_id").alias("item")).select("item", "words"))
    windows = scratch.keep(one.mapInPandas(_item_windows(plain), "item long, key long, p int"))
    keys = bit_map(windows.select(F.col("key").alias("h")), map_bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    held = rows.mapInPandas(_document_windows(plain, keys), "doc_id long, words array<string>, keys array<long>, places array<int>")
    held = scratch.keep(held.withColumn("row", F.monotonically_increasing_id()))
    hits = held.select("row", F.explode(F.arrays_zip("keys", "places")).alias("h")).select("row", F.col("h.keys").alias("key"), F.col("h.places").alias("j"))
    met = hits.join(small_side(windows), "key").groupBy("row", "item").agg(F.collect_list(F.struct("p", "j")).alias("places"))
    pairs = met.join(held.select("row", "doc_id", "words"), "row").join(one.withColumnRenamed("words", "item_words"), "item")
    found = pairs.select("doc_id", "item", "words", "item_words", "places").mapInPandas(_judge(plain), "doc_id long, item long, kind string")
    members = own.join(one, "words").select("item", "item_id")
    best = found.join(small_side(scratch.keep(members)), "item").groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind"))
    return best.select("doc_id", "item_id", "kind")
