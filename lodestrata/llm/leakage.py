"""Held-out test items leaking into a corpus, by template windows and slot consistency.

Texts become words (runs of letters and digits; case, punctuation, underscores, written-out
escapes and markup signs fall away). For the search, numbers (anything that begins with a digit and
number words), units and names become typed placeholders. Names are the words that items spell with
a capital inside a sentence and some common ones, in any case; in documents also capitalised words
that no item has, so that a question asked about somebody else is found. All this only widens what
matches. Windows of one to three template words of the items are kept in a sorted table and
every window of every document is looked up in it. The window length per item is such that any
match must share a window with it, and how many, is known from the number of words that may be
altered, so the lookup loses nothing. Found (document, item) pairs are then judged on
the words themselves:

* ``passage``: at least ``run`` words of the item in a row;
* ``whole``: the whole item with at most ``altered`` of its words altered or lost;
* ``reparameterised``: as ``whole`` for the template, where each slot value of the item stands for
  one and the same other value throughout (slot consistency).

Items are broadcast in blocks of at most ``block_bytes`` of text (one longer item is a block of its
own), each block against all documents in one pass without a shuffle; a document of any length is
handled by one task in linear time. Window keys are 64-bit hashes of word numbers: a collision adds a
candidate, which is then judged, and never loses one, so any number of items and words will do.

Null texts and texts without words match nothing. Copies of a document count by themselves,
repeated rows once. Items of one or two words must occur whole.
"""

from __future__ import annotations

import pickle
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import share, ship

#: Number words, units and given names that become typed placeholders.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
_MEASURES = "metre meter gram litre liter watt volt joule newton hertz second byte bit ampere ohm pascal kelvin mole lumen lux tesla farad henry calorie".split()
_PREFIXES = ["", *"kilo mega giga tera milli micro nano pico centi deci hecto".split()]
UNITS = frozenset(p + m + s for p in _PREFIXES for m in _MEASURES for s in ("", "s")) | frozenset(
    "mm cm km mg kg ml kb mb gb tb kw kwh mw hz khz mhz ghz kpa nm inch inches foot feet yard yards mile miles acre acres hectare hectares tonne tonnes ton tons "
    "pound pounds ounce ounces gallon gallons pint pints minute minutes hour hours day days week weeks month months year years percent degree degrees celsius fahrenheit "
    "radian radians dollar dollars euro euros cent cents yen knot knots mph kph rpm".split()
)
NAMES = frozenset(
    "alice bob carol dave eve frank grace heidi james john mary robert michael william david richard joseph thomas "
    "sarah anna emma olivia noah liam sophia mia lucas maria peter paul george".split()
)

_WORD = re.compile(r"[^\W_]+")
_CAPITALISED = re.compile(r"(?<![^\W_])[A-Z][a-z]+(?![^\W_])")
_INSIDE = re.compile(r"(?<=[^\W_][ ,;:] )[A-Z][a-z]+(?![^\W_])|(?<=[^\W_] )[A-Z][a-z]+(?![^\W_])")
_ESCAPE = re.compile(r"\\(?:u[0-9a-f]{4}|x[0-9a-f]{2}|[nrtfvb0])")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits, written-out escapes removed."""
    if not text:
        return []
    text = text.lower()
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    return _WORD.findall(text)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end in the text of each of its :func:`words`."""
    low = text.lower()
    if "\\" in low:
        low = _ESCAPE.sub(lambda m: " " * len(m.group()), low)
    found = [m.span() for m in _WORD.finditer(low)]
    if len(low) != len(text):
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
        found = [(origin[a], origin[b - 1] + 1) for a, b in found]
    return found


def template(word: str, names=NAMES) -> str:
    """The word, or the placeholder of its type."""
    if word in NUMBERS or word[0].isdigit():
        return "<number>"
    if word in UNITS:
        return "<unit>"
    return "<name>" if word in names else word


def names_in(text: str | None) -> set[str]:
    """Words that a text spells with a capital inside a sentence."""
    return {w.lower() for w in _INSIDE.findall(text or "")}


def window_length(n: int, altered: float) -> int:
    """The longest window up to three words that survives in any item of n words with so many edits."""
    edits = int(n * altered)
    return max(1, min(3, -(-(n - edits) // (edits + 1)), n))


def needed_windows(n: int, run: int, altered: float) -> int:
    """How many windows any match of the item has in common with the document, at least."""
    w, edits = window_length(n, altered), int(n * altered)
    whole = n - w + 1 - w * edits
    return max(1, min(whole, run - w + 1) if n >= run else whole)


class _Numbers(dict):
    """Numbers of words met so far: those of the items, and for any other word that of numbers or 0."""

    def __init__(self, known: dict[str, int], digits: int):
        super().__init__(known)
        self.digits = digits

    def __missing__(self, word: str) -> int:
        self[word] = number = self.digits if word[0].isdigit() else 0
        return number


def may_hold(item: np.ndarray, text: np.ndarray, edits: int) -> bool:
    """False if so many words of the item are not in the text at all that it cannot be there with so few edits."""
    size = int(item.max()) + 1
    here = text[(text >= 0) & (text < size)]
    return int(np.minimum(np.bincount(item, minlength=size), np.bincount(here, minlength=size)).sum()) >= len(item) - edits


class ItemIndex:
    """The template windows of a block of items as sorted arrays."""

    def __init__(self, items: list[tuple], run: int, altered: float):
        self.run, self.altered = run, altered
        self.ids, self.words = [], []
        names = set(NAMES)
        for item_id, text in items:
            found = words(text)
            if found:
                self.ids.append(item_id)
                self.words.append(found)
                names |= names_in(text)
        #: Word numbers: 0 stands for every word that no item has.
        self.number: dict[str, int] = {}
        for item in self.words:
            for word in item:
                self.number.setdefault(template(word, names), len(self.number) + 1)
        #: Numbers of the placeholders; words of their types get the same.
        self.digits, self.unit, self.name = (self.number.get(p, 0) for p in ("<number>", "<unit>", "<name>"))
        for kind, of in ((self.digits, NUMBERS), (self.unit, UNITS), (self.name, names)):
            if kind:
                self.number.update((w, kind) for w in of if template(w, names) in self.number and self.number[template(w, names)] == kind)
        self.slots = {self.digits, self.unit, self.name} - {0}
        self._met = None
        self.needed = np.array([needed_windows(len(x), run, altered) for x in self.words], np.int64)
        self.length = np.array([len(x) for x in self.words], np.int64)
        self.templates = [self.numbers_of(x) for x in self.words]
        self.tables = {}
        for w in {window_length(len(x), altered) for x in self.words}:
            keys, owners = [], []
            for k, item in enumerate(self.templates):
                if window_length(len(item), altered) == w:
                    keys.append(self.keys(item, w)[0])
                    owners.append((np.full(len(item) - w + 1, k, np.int64) << 32) + np.arange(len(item) - w + 1))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            unique, start, count = np.unique(keys[order], return_index=True, return_counts=True)
            self.tables[w] = unique, start, count, owners[order]
        self.least = int(min(self.needed)) if len(self.needed) else 1
        self.runs: dict[tuple, set[int]] = {}
        for k, item in enumerate(self.words):
            for i in range(len(item) - run + 1):
                self.runs.setdefault(tuple(item[i : i + run]), set()).add(k)

    def numbers_of(self, found: list[str], text: str | None = None) -> np.ndarray:
        """Template numbers of words; with their ``text``, capitalised words that no item has are names."""
        if self._met is None or len(self._met) > 1 << 20:
            self._met = _Numbers(self.number, self.digits)
        met = self._met
        ids = np.fromiter((met[w] for w in found), np.int64, len(found))
        if self.name and text and not ids.all():
            capitalised = {w.lower() for w in _CAPITALISED.findall(text)}
            if capitalised:
                for i in np.nonzero(ids == 0)[0].tolist():
                    if found[i] in capitalised:
                        ids[i] = self.name
        return ids

    def keys(self, ids: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash per window, and whether all its words are known."""
        n = max(0, len(ids) - w + 1)
        key, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(w):
            part = ids[j : j + n]
            key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            known &= part > 0
        return key, known

    def candidates(self, ids: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """{item: (document positions, item positions)} of items with enough windows in common."""
        out = {}
        for w, (unique, start, count, owners) in self.tables.items():
            if len(ids) < w:
                continue
            keys, known = self.keys(ids, w)
            at = np.nonzero(known)[0]
            if not len(at):
                continue
            slot = np.searchsorted(unique, keys[at])
            slot[slot == len(unique)] = 0
            hit = unique[slot] == keys[at]
            at, slot = at[hit], slot[hit]
            if not len(at):
                continue
            n = count[slot]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = owners[np.repeat(start[slot], n) + offset]
            where = np.repeat(at, n)
            item = owner >> 32
            often = np.bincount(item, minlength=len(self.ids))
            for k in np.nonzero(often >= np.maximum(self.needed, 1))[0]:
                if window_length(self.length[k], self.altered) == w:
                    mine = item == k
                    out[int(k)] = where[mine], (owner & (2**32 - 1))[mine]
        return out

    def regions(self, k: int, where: np.ndarray, inner: np.ndarray, size: int):
        """Stretches of the document in which item k has enough distinct windows."""
        span = int(self.length[k] * (1 + self.altered)) + 3
        need = int(self.needed[k])
        end = np.searchsorted(where, where + span, "right")
        good = np.nonzero(end - np.arange(len(where)) >= need)[0]
        low = high = None
        for g in good:
            if len(np.unique(inner[g : end[g]])) < need:
                continue
            a, b = max(0, int(where[g]) - span), min(size, int(where[end[g] - 1]) + span + 3)
            if high is not None and a <= high:
                high = max(high, b)
            else:
                if high is not None:
                    yield low, high
                low, high = a, b
        if high is not None:
            yield low, high

    def judge(self, k: int, found: list[str], ids: np.ndarray, regions: list[tuple[int, int]]) -> str | None:
        item, best = self.words[k], None
        if len(item) >= self.run:
            for a, b in regions:
                for i in range(a, b - self.run + 1):
                    if k in self.runs.get(tuple(found[i : i + self.run]), ()):
                        return "passage"
        edits = int(len(item) * self.altered)
        number: dict[str, int] = {}
        exact = np.array([number.setdefault(w, len(number)) for w in item])
        for a, b in regions:
            there = np.array([number.get(w, -1) for w in found[a:b]], np.int64)
            if may_hold(exact, there, edits) and least_edits(exact, there)[0] <= edits:
                return "whole"
            if not self.slots or not may_hold(self.templates[k], ids[a:b], edits):
                continue
            distance, end = least_edits(self.templates[k], ids[a:b])
            low = a + max(0, end - len(item) - edits)
            if distance <= edits and self.consistent(k, found[low : a + end], ids[low : a + end]):
                best = "reparameterised"
        return best

    def consistent(self, k: int, part: list[str], part_ids: np.ndarray) -> bool:
        """Whether each slot value of the item meets one value only, in order of the slots."""
        theirs = [(w, i) for w, i in zip(part, part_ids.tolist()) if i in self.slots]
        ours = [(w, i) for w, i in zip(self.words[k], self.templates[k].tolist()) if i in self.slots]
        bound: dict[str, str] = {}
        return len(ours) == len(theirs) and all(i == j and bound.setdefault(a, b) == b for (a, i), (b, j) in zip(ours, theirs))

    def stretches(self, k: int, found: list[str], ids: np.ndarray, regions: list[tuple[int, int]]):
        """The words (from, to) of a document that are item k: its passages, and the whole item however altered."""
        item = self.words[k]
        edits = int(len(item) * self.altered)
        number: dict[str, int] = {}
        exact = np.array([number.setdefault(w, len(number)) for w in item])
        for a, b in regions:
            for i in range(a, b - self.run + 1):
                if k in self.runs.get(tuple(found[i : i + self.run]), ()):
                    yield i, i + self.run
            there = np.array([number.get(w, -1) for w in found[a:b]], np.int64)
            rest = ids[a:b].copy()
            if may_hold(exact, there, edits):
                for low, high in occurrences(exact, there, edits):
                    yield a + low, a + high
                    rest[low:high] = 0
            if not self.slots or not may_hold(self.templates[k], rest, edits):
                continue
            for low, high in occurrences(self.templates[k], rest, edits):
                if self.consistent(k, found[a + low : a + high], ids[a + low : a + high]):
                    yield a + low, a + high

    def without(self, text: str | None) -> str | None:
        """The text with a blank for each stretch that is an item; the same words elsewhere stay."""
        found = words(text)
        ids = self.numbers_of(found, text)
        if np.count_nonzero(ids) < self.least:
            return text
        gone = sorted(
            part for k, (where, inner) in self.candidates(ids).items()
            for part in self.stretches(k, found, ids, list(self.regions(k, where, inner, len(found))))
        )
        if not gone:
            return text
        spans, kept, at = word_spans(text), [], 0
        for low, high in gone:
            start, end = spans[low][0], spans[high - 1][1]
            if end > at:
                kept.append(text[at : max(at, start)])
                at = end
        return " ".join([*kept, text[at:]])

    def search(self, text: str | None) -> list[tuple]:
        """(item id, kind) of every item found in a document."""
        found = words(text)
        ids = self.numbers_of(found, text)
        if np.count_nonzero(ids) < self.least:
            return []
        out = []
        for k, (where, inner) in self.candidates(ids).items():
            regions = list(self.regions(k, where, inner, len(found)))
            kind = self.judge(k, found, ids, regions) if regions else None
            if kind:
                out.append((self.ids[k], kind))
        return out


def edits_by_end(item: np.ndarray, text: np.ndarray, anywhere: bool = True) -> np.ndarray:
    """The least number of altered, lost or inserted words of the item ending after each word of the text, from anywhere or from its first word.

    The columns of the dynamic program are kept as differences in the bits of two integers, so a word
    costs a few operations however long the item is.
    """
    places: dict[int, int] = {}
    for j, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << j
    mask, top, first = (1 << len(item)) - 1, len(item) - 1, 0 if anywhere else 1
    more, less, score, out = mask, 0, len(item), []
    for word in text.tolist():
        equal = places.get(word, 0)
        vertical = equal | less
        flat = (((equal & more) + more) ^ more) | equal
        up, down = less | (mask & ~(flat | more)), more & flat
        score += (up >> top & 1) - (down >> top & 1)
        up, down = up << 1 & mask | first, down << 1 & mask
        more, less = down | (mask & ~(vertical | up)), up & vertical
        out.append(score)
    return np.array(out, np.int64)


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least number of edits of the item anywhere in the text, and where it ends."""
    by_end = edits_by_end(item, text)
    end = int(np.argmin(by_end)) if len(by_end) else 0
    return (int(by_end[end]), end + 1) if len(by_end) and by_end[end] < len(item) else (len(item), 0)


def occurrences(item: np.ndarray, text: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """The stretches (from, to) of the text that are the item with at most so many edits, best first, apart from each other."""
    by_end = edits_by_end(item, text)
    out: list[tuple[int, int]] = []
    for end in sorted(np.nonzero(by_end <= edits)[0].tolist(), key=lambda e: (by_end[e], e)):
        if any(low <= end < high for low, high in out):
            continue
        back = text[max(0, end + 1 - len(item) - edits) : end + 1][::-1]
        low = end - int(np.argmin(edits_by_end(item[::-1], back, False)))
        if not any(low < h and l <= end for l, h in out):
            out.append((low, end + 1))
    return out


def item_blocks(items: DataFrame, block_bytes: int, run: int, altered: float):
    """Indexes of the items (item_id, item_text) in blocks of a bounded size of text, one at a time.

    Blocks are made from the sizes alone, which are summed per hash; only one block's texts are on the driver at once.
    """
    sized = items.select("item_id", "item_text", F.pmod(F.xxhash64("item_text"), F.lit(1 << 12)).alias("part"), F.octet_length("item_text").alias("bytes"))
    parts = sized.groupBy("part").agg(F.sum("bytes").alias("bytes")).orderBy("part").collect()  # 4,096 rows at most
    low, total = 0, 0
    bounds = []
    for r in parts:
        if total and total + r["bytes"] > block_bytes:
            bounds.append((low, r["part"] - 1))
            low, total = r["part"], 0
        total += r["bytes"]
    bounds.append((low, (1 << 12) - 1))
    for first, last in bounds:
        rows = sized.where(F.col("part").between(first, last)).select("item_id", "item_text").collect()
        yield ItemIndex([tuple(r) for r in rows], run, altered)


#: Bytes of item texts in one broadcast index.
BLOCK_BYTES = 16 << 20


def clean_items(items: DataFrame) -> DataFrame:
    """The distinct items with a text."""
    return items.select("item_id", "item_text").where(F.col("item_text").isNotNull()).distinct()


def leaks(documents: DataFrame, items: DataFrame, run: int = 10, altered: float = 0.25, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, kind of every item found in a document (kinds as in the module text).

    ``documents``: doc_id and text; ``items``: item_id and item_text. Other columns are ignored.
    """
    spark = documents.sparkSession
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, kind string"
    found = []
    for index in item_blocks(clean_items(items), block_bytes, run, altered):
        shared = share(spark, index)

        def search(batches, shared=shared):
            index = pickle.loads(shared.value)
            for batch in batches:
                out = [(d, *hit) for d, text in zip(batch["doc_id"], batch["text"]) for hit in index.search(text)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind"])

        found.append(documents.select("doc_id", "text").mapInPandas(search, schema))
    return reduce(DataFrame.unionAll, found).distinct()


ship(__name__)
