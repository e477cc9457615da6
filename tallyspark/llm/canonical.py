"""Freely typed values mapped to a canonical list.

An Aho-Corasick automaton over all canonical names and aliases finds the mentions embedded in a
value; the longest that do not overlap win. A value names an item when its mentions agree on one and
nothing but decoration is left of it (note references, numbering, "restated" and the like). The
other values go to token-set similarity: words are paired one to one, by equality, small slips of
typing or abbreviation, and every content word on both sides must find a partner.

Defined results: null, empty and blank values name nothing; a value that names two items, or whose
best two items tie, names none; a value with a further content word names another thing.

A list of any length is taken in shards of ``SHARD`` entries by the hash of the folded name: every record
passes through all of them, gathers mentions and similarities, and is settled at the end, without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.textnorm import distance, fold, read_digits
from tallyspark.session import cut

#: Entries that one pass holds.
SHARD = 200_000
#: Least similarity of a value and an alias that have no embedded mention.
LEAST = 0.7
CACHE = 200_000

# Words around a caption that do not change what it names, in folded form.
DECORATION = frozenset("total totals see note notes nb ref unaudited audited restated net nets nette retraite retraites non audite voir معدله معدل ايضاح ايضاحات صافي انظر مدققه غير".split())


# Those of them that may as well belong to a caption ("... in total").
_EITHER = frozenset("total totals net nets nette non".split())
_NOTE = re.compile(r"(?:note|notes|ايضاح)\d+[a-z]?")


def _is_decoration(word: str) -> bool:
    return word in DECORATION or word.isdigit() or len(word) == 1 or bool(_NOTE.fullmatch(word))


def _is_reference(word: str) -> bool:
    """Decoration that no caption has, slips of typing included."""
    if word in _EITHER:
        return False
    return _is_decoration(word) or (len(word) > 3 and any(len(x) > 4 and distance(word, x, 1) <= 1 for x in DECORATION - _EITHER))


def _strip(words: list[str], loose) -> list[str]:  # noqa: ANN001
    first, last = 0, len(words)
    while first < last and loose(words[first]):
        first += 1
    while last > first and loose(words[last - 1]):
        last -= 1
    return words[first:last]


def _abbreviates(short: str, full: str) -> bool:
    """Whether ``short`` is a start of ``full`` or keeps its first letter and others in order."""
    if len(short) < 2 or len(short) > len(full) - 2 or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def _alike(word: str, entry: str) -> float:
    """Similarity of a typed word and a word of the list: 1 equal, 0 unrelated."""
    if word == entry:
        return 1.0
    n, allowed = len(entry), _slips(entry)
    if allowed and (d := distance(word, entry, allowed)) <= allowed:
        return 1 - d / n
    return 0.8 if _abbreviates(word, entry) else 0.0


def _drops(word: str, times: int) -> set[str]:
    """The word and what is left of it without up to so many of its letters."""
    out = last = {word}
    for _ in range(times):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _slips(word: str) -> int:
    """Slips of typing that may be in a word of this length."""
    n = len(word)
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 9 else 3


Verdict = tuple[str | None, str | None, float]
Mention = tuple[int, int, str]
NONE: Verdict = (None, None, 0.0)


def words_of(value: str | None) -> list[str]:
    """The words of a value in folded form."""
    return [read_digits(w) for w in (fold(value) or "").split()]


def by_mention(words: list[str], hits: Iterable[Mention]) -> Verdict | None:
    """What the longest mentions that do not overlap say, if nothing but decoration is left beside them; None if there is more."""
    if not words:
        return NONE
    taken: list[Mention] = []
    for a, b, item in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if all(b <= x or y <= a for x, y, _ in taken):
            taken.append((a, b, item))
    if not taken:
        return None
    rest = list(f" {' '.join(words)} ")
    for a, b, _ in taken:
        rest[a:b] = " " * (b - a)
    if not all(map(_is_decoration, "".join(rest).split())):
        return None
    items = {item for _, _, item in taken}
    return (items.pop(), "mention", 1.0) if len(items) == 1 else NONE


def by_similarity(best: dict[str, float]) -> Verdict:
    """The most similar item, none where two come within a fiftieth."""
    ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
    if not ranked or (len(ranked) > 1 and ranked[0][1] - ranked[1][1] < 0.02):
        return NONE
    return ranked[0][0], "similar", round(ranked[0][1], 4)


class Mapper:
    """The automaton and the word index of one canonical list of (item, alias)."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        names: dict[str, set[str]] = defaultdict(set)
        for item, alias in entries:
            words = " ".join(read_digits(w) for w in (fold(alias) or "").split())
            if words:
                names[words].add(item)
        self.names = {k: next(iter(v)) for k, v in names.items() if len(v) == 1}
        self.words = {k: k.split() for k in self.names}
        self.most_words = max(map(len, self.words.values()), default=0)
        self.machine = ahocorasick.Automaton()
        self.content: dict[str, frozenset[str]] = {}
        self.having: dict[str, set[str]] = defaultdict(set)
        self.near: dict[str, set[str]] = defaultdict(set)
        self.starts: dict[str, set[str]] = defaultdict(set)
        self.packed: dict[str, set[str]] = defaultdict(set)
        for k, words in self.words.items():
            self.machine.add_word(f" {k} ", k)
            self.content[k] = frozenset(w for w in words if len(w) > 3)
            for w in words:
                self.having[w].add(k)
            for x in _drops("".join(words), 1):
                self.packed[x].add(k)
        for w in self.having:
            self.starts[w[0]].add(w)
            for x in _drops(w, min(2, _slips(w))):
                self.near[x].add(w)
        if self.names:
            self.machine.make_automaton()
        self.cache: dict[str, Verdict] = {}
        self.met: dict[str, dict[str, float]] = {}

    def __call__(self, value: str | None) -> Verdict:
        """(item, how, score) of a value; (None, None, 0) when it names none."""
        if not value or not self.names:
            return NONE
        found = self.cache.get(value)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            words = words_of(value)
            found = by_mention(words, self.mentions(words))
            self.cache[value] = found = by_similarity(self.similar(words)) if found is None else found
        return found

    def mentions(self, words: list[str]) -> list[Mention]:
        """Every name in the padded text of the words, as (start, end, item)."""
        if not self.names or not words:
            return []
        return [(end - len(k), end, self.names[k]) for end, k in self.machine.iter(f" {' '.join(words)} ")]

    def alike(self, word: str) -> dict[str, float]:
        """The words of the list that a typed word may stand for, with their similarity."""
        found = self.met.get(word)
        if found is None:
            if len(self.met) >= CACHE:
                self.met.clear()
            close = set().union(*(self.near.get(x, ()) for x in _drops(word, 2))) if len(word) > 3 else {word} & self.having.keys()
            close |= self.starts.get(word[0], set()) if 1 < len(word) else set()
            found = self.met[word] = {w: s for w in close if (s := _alike(word, w)) > 0}
        return found

    def similar(self, words: list[str]) -> dict[str, float]:
        """item -> similarity of the best of its names, if at least LEAST."""
        if not words or sum(len(w) > 3 and not _is_decoration(w) for w in words) > self.most_words:
            return {}
        kept = _strip(words, _is_reference)
        best: dict[str, float] = {}
        for form in {tuple(kept), tuple(_strip(kept, _is_decoration)), tuple(words)}:
            packed = "".join(form)
            sims = [self.alike(w) for w in form]
            shared: dict[str, set[str]] = defaultdict(set)  # alias -> its words that some typed word stands for
            for sim in sims:
                for e in sim:
                    for k in self.having[e]:
                        shared[k].add(e)
            as_one = set().union(*(self.packed.get(x, ()) for x in _drops(packed, 1))) if packed else set()
            for k in shared.keys() | as_one:
                score = self._score(form, sims, packed, k, shared.get(k, set()), k in as_one)
                if score >= LEAST and score > best.get(self.names[k], 0):
                    best[self.names[k]] = score
        return best

    def _score(self, words: tuple[str, ...], sims: list[dict[str, float]], packed: str, key: str, shared: set[str], run_together: bool) -> float:
        entry = self.words[key]
        size = len(key) - len(entry) + 1
        found = 0.0
        if self.content[key] <= shared and len(words) <= 2 * len(entry) + 2:
            pairs = sorted(((sim[e], i, j) for i, sim in enumerate(sims) for j, e in enumerate(entry) if e in sim), key=lambda p: (-p[0], abs(p[1] - p[2])))
            mine: set[int] = set()
            theirs: set[int] = set()
            got = 0.0
            for s, i, j in pairs:
                if i not in mine and j not in theirs:
                    mine.add(i)
                    theirs.add(j)
                    got += s * len(entry[j])
            if not any(i not in mine and len(w) > 3 for i, w in enumerate(words)) and not any(j not in theirs and len(e) > 3 for j, e in enumerate(entry)):
                found = got / (size + sum(len(w) for i, w in enumerate(words) if i not in mine))
        allowed = max(1, size // 6)
        if found < 1 - 1 / size and abs(len(packed) - size) <= allowed and (run_together or 2 * sum(map(len, shared)) >= size - 6):
            d = distance(packed, key.replace(" ", ""), allowed)
            if d <= allowed:
                found = max(found, 1 - d / size)
        return found


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda x: " ".join(words_of(x)))


def entries(items: DataFrame, aliases: DataFrame, size: int) -> Iterator[list[tuple[str, str]]]:
    """(item_id, caption) of the list, names of items and their aliases, in parts of about ``size``; equal names are in one part."""
    both = items.select("item_id", F.regexp_replace("item_id", "_", " ").alias("alias")).unionByName(aliases.select("item_id", "alias")).where("item_id IS NOT NULL AND alias IS NOT NULL").distinct()
    parts = -(-both.count() // size) or 1
    if parts > 1:
        both = cut(both.withColumn("part", F.pmod(F.xxhash64(_folded("alias")), F.lit(parts))))
    for k in range(parts):
        yield sorted((r[0], r[1]) for r in (both if parts == 1 else both.where(F.col("part") == k)).collect())


def _mappers(known: list[tuple[str, str]]) -> tuple[Mapper, Mapper, frozenset[str]]:
    """The mapper of labels, that of typed ids, and the ids of a part of the list."""
    own = [(i, a) for i, a in known if a == i.replace("_", " ")]
    return Mapper(known), Mapper(own), frozenset(i for i, _ in own)


MAPPED = "record_id STRING, label STRING, canonical_id STRING, item_id STRING, how STRING, score DOUBLE, typed_item STRING"


def _mapped(b: pa.RecordBatch, found: list[Verdict], meant: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.float64()), pa.array(meant, pa.string())],
        names=["record_id", "label", "canonical_id", "item_id", "how", "score", "typed_item"],
    )


def map_values(records: DataFrame, items: DataFrame, aliases: DataFrame, shard: int = SHARD) -> DataFrame:
    """(record_id, label, canonical_id, item_id, how, score, typed_item) for every record.

    ``records`` is (record_id, label, canonical_id). ``item_id`` is what the label names, and
    ``typed_item`` the item meant by the typed id beside it. Nothing is shuffled; a label that is
    repeated costs one dictionary look-up.
    """
    parts = list(entries(items, aliases, shard))
    slim = records.select("record_id", "label", "canonical_id")
    if len(parts) == 1:
        return slim.mapInArrow(_in_one_pass(parts[0]), MAPPED)
    out = slim.withColumn("evidence", F.lit(None).cast("string"))
    for known in parts:
        out = out.mapInArrow(_gathering(known), "record_id STRING, label STRING, canonical_id STRING, evidence STRING")
    return out.mapInArrow(_settling, MAPPED)


def _in_one_pass(known: list[tuple[str, str]]):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, typed, listed = _mappers(known)
        for b in batches:
            yield _mapped(b, [labels(x) for x in b.column(1).to_pylist()], [x if x in listed else typed(x)[0] for x in b.column(2).to_pylist()])

    return rows


def _gathering(known: list[tuple[str, str]]):  # noqa: ANN202
    """One part of the list: what it adds to the mentions and similarities of each record, kept as JSON."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, typed, listed = _mappers(known)

        def more(label: str | None, ident: str | None, held: str | None) -> str:
            e = json.loads(held) if held else {"l": [[], {}], "t": [[], {}], "id": None}
            for key, mapper, value in (("l", labels, label), ("t", typed, ident)):
                words = words_of(value)
                e[key][0] += mapper.mentions(words)
                for item, score in mapper.similar(words).items():
                    e[key][1][item] = max(score, e[key][1].get(item, 0.0))
            e["id"] = ident if ident in listed else e["id"]
            return json.dumps(e)

        for b in batches:
            held = [more(*x) for x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(held, pa.string())], names=["record_id", "label", "canonical_id", "evidence"])

    return rows


def _settling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The verdict of each record from all that the parts of the list gathered."""

    def verdict(value: str | None, hits: list, best: dict[str, float]) -> Verdict:
        found = by_mention(words_of(value), map(tuple, hits)) if value else NONE
        return by_similarity(best) if found is None else found

    for b in batches:
        labels, typed, held = (b.column(k).to_pylist() for k in (1, 2, 3))
        all_ = [json.loads(x) for x in held]
        yield _mapped(b, [verdict(x, *e["l"]) for x, e in zip(labels, all_, strict=True)], [e["id"] or verdict(x, *e["t"])[0] for x, e in zip(typed, all_, strict=True)])


def found_items(mapped: DataFrame, items: DataFrame) -> DataFrame:
    """(record_id, item_id): records whose label names an item and whose typed id is not exactly a listed one."""
    ids = items.select(F.col("item_id").alias("canonical_id")).where("canonical_id IS NOT NULL").distinct()
    open_ = mapped.where("item_id IS NOT NULL").join(ids, "canonical_id", "left_anti")
    return open_.select("record_id", "item_id").distinct()


def unmatched(mapped: DataFrame) -> DataFrame:
    """(label, canonical_id, records): values that name no item, with the number of records."""
    none = mapped.where("item_id IS NULL").select("record_id", "label", "canonical_id").dropDuplicates(["record_id"])
    return none.groupBy("label", "canonical_id").agg(F.count(F.lit(1)).alias("records"))
