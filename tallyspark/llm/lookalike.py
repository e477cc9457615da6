"""Texts that look the same although their characters differ, brought to one form.

The vocabulary is a trie whose edges stand for what a character looks like. A weighted edit automaton
walks it along a text as it is typed: a step to an edge of the same look costs nothing, whatever the
character, width, ligature or kind of space; a character that does not show stays where it is at no cost;
any other change, extra or missing character costs one. A walk that ends on a caption within the allowed
cost selects that caption's spelling; a token that no walk accepts is normalised by the look-alike table
alone.

A vocabulary of any size is walked in shards of ``SHARD`` captions, chosen by hash: every record passes
through all of them and keeps the best hit, without a shuffle.

Defined results: null stays null; an empty or blank text is no caption; a text equal to a caption is
that caption at cost 0; of several captions the cheapest wins, ties by the smaller id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.textnorm import LOOKS, visual

#: Captions that one pass holds.
SHARD = 200_000
CACHE = 200_000


def seen(text: str) -> Iterator[str]:
    """What the characters of a text look like, one plain character at a time; those that do not show are passed over.

    Accents that follow one letter come in canonical order, however they were typed.
    """
    accents: list[tuple[int, str]] = []
    for char in text:
        for c in LOOKS[ord(char)]:
            order = unicodedata.combining(c)
            if order:
                accents.append((order, c))
                continue
            if accents:
                yield from _in_order(accents)
                accents = []
            yield c
    yield from _in_order(accents)


def _in_order(accents: list[tuple[int, str]]) -> list[str]:
    return [c for _, c in (accents if len(accents) == 1 else sorted(accents, key=lambda x: x[0]))]


class Trie:
    """Captions by what their characters look like, walked with a weighted edit automaton."""

    def __init__(self, captions: Iterable[tuple[int, str]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.spelling: dict[int, str] = {}
        for ident, caption in sorted(captions):
            self.spelling[ident] = caption
            node = 0
            for c in seen(caption):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                node = self.next[node][c]
            if self.ends[node] is None and node:
                self.ends[node] = ident

    def walk(self, text: str, most: int = 0) -> tuple[int, int] | None:
        """(id, cost) of the caption that the text spells at a cost of at most ``most``; None if there is none.

        The state is the cheapest cost of each trie node reached.
        """
        state = self._missing({0: 0}, most)
        for c in seen(text):
            state = self._step(state, c, most)
            if not state:
                return None
            state = self._missing(state, most)
        ends = [(cost, self.ends[node]) for node, cost in state.items() if self.ends[node] is not None]
        return (min(ends)[1], min(ends)[0]) if ends else None

    def _step(self, state: dict[int, int], c: str, most: int) -> dict[int, int]:
        """The nodes after one more character: free along the edge of its look; at one along any other, or staying."""
        step: dict[int, int] = {}
        for node, cost in state.items():
            to = self.next[node].get(c)
            if to is not None and cost < step.get(to, most + 1):
                step[to] = cost
            if cost < most:
                for to in (node, *self.next[node].values()):
                    if cost + 1 < step.get(to, most + 1):
                        step[to] = cost + 1
        return step

    def _missing(self, state: dict[int, int], most: int) -> dict[int, int]:
        """Add the nodes reached by captions' characters that the text lacks, at one each."""
        todo = [x for x in state.items() if x[1] < most] if most else []
        while todo:
            node, cost = todo.pop()
            for to in self.next[node].values():
                if cost + 1 < state.get(to, most + 1):
                    state[to] = cost + 1
                    if cost + 1 < most:
                        todo.append((to, cost + 1))
        return state


def _shards(aliases: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The vocabulary in parts of about ``size`` captions, by hash; one part at a time is on the driver."""
    listed = aliases.select("alias_id", "alias").where("alias_id IS NOT NULL AND alias <> ''").distinct()
    parts = -(-listed.count() // size) or 1
    for k in range(parts):
        mine = listed if parts == 1 else listed.where(F.pmod(F.xxhash64("alias_id"), F.lit(parts)) == k)
        yield sorted((r[0], r[1]) for r in mine.collect())


def canonical_form(labels: DataFrame, aliases: DataFrame, most: int = 0, shard: int = SHARD) -> DataFrame:
    """(record_id, label, form, alias_id, cost) for every record of (record_id, label).

    ``form`` compares equal for all texts that look the same: the caption's own spelling, or the
    form token by token. Nothing is shuffled.
    """
    fields = "record_id STRING, label STRING, form STRING, alias_id BIGINT, cost INT"
    out = labels.select("record_id", "label", F.lit(None).cast("string").alias("form"), F.lit(None).cast("bigint").alias("alias_id"), F.lit(None).cast("int").alias("cost"))
    for known in _shards(aliases, shard):
        out = out.mapInArrow(_pass(known, most), fields)
    return out


def _pass(known: list[tuple[int, str]], most: int):  # noqa: ANN202
    """One shard's pass: the hit of each record, if better than the one it has, else the tokens that this shard spells."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(known)
        tokens = Trie(enumerate(sorted({w for _, a in known for w in a.split(" ") if w})))
        hits: dict[str, tuple[int, int] | None] = {}
        spelt: dict[str, str] = {}

        def hit(label: str) -> tuple[int, int] | None:
            if label not in hits:
                if len(hits) >= CACHE:
                    hits.clear()
                hits[label] = trie.walk(label, most)
            return hits[label]

        def token(word: str) -> str:
            if word not in spelt:
                if len(spelt) >= CACHE:
                    spelt.clear()
                found = tokens.walk(word)
                spelt[word] = tokens.spelling[found[0]] if found else word
            return spelt[word]

        def one(label: str | None, form: str | None, ident: int | None, cost: int | None) -> tuple[str | None, int | None, int | None]:
            if label is None:
                return None, None, None
            found = hit(label)
            if found and (ident is None or (found[1], found[0]) < (cost, ident)):
                return trie.spelling[found[0]], *found
            if ident is not None:
                return form, ident, cost
            return " ".join(map(token, (visual(label) if form is None else form).split(" "))), None, None

        for b in batches:
            out = [one(*x) for x in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())], names=["record_id", "label", "form", "alias_id", "cost"])

    return rows


def disguised(forms: DataFrame) -> DataFrame:
    """(record_id, alias_id): records whose label looks the same as the caption but is not equal to it."""
    return forms.where("cost = 0 AND label <> form").select("record_id", "alias_id").distinct()
