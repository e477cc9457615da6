"""Subject areas of documents by a seeded non-negative factorisation of the document-term matrix.

Rows are documents and columns are words. Every sentence brings one unit, which its words share, so
that the mixture of a document counts its sentences. One component is anchored to each subject: its
words start from hand-labelled documents (and the glosses), and words that all subjects share are held
out of every subject; one more component is the ground. Alternating multiplicative updates run over
all documents until the components stand still: the mixture of each document is updated on the spot
against the word weights, which are sent to all workers, and the weights are updated from sums over
the whole corpus. The mixture then gives the subjects directly: rounded, it is the number of sentences
about each, and a subject counts for a document if at least a fifth of its sentences are about it.

The texts are read twice: once for the vocabulary and the sums over labelled documents, once for the
matrix.

What is bounded: the labelled rows used as seed (``MOST_LABELLED`` documents, by hash; a documented
sample), and the vocabulary (words in at least one document in ``RARITY``: at most RARITY times the
mean number of words of a document, however large the corpus). The bar is a share, so that a corpus
that grows alike keeps its words. All else covers all documents.

Defined results: null, empty and blank texts have no subject; a ``doc_id`` that is delivered again
comes out once, though statistics count each delivery; a label that is not a listed subject counts as
"none"; no subjects or no documents give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.textnorm import folds
from tallyspark.session import bounded, cut

MOST_LABELLED = 10_000
MOST_SUBJECTS = 1000
RARITY = 2000
#: A word that labelled documents tell so often of is a word of the subjects.
ANCHORED = 2
REMEMBERED = 500_000
#: Sums that a task holds before it passes them on.
FLUSH = 200_000
#: A document is about a subject if at least this share of its sentences is.
SHARE = 0.2
#: Words spread over the equivalent of so many subjects belong to none.
FRAME = 3.0
#: Rounds end when no component's weights move by more than this (of 2 at most), or after ``MOST_ROUNDS``.
STILL = 0.2
MOST_ROUNDS = 8
#: Updates of the mixtures within a round, and when they are read.
INNER, LAST = 8, 12

_WORD = re.compile(r"[^\W_]{2,}")
_TOKEN = re.compile(r"[^\W_]{2,}|[.!?؟。](?=\s)|[\n\r]")
_ARTICLE = re.compile(r"^(?:وال|بال|كال|فال|ال|لل)(?=..)")


def plain_word(token: str) -> str | None:
    """A token as a word: letters only, Arabic without its article; None for anything else."""
    if not token.isalpha():
        return None
    return _ARTICLE.sub("", token) if "؀" <= token[0] <= "ۿ" else token


def words_of(text: str | None) -> set[str]:
    """The different words of a text."""
    return {w for t in set(_WORD.findall(text.translate(folds()))) if (w := plain_word(t))} if text else set()


class SentenceReader:
    """Reads a text into sentences of word numbers; what each token stands for is remembered."""

    END, OTHER, UNKNOWN = -3, -2, -1

    def __init__(self, number: dict[str, int]):
        self.number = number
        self.met: dict[str, int] = {}

    def _code(self, token: str) -> int:
        if not (token[0].isalnum()):
            code = self.END
        elif (word := plain_word(token)) is None:
            code = self.OTHER
        else:
            code = self.number.get(word, self.UNKNOWN)
        if len(self.met) >= REMEMBERED:
            self.met.clear()
        self.met[token] = code
        return code

    def __call__(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """(sentences, word numbers, the sentence of each): a word once a sentence; lines of fewer than three words are none."""
        words, places, n = [], [], 0
        here: dict[int, None] = {}
        count = 0
        met = self.met
        for token in [*_TOKEN.findall(text.translate(folds())), "."] if text else ():
            code = met.get(token)
            if code is None:
                code = self._code(token)
            if code >= 0:
                here[code] = None
                count += 1
            elif code == -1:
                count += 1
            elif code == -3 and count:
                if count >= 3:
                    words.extend(here)
                    places.extend([n] * len(here))
                    n += 1
                here = {}
                count = 0
        return n, words, places


class Rows:
    """Sparse rows of the matrix: document, word and count of each entry."""

    def __init__(self, n: int, doc: np.ndarray, word: np.ndarray, count: np.ndarray):
        self.n, self.doc, self.word, self.count = n, doc, word, count.astype(np.float64)
        self.size = np.bincount(doc, self.count, n) if len(doc) else np.zeros(n)

    @classmethod
    def of(cls, lists: list[list[int]]) -> Rows:
        """Rows from lists of word numbers, a word as often as it counts."""
        counted = [Counter(words) for words in lists]
        doc = np.repeat(np.arange(len(lists)), [len(c) for c in counted])
        return cls(len(lists), doc, np.array([w for c in counted for w in c], np.int64), np.array([x for c in counted for x in c.values()], np.float64))

    @classmethod
    def read(cls, ids: pa.ListArray, counts: pa.ListArray) -> Rows:
        """Rows from two columns of a batch, without a step per row."""
        doc = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(ids)))
        return cls(len(ids), doc, np.asarray(ids.flatten(), np.int64), np.asarray(counts.flatten(), np.float64))

    def parts(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How each entry's count divides over the components."""
        share = w[self.doc] * h[:, self.word].T
        return share * (self.count / np.maximum(share.sum(1), 1e-30))[:, None]

    def mixtures(self, h: np.ndarray, rounds: int) -> np.ndarray:
        """The mixture of each document against fixed word weights; its parts add up to what its words count."""
        w = np.repeat(np.maximum(self.size, 1e-9)[:, None] / h.shape[0], h.shape[0], 1)
        for _ in range(rounds):
            w = self._by_doc(self.parts(w, h))
        return w

    def _by_doc(self, parts: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.doc, parts[:, j], self.n) for j in range(parts.shape[1])], 1)

    def by_word(self, parts: np.ndarray, words: int) -> np.ndarray:
        return np.stack([np.bincount(self.word, parts[:, j], words) for j in range(parts.shape[1])])


def spread_of(counts: np.ndarray) -> np.ndarray:
    """Over how many subjects each word is spread, given its counts by subject: 1 to all of them."""
    rate = counts / np.maximum(counts.sum(1, keepdims=True), 1e-9)
    q = rate / np.maximum(rate.sum(0, keepdims=True), 1e-15)
    return np.exp(-(q * np.log(np.maximum(q, 1e-12))).sum(0))


class Told:
    """What labelled texts tell of each word, in sentences: by subject (whole and single), without a subject, and in all."""

    def __init__(self, subjects: int, words: int):
        self.whole, self.single = np.zeros((subjects, words)), np.zeros((subjects, words))
        self.plain, self.seen = np.zeros(words), np.zeros(words)

    def add(self, words: np.ndarray, counts: np.ndarray, own: set[int]) -> None:
        """One text of the subjects ``own``, which share it evenly."""
        np.add.at(self.seen, words, counts)
        if not own:
            np.add.at(self.plain, words, counts)
        for j in own:
            np.add.at(self.whole[j], words, counts / len(own))
            if len(own) == 1:
                np.add.at(self.single[j], words, counts)


def seed(told_of: Told) -> tuple[np.ndarray, np.ndarray]:
    """(word weights, held out) from labelled texts; the last component is the ground that all share.

    A document of several subjects counts a part for each, and little when it is settled which words
    the subjects share: those are held out of them, and so are words of documents without a subject.
    """
    whole, plain, seen = told_of.whole, told_of.plain, told_of.seen
    told = told_of.single + 0.15 * (whole - told_of.single)
    p = (whole + 1e-3) / (whole + 1e-3).sum(1, keepdims=True)
    q = p / p.sum(0, keepdims=True)
    held = ((spread_of(told) >= FRAME) & (told.sum(0) >= 3)) | ((plain > 0) & ((plain + 1e-3) / (plain + 1e-3).sum() > 0.3 * p.max(0)))
    even = (seen + 0.1) / (seen + 0.1).sum()
    anchored = ~held & (told.sum(0) >= ANCHORED)  # what labels tell of a word, the ground shall not take
    h = np.vstack([np.where(held, 0, p * q**2 + 1e-8 + 1e-4 * even), np.where(held, even, np.where(anchored, 0, 0.1 * even))])
    return h / h.sum(1, keepdims=True), held


def _first_pass(documents: DataFrame, own: dict[int, set[int]], subjects: int) -> tuple[dict[str, int], Told]:
    """(word -> number, what labelled documents tell) in one reading of all texts.

    The vocabulary is the words of at least one document in RARITY. ``own`` has the subjects of at most
    MOST_LABELLED documents. Sums are pre-aggregated by task; what comes back is one row a word of the
    vocabulary and one a word and subject that it is told of, as Arrow columns.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents_of: Counter = Counter()
        told: dict[tuple[int, str], list[float]] = {}
        read = 0

        def tell(j: int, word: str, a: float, b: float) -> None:
            entry = told.setdefault((j, word), [0.0, 0.0])
            entry[0] += a
            entry[1] += b

        def rows() -> pa.RecordBatch:
            keys = [*((-1, w) for w in documents_of), *told]
            parts = [*([float(n), 0.0] for n in documents_of.values()), *told.values()]
            return pa.RecordBatch.from_arrays([pa.array([j for j, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string()), pa.array([x[0] for x in parts], pa.float64()), pa.array([x[1] for x in parts], pa.float64())], names=["of", "word", "a", "b"])

        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                documents_of.update(words)
                read += 1
                mine = own.get(ident)
                if mine is not None and words:
                    known = sorted(words)
                    counts = Counter(SentenceReader({w: k for k, w in enumerate(known)})(text.as_py())[1])
                    for k, n in counts.items():
                        tell(subjects, known[k], n if not mine else 0.0, n)
                        for j in mine:
                            tell(j, known[k], n / len(mine), n if len(mine) == 1 else 0.0)
            if len(documents_of) + len(told) > FLUSH:
                yield rows()
                documents_of.clear()
                told.clear()
        documents_of[""] = read
        yield rows()

    parts = documents.select("doc_id", "text").mapInArrow(sums, "of INT, word STRING, a DOUBLE, b DOUBLE")
    total = cut(parts.groupBy("of", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    read = total.where("of = -1 AND word = ''").agg(F.sum("a")).first()[0] or 0.0
    listed = total.where("of = -1 AND word <> ''").where(F.col("a") >= read / RARITY).select("word")
    words = sorted(listed.toArrow().column(0).to_pylist())
    number = {w: k for k, w in enumerate(words)}
    out = Told(subjects, len(number))
    held = total.where("of >= 0").join(listed, "word", "left_semi").select("of", "word", "a", "b").toArrow()
    at = np.array([number[w] for w in held.column(1).to_pylist()], np.int64)
    of, a, b = (np.asarray(held.column(k)) for k in (0, 2, 3))
    for j in range(subjects):
        here = of == j
        out.whole[j, at[here]], out.single[j, at[here]] = a[here], b[here]
    here = of == subjects
    out.plain[at[here]], out.seen[at[here]] = a[here], b[here]
    return number, out


def unit_rows(read: list[tuple[int, list[int], list[int]]], words: int) -> tuple[pa.ListArray, pa.ListArray]:
    """(word numbers, what each counts) of every text read, when each sentence brings one unit that its words share."""
    lengths = np.array([len(w) for _, w, _ in read], np.int64)
    doc = np.repeat(np.arange(len(read)), lengths)
    word = np.fromiter((x for _, w, _ in read for x in w), np.int64, len(doc))
    before = np.cumsum([0, *(n for n, _, _ in read)])  # sentences of earlier texts
    sentence = np.fromiter((x for _, _, p in read for x in p), np.int64, len(doc)) + before[doc]
    part = 1.0 / np.bincount(sentence)[sentence] if len(doc) else np.zeros(0)
    cell, place = np.unique(doc * words + word, return_inverse=True)
    count = np.bincount(place, part, len(cell)).astype(np.float32)
    ends = pa.array(np.searchsorted(cell, np.arange(len(read) + 1) * words), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(cell % max(words, 1), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(count, pa.float32()))


def subject_mixtures(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, sentences, subject, about, share, weight): every subject with a sentence in a document.

    ``weight`` is the subject's part in the document's mixture, in sentences; ``about`` is that as a
    whole number of the ``sentences``, and ``share`` their part.
    """
    spark = documents.sparkSession
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    names = [r[0] for r in bounded(subjects.select("subject").where("subject IS NOT NULL").distinct().orderBy("subject"), MOST_SUBJECTS, "subjects")]
    glosses = {r[0]: r[1] for r in bounded(subjects.select("subject", "gloss"), MOST_SUBJECTS, "glosses")}
    place = {s: k for k, s in enumerate(names)}
    chosen = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("own")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    own = {r["doc_id"]: {place[s] for s in r["own"] if s in place} for r in chosen.collect()}  # at most MOST_LABELLED rows
    number, told = _first_pass(texts, own, len(names))
    for s, gloss in glosses.items():
        if s in place:
            known = np.array([number[w] for w in words_of(gloss) if w in number], np.int64)
            told.add(known, np.ones(len(known)), {place[s]})
    h, held = seed(told)
    topical = {w: k for w, k in number.items() if not held[k]}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = SentenceReader(topical)
        for b in batches:
            found = [read(x.as_py()) for x in b.column(1)]
            ids, counts = unit_rows(found, len(number))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in found], pa.int32()), ids, counts], names=["doc_id", "sentences", "ids", "counts"])

    matrix = cut(texts.mapInArrow(rows, "doc_id BIGINT, sentences INT, ids ARRAY<INT>, counts ARRAY<FLOAT>").where("size(ids) > 0"))
    for k in range(MOST_ROUNDS):
        before, h = h, _update(matrix, h, hold=k == 0)
        if np.abs(h - before).sum(1).max(initial=0.0) <= STILL:
            break
    last = spark.sparkContext.broadcast(h.astype(np.float32))  # subjects x vocabulary, both bounded

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = last.value.astype(np.float64)
        for b in batches:
            mixed = Rows.read(b.column(2), b.column(3)).mixtures(weights, LAST)[:, : len(names)]
            about = np.floor(mixed + 0.5).astype(np.int64)
            row, subject = np.nonzero(about)
            n, took = np.asarray(b.column(1))[row], about[row, subject]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(n, pa.int32()), pa.array([names[k] for k in subject], pa.string()), pa.array(took, pa.int32()), pa.array(took / n, pa.float64()), pa.array(mixed[row, subject], pa.float64())], names=["doc_id", "sentences", "subject", "about", "share", "weight"])

    found = matrix.mapInArrow(decode, "doc_id BIGINT, sentences INT, subject STRING, about INT, share DOUBLE, weight DOUBLE")
    return found.dropDuplicates(["doc_id", "subject"])


def _update(matrix: DataFrame, h: np.ndarray, hold: bool) -> np.ndarray:
    """One alternating step over all rows: mixtures on the workers, sums of the word weights by word.

    With ``hold``, words that turn out to be spread over the subjects of the corpus (the names of
    issuers, say) are held out of them as well.
    """
    shared = matrix.sparkSession.sparkContext.broadcast(h.astype(np.float32))
    k, words = h.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.astype(np.float64)
        total = np.zeros((k, words))
        for b in batches:
            rows = Rows.read(b.column(0), b.column(1))
            if len(rows.doc):
                total += rows.by_word(rows.parts(rows.mixtures(weights, INNER), weights), words)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(row[at], pa.float64()) for row in total)], names=["word", *(f"p{j}" for j in range(k))])

    parts = matrix.select("ids", "counts").mapInArrow(sums, "word INT" + "".join(f", p{j} DOUBLE" for j in range(k)))
    each = parts.groupBy("word").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(k)]).toArrow()  # one row a word of the vocabulary
    new = np.zeros_like(h)
    at = np.asarray(each.column(0), np.int64)
    for j in range(k):
        new[j, at] = np.asarray(each.column(1 + j))
    new = np.where(h > 0, np.maximum(new, 1e-9), 0)
    if hold and k > 2:
        new[:-1, spread_of(new[:-1]) >= FRAME] = 0
    shared.destroy()
    return new / np.maximum(new.sum(1, keepdims=True), 1e-30)
