"""Evaluation texts inside training texts, by a generalised suffix automaton."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# A word: letters and digits, with unseen characters and combining marks inside it.
_UNSEEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff"
_MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
_WORD = re.compile(rf"[^\W_](?:[{_UNSEEN}{_MARKS}]*[^\W_])*[{_MARKS}]*")
_PLAIN = re.compile(r"[a-z0-9]+")
_DROP = re.compile(f"[{_UNSEEN}]+")
_LETTERS = re.compile(r"[^\W_]+")
_STRAY = re.compile(f"[{_MARKS}]+")


def _folded(word: str) -> list[str]:
    if word.isascii():
        return [word.lower()]
    word = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", _DROP.sub("", word)).casefold())
    return _LETTERS.findall(_STRAY.sub("", word))


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters and digits, in one letter case and form."""
    if text.isascii():
        return _PLAIN.findall(text.lower())
    return [x for w in _WORD.findall(text) for x in _folded(w)]


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """As words_of, with where each word begins and ends in the text."""
    return [(x, m.start(), m.end()) for m in _WORD.finditer(text) for x in _folded(m.group())]


class SuffixAutomaton:
    """All word sequences of several items; each state knows which items hold its sequence of ``span`` words."""

    def __init__(self, items: list[tuple[int, str]], span: int) -> None:
        self.span, self.vocabulary, self.sizes = span, {}, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text or "")]
            self.sizes[item] = len(ids)
            sequences.append((item, ids))
            at = 0
            for c in ids:
                at = self._extend(at, c)
        self.anchor = [self._anchor(v) for v in range(len(self.next))]
        self.items: dict[int, list[int]] = {}
        for item, ids in sequences:
            at = 0
            for c in ids:
                at = self.next[at][c]
                if (u := self.anchor[at]) >= 0 and item not in (found := self.items.setdefault(u, [])):
                    found.append(item)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def _anchor(self, v: int) -> int:
        """The state of the last ``span`` words of v's sequences; -1 if those are shorter."""
        if self.length[v] < self.span:
            return -1
        while self.length[self.link[v]] >= self.span:
            v = self.link[v]
        return v

    def matches(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place of the last word, matching length, state) wherever ``span`` or more words match."""
        out, at, size = [], 0, 0
        moves, link, length, span, known = self.next, self.link, self.length, self.span, self.vocabulary.get
        for i, w in enumerate(words):
            c = known(w)
            if c is None:
                at = size = 0
                continue
            while at and c not in moves[at]:
                at = link[at]
                size = length[at]
            if c in moves[at]:
                at = moves[at][c]
                size += 1
                if size >= span:
                    out.append((i, size, self.anchor[at]))
        return out


_built: dict[tuple[str, int], SuffixAutomaton] = {}


def _automaton(key: str, items: Broadcast, span: int) -> SuffixAutomaton:
    """The automaton of a block of items, built once in a Python worker, which keeps that of one block at a time."""
    if (key, span) not in _built:
        _built.clear()
        _built[key, span] = SuffixAutomaton(items.value, span)
    return _built[key, span]


def _cut_out(text: str, places: list[tuple[str, int, int]], cut: list[int]) -> str:
    """The text without the words at the ascending places ``cut``, and what stands between two of them."""
    pieces, at = [], 0
    for k, j in enumerate(cut):
        if k == 0 or cut[k - 1] != j - 1:
            pieces.append(text[at : places[j][1]])
        at = max(at, places[j][2])
    return "".join([*pieces, text[at:]])


def _blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters, read a row at a time."""
    blocks, size = [[]], 0
    for row in items.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).toLocalIterator():
        if blocks[-1] and size + len(row[1]) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], row[1]))
        size += len(row[1])
    return blocks


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 12, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_words, coverage): documents that hold ``span`` or more consecutive words of an item.

    n_words counts the document's words in such passages of the item; coverage
    is that over the item's words, 1 at most.  The items are a stated test set:
    they are taken in blocks of about ``block_chars`` characters, one automaton
    (some 90 bytes a character, once a Python worker) and one pass over the
    documents a block, so that what is broadcast has a bound.  Null and empty texts match nothing; items shorter than ``span``
    words can't leak; repeated items are reported under each id.
    """
    spark = docs.sparkSession
    found = None
    item_kind = items.schema[item_id].dataType
    item_type = to_arrow_type(item_kind)
    for block in _blocks(items, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, shared, span)
            for batch in batches:
                ids, which, words = [], [], []
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    last: dict[int, int] = {}
                    n: dict[int, int] = {}
                    for i, _, state in automaton.matches(words_of(body)):
                        for item in automaton.items[state]:
                            n[item] = n.get(item, 0) + min(span, i - last.get(item, -span))
                            last[item] = i
                    ids += [doc] * len(n)
                    which += n
                    words += n.values()
                share = [min(1.0, w / automaton.sizes[k]) for w, k in zip(words, which)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(which, item_type), pa.array(words, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "n_words", "coverage"])

        kind = docs.schema[doc_id].dataType.simpleString()
        part = docs.select(doc_id, text).where(F.col(text).isNotNull()).mapInArrow(run, f"doc_id {kind}, item_id {item_kind.simpleString()}, n_words bigint, coverage double")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 12, max_coverage: float = 0.5, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, text, n_removed, kept): the documents without the passages that match ``span`` or more words of an item.

    A document is not kept, and its text is null, if such passages make up more
    than ``max_coverage`` of its words.  n_removed counts the words in such
    passages.  All blocks of items are matched against the original text, then
    it is judged and cut once, so that the result doesn't depend on them.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<int>").alias("cut"))
    blocks = _blocks(items, item_id, item_text, block_chars)
    for b, block in enumerate(blocks, 1):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex, last=b == len(blocks)) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, shared, span)
            for batch in batches:
                bodies, cuts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for k, body in enumerate(bodies):
                    if body and (hits := automaton.matches(words_of(body))):
                        cuts[k] = sorted({j for i, size, _ in hits for j in range(i - size + 1, i + 1)}.union(cuts[k]))
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.list_(pa.int32()))], ["doc_id", "text", "cut"])
                    continue
                kept = [True] * len(bodies)
                for k, cut in enumerate(cuts):
                    if cut:
                        places = word_spans(bodies[k])
                        kept[k] = len(cut) <= max_coverage * len(places)
                        bodies[k] = _cut_out(bodies[k], places, cut) if kept[k] else None
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array([len(c) for c in cuts], pa.int64()), pa.array(kept, pa.bool_())], ["doc_id", "text", "n_removed", "kept"])

        out = out.mapInArrow(run, f"doc_id {kind}, text string, " + ("n_removed bigint, kept boolean" if b == len(blocks) else "cut array<int>"))
    return out
