"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines. The normaliser maps a text to its escaped
form (a space becomes U+2581, one may be put in front). The piece machine has an arc for
every piece, weighted by its negated score, and for every character without a piece an arc
for the bytes of its UTF-8 form. For byte-pair models a third machine accepts exactly the
pairs of neighbours that the model's merges, run on the two alone, leave as they are; a
sequence is the merges' outcome if and only if all its pairs are accepted, because a merge
across a boundary depends on nothing but the two pieces beside it. Composing an input with
them gives a lattice over positions, whose shortest path in the tropical semiring is the
encoding. With unigram models the third machine accepts all, and weights alone decide.

Text falls apart into units at places that no piece spans: at spaces, control characters, and
between the characters that pieces join with letters and those that they never do. A unit's path
is found once per task and kept in a bounded memory, whose older half is given up when it is full. Null text counts as empty and encodes to no ids. The
escape character itself decodes to a space, as in the model's own library. Repeated rows
encode alike. Models with a character map or user-defined pieces are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from routescope.llm.words import slices
from routescope.session import ship_package

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
UNIGRAM, BPE = 1, 2  # model types of the format
KEPT = 300_000  # pairs of pieces remembered by a task, and words and units, of each
INFINITE = float("inf")
SLICE = 1 << 20  # bytes of text that a task encodes before it hands on their ids
LONG_UNIT = 64  # characters; longer ones aren't remembered


def fields(data: bytes):
    """(number, value) of a protocol buffer message, nested messages as bytes."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Transducer:
    kind: int
    pieces: dict[str, int]
    weight: dict[str, float]  # negated scores
    bytes_at: list[int]  # id of each byte, or empty
    unknown: int
    texts: list[bytes]  # what each id decodes to
    prefix: bool
    squeeze: bool
    longest: int = 1
    unseen: float = 0.0  # weight of a character without a piece, above every piece's
    turns: dict = field(default_factory=dict)  # of pieces that the merges make of their own characters
    unit: re.Pattern | None = None
    pairs: dict = field(default_factory=dict)
    paths: dict = field(default_factory=dict)  # ids of units
    words: dict = field(default_factory=dict)  # ids of what follows a space, with it
    older_paths: dict = field(default_factory=dict)
    older_words: dict = field(default_factory=dict)
    by_words: bool = False
    arcs: dict = field(default_factory=dict)  # by its characters in turn, under "" the pieces that begin so, the shortest first
    codes: dict = field(default_factory=dict)  # ids of pieces as 32-bit integers

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((SPACE if self.prefix else "") + text).replace(" ", SPACE)

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The merges' outcome, the best pair first and the leftmost of equals; and of each
        merge in turn its weight and the first and last symbol after it."""
        out, turns = list(text), []
        weight = self.weight
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                w = weight.get(out[i] + out[i + 1])
                if w is not None and (best is None or w < best):
                    best, at = w, i
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
            turns.append((best, out[0], out[-1]))
        return out, turns

    def accepts(self, left: str, right: str) -> bool:
        """Whether the merges of two neighbouring pieces never cross from one into the other.

        Both sides' merges go on in the order of their weights; the pair of symbols at the
        boundary is merged if it weighs less than what is next on the left, and no more than
        what is next on the right."""
        one, two = self.turns.get(left, ()), self.turns.get(right, ())
        edge, lead = left[-1], right[0]
        i = j = 0
        known = True
        weight = self.weight
        while True:
            cross = weight.get(edge + lead)
            w1 = one[i][0] if i < len(one) else INFINITE
            w2 = two[j][0] if j < len(two) else INFINITE
            if cross is not None and cross < w1 and cross <= w2:
                known = False
                break
            if w1 == w2 == INFINITE:
                break
            if w1 <= w2:
                edge = one[i][2]
                i += 1
            else:
                lead = two[j][1]
                j += 1
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known

    def path(self, text: str) -> list[str]:
        """Pieces of the shortest path through the lattice of one unit."""
        return self._accepted(text) if self.kind == BPE else self._cheapest(text)

    def _accepted(self, text: str) -> list[str]:
        """With the acceptor at most one path enters a position, as the pieces before it are
        what the merges make of that prefix. So the composition is searched as it unfolds,
        longer arcs first, and a position left without a way on is not entered again."""
        n, trie, known, accepts = len(text), self.arcs, self.pairs.get, self.accepts
        path: list[str] = []
        ahead: list[list[str]] = []  # arcs not tried yet, of each position on the way
        dead: set[int] = set()
        at = 0
        while at < n:
            node = trie.get(text[at])
            if node is None:
                arcs = [text[at]]
            else:
                for c in text[at + 1 :]:
                    further = node.get(c)
                    if further is None:
                        break
                    node = further
                arcs = [*node[""]]
            while True:
                while arcs:
                    arc = arcs.pop()
                    if dead and at + len(arc) in dead:
                        continue
                    if not path:
                        break
                    fits = known((path[-1], arc))
                    if fits is None:
                        fits = accepts(path[-1], arc)
                    if fits:
                        break
                else:
                    dead.add(at)
                    at -= len(path.pop())
                    arcs = ahead.pop()
                    continue
                break
            path.append(arc)
            ahead.append(arcs)
            at += len(arc)
        return path

    def _cheapest(self, text: str) -> list[str]:
        n = len(text)
        cost = [0.0] + [float("inf")] * n
        last = [""] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                arc = text[begin:end]
                w = self.weight.get(arc, self.unseen if end - begin == 1 else None)
                if w is not None and cost[begin] + w < cost[end]:
                    cost[end], last[end] = cost[begin] + w, arc
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def ids(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is not None:
            return [known]
        return [self.bytes_at[b] for b in piece.encode()] if self.bytes_at else [self.unknown]

    def _coded(self, text: str) -> bytes:
        """The ids of a unit as 32-bit integers."""
        codes = self.codes.get
        return b"".join([codes(p) or np.array(self.ids(p), "<i4").tobytes() for p in self.path(text)])

    def unit_ids(self, text: str) -> bytes:
        """The ids of a unit; units after a space are remembered as words."""
        if len(text) > LONG_UNIT:
            return self._coded(text)
        if text[0] == SPACE:
            return self.words.get(text[1:]) or self._word(text[1:])
        found = self.paths.get(text)
        if found is None:
            found = self.older_paths.get(text) or self._coded(text)
            if len(self.paths) >= KEPT // 2:
                self.paths, self.older_paths = {}, self.paths
            self.paths[text] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self.older_words.get(word) or self._coded(SPACE + word)
        if len(self.words) >= KEPT // 2:
            self.words, self.older_words = {}, self.words
        self.words[word] = found
        return found

    def units_ids(self, text: str) -> bytes:
        return b"".join([self.unit_ids(u) for u in self.unit.findall(text)])

    def encode(self, text: str) -> np.ndarray:
        plain = self.by_words and self.prefix and not ("  " in text or text[:1] in ("", " ") or text[-1] == " " or SPACE in text)
        if not plain:
            return np.frombuffer(self.units_ids(self.normalise(text)), "<i4")
        out = []
        for word in text.split(" "):  # single spaces only: every word is one unit or a few
            out.append(self.words.get(word) or self.units_ids(SPACE + word))
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        texts = self.texts
        out = b"".join([texts[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if self.prefix and out.startswith(" ") else out


def arc_tree(pieces) -> dict:
    """The pieces by their characters in turn; each node has under "" all that begin its text, and its first character."""
    tree: dict = {}
    for piece in sorted(pieces):  # a piece comes after those that it begins with
        node = tree
        for i, c in enumerate(piece):
            node = node.setdefault(c, {"": node[""] if i else (c,)})
        if len(piece) > 1:
            node[""] = (*node[""], piece)
    return tree


def largest_joined(pieces) -> set[str]:
    """The largest set of characters that pieces join with each other, but never with another one; spaces aside."""
    part: dict[str, set[str]] = {}
    for piece in pieces:
        chars = set(piece) - {SPACE}
        if len(chars) > 1:
            whole = chars.union(*[part[c] for c in chars if c in part])
            if any(part.get(c) is None or len(part[c]) < len(whole) for c in chars):
                part.update(dict.fromkeys(whole, whole))
    return max(part.values(), key=len, default=set())


def compiled(model_file: str) -> Transducer:
    """The transducer of a model file, which only the driver reads."""
    with open(model_file, "rb") as f:
        top = list(fields(f.read()))
    trainer = dict(fields(next(v for k, v in top if k == 2)))
    spec = dict(fields(next(v for k, v in top if k == 3)))
    rows = []
    for value in (v for k, v in top if k == 1):
        own = dict(fields(value))
        rows.append((own[1].decode(), float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]), own.get(3, NORMAL)))
    kind = trainer.get(3, UNIGRAM)
    if spec.get(2) or kind not in (UNIGRAM, BPE) or any(t == USER for _, _, t in rows) or not spec.get(5, 1):
        raise ValueError("only byte-pair and unigram models without a character map or user-defined pieces")
    pieces = {p: i for i, (p, _, t) in enumerate(rows) if t == NORMAL}
    weight = {p: -s for p, s, t in rows if t == NORMAL}
    by_byte = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(rows) if t == BYTE}
    texts = [bytes([int(p[1:-1], 16)]) if t == BYTE else p.encode() if t == NORMAL else " ⁇ ".encode() if t == UNKNOWN else b"" for p, _, t in rows]
    unknown = next(i for i, (_, _, t) in enumerate(rows) if t == UNKNOWN)
    out = Transducer(kind, pieces, weight, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], unknown, texts,
                     bool(spec.get(3, 1)), bool(spec.get(4, 1)))
    out.longest = max(map(len, pieces), default=1)
    out.unseen = 10.0 + max(weight.values(), default=0.0)
    if kind == BPE:
        outcomes = {p: out.merged(p) for p in pieces}
        out.turns = {p: turns for p, (left, turns) in outcomes.items() if left == [p]}
        out.arcs = arc_tree(out.turns)
    out.codes = {p: np.array([i], "<i4").tobytes() for p, i in pieces.items()}
    spanned = {c for p in pieces if len(p) > 1 for c in p}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        out.unit = re.compile(".+", re.S)
    else:
        # no piece goes from a character to a space, or over a control character
        out.by_words = True
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in spanned)
        joined = "".join(map(re.escape, sorted(largest_joined(pieces) - set(map(chr, range(32))))))
        rest = f"{SPACE}*[^{SPACE}{alone}{joined}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")
        out.unit = re.compile(f"{SPACE}*[{joined}]+|{rest}" if joined else rest)
    return out


def encode(docs: DataFrame, transducer: Transducer, keep: list[str]) -> DataFrame:
    """``keep`` of every row, with the ``ids`` of its whole text, how many are bytes, and
    whether decoding the ids gives the text back."""
    added = {"ids": "array<int>", "n_bytes": "bigint", "exact": "boolean"}
    schema = docs.select(*keep, *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()]).schema
    # a text that is kept anyway is sent to Python once
    source = "text" if "text" in keep and schema["text"].dataType == StringType() else "__text"
    rows = docs.select(*keep, *([] if source == "text" else [F.coalesce("text", F.lit("")).alias("__text")]))
    shared = docs.sparkSession.sparkContext.broadcast(transducer)  # as large as the model file

    def run(batches):
        t = shared.value
        fallback = np.zeros(len(t.texts), bool)
        fallback[t.bytes_at] = True
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(source))
            kept = [c for c, name in zip(batch.columns, batch.schema.names) if name != "__text"]
            for lo, hi in slices(texts, SLICE):
                strings = [x or "" for x in texts.slice(lo, hi - lo).to_pylist()]
                some = [t.encode(x) for x in strings]
                exact = [t.decode(ids) == x.replace(SPACE, " ") for ids, x in zip(some, strings)]
                at = np.concatenate([[0], np.cumsum([len(i) for i in some])]).astype(np.int32)
                ids = np.concatenate([np.zeros(0, np.int32), *some])
                n_bytes = np.diff(np.concatenate([[0], np.cumsum(fallback[ids])])[at]) if len(ids) else np.zeros(hi - lo, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in kept], pa.ListArray.from_arrays(pa.array(at), pa.array(ids)),
                     pa.array(n_bytes.astype(np.int64)), pa.array(exact)], names=[f.name for f in schema])

    ship_package(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, transducer: Transducer, keep: list[str]) -> DataFrame:
    """``keep`` of every row and the ``text`` of its ``ids``; null ids count as none."""
    schema = rows.select(*keep).schema.add("text", "string")
    shared = rows.sparkSession.sparkContext.broadcast(transducer)

    def run(batches):
        t = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("__ids")
            texts = [t.decode(np.array(ids or [], np.int32)) for ids in batch.column(at).to_pylist()]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[f.name for f in schema])

    ship_package(rows.sparkSession)
    return rows.select(*keep, F.col("ids").alias("__ids")).mapInArrow(run, schema)
