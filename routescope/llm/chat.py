"""Chat formatting at the level of tokens.

Segments (role, text) are encoded on their own and reserved ids are spliced between them:

    START role-ids newline-ids text-ids END newline-ids

The reserved ids lie above the vocabulary, so no text can encode to them. Where the ids are
written as text, control strings inside contents must not read as marks: a ``<`` followed by
backslashes and a ``|`` gets one backslash more, and one less on the way back.

Every turn becomes a row of its own with its offset in the conversation, a running sum of
lengths in turn order, so a conversation of any length is never held together. The loss
mask of a turn is the running sum of +1 where its learned segment begins and -1 where it
ends. Only the texts of ``LEARNED`` roles are learned.

Null text counts as empty, a null role as an empty one. Rows of equal conv_id and turn go by
role, then text; repeated rows stay repeated. A null conv_id is a conversation as well.
Roles are escaped as texts are, and their line breaks as well, as one ends a role.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer

from routescope.session import ship_package

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = ("assistant",)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def one_line(role: str) -> str:
    """A role without line breaks: they and backslashes are written with a backslash."""
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def as_given(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line)


@dataclass
class Template:
    """A tokenizer's vocabulary with two ids reserved above it."""

    vocabulary_json: str

    def __post_init__(self):
        self.tokenizer = Tokenizer.from_str(self.vocabulary_json)
        self.tokenizer.encode_special_tokens = True
        self.start = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end = self.start + 1
        self.newline = self.encode(["\n"])[0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def turns(self, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each turn."""
        heads, bodies = self.encode([escape(one_line(r)) for r in roles]), self.encode([escape(t) for t in texts])
        out = []
        for role, head, body in zip(roles, heads, bodies):
            segments = [[self.start], head, self.newline, body, [self.end], self.newline]
            bound = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
            steps = np.zeros(bound[-1] + 1, np.int32)
            if role in LEARNED:
                steps[bound[3]] += 1
                steps[bound[4]] -= 1
            out.append((np.array([i for s in segments for i in s], np.int32), np.cumsum(steps[:-1]).astype(np.int8)))
        return out

    def texts(self, ids: np.ndarray) -> list[str]:
        """The ordinary texts between reserved ids, still escaped."""
        cuts = np.flatnonzero(ids >= self.start)
        parts = np.split(ids, cuts)
        parts = [p[1:] if len(p) and p[0] >= self.start else p for p in parts]
        return [self.tokenizer.decode(p.tolist(), skip_special_tokens=False) if len(p) else "" for p in parts]

    def written(self, ids: np.ndarray) -> str:
        """The formatted text: marks in place of reserved ids."""
        texts = self.texts(ids)
        marks = ["" if i < 0 else START if i == self.start else END for i in [-1, *ids[ids >= self.start]]]
        return "".join(m + t for m, t in zip(marks, texts))

    def turn_of(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of one turn, read back from its ids."""
        role, _, text = self.texts(ids)[1].partition("\n")
        return as_given(unescape(role)), unescape(text)


def formatted(conversations: DataFrame, vocabulary_file: str) -> DataFrame:
    """(conv_id, turn, position, offset, ids, mask): a row for each turn of the formatted conversations."""
    with open(vocabulary_file) as f:
        spark = conversations.sparkSession
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary file, of fixed size
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        template = Template(shared.value)
        for batch in batches:
            pairs = template.turns(batch.column("role").to_pylist(), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(i) for i, _ in pairs], pa.int64()),
                 pa.array([i for i, _ in pairs], pa.list_(pa.int32())), pa.array([m for _, m in pairs], pa.list_(pa.int8()))],
                ["conv_id", "turn", "role", "text", "size", "ids", "mask"])

    ship_package(spark)
    tokens = rows.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, size bigint, ids array<int>, mask array<tinyint>")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1))
    return tokens.select("conv_id", "turn", F.row_number().over(order).cast("bigint").alias("position"),
                         F.coalesce(before, F.lit(0)).alias("offset"), "ids", "mask")


def digests(turns: DataFrame, vocabulary_file: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from ids and masks.

    Turns stream by in order, a conversation's digests being fed turn by turn."""
    with open(vocabulary_file) as f:
        shared = turns.sparkSession.sparkContext.broadcast(f.read())

    def read_back(batches):
        template = Template(shared.value)
        for batch in batches:
            out = []
            for ids, mask in zip(batch.column("ids").to_pylist(), batch.column("mask").to_pylist()):
                ids, mask = np.array(ids, np.int32), np.array(mask, bool)
                role, text = template.turn_of(ids)
                loss = unescape(template.tokenizer.decode(ids[mask].tolist(), skip_special_tokens=False)) if mask.any() else ""
                out.append((role, text, loss, len(template.written(ids))))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("position"), *[pa.array(c, pa.string()) for c in cols[:3]], pa.array(cols[3], pa.int64())],
                ["conv_id", "position", "role", "text", "loss", "chars"])

    def digest(batches):
        state = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def ended(s):
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        for batch in batches:
            done = []
            for conv, role, text, loss, chars in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars")]):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(ended(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
            yield _batch(done, names, kinds)
        if state is not None:
            yield _batch([ended(state)], names, kinds)

    ship_package(turns.sparkSession)
    parts = turns.select("conv_id", "position", "ids", "mask").mapInArrow(read_back, "conv_id bigint, position bigint, role string, text string, loss string, chars bigint")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _batch(rows, names, kinds):
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
