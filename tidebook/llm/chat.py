"""Chat formatting by token-level assembly.

Every segment (a role, a text) is encoded by itself, and reserved ids above the vocabulary are spliced between: begin, role end, turn end. No text
can produce them. The rendered form writes them as HEADER, line end and turn mark; there a text's own control strings are escaped with one more
backslash than they have before them, and unescaping takes one away. The loss mask is built from the segments' lengths: +1 where an assistant's text
begins, -1 where it ends, and a prefix sum over the turn.

Rows go to their conversation's place by (conv_id, turn), ties by role and text; within a partition they stream, so no conversation is
held whole. Null text, role: empty. Null conv_id: a conversation of its own. Null turn: first. Empty tables give no turns. Columns other
than conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.tokens import default_path, encoding

#: What the template writes. A header is "### Role:" on a line of its own; a turn ends with TURN_END on one of its own.
TURN_END = "</turn>"
CONTROL = r"(?:### [^\n:]*:|</turn>|<\|[a-z_]+\|>)"
BEGIN, ROLE_END, END = range(3)  # reserved ids, counted from the vocabulary's size
TRAINED_ROLE = "assistant"

FORMATTED = "conv_id long, turn long, ids binary, loss_mask binary, n_ids long, start long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """One more backslash before every control string."""
    return re.sub(r"\\*" + CONTROL, r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\*" + CONTROL + ")", r"\1", text)


def encoded(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Each row's segments as ids, before any shuffle: conv_id, turn, role_ids, text_ids, trained."""
    path = tokenizer or default_path()
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role_ids", pa.binary()), ("text_ids", pa.binary()), ("trained", pa.bool_())])

    def encode(batches):
        enc = encoding(path)
        raw = lambda s: np.array(enc.encode_ordinary(s), "<u4").tobytes()
        for b in batches:
            role, text = ([x or "" for x in b.column(k).to_pylist()] for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(raw, role), pa.binary()), pa.array((raw(escape(t)) for t in text), pa.binary()), pa.array([r == TRAINED_ROLE for r in role])], schema=schema)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(encode, "conv_id long, turn long, role_ids binary, text_ids binary, trained boolean")


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_ids", "text_ids")


def assemble(rows, base: int):
    """rows: (conv_id, turn, role ids, text ids, trained) in order. Yields each turn's (conv_id, turn, ids, mask, start in the conversation)."""
    for conv, turns in itertools.groupby(rows, key=lambda r: r[0]):
        start = 0
        for _, turn, role, text, trained in turns:
            role, text = np.frombuffer(role, "<u4"), np.frombuffer(text, "<u4")
            ids = np.concatenate([[base + BEGIN], role, [base + ROLE_END], text, [base + END]]).astype("<u4")
            edge = np.zeros(len(ids) + 1, np.int8)
            if trained:
                edge[2 + len(role)] += 1
                edge[2 + len(role) + len(text)] -= 1
            yield conv, turn, ids, np.cumsum(edge[:-1], dtype=np.int8).astype(np.uint8), start
            start += len(ids)


def _rows(batches):
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(5)))


def formatted(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row for each turn, in order within its conversation: ids (unsigned, little-endian), loss_mask (a byte each), n_ids, start."""
    path = tokenizer or default_path()

    def build(batches):
        base = encoding(path).n_vocab
        done = assemble(_rows(batches), base)
        while part := list(itertools.islice(done, 2000)):
            conv, turn, ids, mask, start = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in mask], pa.binary()), pa.array(map(len, ids), pa.int64()), pa.array(start, pa.int64())], names=["conv_id", "turn", "ids", "loss_mask", "n_ids", "start"])

    return in_order(encoded(conversations, path)).mapInArrow(build, FORMATTED)


def render(ids: np.ndarray, enc) -> str:
    """The ids of one turn as written text."""
    base = enc.n_vocab
    cut = np.flatnonzero(ids >= base)
    role, text = (enc.decode(ids[a + 1 : b].tolist()) for a, b in itertools.pairwise(cut))
    return f"### {role[:1].upper()}{role[1:]}:\n{text}\n{TURN_END}\n"


def read_back(formatted_turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """DIGEST: from the formatted turns alone, one row for each conversation. formatted_turns: as formatted() gives them (a conversation's turns adjacent and in order)."""
    path = tokenizer or default_path()

    def turns(batches):
        for b in batches:
            yield from zip(b.column("conv_id").to_pylist(), b.column("ids").to_pylist(), b.column("loss_mask").to_pylist())

    def digest(batches):
        enc = encoding(path)
        base = enc.n_vocab
        out: list[tuple] = []
        for conv, own in itertools.groupby(turns(batches), key=lambda r: r[0]):
            n, loss_chars, chars, said, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for _, ids, mask in own:
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
                cut = np.flatnonzero(ids >= base)
                role, text = (enc.decode(ids[a + 1 : b].tolist()) for a, b in itertools.pairwise(cut))
                said.update(f"{role}\n{unescape(text)}\n".encode())
                n, chars = n + 1, chars + len(render(ids, enc))
                if mask.any():
                    trained = unescape(enc.decode(ids[mask == 1].tolist()))
                    loss.update(trained.encode())
                    loss_chars += len(trained)
            out.append((conv, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 4) else pa.int64()) for k, c in enumerate(zip(*out))], names=[x.split()[0] for x in DIGEST.split(", ")])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 4) else pa.int64()) for k, c in enumerate(zip(*out))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return formatted_turns.mapInArrow(digest, DIGEST)
