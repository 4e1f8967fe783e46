"""Chat formatting by tokens: segments are encoded one by one, reserved ids are spliced in, and the loss mask is a prefix sum.

A turn becomes `<|im_start|>` role newline text `<|im_end|>` newline, where the two marks are reserved ids beyond the
vocabulary, which no text can produce. So that the rendered text is safe too, `<|` inside a text is written `<\\|`
(and `<\\|` as `<\\\\|`, and so on), which is undone when the output is read back. Roles are escaped in the same
way, and their newlines as well.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Conversations are ordered by these; rows that agree in all of them are alike.
ORDER = ["conv_id", "turn", "role", "text"]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


@functools.cache
def encoding(path: str, pattern: str):
    """A tiktoken vocabulary, and the ids of START and END behind it. Loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    own = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return own, max(ranks.values()) + 2, max(ranks.values()) + 3


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _, _ = encoding(path, pattern)
        heads: dict[str, list[int]] = {}
        for batch in batches:
            roles, texts = (batch.column(c).to_pylist() for c in ("role", "text"))
            for role in {*roles} - heads.keys():
                heads[role] = enc.encode_ordinary(escape_role(role))
            body = [enc.encode_ordinary(escape(t)) for t in texts]
            yield pa.record_batch(
                [*(batch.column(c) for c in ORDER), pa.array([heads[r] for r in roles], pa.list_(pa.int32())), pa.array(body, pa.list_(pa.int32()))],
                names=[*ORDER, "head_ids", "text_ids"],
            )

    return run


def _splice(path: str, pattern: str, learn: str):
    """Turns in order become ids, mask and the place of their first token in the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start, end = encoding(path, pattern)
        newline = enc.encode_ordinary("\n")
        conv, turn_no, at = object(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            head, text = (batch.column(c) for c in ("head_ids", "text_ids"))
            n_head, n_text = (np.diff(x.offsets.to_numpy()) for x in (head, text))
            gap = len(newline)
            # pieces of a turn, in order: start, head, newline, text, end, newline
            size = np.stack([np.ones(n, np.int64), n_head, np.full(n, gap), n_text, np.ones(n, np.int64), np.full(n, gap)], 1)
            first = np.concatenate([[0], np.cumsum(size)])
            begin = first[:-1].reshape(n, 6)
            ids, step = np.zeros(first[-1], np.int32), np.zeros(first[-1] + 1, np.int8)
            ids[begin[:, 0]], ids[begin[:, 4]] = start, end
            for j, x in enumerate(newline):
                ids[begin[:, 2] + j] = ids[begin[:, 5] + j] = x
            for k, x, m in ((1, head, n_head), (3, text, n_text)):
                own = np.repeat(begin[:, k] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                ids[own] = x.flatten().to_numpy(zero_copy_only=False)
            loss = np.flatnonzero((np.array(batch.column("role").to_pylist(), object) == learn) & (n_text > 0))
            step[begin[loss, 3]] += 1
            step[begin[loss, 4]] -= 1
            mask = np.cumsum(step[:-1], dtype=np.int8)
            offsets = np.append(begin[:, 0], first[-1]).astype(np.int32)
            length, nos, starts = np.diff(offsets), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, c in enumerate(batch.column("conv_id").to_pylist()):
                if c != conv:
                    conv, turn_no, at = c, 0, 0
                nos[i], starts[i] = turn_no, at
                turn_no, at = turn_no + 1, at + int(length[i])
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (ids, mask)]
            yield pa.record_batch([batch.column("conv_id"), pa.array(nos), pa.array(starts), *lists], names=["conv_id", "turn_no", "start", "ids", "mask"])

    return run


def format_chats(convs: DataFrame, *, path: str, pattern: str, learn: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn_no, start, ids, mask): each turn's tokens, in the order of turns, and where they start.

    A partition holds whole conversations, ordered by conv_id and turn_no; rows stay single turns, so that a long
    conversation is never one value. Turns are dealt to encoders as they are read, before the shuffle by
    conversation. Rows of one turn number come by role and text; repeated rows stay; a null turn comes first, null
    roles and texts are empty, and rows with a null conv_id are one conversation. An empty text has no token under
    the mask. Other columns are ignored; an empty table gives no rows.
    """
    rows = convs.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    kinds = "conv_id long, turn long, role string, text string, head_ids array<int>, text_ids array<int>"
    dealt = rows.mapInArrow(_encode(path, pattern), kinds).repartition("conv_id").sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(_splice(path, pattern, learn), "conv_id long, turn_no long, start long, ids array<int>, mask array<byte>")


def _read_back(path: str, pattern: str):
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start, end = encoding(path, pattern)
        held = None  # conv_id, turns, hash, loss characters, loss hash, characters, tokens

        def done():
            return {k: x.hexdigest() if hasattr(x, "hexdigest") else x for k, x in zip(kinds.names, held, strict=True)}

        for batch in batches:
            out = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask"), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        out.append(done())
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                if ids[0] != start or np.count_nonzero(ids == start) != 1 or np.count_nonzero(ids == end) != 1:
                    raise ValueError(f"not one turn: {conv}")
                stop = int(np.flatnonzero(ids == end)[0])
                inner = enc.decode_bytes(ids[1:stop].tolist()).decode()
                tail = enc.decode_bytes(ids[stop + 1 :].tolist()).decode()
                learnt = unescape(enc.decode_bytes(ids[mask == 1].tolist()).decode())
                role, _, text = inner.partition("\n")
                held[1] += 1
                held[2].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                held[3] += len(learnt)
                held[4].update(learnt.encode())
                held[5] += len(START) + len(inner) + len(END) + len(tail)
                held[6] += len(ids)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if held is not None:
            yield pa.RecordBatch.from_pylist([done()], kinds)

    return run


def read_back(formatted: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """What the tokens say, by conversation. formatted: as format_chats gives it, each conversation in order in one partition."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    return formatted.mapInArrow(_read_back(path, pattern), kinds)
