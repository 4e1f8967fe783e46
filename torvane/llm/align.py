"""Alignment of two tokenizers: tokens of one text by both, cut into groups where both end, and links between tokens whose bytes overlap.

Python tokenises, and writes the digests of groups. Groups and links are made of arrays by Spark's own functions: the ends that only one of both arrays has
are their differences; arrays that say for each byte which token holds it turn places into tokens in one step, so all work grows with the text's length.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torvane.llm.shared import cut, release

#: Pairs of ids whose counts are broadcast, at most: the most frequent ones; the counts of the others are joined.
FREQUENT = 1 << 18

#: Bytes of what goes to a Python worker at once.
BATCH = 4 << 20


def byte_decoder() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def byte_level(path: str, pattern: str):
    """(encode, bytes by id) of a byte-level BPE vocabulary in a tokenizers file. The merges run in tiktoken: in such vocabularies ids are ranks of merges, so both give the same ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    letters = byte_decoder()
    vocab = {bytes(letters[c] for c in token): i for token, i in own["model"]["vocab"].items()}
    for extra in own["added_tokens"]:
        vocab.pop(extra["content"].encode(), None)
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = token
    return coder.encode_ordinary, table


@functools.cache
def pieces(path: str):
    """(encode, bytes by id) of a sentencepiece model: U+2581 is a blank, <0xHH> a byte; control ids have none."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else piece.replace("▁", " ").encode())
    return sp.encode, table


COLUMNS = ["a", "a_ends", "a_at", "a_keys", "b", "b_ends", "b_at", "b_keys"]


def _tokens(path_a: str, pattern: str, path_b: str, stride: int, bits: int):
    items = [pa.list_(pa.field("element", t, nullable=False)) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, table_a), (encode_b, table_b) = byte_level(path_a, pattern), pieces(path_b)
        size_a, size_b = (np.fromiter(map(len, t), np.int32) for t in (table_a, table_b))
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                lists = []
                for text in batch.column("text").to_pylist():
                    a, b = (encode_a(f" {text}"), encode_b(text)) if text else ([], [])  # one text a call: the piece model takes a third more time for lists of texts
                    same = text and b"".join([table_a[i] for i in a]) == f" {text}".encode() == b"".join([table_b[i] for i in b])
                    lists.append((a, b) if same else ([], []))
                out = [batch.column("doc_id")]
                for side, sizes, times in ((0, size_a, stride), (1, size_b, 1)):
                    ids = np.fromiter(itertools.chain.from_iterable(x[side] for x in lists), np.int32)
                    counts = [len(x[side]) for x in lists]
                    offsets, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(sizes[ids], dtype=np.int64)]
                    ends = (total[1:] - np.repeat(total[offsets[:-1]], counts)).astype(np.int32)
                    places = np.arange(len(ids)) - np.repeat(offsets[:-1], counts)
                    at, keys = np.repeat(places.astype(np.int32), sizes[ids]), (places << bits) + ids.astype(np.int64) * times
                    found = zip((offsets, offsets, total[offsets], offsets), (ids, ends, at, keys), items, strict=True)
                    out += [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v), type=t) for o, v, t in found]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", *COLUMNS])

    return run


def _bits(stride: int, ids_a: int) -> int:
    return max(1, stride * ids_a - 1).bit_length()


def tokenized(docs: DataFrame, *, path_a: str, pattern: str, path_b: str, stride: int = 1 << 15, ids_a: int = 1 << 16) -> DataFrame:
    """Rows (doc_id, a, a_ends, a_at, a_keys, b, b_ends, b_at, b_keys) of the documents (doc_id, text): the ids of a blank and the text by a byte-level vocabulary, and of the text by a piece
    model (which puts the blank itself), behind how many bytes each token ends, for each byte the place of the token that holds it, and keys that sort tokens by place: below the place they
    have the id, a's times stride, in as many bits as stride times ids_a takes. Names of special tokens in a text are text.

    Null and empty texts, and those that the joined bytes of either side's tokens don't give back, have no tokens. Repeated
    rows stay; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fields = [T.StructField(c, T.ArrayType(T.LongType() if c.endswith("keys") else T.IntegerType(), False), False) for c in COLUMNS]
    return rows.mapInArrow(_tokens(path_a, pattern, path_b, stride, _bits(stride, ids_a)), T.StructType([T.StructField("doc_id", T.LongType()), *fields]))


def links(tokens: DataFrame, stride: int, ids_a: int) -> DataFrame:
    """tokens with open_a and open_b (places of tokens that end where none of the other side does: a group ends with every other token), and pairs: a's id times stride and b's id for each two
    tokens that overlap, by place.

    Most tokens of one side end where one of the other does, so lambdas see only those that don't: such a token is a link more, with the token that holds the next byte on the other side, whose
    key is sorted in once more. Keys are sorted in a select of their own and read twice after it, else Spark would put that into the next function with a lambda, where all is interpreted.
    """
    bits = _bits(stride, ids_a)
    apart = tokens.select("*", F.array_except("a_ends", "b_ends").alias("only_a"), F.array_except("b_ends", "a_ends").alias("only_b"))
    ending = lambda ends, of: F.transform(ends, lambda e: F.get(of, e - 1))
    inside = lambda ends, of, keys: F.transform(ends, lambda e: F.coalesce(F.get(keys, F.get(of, e)), F.lit(0)))
    placed = apart.select(
        *tokens.columns, ending("only_a", "a_at").alias("open_a"), ending("only_b", "b_at").alias("open_b"),
        inside("only_b", "a_at", "a_keys").alias("more_a"), inside("only_a", "b_at", "b_keys").alias("more_b"),
    )
    columns = [*tokens.columns, "open_a", "open_b"]
    linked = placed.select(*columns, F.sort_array(F.concat("a_keys", "more_a")).alias("linked_a"), F.sort_array(F.concat("b_keys", "more_b")).alias("linked_b"))
    pairs = F.zip_with("linked_a", "linked_b", lambda a, b: (a + b).bitwiseAND(F.lit(2**bits - 1).cast("long")))
    pairs = F.when(F.size("linked_a") == F.size("linked_b"), pairs)  # always
    return linked.select(*columns, pairs.cast("array<int>" if bits < 32 else "array<bigint>").alias("pairs"))


@functools.cache
def _names(ids_a: int, ids_b: int) -> np.ndarray:
    """What a token is in the text of groups: at twice its id (b's behind all of a's) as the last one of its side of a group, one further on as another one."""
    return np.array([f"{i}{mark}".encode() for n, last in ((ids_a, "|"), (ids_b, ";")) for i in range(n) for mark in (last, ",")])


def _digests(ids_a: int, ids_b: int):
    def side(batch: pa.RecordBatch, name: str):
        """The ids of all rows, whether each leaves its group open, the group of each (counted over all rows), and where rows begin."""
        ids, opened = batch.column(name), batch.column(f"open_{name}")
        starts = np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]
        more = np.zeros(starts[-1], bool)
        more[opened.flatten().to_numpy(zero_copy_only=False) + np.repeat(starts[:-1], opened.value_lengths().to_numpy(zero_copy_only=False))] = True
        return ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), more, np.cumsum(~more) - ~more, starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(ids_a, ids_b)
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                (a, more_a, group_a, starts_a), (b, more_b, group_b, starts_b) = side(batch, "a"), side(batch, "b")
                n = int(group_a[-1]) + 1 if len(a) else 0
                before_b = np.r_[0, np.cumsum(np.bincount(group_b, minlength=n))]  # b's tokens of the groups before each one
                up_to_a = np.cumsum(np.bincount(group_a, minlength=n))  # a's tokens up to each group's end
                order = np.empty(len(a) + len(b), np.int64)
                order[np.arange(len(a)) + before_b[group_a]] = 2 * a + more_a
                order[np.arange(len(b)) + up_to_a[group_b]] = 2 * (b + ids_a) + more_b
                starts = starts_a + starts_b
                texts = [names[order[i:j]].tobytes().translate(None, b"\0")[:-1] for i, j in itertools.pairwise(starts.tolist())]
                found = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())
                yield batch.select([c for c in batch.schema.names if c not in ("a", "b", "open_a", "open_b")]).append_column("groups_sha256", found)

    return run


def digests(groups: DataFrame, ids_a: int, ids_b: int) -> DataFrame:
    """Rows with groups_sha256 in place of (a, b, open_a, open_b) as links() gives them: the digest of the groups' text, in which ids of either side are joined by commas, sides by |, groups by ;.
    Empty without tokens. Other columns stay."""
    kept = [f for f in groups.schema.fields if f.name not in ("a", "b", "open_a", "open_b")]
    return groups.mapInArrow(_digests(ids_a, ids_b), T.StructType([*kept, T.StructField("groups_sha256", T.StringType())]))


def aligned(docs: DataFrame, *, path_a: str, pattern: str, path_b: str, stride: int = 1 << 15, ids_a: int = 1 << 16, frequent: int = FREQUENT) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each document of tokenized(): counts of tokens, groups and links; links
    whose pair of ids is the most frequent one of its a id; the sum of all links' counts; and the digest of digests().

    The count of a pair is the number of documents that hold it, over all of docs. stride is more than any id of b, ids_a more than any of a. Rows count as documents, repeated ones too.
    """
    made = links(tokenized(docs, path_a=path_a, pattern=pattern, path_b=path_b, stride=stride, ids_a=ids_a), stride, ids_a)
    sizes = (n.cast("long").alias(c) for n, c in ((F.size("a"), "n_a"), (F.size("b"), "n_b"), (F.size("a") - F.size("open_a"), "n_groups"), (F.size("pairs"), "n_links")))
    own = digests(made.select("doc_id", *sizes, "pairs", "a", "b", "open_a", "open_b"), ids_a, stride).withColumn("row", F.monotonically_increasing_id())
    conf, most = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = conf.get(most)
    conf.set(most, BATCH)  # two Python workers a task hold a batch each
    try:
        own = cut(own)
    finally:
        conf.set(most, usual)
    counts = cut(own.select(F.explode(F.array_distinct("pairs")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    by_a = counts.select((F.col("pair") / stride).cast("int").alias("a"), "n").groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of one vocabulary
    counts = counts.join(F.broadcast(by_a), (F.col("pair") / stride).cast("int") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    # the most frequent pairs are broadcast, as many powers of two of their counts as fit
    sizes = {r["log"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("log")).agg(F.count("*").alias("pairs")).collect()}
    log, held = 64, 0
    while log > 0 and held + sizes.get(log - 1, 0) <= frequent:
        log -= 1
        held += sizes.get(log, 0)
    often = counts.filter(F.col("n") >= 2**log)
    every = own.select("row", F.explode("pairs").alias("pair"))
    sums = [F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")]
    known = every.join(F.broadcast(often), "pair").groupBy("row").agg(*sums)
    if any(k < log for k in sizes):
        rare = counts.filter(F.col("n") < 2**log)
        known = known.unionByName(every.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums))
    known = known.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.drop("pairs").join(known, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
