"""Conversations as token ids with a loss mask, assembled segment by segment.

    <s>[ROLE] role [/ROLE] text </s> ... one such block per turn

Roles and texts are encoded on their own, each control string is one reserved
id put between them, and the mask is the running sum of +1 where an assistant
text begins and -1 where it ends.  A control string inside a role or text gets
a backslash in front, as does one that has backslashes in front already, so
that unescaping takes exactly one off.  The spaces around a control string
belong to it, so in the written form, too, a real one never follows a
backslash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import bound_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The control strings, and how each is written out.
CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
WRITTEN = {"<s>": "<s>", "[ROLE]": "[ROLE] ", "[/ROLE]": " [/ROLE] ", "</s>": " </s>"}
LEARNED_ROLE = "assistant"
#: The conversation every run adds: content that looks like control strings.
PROBE_ID, PROBE = -1, (("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"))
# How byte-level BPE cuts a text before merging; the rule of the public vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_CONTROLS = "|".join(map(re.escape, CONTROL))
_RAW = re.compile(rf"(\\*)({_CONTROLS})")
_ESCAPED = re.compile(rf"\\(\\*(?:{_CONTROLS}))")


def escape(text: str) -> str:
    return _RAW.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=2)
def load_encoding(vocabulary: str):
    """The byte-level BPE of a file of ranks, with the control strings as
    reserved ids behind it."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    first = max(ranks.values()) + 1
    return tiktoken.Encoding(PurePath(vocabulary).stem, pat_str=SPLIT, mergeable_ranks=ranks,
                             special_tokens={c: first + i for i, c in enumerate(CONTROL)})


def assemble(turns, encoding) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of (role, text) turns."""
    reserved = encoding._special_tokens
    parts, lengths, learned = [], [], []

    def add(ids, learn=False):
        parts.append(ids)
        lengths.append(len(ids))
        learned.append(learn)

    for role, text in turns:
        add([reserved["<s>"], reserved["[ROLE]"]])
        add(encoding.encode_ordinary(escape(role)))
        add([reserved["[/ROLE]"]])
        add(encoding.encode_ordinary(escape(text)), role == LEARNED_ROLE)
        add([reserved["</s>"]])
    ids = np.array([i for part in parts for i in part], np.int64)
    lengths, learned = np.array(lengths, np.int64), np.array(learned, bool)
    ends = np.cumsum(lengths)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, (ends - lengths)[learned], 1)
    np.add.at(change, ends[learned], -1)
    return ids, np.cumsum(change)[:-1].astype(bool)


def read_back(ids: np.ndarray, encoding) -> list[tuple[str, str]]:
    """The (role, text) turns in ids."""
    reserved = encoding._special_tokens
    turns, start, role = [], 0, ""
    for at in np.flatnonzero(ids >= min(reserved.values())):
        mark, part = ids[at], ids[start:at]
        if mark == reserved["[/ROLE]"]:
            role = unescape(encoding.decode(part.tolist()))
        elif mark == reserved["</s>"]:
            turns.append((role, unescape(encoding.decode(part.tolist()))))
        start = at + 1
    return turns


def learned_texts(ids: np.ndarray, mask: np.ndarray, encoding) -> list[str]:
    """The texts under the mask, each run of masked ids on its own."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [unescape(encoding.decode(ids[a:b].tolist())) for a, b in zip(edges[::2], edges[1::2])]


def written(ids: np.ndarray, encoding) -> str:
    """The ids as one string, control strings included."""
    reserved = {i: WRITTEN[c] for c, i in encoding._special_tokens.items() if c in WRITTEN}
    out, start = [], 0
    for at in np.flatnonzero(ids >= min(encoding._special_tokens.values())):
        out += [encoding.decode(ids[start:at].tolist()), reserved[int(ids[at])]]
        start = at + 1
    return "".join(out)


def format_conversations(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``turns``: (conv_id, turn, role, text).  One row per conversation:
    conv_id, ids, mask (arrays), formatted (string).

    Turns go by number, then role, then text; turns without a number come
    first.  A null role or text is an empty one, rows without a conversation id
    are one conversation without an id, repeated rows are repeated turns.  One
    conversation is one row of the result, and so one group.
    """
    bound_batches(turns.sparkSession)
    grouped = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).alias("one")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")) \
        .select("conv_id", "turns.role", "turns.text")

    def run(batches):
        encoding = load_encoding(vocabulary)
        for batch in batches:
            rows = [assemble(list(zip(r, t)), encoding) for r, t in
                    zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("conv_id"), pa.array([i for i, _ in rows], pa.list_(pa.int64())),
                pa.array([m for _, m in rows], pa.list_(pa.bool_())),
                pa.array([written(i, encoding) for i, _ in rows], pa.string())],
                ["conv_id", "ids", "mask", "formatted"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(
        run, f"conv_id {kind}, ids array<bigint>, mask array<boolean>, formatted string")


def digest_formatted(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What can be read back from the ids and mask of each conversation."""
    def run(batches):
        encoding = load_encoding(vocabulary)
        for batch in batches:
            out = []
            for ids, mask, text in zip(*(batch.column(c) for c in ("ids", "mask", "formatted"))):
                ids, mask = np.array(ids.as_py(), np.int64), np.array(mask.as_py(), bool)
                turns = read_back(ids, encoding)
                learned = "".join(learned_texts(ids, mask, encoding))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned),
                            hashlib.sha256(learned.encode()).hexdigest(), len(text.as_py()),
                            len(ids), int(mask.sum())))
            number, name = pa.int64(), pa.string()
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(
                    columns, (number, name, number, name, number, number, number)))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                 "formatted_chars", "n_tokens", "loss_tokens"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint,"
        " loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and the turns of ``PROBE``."""
    spark = conversations.sparkSession
    turns = conversations.select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, i, *turn) for i, turn in enumerate(PROBE)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return turns.unionByName(probe)
