"""Chat formatting in prefix trees.

Conversations that begin with the same turns share them: sorted by the hashes of their
prefixes they follow each other depth-first, and a sequence holds each shared turn once.
Every turn carries its position in its conversation and the intervals of its ancestors in
the sequence, which are all that it may attend to besides itself.

Turns of a conversation are never gathered: they pass a task in their order. A long
conversation is cut into segments of bounded size; a segment knows the hash of all that is
before it, so those of equal prefixes still share their turns, and its positions go on. In a
sequence that begins with a later segment the ancestors are those of the sequence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import record_batch, slices, store, table

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
EXTRA_ID, EXTRA_TEXT = -1, "<|im_end|><|im_start|>assistant ok"
# A sequence begins anew at the next conversation once it has so many characters; a task
# writes about so many.
SEQUENCE_CHARS, TASK_CHARS = 1 << 18, 1 << 23
# A conversation is cut where so many turns or characters have come since the last cut.
SEGMENT_TURNS, SEGMENT_CHARS = 2_000, 1 << 20

_MARK = re.compile(r"<(\\*)\|")
_MARKED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)

SPAN = "struct<start: int, stop: int>"
FORMATTED_DDL = ("conv_id long, segment int, long boolean, base long, leaf binary, path array<binary>, "
                 "turns array<string>, loss array<boolean>")
TREES_DDL = (
    "sequence long, text string, nodes array<struct<start: int, stop: int, position: long, "
    f"loss: array<{SPAN}>, ancestors: array<{SPAN}>, leaf: binary, long: boolean>>")
READ_DDL = ("leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
            "formatted_chars long, told string, learned string")
DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int32()), ("long", pa.bool_()), ("base", pa.int64()),
    ("leaf", pa.binary()), ("path", pa.list_(pa.binary())),
    ("turns", pa.list_(pa.string())), ("loss", pa.list_(pa.bool_())),
])
TREES = pa.schema([
    ("sequence", pa.int64()), ("text", pa.string()),
    ("nodes", pa.list_(pa.struct([
        ("start", pa.int32()), ("stop", pa.int32()), ("position", pa.int64()),
        ("loss", _span_type()), ("ancestors", _span_type()), ("leaf", pa.binary()), ("long", pa.bool_())]))),
])
READ = pa.schema([
    ("leaf", pa.binary()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ("told", pa.string()), ("learned", pa.string()),
])


def escape(text: str) -> str:
    """No control string is left: what could open one gets a backslash more."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def format_conversations(conversations: DataFrame, segment_turns: int = SEGMENT_TURNS,
                         segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """A row for each segment of each conversation: its formatted turns, and a hash of each prefix.

    Turns follow ``turn``, ties the role and the text; nulls come first. A null text or role
    is empty, and rows without a ``conv_id`` are one conversation without id. ``long`` tells
    whether a conversation has several segments, ``base`` how many characters are before one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, segment, base, path, turns, loss = None, b"", 0, 0, [], [], []

        def row(more: bool) -> tuple:
            return at[0], segment, more or segment > 0, base, key, path, turns, loss

        for part in slices(batches):
            out = []
            for conv_id, role, text in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                if at != (conv_id,):
                    if path:
                        out.append(row(False))
                    at, key, segment, base, path, turns, loss = (conv_id,), b"", 0, 0, [], [], []
                elif len(path) >= segment_turns or size > segment_chars:
                    out.append(row(True))
                    segment, base, path, turns, loss = segment + 1, base + size, [], [], []
                turn = format_turn(role or "", text or "")
                size = size + len(turn) if path else len(turn)
                key = hashlib.blake2b(key + turn.encode(), digest_size=16).digest()
                path.append(key)
                turns.append(turn)
                loss.append(role == ASSISTANT)
            if out:
                yield record_batch(FORMATTED, list(map(list, zip(*out))))
        if path:
            yield record_batch(FORMATTED, list(map(list, zip(row(False)))))

    order = ["turn", "role", "text"]
    return conversations.select(F.col("conv_id").cast("long"), *order).repartition("conv_id") \
        .sortWithinPartitions("conv_id", *order).mapInArrow(run, FORMATTED_DDL)


class _Sequence:
    """A sequence that is being written, and the way from its root to its last turn."""

    def __init__(self):
        self.parts, self.nodes, self.size = [], [], 0
        self.way: list[tuple[bytes, int, int, int]] = []  # hash, node, start, stop

    def add(self, path: list[bytes], turns: list[str], loss: list[bool], base: int, long: bool) -> None:
        shared = 0
        while shared < min(len(path), len(self.way)) and path[shared] == self.way[shared][0]:
            shared += 1
        del self.way[shared:]
        for key, turn, learn in zip(path[shared:], turns[shared:], loss[shared:]):
            # What the node above attends to, and the node itself.
            above, position = [], base
            if self.way:
                _, n, begin, end = self.way[-1]
                above, position = self.nodes[n]["ancestors"], self.nodes[n]["position"] + end - begin
                if above and above[-1]["stop"] == begin:
                    above = [*above[:-1], {"start": above[-1]["start"], "stop": end}]
                else:
                    above = [*above, {"start": begin, "stop": end}]
            start, stop = self.size, self.size + len(turn)
            text_at = start + turn.index("\n") + 1
            self.parts.append(turn)
            self.nodes.append({
                "start": start, "stop": stop, "position": position, "ancestors": above, "leaf": None, "long": False,
                "loss": [{"start": text_at, "stop": stop - len(END) - 1}] if learn else []})
            self.way.append((key, len(self.nodes) - 1, start, stop))
            self.size = stop
        # It may be there as a whole already, and end in the midst of a longer one.
        self.nodes[self.way[-1][1]].update(leaf=path[-1], long=long)


def build_trees(formatted: DataFrame, sequence_chars: int = SEQUENCE_CHARS) -> DataFrame:
    """Sequences of turns in depth-first order, from distinct segments of conversations.

    Equal ones are written once. The rest is dealt by ranges of prefix hashes, so many
    conversations with the same first turns spread over tasks; a turn is written once in a
    sequence and again only in the next one, as a sequence has bounded size.
    """
    # Equal prefixes are cut at the same places, so a leaf names one segment. It may be a whole
    # conversation and the beginning of a longer one.
    first = formatted.groupBy("leaf").agg(
        F.min(F.struct("conv_id", "segment")).alias("first"), F.max("long").alias("any_long"))
    distinct = formatted.join(first, "leaf").filter(
        F.col("conv_id").eqNullSafe(F.col("first.conv_id")) & (F.col("segment") == F.col("first.segment"))) \
        .select("path", "turns", "loss", "base", F.col("any_long").alias("long"))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    n = 1 + (formatted.agg(F.sum(size)).head()[0] or 0) // TASK_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        own = _Sequence()

        def close() -> pa.RecordBatch:
            return record_batch(TREES, [[number], ["".join(own.parts)], [own.nodes]])

        for part in slices(batches):
            for path, turns, loss, base, long in zip(*(part.column(i).to_pylist() for i in range(5))):
                if own.size and (path[0] != own.way[0][0] or own.size > sequence_chars):
                    yield close()
                    number, own = number + 1, _Sequence()
                own.add(path, turns, loss, base, long)
        if own.size:
            yield close()

    return distinct.repartitionByRange(n, "path").sortWithinPartitions("path").mapInArrow(run, TREES_DDL)


def read_trees(trees: DataFrame) -> DataFrame:
    """Each distinct segment, from the spans of its turns and the loss mask.

    ``told`` and ``learned`` are what the digests are of, where a segment is not all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = {n["start"]: n for n in nodes}
                out = [[] for _ in READ]
                for node in nodes:
                    if node["leaf"] is None:
                        continue
                    spans = [*node["ancestors"], {"start": node["start"], "stop": node["stop"]}]
                    whole = "".join(text[s["start"]:s["stop"]] for s in spans)
                    turns, masked = parse(whole), []
                    for span in spans:
                        here = span["start"]
                        while here < span["stop"]:
                            masked += [text[s["start"]:s["stop"]] for s in at[here]["loss"]]
                            here = at[here]["stop"]
                    learned = "".join(map(unescape, masked))
                    told = "".join(f"{r}\n{t}\n" for r, t in turns)
                    for column, value in zip(out, (
                            node["leaf"], len(turns), hashlib.sha256(told.encode()).hexdigest(),
                            len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(whole),
                            told if node["long"] else None, learned if node["long"] else None)):
                        column.append(value)
                yield record_batch(READ, out)

    return trees.mapInArrow(run, READ_DDL)


def _joined(segments: DataFrame) -> DataFrame:
    """Digests of long conversations; their segments pass a task in their order."""
    schema = pa.schema([("conv_id", pa.int64()), *(READ.field(c) for c in DIGESTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer() -> pa.RecordBatch:
            return record_batch(schema, [[at[0]], [n], [turns.hexdigest()], [learned], [loss.hexdigest()], [chars]])

        at = None
        for part in slices(batches):
            for conv_id, more, told, own, size in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if at != (conv_id,):
                    if at:
                        yield answer()
                    at, n, learned, chars, turns, loss = (conv_id,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                turns.update(told.encode())
                loss.update(own.encode())
                n, learned, chars = n + more, learned + len(own), chars + size
        if at:
            yield answer()

    return segments.select("conv_id", "segment", "n_turns", "told", "learned", "formatted_chars") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "segment") \
        .mapInArrow(run, "conv_id long, " + ", ".join(
            f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in DIGESTS))


def chat_digests(conversations: DataFrame, sequence_chars: int = SEQUENCE_CHARS,
                 segment_turns: int = SEGMENT_TURNS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``conv_id`` and what was read back from the trees, for every conversation.

    An empty table gives no rows; repeated rows are repeated turns; other columns are left out.
    A conversation of any length passes one task as a stream, since its digest is of all its
    turns in their order; a task holds a segment at most.
    """
    formatted = store(format_conversations(conversations, segment_turns, segment_chars), "conversations")
    trees = store(build_trees(formatted, sequence_chars), "trees")
    segments = formatted.select("conv_id", "segment", "long", "leaf")
    whole = segments.filter(~F.col("long")).join(read_trees(trees).drop("told", "learned"), "leaf")
    with_long = trees.filter(F.exists("nodes", lambda n: n["long"]))
    long = segments.filter("long").join(read_trees(with_long).filter("told IS NOT NULL"), "leaf")
    return whole.select("conv_id", *DIGESTS).unionByName(_joined(long))


def op4_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(EXTRA_ID, i, role, EXTRA_TEXT) for i, role in enumerate(("user", ASSISTANT))],
        "conv_id long, turn long, role string, text string")
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(given.unionByName(extra))


OP4_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT {EXTRA_ID}, 0, 'user', '{EXTRA_TEXT}'
  UNION ALL SELECT {EXTRA_ID}, 1, '{ASSISTANT}', '{EXTRA_TEXT}'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
       sum({len(START) + len(END) + 2} + length(text) + len(regexp_extract_all(text, '<\\*\|'))
           + length(role) + len(regexp_extract_all(role, '[\\\n]'))
           + len(regexp_extract_all(role, '<\\*\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
