"""Removal of long byte strings that an earlier document has, by enhanced suffix arrays.

Any 50 bytes have an anchor, the least hash of their stretches of 16, and equal bytes have
equal anchors. Blocks of texts send the anchors they hold to ranges of hashes and learn which
ones another text has too. The passages around those anchors, each once a block, are dealt by
anchor to shards. A shard builds one suffix array with common prefixes over its different
passages and scans it with a stack: the intervals of 50 bytes or more that extend to the left
by different bytes are the maximal repeats, with all occurrences. What a repeat covers in
passages of later documents goes back to their blocks.

An anchor with very many different passages would crowd a shard. Its passages are cut into
their single windows, which are dealt by their own hashes, so nothing is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import record_batch, slices, store, table

WINDOW, STRETCH = 50, 16
# Bytes of text in a block, anchors in a range of hashes, bytes of passages in a shard.
BLOCK, RANGE, SHARD = 4 << 20, 1_000_000, 3 << 20
# Different passages of an anchor, summed over blocks, beyond which its windows are dealt.
CROWD = 10_000
# Windows whose anchors are sought at once.
STEP = 1 << 19
HASH_BITS = 40
LAST = (1 << 63) - 1

TEXTS = pa.schema([("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("d", pa.int64()),
                   ("n", pa.int64()), ("z", pa.binary())])
ANCHORS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("h", pa.binary()), ("many", pa.binary())])
SHARED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()),
                    ("z", pa.binary())])
PASSAGES = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("place", pa.binary()),
                      ("size", pa.binary()), ("d", pa.binary()), ("text", pa.binary())])
RESULT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int64()), ("n_removed", pa.int64()),
                    ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


# --- anchors ---------------------------------------------------------------------------


def _words_at(buffer: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` places on, as one number."""
    return np.ascontiguousarray(
        np.lib.stride_tricks.as_strided(buffer, (n, 8), (1, 1))).view(np.uint64).ravel()


def _grams(buffer: np.ndarray, n: int, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each of the first ``n`` places on; ``k`` is 8 or more."""
    at = _words_at(buffer, n + k - 8)
    out = at[:n] * np.uint64(0x9E3779B97F4A7C15)
    for o in sorted({*range(8, k - 8, 8), k - 8} - {0}):
        out ^= out >> np.uint64(29)
        out = (out + at[o:o + n]) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(31)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return values if done == width else np.minimum(values[:len(values) - (width - done)], values[width - done:])


def anchors(buffer: np.ndarray, ends: np.ndarray, window: int = WINDOW, stretch: int = STRETCH) -> tuple:
    """``hash, first, count`` of each run of windows with one anchor, in joined texts.

    ``ends`` are the places behind each text; no window crosses one.
    """
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    n, low = len(buffer), np.uint64((1 << (64 - HASH_BITS)) - 1)
    for at in range(0, n - window + 1, STEP):
        stop = min(at + STEP, n - window + 1)
        part = buffer[at:stop + window - 1]
        grams = _grams(part, len(part) - stretch + 1, stretch)
        place = np.arange(len(grams), dtype=np.uint64)
        least = _least(grams & ~low | place, window - stretch + 1)
        # Windows that lie in one text: no end inside.
        start = np.arange(at, stop)
        here = np.searchsorted(ends, start, "right")
        alone = start + window <= ends[np.minimum(here, len(ends) - 1)]
        new = np.r_[True, (least[1:] != least[:-1]) | (here[1:] != here[:-1])] & alone
        first = np.flatnonzero(new)
        if len(first):
            run = np.cumsum(new) - 1
            count = np.bincount(run[alone], minlength=len(first))
            found.append((least[first] >> np.uint64(64 - HASH_BITS), first + at, count))
    return tuple(np.concatenate(c) for c in zip(*found))


def _steps(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, in a row."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BITS // 8]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // HASH_BITS, 8), np.uint8)
    out[:, :HASH_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BITS // 8)
    return out.view("<u8").ravel()


# --- the suffix array and its intervals ------------------------------------------------


class PrefixIntervals:
    """The suffixes of some texts that share ``least`` bytes with another one, sorted.

    ``text`` and ``start`` name the suffixes in order, ``common[i]`` is how many bytes suffix
    ``i`` shares with the one before it.
    """

    def __init__(self, texts: list[bytes], least: int):
        self.texts, self.least = texts, least
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        # One more than each byte: UTF-8 stays below 256, and nought is left for what is behind an end.
        total = int(ends[-1]) if len(ends) else 0
        raw = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
        count = np.maximum(size - least + 1, 0)
        text = np.repeat(np.arange(len(texts)), count)
        start = _steps(count)
        place = (ends - size)[text] + start
        if len(place):
            # Only those whose first bytes stand twice; equal bytes have equal hashes.
            key = _grams(raw, total - least + 1, least)[place] if least >= 8 else np.zeros(len(place), np.uint64)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = order[np.r_[False, same] | np.r_[same, False]]
            text, start, place = text[twice], start[twice], place[twice]
        left = size[text] - start
        at = _words_at(raw + np.uint8(1), len(raw) - 8).byteswap() if len(place) else np.zeros(0, np.uint64)
        words = []
        for o in range(0, int(left.max(initial=0)), 8):
            inside = np.clip(left - o, 0, 8).astype(np.uint64)
            mask = np.where(inside > 0, ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(inside, 1))), 0)
            words.append(at[np.minimum(place + o, len(at) - 1)] & mask)
        if words:
            order = np.lexsort(words[::-1])
            words = [w[order] for w in words]
            text, start, left = text[order], start[order], left[order]
        self.text, self.start = text, start
        self.common = np.zeros(len(text), np.int64)
        if len(text) > 1:
            going = np.ones(len(text) - 1, bool)
            for w in words:
                differ = (w[1:] ^ w[:-1]).byteswap().view(np.uint8).reshape(-1, 8) != 0
                same = np.where(differ.any(1), differ.argmax(1), 8)
                self.common[1:] += np.where(going, same, 0)
                going &= same == 8
            self.common[1:] = np.minimum(self.common[1:], np.minimum(left[1:], left[:-1]))
        # The byte before, -1 at the start of a text, where any byte may stand.
        before = raw[np.maximum(place - 1, 0)].astype(np.int64) if len(place) else np.zeros(0, np.int64)
        self.before = np.where(start > 0, before[order] if words else before, -1)

    def scan(self, document: np.ndarray) -> Iterator[tuple]:
        """Scan the array with a stack; ``length, low, high, open, least`` of each maximal repeat.

        A repeat is the interval from ``low`` to ``high`` of suffixes that share ``length``
        bytes and are not all preceded by the same byte. ``document`` has a number for each
        text and ``least`` is the smallest one of the interval. ``open`` are the suffixes with a
        larger number that no longer repeat with a smaller number covered.
        """
        number = document[self.text].tolist()
        before, common = self.before.tolist(), self.common.tolist()
        stack: list[list] = []  # length, low, least, byte before (-1: different), open
        for i in range(1, len(number) + 1):
            shared = common[i] if i < len(number) else 0
            low, least, byte, open_ = i - 1, number[i - 1], before[i - 1], [i - 1]
            while stack and stack[-1][0] > shared:
                length, from_, m, x, o = stack.pop()
                least, byte = min(least, m), byte if byte == x else -1
                low = from_
                open_ = o + open_
                later = [j for j in open_ if number[j] > least]
                if byte < 0:
                    yield length, low, i - 1, later, least
                # Where all are preceded by one byte, the interval one byte before covers them.
                open_ = [j for j in open_ if number[j] == least] if later else open_
            if shared >= self.least:
                if stack and stack[-1][0] == shared:
                    top = stack[-1]
                    top[2], top[3] = min(top[2], least), byte if byte == top[3] else -1
                    top[4] += open_
                else:
                    stack.append([shared, low, least, byte, open_])


def maximal_repeats(texts: list[bytes], least: int = WINDOW) -> list[tuple]:
    """``string, [(text, start), ...]`` of every maximal repeat of ``least`` bytes or more.

    A string that stands at two places at least, not always with the same byte before it and
    not always with the same byte behind it; starts and ends of texts differ from any byte.
    """
    tree = PrefixIntervals(texts, least)
    out = []
    for length, low, high, _, _ in tree.scan(np.zeros(len(texts), np.int64)):
        places = sorted(zip(tree.text[low:high + 1].tolist(), tree.start[low:high + 1].tolist()))
        out.append((texts[places[0][0]][places[0][1]:places[0][1] + length], places))
    return out


# --- blocks ----------------------------------------------------------------------------


class Block:
    """Texts that are worked on together, in a fixed order, and the passages they share."""

    def __init__(self, rows: pa.Table, window: int, stretch: int):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("a", "b", "d", "z"))))
        self.keys = [r[:3] for r in rows]
        self.texts = [unpack(r[3]) for r in rows]
        self.window = window
        self.d = np.array([r[2] for r in rows], np.int64)
        self.ends = np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(self.texts)))
        self.joined = b"".join(self.texts)
        self.hash, self.first, self.count = anchors(
            np.frombuffer(self.joined + bytes(16), np.uint8)[:len(self.joined)], self.ends, window, stretch)

    def held(self) -> tuple:
        """The different anchors, and of each how many passages, 128 more if of several texts."""
        text = np.searchsorted(self.ends, self.first, "right")
        size = self.count + self.window - 1
        data = np.frombuffer(self.joined + bytes(16), np.uint8)
        # Passages that differ have different tokens, but for rare cases that change work only.
        at = _words_at(data, len(self.joined)) if len(self.joined) else np.zeros(0, np.uint64)
        token = (at[self.first] * np.uint64(31) + at[self.first + size - 8]) * np.uint64(31) + size.astype(np.uint64)
        order = np.lexsort((token, self.hash))
        h, token, text = self.hash[order], token[order], text[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        other = new | np.r_[True, token[1:] != token[:-1]] if len(h) else new
        start = np.flatnonzero(new)
        if not len(start):
            return h, np.zeros(0, np.uint8)
        kinds = np.minimum(np.add.reduceat(other.astype(np.int64), start), 127)
        several = np.minimum.reduceat(text, start) < np.maximum.reduceat(text, start)
        return h[start], (kinds + 128 * several).astype(np.uint8)

    def passages(self, shared: np.ndarray, crowded: np.ndarray) -> tuple:
        """``texts, hashes, place, start``: different passages, and where they stand.

        ``shared`` and ``crowded`` are sorted hashes; passages of crowded ones are windows, whose
        hashes are their own.
        """
        import xxhash

        def among(values: np.ndarray) -> np.ndarray:
            at = np.searchsorted(values, self.hash)
            return values[np.minimum(at, len(values) - 1)] == self.hash if len(values) else np.zeros(len(self.hash), bool)

        alone = among(crowded)
        whole = among(shared) & ~alone
        first, size = self.first[whole], self.count[whole] + self.window - 1
        count = self.count[alone]
        windows = np.repeat(self.first[alone], count) + _steps(count)
        texts, place = self._different(first, size)
        hashes = np.zeros(len(texts), np.uint64)
        hashes[place] = self.hash[whole]
        single, single_place = self._different(windows, np.full(len(windows), self.window))
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, single), np.uint64, len(single))
        return (texts + single, np.concatenate([hashes, own]),
                np.concatenate([place, single_place + len(texts)]), np.concatenate([first, windows]))

    def _different(self, first: np.ndarray, size: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        seen: dict[bytes, int] = {}
        joined = self.joined
        place = np.fromiter((seen.setdefault(joined[a:b], len(seen)) for a, b in
                             zip(first.tolist(), (first + size).tolist())), np.int64, len(first))
        return list(seen), place

    def least(self, places: int, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The smallest document of each passage."""
        out = np.full(places, LAST, np.int64)
        np.minimum.at(out, place, self.d[np.searchsorted(self.ends, first, "right")])
        return out


def _answers(rows: pa.Table, kind: int) -> list[tuple]:
    return [r[1:] for r in zip(*(rows.column(c).to_pylist() for c in ("kind", "x", "y", "z"))) if r[0] == kind]


def _shared_hashes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    got = _answers(rows, 0)
    return tuple(np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unpacked(r[i]) for r in got)])) for i in (0, 1))


# --- the job ---------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """``d, a, b, n, text``: the id (null ones last), two hashes of the text, its bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("a"),
        F.xxhash64(F.lit(1), text).alias("b"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))


def _different_texts(docs: DataFrame, window: int, block: int) -> DataFrame:
    """Each text of ``window`` bytes or more once, packed, with its smallest id, in blocks."""
    packed = pa.schema([TEXTS.field(c) for c in ("a", "b", "d", "n", "z")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches):
            yield record_batch(packed, [*part.columns[:4], [pack(t.encode()) for t in part.column(4).to_pylist()]])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size = TaskContext.get().partitionId() << 32, 0
        for part in batches:
            before = size + np.cumsum(part.column(3).to_numpy()) - part.column(3).to_numpy()
            size += int(part.column(3).to_numpy().sum())
            yield record_batch(TEXTS, [pa.array(at + before // block), *part.columns])

    rows = _keyed(docs).filter(F.col("n") >= window).select("a", "b", "d", "n", "text") \
        .mapInArrow(pack, _ddl(packed))
    return store(
        rows.groupBy("a", "b").agg(F.min(F.struct("d", "n", "z")).alias("x")).select("a", "b", "x.*")
        .mapInArrow(dealt, _ddl(TEXTS)), "blocks")


def _blocks(batches: Iterator[pa.RecordBatch], window: int, stretch: int) -> Iterator[tuple]:
    """The number and the block of adjacent rows of one block."""
    at, rows = None, []
    for part in slices(batches):
        for run in np.split(np.arange(part.num_rows), 1 + np.flatnonzero(np.diff(part.column(0).to_numpy()))):
            if len(run):
                piece = part.slice(int(run[0]), len(run))
                if piece.column(0)[0].as_py() != at and rows:
                    yield at, Block(pa.Table.from_batches(rows), window, stretch)
                    rows = []
                at = piece.column(0)[0].as_py()
                rows.append(piece)
    if rows:
        yield at, Block(pa.Table.from_batches(rows), window, stretch)


def _shared_anchors(texts: DataFrame, parts: int, window: int, stretch: int, crowd: int) -> DataFrame:
    """For each block the anchors that another text has too, and those of them that are crowded."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, window, stretch):
            hashes, many = block.held()
            part = (hashes % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for run in np.split(order, 1 + np.flatnonzero(np.diff(part[order]))):
                if len(run):
                    yield record_batch(ANCHORS, [
                        [int(part[run[0]])], [number], [_packed(hashes[run])], [many[run].tobytes()]])

    def meet(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_numpy()
        found = [_unpacked(h) for h in rows.column("h").to_pylist()]
        hashes = np.concatenate([np.zeros(0, np.uint64), *found])
        many = np.frombuffer(b"".join(rows.column("many").to_pylist()), np.uint8)
        block = np.repeat(np.arange(len(blocks)), [len(h) for h in found])
        order = np.argsort(hashes, kind="stable")
        hashes, many, block = hashes[order], many[order], block[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        run, start = np.cumsum(new) - 1, np.flatnonzero(new)
        out = [[], [], []]
        if len(start):
            size = np.diff(np.r_[start, len(hashes)])
            shared = (size > 1) | (np.maximum.reduceat(many, start) > 127)
            crowded = np.add.reduceat(many.astype(np.int64) & 127, start) > crowd
            keep, full = shared[run], (shared & crowded)[run]
            order = np.argsort(block[keep], kind="stable")
            hashes, full, block = hashes[keep][order], full[keep][order], block[keep][order]
            for part in np.split(np.arange(len(block)), 1 + np.flatnonzero(np.diff(block))):
                if len(part):
                    out[0].append(int(blocks[block[part[0]]]))
                    out[1].append(_packed(hashes[part][~full[part]]))
                    out[2].append(_packed(hashes[part][full[part]]))
        return pa.Table.from_batches([record_batch(SHARED, [
            out[0], np.zeros(len(out[0]), np.int32), out[1], out[2], [b""] * len(out[0])])])

    return texts.mapInArrow(held, _ddl(ANCHORS)).groupBy("part").applyInArrow(meet, _ddl(SHARED))


def _shared_passages(texts: DataFrame, shared: DataFrame, shards: int, window: int, stretch: int) -> DataFrame:
    """Each block's different passages around shared anchors, for the shards of their anchors."""
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = [[] for _ in PASSAGES]
        if rows.num_rows and answers.num_rows:
            block = Block(rows, window, stretch)
            found, hashes, place, first = block.passages(*_shared_hashes(answers))
            d = block.least(len(found), place, first)
            shard = (hashes % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            size = np.fromiter(map(len, found), np.uint8, len(found))
            number = rows.column("block")[0].as_py()
            for part in np.split(order, 1 + np.flatnonzero(np.diff(shard[order]))):
                if len(part):
                    for column, value in zip(out, (
                            int(shard[part[0]]), number, part.astype("<i4").tobytes(), size[part].tobytes(),
                            d[part].tobytes(), b"".join([found[i] for i in part.tolist()]))):
                        column.append(value)
        return pa.Table.from_batches([record_batch(PASSAGES, out)])

    return texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, _ddl(PASSAGES))


class Shard:
    """The different passages of a shard, and which rows of which blocks have them."""

    def __init__(self, rows: pa.Table, window: int):
        self.block, self.place, self.of, self.d = [], [], [], []
        seen: dict[bytes, int] = {}
        for block, place, size, d, text in zip(*(rows.column(c).to_pylist() for c in (
                "block", "place", "size", "d", "text"))):
            ends = np.cumsum(np.frombuffer(size, np.uint8).astype(np.int64)).tolist()
            self.of.append(np.array([seen.setdefault(text[a:b], len(seen)) for a, b in zip([0, *ends], ends)], np.int64))
            self.block.append(block)
            self.place.append(np.frombuffer(place, "<i4"))
            self.d.append(np.frombuffer(d, np.int64))
        self.texts = list(seen)
        self.least = np.full(len(seen), LAST, np.int64)
        for of, d in zip(self.of, self.d):
            np.minimum.at(self.least, of, d)
        self.tree = PrefixIntervals(self.texts, window)

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``passage, start, stop`` of what a repeat covers in the first document of a passage."""
        at, size = [], []
        for length, _, _, later, _ in self.tree.scan(self.least):
            at += later
            size += [length] * len(later)
        at, size = np.array(at, np.int64), np.array(size, np.int64)
        start = self.tree.start[at]
        return self.tree.text[at], start, start + size


def _covers(passages: DataFrame, window: int) -> DataFrame:
    """For each block: passages that smaller documents have, and the covered stretches of others."""
    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, window)
        text, start, stop = shard.covered()
        order = np.argsort(text, kind="stable")
        text, start, stop = text[order], start[order], stop[order]
        low, high = (np.searchsorted(text, np.arange(len(shard.texts)), s) for s in ("left", "right"))
        out = [[], [], [], []]
        for block, place, of, d in zip(shard.block, shard.place, shard.of, shard.d):
            later = d > shard.least[of]
            count = np.where(later, 0, high[of] - low[of])
            if not later.any() and not count.any():
                continue
            at = np.repeat(low[of], count) + _steps(count)
            out[0].append(block)
            out[1].append(place[later].tobytes())
            out[2].append(np.repeat(place, count).astype("<i4").tobytes())
            out[3].append(np.stack([start[at], stop[at]]).astype(np.uint8).tobytes())
        return pa.Table.from_batches([record_batch(SHARED, [out[0], np.ones(len(out[0]), np.int32), *out[1:]])])

    return passages.groupBy("shard").applyInArrow(run, _ddl(SHARED))


def _removed(texts: DataFrame, answers: DataFrame, window: int, stretch: int, keep: bool) -> DataFrame:
    """``a, b, d, n_removed, n_spans, kept_sha256, kept`` of each different text."""
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = [[] for _ in RESULT]
        if not rows.num_rows:
            return pa.Table.from_batches([record_batch(RESULT, out)])
        block = Block(rows, window, stretch)
        found, _, place, first = block.passages(*_shared_hashes(answers))
        size = np.fromiter(map(len, found), np.int64, len(found))
        least = block.least(len(found), place, first)
        whole = np.zeros(len(found), bool)
        low = [np.zeros(0, np.int64)]
        high, of = list(low), list(low)
        for known, places, spans in _answers(answers, 1):
            whole[np.frombuffer(known, "<i4")] = True
            spans = np.frombuffer(spans, np.uint8).astype(np.int64).reshape(2, -1)
            of.append(np.frombuffer(places, "<i4").astype(np.int64))
            low.append(spans[0])
            high.append(spans[1])
        of, low, high = (np.concatenate(c) for c in (of, low, high))
        order = np.argsort(of, kind="stable")
        of, low, high = of[order], low[order], high[order]
        # Later documents lose a passage as a whole, its first one what repeats cover.
        gone = whole[place] | (block.d[np.searchsorted(block.ends, first, "right")] > least[place])
        a, b = [first[gone]], [first[gone] + size[place[gone]]]
        rest, where = place[~gone], first[~gone]
        from_, to = np.searchsorted(of, rest, "left"), np.searchsorted(of, rest, "right")
        count = to - from_
        at = np.repeat(from_, count) + _steps(count)
        a.append(np.repeat(where, count) + low[at])
        b.append(np.repeat(where, count) + high[at])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        text = np.searchsorted(block.ends, a, "right")
        # Runs: what overlaps or touches in one text.
        new = np.r_[True, (a[1:] > b[:-1]) | (text[1:] != text[:-1])] if len(a) else np.zeros(0, bool)
        begin, text = a[new], text[new]
        stop = b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]] if len(a) else begin
        of = np.searchsorted(text, np.arange(len(block.texts) + 1))
        for i, (key, text, end) in enumerate(zip(block.keys, block.texts, block.ends.tolist())):
            runs = slice(of[i], of[i + 1])
            ahead = end - len(text)
            left, at = [], 0
            for x, y in zip((begin[runs] - ahead).tolist(), (stop[runs] - ahead).tolist()):
                left.append(text[at:x])
                at = y
            left = b"".join([*left, text[at:]])
            for column, value in zip(out, (*key, len(text) - len(left), runs.stop - runs.start,
                                           hashlib.sha256(left).hexdigest(), left if keep else None)):
                column.append(value)
        return pa.Table.from_batches([record_batch(RESULT, out)])

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _ddl(RESULT))


def _shares(docs: DataFrame, window: int, stretch: int, crowd: int, block: int, range_: int, shard: int) -> tuple:
    """The different texts in blocks, what they share, and the passages of each shard."""
    texts = _different_texts(docs, window, block)
    size = texts.agg(F.sum("n")).head()[0] or 0
    width = window - stretch + 1
    parts = max(1, -(-2 * size // (width + 1) // range_))
    shared = store(_shared_anchors(texts, parts, window, stretch, crowd), "shared")
    count = shared.agg(F.sum(F.octet_length("x")), F.sum(F.octet_length("y"))).head()
    held = ((count[0] or 0) * (window + width // 2) + (count[1] or 0) * window * width // 2) * 8 // HASH_BITS
    return texts, shared, _shared_passages(texts, shared, max(1, -(-held // shard)), window, stretch)


def remove_repeats(docs: DataFrame, window: int = WINDOW, stretch: int = STRETCH, crowd: int = CROWD,
                   block: int = BLOCK, range_: int = RANGE, shard: int = SHARD, keep: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs``.

    A byte goes if ``window`` bytes around it (at most 128) also start in a document with a
    smaller id; ``n_spans`` counts the maximal runs that go, ``kept`` are the other bytes (null
    where ``keep`` is false). A null text is empty. Null ids count as larger than all others and
    are no example for anything; rows with one id do not remove each other's bytes, so repeated
    rows are equal. Of equal texts those after the smallest id go as a whole, if they have
    ``window`` bytes. Other columns are left out; an empty table gives none.
    """
    if not 2 * window - stretch <= 255 or not 8 <= stretch <= window:
        raise ValueError("the window and its stretch must fit into passages of 255 bytes")
    texts, shared, passages = _shares(docs, window, stretch, crowd, block, range_, shard)
    answers = shared.union(store(_covers(passages, window), "covers"))
    found = store(_removed(texts, answers, window, stretch, keep), "removed").withColumnRenamed("d", "least")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    rows = _keyed(docs)
    if not keep:
        rows = rows.withColumn("text", F.when(F.col("n") < window, F.col("text")))
    copy, short = F.col("d") > F.col("least"), F.col("least").isNull()
    kept = F.when(short, F.encode("text", "UTF-8")).when(copy, F.lit(b"")).otherwise(F.col("kept"))
    return rows.join(found, ["a", "b"], "left").select(
        F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), F.col("n").alias("n_bytes"),
        F.when(short, 0).when(copy, F.col("n")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(short, 0).when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(short, F.sha2(F.encode("text", "UTF-8"), 256)).when(copy, none)
        .otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        (kept if keep else F.lit(None).cast("binary")).alias("kept"))


def repeat_groups(docs: DataFrame, window: int = WINDOW, stretch: int = STRETCH, crowd: int = CROWD,
                  block: int = BLOCK, range_: int = RANGE, shard: int = SHARD) -> DataFrame:
    """``repeat, length, doc_id, start``: every occurrence of each maximal repeat of a shard.

    ``repeat`` is a hash of the string, of ``window`` bytes or more. Strings are maximal within
    the passages of shared anchors, so longer ones come in overlapping parts. Equal texts are
    one document, that of the smallest id (null where no row has one). A passage that stands in
    one form only is a repeat of its own. Rows are as many as occurrences.
    """
    texts, shared, passages = _shares(docs, window, stretch, crowd, block, range_, shard)
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()),
                        ("z", pa.binary())])
    result = pa.schema([("repeat", pa.int64()), ("length", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64())])

    def groups(rows: pa.Table) -> pa.Table:
        import xxhash

        held = Shard(rows, window)
        passage, start, length, name = ([] for _ in range(4))
        for size, low, high, _, _ in held.tree.scan(np.zeros(len(held.texts), np.int64)):
            t, s = held.tree.text[low:high + 1], held.tree.start[low:high + 1]
            string = held.texts[t[0]][s[0]:s[0] + size]
            passage += t.tolist()
            start += s.tolist()
            length += [size] * len(t)
            name += [xxhash.xxh3_64_intdigest(string)] * len(t)
        # Passages as a whole; equal ones are one leaf of the array.
        passage += range(len(held.texts))
        start += [0] * len(held.texts)
        length += list(map(len, held.texts))
        name += [xxhash.xxh3_64_intdigest(t) for t in held.texts]
        order = np.argsort(passage, kind="stable")
        passage = np.array(passage, np.int64)[order]
        entry = np.stack([np.array(name, np.uint64)[order], np.array(start, np.uint64)[order],
                          np.array(length, np.uint64)[order]])
        out = [[], [], []]
        for number, place, of in zip(held.block, held.place, held.of):
            low, high = np.searchsorted(passage, of, "left"), np.searchsorted(passage, of, "right")
            count = high - low
            at = np.repeat(low, count) + _steps(count)
            out[0].append(number)
            out[1].append(np.repeat(place, count).astype("<i4").tobytes())
            out[2].append(np.ascontiguousarray(entry[:, at]).tobytes())
        return pa.Table.from_batches([record_batch(schema, [
            out[0], np.ones(len(out[0]), np.int32), out[1], out[2], [b""] * len(out[0])])])

    def expand(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = [np.zeros((4, 0), np.int64)]
        if rows.num_rows and answers.num_rows:
            held = Block(rows, window, stretch)
            found, _, place, first = held.passages(*_shared_hashes(answers))
            order = np.argsort(place, kind="stable")
            place, first = place[order], first[order]
            text = np.searchsorted(held.ends, first, "right")
            begin = np.r_[0, held.ends][text]
            for places, entries, _ in _answers(answers, 1):
                of = np.frombuffer(places, "<i4")
                entry = np.frombuffer(entries, np.uint64).reshape(3, -1)
                low, high = np.searchsorted(place, of, "left"), np.searchsorted(place, of, "right")
                count = high - low
                at = np.repeat(low, count) + _steps(count)
                entry = np.repeat(entry, count, axis=1)
                out.append(np.stack([entry[0].view(np.int64), entry[2].view(np.int64), held.d[text[at]],
                                     first[at] - begin[at] + entry[1].view(np.int64)]))
        name, length, d, start = np.concatenate(out, axis=1)
        return pa.Table.from_batches([record_batch(result, [
            pa.array(name), pa.array(length.astype(np.int32)), pa.array(d, mask=d == LAST), pa.array(start)])])

    answers = shared.union(store(passages.groupBy("shard").applyInArrow(groups, _ddl(schema)), "groups"))
    rows = store(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(expand, _ddl(result))
                 .distinct(), "occurrences")
    several = store(rows.groupBy("repeat").count().filter("count > 1").select("repeat"), "several")
    return rows.join(several, "repeat")


def op11_prefix_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), keep=False).drop("kept")
