"""Token ids of whole texts, as little-endian unsigned 32-bit integers in bytes.

A byte-level BPE splits text before it merges, and no piece of that split runs from a
character that is no white space over a following space. A text can therefore be cut at
every single space between two characters that are no white space, and the space goes
with what follows. The same words come again and again, so each worker remembers the ids
of a bounded number of them.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from buildlens.llm.common import per_task

REMEMBERED = 300_000
_MARKS = [".", ",", ";", ":", "!", "?"]
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself, or the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Remembered:
    """Two generations of a dictionary: what was not asked for lately is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys) -> list[str]:
        """The keys that are not known, each once; the known ones are in ``new`` afterwards."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for k in dict.fromkeys(keys):
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out


def _odd(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace()


class WordEncoder:
    """Encodes whole texts word by word.

    ``split`` cuts a string into the pieces that are merged separately, and
    ``encode(pieces) -> [bytes]`` gives the ids of each. ``added`` are tokens that stand for a
    string wherever it is; what is between them is encoded by itself.
    """

    def __init__(self, split: Callable[[str], list[str]],
                 encode: Callable[[list[str]], list[bytes]], limit: int = REMEMBERED,
                 added: dict[str, int] | None = None):
        self.split, self.encode = split, encode
        self.added = {s: np.uint32(i).tobytes() for s, i in (added or {}).items()}
        self.at_added = re.compile("(" + "|".join(
            re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces, self.words = Remembered(limit), Remembered(limit // 8)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        missing = self.pieces.missing(pieces)
        self.pieces.new.update(zip(missing, self.encode(missing)))
        return list(map(self.pieces.new.__getitem__, pieces))

    def _strings(self, strings: list[str]) -> list[bytes]:
        cut = [self.split(s) for s in strings]
        ids = iter(self._pieces([p for c in cut for p in c]))
        return [b"".join(islice(ids, len(c))) for c in cut]

    def _whole(self, text: str) -> bytes:
        """The ids of a text that is cut only at added tokens and where no white space is near."""
        out = []
        for i, part in enumerate(self.at_added.split(text) if self.added else [text]):
            if i % 2:
                out.append(self.added[part])
            else:
                head, *rest = _CUT.split(part)
                out += self._strings([head, *(" " + r for r in rest)])
        return b"".join(out)

    def _words(self, words: list[str]) -> list[bytes | None]:
        """Ids of other words with a space before them; None where white space is at an end."""
        missing = [w for w in self.words.missing(words) if not _odd(w)]
        self.words.new.update(zip(missing, self._strings([" " + w for w in missing])))
        return [self.words.new.get(w) for w in words]

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where the ids of each text end; null is empty."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # Most words are letters, or letters and one mark: two pieces without a search.
        letters = pc.utf8_is_alpha(words)
        stem, mark = (pc.utf8_slice_codeunits(words, start=i, stop=j) for i, j in ((0, -1), (-1, None)))
        at_mark = pc.index_in(mark, pa.array(_MARKS))
        marked = pc.and_(pc.utf8_is_alpha(stem), pc.is_valid(at_mark))
        marked = pc.and_not(marked, letters)
        plain = pc.or_(letters, marked)
        stems = pc.binary_join_element_wise("", pc.if_else(letters, words, stem), " ") \
            .filter(plain).dictionary_encode()
        other = words.filter(pc.invert(plain)).to_pylist()
        heads = words.take(pa.array(codes[first])).to_pylist()
        stem_ids = self._pieces(stems.dictionary.to_pylist())
        other_ids = self._words(other)
        ids = [b"", *self._pieces(_MARKS), *stem_ids, *(o or b"" for o in other_ids)]
        head_at = len(ids)
        ids += self._strings(heads)
        plain = plain.to_numpy(zero_copy_only=False)
        main = np.empty(len(words), np.int64)
        main[plain] = 1 + len(_MARKS) + stems.indices.to_numpy()
        main[~plain] = 1 + len(_MARKS) + len(stem_ids) + np.arange(len(other))
        tail = np.where(marked.to_numpy(zero_copy_only=False),
                        1 + pc.fill_null(at_mark, 0).to_numpy(), 0)
        pairs = np.stack([main[codes], tail[codes]], 1)
        # What stands first in a text has no space before it, so it is no word like the rest.
        pairs[first, 0], pairs[first, 1] = head_at + np.arange(len(first)), 0
        stops = np.append(first[1:], len(codes))
        bad = np.array([_odd(h) for h in heads], bool) & (stops - first > 1)
        if None in other_ids:
            flag = np.zeros(len(words), bool)
            flag[~plain] = [o is None for o in other_ids]
            flag = flag[codes]
            flag[first] = False
            bad |= np.add.reduceat(flag, first) > 0
        for s in self.added:
            bad |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        for t in np.flatnonzero(bad).tolist():
            # All ids of such a text stand first.
            pairs[first[t]:stops[t]] = 0
            pairs[first[t], 0] = head_at + t
            ids[head_at + t] = self._whole(texts[t].as_py())
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        each = n[pairs].ravel()
        ends = np.cumsum(each)
        out = flat[np.repeat(at[pairs].ravel() - (ends - each), each) + np.arange(each.sum())]
        return out, ends[2 * stops - 1]


def library_encoder(vocabulary: str) -> WordEncoder:
    """An encoder by the ``tokenizers`` library, with the added tokens of its vocabulary."""
    def make() -> WordEncoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(vocabulary)
        added = library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that look at what is around them")
        split = regex.compile(public_tokenizers.PATTERN).findall

        merge, mapped = library.model.tokenize, str.maketrans(
            {chr(i): c for i, c in enumerate(byte_characters())})

        def encode(pieces: list[str]) -> list[bytes]:
            return [array("I", [t.id for t in merge(p.encode().decode("latin-1").translate(mapped))])
                    .tobytes() for p in pieces]

        return WordEncoder(split, encode, added={t.content: i for i, t in added.items()})

    return per_task(("tokenizers", hashlib.sha256(vocabulary.encode()).digest()), make)


def vocabulary_text(path: str) -> str:
    """The file of a vocabulary, read by the driver; its size is fixed."""
    with open(path, encoding="utf-8") as f:
        return f.read()
