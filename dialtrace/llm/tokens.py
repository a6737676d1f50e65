"""Token ids of whole texts by a byte-level tokenizer, with the words of a task kept."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dialtrace.llm.common import kept_by_worker

#: Words of one generation; a worker keeps two, so that the frequent ones stay.
KEPT_WORDS = 600_000
#: Characters of text that are parted at once, unless one text alone is longer.
CHUNK = 2_000_000

#: White space of any kind, in Arrow's patterns.
WHITE = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
#: The parts end before a single space, comma or dot and around a line feed. The tokenizer
#: parts words there as well, unless one of these comes next to white space or another sign.
RARE = rf"[ \n][{WHITE}]|[{WHITE}][.,\n]|[^\p{{L}}\p{{N}}{WHITE}][.,]|[.,][^\p{{L}}\p{{N}}{WHITE}]|\x01"
#: One word of letters with ASCII signs behind it; the tokenizer parts the two.
SIGNED = re.compile(r"( ?[^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: Up to here, the letters of all versions of Unicode are the same.
LETTERS_END = "\u0530"
#: Writers of so many ids.
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it is printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Encoder(dict):
    """Part of a text -> its ids as little-endian unsigned 32-bit integers.

    Texts are cut where the tokenizer's own pattern always parts words, so the ids of
    the parts in a row are the ids of the text. A text in which a cut could be wrong
    is cut only before a space that a character other than white space follows.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        # one Spark task has one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # asking the tokenizer for its model makes a new object each time
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(part)
        if found is None:
            found = self.fresh(part)
        self[part] = found
        return found

    def fresh(self, part: str) -> bytes:
        word = part[1:] if part[:1] == " " else part
        if word.isalpha() and (word.isascii() or max(word) < LETTERS_END):
            # one word of the tokenizer's pattern: its model alone does
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenize(letters if word is part else self.letters[32] + letters)]
        elif (signed := SIGNED.fullmatch(part)) and signed[1].lstrip(" ").isalpha() and max(signed[1]) < LETTERS_END:
            return self[signed[1]] + self[signed[2]]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids if part else []
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text. Every part is looked up once a chunk, however often it comes."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < CHUNK:
                size, stop = size + len(texts[stop] or ""), stop + 1
            yield from self.chunk([x or "" for x in texts[at:stop]])
            at = stop

    def chunk(self, texts: list[str]) -> Iterator[bytes]:
        column = pa.array(texts, pa.large_string())
        rare = pc.match_substring_regex(column, RARE)
        for sign, marked in ((" ", "\x01 "), (",", "\x01,"), (".", "\x01."), ("\n", "\x01\n\x01")):
            column = pc.replace_substring(column, sign, marked)
        parts = pc.split_pattern(pc.if_else(rare, "", column), "\x01")
        coded = parts.flatten().dictionary_encode()
        ids = pa.array([self[x] for x in coded.dictionary.to_numpy(zero_copy_only=False)], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[np.asarray(parts.offsets)]
        row = memoryview(ids.buffers()[2] or b"")
        for text, other, a, b in zip(texts, rare.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield self.coarse(text) if other else bytes(row[a:b])

    def coarse(self, text: str) -> bytes:
        """Cuts only before a space that a character other than white space follows."""
        parts = re.split(r" (?=\S)", text)
        return b"".join([self[parts[0]], *map(self.__getitem__, [" " + x for x in parts[1:]])])


def encoder(path: str) -> Encoder:
    """The encoder of this worker; it outlives a task."""
    return kept_by_worker(f"encoder {path}", lambda: Encoder(path))
