"""SentencePiece encoding by a table of each prefix's last piece, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialtrace.llm.common import kept_by_worker, whole_text

#: Parts of texts in one generation, of which a worker keeps two, and pairs of pieces kept at most.
KEPT_PARTS = 500_000
KEPT_PAIRS = 500_000

#: Fixed value: the sign that stands for a space.
SPACE = "▁"


class Pieces:
    """A merge-type model: what its pieces are made of, and which two can stand side by side.

    Merging takes the adjacent pair whose joint piece has the best score, the left one
    of equals. Below, a piece's ``rank`` is its place by score; single characters are
    there from the start. Pieces of several space signs share one score, the worst, and
    so are merged when all else is done; ``merge_spaces`` does that.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = {int(names[i][3:5], 16): i for i in range(len(names)) if m.is_byte(i)}
        normal = [i for i in range(len(names)) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.ids = {names[i]: i for i in normal}
        self.space = self.ids[SPACE]
        self.runs = {len(p): i for p, i in self.ids.items() if len(p) > 1 and not p.strip(SPACE)}
        words = sorted((p for p in self.ids if len(p) > 1 and p.strip(SPACE)), key=lambda p: -m.get_score(self.ids[p]))
        scores = [m.get_score(self.ids[p]) for p in words]
        worst = {m.get_score(i) for i in self.runs.values()}
        if len(set(scores)) < len(scores) or len(worst) > 1 or worst and max(worst) >= min(scores) or any(SPACE in p[1:] for p in words):
            raise ValueError("the prefix table needs pieces of distinct scores in which a space sign only comes first")
        self.rank = {p: k for k, p in enumerate(words)}
        self.sides: dict[str, tuple[str, str]] = {}
        for p in words:
            made = self.last_merge(p)
            if made and max(self.rank.get(side, -1) for side in made) < self.rank[p]:
                self.sides[p] = made
            elif made:
                raise ValueError(f"{p!r} is merged before its parts")
        # a piece that its own text does not give cannot occur
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or p in self.sides:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        # a cut before a comma or dot is right where no piece has it behind that character
        inside = {p[i - 1] for p in words for i in range(1, len(p)) if p[i] in ",."}
        self.rare = re.compile("\x01" + "|[" + re.escape("".join(sorted(inside))).replace(SPACE, " ") + "][.,]" * bool(inside))
        if any("\n" in p for p in words):
            raise ValueError("a piece goes on over a line feed")

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge completes ``piece``, or None if its text ends otherwise."""
        parts = list(piece)
        while len(parts) > 2:
            found = min(((self.rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=None)
            if found is None or found[0] == 1 << 40:
                return None
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def spine(self, piece: str, side: int) -> list[tuple[str, int, int]]:
        """The parts at one end of a piece: text, rank at which it comes, and at which it goes."""
        out, goes = [], 1 << 40
        while True:
            comes = self.rank.get(piece, -1)
            out.append((piece, comes, goes))
            if piece not in self.sides:
                return out
            piece, goes = self.sides[piece][side], comes

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the text ab ends in just a and b.

        It does unless, of the parts that meet at the boundary at some time, two have a
        joint piece that is merged before either of them goes: before the left part's
        own merge, which starts further left, or no later than the right part's.
        """
        known = self.fits.get((a, b))
        if known is None:
            known = not any(
                joint < x_goes and joint <= y_goes
                for x, x_comes, x_goes in self.spine(a, 1)
                for y, y_comes, y_goes in self.spine(b, 0)
                if x_comes < y_goes and y_comes < x_goes and (joint := self.rank.get(x + y)) is not None
            )
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            self.fits[a, b] = known
        return known

    def prefix_table(self, text: str) -> list[str]:
        """The last piece of each prefix's encoding, which is unique.

        The automaton gives all pieces that end at a place; the one that can stand next
        to the last piece of what is before it is the one.
        """
        table = [""] * (len(text) + 1)
        ends: dict[int, list[str]] = {}
        for at, piece in self.automaton.iter(text):
            ends.setdefault(at + 1, []).append(piece)
        for end in range(1, len(text) + 1):
            table[end] = text[end - 1]  # a character that is no piece stands alone
            # the automaton gives longer pieces first
            for piece in ends.get(end, ()):
                start = end - len(piece)
                before = table[start]
                if not start or before not in self.ids or self.compatible(before, piece):
                    table[end] = piece
                    break
        return table

    def encode_part(self, text: str) -> list[int]:
        """The ids of a text without spaces but at its start, before spaces are merged."""
        table, end, back = self.prefix_table(text), len(text), []
        while end:
            piece = table[end]
            back.append(piece)
            end -= len(piece)
        ids: list[int] = []
        for piece in reversed(back):
            if piece in self.ids:
                ids.append(self.ids[piece])
            else:
                ids += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return ids

    def merge_run(self, n: int) -> list[int]:
        """The ids of n lone space signs in a row: all merges score alike, so the leftmost goes first."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(i, 1, 1) for i in range(n - 1) if 2 in self.runs]
        while agenda:
            i, a, b = heapq.heappop(agenda)
            j = after[i] if size[i] == a else n
            if j >= n or size[j] != b or not size[i]:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and size[left] + size[right] in self.runs:
                    heapq.heappush(agenda, (left, size[left], size[right]))
        return [self.runs.get(k, self.space) for k in size if k]

    def merge_spaces(self, ids: np.ndarray) -> np.ndarray:
        lone = ids == self.space
        edges = np.flatnonzero(np.diff(np.concatenate([[False], lone, [False]]).astype(np.int8)))
        out, done = [], 0
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a > 1:
                out += [ids[done:a], np.asarray(self.merge_run(int(b - a)), dtype="<u4")]
                done = b
        return np.concatenate([*out, ids[done:]]).astype("<u4")

    @cached_property
    def parts(self) -> Parts:
        return Parts(self)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = " " + text.replace(SPACE, " ")
        if self.rare.search(text):
            found = b"".join([self.parts[SPACE + x] for x in text[1:].split(" ")])
        else:
            marked = text.replace(" ", "\x01" + SPACE).replace(",", "\x01,").replace(".", "\x01.").replace("\n", "\x01\n\x01")
            found = b"".join(map(self.parts.__getitem__, marked.split("\x01")))
        if "  " in text:
            return self.merge_spaces(np.frombuffer(found, dtype="<u4")).tobytes()
        return found


class Parts(dict):
    """Part of a text -> its ids; parts lie between places that no piece crosses."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.pieces = pieces

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEPT_PARTS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(part)
        if found is None:
            found = np.asarray(self.pieces.encode_part(part), dtype="<u4").tobytes()
        self[part] = found
        return found


def pieces_of(path: str) -> Pieces:
    """The model of this worker; it outlives a task."""
    return kept_by_worker(f"pieces {path}", lambda: Pieces(path))


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, the ids of the whole text with begin and end ids, and the text they decode to.

    A missing or empty text has only the begin and end ids. ids are little-endian
    unsigned 32-bit integers. A missing doc_id stays missing; repeated rows have a row
    each; further columns are not read. Rows are independent, so nothing is shuffled.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        begin, end = (np.asarray([i], dtype="<u4").tobytes() for i in (pieces.model.bos_id(), pieces.model.eos_id()))
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.iloc[at : at + 1000]
                ids = [begin + pieces.encode(text) + end for text in some["text"]]
                texts = [pieces.model.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").to_numpy(), "ids": ids, "decoded": texts})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInPandas(work, "doc_id BIGINT, ids BINARY, decoded STRING")


def with_digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
