"""SentencePiece BPE: exact encoding by backtracking over longest matches, and decoding.

An encoding is a sequence of pieces in which each adjacent pair stands as it is when its own letters are merged again, and every text has just one such sequence.
So the encoder walks from left to right: an Aho-Corasick automaton gives the longest piece that begins at each position; a piece is taken if it is
compatible with the one before, else the next shorter piece that is its prefix is tried; if none is left, the position is marked in a bitfield of positions
that nothing leads on from, and the last piece taken is shortened. No position is left twice, so time is linear in the text.

No piece of such a model has a space mark after another letter, so no merge crosses the beginning of a word, and words are encoded one by one and remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: How the model writes a space.
MARK = "▁"
#: Words, parts of words and pairs that a worker remembers, at most.
REMEMBERED = 300_000
#: Characters of a text that are encoded at a time.
SLICE = 1 << 20
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
_ODD = re.compile(f"  |^ | $|{MARK}")
_CUT = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


class Encoder:
    """Encodes texts as the library does. A letter without a piece counts as a piece of its own, -1 - code point, that is written as its bytes."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        self._bytes, self._text, self._score, self._id = [0] * 256, {}, {}, {}
        self._pairs: dict[tuple[int | None, int], bool] = {}
        self._known, self._new, self._parts, self._new_parts = ({} for _ in range(4))
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self._bytes[int(piece[3:5], 16)] = i
            elif library.is_unused(i):
                raise ValueError("models with unused pieces are resegmented by the library, which isn't done here")
            elif not (library.is_control(i) or library.is_unknown(i)):
                self._id[piece], self._text[i], self._score[i] = i, piece, library.get_score(i)
        if not all(self._bytes):
            raise ValueError("the model has no pieces for bytes")
        if any(MARK in p.lstrip(MARK) for p in self._id):
            raise ValueError("the model has pieces that go on after a word's end")
        self._automaton = ahocorasick.Automaton()
        for piece, i in self._id.items():
            self._automaton.add_word(piece, (i, len(piece)))
        self._automaton.make_automaton()
        self._size = {i: len(p) for i, p in self._text.items()}
        self._less: dict[int, int | None] = {}
        self._together = {two for p in self._id for two in zip(p, p[1:], strict=False)}
        self.first, self.last = library.bos_id(), library.eos_id()
        for probe in ["a", "  b  c", " á\nx ", MARK, "\x00\U0001f600", "Abc abc, abcabc 12  345"]:
            if self.ids(probe) != library.encode(probe):
                raise ValueError("the model isn't plain BPE with a space in front: its normaliser, segmenter or options differ")

    def _letters(self, piece: int) -> str:
        return self._text[piece] if piece >= 0 else chr(-1 - piece)

    def merged(self, text: str) -> list[int]:
        """Pieces of a short text by merging: always the adjacent pair whose piece has the highest score, the leftmost of equal ones."""
        parts, get, score, never = list(text), self._id.get, self._score, float("-inf")
        worth = [never if (i := get(a + b)) is None else score[i] for a, b in zip(parts, parts[1:], strict=False)]
        while worth and (best := max(worth)) > never:
            k = worth.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del worth[k]
            if k:
                worth[k - 1] = never if (i := get(parts[k - 1] + parts[k])) is None else score[i]
            if k < len(worth):
                worth[k] = never if (i := get(parts[k] + parts[k + 1])) is None else score[i]
        return [self._id.get(p, -1 - ord(p[0])) for p in parts]

    def compatible(self, before: int | None, piece: int) -> bool:
        """Do two adjacent pieces (or one alone) stand when their letters are merged again?"""
        key = (before, piece)
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            both = [piece] if before is None else [before, piece]
            known = self._pairs[key] = self.merged("".join(map(self._letters, both))) == both
        return known

    def _shorter(self, piece: int) -> int | None:
        """The longest piece that is a proper prefix of a piece, or its first letter; none for a letter."""
        text = self._letters(piece)
        found = None
        for n in range(len(text) - 1, 0, -1):
            if (i := self._id.get(text[:n])) is not None:
                found = i
                break
        else:
            found = -1 - ord(text[0]) if len(text) > 1 else None
        self._less[piece] = found
        return found

    def backtracked(self, text: str) -> list[int]:
        """The pieces of a text without space marks between letters."""
        n = len(text)
        longest: list[int | None] = [None] * n
        for end, (i, size) in self._automaton.iter(text):
            longest[end - size + 1] = i  # of pieces with one beginning longer ones end later
        pairs, less, sizes, failed = self._pairs, self._less, self._size, bytearray(n // 8 + 1)
        out: list[int] = []
        at, before = 0, None
        piece = longest[0] if longest[0] is not None else -1 - ord(text[0])
        while True:
            end = at + (sizes[piece] if piece >= 0 else 1)
            if not failed[end >> 3] >> (end & 7) & 1:
                if (fits := pairs.get((before, piece))) is None:
                    fits = self.compatible(before, piece)
                if fits:
                    out.append(piece)
                    if end == n:
                        return out
                    at, before = end, piece
                    piece = longest[at]
                    if piece is None:
                        piece = -1 - ord(text[at])
                    continue
            piece = less[piece] if piece in less else self._shorter(piece)
            while piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("a text without an encoding: the model's pieces contradict each other")
                last = out.pop()
                at -= sizes[last] if last >= 0 else 1
                before = out[-1] if out else None
                piece = less[last] if last in less else self._shorter(last)

    def _part(self, text: str) -> bytes:
        pieces = self.backtracked(text)
        if min(pieces) >= 0:
            return array("I", pieces).tobytes()
        ids = array("I")
        for piece in pieces:
            ids.extend([piece] if piece >= 0 else (self._bytes[b] for b in chr(-1 - piece).encode("utf-8")))
        return ids.tobytes()

    def _word(self, text: str) -> bytes:
        """Ids of a space mark and what follows it, cut where two letters meet that no piece has side by side: no merge crosses that."""
        together, out, start = self._together, [], 0
        if together.issuperset(zip(text, text[1:], strict=False)):
            return self._part(text)
        for k, two in enumerate(zip(text, text[1:], strict=False), 1):
            if two not in together:
                out.append(self._remembered(text[start:k], self._parts, self._new_parts, self._part))
                start = k
        out.append(self._remembered(text[start:], self._parts, self._new_parts, self._part))
        return b"".join(out)

    def _remembered(self, key: str, known: dict[str, bytes], new: dict[str, bytes], make: Callable[[str], bytes]) -> bytes:
        """What make gives for key. What comes twice is known for good, up to a bound; new ones are forgotten together when they are many, so rare ones don't take the room of common ones."""
        if (x := known.get(key)) is not None:
            return x
        if (x := new.pop(key, None)) is not None:
            if len(known) < REMEMBERED:
                known[key] = x
            return x
        x = make(key)
        if len(key) <= 100:
            if len(new) >= REMEMBERED:
                new.clear()
            new[key] = x
        return x

    def packed_ids(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit integers in the machine's order (little-endian), without begin and end."""
        if not text:
            return b""
        words = [w[1:] for w in _WORDS.findall(MARK + text.replace(" ", MARK))] if _ODD.search(text) else text.split(" ")
        found = list(map(self._known.get, words))
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    found[k] = self._remembered(words[k], self._known, self._new, self._marked)
        return b"".join(found)

    def _marked(self, word: str) -> bytes:
        return self._word(MARK + word)

    def ids(self, text: str) -> list[int]:
        return array("I", self.packed_ids(text)).tolist()


def slices(text: str, limit: int = SLICE) -> Iterator[str]:
    """A text in parts of limit characters or a little more, cut at single spaces, which are left out: the space that the model puts before each part stands for them."""
    at = 0
    while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each model file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str, keep: Sequence[str] = ("doc_id",), ends: bool = True, decoded: bool = False) -> DataFrame:
    """Columns `keep` and ids (binary, little-endian unsigned 32-bit integers) of every whole column text, between the begin and end ids if `ends`.

    With `decoded`, a column of that name has what the library's decode gives for the ids. A null text counts as empty and has the begin and end ids
    alone. Long texts are encoded in slices that are cut between words, so a row needs memory for its text and its ids only. Equal rows stay rows of their own,
    an empty table gives none, and columns that aren't kept aren't read.
    """

    def make() -> Callable[[list[str | None]], list[Sequence]]:
        own = encoder(model)
        first, last = (np.array([i], dtype="<u4").tobytes() if ends else b"" for i in (own.first, own.last))

        def compute(texts: list[str | None]) -> list[Sequence]:
            ids, plain = [], []
            for text in texts:
                parts = [own.packed_ids(s) for s in slices(text or "")]
                ids.append(b"".join([first, *parts, last]))
                if decoded:
                    plain.append(" ".join(own.library.decode(array("I", p).tolist()) for p in parts))
            return [ids, plain] if decoded else [ids]

        return compute

    return common.map_text(docs, "ids binary, decoded string" if decoded else "ids binary", make, keep)


def decode(tokens: DataFrame, model: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and text: what the library's decode gives for column ids (as of encode()). Null ids give a null text."""

    def make() -> Callable[[list[bytes | None]], list[Sequence]]:
        library = encoder(model).library
        return lambda rows: [[None if r is None else library.decode(np.frombuffer(r, dtype="<u4").tolist()) for r in rows]]

    return common.map_text(tokens.select(*keep, F.col("ids").alias("text")), "text string", make, keep)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents between begin and end ids, decode them, and give digests of both."""
    rows = encode(common.documents(spark, sf_dir), default_model(), decoded=True)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
