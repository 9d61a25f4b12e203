"""Token ids of whole texts by a byte-level BPE of the tokenizers library."""

from __future__ import annotations

import gc
import re
from array import array
from codecs import charmap_decode
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ends a document in every encoded stream.
END_ID = 2
#: Words that the model gets at once.
WORDS = 32
#: Bytes of text that are encoded at once (or one longer text): a piece is looked up once in each such chunk.
CHUNK = 1 << 22

#: Letters in all versions of Unicode.
_LETTERS = r"A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_WORD = re.compile(rf"\n?[{_LETTERS}]+")
#: Begins a piece that follows a letter directly; where such pieces begin.
_JOINED = "\r"
_MARKS = ".,;:!?#*$%&|"
_TAIL = rf"([{_LETTERS.replace('\\u00', '\\x').replace('\\u024F', '\\x{24F}')}])([{_MARKS}])"
#: Python's white space in the syntax of Arrow's expressions; texts that aren't cut at each space and each line end, and where those are.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"^{_SPACE}|[ \n]{_SPACE}|{_SPACE}\n"
_CUT = re.compile(rf"( (?=\S)|(?<=[{_LETTERS}])(?=[{_MARKS}])|(?<=\S)(?=\n\S))")


def _byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in same)}
    return "".join(chr(others.get(b, b)) for b in range(256))


class Encoder:
    """Encodes texts exactly as Tokenizer.encode(text, add_special_tokens=False), remembering pieces of text.

    The byte-level pre-tokenizer always begins a new pre-token at a space that stands before a non-space, and a line end between
    non-spaces is a pre-token of its own; no merge crosses pre-tokens. So a text is cut at those spaces and before those line ends, and each distinct piece
    of a chunk of texts is looked up or encoded once by the library. Pieces of letters alone are one pre-token, so the library's model gets them
    without pre-tokenizing. Where other white space is next to a space or a line end, a text isn't cut.
    The library looks for added tokens (`<|endoftext|>`) before anything else, so texts that hold one go to it whole.
    Keys leave out the space that a piece begins with, but not the line end; a text's first piece is looked up with a line end in front, whose ids are left out.
    A pre-token always ends between a letter and common punctuation, so texts are cut there too (such a piece's key begins with a carriage return). The memory takes at most max_pieces
    pieces that came again and as many new ones, so it doesn't grow with the corpus; other pieces are encoded anew.
    """

    def __init__(self, path: str, max_pieces: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self._tokenizer = Tokenizer.from_file(path)
        self._model = m = self._tokenizer.model
        # Only merges in the order of their ranks make what the model gives for words in a row the same as for each.
        self._plain = isinstance(m, BPE) and not (m.ignore_merges or m.dropout or m.continuing_subword_prefix or m.end_of_word_suffix or self._tokenizer.normalizer)
        self._characters = _byte_characters()
        self._begins, self._crossing = self._marks()
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._line_end = self._library(["\n"])[0]
        self._max_pieces = max_pieces
        self._known: dict[str, bytes] = {}
        self._young: dict[str, bytes] = {}

    def _marks(self) -> tuple[np.ndarray, re.Pattern | None]:
        """Whether the token of each id begins with a space or a line end, and where, in a row of words that do, a token could cross from one to the next or from a line end to a letter."""
        marks, vocabulary = self._characters[0x20] + self._characters[0x0A], self._tokenizer.get_vocab()
        begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        begins[[i for t, i in vocabulary.items() if t[:1] in marks]] = True
        line_end = self._characters[0x0A]
        crossing = {re.escape(t[max(0, i - 2) : i + 1]) for t in vocabulary for m in marks if m in t for i in range(1, len(t)) if t[i] in marks}
        crossing |= {re.escape(t[i : i + 2]) for t in vocabulary if line_end in t for i in range(len(t) - 1) if t[i] == line_end}
        return begins, re.compile("|".join(sorted(crossing))) if crossing else None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that _WORD matches. The model gets WORDS of them at once, where no token of its vocabulary could cross their ends."""
        ids, text = array("I"), [p if p[0] == "\n" else f" {p}" for p in pieces]
        if not self._plain:
            return self._library(text)
        for i in range(0, len(text), WORDS):
            characters = charmap_decode("".join(text[i : i + WORDS]).encode(), "strict", self._characters)[0]
            if self._crossing and self._crossing.search(characters):
                return self._library(text)
            ids.extend([t.id for t in self._model.tokenize(characters)])
        begins = np.flatnonzero(self._begins[np.asarray(ids)])
        if len(begins) != len(text):
            return self._library(text)
        data, places = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces that aren't known. A piece that comes again soon becomes known, so that rare ones don't take its room."""
        young, known = self._young, self._known
        found = [young.pop(p, None) for p in pieces]
        if len(known) < self._max_pieces:
            known.update((p, x) for p, x in zip(pieces, found, strict=True) if x is not None)
        if len(young) > self._max_pieces:
            young.clear()
        new = [p for p, x in zip(pieces, found, strict=True) if x is None]
        words, other = [], []
        for p in new:
            (words if (p.isascii() and p.isalpha()) or _WORD.fullmatch(p) else other).append(p)
        young.update(zip(words, self._words(words), strict=True))
        young.update(zip(other, self._library([p if p[:1] == "\n" else p[1:] if p[:1] == _JOINED else f" {p}" for p in other]), strict=True))
        return [young[p] if x is None else x for p, x in zip(pieces, found, strict=True)]

    def many(self, texts: pa.Array | Sequence[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, without an end id; none for a null or empty text."""
        if not len(texts):
            return []
        collecting = gc.isenabled()
        gc.disable()  # many lists are made here, but no cycles
        try:
            return self._many(texts)
        finally:
            if collecting:
                gc.enable()

    def _many(self, texts: pa.Array | Sequence[str | None]) -> list[bytes]:
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = pc.fill_null(column, "")
        lines = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), column, pa.scalar("", pa.large_string()))
        whole = np.zeros(len(column), dtype=bool)
        for t in self._added:
            whole |= pc.match_substring(lines, t).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False) & ~whole
        lines = pc.replace_substring_regex(pc.if_else(pa.array(whole | odd), "\n", lines), _TAIL, rf"\1 {_JOINED}\2")
        cut = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")
        # Each list begins with an empty string; lists of odd texts follow those of all others.
        fields, ends = cut.flatten(), np.asarray(cut.offsets)[1:] - cut.offsets[0].as_py()
        starts, before = np.concatenate([[0], ends[:-1]]) + 1, {}
        if whole.any():
            rows = np.flatnonzero(whole).tolist()
            before.update(zip(rows, self._library([column[i].as_py() for i in rows]), strict=True))
        if odd.any():
            parts, at, firsts, rows = [], len(fields), [], np.flatnonzero(odd).tolist()
            for i in rows:
                first, *rest = _CUT.split(column[i].as_py())
                firsts.append(first)
                parts += ["\n", *(p if space or p[0] == "\n" else _JOINED + p for space, p in zip(rest[::2], rest[1::2], strict=True))]
                starts[i], ends[i] = at, at + 1 + len(rest) // 2
                at = ends[i]
            before.update(zip(rows, self._library(firsts), strict=True))
            fields = pa.concat_arrays([fields, pa.array(parts, pa.large_string())])
        coded = fields.dictionary_encode()
        ids = pc.take(pa.array(self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()), coded.indices)
        places, data = np.frombuffer(ids.buffers()[1], dtype=np.int64), memoryview(ids.buffers()[2])
        skip = len(self._line_end)
        out = [data[a:b].tobytes() for a, b in zip((places[starts] + skip).tolist(), places[ends].tolist(), strict=True)]
        for i, x in before.items():
            out[i] = x + out[i]
        return out

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(self._known.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(missing, self._encode([pieces[i] for i in missing]), strict=True):
            found[i] = x
        return found

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
