"""Whole-text token ids from a public tokenizer file, for the packing and output operators.

A text is cut where no token of the vocabulary can cross. The ids of each distinct chunk come
from the tokenizer once and stay in a bounded per-worker cache, as little-endian 32-bit bytes, so
a document is one ``join`` over its chunks. Byte-level texts are encoded in groups: a chunk is
looked up once per group. The result is the tokenizer's own, id for id.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

from shelfwise.llm.common import Recent

#: Chunks held per worker and generation (about 140 bytes each; two generations).
CACHE_CHUNKS = 250_000
#: Unseen chunks that go through the model as one string. Its merges are queued, so longer ones are slower.
LEARN_CHUNKS = 300

ID_BYTES = 4
#: A full stop or comma after a letter or digit is a pre-token of its own in both vocabularies,
#: so it is cut off and a word is learnt once, however it ends. After anything else it may belong
#: to a longer run: then nothing is cut off in the text.
_ENDS = (". ", ", ", ".\n", ",\n")
#: (The mark comes first in the pattern, so a text is scanned for it alone.)
_NO_CUT = re.compile(r"[.,](?<![^\W_].)[ \n]")
#: Begins a chunk that had no space before it; byte-level chunks keep the space that cut them.
_MARK = "\x00"
_NO_SPACE = " " + _MARK
#: White space that may join its neighbours in one byte-level token, or the mark: such texts go
#: whole.
_WHOLE = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x00")
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow
    from code point 256 on (fixed by the tokenizer files)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()
_SPACE = _ALPHABET[0x20]
#: Stands for a byte that no text holds.
_GAP = _ALPHABET[0xFF]


class ChunkEncoder:
    """``kind``: "word" (white space is dropped, so any ASCII white space is a cut) or "byte"
    (a space belongs to the chunk after it). ``added_tokens``: the file's added tokens in a text
    get their own ids, as by the library's default (such a text goes whole); else they are
    ordinary text."""

    def __init__(
        self, path: str, kind: str, cache_chunks: int = CACHE_CHUNKS, added_tokens: bool = False
    ):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Chunks are ordinary text: lower-casing may make an added token of what was none.
        self.tokenizer.encode_special_tokens = True
        tokens = self.tokenizer.get_added_tokens_decoder().values() if added_tokens else ()
        self.added = tuple(t.content for t in tokens)
        self.model = self.tokenizer.model
        #: The model alone: nothing is cut into pre-tokens or put in the byte-level alphabet.
        self.bare = Tokenizer(self.model)
        self.kind = kind
        self.chunks = Recent(self._learn, cache_chunks)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.packed = [i.to_bytes(ID_BYTES, "little") for i in range(size)]
        #: Whether the token of an id begins with a space.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(size, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        #: The id of the gap, if no token holds it beside others: then no token crosses it.
        gaps = [i for token, i in vocabulary.items() if _GAP in token]
        self.gap = gaps[0] if len(gaps) == 1 and _GAP in vocabulary else None

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([self.packed[i] for i in ids])

    def _with_added(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = False
        try:
            return self.whole(text)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _learn(self, chunk: bytes) -> bytes:
        """Ids of a chunk. A run of letters is one pre-token, which the model takes as it is."""
        text = chunk.decode()
        if self.kind == "byte":
            return self.whole(text.removeprefix(_NO_SPACE))
        if not text.isascii() and (set("Σİ") & set(text) or not unicodedata.is_normalized("NFC", text)):
            return self.whole(text)
        if not text.isalpha():
            return self.whole(text)
        text = text.lower()
        # ASCII letters stand for themselves; other letters are byte by byte.
        shown = text if text.isascii() else "".join(map(_ALPHABET.__getitem__, text.encode()))
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(shown)])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: none) as little-endian unsigned 32-bit integers."""
        if self.kind == "byte":
            return self.encode_all([text])[0]
        if not text:
            return b""
        if any(x in text for x in self.added):
            return self._with_added(text)
        cut = self._ends_cut(text, " ")
        return b"".join(map(self.chunks.__getitem__, cut.encode().lower().split()))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        if self.kind == "word":
            return list(map(self.encode, texts))
        found, cut = [b""] * len(texts), {}
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.added):
                found[k] = self._with_added(text)
            elif (
                text[0] in " \n"
                or text[-1] in " \n"
                or any(x in text for x in _WHOLE)
                or (not text.isascii() and _WIDE_SPACE.search(text))
            ):
                found[k] = self.whole(text)
            else:
                ends = self._ends_cut(text, _NO_SPACE).replace("\n", f"{_NO_SPACE}\n{_NO_SPACE}")
                cut[k] = (_NO_SPACE + ends).encode()
        if cut:
            for k, ids in zip(cut, self._joined(list(cut.values()))):
                found[k] = ids
        return found

    def _joined(self, cut: list[bytes]) -> Iterator[bytes]:
        """Ids of texts in which each chunk begins with the only space it holds."""
        data = b"".join(cut)
        starts = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
        buffers = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._ids_of(distinct), pa.large_binary()).take(chunks.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)
        texts = np.searchsorted(starts, np.cumsum([0, *map(len, cut)]))
        bounds, joined = ends[texts].tolist(), memoryview(ids.buffers()[2])
        return (bytes(joined[a:b]) for a, b in pairwise(bounds))

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        found = list(map(self.chunks.get, chunks))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            learnt = self._learn_together([chunks[k] for k in missing])
            for k in missing:
                found[k] = learnt[chunks[k]]
        return found

    def _learn_together(self, unseen: list[bytes]) -> dict[bytes, bytes]:
        """Ids of unseen chunks. Runs of letters go to the model with gaps between them; marks after one are
        a pre-token of their own. Others with a space before them go through the tokenizer as one text: no
        token crosses from one to the next, and each begins with the only token that begins with a space,
        so the ids fall apart again."""
        older, known = self.chunks.older, {}
        runs, shown, tails, spaced = [], [], [], []
        for chunk in unseen:
            if chunk in older:
                known[chunk] = older[chunk]
                continue
            text = chunk.decode()
            marked = text.startswith(_NO_SPACE)
            run = text[2:] if marked else text[1:]
            tail = b""
            if not run.isalpha():
                letters = run.rstrip(string.punctuation)
                if letters.isalpha():
                    tail = self.chunks[(_NO_SPACE + run[len(letters) :]).encode()]
                run = letters
            if self.gap is not None and run.isalpha():
                # ASCII letters stand for themselves, other letters are byte by byte.
                letters = run if run.isascii() else "".join(map(_ALPHABET.__getitem__, run.encode()))
                runs.append(chunk)
                shown.append(letters if marked else _SPACE + letters)
                tails.append(tail)
            elif marked:
                known[chunk] = self._learn(chunk)
            else:
                spaced.append(chunk)
        if runs:
            joined = [_GAP.join([*shown[k : k + LEARN_CHUNKS], ""]) for k in range(0, len(shown), LEARN_CHUNKS)]
            ids = self._ids(self.bare, joined)
            ends = np.flatnonzero(ids == self.gap)
            known.update(zip(runs, map(bytes.__add__, _parts(ids, np.append(0, ends[:-1] + 1), ends), tails)))
        if spaced:
            ids = self._ids(self.tokenizer, [b"".join(spaced).decode()])
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(spaced):
                known.update(zip(spaced, _parts(ids, starts, np.append(starts[1:], len(ids)))))
            else:
                known |= {chunk: self._learn(chunk) for chunk in spaced}
        self.chunks.put_all(known)
        return known

    def _ids(self, tokenizer, texts: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.array(x.ids, dtype="<u4") for x in found])

    def _ends_cut(self, text: str, by: str) -> str:
        if not _NO_CUT.search(text):
            for end in _ENDS:
                text = text.replace(end, by + end)
        return text


def _parts(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    data = ids.tobytes()
    return (data[a:b] for a, b in zip((starts * ID_BYTES).tolist(), (ends * ID_BYTES).tolist()))


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, kind: str) -> ChunkEncoder:
    """The worker's encoder for a file; kept between the tasks that one Python worker runs."""
    key = (path, kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, kind, added_tokens=True)
    return _ENCODERS[key]
