"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an arc for every vocabulary piece that matches at a position, with the
piece's score; a path's score is the sum over its pieces. Forward Viterbi gives the best score
from the start to every position. Going backwards from the end, that score is the exact
cost still to come, so A* search takes paths off its queue in order of their total score and the
first N to reach the start are the N best.

No piece goes on after a space once it has other characters, so the lattice of a text is a chain
of chunk lattices. Each distinct chunk is searched once per worker while it is in use; the N best
of a text combine the chunks' lists: all best, then best-first over the N - 1 chunks whose second
path costs least (no other chunk can add one of the N best).

Characters without a piece become their UTF-8 byte pieces, at a fixed penalty below all scores.
Ties: in a chunk, by the piece ids compared from the last piece backwards; between chunks, the
earlier chunk changes first. A text is encoded with a space put before it, which decoding removes,
so decoding any of the N gives the text back.

Defined cases: null and empty texts have one segmentation without pieces, score 0; a text with
fewer than N segmentations has fewer rows; repeated rows are documents of their own; a null
doc_id is carried along; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import Recent, in_small_batches, tidied

N_BEST = 3
#: Chunks held per worker and generation (about 300 bytes each; two generations).
CACHE_CHUNKS = 400_000
#: Bytes of ids that a worker gathers before it hands them on.
FLUSH_BYTES = 4 << 20
ID_BYTES = 4
PENALTY = 10.0
_UNUSED = -1e8  # pieces scored below it are never a reason to lower the unknown score
_NONE = float("-inf")
_CHUNK = re.compile(" *[^ \n]+|\n| +")


class _Path:
    """The ids of a path from the end of a text backwards, as a chain of arcs; paths share their tails.

    Two paths of the same score are compared where they part. ``jump`` leads far back, at distances that
    double, so that place is found in a logarithmic number of steps however long the text is."""

    __slots__ = ("arc", "after", "depth", "jump")

    def __init__(self, arc: tuple[int, ...], after: _Path | None):
        self.arc, self.after = arc, after
        if after is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = after.depth + 1
            far = after.jump
            self.jump = far.jump if after.depth - far.depth == far.depth - far.jump.depth else after

    def ids(self) -> tuple[int, ...]:
        arcs, path = [], self
        while path is not None:
            arcs.append(path.arc)
            path = path.after
        return tuple([i for arc in reversed(arcs) for i in arc])

    def _up(self, depth: int) -> _Path:
        path = self
        while path.depth > depth:
            path = path.jump if path.jump.depth >= depth else path.after
        return path

    def __lt__(self, other: _Path) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self._up(depth), other._up(depth)
        if a is b:
            return self.depth < other.depth
        while a.after is not b.after:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.after, b.after)
        return a.arc < b.arc


class Pieces:
    """Vocabulary of a model file: piece text (with plain spaces) -> id and score."""

    def __init__(self, path: str, n_best: int = N_BEST, cache_chunks: int = CACHE_CHUNKS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.n_best = n_best
        self.texts: list[bytes] = []
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i).replace("▁", " ")
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.texts.append(b"")
            else:
                self.ids[piece] = (i, model.get_score(i))
                self.texts.append(piece.encode())
        self.packed = [i.to_bytes(ID_BYTES, "little") for i in range(size)]
        self.root = self._tree()
        self.longest = max(map(len, self.ids), default=1)
        #: Neighbours that some piece holds; a lattice falls apart between any other two.
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        scores = [s for _, s in self.ids.values() if s > _UNUSED]
        self.unknown = min(scores, default=0.0) - PENALTY
        self.single = Recent(self._bytes_arc, 10_000)
        self.chunks = Recent(self._summary, cache_chunks)
        self.parts = Recent(self._search, cache_chunks // 2)
        self.lists = Recent(lambda chunk: self.nbest(chunk, n_best), cache_chunks // 10)

    def _tree(self) -> dict:
        """Children by character; under "" the arc (score, ids, packed ids) of the piece that ends here."""
        root: dict = {}
        for piece, (i, score) in self.ids.items():
            node = root
            for character in piece:
                node = node.setdefault(character, {})
            node[""] = (score, (i,), self.packed[i])
        return root

    def _bytes_arc(self, character: str) -> tuple[float, tuple[int, ...], bytes]:
        """The arc of a character without a piece."""
        ids = tuple([self.bytes[b] for b in character.encode()])
        return self.unknown, ids, self._pack(ids)

    def _from(self, text: str, start: int):
        """The arcs that start at a position: end, score, ids."""
        node, end, found = self.root, start, []
        for character in text[start : start + self.longest]:
            node = node.get(character)
            if node is None:
                break
            end += 1
            arc = node.get("")
            if arc is not None:
                found.append((end, *arc[:2]))
        if not found or found[0][0] != start + 1:
            found.append((start + 1, *self.single[text[start]][:2]))
        return found

    def arcs(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Per end position, the arcs that end there: start, score, ids."""
        into: list[list] = [[] for _ in range(len(text) + 1)]
        for start in range(len(text)):
            for end, score, ids in self._from(text, start):
                into[end].append((start, score, ids))
        return into

    def nbest(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of one lattice, best first."""
        arcs = self.arcs(text)
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max([best[start] + score for start, score, _ in arcs[end]]))
        # Entries: minus the total score, the path, position, score after it.
        queue: list[tuple[float, _Path, int, float]] = [(-best[-1], _Path((), None), len(text), 0.0)]
        out: list[tuple[float, tuple[int, ...]]] = []
        while queue and len(out) < n:
            _, path, at, after = heapq.heappop(queue)
            if not at:
                out.append((after, path.ids()[::-1]))
                continue
            for start, score, ids in arcs[at]:
                total = after + score
                heapq.heappush(queue, (-(best[start] + total), _Path(ids[::-1], path), start, total))
        return out

    def _pack(self, ids: tuple[int, ...]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def _search(self, part: str) -> tuple[bytes, float, float]:
        """Best ids and score of a lattice, and what its second path costs, without a queue: forward
        Viterbi that keeps the two best scores of each position."""
        n, root, longest, single = len(part), self.root, self.longest, self.single
        best, second, last = [0.0] + [_NONE] * n, [_NONE] * (n + 1), [None] * (n + 1)
        for start in range(n):
            first, other = best[start], second[start]
            node, end, alone = root, start, False
            for character in part[start : start + longest]:
                node = node.get(character)
                if node is None:
                    break
                end += 1
                if "" not in node:
                    continue
                arc = node[""]
                if end == start + 1:
                    alone = True
                score = first + arc[0]
                if score > best[end]:
                    second[end] = max(best[end], other + arc[0])
                    best[end], last[end] = score, (start, arc)
                elif score >= second[end]:
                    # Of equally good arcs the one A* takes first.
                    if score == best[end] and arc[1][::-1] < last[end][1][1][::-1]:
                        last[end] = (start, arc)
                    second[end] = score
            if not alone:
                arc, end = single[part[start]], start + 1
                score = first + arc[0]
                if score > best[end]:
                    second[end] = max(best[end], other + arc[0])
                    best[end], last[end] = score, (start, arc)
                elif score >= second[end]:
                    if score == best[end] and arc[1][::-1] < last[end][1][1][::-1]:
                        last[end] = (start, arc)
                    second[end] = score
        at, packed = n, []
        while at:
            at, arc = last[at]
            packed.append(arc[2])
        cost = best[n] - second[n] if second[n] > _NONE and self.n_best > 1 else float("inf")
        return b"".join(packed[::-1]), best[n], cost

    def _summary(self, chunk: str) -> tuple[bytes, float, float]:
        """The same of a chunk, from the parts it falls into."""
        pairs = self.pairs
        cuts = [k for k, pair in enumerate(map(operator.add, chunk, chunk[1:]), 1) if pair not in pairs]
        if not cuts:
            return self._search(chunk)
        found = [self.parts[chunk[a:b]] for a, b in zip([0, *cuts], [*cuts, len(chunk)])]
        ids, scores, costs = zip(*found)
        return b"".join(ids), sum(scores), min(costs)

    def encode(self, text: str | None) -> list[tuple[float, bytes]]:
        """The N best (score, ids as little-endian 32-bit integers) of a text."""
        if not text:
            return [(0.0, b"")]
        text = " " + text
        if "  " in text or "\n" in text:
            chunks = _CHUNK.findall(text)
        else:
            chunks = [" " + x for x in text[1:].split(" ")]
        ids, scores, costs = zip(*map(self.chunks.__getitem__, chunks))
        score = sum(scores)
        out = [(score, b"".join(ids))]
        if self.n_best == 1:
            return out
        cheap = sorted(range(len(costs)), key=costs.__getitem__)[: self.n_best - 1]
        cheap = sorted(i for i in cheap if costs[i] < float("inf"))
        lists = {i: self.lists[chunks[i]] for i in cheap}
        for lost, choice in self._combined([lists[i] for i in cheap]):
            changed = list(ids)
            for i, nth in zip(cheap, choice):
                if nth:
                    changed[i] = self._pack(lists[i][nth][1])
            out.append((score - lost, b"".join(changed)))
        return out

    def _combined(self, lists: list[list[tuple[float, tuple[int, ...]]]]):
        """Best-first (loss, path number per list), without the all-best choice."""
        base = (0,) * len(lists)
        queue, seen, out = [(0.0, tuple(-c for c in base), base)], {base}, []
        while queue and len(out) < self.n_best:
            lost, _, choice = heapq.heappop(queue)
            out.append((lost, choice))
            for i, nth in enumerate(choice):
                after = (*choice[:i], nth + 1, *choice[i + 1 :])
                if nth + 1 < len(lists[i]) and after not in seen:
                    seen.add(after)
                    more = lost + lists[i][nth][0] - lists[i][nth + 1][0]
                    heapq.heappush(queue, (more, tuple(-c for c in after), after))
        return out[1:]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        numbers = memoryview(ids).cast("I").tolist()
        data = b"".join(map(self.texts.__getitem__, numbers))
        return data.removeprefix(b" ").decode(errors="replace")


_PIECES: dict[tuple[str, int], Pieces] = {}


def pieces(path: str, n_best: int = N_BEST) -> Pieces:
    """The worker's vocabulary of a model file."""
    if (path, n_best) not in _PIECES:
        _PIECES[path, n_best] = Pieces(path, n_best)
    return _PIECES[path, n_best]


_FIELDS = [("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("ids", pa.binary())]
_SCHEMA = "doc_id long, rank int, score double, ids binary"


def _record(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields)], [name for name, _ in fields]
    )


def encode_nbest(
    documents: DataFrame,
    model_path: str,
    n_best: int = N_BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """doc_id, rank (1 is best), score, ids (little-endian unsigned 32-bit integers); with
    ``decoded`` also what the ids decode to, made where they are (see :func:`decode_ids`)."""
    fields = [*_FIELDS, ("decoded", pa.string())] if decoded else _FIELDS

    @tidied
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path, n_best)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for rank, (score, ids) in enumerate(model.encode(text.as_py()), 1):
                    row = (doc_id, rank, score, ids)
                    rows.append((*row, model.decode(ids)) if decoded else row)
                    held += len(ids)
                if held > FLUSH_BYTES:
                    yield _record(rows, fields)
                    rows, held = [], 0
            yield _record(rows, fields)

    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("full_text"))
    return in_small_batches(chosen).mapInArrow(encode, _SCHEMA + (", decoded string" if decoded else ""))


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """The columns of ``encode_nbest`` and the decoded text."""
    names = [name for name, _ in _FIELDS] + ["decoded"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            decoded = [model.decode(x.as_py()) for x in batch.column(3)]
            arrays = [*batch.columns, pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    chosen = encoded.select("doc_id", "rank", "score", "ids")
    return chosen.mapInArrow(decode, _SCHEMA + ", decoded string")


def op6_piece_nbest(spark, sf_dir: str) -> DataFrame:
    """doc_id, rank, score, n_tokens, ids_crc32, decoded_sha256 (of the decoded text)."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_nbest(documents, path, decoded=True).select(
        "doc_id",
        "rank",
        "score",
        (F.octet_length("ids") / ID_BYTES).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
