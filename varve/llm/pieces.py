"""Piece encoding and decoding by a max-plus parallel scan.

The pieces of a SentencePiece model are used with the best-scoring segmentation: the sum of piece scores is
largest. A character that no piece covers is
written as its bytes. Giant texts are cut into chunks of at most CHUNK characters, each at the last place that no
piece crosses, if it has one. A chunk's transfer matrix has the best
score from each boundary state before it to each after it; a state is the number of characters that a piece begun
earlier still covers. Matrices are combined in blocks of FAN, level by level, up to one for each text; going down
again fixes the states between the chunks, and each chunk is then backtraced by itself.

A piece never runs past the place where a space follows another character, so stretches between such places are
segmented alone and remembered. Of equally good segmentations of a stretch the one with the shortest first piece that
differs is taken, whatever the chunk size; only a stretch of more than CHUNK characters has its own chunks, whose
states decide between equally good ones.

Rows: null counts as empty, and an empty text is the piece of its leading space. Repeated rows are encoded each
for itself. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

CHUNK, FAN = 1 << 16, 64
#: A BPE model's scores are negative ranks. They are read as logarithms (in millionths) of probabilities that fall
#: with the rank by Zipf's law, shifted by ZIPF; of the shifts tried, words come out most like the library's own merges.
ZIPF = 100
#: Score of a byte written for want of a piece, below any piece's.
BYTE_SCORE = -100_000_000
NEVER = -(1 << 60)
MOST_CACHED, ENDING = 300_000, 8
_stretch = re.compile(r" *[^ ]+| +").findall


class Pieces(dict):
    """A model. As a dict it remembers stretches: from their text to their ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.bytes: list[int] = [0] * 256
        texts = [b""] * model.get_piece_size()
        self.score_of = np.zeros(len(texts), np.int64)
        for k in range(len(texts)):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.bytes[value] = k
                texts[k], self.score_of[k] = bytes([value]), BYTE_SCORE
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                piece = piece.replace("▁", " ")
                if not re.search(r"[^ ] ", piece):  # true of models trained with split words
                    score = -round(1e6 * math.log(ZIPF - model.get_score(k)))
                    self.pieces[piece] = (k, score)
                    texts[k], self.score_of[k] = piece.encode(), score
        self.longest = max(map(len, self.pieces))
        self.ends: dict[str, tuple[int, int]] = {}
        #: Scores of pieces, and None for texts that only begin one.
        self.reach: dict[str, int | None] = {piece[:n]: None for piece in self.pieces for n in range(1, len(piece))}
        self.reach |= {piece: score for piece, (_, score) in self.pieces.items()}
        self._lengths = np.array([len(t) for t in texts], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._all = np.frombuffer(b"".join(texts), np.uint8)

    def best(self, text: str, starts: list[int], stop: int) -> tuple[list[int], list[int]]:
        """Best score of reaching each place, from places with the scores in starts (place 0 on), and the length
        of its last piece. Pieces begin before stop and may run past it."""
        size = len(text)
        best = starts + [NEVER] * (size + 1 - len(starts))
        back = [0] * (size + 1)
        reach = self.reach
        for at in range(stop):
            base = best[at]
            if base <= NEVER:
                continue
            end = at + 1
            if reach.get(text[at]) is None:
                value = base + BYTE_SCORE * len(text[at].encode("utf-8", "surrogatepass"))
                if value > best[end] or (value == best[end] and back[end] > 1):
                    best[end], back[end] = value, 1
            while end <= size:
                part = text[at:end]
                if part not in reach:
                    break
                score = reach[part]
                if score is not None:
                    value = base + score
                    if value > best[end] or (value == best[end] and back[end] > end - at):
                        best[end], back[end] = value, end - at
                end += 1
        return best, back

    def ids(self, text: str, back: list[int], end: int) -> bytes:
        out: list[int] = []
        while back[end]:
            part = text[end - back[end] : end]
            found = self.pieces.get(part)
            out.extend([found[0]] if found else [self.bytes[b] for b in reversed(part.encode("utf-8", "surrogatepass"))])
            end -= back[end]
        return np.array(out[::-1], "<i4").tobytes()

    def __missing__(self, stretch: str) -> bytes:
        """The best segmentation of a stretch, from its end to its beginning. The best scores and first pieces of
        short endings are remembered, since words share them; with an ending, all shorter ones of it are known."""
        size, reach, ends = len(stretch), self.reach, self.ends
        value, first = [0] * (size + 1), [0] * (size + 1)
        at = size
        for k in range(max(0, size - ENDING), size):
            if stretch[k:] in ends:
                at = k
                break
        for k in range(at, size):
            value[k], first[k] = ends[stretch[k:]]
        for k in range(at - 1, -1, -1):
            top, n, end = NEVER, 1, k + 1
            if reach.get(stretch[k]) is None:
                top = value[end] + BYTE_SCORE * len(stretch[k].encode("utf-8", "surrogatepass"))
            while end <= size:
                part = stretch[k:end]
                if part not in reach:
                    break
                score = reach[part]
                if score is not None and score + value[end] > top:
                    top, n = score + value[end], end - k
                end += 1
            value[k], first[k] = top, n
            if size - k <= ENDING and len(ends) < MOST_CACHED:
                ends[stretch[k:]] = top, n
        out: list[int] = []
        k = 0
        while k < size:
            part = stretch[k : k + first[k]]
            piece = self.pieces.get(part)
            out.extend([piece[0]] if piece else [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")])
            k += first[k]
        found = np.array(out, "<i4").tobytes()
        if len(self) < MOST_CACHED and size < 32:
            self[stretch] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _stretch(text)))

    def decode(self, ids: bytes | list[int]) -> bytes:
        """The text of the pieces, with its leading space."""
        ids = np.frombuffer(ids, "<i4") if isinstance(ids, bytes) else np.asarray(ids, np.int64)
        n = self._lengths[ids]
        ends = np.cumsum(n)
        return self._all[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._starts[ids] - ends + n, n)].tobytes()

    def _parts(self, text: str, size: int) -> tuple[int, int]:
        """The first and last place in the chunk that no piece crosses; -1 if there is none."""
        first = re.search(r"(?<=[^ ]) ", text[:size])
        if not first:
            return -1, -1
        last = size - 1
        while not (text[last] == " " and text[last - 1] != " "):
            last -= 1
        return first.start(), last

    def matrix(self, text: str, size: int) -> np.ndarray:
        """The chunk's transfer matrix. text: its size characters and those that its last pieces may cover."""
        wide = self.longest
        out = np.full((wide, wide), NEVER, np.int64)
        first, last = self._parts(text, size)

        def exits(best: list[int], at: int) -> np.ndarray:
            row = np.full(wide, NEVER, np.int64)
            reached = best[size - at : size - at + wide]
            row[: len(reached)] = reached
            return row

        if first < 0:
            for s in range(min(wide, size + 1)):
                out[s] = exits(self.best(text, [NEVER] * s + [0], size)[0], 0)
            for s in range(size + 1, wide):  # a piece begun earlier covers the whole chunk
                out[s, s - size] = 0
            return out
        middle = int(self.score_of[np.frombuffer(self.encode(text[first:last]), "<i4")].sum())
        tail = exits(self.best(text[last:], [0], size - last)[0], last)
        for s in range(min(wide, first + 1)):
            head = self.best(text[:first], [NEVER] * s + [0], first)[0][first]
            out[s] = np.where(tail > NEVER, head + middle + tail, NEVER)
        return out

    def backtrace(self, text: str, size: int, enter: int, leave: int) -> bytes:
        first, last = self._parts(text, size)
        if first < 0:
            if enter > size:
                return b""
            return self.ids(text, self.best(text, [NEVER] * enter + [0], size)[1], size + leave)
        # a chunk that begins or ends between two stretches is segmented there like any other text
        starts = enter == 0 and text[0] == " "
        ends = leave == 0 and (size == len(text) or (text[size] == " " and text[size - 1] != " "))
        head = b"" if starts else self.ids(text[:first], self.best(text[:first], [NEVER] * enter + [0], first)[1], first)
        tail = b"" if ends else self.ids(text[last:], self.best(text[last:], [0], size - last)[1], size + leave - last)
        return head + self.encode(text[0 if starts else first : size if ends else last]) + tail


_models: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NEVER)


def states(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The states between the matrices on the best path from enter to leave, both included."""
    row = np.full(len(matrices[0]), NEVER, np.int64)
    row[enter] = 0
    reached = [row]
    for m in matrices:
        reached.append(np.maximum((reached[-1][:, None] + m).max(0), NEVER))
    out = [leave]
    for m, row in zip(reversed(matrices), reversed(reached[:-1])):
        out.append(int(np.argmax(row + m[:, out[-1]])))
    return out[::-1]


def _up(level: DataFrame, wide: int) -> DataFrame:
    """Blocks of FAN matrices combined: rid, k, matrix."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        product = None
        for m in table["matrix"].to_pylist():
            m = np.frombuffer(m, np.int64).reshape(wide, wide)
            product = m if product is None else times(product, m)
        return pa.table({"rid": table["rid"].slice(0, 1), "k": pa.array([table["k"][0].as_py() // FAN], pa.int64()), "matrix": pa.array([product.tobytes()], pa.binary())})

    return level.groupBy("rid", F.expr(f"k div {FAN}").alias("block")).applyInArrow(run, "rid long, k long, matrix binary")


def _down(level: DataFrame, above: DataFrame, wide: int) -> DataFrame:
    """States before and after each matrix of a level, from those of the blocks above: rid, k, enter, leave."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        ms = [np.frombuffer(m, np.int64).reshape(wide, wide) for m in table["matrix"].to_pylist()]
        path = states(ms, table["enter"][0].as_py(), table["leave"][0].as_py())
        return pa.table({"rid": table["rid"], "k": table["k"], "enter": pa.array(path[:-1], pa.int32()), "leave": pa.array(path[1:], pa.int32())})

    both = level.withColumn("block", F.expr(f"k div {FAN}")).join(above.withColumnRenamed("k", "block"), ["rid", "block"])
    return both.select("rid", "block", "k", "matrix", "enter", "leave").groupBy("rid", "block").applyInArrow(run, "rid long, k long, enter int, leave int")


def _chunked(giants: DataFrame, chunk: int, longest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for rid, doc, text in zip(*(x.column(c).to_pylist() for c in range(3))):
                text = " " + text
                at = k = 0
                while at < len(text):
                    size = min(chunk, len(text) - at)
                    if at + size < len(text):
                        place = at + size
                        while place > at and not (text[place] == " " and text[place - 1] != " "):
                            place -= 1
                        size = place - at or size
                    yield pa.record_batch([pa.array([rid], pa.int64()), pa.array([doc], x.schema.field(1).type), pa.array([k], pa.int64()), pa.array([size], pa.int32()), pa.array([text[at : at + size + longest - 1]], pa.string())], names=["rid", "doc_id", "k", "size", "text"])
                    at, k = at + size, k + 1

    return giants.mapInArrow(run, f"rid long, doc_id {dict(giants.dtypes)['doc_id']}, k long, size int, text string")


SCHEMA = "rid long, k long, n_chars long, exact boolean, ids array<int>"


def _encoded(p: Pieces, doc_id: pa.Array, rid: pa.Array, k: pa.Array, covered: list[str], ids: list[bytes]) -> pa.RecordBatch:
    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
    offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
    exact = [p.decode(i) == t.encode("utf-8", "surrogatepass") for t, i in zip(covered, ids)]
    return pa.record_batch([doc_id, rid, k, pa.array(list(map(len, covered)), pa.int64()), pa.array(exact, pa.bool_()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "rid", "k", "n_chars", "exact", "ids"])


def encode(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """Rows doc_id, rid (one for each row of docs), k (chunk), n_chars (characters that the ids stand for, with the
    leading space of the first chunk), exact (the ids decode to just those), ids. Texts of more than `chunk`
    characters have several rows."""
    kind = dict(docs.dtypes)["doc_id"]
    wide = pieces_of(model).longest
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small = rows.filter(F.length("text") < chunk).select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    giant = rows.filter(F.length("text") >= chunk).withColumn("rid", -1 - F.monotonically_increasing_id()).select("rid", "doc_id", "text")
    schema = f"doc_id {kind}, {SCHEMA}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                texts = [" " + t for t in part.column(1).to_pylist()]
                yield _encoded(p, part.column(0), part.column(2), pa.array([0] * len(texts), pa.int64()), texts, list(map(p.encode, texts)))

    done = small.mapInArrow(whole, schema)
    chunks = cut(_chunked(giant, chunk, wide), "chunks").repartition("rid", "k")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for x in batches:
            ms = [p.matrix(t, s).tobytes() for t, s in zip(x.column(3).to_pylist(), x.column(2).to_pylist())]
            yield pa.record_batch([x.column(0), x.column(1), pa.array(ms, pa.binary())], names=["rid", "k", "matrix"])

    levels = [cut(chunks.select("rid", "k", "size", "text").mapInArrow(transfer, "rid long, k long, matrix binary"), "level")]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) > 0:
        levels.append(cut(_up(levels[-1], wide), "level"))
    found = levels.pop().select("rid", "k", F.lit(0).alias("enter"), F.lit(0).alias("leave"))
    while levels:
        found = cut(_down(levels.pop(), found, wide), "states")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for x in batches:
            c = [x.column(k).to_pylist() for k in range(x.num_columns)]
            ids = [p.backtrace(t, s, a, b) for t, s, a, b in zip(c[4], c[3], c[5], c[6])]
            covered = [t[a : max(a, s + b)] for t, s, a, b in zip(c[4], c[3], c[5], c[6])]
            yield _encoded(p, x.column(1), x.column(0), x.column(2), covered, ids)

    traced = chunks.join(found, ["rid", "k"]).select("rid", "doc_id", "k", "size", "text", "enter", "leave").mapInArrow(trace, schema)
    return done.unionByName(traced)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """One row per text: doc_id, rid, text. Each chunk is decoded by itself; a text's chunks are joined in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for x in batches:
            texts = [p.decode(i).decode("utf-8", "surrogatepass") for i in x.column(3).to_pylist()]
            yield pa.record_batch([x.column(0), x.column(1), x.column(2), pa.array(texts, pa.string())], names=["doc_id", "rid", "k", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    parts = encoded.select("doc_id", "rid", "k", "ids").mapInArrow(run, f"doc_id {kind}, rid long, k long, text string")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "")
    return parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.substring(text, 2, 2**31 - 1).alias("text")).select("doc_id", "rid", "text")


def round_trip(encoded: DataFrame) -> DataFrame:
    """One row per text: doc_id, n_chars, n_pieces, n_chunks, ids_hash, exact (the pieces of every chunk decode to
    the characters that they stand for)."""
    out = encoded.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), (F.sum("n_chars") - 1).alias("n_chars"), F.sum(F.size("ids")).alias("n_pieces"), F.count(F.lit(1)).alias("n_chunks"), F.bit_xor(F.xxhash64("k", "ids")).alias("ids_hash"), F.bool_and("exact").alias("exact"),
    )
    return out.drop("rid")
