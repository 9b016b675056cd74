"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Adjacent symbol pairs wait in an agenda ordered by score, then by place; the best pair merges, and its new neighbours join the
agenda. A text is cut where no piece of the vocabulary can cross (before a run of spaces, around line ends), so each distinct
part is encoded once per task and kept in a bounded table, its ids as the bytes of 32-bit numbers. Every newly encoded part of an Arrow batch is checked against the
sentencepiece library; a difference raises.

Null and empty texts have no ids and decode to an empty text. Repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posetrail.llm import shared
from pyspark.sql import types as T

SPACE = "▁"
NEVER = np.int32(0x7FFFFFFF)
#: Symbols of the longest part that merges in a numpy matrix; longer ones use a heap.
SIDE_BY_SIDE = 40
#: Parts kept by a task; beyond that the table starts anew.
KEPT_PARTS = 150_000
#: Bytes of the texts of an output batch, and new parts encoded and checked at once.
BATCH_BYTES, NEW_PARTS = 400_000, 5_000

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Codec:
    """Encoder and decoder of one model file, given as bytes."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = proto.SentencePiece
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces) or trainer.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with identity normalisation, escaped blanks and a dummy prefix are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model) if check else None
        normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        self.ids = {p.piece: i for i, p in normal}
        #: Places in the order of merging; equal scores share one.
        order = {s: k for k, s in enumerate(sorted({p.score for _, p in normal}, reverse=True))}
        self.rank = {p.piece: order[p.score] for _, p in normal}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE} if trainer.byte_fallback else {}
        if any(SPACE in p.piece.lstrip(SPACE) or "\n" in p.piece for _, p in normal):
            raise ValueError("a piece crosses the places where texts are cut")
        self.raw = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.raw[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.BYTE:
                self.raw[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.raw[i] = trainer.unk_surface.encode()
        self.blank_first = {i for i, p in normal if p.piece[0] == SPACE}
        self.parts = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.kept: dict[str, bytes] = {}
        self._pair_table()

    def symbols_to_ids(self, symbols: list[str]) -> bytes:
        out = array("i")
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def _pair_table(self) -> None:
        """Sorted keys of the pairs of symbols that merge, with their ranks and the pieces they make."""
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], self.rank[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, rank, made = np.array(pairs, dtype=np.int64).reshape(-1, 4).T
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.pair_rank, self.made = keys[order], rank[order].astype(np.int32), made[order].astype(np.int32)
        chars = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
        self.chars, self.char_ids = np.array([c for c, _ in chars], dtype=np.uint32), np.array([i for _, i in chars], dtype=np.int32)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.pair_rank[at], NEVER), self.made[at]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Parts of known characters merge side by side, a pair of each per round; long and other parts one by one."""
        out: list = [None] * len(parts)
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        known = self.chars[at] == points
        ids, starts = self.char_ids[at], np.concatenate([[0], np.cumsum(lengths)])[:-1]
        plain = np.add.reduceat(known, starts) == lengths
        for low, high in ((0, 8), (8, 14), (14, 24), (24, SIDE_BY_SIDE)):
            chosen = np.flatnonzero(plain & (lengths > low) & (lengths <= high))
            for k in range(0, len(chosen), 5_000):
                some = chosen[k : k + 5_000]
                for i, row in zip(some.tolist(), self._side_by_side(ids, starts[some], lengths[some]), strict=True):
                    out[i] = row
        for i in np.flatnonzero(~plain | (lengths > SIDE_BY_SIDE)).tolist():
            out[i] = self.symbols_to_ids(self._long(list(parts[i])))
        return out

    def _side_by_side(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Each row is a part with its own agenda: the ranks of its adjacent pairs. A round merges the best pair, leftmost first, of each row."""
        out: list = [None] * len(starts)
        places = np.arange(int(lengths.max()))
        symbols = np.where(places < lengths[:, None], ids[np.minimum(starts[:, None] + places, len(ids) - 1)], -1)
        agenda, made = self._look_up(np.where(symbols[:, :-1] < 0, 0x7FFFFFFF, symbols[:, :-1]), np.where(symbols[:, 1:] < 0, 0x7FFFFFFF, symbols[:, 1:]))
        rows = np.arange(len(starts))

        def finished(done: np.ndarray) -> None:
            some = symbols[done].astype(np.int32, copy=False)
            data, width = some.tobytes(), 4 * some.shape[1]
            starts = range(0, width * len(some), width)
            for i, a, n in zip(rows[done].tolist(), starts, (4 * (some >= 0).sum(axis=1)).tolist(), strict=True):
                out[i] = data[a : a + n]

        while len(rows):
            if agenda.shape[1] == 0:
                finished(np.ones(len(rows), dtype=bool))
                break
            best = agenda.argmin(axis=1)
            going = agenda[np.arange(len(rows)), best] != NEVER
            if not going.all():
                finished(~going)
                rows, symbols, agenda, made, best = rows[going], symbols[going], agenda[going], made[going], best[going]
                if not len(rows):
                    break
            each, k = np.arange(len(rows)), best[:, None]
            piece = made[each, best]
            width = symbols.shape[1] - 1
            symbols = np.where(np.arange(width) < k, symbols[:, :-1], symbols[:, 1:])
            symbols[each, best] = piece
            agenda, made = (np.where(np.arange(width - 1) < k, x[:, :-1], x[:, 1:]) for x in (agenda, made))
            for near, mask in ((best - 1, best > 0), (best, best < width - 1)):
                r, c = each[mask], near[mask]
                right = symbols[r, c + 1]
                agenda[r, c], made[r, c] = self._look_up(symbols[r, c], np.where(right < 0, 0x7FFFFFFF, right))
        return out

    def _long(self, symbols: list[str]) -> list[str]:
        rank, n = self.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[p], k, p) for k in range(n - 1) if (p := symbols[k] + symbols[k + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, k, piece = heapq.heappop(agenda)
            right = after[k]
            if not symbols[k] or right >= n or symbols[k] + symbols[right] != piece:
                continue
            symbols[k], symbols[right] = piece, ""
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                if (p := piece + symbols[after[k]]) in rank:
                    heapq.heappush(agenda, (rank[p], k, p))
            if before[k] >= 0 and (p := symbols[before[k]] + piece) in rank:
                heapq.heappush(agenda, (rank[p], before[k], p))
        return [s for s in symbols if s]

    def split(self, text: str) -> list[str]:
        return self.parts.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [memoryview(x).cast("i").tolist() for x in self.encoded(texts)]

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit numbers."""
        split = [self.split(t) for t in texts]
        if len(self.kept) > KEPT_PARTS:
            self.kept = {}
        kept = self.kept
        new = list({p for parts in split for p in parts if p not in kept})
        for k in range(0, len(new), NEW_PARTS):
            some = new[k : k + NEW_PARTS]
            kept.update(zip(some, self.encode_parts(some), strict=True))
            if self.library is not None:
                self.checked(some)
        return [b"".join(map(kept.__getitem__, parts)) for parts in split]

    def checked(self, parts: list[str]) -> None:
        # the library puts a dummy prefix before a text, so a part without one follows a line end; no piece holds a line end
        lead = [p[1:] + "\n" if p[0] == SPACE else f"\n{p}\n" for p in parts]
        skip, end = [0 if p[0] == SPACE else 2 for p in parts], len(self.symbols_to_ids(["\n"])) // 4
        for p, k, ids in zip(parts, skip, self.library.encode(lead, num_threads=1), strict=True):
            if array("i", ids[k:-end]).tobytes() != self.kept[p]:
                raise ValueError(f"not as the sentencepiece library encodes it: {p[:80]!r}")

    def decode(self, ids: Sequence[int]) -> str:
        """Pieces joined, bytes of one run read as UTF-8 (each invalid byte: U+FFFD), without the dummy prefix."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "each_byte")
        return text[1:] if len(ids) and ids[0] in self.blank_first else text


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", check: bool = True) -> DataFrame:
    """docs with piece_ids array<int> and decoded string (such columns in docs are replaced); a narrow job, without a shuffle."""
    with open(model_path, "rb") as f:  # on the driver; the model (0.5 MB) travels with the tasks
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("piece_ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, check)
        for batch in batches:
            at, column = 0, batch.column(batch.schema.get_field_index(text))
            lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            while at < batch.num_rows:
                end, size = at + 1, lengths[at]
                while end < batch.num_rows and size + lengths[end] <= BATCH_BYTES:
                    size += lengths[end]
                    end += 1
                ids = codec.encoded([t or "" for t in column.slice(at, end - at).to_pylist()])
                part = batch.slice(at, end - at)
                decoded = pa.array([codec.decode(memoryview(x).cast("i")) for x in ids], pa.string())
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, decoded], names=[*part.schema.names, "piece_ids", "decoded"])
                at = end

    return docs.mapInArrow(shared.tidy(run), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of an encode_decode result."""
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
