"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut before each run of spaces, and then between characters that stand side by side in no
piece of the vocabulary. No merge can cross such a cut, so every chunk is encoded on its own and
remembered. In a chunk an agenda of the adjacent symbol pairs that form a piece is ordered by score,
then position; the best pair is merged and its neighbours are entered. Short chunks keep the agenda as
a list, long ones as a heap whose stale entries are skipped. Symbols left without a piece become byte
pieces, or the unknown id.

Every chunk that the agenda encodes is also encoded by the sentencepiece library, one call for the new
chunks of each Arrow batch; a difference stops the job rather than reaching the result.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any length
are encoded whole; rows are independent, so repeated rows, null ids and empty tables need no care.
Only the two named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
CACHE_CHUNKS = 600_000
LONGEST_CACHED = 48
LONGEST_LISTED = 64
NEVER = float("inf")
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary:
    """Pieces of a model file, given as bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a merge-type vocabulary without text normalisation is needed")
        if trainer.treat_whitespace_as_suffix or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("space suffixes, user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.merges = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.cost = {piece: cost for piece, (cost, _) in self.merges.items()}
        self.beside = {piece[i : i + 2] for piece in self.merges for i in range(len(piece) - 1)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        if any(SPACE in p.lstrip(SPACE) for p in self.merges):
            raise ValueError("a piece holds a space after another character")
        surface = trainer.unk_surface.encode()
        self.surface = {}
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                out = bytes([int(p.piece[3:5], 16)])
            elif p.type == NORMAL:
                out = p.piece.replace(SPACE, " ").encode()
            else:
                out = surface if p.type == UNKNOWN else b""
            self.surface[str(i)] = out
        self.strip = len(self.prefix)

    def parts(self, chunk: str) -> list[str]:
        """Parts of a chunk that no merge can join."""
        beside, start, out = self.beside, 0, []
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in beside:
                out.append(chunk[start:i])
                start = i
        out.append(chunk[start:])
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        symbols = self.listed(chunk) if len(chunk) <= LONGEST_LISTED else self.heaped(chunk)
        ids = []
        for s in symbols:
            found = self.merges.get(s)
            if found:
                ids.append(found[1])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in s.encode("utf-8", "replace"))
            else:
                ids.append(self.unknown)
        return ids

    def listed(self, chunk: str) -> list[str]:
        """Symbols after all merges; the agenda is the list of the scores of adjacent pairs."""
        cost, symbols = self.cost.get, list(chunk)
        agenda = [cost(chunk[i : i + 2], NEVER) for i in range(len(chunk) - 1)]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def heaped(self, chunk: str) -> list[str]:
        """Symbols after all merges; the agenda is a heap."""
        merges = self.merges
        n = len(chunk)
        symbol = list(chunk)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(chunk[i : i + 2])
            if found:
                heap.append((found[0], i, 2))
        heapq.heapify(heap)
        while heap:
            _, left, size = heapq.heappop(heap)
            right = after[left]
            # stale: one of the two symbols was merged since, so the pair no longer has this length
            if not symbol[left] or right >= n or len(symbol[left]) + len(symbol[right]) != size:
                continue
            symbol[left] += symbol[right]
            symbol[right] = ""
            after[left] = end = after[right]
            if end < n:
                before[end] = left
                found = merges.get(symbol[left] + symbol[end])
                if found:
                    heapq.heappush(heap, (found[0], left, len(symbol[left]) + len(symbol[end])))
            start = before[left]
            if start >= 0:
                found = merges.get(symbol[start] + symbol[left])
                if found:
                    heapq.heappush(heap, (found[0], start, len(symbol[start]) + len(symbol[left])))
        return [s for s in symbol if s]


class Codec(dict):
    """Encodes and decodes whole texts; maps each chunk to its comma-joined ids."""

    def __init__(self, model: bytes):
        import sentencepiece

        super().__init__()
        self.vocabulary = Vocabulary(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.lead = "\n"
        self.lead_ids = ",".join(map(str, self.library.encode(self.lead)))
        self.fresh: dict[str, str] = {}
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __missing__(self, chunk: str) -> str:
        parts = self.vocabulary.parts(chunk)
        if len(parts) > 1:
            ids = ",".join([self[p] for p in parts])
        else:
            ids = ",".join(map(str, self.vocabulary.encode_chunk(chunk)))
            self.fresh[chunk] = ids
        if len(chunk) <= LONGEST_CACHED:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = ids
        if len(self.fresh) >= 20_000 or len(chunk) > 100_000:
            self.check()
        return ids

    def check(self) -> None:
        """Compare what the agenda encoded since the last check with the library."""
        if not self.fresh:
            return
        drop = len(self.vocabulary.prefix)
        # the prefix alone cannot be written as a text for the library; it is a single piece
        starts = [c for c in self.fresh if c.startswith(self.vocabulary.prefix) and len(c) > drop]
        inner = [c for c in self.fresh if not c.startswith(self.vocabulary.prefix)]
        # a part from within a text is put after a line feed, to which nothing of it is joined
        inner = [c for c in inner if self.lead[-1] + c[0] not in self.vocabulary.beside]
        sent = [c[drop:] for c in starts] + [self.lead + c for c in inner]
        for chunk, ids in zip(starts + inner, self.library.encode(sent, num_threads=1)):
            found = ",".join(map(str, ids))
            if found != (self.fresh[chunk] if chunk[:drop] == self.vocabulary.prefix else f"{self.lead_ids},{self.fresh[chunk]}"):
                raise ValueError(f"the agenda and the library differ on {chunk[:80]!r}")
        self.fresh = {}

    def encode(self, text: str) -> str:
        """Comma-joined ids of a whole text."""
        if not text:
            return ""
        whole = self.vocabulary.prefix + text.replace(" ", SPACE)
        return ",".join([self[c] for c in self.cut.findall(whole)])

    def decode(self, ids: str) -> str:
        """Text of comma-joined ids."""
        if not ids:
            return ""
        out = b"".join(map(self.vocabulary.surface.__getitem__, ids.split(",")))
        if self.vocabulary.strip and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


CODECS: dict[str, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for each Python worker, kept from task to task."""
    key = hashlib.sha256(model).hexdigest()
    if key not in CODECS:
        CODECS[key] = Codec(model)
    return CODECS[key]


def encode_documents(
    df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", outputs: str = "digest", keep: Sequence[str] = ()
) -> DataFrame:
    """Encode the texts of ``df``: one row per row, with the id column first.

    ``outputs="digest"`` gives n_tokens and the digests of ids and decoded text; ``outputs="ids"``
    gives n_tokens, the ids and the decoded text. Columns named in ``keep`` stay, behind the others.
    """
    with open(model_file, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB
    digest = outputs == "digest"

    def encode(batches):
        tool = codec(model.value)
        for batch in batches:
            ids, decoded, counts = [], [], []
            for text in batch.column(1):
                found = tool.encode(text.as_py() or "")
                back = tool.decode(found)
                counts.append(found.count(",") + 1 if found else 0)
                if digest:
                    ids.append(hashlib.sha256(found.encode()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                else:
                    ids.append([int(i) for i in found.split(",")] if found else [])
                    decoded.append(back)
            tool.check()
            kind = pa.string() if digest else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(decoded, pa.string()), *batch.columns[2:]],
                names=[id_col, *names, *keep],
            )

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    kinds = SCHEMA if digest else "n_tokens long, ids array<int>, decoded string"
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    key = df.select(id_col).schema.fields[0].dataType.simpleString()
    return df.select(id_col, text_col, *keep).mapInArrow(encode, f"`{id_col}` {key}, {kinds}{kept}")
