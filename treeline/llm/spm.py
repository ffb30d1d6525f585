"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field (pieces with scores and types,
trainer and normaliser settings); from it the normaliser (character map, white
space rules, metaspace marker) and the model are rebuilt with the tokenizers
library: the unigram scores or, for a BPE model, the merges in the order of the
merged pieces' scores, and byte fallback. Batches are encoded by the library's
threads. ``verify`` compares ids and decoded texts with the SentencePiece
library itself.

Text is cut where no piece can span the cut (see ``Codec``), and the library
encodes each distinct segment once; the ids are the same as without the cuts.
User-defined pieces stay whole. Ids that make valid UTF-8 without special
pieces decode from a table of the pieces, all others piece by piece.

The model file is read on the driver and handed to the workers as bytes, at
most ``MODEL_LIMIT``.

Defined cases: a null text has null ids and null decoded text; an empty text
has no ids and decodes to an empty text. Texts, also very long ones, are encoded
whole. Repeated rows are encoded each; an empty table gives an empty result.
Columns named like a result (``ids``, ``n_tokens``, ``decoded``) are replaced by
it; others are kept. White space as a suffix of words is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Regex, Tokenizer, models, normalizers

from treeline.llm.common import unlike, with_results

MODEL_LIMIT = 64 << 20
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_MARK = "▁"
_NEVER = "\U0010ffff"
_UNKNOWN = " ⁇ "


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _message(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; values are int, float or bytes by wire type."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = np.frombuffer(raw[at : at + n], "<f8" if n == 8 else "<f4")[0], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


@dataclass
class SentencePieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> SentencePieceModel:
        model = cls()
        for number, value in _message(raw):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_message(value))
                model.pieces.append((piece[1].decode(), float(piece[2]), int(piece[3])))
            elif number == 2:
                spec = dict(_message(value))
                model.kind = int(spec.get(3, UNIGRAM))
                model.byte_fallback = bool(spec.get(35, 0))
                if spec.get(24, 0):
                    raise ValueError("white space as a suffix isn't supported")
            elif number == 3:
                spec = dict(_message(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix = bool(spec.get(3, 1))
                model.squeeze_spaces = bool(spec.get(4, 1))
                model.escape_spaces = bool(spec.get(5, 1))
        model.unk_id = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        return model

    def has(self, *kinds: int) -> list[int]:
        return [i for i, p in enumerate(self.pieces) if p[2] in kinds]

    def tokenizer(self) -> Tokenizer:
        """The model alone: what it is given must be normalised and free of user-defined pieces.

        Pieces that text can't become (control, unused, and in a unigram model
        bytes and the unknown piece) have names that no text is given with.
        """
        known = set(self.has(NORMAL, USER))
        if self.kind == UNIGRAM:
            best = max((self.pieces[i][1] for i in self.has(NORMAL)), default=0.0)
            rank = lambda i: len(self.pieces[i][0].encode()) * best - 0.1 if self.pieces[i][2] == USER else self.pieces[i][1]
            return Tokenizer(models.Unigram([(p[0], rank(i)) if i in known else (f"{_NEVER}{i}", -1e6) for i, p in enumerate(self.pieces)], unk_id=self.unk_id, byte_fallback=False))
        if self.kind != BPE:
            raise ValueError("only unigram and BPE models are supported")
        ids = {self.pieces[i][0]: i for i in sorted(known)}
        ranked = []
        for piece, i in ids.items():
            cuts = [(piece[:c], piece[c:]) for c in range(1, len(piece))]
            ranked += [(-self.pieces[i][1], i, ids[a], ids[b], a, b) for a, b in cuts if a in ids and b in ids]
        ranked.sort()
        names = [p[0] if i in known or p[2] in (BYTE, UNKNOWN) else f"{_NEVER}{i}" for i, p in enumerate(self.pieces)]
        return Tokenizer(models.BPE({n: i for i, n in enumerate(names)}, [r[4:] for r in ranked], unk_token=names[self.unk_id], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0))

    def normalizer(self) -> normalizers.Normalizer:
        """What comes after the character map: white space rules, the prefix, the metaspace marker."""
        steps: list = []
        if self.squeeze_spaces:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", _MARK))
        return normalizers.Sequence(steps)


def load(path: str) -> bytes:
    """A model file's bytes, of bounded size."""
    with open(path, "rb") as f:
        raw = f.read(MODEL_LIMIT + 1)
    if len(raw) > MODEL_LIMIT:
        raise ValueError(f"{path} is larger than {MODEL_LIMIT} bytes")
    return raw


class Codec:
    """A model with the ids of words and segments seen.

    Text is cut between two characters that no piece holds side by side: no piece
    spans the cut, so the segments' ids are those of the whole. Each distinct
    segment goes to the library once, many in a call. Caches are two generations
    of ``CACHE`` entries and a batch's: what was used lately stays when the older
    one goes.
    """

    CACHE = 80_000

    def __init__(self, raw: bytes):
        m = self.model = SentencePieceModel.parse(raw)
        self.tokenizer, self.normalizer = m.tokenizer(), m.normalizer()
        self.charsmap = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        plain = [m.pieces[i][0] for i in m.has(NORMAL)]
        users = sorted((m.pieces[i][0] for i in m.has(USER)), key=lambda p: (-len(p), p))
        self.user_ids = {m.pieces[i][0]: i for i in m.has(USER)}
        self.user = re.compile("|".join(map(re.escape, users))) if users else None
        beside = sorted({c for p in plain if len(p) > 1 for c in p})
        alone = sorted({p for p in plain if len(p) == 1}.difference(beside))
        # Classes of characters: 0 in no piece, 1 pieces of their own only, others as they come.
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in alone]] = 1
        self.kind[[ord(c) for c in beside]] = np.arange(2, len(beside) + 2)
        self.joined = np.zeros((len(beside) + 2,) * 2, bool)
        for p in plain:
            at = self.kind[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        self.joined[0, 0] = not m.byte_fallback  # neighbouring unknown characters are one unknown piece
        self.byte_ids = np.array([i for _, i in sorted((int(m.pieces[i][0][3:5], 16), i) for i in m.has(BYTE))], np.int32)
        self.measured = m.kind == BPE and m.byte_fallback and len(self.byte_ids) == 256
        self.sizes = np.array([1 if p[2] == BYTE else len(p[0].encode()) for p in m.pieces])
        self.spelled = m.kind == UNIGRAM and m.byte_fallback and len(self.byte_ids) == 256
        inner = any(_MARK in p.lstrip(_MARK) for p in plain)
        self.by_word = m.escape_spaces and m.dummy_prefix and _MARK in plain and not (m.charsmap or m.squeeze_spaces or users or inner)
        self.by_line = m.byte_fallback and not any("\n" in p for p in plain)
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.segments: list[dict[str, bytes]] = [{}, {}]
        self.pieces = np.array([b"" if p[2] == CONTROL else bytes([int(p[0][3:5], 16)]) if p[2] == BYTE else p[0].replace(_MARK, " ").encode() for p in m.pieces], dtype=object)
        self.odd = np.array([p[2] in (UNKNOWN, CONTROL) for p in m.pieces])

    def _known(self, cache: list[dict[str, bytes]], keys: set[str], make) -> dict[str, bytes]:
        """A generation that holds the ids of all of keys, made for those not in the cache."""
        if len(cache[0]) > self.CACHE:
            cache[:] = [{}, cache[0]]
        young, old = cache
        new = keys.difference(young)
        if new:
            young.update([(k, old[k]) for k in new if k in old])
            if fresh := [k for k in new if k not in old]:
                young.update(zip(fresh, make(fresh), strict=True))
        return young

    def _library(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment; the library gets lists of a thousand and works on these in its threads."""
        parts = [segments[a : a + 1024] for a in range(0, len(segments), 1024)]
        if self.measured:
            # Every piece stands for its own bytes, so their sums tell where the segments end.
            out = []
            for part, e in zip(parts, self.tokenizer.encode_batch_fast(parts, is_pretokenized=True, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x.encode()) for x in part]))
                out += [ids[a:b].tobytes() for a, b in zip([0, *(ends[:-1] + 1).tolist()], (ends + 1).tolist(), strict=True)]
            return out
        # Bytes of a unigram model are taken from the text, as text may spell a byte piece's name.
        out = []
        for part, e in zip(parts, self.tokenizer.encode_batch([[x.replace(_NEVER, "\U0010fffe") for x in p] for p in parts], is_pretokenized=True, add_special_tokens=False), strict=True):
            ids: list[list[int]] = [[] for _ in part]
            for i, w, (a, b) in zip(e.ids, e.word_ids, e.offsets, strict=True):
                ids[w] += [i] if i != self.model.unk_id or not self.spelled else self.byte_ids[list(part[w][a:b].encode())].tolist()
            out += [np.array(x, np.int32).tobytes() for x in ids]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of normalised texts, none of them empty."""
        whole = "".join(texts)
        kind = self.kind[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        starts = np.cumsum([0, *map(len, texts)])
        cut = np.empty(len(whole) + 1, bool)
        cut[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        cut[starts] = True
        at = np.flatnonzero(cut)
        places = at.tolist()
        segments = [whole[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        ids = list(map(self._known(self.segments, set(segments), self._library).__getitem__, segments))
        ends = np.searchsorted(at, starts).tolist()
        return [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _normalised(self, text: str) -> str:
        if self.charsmap:
            cuts = [m.span() for m in self.user.finditer(text)] if self.user else []
            edges = [0, *(x for c in cuts for x in c), len(text)]
            parts = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            text = "".join(p if i % 2 else self.charsmap.normalize_str(p) for i, p in enumerate(parts))
        return self.normalizer.normalize_str(text) if text and (text.strip(" ") or not self.model.squeeze_spaces) else ""

    def _whole(self, text: str) -> np.ndarray:
        """Ids of any text."""
        text, out, at = self._normalised(text), [], 0
        for m in self.user.finditer(text) if self.user else ():
            if m.start() > at:
                out += self._encode([text[at : m.start()]])
            out.append(np.int32(self.user_ids[m[0]]).tobytes())
            at = m.end()
        if at < len(text):
            out += self._encode([text[at:]])
        return np.frombuffer(b"".join(out), np.int32)

    def _spell(self, words: list[str]) -> list[bytes]:
        return self._library([w if self.by_line and w[0] == "\n" else _MARK + w for w in words])

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = [None] * len(texts)
        parts: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if not text:
                out[i] = None if text is None else np.empty(0, np.int32)
                continue
            # A word has the marker of the space before it; one behind a line feed has none.
            lines = text.replace("\n", " \n") if self.by_line else text
            if self.by_word and _MARK not in text and "" not in (words := lines.split(" ")):
                parts[i] = words
            else:
                out[i] = self._whole(text)
        if parts:
            ids = self._known(self.words, set().union(*parts.values()), self._spell)
            for i, words in parts.items():
                out[i] = np.frombuffer(b"".join(map(ids.__getitem__, words)), np.int32)
        return out

    def _spoken(self, ids: np.ndarray) -> str:
        """The text of any ids: unknown pieces as the model's sign for them, a byte that isn't UTF-8 as U+FFFD."""
        out: list[str] = []
        held = b""
        first = True
        for i in [*ids.tolist(), None]:
            name, _, kind = self.model.pieces[i] if i is not None else ("", 0.0, NORMAL)
            if kind == BYTE:
                held += self.pieces[i]
                continue
            while held:
                size = 1 if held[0] < 0xC0 else 2 if held[0] < 0xE0 else 3 if held[0] < 0xF0 else 4
                try:
                    out.append(held[:size].decode())
                except UnicodeDecodeError:
                    size = 1
                    out.append("\ufffd")
                held, first = held[size:], False
            if i is None or kind == CONTROL:
                continue
            text = _UNKNOWN if kind == UNKNOWN else name
            if first and kind != UNKNOWN and (self.model.dummy_prefix or self.model.squeeze_spaces):
                text = text.removeprefix(_MARK)
                first = not text and self.model.squeeze_spaces
            else:
                first = False
            out.append(text if kind == UNKNOWN else text.replace(_MARK, " "))
        return "".join(out)

    def decode(self, ids: list[np.ndarray | None]) -> list[str | None]:
        out: list[str | None] = [None] * len(ids)
        for i, x in enumerate(ids):
            if x is None:
                continue
            if self.model.squeeze_spaces or len(x) and self.odd[x].any():
                out[i] = self._spoken(x)
                continue
            try:
                text = b"".join(self.pieces[x].tolist()).decode()
            except UnicodeDecodeError:  # byte pieces that aren't UTF-8
                out[i] = self._spoken(x)
                continue
            # A leading space that is a byte piece isn't the prefix.
            out[i] = text[1:] if self.model.dummy_prefix and text[:1] == " " and self.model.pieces[x[0]][2] != BYTE else text
        return out


_BUILT: dict[str, Codec] = {}


def built(raw: bytes) -> Codec:
    """The codec of a model, made once a worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = Codec(raw)
    return _BUILT[key]


def verify(raw: bytes, texts: list[str]) -> list[int]:
    """Indexes of texts whose ids or decoded text differ from the SentencePiece library's."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids = built(raw).encode(texts)
    mine = built(raw).decode(ids)
    return [i for i, t in enumerate(texts) if theirs.encode(t) != ids[i].tolist() or theirs.decode(ids[i].tolist()) != mine[i]]


def _slices(batch: pa.RecordBatch, spot: int, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of so many rows and about so many bytes of a column at most; a row alone may have more."""
    values = batch.column(spot)
    sizes = pc.fill_null(pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        stop = min(max(stop, at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def _with(docs: DataFrame, results: str, make, source: str) -> DataFrame:
    """docs without columns named like a result, and make(the source column of a part) as the results; parts are cut by its size."""
    spot = unlike(docs.columns, StructType.fromDDL(results).names).index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            for part in _slices(batch, spot):
                yield [*part.columns, *make(part.column(spot))]

    return with_results(docs, run, results)


def encode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """docs with ids (array of int) and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(column: pa.Array) -> list[pa.Array]:
        ids = built(shared.value).encode(column.to_pylist())
        return _ids_arrays(ids)

    return _with(docs, "ids array<int>, n_tokens bigint", make, text)


def decode(docs: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """docs with decoded, the text of the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(lists: pa.Array) -> list[pa.Array]:
        values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
        rows = [values[a:b] if ok else None for a, b, ok in zip(starts[:-1], starts[1:], lists.is_valid().to_pylist(), strict=True)]
        return [pa.array(built(shared.value).decode(rows), pa.string())]

    return _with(docs, "decoded string", make, ids)


def _ids_arrays(ids: list[np.ndarray | None]) -> list[pa.Array]:
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in ids)]).astype(np.int32)
    flat = np.concatenate([*(x for x in ids if x is not None), np.empty(0, np.int32)])
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in ids]))
    return [lists, pa.array([None if x is None else len(x) for x in ids], pa.int64())]


def encode_checked(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """docs with ids, n_tokens, and round_trip: whether the ids decode to the text. One pass, one model a worker."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(column: pa.Array) -> list[pa.Array]:
        codec = built(shared.value)
        texts = column.to_pylist()
        ids = codec.encode(texts)
        same = [a == b for a, b in zip(codec.decode(ids), texts, strict=True)]
        return [*_ids_arrays(ids), pa.array(same, pa.bool_())]

    return _with(docs, "ids array<int>, n_tokens bigint, round_trip boolean", make, text)


def op4_sentencepiece(spark, sf_dir: str, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Every document's number and digest of ids, and whether they decode to its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_checked(docs, load(model_path))
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip")


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLE: dict[str, str] = {}
