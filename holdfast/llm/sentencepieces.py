"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Each text is cut where no piece of the vocabulary can cross; within a cut, adjacent symbol pairs wait
in an agenda ordered by the score of the piece they would form, and the best pair is merged first. The ids are the
agenda's. In every Arrow batch the sentencepiece library checks each cut that is new to the task, and one whole
text; a difference is counted and never replaces an id.

Models with rules that the agenda does not follow are refused: other kinds than merges, a normaliser that changes
texts or white space, no space before a text, pieces defined by the user.

Defined results: a null text counts as empty; an empty text has the begin and end ids only; a
literal ``▁`` is a space, as in the library; characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.batches import extended, slices, texts

SPACE = "▁"
#: Text handled at a time within a task, and distinct cuts remembered by a task.
SLICE_BYTES = 1 << 20
MEMORY = 600_000
LONGEST_REMEMBERED = 48
#: Cuts of up to SHORT characters are merged together, ROWS at a time.
SHORT, ROWS = 32, 8192
NONE = np.iinfo(np.int64).max


class Agenda:
    """Encoder for one vocabulary; built once per task from the library's own view of the model."""

    def __init__(self, processor):
        self.processor = processor
        self.id_bytes: dict[str, bytes] = {}
        self.byte_bytes: dict[int, bytes] = {}
        scores: dict[str, float] = {}
        for i in range(processor.vocab_size()):
            piece, packed = processor.id_to_piece(i), struct.pack("<I", i)
            if processor.is_byte(i):
                self.byte_bytes[int(piece[1:-1], 16)] = packed
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                self.id_bytes[piece] = packed
                scores[piece] = processor.get_score(i)
        # Place of each piece by falling score; equal scores share a place, so the leftmost goes first.
        places = {score: place for place, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.place = {piece: places[score] for piece, score in scores.items()}
        self.unknown = struct.pack("<I", processor.unk_id())
        self.begin, self.end = struct.pack("<I", processor.bos_id()), struct.pack("<I", processor.eos_id())
        longer = [piece for piece in scores if len(piece) > 1]
        #: Cuts before runs of spaces and around line ends are exact where no piece reaches across.
        self.cuts = not any("\n" in piece or SPACE in piece.lstrip(SPACE) for piece in longer)
        self.cutter = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.cuts else r"[\s\S]+")
        self._tables()
        self.known: dict[str, bytes] = {}
        self.line_ids = len(processor.encode("\n"))

    def _tables(self) -> None:
        """Arrays for ``merge_short``: a symbol per character, and place and result of each pair."""
        symbol = {piece: i for i, piece in enumerate(self.place)}
        self.ids = np.array([struct.unpack("<I", self.id_bytes[p])[0] for p in symbol], "<u4")
        self.of_character = np.full(0x110000, -1, np.int32)
        pairs = []
        for piece, i in symbol.items():
            if len(piece) == 1:
                self.of_character[ord(piece)] = i
            for at in range(1, len(piece)):
                left, right = symbol.get(piece[:at]), symbol.get(piece[at:])
                if left is not None and right is not None:
                    pairs.append((left * len(symbol) + right, self.place[piece], i))
        table = np.array(sorted(pairs) or [(-1, NONE, 0)], np.int64)
        self.pair, self.pair_place, self.pair_symbol = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()

    def _places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair (``NONE`` if it forms no piece) and its row in the pair table."""
        key = left.astype(np.int64) * len(self.ids) + right
        row = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        found = (self.pair[row] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_place[row], NONE), row

    def merge_short(self, cuts: list[str]) -> list[bytes]:
        """``merge`` for many cuts at once, all of whose characters are in the vocabulary.

        Each row's agenda holds the places of its adjacent pairs; a round takes the best pair of
        every row that still has one.
        """
        lengths = np.array([len(c) for c in cuts])
        width = int(lengths.max())
        points = np.frombuffer("".join(cuts).encode("utf-32-le"), "<u4")
        symbols = np.full((len(cuts), width + 1), -1, np.int32)
        symbols[np.arange(width + 1) < lengths[:, None]] = self.of_character[points]
        agenda = self._places(symbols[:, :-1], symbols[:, 1:])[0]
        columns, open_rows = np.arange(width), np.arange(len(cuts))
        done = symbols[:, :width].copy()
        while len(open_rows):
            best = agenda.argmin(1)
            rows = np.arange(len(best))
            more = agenda[rows, best] < NONE
            if not more.all():
                done[open_rows[~more]] = symbols[~more, :width]
                open_rows, symbols, agenda, best = open_rows[more], symbols[more], agenda[more], best[more]
                rows = np.arange(len(best))
                if not len(best):
                    break
            row = self._places(symbols[rows, best], symbols[rows, best + 1])[1]
            moved = columns > best[:, None]
            symbols[:, :-1] = np.where(moved, symbols[:, 1:], symbols[:, :-1])
            symbols[rows, best] = self.pair_symbol[row]
            agenda[:, :-1] = np.where(moved[:, :-1], agenda[:, 1:], agenda[:, :-1])
            agenda[:, -1] = NONE
            agenda[rows, best] = self._places(symbols[rows, best], symbols[rows, best + 1])[0]
            nearer = np.maximum(best - 1, 0)
            place = self._places(symbols[rows, nearer], symbols[rows, nearer + 1])[0]
            agenda[rows, nearer] = place
        kept = done >= 0
        packed = self.ids[done[kept]].tobytes()
        ends = (4 * kept.sum(1).cumsum()).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def merge_all(self, cuts: list[str]) -> list[bytes]:
        """Ids of every cut; short ones together, the rest one by one."""
        result: list[bytes | None] = [None] * len(cuts)
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        order = np.argsort(lengths, kind="stable")[: int((lengths <= SHORT).sum())]
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS].tolist()
            points = np.frombuffer("".join([cuts[i] for i in rows]).encode("utf-32-le"), "<u4")
            if (self.of_character[points] < 0).any():
                rows = [i for i in rows if all(c in self.place for c in cuts[i])]
            if rows:
                for i, ids in zip(rows, self.merge_short([cuts[i] for i in rows])):
                    result[i] = ids
        return [self.merge(c) if ids is None else ids for c, ids in zip(cuts, result)]

    def merge(self, cut: str) -> bytes:
        """Ids of one cut: take the best adjacent pair off the agenda until none is left.

        An entry is the place of the piece that a pair forms, then the position of its left symbol.
        """
        place = self.place.get
        symbols: list[str | None] = list(cut)
        end = len(symbols)
        agenda = [
            (p << 40) | i
            for i, p in enumerate(map(place, map(str.__add__, symbols, symbols[1:])))
            if p is not None
        ]
        if agenda:
            heapify(agenda)
            after, before = list(range(1, end + 1)), list(range(-1, end - 1))
            while agenda:
                entry = heappop(agenda)
                left = entry & 0xFFFFFFFFFF
                right = after[left]
                if right >= end or (own := symbols[left]) is None:
                    continue
                merged = own + symbols[right]
                if place(merged) != entry >> 40:
                    continue
                symbols[left], symbols[right] = merged, None
                after[left] = further = after[right]
                if further < end:
                    before[further] = left
                    if (p := place(merged + symbols[further])) is not None:
                        heappush(agenda, (p << 40) | left)
                if (nearer := before[left]) >= 0 and (p := place(symbols[nearer] + merged)) is not None:
                    heappush(agenda, (p << 40) | nearer)
        found = self.id_bytes
        return b"".join([found.get(s) or self._outside(s) for s in symbols if s is not None])

    def _outside(self, symbol: str) -> bytes:
        return b"".join(self.byte_bytes[b] for b in symbol.encode()) if self.byte_bytes else self.unknown

    def encode(self, given: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as little-endian unsigned 32-bit integers, and whether the library agrees.

        Every cut not yet remembered goes to the library as well, all of a batch in one call, and so does the first
        text as a whole.
        """
        known, cuts, ends = self.known, [], [0]
        for text in given:
            if text:
                cuts += self.cutter.findall(SPACE + text.replace(" ", SPACE))
            ends.append(len(cuts))
        ids = list(map(known.get, cuts))
        missing = [i for i, found in enumerate(ids) if found is None]
        new = list({cuts[i] for i in missing})
        own = self.merge_all(new)
        # A line end before the cut takes the space that the library puts before a text.
        checked = [f"\n{cut}" for cut in new] if self.cuts else [cut.removeprefix(SPACE) for cut in new]
        skip = 4 * self.line_ids if self.cuts else 0
        wrong = {
            cut for cut, mine, found in zip(new, own, self.processor.encode(checked, num_threads=1))
            if struct.pack(f"<{len(found)}I", *found)[skip:] != mine
        }
        batch = dict(zip(new, own))
        for i in missing:
            ids[i] = batch[cuts[i]]
        if len(known) + len(batch) > MEMORY:
            known.clear()
        known.update({c: x for c, x in batch.items() if len(c) <= LONGEST_REMEMBERED and c not in wrong})
        spans = list(zip(ends, ends[1:]))
        agree = [not wrong.intersection(cuts[a:b]) for a, b in spans] if wrong else [True] * len(given)
        encoded = [b"".join([self.begin, *ids[a:b], self.end]) for a, b in spans]
        if given:
            whole = self.processor.encode(given[0], add_bos=True, add_eos=True)
            agree[0] = agree[0] and encoded[0] == struct.pack(f"<{len(whole)}I", *whole)
        return encoded, agree


def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def require_supported(model: bytes) -> None:
    """An error for a model whose rules the agenda does not follow."""
    from sentencepiece import sentencepiece_model_pb2

    read = sentencepiece_model_pb2.ModelProto.FromString(model)
    trained, rules = read.trainer_spec, read.normalizer_spec
    faults = {
        "not a vocabulary of merges": trained.model_type != trained.BPE,
        "the normaliser changes characters": bool(rules.precompiled_charsmap),
        "extra white space is removed": rules.remove_extra_whitespaces,
        "no space before a text": not rules.add_dummy_prefix,
        "spaces are not escaped": not rules.escape_whitespaces,
        "spaces end a piece": trained.treat_whitespace_as_suffix,
        "pieces defined by the user": any(p.type == p.USER_DEFINED for p in read.pieces),
    }
    if found := [fault for fault, there in faults.items() if there]:
        raise ValueError(f"unsupported model: {', '.join(found)}")


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids",
           agrees: str = "ids_agree") -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit integers, begin and end included) and ``agrees``.

    ``ids`` are the agenda's; ``agrees`` tells whether the library, as far as it was asked, has the same. Existing
    columns of these names are replaced. The model is read on the driver and travels with the tasks: vocabularies
    are a few megabytes at most.
    """
    model = Path(model_path).read_bytes()
    require_supported(model)
    kept = df.drop(ids, agrees)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType()),
                           T.StructField(agrees, T.BooleanType())])
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model)
        agenda = Agenda(processor)
        for batch in slices(batches, text, SLICE_BYTES):
            encoded, agree = agenda.encode(texts(batch, text))
            yield extended(batch, arrow, **{ids: encoded, agrees: agree})

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``, what the library decodes from ``ids``; null ids give an empty text."""
    model = Path(model_path).read_bytes()
    kept = df.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model)
        for batch in slices(batches, ids, SLICE_BYTES):
            given = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(ids).to_pylist()]
            yield extended(batch, arrow, **{text: processor.decode(given, num_threads=1)})

    return kept.mapInArrow(run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def token_count(ids: str) -> Column:
    return F.expr(f"cast(octet_length(`{ids}`) div 4 as bigint)")
