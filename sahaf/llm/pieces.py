"""SentencePiece encoding and decoding by a table of prefixes.

A model of merges has one encoding of every prefix of a text, and the last piece of that encoding is all that must be
known of it: without this piece the rest is the encoding of a shorter prefix.  An automaton of all pieces finds those that
end at a place; the one that may stand beside the last piece of the prefix before it is the prefix's last piece.  Two
pieces may be neighbours if merging their joined characters gives just those two.  Ids are recovered backwards from the
end of the table.

Merging never crosses the place before a space mark that follows another character, since no piece does, so texts are
taken apart there, and every worker keeps the ids of segments that it has met.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The mark that stands for a space.
SPACE = "▁"
#: Segments that a worker remembers, and the characters of the longest of them; what comes later is encoded again.
CACHE_SEGMENTS, CACHED_CHARACTERS = 400_000, 64
#: Pairs of pieces whose test a worker remembers before it starts anew.
CACHE_PAIRS = 500_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def default_model() -> str:
    """The path of the public model file that the query names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("sahaf-one-by-one", _one_by_one)


class Model:
    """The pieces of a model file, and what follows from them.

    Models other than of merges, with a normalizer of their own, with pieces across a space mark that follows a letter,
    or with several pieces of one score (runs of the space mark may share theirs) are refused with a ValueError.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != proto.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models of merges that keep texts as they are")
        kinds = [p.type for p in model.pieces]
        if USER in kinds or UNUSED in kinds:
            raise ValueError("pieces that are user-defined or unused")
        self.prefix = rules.add_dummy_prefix
        self.bytes_fall_back = trainer.byte_fallback
        self.pieces = [p.piece for p in model.pieces]
        self.unknown = kinds.index(UNKNOWN)
        self.plain = [k == NORMAL for k in kinds]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.plain[i]}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        longer = [p for p in self.ids if len(p) > 1 and p.strip(SPACE)]
        if len({self.scores[p] for p in longer}) < len(longer) or any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("pieces of one score, or across a space mark")
        self.of_byte = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.special = np.array([k in (UNKNOWN, CONTROL) for k in kinds])
        byte_at = {i: b for b, i in self.of_byte.items()}
        surface = trainer.unk_surface
        self.shown = [bytes([byte_at[i]]) if k == BYTE else surface.encode() if k == UNKNOWN else b"" if k == CONTROL else self.pieces[i].replace(SPACE, " ").encode() for i, k in enumerate(kinds)]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, dtype=np.int32), 0
        self.first, self.count, self.n = np.empty(1 << 16, dtype=np.int64), np.empty(1 << 16, dtype=np.int64), 0

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (-1: nothing that could merge with it) in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            want = [self.pieces[b]] if a < 0 else [self.pieces[a], self.pieces[b]]
            known = self.pairs[a, b] = self.merged("".join(want)) == want
        return known

    def encode_segment(self, text: str) -> list[int]:
        """The ids of a text by its table of prefixes."""
        last = [-1] * (len(text) + 1)  # the last piece of each prefix; -1 where it ends with an unknown character
        size = [1] * (len(text) + 1)
        neighbours = self.neighbours
        for end, (piece, n) in self.automaton.iter(text):
            if last[end + 1] < 0 and neighbours(last[end + 1 - n], piece):
                last[end + 1], size[end + 1] = piece, n
        ids, end = [], len(text)
        while end > 0:
            if last[end] >= 0:
                ids.append(last[end])
            elif self.bytes_fall_back:
                ids += [self.of_byte[b] for b in reversed(text[end - 1].encode())]
            elif not ids or ids[-1] != self.unknown:  # a run of unknown characters is one id
                ids.append(self.unknown)
            end -= size[end]
        return ids[::-1]

    def segments(self, text: str) -> list[str]:
        marked = (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)
        return _segment.findall(marked)

    def _keep(self, ids: list[int]) -> int:
        """Add a segment's ids to the flat table; its number."""
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(need, len(self.flat)), dtype=np.int32)])
        if self.n == len(self.first):
            self.first, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.count))
        self.flat[self.used : need] = ids
        self.first[self.n], self.count[self.n] = self.used, len(ids)
        self.used, self.n = need, self.n + 1
        return self.n - 1

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text k are ids[offsets[k]:offsets[k + 1]]; a null text has none."""
        mark = self.n, self.used
        numbers: list[int] = []
        ends = [0]
        fresh: dict[str, int] = {}
        for text in texts:
            for s in self.segments(text or ""):
                n = self.known.get(s)
                if n is None:
                    n = fresh.get(s)
                    if n is None:
                        n = fresh[s] = self._keep(self.encode_segment(s))
                numbers.append(n)
            ends.append(len(numbers))
        at = np.array(numbers, dtype=np.int64)
        first, count = self.first[at], self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(first - total[:-1], count)]
        if len(self.known) + len(fresh) <= CACHE_SEGMENTS and all(len(s) <= CACHED_CHARACTERS for s in fresh):
            self.known |= fresh
        else:
            self._forget(mark, {s: n for s, n in fresh.items() if len(s) <= CACHED_CHARACTERS})
        return total[np.array(ends)], ids

    def _forget(self, mark: tuple[int, int], fresh: dict[str, int]) -> None:
        """Drop the segments since mark, but for as many of fresh as the worker may remember."""
        kept = [(s, self.flat[self.first[n] : self.first[n] + self.count[n]].copy()) for s, n in fresh.items()][: max(0, CACHE_SEGMENTS - len(self.known))]
        self.n, self.used = mark
        for s, ids in kept:
            self.known[s] = self._keep(ids)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks are spaces, but for one that the text opens with; bytes that are no character are U+FFFD each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id that the model does not have")
        out: list[str] = []
        opened = False
        cuts = np.flatnonzero(self.special[ids])
        for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)], strict=True):
            run = ids[a:b]
            if len(run):
                text = b"".join(map(self.shown.__getitem__, run.tolist())).decode("utf-8", "sahaf-one-by-one")
                if not opened and self.prefix and not self.is_byte[run[0]] and self.pieces[run[0]].startswith(SPACE):
                    text = text[1:]
                opened = True
                out.append(text)
            if b < len(ids) and ids[b] == self.unknown:
                out.append(self.shown[self.unknown].decode())
                opened = True
        return "".join(out)


_segment = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """This worker's model of the file; what it remembers serves all tasks that the worker runs."""
    if path not in _models:
        _models.clear()
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of whole texts, as the library's encode gives them without begin or end ids.

    Null and empty texts have no ids; repeated rows and rows without doc_id are encoded each; texts may be of any length
    (a table of two numbers a character is held for the longest run without a space).  An empty table gives no rows;
    columns of other names are ignored.  path is the model's file on every executor, the query's public one if None.
    """
    file = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(file)
        for b in batches:
            offsets, ids = own.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return common.map_arrow(common.texts_of(docs), run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and text of rows of doc_id and ids, as the library's decode gives it.

    Null ids and null lists are nothing; an id that the model does not have is an error.  An empty table gives no rows.
    """
    file = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(file)
        for b in batches:
            # one flat array of ids, nulls left out, with each row's bounds in it
            lists = b.column(1)
            flat = lists.flatten()
            real = np.concatenate([[0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))])
            bounds = real[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])]
            ids = flat.drop_null().to_numpy()
            texts = [own.decode(ids[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, type=pa.string())], names=["doc_id", "ids", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return common.map_arrow(rows, run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]))


def digest(ids: Column) -> Column:
    """SHA-256, in lower-case hex, of ids in decimal joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded, and decoded from its ids."""
    back = decode(encode(docs, path), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2(F.encode(F.col("text"), "UTF-8"), 256).alias("decoded_sha256"))
