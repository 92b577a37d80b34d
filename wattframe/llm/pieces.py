"""Byte-fallback BPE of a sentencepiece model: encoding by backtracking, and decoding.

Merge-type BPE joins the best pair of neighbours until none is left. The same tokens are found without merging a
whole text: a sequence of tokens is the encoding exactly if each two neighbours, put together, are encoded as these
two. So the longest token at the current place is taken (the longest matches, one behind the other, come from an Aho-Corasick pass), checked
against the token before by merging the two anew, and replaced by the next shorter one if they do not go together.
Where no token goes on, the last one is taken back; a bitfield marks ends from which no encoding was found, so each
place fails once. A text is cut between characters that stand side by side in no token, since no merge crosses there.

The model file is read on the driver (a vocabulary, not data) and sent to the tasks.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from wattframe.errors import ArgumentError
from wattframe.llm.added import add_columns

BLANK = "▁"
#: Tasks remember this many words of at most this many characters, and this many pairs of tokens.
REMEMBERED_WORDS = 250_000
REMEMBERED_LETTERS = 40
REMEMBERED_PAIRS = 500_000
#: Encoded rows are sent on in blocks of about this many characters; a longer text is a block of its own.
BLOCK_LETTERS = 1_000_000


def _one_mark_per_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("wattframe.one_mark_per_byte", _one_mark_per_byte)


@dataclass(frozen=True)
class PieceModel:
    """What encoding and decoding need to know of a model file; ids are places in `pieces`."""

    pieces: list[str]
    #: Merge order of the pieces that merging can make (larger first), by text.
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    controls: list[int]
    unknown: int
    unknown_text: str
    blank_before: bool
    trim_blanks: bool


def read_model(path: str) -> PieceModel:
    """The model in a file of the driver. Only BPE with byte fallback, without character maps and user symbols."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    kind, rules, trainer = sentencepiece_model_pb2.ModelProto.SentencePiece, proto.normalizer_spec, proto.trainer_spec
    pieces = [p.piece for p in proto.pieces]
    of_type = {t: [i for i, p in enumerate(proto.pieces) if p.type == t] for t in range(1, 7)}
    refused = of_type[kind.USER_DEFINED] or of_type[kind.UNUSED] or rules.precompiled_charsmap or not rules.escape_whitespaces
    if trainer.model_type != trainer.BPE or len(of_type[kind.BYTE]) != 256 or refused or trainer.treat_whitespace_as_suffix:
        raise ArgumentError("only BPE models with byte fallback, without character maps and user symbols, are read")
    byte_ids = [0] * 256
    for i in of_type[kind.BYTE]:
        byte_ids[int(pieces[i][3:-1], 16)] = i
    normal = of_type[kind.NORMAL]
    return PieceModel(
        pieces, {pieces[i]: proto.pieces[i].score for i in normal}, {pieces[i]: i for i in normal}, byte_ids,
        of_type[kind.CONTROL], of_type[kind.UNKNOWN][0], trainer.unk_surface, rules.add_dummy_prefix,
        rules.remove_extra_whitespaces)


class _Words(dict):
    """Ids by word, computed when first asked for. Long words are not kept; once there are too many, those not asked
    for since the last time are forgotten."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word) or self.encode(word)
        if len(word) <= REMEMBERED_LETTERS:
            if len(self) >= REMEMBERED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Plain merging: the best pair of neighbours first, the leftmost of equal ones."""
    parts = list(text)
    value = [scores.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
    while value:
        best = max(value)
        if best == -np.inf:
            break
        at = value.index(best)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del value[at]
        if at > 0:
            value[at - 1] = scores.get(parts[at - 1] + parts[at], -np.inf)
        if at < len(value):
            value[at] = scores.get(parts[at] + parts[at + 1], -np.inf)
    return parts


class Encoder:
    """Encodes with a model. Tokens are numbered apart from ids: every character of a piece is a token, in the
    vocabulary or not; a piece that merging never makes is none."""

    def __init__(self, model: PieceModel) -> None:
        self.model, scores = model, model.scores
        known = {c for p in scores for c in p}
        self.joined = {a + b for p in scores for a, b in zip(p, p[1:], strict=False)}
        self.texts = sorted(known | {p for p in scores if len(p) > 1 and len(merged(p, scores)) == 1})
        number = {t: i for i, t in enumerate(self.texts)}
        self.automaton = ahocorasick.Automaton()
        for text, i in number.items():
            self.automaton.add_word(text, (i, len(text) - 1))
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in self.texts]
        # the longest token that is a shorter beginning of a token; single characters have none
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.texts]
        self.ids = [(model.ids[t],) if t in model.ids else self._bytes(t) for t in self.texts]
        self.pairs: list[dict[int, bool]] = [{} for _ in self.texts]
        self.remembered_pairs = 0
        self.words = _Words(self.encode_word)
        self.runs = re.compile(f"[{re.escape(''.join(sorted(known)))}]+|.", re.DOTALL)
        self.cut = self._cuts(known)

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.model.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))

    def _cuts(self, known: set[str]) -> re.Pattern | None:
        """Words with the blanks before them, single unknown ASCII characters, blanks at the end; None if a piece
        goes on behind a word with a blank, so that only whole texts are safe."""
        if any(a != BLANK and b == BLANK for a, b in self.joined):
            return None
        unknown = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in known)
        word = f"{BLANK}*[^{BLANK}{unknown}]+|{BLANK}+"
        return re.compile(f"[{unknown}]|{word}" if unknown else word)

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart, and as they are, when their texts are merged together."""
        a, b = self.texts[left], self.texts[right]
        fits = (a[-1] + b[0]) not in self.joined or merged(a + b, self.model.scores) == [a, b]
        if self.remembered_pairs >= REMEMBERED_PAIRS:
            self.remembered_pairs = 0
            for row in self.pairs:
                row.clear()
        self.remembered_pairs += 1
        self.pairs[left][right] = fits
        return fits

    def tokens(self, word: str) -> list[int] | None:
        """The encoding of a text of known characters, by backtracking; None if a character is in no piece."""
        lengths, shorter, pairs, out = self.lengths, self.shorter, self.pairs, []
        longest = {end - before: token for end, (token, before) in self.automaton.iter_long(word)}
        size = len(word)
        if sum([lengths[t] for t in longest.values()]) != size:
            return None
        at, dead_ends, token, row = 0, 0, longest[0], None
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if not dead_ends or not dead_ends >> end & 1:
                    if row is None:
                        break
                    fits = row.get(token)
                    if fits or fits is None and self.fit(out[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, row = end, pairs[token]
                if at < size:
                    token = longest.get(at)
                    if token is None:
                        token = self._longest_from(word, at, longest)
            else:
                dead_ends |= 1 << at
                token = out.pop()
                at -= lengths[token]
                row = pairs[out[-1]] if out else None
        return out

    def _longest_from(self, word: str, at: int, longest: dict[int, int]) -> int:
        """The longest token at a place, and at the places that follow one another from it, until one is known."""
        for end, (token, before) in self.automaton.iter_long(word, at):
            if end - before in longest:
                break
            longest[end - before] = token
        return longest[at]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a part of a text; characters of no piece are written as bytes."""
        ids = self.ids
        if len(word) <= REMEMBERED_LETTERS:
            tokens = self.tokens(word)
            if tokens is not None:
                return tuple(chain.from_iterable([ids[t] for t in tokens]))
        found: list[int] = []
        for run in self.runs.findall(word):
            if not self.automaton.exists(run[0]):
                found += self._bytes(run)
                continue
            for part in self._parts(run):
                found += chain.from_iterable([ids[t] for t in self.tokens(part)])
        return tuple(found)

    def _parts(self, run: str) -> Iterator[str]:
        """A long run, cut where two characters stand side by side in no piece, so that bitfields stay short."""
        start = 0
        for i in range(1, len(run)):
            if run[i - 1:i + 1] not in self.joined:
                yield run[start:i]
                start = i
        yield run[start:]

    def encode(self, text: str | None) -> Iterator[int]:
        """The ids of a text, without begin and end ids."""
        line = text or ""
        if self.model.trim_blanks:
            line = re.sub(" +", " ", line.strip(" "))
        if not line:
            return iter(())
        line = (BLANK if self.model.blank_before else "") + line.replace(" ", BLANK)
        parts = self.cut.findall(line) if self.cut else [line]
        return chain.from_iterable(map(self.words.__getitem__, parts))


class Decoder:
    """Puts the texts of ids together, blocks of ids at a time."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        texts = [p.replace(BLANK, " ").encode() for p in model.pieces]
        for byte, i in enumerate(model.byte_ids):
            texts[i] = bytes([byte])
        for i in model.controls:
            texts[i] = b""
        texts[model.unknown] = model.unknown_text.encode()
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.leading_blank = np.array([p.startswith(BLANK) for p in model.pieces])

    def decode(self, ids: np.ndarray) -> str:
        """The text. Bytes that are not UTF-8 become one replacement mark each, as do the parts of a character that a
        control id divides; an id out of range is an error."""
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.size):
            raise ArgumentError("an id is not of this model")
        size = self.size[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + size, size)
        said = self.flat[place].tobytes()
        silent = np.flatnonzero(size == 0)
        parts = [said[a:b] for a, b in zip([0, *ends[silent]], [*ends[silent], ends[-1]], strict=True)]
        text = "".join(p.decode("utf-8", "wattframe.one_mark_per_byte") for p in parts)
        first = ids[size > 0][:1]
        if not (self.model.blank_before or self.model.trim_blanks) or not len(first) or not self.leading_blank[first[0]]:
            return text
        return text.lstrip(" ") if self.model.trim_blanks else text[1:]


def _tool(shared, kind):
    """One encoder or decoder per Python process and broadcast model, with its memory."""
    model = shared.value
    tools = model.__dict__.setdefault("_tools", {})
    if kind not in tools:
        tools[kind] = kind(model)
    return tools[kind]


def encode_texts(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The rows with `ids` (array of int), the encoding of the whole text, and on request the text decoded from them.

    Columns of these names are replaced. Null and empty texts have no ids. Equal rows are encoded each; a text is one
    value and must fit a task, its words are looked up one after the other. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def blocks():
        encoder, decoder = _tool(shared, Encoder), _tool(shared, Decoder)

        def done(flat: list[np.ndarray]) -> list[pa.Array]:
            offsets = np.cumsum([0, *map(len, flat)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
            return [lists, pa.array(map(decoder.decode, flat), pa.string())] if decoded else [lists]

        def encoded(texts: pa.Array) -> Iterator[list[pa.Array]]:
            flat, letters = [], 0
            for value in texts:
                line = value.as_py()
                flat.append(np.fromiter(encoder.encode(line), np.int32))
                letters += len(line or "")
                if letters >= BLOCK_LETTERS:
                    yield done(flat)
                    flat, letters = [], 0
            if flat:
                yield done(flat)

        return encoded

    added = {ids: ArrayType(IntegerType())} | ({decoded: StringType()} if decoded else {})
    return add_columns(docs, F.col(text).cast("string"), added, blocks)


def decode_ids(rows: DataFrame, model: PieceModel, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with `decoded`, the text of `ids`. A column of that name is replaced; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def blocks():
        decoder = _tool(shared, Decoder)

        def decoded(lists: pa.Array) -> Iterator[list[pa.Array]]:
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            present = lists.is_valid().to_pylist()
            texts = [decoder.decode(values[a:b]) if ok else "" for a, b, ok in zip(offsets, offsets[1:], present, strict=False)]
            yield [pa.array(texts, pa.string())]

        return decoded

    return add_columns(rows, F.col(ids).cast("array<int>"), {text: StringType()}, blocks)
