"""Exact encoding with a merge-type piece vocabulary by backtracking over longest matches.

The vocabulary file of a public tokenizer is read, never trained or copied. Its merges join the
adjacent pair whose joined text is the piece with the best score, the leftmost on equal scores,
until no pair joins. The encoder finds the same pieces from left to right:

* an Aho-Corasick automaton over the pieces gives the longest piece at a position, its prefix chain
  the shorter ones;
* two adjacent pieces are compatible if merging their joined text again gives just these two;
* a bit per position marks where no continuation exists, so no position is tried twice.

A sequence whose neighbours are all compatible is the one the merges produce. Pieces never hold a
blank mark or line break behind another character (checked when the file is read), so the text is
cut there and every distinct part is encoded once per task, in a cache of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelcast.llm.text import filled, map_texts

MARK = "▁"  # stands for a blank inside pieces
CACHE_PARTS = 150_000  # encoded parts kept per task
CACHE_LENGTH = 64  # longer parts are not kept
MEMO_ENTRIES = 500_000  # pairs of adjacent pieces kept per process


class Pieces:
    """Pieces of a vocabulary file: text, id, score, and the byte pieces for unknown characters."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("  ﬁ A\n") != MARK * 3 + "ﬁ" + MARK + "A\n":
            raise ValueError("only vocabularies without text normalisation are supported")
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("only vocabularies with all byte pieces are supported")
        if not model.is_unknown(0):
            raise ValueError("id 0 must be the unknown piece")
        skipped = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        self.texts = {i: model.id_to_piece(i) for i in ids if not skipped(i)}
        self.ids = {t: i for i, t in self.texts.items()}
        self.scores = {t: model.get_score(i) for t, i in self.ids.items()}
        self.values = {i: b for b, i in self.bytes.items()}
        inner = re.compile(f"[^{MARK}]{MARK}|\n.|.\n", re.S)
        if any(inner.search(t) for t in self.ids):
            raise ValueError("a piece crosses the start of a word")
        self.parts = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class Encoder:
    """Encodes and decodes with ``Pieces``; remembers which pieces may follow each other."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        # a piece that merging does not make of its own text never stands in a result
        usable = {t: i for t, i in pieces.ids.items() if len(self.merged(t)) == 1}
        automaton = ahocorasick.Automaton()
        for text, i in usable.items():
            automaton.add_word(text, (len(text) - 1, i))
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter = {
            i: next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), None)
            for t, i in usable.items()
        }
        self.lengths = {i: len(t) for t, i in usable.items()}
        self.names = {i: str(i) for i in [*pieces.texts, *pieces.bytes.values()]}
        letters = "".join(t for t in pieces.ids if len(t) == 1)
        self.unknown = re.compile(f"[^{re.escape(letters)}]")
        self.follow: list[dict[int, int | None]] = [{} for _ in range(max(usable.values()) + 1)]
        self.remembered = 0

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves, by definition; for short texts."""
        get, none = self.pieces.scores.get, float("-inf")
        parts = list(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != none:
            k = scores.index(best)  # the leftmost
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def fits(self, left: int, right: int) -> bool:
        """True if merging the joined text of two pieces gives these two again."""
        a, b = self.pieces.texts[left], self.pieces.texts[right]
        return self.merged(a + b) == [a, b]

    def first_fit(self, last: int, candidate: int) -> int | None:
        """The longest of a piece and its prefixes that may follow ``last``, remembered."""
        known, passed, fit = self.follow[last], [], candidate
        while fit is not None and not self.fits(last, fit):
            passed.append(fit)
            fit = self.shorter[fit]
            if fit in known:
                fit = known[fit]
                break
        self.remembered += len(passed) + 1
        if self.remembered > MEMO_ENTRIES:
            for d in self.follow:
                d.clear()
            self.remembered = 0
        known.update(dict.fromkeys([*passed, candidate], fit))
        return fit

    def encode_known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        size, lengths, follow = len(text), self.lengths, self.follow
        longest: list[int | None] = [None] * size
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # ends ascend, so the longest comes last
        last = candidate = longest[0]
        if candidate is None:
            raise ValueError("the vocabulary cannot encode this text by merges")
        result, position = [last], lengths[last]
        shut = 0  # bit p: no way on from position p
        while position < size:
            candidate = longest[position]
            while True:
                # the longest piece that fits behind the last one and ends where a way leads on
                if candidate is not None:
                    known = follow[last]
                    fit = known.get(candidate, 0)
                    if fit == 0:  # no piece has id 0
                        fit = self.first_fit(last, candidate)
                    candidate = fit
                if candidate is not None:
                    end = position + lengths[candidate]
                    if not shut >> end & 1:
                        break
                    candidate = self.shorter[candidate]
                    continue
                shut |= 1 << position
                position -= lengths[last]
                candidate = self.shorter[result.pop()]
                if result:
                    last = result[-1]
                    continue
                while candidate is not None and shut >> lengths[candidate] & 1:
                    candidate = self.shorter[candidate]
                if candidate is None:
                    raise ValueError("the vocabulary cannot encode this text by merges")
                end = lengths[candidate]
                break
            result.append(candidate)
            last, position = candidate, end
        return result

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part; characters that are no piece become their bytes."""
        ids: list[int] = []
        start = 0
        for unknown in self.unknown.finditer(part):
            if unknown.start() > start:
                ids += self.encode_known(part[start : unknown.start()])
            ids += [self.pieces.bytes[b] for b in unknown.group().encode("utf-8")]
            start = unknown.end()
        return ids + self.encode_known(part[start:]) if start < len(part) else ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; the blank before a text's first piece is still there."""
        texts = self.pieces.texts
        try:
            return "".join([texts[i] for i in ids]).replace(MARK, " ")
        except KeyError:  # byte pieces among them
            pass
        out, pending = [], bytearray()
        for i in ids:
            value = self.pieces.values.get(i)
            if value is not None:
                pending.append(value)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(texts[i].replace(MARK, " "))
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def split(self, text: str) -> list[str]:
        """Parts of a text that no merge crosses."""
        return self.pieces.parts.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [i for part in self.split(text) for i in self.encode_part(part)]

    def decode_text(self, ids: Sequence[int]) -> str:
        """The text of ids; one leading blank mark belongs to the encoding, not to the text."""
        return self.decode(ids).removeprefix(" ")


class EncodedParts(dict):
    """Number of ids, the ids as text, and the decoded text by part; starts over when full."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> tuple[int, str, str]:
        names = self.encoder.names
        ids = self.encoder.encode_part(part)
        known = len(ids), ",".join([names[i] for i in ids]), self.encoder.decode(ids)
        if len(part) <= CACHE_LENGTH:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[part] = known
        return known


def _shipped(spark: SparkSession, path: str) -> str:
    """Adds a vocabulary file to the files of the job; the name tasks find it by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(Pieces(path))


def encode_pieces(
    docs: DataFrame,
    model_path: str,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    digests: bool = False,
) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns ``key``, ``keep`` and n_tokens, ids (array), decoded; with ``digests`` n_tokens and the
    SHA-256 of the comma-joined ids and of the decoded text instead. A null text counts as empty:
    no ids, decoded to the empty text. Texts are whole, however long; a null key is kept. Repeated rows give repeated results, an empty table an empty
    one. Columns of ``keep`` named like a new column are dropped.
    """
    name = _shipped(docs.sparkSession, model_path)

    def work():
        encoder = _encoder(SparkFiles.get(name))
        parts = EncodedParts(encoder)

        def compute(texts: pa.Array):
            counts, first, second = [], [], []
            for text in filled(texts).to_pylist():
                found = [parts[p] for p in encoder.split(text)]
                ids = ",".join([f[1] for f in found])
                decoded = "".join([f[2] for f in found]).removeprefix(" ")
                counts.append(sum([f[0] for f in found]))
                if digests:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    first.append([int(i) for i in ids.split(",")] if ids else [])
                    second.append(decoded)
            return counts, first, second

        return compute

    if digests:
        added = [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    else:
        added = [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    return map_texts(docs, key, text, [("n_tokens", T.LongType()), *added], work, keep)
