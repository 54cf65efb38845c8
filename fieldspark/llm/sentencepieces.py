"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

A text is marked (a mark in front, a mark for every blank) and cut before each run of marks. No piece of the vocabulary
crosses such a cut, so the best segmentation of a text is the best one of each marked word. The distinct marked words
of a block are sorted; sorted order is the depth-first order of their trie, so the forward scores of a common prefix
are computed once and reused. Scores are the pieces' scores in the model file; the sum is maximised, and of equal sums
the longer last piece wins. Characters without a piece become byte pieces. Decoding joins the pieces and bytes.

A block is a bounded run of rows inside one Arrow batch: nothing is shuffled and a lost task is simply run again. Ids and
remembered words are kept as packed numbers, and a text goes to a worker once, also if it is decoded again there.
A literal mark character U+2581 in a text is encoded as bytes, as is any byte that is not UTF-8; inside a task both stand
as surrogates, which no text can hold. So decoding gives back every text exactly.

Defined cases: a NULL text gives NULL ids and decodes to NULL; an empty text gives no ids; a long text is cut in parts at
marks, and a very long word costs time and memory in proportion to its length; repeated rows give equal ids; an empty
table gives an empty result; columns of the input named like a result column are replaced, all others may have any name.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldspark.llm.text import fresh, ship, text_blocks

MARK = "▁"
# A literal mark stands for itself inside a task under this surrogate, which decoding never makes of a byte.
_LITERAL = "\ud800"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_CUT = re.compile(f"(?<!{MARK}){MARK}")
BYTE_SCORE = -1e6
# Bytes, as estimated, of the words and ids that a worker remembers from block to block.
KNOWN_BYTES = 24_000_000
_WORD_BYTES = 200  # of the objects and the table around one word
# Bytes of text of a block, and characters of a part of a long text.
ENCODE_BYTES = 400_000
PART_CHARS = 200_000
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes_at: tuple[int, ...]  # ids of the 256 byte pieces
    longest: int

    @property
    def table(self) -> dict[str, tuple[int, float]]:
        skip = set(self.bytes_at)
        return {p: (k, self.scores[k]) for k, p in enumerate(self.pieces) if p and k not in skip}


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a model file; control and unknown pieces cannot be produced."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, scores, at = [], [], [-1] * 256
    for k in range(n):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            at[int(piece[3:5], 16)] = k
        usable = not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k))
        pieces.append(piece if usable else "")
        scores.append(float(model.get_score(k)))
    if min(at) < 0:
        raise ValueError("the model has no byte pieces, so not every text can be encoded")
    return Vocabulary(tuple(pieces), tuple(scores), tuple(at), max(map(len, pieces)))


class WordEncoder:
    """Best segmentations of many marked words, word by word in sorted order."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.table
        self.bytes_at = vocabulary.bytes_at
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        # Pieces read from their last character: node[character] leads on, node[None] is the piece's id and score.
        self.tails: dict = {}
        for piece, hit in self.table.items():
            node = self.tails
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[None] = hit

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Packed segmentations of distinct words that are not remembered; as many as there is room for are from now on."""
        made = {w: array("i", ids).tobytes() for w, ids in self.encode_sorted(sorted(words - self.known.keys())).items()}
        for word, ids in made.items():
            if self.known_bytes > KNOWN_BYTES:
                break
            self.known[word] = ids
            self.known_bytes += _WORD_BYTES + len(word) + len(ids)
        return made

    def encode_sorted(self, words: list[str]) -> dict[str, list[int]]:
        """``words`` in sorted order; the stacks hold the forward pass of the current path in the trie."""
        best, start, ids = [0.0], [0], [-1]
        last, out, tails, bytes_at = "", {}, self.tails, self.bytes_at
        for word in words:
            shared = _common(last, word)
            del best[shared + 1 :], start[shared + 1 :], ids[shared + 1 :]
            for end in range(shared, len(word)):
                char = word[end]
                node = tails.get(char)
                top, frm, piece = -1e300, -1, -1
                if node is None or None not in node:
                    # The character has no piece of its own: bytes keep every position reachable.
                    top, frm = best[end] + BYTE_SCORE, end
                at = end
                while node is not None:
                    if None in node:
                        number, score = node[None]
                        value = best[at] + score
                        if value >= top:
                            top, frm, piece = value, at, number
                    if not at:
                        break
                    at -= 1
                    node = node.get(word[at])
                best.append(top)
                start.append(frm)
                ids.append(piece)
            found, at = [], len(word)
            while at > 0:
                if ids[at] >= 0:
                    found.append(ids[at])
                else:
                    char = word[start[at]]
                    found.extend(bytes_at[b] for b in reversed((MARK if char == _LITERAL else char).encode("utf-8", "surrogateescape")))
                at = start[at]
            found.reverse()
            out[word] = found
            last = word
        return out


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def marked_parts(text: str) -> Iterator[list[str]]:
    """The marked words of a text, in parts of bounded length; all together they are the marked text."""
    if not text:
        return
    marked = MARK + text.replace(MARK, _LITERAL).replace(" ", MARK)
    at = 0
    while at < len(marked):
        cut = _CUT.search(marked, at + PART_CHARS) if len(marked) - at > PART_CHARS else None
        end = cut.start() if cut else len(marked)
        yield _WORD.findall(marked, at, end)
        at = end


def encode_packed(encoder: WordEncoder, texts: list[str]) -> list[bytes]:
    """The ids of each text as packed 32-bit numbers. The words of short texts are segmented together."""
    short = [next(marked_parts(t), []) if len(t) < PART_CHARS else None for t in texts]
    made = encoder.encode_words({w for words in short if words for w in words})
    known = encoder.known

    def joined(words: list[str], made: dict[str, bytes]) -> bytes:
        return b"".join([known[w] if w in known else made[w] for w in words])

    out = []
    for text, words in zip(texts, short, strict=True):
        if words is not None:
            out.append(joined(words, made))
        else:
            out.append(b"".join(joined(part, encoder.encode_words(set(part))) for part in marked_parts(text)))
    return out


def encode_block(encoder: WordEncoder, texts: list[str]) -> list[list[int]]:
    return [np.frombuffer(ids, dtype=np.int32).tolist() for ids in encode_packed(encoder, texts)]


@lru_cache(maxsize=2)
def _spellings(vocabulary: Vocabulary) -> list[bytes]:
    """What each id adds to a decoded text."""
    out = [p.replace(MARK, " ").encode("utf-8") for p in vocabulary.pieces]
    for byte, number in enumerate(vocabulary.bytes_at):
        out[number] = bytes([byte])
    return out


def decode_bytes(spellings: list[bytes], ids: list[int]) -> bytes:
    out = b"".join(map(spellings.__getitem__, ids))
    return out[1:] if out[:1] == b" " else out


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of a list of ids."""
    return decode_bytes(_spellings(vocabulary), ids).decode("utf-8")


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(load_vocabulary(path))


def _encode(path: str, keep: list[str], text_column: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        spellings = _spellings(load_vocabulary(path)) if check else None
        for batch in batches:
            for start, end, texts in text_blocks(batch, text_column, ENCODE_BYTES):
                missing = pa.array([t is None for t in texts])
                packed = encode_packed(encoder, [(t or b"").decode("utf-8", "surrogateescape") for t in texts])
                ends = pa.array(np.cumsum([0, *[len(x) // 4 for x in packed]]), pa.int32())
                flat = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
                columns = {n: batch.column(n).slice(start, end - start) for n in keep}
                columns["piece_ids"] = pa.ListArray.from_arrays(ends, flat, mask=missing)
                if check:
                    decoded = (None if t is None else decode_bytes(spellings, np.frombuffer(x, dtype=np.int32).tolist()) for t, x in zip(texts, packed, strict=True))
                    facts = [(None, None) if d is None else (len(d.translate(None, _CONTINUATION)), hashlib.sha256(d).hexdigest()) for d in decoded]
                    columns["decoded_chars"] = pa.array([f[0] for f in facts], pa.int32())
                    columns["decoded_sha256"] = pa.array([f[1] for f in facts], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def encode(docs: DataFrame, model_path: str, text_column: str = "text", keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """The ``keep`` columns (default all) with piece_ids. ``model_path`` is a model file that every executor can read.

    With ``check``, the ids are decoded again beside the encoder, and the length (decoded_chars) and digest
    (decoded_sha256) of the decoded text are added.
    """
    ship(docs.sparkSession)
    made = {"piece_ids": T.ArrayType(T.IntegerType())}
    if check:
        made |= {"decoded_chars": T.IntegerType(), "decoded_sha256": T.StringType()}
    rest = fresh(docs, *made).columns
    keep = rest if keep is None else [c for c in keep if c in rest]
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(n, t) for n, t in made.items()]])
    return docs.select(*dict.fromkeys([*keep, text_column])).mapInArrow(_encode(model_path, keep, text_column, check), schema)


def _decode(path: str, ids_column: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = _spellings(load_vocabulary(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = [None if x is None else decode_bytes(spellings, x) for x in part.column(ids_column).to_pylist()]
                columns = {n: part.column(n) for n in keep}
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(texts, pa.binary()).view(pa.string())], names=[*columns, "decoded"])

    return run


def decode(encoded: DataFrame, model_path: str, ids_column: str = "piece_ids", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default all) with decoded, the text of the ids."""
    ship(encoded.sparkSession)
    rest = fresh(encoded, "decoded").columns
    keep = rest if keep is None else [c for c in keep if c in rest]
    schema = T.StructType([*encoded.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.select(*dict.fromkeys([*keep, ids_column])).mapInArrow(_decode(model_path, ids_column, keep), schema)
