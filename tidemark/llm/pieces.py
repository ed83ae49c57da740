"""SentencePiece BPE encoding and decoding from a merge-type prefix table.

For a byte-pair vocabulary every prefix of a text has exactly one last token in its encoding.  The table
stores that token for each prefix: an automaton lists the pieces that end at a position, and the one to
store is the piece that is compatible with the token stored where it begins.  Two tokens are compatible
if merging their joined characters yields just these two (tested by merging, and remembered).  The ids
are then read backwards from the last prefix.  Time is linear in the text, also for one endless word.

No piece of the usual vocabularies crosses from a letter to a following space mark, so a text is cut
there and repeated words are looked up; a vocabulary that has such pieces is encoded in one go.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words that one Python worker remembers, about half a kilobyte each.
REMEMBERED = 300_000
#: Documents that a task holds at a time.
ROWS = 256


class Codec:
    """Encoder and decoder for a SentencePiece BPE model given as bytes."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, trainer, kinds = proto.normalizer_spec, proto.trainer_spec, pb.ModelProto.SentencePiece
        if trainer.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normaliser that keep white space are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.unknown = trainer.unk_id
        self.names = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.byte_ids = {}
        self.byte_of = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_of[i] = int(p.piece[1:-1], 16)
                self.byte_ids[self.byte_of[i]] = i
        self.surface = [p.piece.replace(SPACE, " ") if p.type == kinds.NORMAL else "" for p in proto.pieces]
        self.surface[self.unknown] = trainer.unk_surface
        self.strips = spec.add_dummy_prefix
        self.cuts = self._cuts()
        self.fits: dict[str, dict[str, bool]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:  # others never come out of merging
                self.automaton.add_word(piece, (piece, len(piece), self.row_of(piece), i))
        self.automaton.make_automaton()

    def _cuts(self) -> re.Pattern | None:
        """Cuts a marked text before each run of space marks, unless a piece of the vocabulary lies across."""
        joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        if SPACE not in self.ids or any(x != SPACE and y == SPACE for x, y in joined):
            return None
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """Characters merged by best score, leftmost first, until no neighbours form a piece."""
        score, parts = self.score, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        row = self.row_of(left)
        known = row.get(right)
        if known is None:
            known = row[right] = self.merged(left + right) == [left, right]
        return known

    def alone(self, character: str) -> tuple:
        return (character, 1, self.row_of(character), self.ids.get(character))

    def row_of(self, left: str) -> dict[str, bool]:
        """What is known of tokens after ``left``; at most one row for each token and character, and one entry
        in it for each piece that was met there."""
        row = self.fits.get(left)
        if row is None:
            row = self.fits[left] = {}
        return row

    def tokens(self, text: str) -> list[tuple]:
        """Tokens of a text that is already marked with spaces, as (piece, size, what may follow, id);
        characters without a piece stand alone and have no id."""
        n, alone, test = len(text), self.alone, self.compatible
        last: list[tuple | None] = [None] * n  # the last token of the text up to and with this place
        for end, token in self.automaton.iter(text):
            if last[end] is not None:
                continue
            begin = end - token[1]
            if begin >= 0:
                left = last[begin]
                if left is None:  # no piece fits there, so the character stands alone
                    left = last[begin] = alone(text[begin])
                ok = left[2].get(token[0])
                if ok is None:
                    ok = test(left[0], token[0])
                if not ok:
                    continue
            last[end] = token
        out, end = [], n - 1
        while end >= 0:
            token = last[end] or alone(text[end])
            out.append(token)
            end -= token[1]
        out.reverse()
        return out

    def ids_of(self, marked: str) -> list[int]:
        found = self.tokens(marked)
        out: list[int] = [t[3] for t in found]
        if None not in out:
            return out
        out = []
        for piece, _, _, i in found:
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return out

    def marked(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def chunks(self, marked: str) -> list[str]:
        return self.cuts.findall(marked) if self.cuts else [marked] if marked else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(self.marked(text)) for i in self.ids_of(c)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ``ids``; ``first`` drops the space that encoding put in front."""
        if not first and self.byte_of.keys().isdisjoint(ids):
            return "".join([self.surface[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            s = self.surface[i]
            if first and self.strips and self.names[i].startswith(SPACE) and not any(out):
                first, s = False, s[1:]
            out.append(s)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


#: One memo for each model in a Python worker, so tasks that follow find what earlier ones have learnt.
_MEMOS: dict[str, Memo] = {}


def memo_of(model: bytes, remembered: int) -> Memo:
    key = f"{hashlib.sha256(model).hexdigest()}-{remembered}"
    if key not in _MEMOS:
        _MEMOS[key] = Memo(Codec(model), remembered)
    return _MEMOS[key]


class Memo:
    """Encodes whole texts and remembers short words: (ids as int32 bytes, ids as text, decoded) of each.

    Words seen for the first time and words seen again are kept apart, up to ``remembered`` in all, and the
    former are forgotten first: most words of a corpus occur once.
    """

    def __init__(self, codec: Codec, remembered: int):
        self.codec, self.most, self.known, self.new = codec, remembered // 2, {}, {}

    def chunk(self, c: str) -> tuple[bytes, str, str]:
        got = self.new.pop(c, None)
        if got is not None:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[c] = got
            return got
        ids = self.codec.ids_of(c)
        got = (array("i", ids).tobytes(), ",".join(map(str, ids)), self.codec.decode(ids, first=False))
        if len(c) <= 48:
            if len(self.new) >= self.most:
                self.new.clear()
            self.new[c] = got
        return got

    def text(self, text: str) -> list[tuple[bytes, str, str]]:
        known, chunk = self.known, self.chunk
        return [known.get(c) or chunk(c) for c in self.codec.chunks(self.codec.marked(text))]

    def decoded(self, parts: list[tuple[bytes, str, str]]) -> str:
        """As decode() of all ids: the bytes of a character are one run within a chunk, and the first piece
        begins with the space that encoding put in front."""
        whole = "".join([p[2] for p in parts])
        return whole[1:] if self.codec.strips and whole.startswith(" ") else whole


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` (with ``text``; other columns are kept) with n_tokens, ids_sha256, decoded_sha256 and, if
    asked for, the ids as array<int>; the column ``text`` is then the decoded text.

    A null or empty text has no ids, 0 tokens and the digests of the empty string; its text stays as it
    is.  Rows are independent: repeated rows give equal rows, an empty table an empty result.  Result
    columns replace input columns of the same name.  The model (0.5 MB) goes to the tasks with the code.
    """
    out = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if ids else [])
    kept = [c for c in docs.columns if c.lower() not in out and (ids or c.lower() != "text")]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if ids else [F.col("text").alias("text")]))
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes if ids or c != "text")
    schema = f"{fields}{', ' if fields else ''}n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = None
        for batch in (b.slice(i, ROWS) for b in it for i in range(0, b.num_rows, ROWS)):
            memo = memo or memo_of(shared.value, remembered)
            column = batch.column(batch.schema.get_field_index("text"))
            n, shas, decs, lists, texts = [], [], [], [], []
            for value in column:
                text = value.as_py()
                parts = memo.text(text) if text else []
                packed = b"".join([p[0] for p in parts])
                n.append(len(packed) // 4)
                shas.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                decoded = memo.decoded(parts)
                decs.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    lists.append(packed)
                    texts.append(decoded if text else text)
            names, arrays = [], []
            for name, a in zip(batch.schema.names, batch.columns):
                if name == "text":
                    if not ids:
                        continue
                    a = pa.array(texts, pa.string())
                names.append(name)
                arrays.append(a)
            arrays += [pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decs, pa.string())]
            names += out[:3]
            if ids:
                flat = pa.array(np.frombuffer(b"".join(lists), np.int32))
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary file that is installed with Python."""
    import public_tokenizers

    return public_tokenizers.path(name)
