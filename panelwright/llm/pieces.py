"""Exact encoding of a merge-type piece vocabulary by backtracking, and decoding.

A sequence of pieces is what the merges produce exactly if every two neighbours are: merging the text of both
again gives the two pieces back. So a text is covered from the left: an Aho-Corasick automaton gives the longest
piece at each place, a piece is accepted if it is compatible with the piece before it, else the next shorter one
is tried; where none fits, the place is marked as failed in a bitfield and the last piece is taken back. Every
place fails at most once, so the work is linear in the text.

Where no piece of the vocabulary can cross (before blank marks, at line ends, from letters to most signs) texts are cut, and the
results of recent words are remembered (a bounded number per worker).

Null texts count as empty and give no ids. Characters without a piece become their UTF-8 byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
#: Words, and pairs of pieces, that a worker remembers before it starts a new memory. Words keep one older memory, until the task ends.
WORDS, PAIRS = 150_000, 300_000
#: Texts encoded at once.
ROWS = 256


class PieceCodec:
    """Encodes and decodes with the vocabulary and scores of a model file of the merge type (given as bytes)."""

    def __init__(self, model: bytes):
        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [reader.id_to_piece(i) for i in range(reader.vocab_size())]
        self.byte_of = {i: int(p[1:-1], 16) for i, p in enumerate(self.pieces) if reader.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.special = {i for i in range(len(self.pieces)) if reader.is_control(i) or reader.is_unknown(i)}
        self.unknown = reader.unk_id()
        plain = [i for i in range(len(self.pieces)) if i not in self.byte_of and i not in self.special and not reader.is_unused(i)]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: reader.get_score(i) for i in plain}
        self.length = [len(p) for p in self.pieces]
        self._pairs: dict[int, bool] = {}
        self._sound: dict[int, bool] = {}
        self._shorter: dict[int, int | None] = {}
        self._words: dict[str, tuple[tuple[int, ...], str, str]] = {}
        self._older: dict[str, tuple[tuple[int, ...], str, str]] = {}
        self._known = frozenset(p for p in self.id_of if len(p) == 1)
        machine = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            machine.add_word(piece, i)
        machine.make_automaton()
        self._machine, self._reach = machine, max(self.length)
        self._cut = self._boundaries()

    def _boundaries(self) -> re.Pattern:
        """Cuts a text where no piece crosses: before blank marks, around line ends, and between a word of letters and an ASCII sign that follows a letter in no piece."""
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.id_of):
            return re.compile(r"[\s\S]+")
        letter = r"[^\W\d_]"
        after = {y for p in self.id_of for x, y in zip(p, p[1:]) if re.match(letter, x)}
        signs = "".join(map(re.escape, sorted(c for c in self._known - after if c.isascii())))
        word = f"(?:{letter}+(?=[{signs}])|[^{MARK}\n]+)" if signs else f"[^{MARK}\n]+"
        return re.compile(f"{MARK}*{word}|{MARK}+|\n+")

    def merge(self, text: str) -> list[str]:
        """Merges neighbours by best score, leftmost first, until none of them form a piece."""
        parts, score = list(text), self.score
        joint = [score.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(joint):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at < len(joint):
                joint[at] = score.get(parts[at] + parts[at + 1])
            if at:
                joint[at - 1] = score.get(parts[at - 1] + parts[at])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of both pieces, each merged to itself, leaves the two."""
        key = a << 24 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return known

    def sound(self, i: int) -> bool:
        """Whether merging the piece's own text gives the piece (pieces that no merge reaches never occur)."""
        if i not in self._sound:
            self._sound[i] = self.merge(self.pieces[i]) == [self.pieces[i]]
        return self._sound[i]

    def shorter(self, i: int) -> int | None:
        """The longest other piece that the piece begins with."""
        if i not in self._shorter:
            p = self.pieces[i]
            self._shorter[i] = next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), None)
        return self._shorter[i]

    def _longest(self, text: str, at: int) -> int:
        """The longest piece at a place: the automaton tells how far its branch goes, the last piece on the branch is it."""
        ahead = text[at: at + self._reach]
        end = self._machine.longest_prefix(ahead)
        i = self.id_of.get(ahead[:end])
        while i is None:
            end -= 1
            i = self.id_of.get(ahead[:end])
        return i

    def _cover(self, text: str) -> list[int]:
        """The pieces of a text all of whose characters are pieces."""
        n, length, longest, pairs = len(text), self.length, self._longest, self._pairs
        usable, out, at, last = bytearray(b"\x01") * (n + 1), [], 0, -1
        piece: int | None = longest(text, 0)
        while at < n:
            while piece is not None:
                end = at + length[piece]
                if usable[end]:
                    if last < 0:
                        if self.sound(piece):
                            break
                    else:
                        fits = pairs.get(last << 24 | piece)
                        if self.compatible(last, piece) if fits is None else fits:
                            break
                piece = self.shorter(piece)
            if piece is None:
                if last < 0:
                    raise ValueError("no covering; the vocabulary is not of the merge type")
                usable[at] = 0
                piece = out.pop()
                at -= length[piece]
                last = out[-1] if out else -1
            else:
                out.append(piece)
                at, last = end, piece
                piece = longest(text, at) if at < n else None
        return out

    def _word(self, word: str) -> tuple[tuple[int, ...], str, str]:
        found = self._older.get(word)
        if found is None:
            ids = self._cover(word) if self._known.issuperset(word) else self._with_unknown(word)
            found = tuple(ids), ",".join(map(str, ids)), self._plain(ids)
        if len(word) < 64:
            if len(self._words) >= WORDS:
                self._older, self._words = self._words, {}
            self._words[word] = found
        return found

    def _with_unknown(self, word: str) -> list[int]:
        """Characters that are no pieces cut the word, and become their bytes."""
        ids: list[int] = []
        for known, run in groupby(word, self._known.__contains__):
            if known:
                ids += self._cover("".join(run))
            else:
                ids += [self.id_of_byte.get(b, self.unknown) for b in "".join(run).encode()]
        return ids

    def forget(self) -> None:
        self._words, self._older = {}, {}

    def words(self, text: str) -> list[tuple[tuple[int, ...], str, str]]:
        """Per word of the text: its ids, the ids as text, and what they decode to (with the leading blank mark)."""
        if not text:
            return []
        out = []
        for w in self._cut.findall(MARK + text.replace(" ", MARK)):
            out.append(self._words.get(w) or self._word(w))
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids, _, _ in self.words(text) for i in ids]

    def _plain(self, ids) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(_lenient(run))
            run = bytearray()
            out.append(" ⁇ " if i == self.unknown else "" if i in self.special else self.pieces[i].replace(MARK, " "))
        return "".join(out) + _lenient(run)

    def decode(self, ids) -> str:
        """The text of the ids, without the blank put before it."""
        first = next((i for i in ids if i == self.unknown or i not in self.special), self.unknown)
        text = self._plain(ids)
        return text[1:] if self.pieces[first].startswith(MARK) else text


def _lenient(run: bytearray) -> str:
    """Bytes as UTF-8; every byte that is not part of a character becomes U+FFFD."""
    out, at = "", 0
    while at < len(run):
        for n in (4, 3, 2, 1):
            try:
                c = bytes(run[at: at + n]).decode()
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out, at = out + c, at + n
                break
        else:
            out, at = out + "�", at + 1
    return out


_codecs: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The codec of a model, made once per worker."""
    key = hashlib.md5(model).digest()
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _slices(own: PieceCodec, batches):
    """Parts of the batches with the words of each text; the words remembered go with the task."""
    try:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield part.column("doc_id"), (own.words(t or "") for t in part.column("text").to_pylist())
    finally:
        own.forget()


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row: ``doc_id``, ``ids`` and ``decoded``."""

    def run(batches):
        for doc_id, texts in _slices(codec(model), batches):
            ids, decoded = [], []
            for ws in texts:
                ids.append([i for w in ws for i in w[0]])
                decoded.append("".join([w[2] for w in ws])[1:])
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """As ``encode_documents``, with digests of ids and decoded text rather than both at full length."""

    def run(batches):
        sha = hashlib.sha256
        for doc_id, texts in _slices(codec(model), batches):
            n, ids, decoded = [], [], []
            for ws in texts:
                n.append(sum([len(w[0]) for w in ws]))
                ids.append(sha(",".join([w[1] for w in ws]).encode()).hexdigest())
                decoded.append(sha("".join([w[2] for w in ws])[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
