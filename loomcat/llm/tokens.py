"""Token ids by the tokenizers library, with bounded memos.

A text is cut at white space where the vocabulary's own rule would cut it too. Each
different chunk of a run of texts is looked up once, and its ids are put in its places by
Arrow. Each worker keeps the ids of the pieces that the vocabulary's rule cuts chunks into (for
a byte-level vocabulary those of chunks too), so its model handles a piece once. Memos take new
entries up to a bound; frequent ones come early, and later ones are worked out each time.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Entries of a worker's memos for a byte-level vocabulary: chunks that are one piece (also read for pieces of others), other chunks, other pieces.
MEMO_SINGLE, MEMO_JOINED, MEMO_PIECES = 800_000, 250_000, 150_000
#: Entries of a worker's memo of pieces for a word vocabulary.
MEMO_WORDS = 800_000
#: Characters that are normalised at once.
NORMALISED = 100_000
#: For Arrow: white space on which rules differ between libraries; texts with it are encoded whole.
ODD_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{180e}]"
#: Texts that a byte-level vocabulary encodes whole: also those with runs of white space, spelled out, which its rule cuts as a whole.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHOLE = rf"{ODD_SPACE}|{_SPACE}{_SPACE}|{_SPACE}\z|\A{_SPACE}"
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    letters = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(letters[b] for b in range(256))


LETTERS = _byte_letters()


def _plain(pattern: str) -> str:
    """The vocabulary's rule for chunks of Latin-1 characters, whose letters and digits are known without Unicode's tables."""
    for name, own in ((r"\p{L}", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"), (r"\p{N}", "0-9\xb2\xb3\xb9\xbc-\xbe")):
        pattern = re.sub(r"\[[^]]*\]", lambda m: m[0].replace(name, own), pattern).replace(name, f"[{own}]")
    return pattern


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, name: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = name == WORD_BPE
        with open(path, encoding="utf-8") as f:
            rule = json.load(f)["pre_tokenizer"]
        pattern = rule["pretokenizers"][0]["pattern"]["Regex"] if self.words else public_tokenizers.PATTERN
        # chunks of a word vocabulary are cut many at once, with a space, which has no ids, after each
        mark = "| " if self.words else ""
        self.cut = regex.compile(pattern + mark).findall
        self.cut_plain = re.compile(_plain(pattern) + mark, re.ASCII).findall
        self.model = self.tokenizer.model.tokenize
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {" ": b""} if self.words else {}
        self.single = self.joined = 0

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        return array("I", [t.id for t in self.model(letters.translate(LETTERS))]).tobytes()

    def _single(self, chunk: str, piece: str) -> bytes:
        """ids of the piece that is the whole chunk."""
        ids = self._ids(piece)
        if self.single < MEMO_SINGLE:
            self.single += 1
            self.chunks[chunk] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self._ids(piece)
        if len(self.pieces) < (MEMO_WORDS if self.words else MEMO_PIECES):
            self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)  # there by now where the text repeats it
        if ids is not None:
            return ids
        pieces = (self.cut_plain if chunk.isascii() else self.cut)(" " + chunk)
        if len(pieces) == 1:
            return self._single(chunk, pieces[0])
        # only the first piece has a space before it, as a chunk by itself has
        head, known = pieces.pop(0), self.pieces.get
        ids = (self.chunks.get(head[1:]) or self._single(head[1:], head)) + b"".join([known(p) or self._piece(p) for p in pieces])
        if self.joined < MEMO_JOINED:
            self.joined += 1
            self.chunks[chunk] = ids
        return ids

    def _normalised(self, chunks: list[str]) -> list[str]:
        """Pieces of the chunks, a space after each chunk's."""
        normal, out = self.tokenizer.normalizer.normalize_str, []
        for a, b in batches_of(chunks, NORMALISED):
            text = normal(" ".join([*chunks[a:b], ""]))
            if text.count(" ") == b - a:
                out += self.cut(text)
            else:  # a chunk that holds white space once it is normalised
                out += [p for c in chunks[a:b] for p in [*(q for q in self.cut(normal(c)) if q != " "), " "]]
        return out

    def _words(self, words: pa.Array) -> tuple[pa.LargeListArray, np.ndarray]:
        """Lists of ids of a word vocabulary's chunks, and each chunk's place among the lists."""
        wide = pc.match_substring_regex(words, r"[^\x{0}-\x{ff}]").to_numpy(zero_copy_only=False)
        near, far = (words.filter(pa.array(own)).to_numpy(zero_copy_only=False).tolist() for own in (~wide, wide))
        # Latin-1 characters are normal as they are, and small by themselves
        pieces = pa.array(self.cut_plain(" ".join([*near, ""]).lower()) + self._normalised(far), pa.large_string()).dictionary_encode()
        at, names = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [self._piece(p) if i is None else i for p, i in zip(names, map(self.pieces.get, names), strict=True)]
        lists = _lists(ids)
        ends = np.cumsum(np.diff(lists.offsets.to_numpy())[at])[at == names.index(" ")]
        places = np.empty(len(words), np.int64)
        places[~wide], places[wide] = np.arange(len(near)), len(near) + np.arange(len(far))
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), lists.take(pa.array(at)).flatten()), places

    def _word_columns(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, ODD_SPACE)
        # a text that is encoded whole has one, empty chunk
        parts = pc.utf8_split_whitespace(pc.if_else(whole, "", texts))
        first = parts.offsets.to_numpy()
        chunks = parts.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first = first - first[0]
        lists, places = self._words(chunks.dictionary)
        order, odd = places[chunks.indices.to_numpy()], texts.filter(whole).to_pylist()
        order[first[:-1][whole.to_numpy(zero_copy_only=False)]] = len(lists) + np.arange(len(odd))
        # entries: the chunks, texts that are encoded whole, the end
        entries = pa.concat_arrays([lists, _lists([*map(self._whole, odd), np.array([end_id], "<u4").tobytes()])])
        return _placed(entries, order, first)

    def columns(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the texts, and all their ids on end, the end id after each text.

        Each different chunk of the texts is looked up once, and its ids are put in its places by Arrow.
        """
        texts = texts.cast(pa.large_string())
        if self.words:
            return self._word_columns(texts, end_id)
        whole = pc.match_substring_regex(texts, WHOLE)
        # a text that is encoded whole has one, empty chunk
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        first = parts.offsets.to_numpy()
        chunks = parts.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first = first - first[0]
        at, words = chunks.indices.to_numpy(), chunks.dictionary
        heads = [t.as_py() if w else h for t, w, h in zip(texts, whole.to_pylist(), words.take(pa.array(at[first[:-1]])).to_pylist(), strict=True)]
        inner = np.ones(len(at), bool)
        inner[first[:-1]] = False
        used = np.flatnonzero(np.bincount(at[inner], minlength=len(words)))
        rest = words.take(pa.array(used)).to_pylist()
        ids = list(map(self.chunks.get, rest))
        if None in ids:
            ids = [self._chunk(c) if i is None else i for c, i in zip(rest, ids, strict=True)]
        # entries: the chunks in use, the heads, the end
        entry = np.zeros(len(words), np.int64)
        entry[used] = np.arange(len(used))
        order = entry[at]
        order[first[:-1]] = len(used) + np.arange(len(heads))
        return _placed(_lists([*ids, *map(self._whole, heads), np.array([end_id], "<u4").tobytes()]), order, first)


def _lists(ids: list[bytes]) -> pa.LargeListArray:
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(np.frombuffer(b"".join(ids), "<u4").view("<i4")))


def _placed(entries: pa.LargeListArray, order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids of texts, and all their ids on end: the entries of order from each text's first on, the last entry after each text."""
    order = np.insert(order, first[1:], len(entries) - 1)
    size = np.diff(entries.offsets.to_numpy())
    return np.add.reduceat(size[order], first[:-1] + np.arange(len(first) - 1)), entries.take(pa.array(order)).flatten().to_numpy()


def encoder(name: str, path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; path: the file, by default that of the installed vocabularies."""
    path = path or public_tokenizers.path(name)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, name)
    return _ENCODERS[path]


def batches_of(texts: list[str] | np.ndarray, chars: int = 400_000):
    """Runs of positions whose texts (or their lengths) hold about so many characters."""
    first, size = 0, 0
    for i, t in enumerate(texts.tolist() if isinstance(texts, np.ndarray) else map(len, texts)):
        size += t
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
