"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix of a word ends in exactly one token. It is the only
token that ends there, was reached by merges, and stands behind the last token
of the shorter prefix without any merge across the seam. So one left-to-right
pass stores the last token of every prefix, and back-pointers give the ids. A
suffix automaton over the vocabulary names the tokens that end at a place; the
seam test undoes the merges of both neighbours, latest first.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxlake.llm.shared import columns, doc_texts, map_rows, tokenizer_json

#: A symbol that ends a word is its character moved up by this much.
FINAL = 0x20000
NEVER = 1 << 60
NONE: frozenset[int] = frozenset()
#: Bounds of the per-process memories (entries); they are emptied when full.
WORDS, SEAMS = 900_000, 1_000_000

# Characters whose normal form, case and class are the same in every library:
# ASCII without separators 1C-1F, Latin-1 and Latin Extended-A without dotted I.
UNUSUAL = re.compile("[^\t-\r -~¡-įı-ſ]")
_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r "
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_PIECES = re.compile(f"{_ENDINGS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
BYTE_PIECES = re.compile(f"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


CHARACTERS = byte_characters()
BYTES = {c: b for b, c in enumerate(CHARACTERS)}
ASCII_CHARACTERS = {b: CHARACTERS[b] for b in range(128) if chr(b) != CHARACTERS[b]}


class SuffixAutomaton:
    """All substrings of the given words; a state holds those that end at the same places.

    Reading a text, it knows the longest end of what it has read that is a
    substring of any word. Words that end there are of that state, no longer
    than the match, or of the states its suffix links lead to.
    """

    def __init__(self, words: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for word in words:
            at = 0
            for c in word:
                at = self._extend(at, c)
        own: dict[int, list[tuple[int, int]]] = {}
        for word, value in words.items():
            at = 0
            for c in word:
                at = self.next[at][c]
            own.setdefault(at, []).append((len(word), value))
        self.own = {at: tuple(sorted(found, reverse=True)) for at, found in own.items()}
        self.known: dict[int, tuple[tuple[int, int], ...]] = {}
        # the next state on the way of suffix links that holds words, -1 for none
        self.back = [-1] * len(self.next)
        for at in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[at]
            self.back[at] = up if up in self.own else self.back[up]

    def _state(self, length: int, link: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, c: str, old: int) -> int:
        """The state of the substrings of old up to one longer than at's, taken out of it."""
        new = self._state(self.length[at] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = new
        while at >= 0 and self.next[at].get(c) == old:
            self.next[at][c] = new
            at = self.link[at]
        return new

    def _extend(self, at: int, c: str) -> int:
        """The state of one more character behind the word that ends in at."""
        old = self.next[at].get(c)
        if old is not None:
            return old if self.length[old] == self.length[at] + 1 else self._split(at, c, old)
        new = self._state(self.length[at] + 1, 0, {})
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][c]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, c, old)
        return new

    def ending(self, at: int) -> tuple[tuple[int, int], ...]:
        """(length, value) of all words that end where a state's longest substring does, longest first."""
        found = self.known.get(at)
        if found is None:
            own, up = self.own.get(at, ()), self.back[at]
            found = self.known[at] = own + (self.ending(up) if up >= 0 else ())
        return found


class PrefixBpe:
    """Vocabulary, merges and the seam test; encodes one word of symbols."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.suffix = suffix or ""
        size = max(vocab.values()) + 1
        symbols: dict[str, str] = {}
        for text in vocab:
            core = text[: -len(self.suffix)] if self.suffix and text.endswith(self.suffix) else text
            if len(core) == 1:
                symbols[text] = core if core == text else chr(ord(core) + FINAL)
        self.rank = [-1] * size
        self.parts: list = [None] * size
        self.length = [1] * size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for order, pair in enumerate(merges):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            joined = left + right
            token, pieces = vocab[joined], (vocab[left], vocab[right])
            symbols[joined] = symbols[left] + symbols[right]
            self.rank[token], self.parts[token] = order, pieces
            self.length[token] = self.length[pieces[0]] + self.length[pieces[1]]
            self.merge_rank[pieces] = order
        # by token: tokens known to stand before it; empty sets of their own would take 20 MB in each process
        self.fitting: list[set[int] | frozenset[int]] = [NONE] * size
        self.unfit: list[set[int] | frozenset[int]] = [NONE] * size
        self.n_seams = 0
        self.symbols: dict[int, str] = {}  # of the tokens that merges reach
        reached = set()
        for text, token in sorted(((t, vocab[t]) for t in symbols), key=lambda x: self.rank[x[1]]):
            if self.parts[token] is None or (reached.issuperset(self.parts[token]) and self._seam(*self.parts[token], top=False)):
                reached.add(token)
                self.symbols[token] = symbols[text]

    @functools.cached_property
    def automaton(self) -> SuffixAutomaton:
        return SuffixAutomaton({symbols: token for token, symbols in self.symbols.items()})

    def _seam(self, left: int, right: int, top: bool = True) -> bool:
        """Whether no merge joins the two tokens; top: also test the pair itself.

        A token exists from its own merge until its parent's. Merges of equal
        rank go from left to right, so the right parent may be as early as the
        crossing merge, the left one may not.
        """
        rank, parts, merged = self.rank, self.parts, self.merge_rank
        left_until = right_until = NEVER
        while True:
            crossing = merged.get((left, right)) if top else None
            if crossing is not None and crossing < left_until and crossing <= right_until:
                return False
            top = True
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left_until, left = a, parts[left][1]
            else:
                right_until, right = b, parts[right][0]

    def _fits(self, before: int, token: int) -> bool:
        """The seam test, remembered for both answers."""
        if self.n_seams >= SEAMS:
            for table in (self.fitting, self.unfit):
                table[:] = [NONE] * len(table)
            self.n_seams = 0
        self.n_seams += 1
        fits = self._seam(before, token)
        table = self.fitting if fits else self.unfit
        if table[token] is NONE:
            table[token] = set()
        table[token].add(before)
        return fits

    def encode(self, symbols: str) -> list[int]:
        last, fitting, unfit = [-1] * len(symbols), self.fitting, self.unfit
        a = self.automaton
        moves, link, longest, known = a.next, a.link, a.length, a.known
        at = matched = 0
        for end, c in enumerate(symbols):
            to = moves[at].get(c)
            while to is None and at:
                at = link[at]
                matched = longest[at]
                to = moves[at].get(c)
            if to is None:
                continue
            at, matched = to, matched + 1
            for size, token in known[at] if at in known else a.ending(at):
                if size > matched:  # of this state, but not of this text
                    continue
                if size > end:
                    last[end] = token
                    break
                before = last[end - size]
                if before in fitting[token] or before >= 0 and before not in unfit[token] and self._fits(before, token):
                    last[end] = token
                    break
        ids, length, at = [], self.length, len(symbols) - 1
        while at >= 0:
            token = last[at]
            if token >= 0:  # a symbol outside the vocabulary has no id
                ids.append(token)
                at -= length[token]
            else:
                at -= 1
        ids.reverse()
        return ids


class Codec:
    """Texts to ids and back, as the given tokenizer definition says."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.bpe = PrefixBpe(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.by_id = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for text, token in [*model["vocab"].items(), *self.special.items()]:
            self.by_id[token] = text
        self.words = bool(spec["normalizer"])
        self.byte_decoder = bool(spec["decoder"])
        self.definition = definition
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.definition)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token stands for itself."""
        if self.special_at and any(s in text for s in self.special):
            return [p for part in self.special_at.split(text) if part for p in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not UNUSUAL.search(text):
            return WORD_PIECES.findall(text.lower()) if self.words else BYTE_PIECES.findall(text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(map(BYTES.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        symbols = piece.translate(ASCII_CHARACTERS) if piece.isascii() else "".join([CHARACTERS[b] for b in piece.encode()])
        if self.bpe.suffix and symbols:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + FINAL)
        return self.bpe.encode(symbols)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece_ids(p)]

    def decode(self, ids: list[int]) -> str:
        texts = [self.by_id[i] for i in ids]
        if not self.byte_decoder:
            return " ".join(texts)
        return b"".join(t.encode() if t in self.special else bytes(map(BYTES.__getitem__, t)) for t in texts).decode("utf-8", "replace")


class Memo(dict):
    """Values by piece, made when first asked for; emptied when full."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        if len(self) >= WORDS:
            self.clear()
        value = self[piece] = self.make(piece)
        return value


@functools.lru_cache(maxsize=4)
def codec(definition: str) -> Codec:
    """One codec for each definition and Python process."""
    return Codec(definition)


class BulkEncoder:
    """The same ids through tiktoken's compiled merges, for operators that only need ids.

    tiktoken merges the pair whose joined bytes have the lowest rank. For tokens
    that merges reach this is the merge list's own order: while two neighbours
    span exactly a token's bytes, they are its two parts. The end of a word is
    a byte that plain texts do not have; joining it to the last letter ranks
    before all merges.
    """

    MARK = "\x01"

    def __init__(self, definition: str):
        import tiktoken

        self.codec = c = codec(definition)
        ranks: dict[bytes, int] = {}
        ids = np.zeros(512 + len(c.by_id), "<u4")
        alone = {f: 256 + BYTES[chr(f)] for f in map(ord, CHARACTERS)}
        for token, symbols in c.bpe.symbols.items():
            last = ord(symbols[-1])
            final = last >= FINAL
            data = bytes(map(BYTES.__getitem__, symbols[:-1])) + bytes([BYTES[chr(last - FINAL if final else last)]]) + self.MARK.encode() * final
            if c.bpe.rank[token] >= 0:
                rank = 512 + c.bpe.rank[token]
            else:
                rank = alone[last - FINAL] if final else data[0]
            ranks[data], ids[rank] = rank, token
        self.ids = ids
        pattern = f"[^{self.MARK}]+{self.MARK}" if c.words else BYTE_PIECES.pattern
        self.tiktoken = tiktoken.Encoding("bulk", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        c = self.codec
        if UNUSUAL.search(text) or any(s in text for s in c.special):
            return np.array(c.encode(text), "<u4")
        if c.words:
            words = WORD_PIECES.findall(text.lower())
            text = self.MARK.join([*words, ""])
        return self.ids[np.frombuffer(array("I", self.tiktoken.encode_ordinary(text)), np.uint32)]


@functools.lru_cache(maxsize=4)
def bulk(definition: str) -> BulkEncoder:
    return BulkEncoder(definition)


def encoded(definition: str, text: str) -> np.ndarray:
    """All ids of a text as unsigned 32-bit integers."""
    return bulk(definition).encode(text)


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, ids of every document.

    A null or empty text has no ids; other columns are ignored, whatever their
    names; repeated rows and rows without doc_id give one row each; an empty
    table gives none. Texts of any length are encoded whole.
    """
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo, c = _piece_ids(definition.value), codec(definition.value)
        ids = pa.array([[i for p in c.pieces(t) for i in memo[p]] for t in batch["text"].to_pylist()], pa.list_(pa.int32()))
        return columns(doc_id=batch["doc_id"], ids=ids)

    return map_rows(doc_texts(docs), part, "doc_id long, ids array<int>", rows=64)


def decode_documents(ids: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, text decoded from ids, special tokens included; null ids give an empty text."""
    definition = ids.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(definition.value)
        return columns(doc_id=batch["doc_id"], text=pa.array([c.decode(x or []) for x in batch["ids"].to_pylist()], pa.string()))

    return map_rows(ids.select("doc_id", "ids"), part, "doc_id long, text string", rows=64)


def encoding_digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded, without storing either.

    Ids and decoded text are remembered for each piece. Word-level vocabularies
    decode token by token; byte-level ones are decoded from the whole id list.
    Cases as in encode_documents.
    """
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, memo, n, coded, decoded = codec(definition.value), _piece_texts(definition.value), [], [], []
        for text in batch["text"].to_pylist():
            found = [memo[p] for p in c.pieces(text)]
            ids = " ".join([x[0] for x in found if x[0]])
            n.append(ids.count(" ") + 1 if ids else 0)
            coded.append(sha(ids))
            back = c.decode([int(i) for i in ids.split()]) if c.byte_decoder else " ".join([x[1] for x in found if x[0]])
            decoded.append(sha(back))
        return columns(doc_id=batch["doc_id"], n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(coded, pa.string()), decoded_sha256=pa.array(decoded, pa.string()))

    return map_rows(doc_texts(docs), part, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@functools.lru_cache(maxsize=2)
def _piece_ids(definition: str) -> Memo:
    return Memo(codec(definition).piece_ids)


@functools.lru_cache(maxsize=2)
def _piece_texts(definition: str) -> Memo:
    c = codec(definition)

    def make(piece: str) -> tuple[str, str]:
        ids = c.piece_ids(piece)
        return " ".join(map(str, ids)), " ".join([c.by_id[i] for i in ids])

    return Memo(make)
