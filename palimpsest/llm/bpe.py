"""Byte-level BPE through the tokenizers library, with each distinct space-separated piece encoded once.

The library's own splitter dominates its time.  A text can be cut before any space that stands between
two non-space characters: no match of the byte-level splitter crosses such a place, and what follows
does not depend on what stood before.  So a text's ids are the ids of its first piece and of " " + piece
for the others, and a two-generation memo of bounded size answers most of them.  That holds for byte-level files
without a normalizer; with any other file the library encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces of letters that every Unicode version knows as letters, digits, plain punctuation and single inner line ends.
#: The splitter's matches in them are the runs of one class, the first of which takes the space before the piece.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r".,;:!?*$%&#|()\-"
PLAIN = re.compile(rf"[{LETTERS}0-9{MARKS}]+(?:\n[{LETTERS}0-9{MARKS}]+)*\Z")
RUNS = re.compile(rf"[{LETTERS}]+|[0-9]+|[{MARKS}]+|\n")
#: Bounds of the memo: pieces, and characters of one.
MEMO_PIECES, MEMO_CHARS = 1_000_000, 64


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memo(dict):
    """piece -> what make(piece) gave; beyond the bound the older generation goes, and long pieces aren't held."""

    def __init__(self, make, bound: int = MEMO_PIECES):
        super().__init__()
        self.make, self.bound, self.old = make, bound // 2, {}

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        self.hold(piece, found)
        return found

    def hold(self, piece: str, found) -> None:
        if len(piece) > MEMO_CHARS:
            return
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[piece] = found

    def held(self, piece: str):
        """What is held of a piece, else None."""
        found = self.get(piece)
        return self.old.get(piece) if found is None else found


def is_plain(spec: dict) -> bool:
    """Whether a tokenizers file splits as this module takes for granted, and no added token can stand in a plain piece."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    usual = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    apart = all(x.split() == [x] and not PLAIN.match(x) for x in added) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    return usual and bool(level) and apart and not spec.get("normalizer")


class Bpe:
    """What texts are encoded to: packed ids, or with counting their number only.

    Packed ids are unsigned 16-bit integers where the vocabulary allows, else 32-bit ones, in native order.
    """

    def __init__(self, path: str, counting: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:  # a file of the library, on every machine
            self.plain = is_plain(json.load(f))
        self.model = self.tokenizer.model
        if self.plain:
            self.model._resize_cache(0)  # the memo stands in for it
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.counting = counting
        self.cat = sum if counting else b"".join
        self.table = byte_alphabet()
        self.space = self.table[32]
        self.runs = Memo(self.one_match, MEMO_PIECES // 4)
        self.memo = Memo(self.after_space)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def by_library(self, text: str):
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return len(found) if self.counting else self.pack(found.ids)

    def one_match(self, run: str):
        """One match of the splitter, in which a space comes first if at all."""
        if run.isascii() and run != "\n":
            mapped = run.replace(" ", self.space)
        else:
            mapped = run.encode().decode("latin-1").translate(self.table)
        found = self.model.tokenize(mapped)
        return len(found) if self.counting else array(self.code, [t.id for t in found]).tobytes()

    def whole(self, text: str, before: str = ""):
        """A text, or the space before it and the text."""
        if text.isalpha() and text.isascii():
            return self.one_match(before + text)
        if not PLAIN.match(text):
            return self.by_library(before + text)
        first, *rest = RUNS.findall(text)
        ids = self.memo[first] if before and rest else self.runs[before + first]
        return self.cat([ids, *map(self.runs.__getitem__, rest)]) if rest else ids

    def after_space(self, piece: str):
        """" " + piece; None where the piece touches white space and so isn't independent."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self.whole(piece, " ")

    def by_parts(self, text: str) -> Iterator:
        """For texts with runs of white space: cut at safe places only."""
        for k, piece in enumerate(SAFE.split(text)):
            found = self.memo[piece] if k else None
            yield self.whole(piece, " " * (k > 0)) if found is None else found

    def encode(self, text: str):
        """A whole text.  With a plain file it may begin with a space that stood at a safe place."""
        if not self.plain:
            return self.by_library(text)
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace() or not first and text[1:2].isspace():
                raise TypeError
            found = self.cat(map(self.memo.__getitem__, rest))
            return self.whole(first) + found if first else found
        except TypeError:
            return self.cat(self.by_parts(text))

    def lengths(self, keys: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(keys, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of ids: the distinct pieces of all the texts that the memo doesn't hold are encoded as one batch.

        Texts with runs of white space have other pieces, whose missing ones are a second batch.
        """
        if not self.plain:
            return self.lengths(texts)
        split = [t.split(" ") for t in texts]
        out = self.summed(split)
        ragged = [k for k, n in enumerate(out) if n is None]
        if ragged:
            for k, n in zip(ragged, self.summed([SAFE.split(texts[k]) for k in ragged], strict=False), strict=True):
                out[k] = n
        return out

    def summed(self, split: list[list[str]], strict: bool = True) -> list[int | None]:
        """For each list of pieces, its number of ids; None where, with strict, a piece depends on those around it."""
        known, ask = {}, []
        for w in set(chain.from_iterable(p[1:] for p in split)):
            if strict and (not w or w[0].isspace() or w[-1].isspace()):
                known[w] = -(1 << 60)
            elif (n := self.memo.held(w)) is not None:
                known[w] = n
            else:
                ask.append(w)
        firsts = list({p[0] for p in split} - {""})
        got = self.lengths([*(" " + w for w in ask), *firsts])
        for w, n in zip(ask, got, strict=False):
            known[w] = n
            if not w[-1:].isspace():
                self.memo.hold(w, n)
        begins = dict(zip(firsts, got[len(ask) :], strict=True)) | {"": 0}
        sums = [begins[p[0]] + sum(map(known.__getitem__, p[1:])) for p in split]
        return [None if n < 0 or strict and p[0][-1:].isspace() else n for n, p in zip(sums, split, strict=True)]


class Pieces:
    """A sentencepiece model, with the interface of Bpe."""

    def __init__(self, path: str, counting: bool = False):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.code, self.counting = "I", counting

    def encode(self, text: str):
        ids = self.model.encode(text)
        return len(ids) if self.counting else array(self.code, ids).tobytes()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


_LOADED: dict[tuple[str, bool], Bpe | Pieces] = {}


def load(path: str, counting: bool = False) -> Bpe | Pieces:
    """One encoder, with its memo, for each Python worker and file: sentencepiece for .model, tokenizers for others."""
    if (path, counting) not in _LOADED:
        _LOADED[path, counting] = (Pieces if path.endswith(".model") else Bpe)(path, counting)
    return _LOADED[path, counting]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
