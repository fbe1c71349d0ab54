"""Exact subword ids at chunk-memo speed, on Arrow arrays.

Whole texts are cut only where the tokenizer itself can never join across the cut.
Cutting and finding the distinct chunks of a run of texts are Arrow kernels; each
distinct chunk is encoded by the ``tokenizers`` library, and its ids are remembered; the
ids of the texts are gathered by numpy. So the result equals encoding the whole texts.
Texts for which no cut is known are encoded whole.

In plain texts (characters below ``PLAIN``) a comma or stop that ends a word is a chunk
of its own, and where the tokenizer drops case, so does the cut: far fewer chunks are
distinct. A chunk that is one run of letters goes to the library's model at once; other
chunks take all steps of its tokenizer, many in one call with a separator between them.
What the tokenizer does to each plain character is asked when the encoder is made.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks remembered by one Python worker.
MEMO_ENTRIES = 500_000
#: Chunks encoded in one call.
JOINED = 256
#: Bytes of text encoded in one run.
RUN_BYTES = 2_000_000
#: Characters below this one stand alone: none combines with another or has a case that depends on others.
PLAIN = 0x300

#: Between chunks while texts are cut; a byte that no text holds.
_CUT = b"\xff"
#: Texts (RE2) with other white space than single blanks and line feeds between words.
_ODD = (
    r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]|\A[ \n]|[ \n]\z"
)
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
_ONE_WORD = re.compile(r" ?\S+")
#: A comma or stop (RE2) that ends a word but need not begin there what the tokenizer takes as one.
_RUN_ON = r"[^\pL\pN][,.][ \n]"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """ids of texts as arrays of ``dtype``.

    A byte-level tokenizer attaches one leading blank to a word, so texts are cut
    before each single blank between words, and around a line feed between words. A
    tokenizer that drops white space is cut at blanks and line feeds.
    """

    _cache: dict[str, "ChunkEncoder"] = {}

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        self.mode = "whole"
        if plain and pre.get("type") == "ByteLevel" and norm is None and not pre.get("add_prefix_space"):
            self.mode = "leading"
        elif plain and pre.get("type") == "Sequence" and _drops_space(pre):
            self.mode = "dropped"
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 65536 else "<u4")
        self.memo_entries = memo_entries
        self._ask_plain(pre, [t["content"] for t in spec.get("added_tokens", [])])
        # a separator with one id of its own, which no joined chunk can give
        self.separator, self.separator_char = {"leading": ("\n", "\n"), "dropped": (" \x01 ", "\x01")}.get(self.mode, ("", ""))
        alone = self._ids([self.separator])[0] if self.separator else []
        a, b, both = self._ids(["a", " b", f"a{self.separator} b"])
        self.separator_id = int(alone[0]) if len(alone) == 1 and both.tolist() == [*a, *alone, *b] else None
        self._forget()

    @classmethod
    def of(cls, name: str) -> "ChunkEncoder":
        """One encoder per vocabulary and Python process."""
        if name not in cls._cache:
            cls._cache[name] = cls(name if os.path.isabs(name) else tokenizer_path(name))
        return cls._cache[name]

    def _ask_plain(self, pre: dict, added: list[str]) -> None:
        """``coarse``: what texts hold (RE2) that are not cut at commas; ``letters``: chunks that are one word to the model, as ``level`` writes them."""
        from tokenizers.pre_tokenizers import ByteLevel

        normal = self.tokenizer.normalizer
        as_read = (lambda c: normal.normalize_str(c)) if normal else (lambda c: c)
        plain = [chr(c) for c in range(PLAIN)]
        low = pc.utf8_lower(pa.array(plain)).to_pylist() if self.mode == "dropped" else plain
        changed = [c for c, x in zip(plain, low) if as_read(c) != as_read(x)]
        held = ["[^\\x{0}-\\x{%x}]" % (PLAIN - 1), *(r"\x{%x}" % ord(c) for c in changed), _RUN_ON]
        # added tokens are found before case is dropped
        held += ["(?i:" + "".join(r"\x{%x}" % ord(c) for c in t) + ")" for t in added]
        self.coarse = "|".join(held)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        pieces = lambda text: self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        own = [c for c in plain if c.isalpha() and as_read(c) == c and len(pieces(f"a{c}a")) == 1]
        self.level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in [*own, " "]}
        fits = self.mode != "whole" and own and json.loads(self.tokenizer.to_str())["model"]["type"] == "BPE"
        self.letters = re.compile(f"{' ?' if self.mode == 'leading' else ''}[{''.join(own)}]+" if fits else r"(?!)")

    def _forget(self) -> None:
        """The memo: each chunk's place in ``start`` and ``length``, which point into ``ids``."""
        self.memo: dict[str, int] = {}
        self.ids, self.start, self.length, self.used = np.zeros(1 << 16, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, chunks: list[str]) -> None:
        """Add chunks that are not in the memo; what is not one word to the model is encoded by ``JOINED`` in one call."""
        words, joined, alone = [], [], []
        one_word = self.letters.fullmatch
        for c in chunks:
            if one_word(c):
                words.append(c)
                continue
            fits = self.separator_id is not None and self.separator_char not in c and _ONE_WORD.fullmatch(c)
            (joined if fits else alone).append(c)
        done, ids, lengths = [], [], []
        if words:
            tokenize, level = self.tokenizer.model.tokenize, self.level
            found = [[t.id for t in tokenize(w.translate(level))] for w in words]
            done += words
            ids.append(np.fromiter(chain.from_iterable(found), self.dtype))
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        for at in range(0, len(joined), JOINED):
            some = joined[at : at + JOINED]
            got = self._ids([self.separator.join(some)])[0]
            apart = got == self.separator_id
            ends = np.flatnonzero(apart)
            if len(ends) == len(some) - 1:
                done += some
                ids.append(got[~apart])
                lengths.append(np.diff(ends, prepend=-1, append=len(got)) - 1)
            else:
                alone += some
        if alone:
            found = self._ids(alone)
            done, ids = done + alone, ids + found
            lengths.append(np.array([len(x) for x in found], np.int64))
        self._add(done, np.concatenate(ids), np.concatenate(lengths))

    def _add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, end = len(self.memo), self.used + len(ids)
        self.memo.update(zip(chunks, range(first, first + len(chunks))))
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(end, len(self.ids)), self.dtype)])
        self.ids[self.used : end] = ids
        self.start = np.concatenate([self.start[:first], self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length[:first], lengths])
        self.used = end

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(chunks as bytes, number of them by text)."""
        if self.mode == "whole":
            return texts.cast(pa.large_binary()), np.ones(len(texts), np.int64)
        coarse = pc.match_substring_regex(texts, self.coarse)
        if self.mode == "dropped":
            texts = pc.replace_substring(texts, "\n", " ")
            lower = pc.utf8_lower(texts)
            for mark in ",.":
                lower = pc.replace_substring(lower, f"{mark} ", f" {mark} ")
            lists = pc.split_pattern(pc.if_else(coarse, texts, lower).cast(pa.large_binary()), b" ")
        else:
            raw = texts.cast(pa.large_binary())
            fine = raw
            for mark in (b", ", b". ", b",\n", b".\n"):
                fine = pc.replace_substring(fine, mark, _CUT + mark)
            cut = pc.if_else(coarse, raw, fine)
            cut = pc.replace_substring(pc.replace_substring(cut, b"\n", _CUT + b"\n" + _CUT), b" ", _CUT + b" ")
            odd = pc.match_substring_regex(texts, _ODD)
            if pc.any(odd).as_py():
                spaced = [(_CUT + b" ").join(p.encode() for p in _BETWEEN_WORDS.split(t)) for t in texts.filter(odd).to_pylist()]
                cut = pc.replace_with_mask(cut, odd, pa.array(spaced, pa.large_binary()))
            lists = pc.split_pattern(cut, _CUT)
        return lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: list[str] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, end of each text in them).

        Nulls count as empty; ``end_id`` is put after each text.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        chunks, per_text = self._cut(texts)
        coded = chunks.dictionary_encode()
        words = coded.dictionary.cast(pa.large_string()).to_pylist()
        if len(self.memo) > self.memo_entries:
            self._forget()
        place = np.fromiter((self.memo.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(place < 0).tolist()
        if new:
            self._encode_new([words[i] for i in new])
            place[new] = [self.memo[words[i]] for i in new]
        at = place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        start, length = self.start[at], self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(per_text)]
        ids = self.ids[np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())]
        if end_id is not None:
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends


def _drops_space(pre: dict) -> bool:
    """True when the first pre-tokenizer keeps only matches that hold no white space."""
    first = (pre.get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def runs_of_texts(texts: pa.Array, most_bytes: int = RUN_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of about ``most_bytes`` bytes.

    Runs are copies that begin at their buffers' start: some Arrow kernels misread slices.
    """
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, pa.concat_arrays([texts.slice(a, b - a), texts.slice(0, 0)])
