"""Exact token ids, fast: whole texts through a tokenizer file, each different chunk of a block of texts once.

No token of these tokenizers reaches from a printed character into a following space, so a text's ids are the ids of its
chunks (cut at spaces) one after another. Arrow cuts the texts and numbers the different chunks. A run of Latin letters, alone or before plain
punctuation, is one word to either tokenizer: words are encoded many together, and the tokens that begin or end words tell them apart;
all other chunks go one by one. Where the tokenizer groups runs of white space ("byte" files), a text with white space other than single
spaces and line ends is encoded in one piece.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridmason.llm.common import release

_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: A chunk that is a word: first in its text (marked) or after a line end, letters, plain punctuation.
_WORD = f"^(?P<lead>LEAD)(?P<word>[{_LATIN}]+)(?P<tail>[.,!?;:|%*#$&]*)$"
#: White space that a text cut at its spaces must not have: other kinds, runs, and any at its ends.
_ODD = "[\\t\\r\\x02\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$"
_FIRST = "\x02"

Ids = tuple[np.ndarray, np.ndarray]  # all ids, and how many each text or chunk has


def _gather(ids: np.ndarray, size: np.ndarray, which: np.ndarray) -> Ids:
    """The ids of chunks ``which``, one after another."""
    many = size[which]
    ends = np.cumsum(many, dtype=np.int64)
    start = (np.cumsum(size, dtype=np.int64) - size)[which]
    return ids[np.repeat(start - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)], many


def _interleaved(*parts: Ids) -> Ids:
    """Chunk by chunk: its ids in each of the parts."""
    k = len(parts)
    ids, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    n = len(parts[0][1])
    ids, size = _gather(ids, size, np.arange(k * n).reshape(k, n).T.reshape(-1))
    return ids, size.reshape(n, k).sum(1)


class Encoder:
    """ids(texts) -> (all ids, number of ids of each text)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.drops_space = any(p.get("behavior") == "Removed" and p.get("invert") for p in pre.get("pretokenizers", [pre]))
        vocab = self.tok.get_vocab()
        end = spec["model"].get("end_of_word_suffix") or ""
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word (drops_space) or begin one
        self.edge[[i for t, i in vocab.items() if (bool(end) and t.endswith(end) if self.drops_space else t.startswith("Ġ"))]] = True
        self.line = vocab.get("Ċ", -1)

    def _one_by_one(self, chunks: pa.Array) -> Ids:
        found = [e.ids for e in self.tok.encode_batch_fast(chunks.to_pylist(), add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _together(self, words: pa.Array, spaced: bool) -> Ids:
        """ids of words, each after a space (which the token of a byte file includes) or at the start of a line."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        between = " " if spaced else "\n"
        cuts = np.minimum(np.arange(0, len(words) + 2000, 2000), len(words)).astype(np.int32)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), between).to_pylist()
        text = text if self.drops_space else [between + t for t in text]
        found = [e.ids for e in self.tok.encode_batch_fast(text, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        if self.drops_space:
            size = np.diff(np.flatnonzero(self.edge[ids]), prepend=-1)
        elif spaced:
            size = np.diff(np.flatnonzero(self.edge[ids]), append=len(ids))
        else:
            ends = ids == self.line
            size = np.diff(np.flatnonzero(ends), append=len(ids)) - 1
            ids = ids[~ends]
        if len(size) == len(words) and size.sum() == len(ids):
            return ids, size
        return self._one_by_one(pc.binary_join_element_wise(" ", words, "") if spaced and not self.drops_space else words)

    def _chunks(self, chunks: pa.Array) -> Ids:
        """ids of different chunks."""
        parts = pc.extract_regex(chunks, _WORD.replace("LEAD", "" if self.drops_space else "[\\x02\\n]?"))
        is_word = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        if self.drops_space and not self.edge.any():
            is_word[:] = False
        at, others = np.flatnonzero(is_word), np.flatnonzero(~is_word)
        rest = chunks.take(pa.array(others))
        if not self.drops_space:  # what a chunk stands for: one after a space, unless first or after a line end
            first, line = pc.starts_with(rest, _FIRST), pc.starts_with(rest, "\n")
            rest = pc.if_else(first, pc.utf8_slice_codeunits(rest, 1), pc.if_else(line, rest, pc.binary_join_element_wise(" ", rest, "")))
        found = parts.take(pa.array(at))
        lead, tail = pc.struct_field(found, "lead"), pc.struct_field(found, "tail").dictionary_encode()
        lead = lead.to_numpy(zero_copy_only=False).astype(str) if len(at) else np.zeros(0, "U1")
        word = pc.struct_field(found, "word")
        spaced = (lead == "") | self.drops_space
        ids: list[Ids] = []
        places = []
        for m, s in ((spaced, True), (~spaced, False)):
            w = word.filter(pa.array(m)).dictionary_encode()
            ids.append(_gather(*self._together(w.dictionary, s), w.indices.to_numpy(zero_copy_only=False)))
            places.append(np.flatnonzero(m))
        order = np.argsort(np.concatenate(places), kind="stable")
        words = _gather(np.concatenate([i for i, _ in ids]), np.concatenate([n for _, n in ids]), order)
        lines = (lead == "\n").astype(np.int64)
        tails = _gather(*self._one_by_one(tail.dictionary), tail.indices.to_numpy(zero_copy_only=False))
        words = _interleaved((np.full(int(lines.sum()), max(self.line, 0), np.uint32), lines), words, tails)
        every = [np.concatenate(x) for x in zip(words, self._one_by_one(rest), strict=True)]
        return _gather(*every, np.argsort(np.concatenate([at, others]), kind="stable"))

    def ids(self, texts: list[str] | pa.Array) -> Ids:
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = np.zeros(len(given), bool)
        if self.drops_space:
            cut = pc.replace_substring(given, "\n", " ")
        else:
            odd = pc.match_substring_regex(given, _ODD).to_numpy(zero_copy_only=False)
            cut = pc.if_else(pa.array(odd), "", given) if odd.any() else given
            cut = pc.binary_join_element_wise(_FIRST, pc.replace_substring(cut, "\n", " \n"), "")
        split = pc.split_pattern(cut, " ")
        chunks = split.flatten().dictionary_encode()
        out, size = _gather(*self._chunks(chunks.dictionary), chunks.indices.to_numpy(zero_copy_only=False))
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        until = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(per_text)]
        sizes = np.diff(until, prepend=0)
        if odd.any():
            at = np.flatnonzero(odd)
            found, many = self._one_by_one(given.take(pa.array(at)))
            out = np.insert(out, np.repeat((until - sizes)[at], many), found)
            sizes[at] = many
        return out, sizes


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for all tasks that a Python worker runs."""
    return Encoder(path)


def bunches(batches: Iterator[pa.RecordBatch], chars: int = 8_000_000) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of about so many bytes of text together, from batches of (id, text) of any size."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            until = min(b.num_rows, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars - size)) + 1)
            held.append(b.slice(at, until - at))
            size += int(ends[until - 1] - (ends[at - 1] if at else 0))
            at = until
            if size >= chars:
                t = pa.Table.from_batches(held)
                yield pa.concat_arrays(t.column(0).chunks), pa.concat_arrays(t.column(1).chunks)
                held, size = [], 0
    if held:
        t = pa.Table.from_batches(held)
        yield pa.concat_arrays(t.column(0).chunks), pa.concat_arrays(t.column(1).chunks)


def blocks(texts: list[str | None], chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together: bounds what a task holds at once."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
    release()
