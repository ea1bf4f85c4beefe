"""Memoised encoding with public tokenizer files, exact by construction.

A text is cut only where the tokenizer itself always cuts, so the ids of a text are the ids of its
chunks in order. Chunks are split and numbered by Arrow's kernels, each distinct chunk of a group of
texts is looked up once, and only chunks never seen before reach the library.

* Tokenizers that drop white space: chunks are what stands between ASCII white space.
* Byte-level tokenizers, whose words may take one leading space: chunks begin at a space that
  follows a character that isn't white space. A text with white space before a space, or with
  white space outside ASCII, goes to the library whole.
* A chunk of letters and one full stop or comma is looked up as its two parts.

The memo is one Arrow array of chunks beside one array of their ids, bounded by bytes: beyond
``MEMO_BYTES`` the chunks that no recent group has used go. New chunks reach the library in slices.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of chunks, ids and numbers that the memo keeps between groups.
MEMO_BYTES = 24 << 20
#: Chunks that the library takes in one call; its own records of tokens are many times their ids.
LEARN_AT_ONCE = 20_000
#: Bytes of text that are encoded together; bounds the arrays in memory.
GROUP_BYTES = 4 << 20

_SPACE_RUN = r"[\t\n\v\f\r ] "
#: The white space outside ASCII.
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters whose lower case is one letter, composed already; then a mark that is a token of its own.
_PLAIN_WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_WORD_MARK = _PLAIN_WORD[:-1] + "[.,]$"


class MemoEncoder:
    """Encodes columns of text to unsigned 32-bit ids, or counts them, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.drops_space = _drops_space(spec)
        self.splits = self.drops_space or _byte_level(spec)
        self.lowers = [x.get("type") for x in _parts(spec, "normalizer", "normalizers")][-1:] == ["Lowercase"]
        self.begins = None if self.drops_space or not self.splits else self._space_tokens()
        self.known = pa.array([], pa.string())
        self.pool = np.zeros(0, np.uint32)
        self.sizes = self.used = np.zeros(0, np.int32)
        self.now = 0

    def _space_tokens(self) -> np.ndarray:
        """Whether a token begins with the byte of a space; a chunk that begins with its only space has one such token, its first."""
        vocabulary = self.library.get_vocab(True)
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True
        return out

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in order and how many each has."""
        if self.begins is not None and words[0].startswith(" "):  # no offsets or words are recorded here: a third less time
            ids = np.array(self.library.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            firsts = np.flatnonzero(self.begins[ids])
            if len(firsts) == len(words) and firsts[0] == 0:
                return ids, np.diff(firsts, append=len(ids)).astype(np.int32)
        got = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(words)).astype(np.int32)

    def _learn(self, units: pa.Array) -> np.ndarray:
        """Where in the memo each of the distinct ``units`` stands; all of them stand in it afterwards."""
        self.now += 1
        at = pc.index_in(units, value_set=self.known)
        missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        self.used[at.drop_null().to_numpy()] = self.now
        if not missing.any():
            return at.to_numpy()
        if self.known.nbytes + self.pool.nbytes + self.sizes.nbytes + self.used.nbytes > MEMO_BYTES:
            self._forget()
            at = pc.index_in(units, value_set=self.known)
            missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        fresh = units.filter(pa.array(missing))
        order = np.argsort(pc.starts_with(fresh, " ").to_numpy(zero_copy_only=False), kind="stable")
        fresh = fresh.take(pa.array(order))
        led = int(pc.sum(pc.starts_with(fresh, " ")).as_py() or 0)
        pools, sizes = [self.pool], [self.sizes]
        for lo, hi in ((0, len(fresh) - led), (len(fresh) - led, len(fresh))):
            for i in range(lo, hi, LEARN_AT_ONCE):
                ids, n = self._encode(fresh.slice(i, min(LEARN_AT_ONCE, hi - i)).to_pylist())
                pools.append(ids)
                sizes.append(n)
        out = at.fill_null(0).to_numpy().copy()
        out[np.flatnonzero(missing)[order]] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        self.pool, self.sizes = np.concatenate(pools), np.concatenate(sizes)
        self.used = np.concatenate([self.used, np.full(len(fresh), self.now, np.int32)])
        return out

    def _forget(self) -> None:
        """Keep what the latest groups used: half of the chunks, and no chunk of this group goes."""
        kept = self.used >= min(np.partition(self.used, len(self.used) // 2)[len(self.used) // 2] + 1, self.now)
        self.pool, self.known = self.pool[np.repeat(kept, self.sizes)], self.known.filter(pa.array(kept))
        self.sizes, self.used = self.sizes[kept], self.used[kept]

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """For each distinct chunk the numbers of its head and its mark among the units; a mark of -1 is none."""
        marked = pc.match_substring_regex(words, _WORD_MARK)
        heads = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words)
        if self.lowers:
            heads = pc.if_else(pc.match_substring_regex(heads, _PLAIN_WORD), pc.utf8_lower(heads), heads)
        ends = pc.if_else(marked, pc.if_else(pc.ends_with(words, "."), ".", ","), None)
        coded = pc.dictionary_encode(pa.concat_arrays([heads, ends]))
        numbers = coded.indices.fill_null(-1).to_numpy()
        return numbers[: len(words)], numbers[len(words) :], coded.dictionary

    def group(self, texts: pa.Array, counting: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of each text, and all ids in order (None when counting). Nulls are empty texts."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.zeros(len(texts), bool)
        if not self.splits:
            whole[:] = True
        elif not self.drops_space:
            whole[:] = pc.or_(pc.match_substring_regex(texts, _SPACE_RUN), pc.match_substring_regex(texts, _WIDE_SPACE)).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        lists = pc.ascii_split_whitespace(cut) if self.drops_space else pc.split_pattern(cut, " ")
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        flat = pc.dictionary_encode(lists.flatten())
        codes, words = flat.indices.to_numpy(), flat.dictionary
        if not self.drops_space:  # all but a text's first chunk follow a space
            firsts = pc.dictionary_encode(pc.list_element(lists, 0))
            codes = codes.copy()
            codes[offsets[:-1]] = firsts.indices.to_numpy() + len(words)
            words = pa.concat_arrays([pc.binary_join_element_wise(" ", words, ""), firsts.dictionary])
        head, mark, units = self._units(words)
        at = self._learn(units)
        # One more row stands for no mark; its chunk is empty.
        sizes = np.append(self.sizes[at], 0).astype(np.int32)
        unit = np.empty(2 * len(codes), np.int32)
        unit[::2], unit[1::2] = head[codes], mark[codes]
        each = sizes[unit]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        offsets = 2 * offsets.astype(np.int64)
        counts = np.diff(ends[offsets])
        rest = self.library.encode_batch([texts[int(i)].as_py() for i in np.flatnonzero(whole)], add_special_tokens=False) if whole.any() else []
        counts[whole] = [len(x.ids) for x in rest]
        if counting:
            return counts, None
        starts = np.append((np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[at], 0)
        starts = starts[unit]
        starts -= ends[:-1]
        at = np.repeat(starts.astype(np.int32), each)  # a group has far fewer tokens than 2**31
        at += np.arange(len(at), dtype=np.int32)
        out = self.pool[at]
        if whole.any():
            merged, of_whole = np.empty(int(counts.sum()), "<u4"), np.repeat(whole, counts)
            merged[~of_whole] = out
            merged[of_whole] = [i for x in rest for i in x.ids]
            out = merged
        return counts, out

    def groups(self, texts: pa.Array, counting: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """``group`` over ranges of rows of about GROUP_BYTES."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for a, b in balanced(sizes, GROUP_BYTES):
            yield a, b, *self.group(texts.slice(a, b - a), counting)
            pa.default_memory_pool().release_unused()


def _parts(spec: dict, key: str, inner: str) -> list[dict]:
    part = spec.get(key) or {}
    return part.get(inner, [part]) if part.get("type") == "Sequence" else [part]


def _drops_space(spec: dict) -> bool:
    """A first split that keeps only runs of letters, one digit or other marks, none of them white space."""
    first = _parts(spec, "pre_tokenizer", "pretokenizers")[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and pattern.endswith(r"[^\s\p{L}\p{N}]+") and not spec.get("post_processor")


def _byte_level(spec: dict) -> bool:
    first = _parts(spec, "pre_tokenizer", "pretokenizers")[0]
    return first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec.get("normalizer")


@lru_cache(maxsize=4)
def encoder(path: str) -> MemoEncoder:
    """One encoder a file and worker process; worker processes are reused across tasks."""
    return MemoEncoder(path)


def balanced(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``most`` bytes together; a larger row stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def regrouped(batches: Iterator, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches brought together to about ``most`` bytes, for work that costs as much on few rows as on many."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def safe_pieces(text: bytes, most: int, drops_space: bool) -> list[bytes]:
    """Cut a long text where any of the two kinds of tokenizers cuts: before a white space after a letter or digit of ASCII, and after a Han character before one of its full-width marks."""
    pieces, at = [], 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m:
            break
        pieces.append(text[at : m.end()])
        at = m.end()
    pieces.append(text[at:])
    return pieces


#: The marks: ideographic comma and full stop, full-width ! , : ; ?
_SAFE = re.compile(rb"[0-9A-Za-z](?=[\t\n\v\f\r ])|[\xe4-\xe9][\x80-\xbf]{2}(?=\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9a\x9b\x9f])")
