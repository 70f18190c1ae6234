"""Exact token ids from public tokenizers: white space cuts texts in chunks, and each distinct chunk is encoded once."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from orospark.llm.common import cache

#: Text encoded at once, about: the more, the fewer distinct chunks to look up.
BATCH_BYTES = 6 << 20
#: Chunks that a worker remembers; others are encoded again when they come in a later batch.
CACHE_CHUNKS = 450_000
CACHE_CHUNK_BYTES = 32
#: Chunks encoded as one string.
JOINED = 512
#: Such strings in one call: the library holds some hundred bytes for each token of a call.
CALLS = 16
#: Control characters that are white space to Python but not to the tokenizers' patterns, or the other way, and those used as marks here.
CONTROLS = ("\0", "\x01", "\x1c", "\x1d", "\x1e", "\x1f", "᠎")
#: White space to Python or to the tokenizers' patterns, but the line feed.
SPACES = r"[\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that end a chunk after a letter are a pre-token of their own.
MARKED = r"[A-Za-zÀ-ÖØ-öø-ɏ][,.!?;:|$%&#*]+$"
MARKS = ",.!?;:|$%&#*"
LARGE = pa.large_string()
EMPTY = pa.scalar("", LARGE)


def _bounds(column: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of flat one after the other, where each begins, and their end)."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    small = np.int32 if max(upto[-1], len(flat)) < 1 << 31 else np.int64
    place = np.arange(upto[-1], dtype=small) + np.repeat((starts - upto[:-1]).astype(small), sizes)
    return flat[place], upto


class ChunkEncoder:
    """encode(texts) gives the ids of all texts in one array, and where each text's begin.

    Byte-level files: pre-tokens never cross a single space or line feed between two other characters, so a text
    is cut at each. A chunk that starts or ends with other white space, or an empty one, betrays a run of white
    space: such a text is encoded whole. Word files: white space only separates. Either way the ids are those of
    the whole text. Texts with an added token's string, such as <|endoftext|>, are encoded whole too, so that it becomes
    that token, as the library has it. Cutting, finding new chunks and gathering ids are array operations; the library
    gets each new chunk of a batch once, many in one string."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.normalizer is not None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        controls = [f"\\x{{{ord(c):x}}}" for c in (CONTROLS if self.word else CONTROLS[:1])]
        self.apart = "|".join([f"[{''.join(controls)}]", *added])
        # white space beside white space, or a character that stands for something here
        self.odd = f"^$|[{''.join(controls[1:])}]" if self.word else rf"(?s)^[\n\x00]?(?:{SPACES}|$)|{SPACES}$|^.+[\n\x00]|\x{{180e}}"
        self.separator = " \x01 " if self.word else "\n"
        self.mark = self._whole([self.separator])[0]
        vocabulary = self.tokenizer.get_vocab()
        self.marks, self.spaces = np.zeros((2, max(vocabulary.values()) + 1), bool)
        self.marks[self.mark[:1]] = len(self.mark) == 1
        self.spaces[[i for t, i in vocabulary.items() if t[:1] == "Ġ"]] = True
        self.known, self.flat, self.starts, self.sizes = pa.array([], LARGE), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _joined(self, atoms: pa.LargeStringArray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of strings, many in one call; first tells which ids can only be the first of a string."""
        ends, data = _bounds(atoms), memoryview(atoms.buffers()[2] or b"")
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(atoms), JOINED * CALLS):
            runs = [(a, min(a + JOINED, len(atoms))) for a in range(k, min(k + JOINED * CALLS, len(atoms)), JOINED)]
            for (a, b), got in zip(runs, self._whole([str(data[ends[a] : ends[b]], "utf-8") for a, b in runs]), strict=True):
                at = np.flatnonzero(first[got])
                if len(at) == b - a and at[0] == 0:
                    ids.append(got)
                    sizes.append(np.diff(at, append=len(got)))
                else:
                    ids += (each := self._whole(atoms[a:b].to_pylist()))
                    sizes.append(np.array([len(i) for i in each], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _ids(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of chunks as they stand in a text: after a space, a line feed, or (marked \\0) first of all.

        After a space, a chunk's first id is one that starts with a space, and no other is; so these need no separator."""
        lead = pc.binary_join_element_wise
        if self.word:
            ids, sizes = self._joined(lead(pa.scalar(self.separator, LARGE), pc.utf8_ltrim(chunks, "\0"), EMPTY), self.marks)
            return ids, np.cumsum(sizes) - sizes + len(self.mark), sizes - len(self.mark)
        begins = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[_bounds(chunks)[:-1]]
        bare = (begins == 0) | (begins == 10)
        spaced, n = self._joined(lead(pa.scalar(" ", LARGE), chunks.filter(pa.array(~bare)), EMPTY), self.spaces)
        after, m = self._joined(lead(pa.scalar(self.separator, LARGE), pc.utf8_slice_codeunits(chunks.filter(pa.array(bare)), 1), EMPTY), self.marks)
        starts, sizes = np.zeros((2, len(chunks)), np.int64)
        starts[~bare], sizes[~bare] = np.cumsum(n) - n, n
        starts[bare], sizes[bare] = np.cumsum(m) - m + len(spaced), m
        starts[begins == 0] += len(self.mark)
        sizes[begins == 0] -= len(self.mark)
        return np.concatenate([spaced, after]), starts, sizes

    def _remember(self, chunks: pa.LargeStringArray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        if len(chunks) and len(self.known) < CACHE_CHUNKS:
            short = np.diff(_bounds(chunks)) <= CACHE_CHUNK_BYTES
            starts, sizes = starts[short], sizes[short]
            ids, upto = _gathered(ids, starts, sizes)
            self.known = pa.concat_arrays([self.known, chunks.filter(pa.array(short))])
            self.starts = np.concatenate([self.starts, upto[:-1] + len(self.flat)])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def _known(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes, which are odd) of distinct chunks, odd ones without ids."""
        place = pc.index_in(chunks, value_set=self.known).fill_null(-1).to_numpy()
        found, new, odd = place >= 0, np.flatnonzero(place < 0), np.zeros(len(chunks), bool)
        odd[new] = pc.match_substring_regex(chunks.take(pa.array(new)), self.odd).to_numpy(zero_copy_only=False)
        new = new[~odd[new]]
        starts, sizes = np.zeros((2, len(chunks)), np.int64)
        starts[found], sizes[found] = self.starts[place[found]], self.sizes[place[found]]
        names = chunks.take(pa.array(new))
        fresh, own, sizes[new] = self._ids(names)
        starts[new] = own + len(self.flat)
        flat = np.concatenate([self.flat, fresh])
        self._remember(names, fresh, own, sizes[new])
        return flat, starts, sizes, odd

    def _looked_up(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As _known(); chunks that end in marks are put together from two, of which most are known."""
        marked = pc.match_substring_regex(chunks, MARKED)
        ending = chunks.filter(marked)
        stems = pc.utf8_rtrim(ending, MARKS)
        marks = pc.replace_substring_regex(ending, "(?s)^.*[^,.!?;:|$%&#*]", "\0")
        parts = pa.concat_arrays([chunks.filter(pc.invert(marked)), stems, marks]).dictionary_encode()
        flat, starts, sizes, odd = self._known(parts.dictionary)
        marked, part = marked.to_numpy(zero_copy_only=False), parts.indices.to_numpy()
        n = len(ending)
        one, two = np.zeros((2, len(chunks)), part.dtype)
        one[~marked], one[marked], two[marked] = part[: len(chunks) - n], part[len(chunks) - n : len(chunks)], part[len(chunks) :]
        both = np.stack([one[marked], two[marked]], 1).ravel()
        ids, ends = _gathered(flat, starts[both], sizes[both])
        starts, sizes, odd = starts[one], sizes[one], odd[one]
        starts[marked], sizes[marked] = len(flat) + ends[:-1:2], np.diff(ends[::2])
        return np.concatenate([flat, ids]), starts, sizes, odd

    def encode(self, texts: list[bytes | None] | pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of UTF-8 texts; those of text k are ids[offsets[k]:offsets[k + 1]]. None is empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary())
        try:
            column = column.cast(LARGE)
        except pa.ArrowInvalid:
            column = pa.array([t and t.decode("utf-8", "replace") for t in column.to_pylist()], LARGE)
        column = column.fill_null("")
        n, apart = len(column), pc.match_substring_regex(column, self.apart).to_numpy(zero_copy_only=False)
        if self.word:
            lists = pc.utf8_split_whitespace(column)
        else:
            marked = pc.binary_join_element_wise(pa.scalar("\0", LARGE), pc.replace_substring(column, "\n", " \n"), EMPTY)
            lists = pc.split_pattern(marked, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends -= ends[0]
        marked = lists = None  # as large as the texts
        codes, chunks = coded.indices.to_numpy(), coded.dictionary
        flat, starts, sizes, strange = self._looked_up(chunks)
        if strange.any() and not self.word:
            apart[np.searchsorted(ends, np.flatnonzero(strange[codes]), "right") - 1] = True
            apart[np.diff(ends) == 1] &= pc.binary_length(column).to_numpy()[np.diff(ends) == 1] > 0  # an empty text is one empty chunk
        if apart.any():
            codes, ends, flat, starts, sizes = self._patch(column, apart, codes, ends, flat, starts, sizes)
        ids, upto = _gathered(flat, starts[codes], sizes[codes])
        return ids, upto[ends[: n + 1]]

    def _patch(self, column, apart, codes, ends, flat, starts, sizes):
        """The texts set apart become one chunk each, encoded whole."""
        rows = np.flatnonzero(apart)
        ids = self._whole([column[int(k)].as_py() for k in rows])
        own = np.array([len(i) for i in ids], np.int64)
        keep = ~np.repeat(apart, np.diff(ends))
        count = np.where(apart, 1, np.diff(ends))
        out_ends = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(out_ends[-1], np.int64)
        slot = np.zeros(out_ends[-1], bool)
        slot[out_ends[:-1][rows]] = True
        out[~slot] = codes[keep]
        out[slot] = len(sizes) + np.arange(len(rows))
        starts = np.concatenate([starts, len(flat) + np.cumsum(own) - own])
        return out, out_ends, np.concatenate([flat, *ids]), starts, np.concatenate([sizes, own])


#: Name of the encoders' cache().
ENCODERS = "encoders"
encoders: dict[str, ChunkEncoder] = cache(ENCODERS)


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each path in a worker process."""
    if path not in encoders:
        encoders[path] = ChunkEncoder(path)
    return encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and offsets with the end id after each text."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
