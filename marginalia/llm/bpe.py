"""Byte-level BPE ids for whole batches of texts, equal to those of the tokenizers library.

A pre-token here is what stands between two single spaces, with the space before it. The
vocabulary's own splitting rule never reaches across such a space, so the ids of a text are those
of its pre-tokens in a row. A batch is split, and its distinct pre-tokens found, by Arrow; each is
looked up in a table, then in the worker's cache; only misses are encoded, all in one call.

Texts in which that argument doesn't hold (a space followed by white space, special strings) or
whose characters newer Unicode tables may classify differently are given to the library whole.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed: characters that all the libraries' Unicode tables class alike, as ranges of an RE2 class.
ALIKE = r"\x{0}-\x{52F}\x{2010}-\x{2027}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"
#: A text with this goes to the library whole.
UNSAFE = rf"[^{ALIKE}]|<\|| [\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}]"
#: Pre-tokens that a worker keeps; when full, the cache starts anew. Longer ones aren't kept.
CACHE, CACHE_CHARS = 300_000, 64
#: Pre-tokens longer than this (in characters) go to the library: its merges are n log n.
LONG = 400


class ByteBpe:
    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, i in ranks.items():
            self.width[i] = len(piece)
        self.cache: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, as little-endian 16-bit numbers."""
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]

    def _misses(self, chunks: list[str]) -> list[bytes]:
        """The ids of each pre-token, a space before it."""
        plain = [c for c in chunks if c and len(c) <= LONG]
        found = {}
        if plain:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(plain)), dtype=np.int64)
            ends = np.cumsum([len(c.encode()) + 1 for c in plain])
            cuts = (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1) * 2
            raw, cuts = ids.astype("<u2").tobytes(), cuts.tolist()
            if len(plain) == len(chunks):
                return [raw[a:b] for a, b in zip([0, *cuts], cuts)]
            found = dict(zip(plain, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
        return [found[c] if c in found else self.whole([f" {c}"])[0] for c in chunks]

    def pieces(self, chunks: list[str], table: dict[str, bytes] | None = None) -> list[bytes]:
        """The ids of each distinct pre-token: from the table, the cache, or encoded now."""
        cache = self.cache
        got = list(map((table or cache).get, chunks))
        if table:
            got = [cache.get(c) if g is None else g for c, g in zip(chunks, got)]
        missing = [k for k, g in enumerate(got) if g is None]
        new = self._misses([chunks[k] for k in missing])
        if len(cache) + len(new) > CACHE:
            cache.clear()
        for k, ids in zip(missing, new):
            got[k] = ids
        cache.update((chunks[k], got[k]) for k in missing[:CACHE] if len(chunks[k]) <= CACHE_CHARS)
        return got

    def _head(self, chunk: str) -> bytes:
        """The ids of a text's first pre-token, which has no space before it."""
        if chunk not in self.heads:
            if len(self.heads) > 50_000:
                self.heads.clear()
            ids = self.whole([chunk])[0] if len(chunk) > LONG else np.array(self.fast.encode_ordinary(chunk), dtype="<u2").tobytes()
            if len(chunk) > CACHE_CHARS:
                return ids
            self.heads[chunk] = ids
        return self.heads[chunk]

    def split(self, texts: pa.Array, lookup) -> tuple[list, np.ndarray, np.ndarray]:
        """(values, codes, offsets): text k is made of ``values[c]`` for c in ``codes[offsets[k]:offsets[k + 1]]``.

        ``lookup`` gives the values of distinct pre-tokens; heads and whole texts are byte strings.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(unsafe), "", texts), " ")
        offsets = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = offsets[:-1] - offsets[0]
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(lookup(names))
        heads = [self._head(names[c]) for c in codes[first].tolist()]
        if unsafe.any():
            for k, ids in zip(np.flatnonzero(unsafe), self.whole([t for t in texts.filter(pa.array(unsafe)).to_pylist()])):
                heads[k] = ids
        codes[first] = len(values) + np.arange(len(first))
        return [values, heads], codes, offsets - offsets[0]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of a batch: all ids in a row and the number of each text's."""
        if not len(texts):
            return np.zeros(0, dtype="<u2"), np.zeros(0, dtype=np.int64)
        (values, heads), codes, offsets = self.split(texts, self.pieces)
        pool = np.frombuffer(b"".join(values) + b"".join(heads), dtype="<u2")
        sizes = np.fromiter(map(len, values + heads), dtype=np.int64, count=len(values) + len(heads)) // 2
        starts = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        place = np.repeat(starts[codes] - (np.cumsum(counts) - counts), counts)
        place += np.arange(len(place))
        return pool[place], np.add.reduceat(counts, offsets[:-1])

    def counts(self, texts: pa.Array, table: dict[str, int]) -> np.ndarray:
        """The number of ids of each text; ``table`` has those of frequent pre-tokens."""
        if not len(texts):
            return np.zeros(0, dtype=np.int64)

        def lookup(names):
            got = list(map(table.get, names))
            rare = [k for k, g in enumerate(got) if g is None]
            for k, ids in zip(rare, self.pieces([names[k] for k in rare])):
                got[k] = len(ids) // 2
            return got

        (values, heads), codes, offsets = self.split(texts, lookup)
        sizes = np.array(values + [len(h) // 2 for h in heads], dtype=np.int64)
        return np.add.reduceat(sizes[codes], offsets[:-1])


@lru_cache(maxsize=1)
def worker_bpe(json_path: str | None = None, ranks_path: str | None = None) -> ByteBpe:
    """One encoder for a Python worker; by default the installed 50k byte vocabulary."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    return ByteBpe(
        json_path or public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
