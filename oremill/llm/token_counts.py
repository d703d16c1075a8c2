"""Token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a slice of rows are held as one flat array of symbols with sequence offsets.  Each round looks
up the rank of every adjacent pair, finds the lowest rank of each sequence, and applies that pair's merges in all
sequences at the same time; sequences without a mergeable pair leave with their number of symbols.

Words that the vectorised pre-tokenizer does not cover are normalised and cut in Python by the tokenizer's rules and
merged by the same arrays.

Defined results: null and empty texts have 0 tokens; special strings inside texts count as one token each, as by the
library's default; rows that repeat are counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, load, narrowed, ragged_arange
from .pretokens import Cache, distinct, units

LIMIT = 2048
SLICE_BYTES = 2 << 20
NONE = np.iinfo(np.int64).max


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else 256 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merger:
    """The merge table of a byte-level BPE with word ends, over symbols 0-255 (bytes), 256-511 (last bytes) and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        chars, end = byte_chars(), held["model"]["end_of_word_suffix"] or ""
        ids = {c: b for b, c in enumerate(chars)} | {c + end: 256 + b for b, c in enumerate(chars)}
        left, right, made = [], [], []
        for a, b in held["model"]["merges"]:
            ids.setdefault(a + b, len(ids))
            left.append(ids[a]), right.append(ids[b]), made.append(ids[a + b])
        keys = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, np.array(made, np.int64)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in held["added_tokens"])) if held["added_tokens"] else None
        cut = held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(cut)

    def ranks(self, symbols: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each position; NONE where there is none or the next symbol is another's."""
        out = np.full(len(symbols), NONE)
        at = np.flatnonzero(joined)
        pair = symbols[at] << 20 | symbols[at + 1]
        i = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        out[at] = np.where(self.keys[i] == pair, self.rank[i], NONE)
        return out

    def counts(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence when no pair merges any more."""
        out = sizes.astype(np.int64)
        live = np.flatnonzero(sizes > 1)
        if not len(live):
            return out
        keep = np.repeat(sizes > 1, sizes)
        symbols, sizes = symbols[keep].astype(np.int64), sizes[live].astype(np.int64)
        while len(live):
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            joined = np.ones(len(symbols), bool)
            joined[cuts[1:] - 1] = False
            rank = self.ranks(symbols, joined)
            low = np.minimum.reduceat(rank, cuts[:-1])
            going = low < NONE
            out[live[~going]] = sizes[~going]
            apply = (rank == np.repeat(low, sizes)) & (rank < NONE)
            # of overlapping occurrences (aaa) every second one of a run applies, from its left end
            at = np.flatnonzero(apply)
            if len(at):
                run = np.concatenate([[True], np.diff(at) > 1])
                first = np.flatnonzero(run)
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                at = at[place % 2 == 0]
                symbols[at] = self.made[rank[at]]
                kept = np.ones(len(symbols), bool)
                kept[at + 1] = False
                sizes = np.add.reduceat(kept.astype(np.int64), cuts[:-1])
                kept &= np.repeat(going, np.diff(cuts))
                symbols = symbols[kept]
            else:
                symbols = symbols[:0]
            live, sizes = live[going], sizes[going]
        return out

    def sequences(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat first symbols of byte strings, the last byte of each marked as a word end, and their sizes."""
        sizes = np.array([len(r) for r in raws], np.int64)
        symbols = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        symbols[np.cumsum(sizes)[sizes > 0] - 1] += 256
        return symbols, sizes

    def slow(self, words: list[str]) -> np.ndarray:
        """Tokens of whole words by the tokenizer's full rules."""
        raws, of, fixed = [], [], np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            parts = self.special.split(word) if self.special else [word]
            fixed[i] = len(parts) - 1
            for part in parts:
                plain = "".join(c.lower() for c in regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part)))
                for m in self.cut.finditer(plain):
                    raws.append(m[0].encode())
                    of.append(i)
        if raws:
            fixed += np.bincount(of, self.counts(*self.sequences(raws)), len(words)).astype(np.int64)
        return fixed


_held: dict[str, tuple[Merger, Cache]] = {}


def held(path: str) -> tuple[Merger, Cache]:
    """The merge table and cache of this Python worker, which serve its later tasks too."""
    if path not in _held:
        _held.clear()
        _held[path] = Merger(path), Cache(1, np.int32)
    return _held[path]


def _count(path: str, limit: int):
    def run(batches):
        merger, cache = held(path)
        for batch in byte_rows(SLICE_BYTES, batches):
            names = batch.schema.names
            col = batch.column(names.index("text"))
            buf, starts, ends, slow, hashes, bounds = units(col)
            first, back = distinct(buf, starts, ends, hashes)
            slot, keys, known = cache.find(buf, starts[first], ends[first], hashes[first])
            count = np.where(known, cache.values[slot, 0], 0)
            miss = np.flatnonzero(~known)
            at = first[miss]
            got = np.zeros(len(at), np.int64)
            easy = ~slow[at]
            s, size = starts[at[easy]], (ends - starts)[at[easy]]
            flat = buf[np.repeat(s, size) + ragged_arange(size)].astype(np.int64)
            flat[np.cumsum(size) - 1] += 256
            got[easy] = merger.counts(flat, size)
            got[~easy] = merger.slow([buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[at[~easy]], ends[at[~easy]])])
            count[miss] = got
            short = miss[(ends - starts)[at] <= cache.KEY_BYTES]
            cache.put(slot[short], keys[short], count[short, None])
            total = np.concatenate([[0], np.cumsum(count[back])]) if len(hashes) else np.zeros(1, np.int64)
            tokens = np.diff(total[bounds])
            size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
            fresh = {"n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array(tokens > limit)}
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, c in enumerate(names) if c != "text"], *fresh.values()], names=[*[c for c in names if c != "text"], *fresh])

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; one pass without a shuffle."""
    texts = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_count(path or vocabulary_path(), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document."""
    return token_counts(load(spark, sf_dir, "documents"))


ORACLE = None  # a tokenizer is no SQL function; the tests compare with the library
