"""Problem 8: the whole corpus as token ids of a public byte-level BPE.

Method: forced-boundary splitting. A byte pair that occurs inside no vocabulary token can
never be merged over, so a cut between its two bytes is certain, be it between words or within one. Fragments between certain
cuts are encoded independently (each distinct one once per worker) and concatenated.

The pre-tokeniser looks at characters, so three kinds of places are never cut, whatever the pair: within a character's bytes; after white space (how much of
a run of it belongs to the next word depends on what follows); before an apostrophe that follows no ASCII letter or digit, and within
the contractions it knows (a fragment must not begin with one that the whole text does not have there). At every other place both sides are split as in the whole text:
its pattern looks back at nothing, and ahead only past white space.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.plans.runtime import fan_out

#: Where the vocabulary files lie on every machine; a parameter, never copied.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pre-tokeniser pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the contractions of that pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: White space outside ASCII, as UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Distinct fragments kept by one worker; beyond it the memory starts anew (ids do not change).
REMEMBERED = 400_000
#: Fragments longer than this are rarely repeated and are not remembered.
LONG = 48


class FragmentEncoder:
    """Exact encoder of one vocabulary with memory of fragments."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = VOCABULARIES):
        import tiktoken

        ranks = {}
        for line in Path(folder, f"{name}.tiktoken").read_bytes().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.certain = self._certain(ranks)
        self.memory: dict[bytes, list[int]] = {}

    @staticmethod
    def _certain(tokens) -> np.ndarray:
        """For each byte pair (first * 256 + second) whether a cut between the two is certain."""
        certain = np.ones((256, 256), dtype=bool)
        joined = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        within = np.ones(len(joined), dtype=bool)
        within[np.cumsum(sizes) - 1] = False  # the last byte of a token has no successor in it
        at = np.flatnonzero(within)
        certain[joined[at], joined[at + 1]] = False
        for word in CONTRACTIONS:
            certain[list(word[:-1].encode()), list(word[1:].encode())] = False
        certain[:, 0x80:0xC0] = False  # within a character
        certain[[*range(0x09, 0x0E), *range(0x1C, 0x21)], :] = False  # after white space
        plain = np.zeros(256, dtype=bool)
        plain[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        certain[~plain, 0x27] = False
        return certain.ravel()

    def fragments(self, text: str) -> list[bytes]:
        """The text, as UTF-8, between its certain cuts."""
        data = text.encode("utf-8", "surrogatepass")
        codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint16)
        cut = self.certain[(codes[:-1] << 8) | codes[1:]]
        if not text.isascii():
            for m in _WIDE_SPACE.finditer(data):
                if m.end() < len(data):
                    cut[m.end() - 1] = False
        ends = (np.flatnonzero(cut) + 1).tolist()
        return [data[a:b] for a, b in zip([0, *ends], [*ends, len(data)])]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty give []."""
        ids: list[int] = []
        if not text:
            return ids
        memory, add = self.memory, ids.extend
        for part in self.fragments(text):
            known = memory.get(part)
            if known is None:
                known = self.encoding.encode_ordinary(part.decode("utf-8", "surrogatepass"))
                if len(part) <= LONG:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[part] = known
            add(known)
        return ids


@cache
def encoder(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> FragmentEncoder:
    """The worker's encoder."""
    return FragmentEncoder(name, folder)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row.

    Null and empty texts give an empty list; strings that look like special tokens are
    ordinary text; repeated rows stay repeated; an empty table gives an empty table; other
    columns are not read. Narrow: no shuffle unless the scan has fewer splits than cores.
    """
    src = fan_out(df.select(df[id_col].alias("id_"), df[text_col].cast("string").alias("text_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id_", "ids"])

    kind = dict(src.dtypes)["id_"]
    return src.mapInArrow(run, f"id_ {kind}, ids array<int>").withColumnRenamed("id_", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, n_tokens BIGINT) of every row; 0 for null and empty texts."""
    src = fan_out(df.select(df[id_col].alias("id_"), df[text_col].cast("string").alias("text_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            sizes = [len(enc.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id_", "n_tokens"])

    kind = dict(src.dtypes)["id_"]
    return src.mapInArrow(run, f"id_ {kind}, n_tokens bigint").withColumnRenamed("id_", id_col)
