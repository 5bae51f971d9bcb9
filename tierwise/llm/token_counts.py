"""Token counts by byte-pair merging with a heap over a linked list of symbols.

A text is cut into pretokens by the tokenizer's own pattern. Each pretoken starts as one symbol
a byte; the adjacent pair of the lowest merge rank is popped from a heap again and again and its
two list nodes are joined. The count is the initial symbols less the merges: no identifier is
ever made. Counts of pretokens are kept in a worker's bounded table, as texts repeat them.

Defined results: a null text is empty, with no bytes and no tokens; special strings inside texts
count as one token each, as the library's default has it; an empty table gives an empty result;
repeated rows are each counted; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tierwise.llm.common import map_arrow, schema_of, table, text_rows

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Pretokens kept by one worker, and the longest that are kept.
CACHE, CACHE_BYTES = 800_000, 64
#: A pretoken as the byte-level pre-tokenizer cuts it. Fixed by the vocabulary's format.
#: PLAIN_PATTERN cuts the same in texts without a character of UNUSUAL, and is faster.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"
UNUSUAL = r"[^\x00-\x1b\x20-\x7fÀ-ÿ]"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeCounter(dict):
    """Pretoken -> number of tokens; a dict that counts what it misses."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        raw = lambda s: bytes(to_byte[c] for c in s)
        # symbols are numbered here: bytes first, then each merge's result as it is first made
        symbol = {bytes([b]): b for b in range(256)}
        #: left symbol << 20 | right symbol -> merge rank, and merge rank -> symbol made
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            x, y = raw(a), raw(b)
            self.made.append(symbol.setdefault(x + y, len(symbol)))
            self.ranks[symbol[x] << 20 | symbol[y]] = rank
        self.marks = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.marks, key=len, reverse=True)))) if self.marks else None
        self.pretokens = regex.compile(PATTERN).findall
        self.plain = re.compile(PLAIN_PATTERN).findall
        self.unusual = re.compile(UNUSUAL).search

    def merged(self, data: bytes) -> int:
        """Tokens of one pretoken: a heap of ranks and places over doubly linked symbols."""
        n = len(data)
        if n < 2:
            return n
        rank_of, made, symbols = self.ranks.get, self.made, list(data)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << bits | i for i in range(n - 1) if (r := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & mask
            left, j = symbols[i], after[i]
            # a place whose pair has changed since it was pushed is stale
            if left < 0 or j >= n or rank_of(left << 20 | symbols[j]) != top >> bits:
                continue
            symbols[i] = left = made[top >> bits]
            symbols[j] = -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank_of(left << 20 | symbols[k])) is not None:
                    heapq.heappush(heap, r << bits | i)
            if (h := before[i]) >= 0 and (r := rank_of(symbols[h] << 20 | left)) is not None:
                heapq.heappush(heap, r << bits | h)
        return n - merges

    def __missing__(self, token: str) -> int:
        data = token.encode()
        found = self.merged(data)
        if len(data) <= CACHE_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[token] = found
        return found

    def count(self, text: str) -> int:
        if self.special and any(x in text for x in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.count(x) for x in parts)
        cut = self.pretokens if self.unusual(text) else self.plain
        return sum(map(self.__getitem__, cut(text)))


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter for each vocabulary and worker process."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) for each row."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    rows = text_rows(docs, id_col, text_col)
    schema = schema_of(rows, ["doc_id"], "n_bytes bigint, n_tokens bigint, over_limit boolean")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path).count
        sizes, tokens = [], []
        for x in batch.column("text"):
            text = x.as_py() or ""
            sizes.append(len(text.encode()))
            tokens.append(count(text))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=schema.names)

    return map_arrow(rows, run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether they pass 1024."""
    return token_counts(table(spark, sf_dir, "documents"))
