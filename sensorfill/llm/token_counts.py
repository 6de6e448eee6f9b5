"""Token counts of byte-pair encodings by merging with a heap and a linked list.

A word's bytes are symbols in a linked list. A heap holds the adjacent pairs that may
merge; the one of lowest rank is popped again and again, the leftmost first, and merged;
pairs that a merge has made stale are passed over. The count is the number of first
symbols less the number of merges. No identifier is looked up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A tokenizer file of the ``tokenizers`` library: byte-level BPE.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: What its byte-level splitting uses.
PATTERN = public_tokenizers.PATTERN
# Code points that ``regex`` takes for letters or digits by its newer
# Unicode tables and the ``tokenizers`` library does not.
TOO_NEW = """0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1
    AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9
    11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF
    18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
    1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5
    1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479
    3D000-3FC3F""".split()
LIMIT = 512
#: Pieces of text whose counts a task remembers.
MEMO = 400_000


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: visible Latin-1 characters for themselves,
    the others, in order, for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def word_pattern() -> regex.Pattern:
    """``PATTERN`` with the letters and digits that the library knows."""
    ranges = ["-".join(chr(int(x, 16)) for x in r.split("-")) for r in TOO_NEW]
    new = "".join(ranges)
    known = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{new}]]")
    for kind in ("L", "N"):
        known = known.replace(rf"?\p{{{kind}}}", rf"?[\p{{{kind}}}--[{new}]]")
    return regex.compile(known, regex.V1)


class Counter:
    """Counts tokens as the tokenizer of a file would make them."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, split = made["model"], made["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"]
        if model["type"] != "BPE" or made["normalizer"] or not plain or model["ignore_merges"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.rank = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        self.words = word_pattern()
        added = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.of_word: dict[str, int] = {}
        self.of_piece: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Symbols left of one word when no pair of it can merge any more."""
        symbols = list(word.encode().decode("latin-1").translate(self.symbols))
        n = left = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank.get
        heap = [
            (r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None
        ]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def _words(self, piece: str) -> int:
        total = 0
        for word in self.words.findall(piece):
            n = self.of_word.get(word)
            if n is None:
                n = self.merged(word)
                if len(self.of_word) >= MEMO:
                    self.of_word.clear()
                self.of_word[word] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        """Tokens of a text without added tokens.

        A space before a visible character always begins a word, and white space never
        follows a visible character inside one. So a part between spaces that begins and
        ends visibly is counted, with the space before it, on its own, and remembered.
        """
        parts = text.split(" ")
        total, known = 0, self.of_piece.get
        opened = 0  # the first part of a run that must be read together, or -1
        for i, part in enumerate(parts):
            n = known(part) if i else None
            if n is None:
                if not i or not part or part[0].isspace() or part[-1].isspace():
                    if opened < 0:
                        opened = i
                    continue
                n = self._words(" " + part)
                if len(self.of_piece) >= MEMO:
                    self.of_piece.clear()
                self.of_piece[part] = n
            if opened >= 0:
                total += self._words((" " if opened else "") + " ".join(parts[opened:i]))
                opened = -1
            total += n
        if opened >= 0:
            total += self._words((" " if opened else "") + " ".join(parts[opened:]))
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; an added token's string in it is one token."""
        if self.added is None:
            return self._plain(text)
        plain = self.added.split(text)
        return len(plain) - 1 + sum(map(self._plain, filter(None, plain)))


def with_counts(docs: DataFrame, path: str = TOKENIZER, text: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8) and n_tokens of each whole text; a null text is empty and has
    neither. ``docs`` must not have the two columns."""
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            columns = [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([counter.count(t) for t in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, "n_bytes", "n_tokens"]
            )

    return docs.mapInArrow(run, schema)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has over ``LIMIT`` tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = with_counts(docs)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
