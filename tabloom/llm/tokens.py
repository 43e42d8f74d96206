"""A corpus as ids of a public tokenizer, by tree concatenation.

Every text longer than ``leaf`` characters is halved, wherever that falls, until
its parts are leaves; leaves are encoded and joined pairwise. At a join a window
about it grows until it begins and ends at places where the tokenizer splits
whatever stands around them, or at the ends; its two parts must be what the two
sides have there, and only the window is encoded again. Texts longer than
``spread`` characters have their parts encoded by different tasks; there a scan
for splits goes on from the last sure one until the right side has it, too.
Inside a long run that the tokenizer doesn't split, the halves are encoded and
windows about the join grow until the new ids agree with the old ones on both
sides: a sequence of byte-pair tokens is the encoding of its text if every two
neighbours are, so one agreeing token on either side makes the join exact.

Defined results: null and empty texts have the empty list; strings of special
tokens are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import map_batches

#: Where the vocabulary files lie unless the caller says otherwise.
FOLDER = "/opt/tokenizers"
#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for a scanner whose white space is that of Unicode's property, as the tokenizer's is.
SCAN = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s+(?!\S)|\s+", r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Characters of a leaf; of the parts of a text that several tasks share; bytes from which an unsplit run is halved; first window.
LEAF, SPREAD, RUN, WINDOW = 512, 32_768, 4_096, 32
#: A single blank between two other characters: the tokenizer splits before it, whatever stands around.
_SURE = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def _ranks(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Piece:
    """A text with its ids; for each split of the tokenizer its end in the text and in the ids."""

    text: str
    ids: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    id_ends: list[int] = field(default_factory=list)


class TreeEncoder:
    def __init__(self, data: bytes, leaf: int = LEAF, run: int = RUN):
        self.encoding, self.leaf, self.run = _ranks(data), leaf, run
        self._split = regex.compile(SCAN)

    # -- one unsplit run ---------------------------------------------------
    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.encoding.decode_single_token_bytes, ids))

    def _pairs(self, data: bytes) -> list[int]:
        return self.encoding._encode_single_piece(data)

    def _join_runs(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two halves of a run as ids of the whole."""
        w = 4
        while True:
            i, j = min(w, len(left)), min(w, len(right))
            a, b = left[len(left) - i :], right[:j]
            got = self._pairs(self._bytes(a + b))
            left_agrees = i == len(left) or got[0] == a[0]
            right_agrees = j == len(right) or got[-1] == b[-1]
            if left_agrees and right_agrees:
                return left[: len(left) - i] + got + right[j:]
            w *= 2

    def run_ids(self, data: bytes) -> list[int]:
        """Ids of an unsplit run, halved while it is long."""
        if len(data) <= self.run:
            return self._pairs(data)
        half = len(data) // 2
        return self._join_runs(self.run_ids(data[:half]), self.run_ids(data[half:]))

    # -- pieces of a text ----------------------------------------------------
    def piece(self, text: str) -> Piece:
        out = Piece(text)
        for m in self._split.finditer(text):
            data = m[0].encode("utf-8", "replace")
            out.ids.extend(self.run_ids(data))
            out.ends.append(m.end())
            out.id_ends.append(len(out.ids))
        return out

    def join(self, left: Piece, right: Piece) -> Piece:
        """Two neighbouring pieces as one, exact."""
        if not left.text or not right.text:
            return right if not left.text else left
        text, n = left.text + right.text, len(left.text)
        # A split is sure if its match, and what it looks ahead at, lies inside the left side.
        k = len(left.ends)
        while k and left.ends[k - 1] > n - 2:
            k -= 1
        k = max(0, k - 1)
        at, kept = (left.ends[k - 1], left.id_ends[k - 1]) if k else (0, 0)
        out = Piece(text, left.ids[:kept], left.ends[:k], left.id_ends[:k])
        theirs = {n + e: i for i, e in enumerate(right.ends)}
        last, last_id = (left.ends[-2], left.id_ends[-2]) if len(left.ends) > 1 else (0, 0)
        while at < len(text):
            m = self._split.match(text, at)
            if at == last and m.end() == n + right.ends[0]:  # a run that only the cut divides
                out.ids.extend(self._join_runs(left.ids[last_id:], right.ids[: right.id_ends[0]]))
            else:
                out.ids.extend(self.run_ids(m[0].encode("utf-8", "replace")))
            at = m.end()
            out.ends.append(at)
            out.id_ends.append(len(out.ids))
            if at in theirs:
                i = theirs[at]
                shift, base = len(out.ids), right.id_ends[i]
                out.ids.extend(right.ids[base:])
                out.ends.extend(n + e for e in right.ends[i + 1 :])
                out.id_ends.extend(shift + e - base for e in right.id_ends[i + 1 :])
                break
        return out

    def tree(self, pieces: list[Piece]) -> Piece:
        """All pieces of a text, joined pairwise, level by level."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else Piece("")

    # -- texts of one task -----------------------------------------------------
    def _window(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text) if len(text) <= self.leaf else self.piece(text).ids

    def _about(self, text: str, lo: int, cut: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[lo:hi] from those of its two sides."""
        w = WINDOW
        while True:
            a, b = max(lo, cut - w), min(hi, cut + w)
            start = next((m.start() for m in reversed(list(_SURE.finditer(text, a, cut)))), lo if a == lo else None)
            stop = next((m.start() for m in _SURE.finditer(text, cut, b) if m.start() > cut), hi if b == hi else None)
            if start is not None and stop is not None:
                tail, head = self._window(text[start:cut]), self._window(text[cut:stop])
                if left[len(left) - len(tail) :] == tail and right[: len(head)] == head:
                    return left[: len(left) - len(tail)] + self._window(text[start:stop]) + right[len(head) :]
                if a == lo and b == hi:
                    return self.piece(text[lo:hi]).ids
            w *= 2

    def _halved(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.encoding.encode_ordinary(text[lo:hi])
        cut = (lo + hi) // 2
        return self._about(text, lo, cut, hi, self._halved(text, lo, cut), self._halved(text, cut, hi))

    def encode(self, text: str | None) -> list[int]:
        return self._halved(text, 0, len(text)) if text else []


def vocabulary(path: str | None = None) -> bytes:
    with open(path or f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, keep: list[str], text: str, *, path: str | None = None, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """``keep`` and ids of every row.

    Texts up to ``spread`` characters are encoded in their row, without shuffle.
    Longer ones are cut in the JVM, their parts encoded by different tasks, and
    joined per text; what meets in one task is one text, whose ids make one row
    anyway. Rows that are alike in ``keep`` and text are encoded once and come out as often as they are.
    """
    data = df.sparkSession.sparkContext.broadcast(vocabulary(path))  # a vocabulary: under a megabyte, fixed
    base = df.select(*keep, F.col(text).alias("__text"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    long = F.coalesce(F.length("__text"), F.lit(0)) > spread

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TreeEncoder(data.value, leaf)
        for pdf in batches:
            out = pdf[keep].copy()
            out["ids"] = pd.Series([encoder.encode(x) for x in pdf["__text"]], dtype=object, index=out.index)
            yield out

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TreeEncoder(data.value, leaf)
        for pdf in batches:
            got = [encoder.piece(x) for x in pdf["__text"]]
            for name in ("ids", "ends", "id_ends"):
                pdf[f"__{name}"] = pd.Series([getattr(p, name) for p in got], dtype=object, index=pdf.index)
            yield pdf

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        encoder = TreeEncoder(data.value, leaf)
        copies = int((pdf["__part"] == 0).sum())
        one = pdf.drop_duplicates("__part").sort_values("__part")
        pieces = [Piece(t, list(i), list(e), list(n)) for t, i, e, n in zip(one["__text"], one["__ids"], one["__ends"], one["__id_ends"], strict=True)]
        out = pd.concat([one[keep].iloc[:1]] * copies, ignore_index=True)
        out["ids"] = pd.Series([encoder.tree(pieces).ids] * copies, dtype=object)
        return out

    near = map_batches(base.where(~long), short, own + ", ids array<int>")
    starts = F.sequence(F.lit(0), F.floor((F.length("__text") - 1) / spread).cast("int"))
    cut = base.where(long).select(*keep, "__text", F.xxhash64("__text").alias("__hash"), F.length("__text").alias("__length"), F.explode(starts).alias("__part"))
    cut = cut.withColumn("__text", F.expr(f"substring(__text, __part * {int(spread)} + 1, {int(spread)})"))
    extra = ", __text string, __hash long, __length int, __part int, __ids array<int>, __ends array<int>, __id_ends array<int>"
    spread_out = map_batches(cut.repartition(F.col("__hash"), F.col("__part")), parts, own + extra)
    far = spread_out.groupBy(*keep, "__hash", "__length").applyInPandas(joined, own + ", ids array<int>")
    return near.unionByName(far)


def token_counts(df: DataFrame, text: str, keep: list[str], *, path: str | None = None, spread: int = SPREAD) -> DataFrame:
    """``keep`` and n_tokens of every row."""
    return encode_texts(df, keep, text, path=path, spread=spread).select(*keep, F.size("ids").cast("long").alias("n_tokens"))
