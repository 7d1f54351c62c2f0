"""Operator 1: exact token counts of every prefix of a text.

A BPE encoding is valid if and only if each of its adjacent pairs of pieces is the encoding of their joined
string. So the encoding of a prefix ends in the one piece that agrees with the last piece of the shorter prefix
before it, and one pass from left to right (a dynamic program over prefixes) gives the token count of *every*
prefix. The counts are kept as differences from one code point to the next; sums of them answer how many tokens a
cut text has and how much of a text a budget buys, without encoding anything again.

No piece of the vocabulary has a space mark after another character (checked when the model is read), so a text
falls apart into units of leading space marks and the characters after them, and units are solved one by one.
Null and empty texts have no tokens. Long texts take time in proportion to their length.
"""

from __future__ import annotations

import functools
import re
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MARK = "▁"
#: Units whose solution a worker keeps; at this many it starts anew.
KEPT_UNITS = 400_000
NEVER = float("inf")


class PrefixCounter:
    """Token counts of prefixes under one SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans two words: this model can't be solved unit by unit")
        #: Lower ranks merge first.
        self.rank = {p: -sp.get_score(sp.piece_to_id(p)) for p in pieces}
        #: Finds the pieces that end at each character, the longest first; a piece comes with what is known of it after others.
        found = ahocorasick.Automaton()
        for p in pieces:
            found.add_word(p, (len(p), p, {}))
        found.make_automaton()
        self.pieces_in = found.iter
        self.split_of: dict[str, tuple[str, str] | None] = {}
        self.units: dict[str, bytes] = {}
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose join makes this one when it is encoded alone; None if its encoding is another."""
        if piece not in self.split_of:
            parts = list(piece)
            while len(parts) > 2:
                ranks = [self.rank.get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
                if (best := min(ranks)) == NEVER:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split_of[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.split_of[piece]

    def agree(self, a: str, b: str) -> bool:
        """Whether b may follow a (if a is empty: start a unit).

        Undoes the merges of both pieces, the latest first. The pair doesn't stand if a join over their border would
        have come before the merge that has just been undone.
        """
        if len(b) > 1 and self.halves(b) is None:
            return False
        rank, split_of, limit = self.rank, self.split_of, NEVER
        while a:
            if rank.get(a + b, NEVER) < limit:
                return False
            of_a = rank[a] if len(a) > 1 else -1
            of_b = rank[b] if len(b) > 1 else -1
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                limit, a = of_a, (split_of.get(a) or self.halves(a))[1]
            else:  # of two equal pieces the left one was made first
                limit, b = of_b + 0.5, (split_of.get(b) or self.halves(b))[0]
        return True

    def solve(self, unit: str) -> bytes:
        """Differences of the prefix counts of one unit, as 16-bit integers."""
        n = len(unit)
        last, count = [""] * (n + 1), [0] * (n + 1)
        done = 0  # prefixes up to here are solved
        for end, (width, piece, follows) in self.pieces_in(unit):
            end += 1
            if last[end]:
                continue
            if end - done > 1:
                self.skip(unit, last, count, done, end - 1)
                done = end - 1
            before = last[end - width]
            ok = follows.get(before)
            if ok is None:
                ok = follows[before] = self.agree(before, piece)
            if ok:
                last[end], count[end], done = piece, count[end - width] + 1, end
        self.skip(unit, last, count, done, n)
        return array("h", map(sub, count[1:], count)).tobytes()

    @staticmethod
    def skip(unit: str, last: list[str], count: list[int], done: int, to: int) -> None:
        """Characters that aren't in the vocabulary stand alone and count their bytes."""
        for end in range(done + 1, to + 1):
            last[end] = unit[end - 1]
            count[end] = count[end - 1] + len(last[end].encode())

    def steps(self, text: str | None) -> bytes:
        """Differences of the token counts from each code point of a text to the next."""
        if not text:
            return b""
        if len(self.units) > KEPT_UNITS:
            self.units.clear()
        units, solved = self.split(MARK + text.replace(" ", MARK)), self.units
        for u in set(units).difference(solved):
            solved[u] = self.solve(u)
        steps = np.frombuffer(b"".join(map(solved.__getitem__, units)), np.int16)
        first = steps[:2].sum(dtype=np.int16)  # the mark before a text is no code point of the text
        return first.tobytes() + steps[2:].tobytes()


@functools.lru_cache(2)
def _counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def prefix_steps(text: Column, model_file: str) -> Column:
    """BINARY: int16 differences of the token count, one for each code point of the text. Null and empty texts: empty."""

    @F.arrow_udf("binary")
    def steps(texts: pa.Array) -> pa.Array:
        counter = _counter(model_file)
        return pa.array([counter.steps(t.as_py()) for t in texts], pa.binary())

    return steps(text)


def budget_answers(steps: Column, budget: int) -> Column:
    """STRUCT n_tokens, fits (code points of the longest prefix within the budget), from stored prefix counts alone."""

    @F.arrow_udf("n_tokens long, fits long")
    def answers(rows: pa.Array) -> pa.Array:
        total, fits = [], []
        for row in rows:
            counts = np.cumsum(np.frombuffer(row.as_py() or b"", np.int16), dtype=np.int64)
            total.append(int(counts[-1]) if len(counts) else 0)
            within = np.flatnonzero(counts <= budget)
            fits.append(int(within[-1]) + 1 if len(within) else 0)
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(fits, pa.int64())], ["n_tokens", "fits"])

    return answers(steps)


def tokens_before(steps: Column, n_chars: Column) -> Column:
    """LONG: the token count of the first n_chars code points, from stored prefix counts alone."""

    @F.arrow_udf("long")
    def counts(rows: pa.Array, cuts: pa.Array) -> pa.Array:
        out = [int(np.frombuffer(r.as_py() or b"", np.int16)[: max(0, c.as_py() or 0)].sum(dtype=np.int64)) for r, c in zip(rows, cuts, strict=True)]
        return pa.array(out, pa.int64())

    return counts(steps, n_chars)


def token_counts(df: DataFrame, model_file: str, text: str = "text", budget: int = 4096) -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit and fits (code points that the budget buys); such columns of df are replaced."""
    answers = "__budget_answers"
    return (
        small_batches(df).withColumn(answers, budget_answers(prefix_steps(F.col(text), model_file), budget))
        .withColumns({
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": F.col(answers)["n_tokens"],
            "over_limit": F.col(answers)["n_tokens"] > budget,
            "fits": F.col(answers)["fits"],
        })
        .drop(answers)
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
