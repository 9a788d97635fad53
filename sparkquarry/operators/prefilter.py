"""One pass over a text for all tokens that any rule needs: an Aho-Corasick automaton gives a bitset, and rules test bits.

Bit i of the array of longs (64 a word) says whether token i stands anywhere in the text, case folded by A-Z only. A text is
looked through once whatever the number of tokens; null texts have no bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def folded(text: str) -> str:
    """A-Z in lower case, nothing else: offsets and other letters stay."""
    return text.translate(FOLD)


FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@lru_cache(maxsize=8)
def automaton(tokens: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, token in enumerate(tokens):
        if token:
            out.add_word(folded(token), (*(out.get(folded(token), ())), i))
    out.make_automaton()
    return out


def bits_of(text: str | None, tokens: tuple[str, ...]) -> list[int]:
    """The words of a text's bitset, as signed longs."""
    words = np.zeros(max(1, -(-len(tokens) // WORD)), np.uint64)
    found = automaton(tokens)
    if text and len(found):
        for _, which in found.iter(folded(text)):
            for i in which:
                words[i // WORD] |= np.uint64(1) << np.uint64(i % WORD)
    for i, token in enumerate(tokens):  # the empty token stands in every text
        if not token and text is not None:
            words[i // WORD] |= np.uint64(1) << np.uint64(i % WORD)
    return words.view(np.int64).tolist()


def token_bits(rows: DataFrame, text: str, tokens: list[str], name: str = "bits") -> DataFrame:
    """rows with the bitset of their text. tokens are few: they go with the plan."""
    held = tuple(tokens)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bits_of(t, held) for t in texts])

    return rows.withColumn(name, F.pandas_udf(run, "array<long>")(F.col(text)))


def any_bit(bits: str | Column, places: list[int]) -> Column:
    """Whether one of the tokens at these places was found: a conjunction with a mask for each word that has any."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    masks: dict[int, int] = {}
    for i in places:
        masks[i // WORD] = masks.get(i // WORD, 0) | 1 << (i % WORD)
    signed = lambda m: m - (1 << WORD) if m >= 1 << (WORD - 1) else m
    out = F.lit(False)
    for word, mask in masks.items():
        out = out | (F.get(bits, F.lit(word)).bitwiseAND(F.lit(signed(mask)).cast("long")) != 0)
    return out
