"""Aligning the words of two texts that should be the same."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Words of a text, lower case, without signs, parted by blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def aligned(pairs: DataFrame, keys: list[str], a: str, b: str, most_gaps: int = 10) -> DataFrame:
    """keys, words_a, words_b, aligned, ratio, gaps(size, ours, theirs): matching blocks of the words of two texts and their largest gaps.

    Pairs are independent and are aligned in Arrow batches where they stand.
    """
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, x, y in pdf.itertuples(index=False):
                u, v = x.split(), y.split()
                m = difflib.SequenceMatcher(None, u, v, autojunk=False)
                gaps, i, j, same = [], 0, 0, 0
                for p, q, n in m.get_matching_blocks():
                    if p > i or q > j:
                        gaps.append((p - i + q - j, " ".join(u[i:p]), " ".join(v[j:q])))
                    i, j, same = p + n, q + n, same + n
                gaps.sort(key=lambda g: -g[0])
                out.append((*key, len(u), len(v), same, round(m.ratio(), 6), [{"size": s, "ours": o, "theirs": t} for s, o, t in gaps[:most_gaps]]))
            yield pd.DataFrame(out, columns=[*keys, "words_a", "words_b", "aligned", "ratio", "gaps"])

    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return pairs.select(*keys, plain(F.col(a)).alias("_a"), plain(F.col(b)).alias("_b")).mapInPandas(run, f"{named}, words_a int, words_b int, aligned int, ratio double, gaps array<struct<size:int,ours:string,theirs:string>>")
