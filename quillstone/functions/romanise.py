"""Devanagari to Latin letters after the public ITRANS scheme, for phonetic search."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: consonants, dependent vowel signs, independent vowels and marks with their ITRANS spellings
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v sh Sh s h L".split(), strict=True))
NUKTA = {"क": "q", "ख": "K", "ग": "G", "ज": "z", "ड": ".D", "ढ": ".Dh", "फ": "f"}
COMPOSED = {chr(0x0958 + i): v for i, v in enumerate("q K G z .D .Dh f Y".split())}
SIGNS = dict(zip("ािीुूृेैोौॅॉ", "A i I u U RRi e ai o au e o".split(), strict=True))
VOWELS = dict(zip("अआइईउऊऋएऐओऔऍऑ", "a A i I u U RRi e ai o au e o".split(), strict=True))
MARKS = {"ं": "M", "ँ": ".N", "ः": "H", "ऽ": ".a", "।": "|", "॥": "||"} | {chr(0x0966 + i): str(i) for i in range(10)}
VIRAMA, NUKTA_SIGN = "\u094d", "\u093c"


@lru_cache(1 << 18)
def itrans(run: str) -> str:
    out, i = [], 0
    while i < len(run):
        c = run[i]
        if c in CONSONANTS or c in COMPOSED:
            spelt = CONSONANTS.get(c) or COMPOSED[c]
            if run[i + 1 : i + 2] == NUKTA_SIGN:
                spelt, i = NUKTA.get(c, spelt), i + 1
            follow = run[i + 1 : i + 2]
            if follow == VIRAMA:
                i += 1
            elif follow in SIGNS and follow:
                spelt, i = spelt + SIGNS[follow], i + 1
            else:
                spelt += "a"
            out.append(spelt)
        else:
            out.append(VOWELS.get(c) or MARKS.get(c) or SIGNS.get(c) or ("" if c in (VIRAMA, NUKTA_SIGN) else c))
        i += 1
    return "".join(out)


def romanise(text: Column) -> Column:
    """Every Devanagari run in Latin letters; texts without one never leave the JVM's hands for the Python worker's work."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: re.sub("[\u0900-\u097f]+", lambda m: itrans(m[0]), t), na_action="ignore")

    udf = F.pandas_udf(each, T.StringType())
    return F.coalesce(F.when(text.rlike(r"[\x{0900}-\x{097F}]"), udf(text)).otherwise(text), F.lit(""))
