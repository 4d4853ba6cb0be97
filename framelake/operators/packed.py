"""Several values packed in one field: one row per value, with its position.

A cell is cut into tokens: an ordinary run (letters, digits, inner blanks, an apostrophe between letters, a
slash without blanks beside it), a run of blanks, an escape, or one special character. Masking every ordinary
run by ``w`` and every blank run by a blank leaves the cell's *delimiter skeleton*. Which tokens belong to
which value depends on the skeleton alone, so the rule is worked out once per distinct skeleton, in Python,
and every cell is then taken apart by token positions inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.text import BLANK, strip_blanks
from framelake.operators.skew import lookup_join

#: Marks that separate values, quotes that open and close a value, brackets of a list.
SEPARATORS = ",;|\n\r\t；、，·/"
SPACED_SEPARATORS = "·/"  # these need a blank or the cell's end on one side
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "‘": "’"}
SPECIAL = SEPARATORS + "\"'“”«»‘’[]"

#: The blanks of Unicode and the invisible marks, without the line and tab separators.
SOFT = " \x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0            ​‌‍    ⁠　﻿"

_SET = "".join("\\" + c if c in "[]|" else c for c in SPECIAL)
_PLAIN = rf"(?:[^{_SET}{SOFT}\\]|(?<=\p{{L}})['’](?=\p{{L}})|(?<=[\p{{L}}\p{{N}}])/(?=[\p{{L}}\p{{N}}]))"
TOKEN = rf"(?s)(?:\\u[0-9a-fA-F]{{4}})+|\\x[0-9a-fA-F]{{2}}|\\.|{_PLAIN}+(?:[{SOFT}]+{_PLAIN}+)*|[{SOFT}]+|."
#: A longer skeleton is resolved beside its cell instead of once for all cells that share it.
LONG_SKELETON = 512


def _mask(token: Column) -> Column:
    first, second = F.substring(token, 1, 1), F.substring(token, 2, 1)
    escape = F.when(F.length(token) == 1, F.lit("w")).when((second == "u") & (F.length(token) >= 6), F.lit("U")).when((second == "x") & (F.length(token) == 4), F.lit("X")).otherwise(F.lit("E"))
    return F.when(first == "\\", escape).when(F.lit(SOFT).contains(first), F.lit(" ")).when((F.length(token) == 1) & F.lit(SPECIAL).contains(token), token).otherwise(F.lit("w"))


def resolve_skeleton(skeleton: str) -> list[list[int]]:
    """For each value of a cell with this skeleton the 1-based numbers of its tokens, in order.

    A quote opens only where a value starts and closes only where one ends (blanks, then a separator or the
    end of the cell or list); a doubled quote inside stands for one. A separator inside quotes, after a
    backslash or, for the slash and the middle dot, without a blank or an end beside it is part of the value.
    """
    s, lo, hi = skeleton, 0, len(skeleton)
    bare = skeleton.strip(" \n\r\t")
    if bare.startswith("[") and bare.endswith("]") and len(bare) > 1:
        lo, hi = s.index("[") + 1, s.rindex("]")

    def splits(i: int) -> bool:
        c = s[i]
        if c not in SEPARATORS:
            return False
        if c not in SPACED_SEPARATORS:
            return True
        around = " \n\r\t"
        return i == lo or i == hi - 1 or s[i - 1] in around or s[i + 1] in around

    def ends(i: int) -> bool:
        while i < hi and s[i] == " ":
            i += 1
        return i >= hi or splits(i)

    values, now, i = [], [], lo
    start = True
    while i < hi:
        c = s[i]
        if start and c in QUOTES:
            close, j, inner = QUOTES[c], i + 1, []
            while j < hi:
                if s[j] == close and close == c and j + 1 < hi and s[j + 1] == close and not ends(j + 1):
                    inner.append(j)
                    j += 2
                elif s[j] == close and close == c and s[j + 1 : j + 3] == close * 2 and ends(j + 3):
                    inner.append(j)  # a doubled quote right before the closing one
                    j += 2
                elif s[j] == close and ends(j + 1):
                    break
                else:
                    inner.append(j)
                    j += 1
            if j < hi:
                now, i, start = inner, j + 1, False
                continue
        if splits(i):
            values.append(now)
            now, start = [], True
        else:
            if c != " ":
                start = False
            if not (c == " " and not now):
                now.append(i)
        i += 1
    values.append(now)
    return [[k + 1 for k in v] for v in values if any(s[k] != " " for k in v)]


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(rule=[resolve_skeleton(s) for s in b["skeleton"]])


def _text(token: Column) -> Column:
    """What one token stands for inside a value."""
    first, second = F.substring(token, 1, 1), F.substring(token, 2, 1)
    escaped = F.substring(token, 2, 1 << 30)
    return (
        F.when((first != "\\") | (F.length(token) == 1), token)
        .when((second == "u") & (F.length(token) >= 6), F.decode(F.unhex(F.regexp_replace(token, r"\\u", "")), "UTF-16BE"))
        .when((second == "x") & (F.length(token) == 4), F.decode(F.unhex(F.concat(F.lit("00"), F.substring(token, 3, 2))), "UTF-16BE"))
        .when(second == "n", F.lit("\n"))
        .when(second == "t", F.lit("\t"))
        .when(second == "r", F.lit("\r"))
        .otherwise(escaped)
    )


def split_packed(df: DataFrame, id_col: str, fields: list[str], checkpoint=None) -> DataFrame:
    """Rows (``id_col``, ``field``, ``pos``, ``value``): one for each value in each named field.

    Null, empty and blank cells give no rows; empty values are dropped and not counted; a repeated value keeps
    every position. An unclosed quote is an ordinary character. Other columns of ``df`` are ignored.

    Cells repeat, so each distinct text is cut once and meets its rows afterwards. Rules are resolved per distinct
    skeleton; a skeleton of more than ``LONG_SKELETON`` characters is resolved beside its cell, so rules that are
    broadcast stay small. Frequent skeletons and cells meet their rows by ``lookup_join``. ``checkpoint`` stores
    the two intermediate tables once; by default they are recomputed.
    """
    stored = checkpoint or (lambda x: x)
    names = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("cell")) for f in fields])
    cells = df.select(F.col(id_col).alias("_id"), F.explode(names).alias("_c")).select("_id", "_c.field", "_c.cell").where(F.col("cell").rlike(r"[^\s\p{Z}]"))
    texts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).withColumn("tokens", F.regexp_extract_all("cell", F.lit(TOKEN), 0))
    texts = stored(texts.withColumn("skeleton", F.array_join(F.transform("tokens", _mask), "")))
    short, long = texts.where(F.length("skeleton") <= LONG_SKELETON), texts.where(F.length("skeleton") > LONG_SKELETON)
    rules = short.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).mapInPandas(_resolve, "skeleton string, n long, rule array<array<int>>")
    ruled = lookup_join(short, stored(rules), "skeleton", "n")
    beside = long.mapInPandas(_resolve, "cell string, rows long, tokens array<string>, skeleton string, rule array<array<int>>")
    values = F.transform("rule", lambda v: strip_blanks(F.array_join(F.transform(v, lambda k: _text(F.element_at("tokens", k))), "")))
    cut = ruled.select("cell", "rows", "tokens", "rule").unionByName(beside.select("cell", "rows", "tokens", "rule"))
    cut = stored(cut.select("cell", "rows", F.filter(values, lambda v: v != "").alias("v")))
    met = lookup_join(cells, cut, "cell", "rows")
    return met.select(F.col("_id").alias(id_col), "field", F.posexplode("v").alias("p", "value")).select(id_col, "field", (F.col("p") + 1).cast("int").alias("pos"), "value")


def newest_rows(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row per ``key``: the one sent last, ties broken by the values themselves. A null key counts as one key."""
    packed = F.struct(*columns)
    return df.groupBy(key).agg(F.max_by(packed, F.struct(F.col(order), F.to_json(packed))).alias("_r")).select(key, "_r.*")


__all__ = ["split_packed", "resolve_skeleton", "newest_rows", "BLANK"]
