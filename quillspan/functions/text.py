"""Text as Columns: lines, spaces, previews, ids, spans. Offsets are 0-based code points, ends exclusive."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPAN = "array<struct<start:int,end:int,hit:string>>"
#: CJK ideographs as the profile rules count them.
CJK = "\\u3400-\\u9fff"
#: Everything that Python's str.isspace and Java's (?U)\s agree on, as a class for Java.
SPACE = "(?U)\\s"


def strip_eol(col: Column) -> Column:
    """F-01: the line without its one line end."""
    return F.regexp_replace(col, "(\\r\\n|\\r|\\n)$", "")


def line_breaks(col: Column) -> Column:
    """F-02: line ends in a text; CR LF is one."""
    return F.regexp_count(col, F.lit("\\r\\n|\\r|\\n")).cast("long")


def collapse(col: Column) -> Column:
    """F-03: white space runs as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col, "(?U)\\s+", " "), "^ | $", "")


def bare(col: Column) -> Column:
    """White space of any script removed at both ends."""
    return F.regexp_replace(col, "(?U)^\\s+|\\s+$", "")


def preview(col: Column, limit: int) -> Column:
    """F-04: line ends made visible, cut to ``limit`` characters with an ellipsis."""
    shown = F.replace(F.replace(col, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(shown) <= limit, shown).otherwise(F.concat(F.substring(shown, 1, limit - 1), F.lit("…")))


def sha(col: Column) -> Column:
    return F.sha2(col, 256)


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """F-28: an id bound to its parts; a null part counts as empty."""
    joined = F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def part_of(text: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end``."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


#: Matches that one inner loop adds up; loops over blocks keep long lists of matches from costing their square.
BLOCK = 64


def _summed(both: Column) -> Column:
    """Spans from (hit, gap) pairs: what stands between matches gives the distances."""

    def length(x: Column) -> Column:
        return F.length(x["gap"]) + F.length(x["hit"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        row = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(F.concat(acc["out"], F.array(row)).cast(SPAN).alias("out"), end.alias("at"))

    def block_starts(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + length(x)))
        zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(totals, zero, lambda acc, n: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + n).alias("at")), lambda acc: acc["out"])

    def inner(z: Column) -> Column:
        zero = F.struct(F.array().cast(SPAN).alias("out"), z["start"].alias("at"))
        return F.aggregate(z["block"], zero, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), block_starts(blocks).alias("start")), inner))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int")), lambda b: F.slice(both, b * BLOCK + 1, F.lit(BLOCK)))
    return F.transform(F.array(blocks), joined)[0]


def spans(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` with its span; Spark's own position functions count UTF-16 units, which differ from code
    points. Lists are bound to names by one-element arrays, so each regular expression runs once."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    pairs = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"))  # one gap more than hits: what follows the last
    pairs = F.transform(F.array(pairs), lambda p: F.slice(p, 1, F.size(p) - 1))[0]
    found = F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, _summed(p)).otherwise(F.array().cast(SPAN)))[0]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def cjk_ratio(col: Column) -> Column:
    """G-10: ideographs among characters that are no white space; 0 without any."""
    solid = F.length(F.regexp_replace(col, "(?U)\\s", ""))
    # most texts of other scripts are told by their size, the rest by one look
    some = (F.octet_length(col) > F.length(col)) & col.rlike(f"[{CJK}]")
    return F.when(some, F.regexp_count(col, F.lit(f"[{CJK}]")) / solid).otherwise(0.0)


def ascii_letter_ratio(col: Column) -> Column:
    return F.regexp_count(col, F.lit("[A-Za-z]")) / F.greatest(F.length(col), F.lit(1))


def occurrences(col: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(word), F.lit("")))) / len(word)).cast("long")


def register_shares(col: Column, registers: dict[str, tuple[str, ...]]) -> Column:
    """G-11: each word list's share of all listed words, as a map; zeros without any."""
    counts = [sum((occurrences(col, w) for w in words), F.lit(0)) for words in registers.values()]
    total = sum(counts, F.lit(0))
    parts = []
    for name, n in zip(registers, counts, strict=True):
        parts += [F.lit(name), F.when(total > 0, n / total).otherwise(0.0)]
    return F.create_map(*parts)


def mean_sentence(col: Column) -> Column:
    """G-12: mean length of sentences that are not blank; the text's length without any."""
    parts = F.filter(F.split(col, "[。！？!?]+"), lambda s: F.length(bare(s)) > 0)
    lengths = F.aggregate(parts, F.lit(0), lambda acc, s: acc + F.length(s))
    return F.when(F.size(parts) > 0, lengths / F.size(parts)).otherwise(F.length(col).cast("double"))


def safe_ratio(part: Column, whole: Column) -> Column:
    """F-54: 1 where there is nothing to divide by."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def jaccard(a: Column, b: Column) -> Column:
    """G-13: 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# Spark has no Unicode normalisation and no case folding; these run on Arrow batches.

#: What the retrieval form of a name leaves out.
PUNCTUATION = "[\\s\\u3000，。！？；：、,.!?;:\\-—_()（）\\[\\]【】{}《》〈〉\"'“”‘’]+"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """F-05: NFKC without white space at the ends."""
    return values.map(lambda s: unicodedata.normalize("NFKC", s).strip(), na_action="ignore")


@F.pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    """F-06: NFKC, bare ends, case folded: the form entities are compared in."""
    return values.map(lambda s: unicodedata.normalize("NFKC", s).strip().casefold(), na_action="ignore")


def search_form(col: Column) -> Column:
    """F-07: folded, and without punctuation and white space anywhere: the form questions are matched in."""
    return F.regexp_replace(folded(col), f"(?U){PUNCTUATION}", "")
