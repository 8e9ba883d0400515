"""Claim validation: a candidate against the exact text it points to (P-21 to P-28)."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.numerals import DATE_TOKEN, numbers_in, to_date, to_decimal
from quillspan.functions.text import part_of

# The wording of assertions, negations, modality and cues.
NEGATED = re.compile(
    r"并非|并未|不是|不曾|从未|不得|不能|不可以|不允许|禁止|未曾|未能|没有|无权|未|\bnot\b|\bnever\b|\bno\b|\bcannot\b|\bcan't\b|\bmay not\b|\bmust not\b", re.I
)
MODAL = re.compile(
    r"据说|传闻|听说|或许|可能|似乎|也许|假如|如果|倘若|若是|声称|宣称|谎称|自称|预计|计划|准备|将要|即将|"
    r"\breportedly\b|\ballegedly\b|\bperhaps\b|\bmaybe\b|\bif\b|\bclaimed\b|\bclaims\b|\bwill\b|\bwould\b|[？?]",
    re.I,
)
ALIAS = ("改称", "更名为", "更名", "又称", "亦称", "也称", "别名为", "别名是", "别称", "原名", "旧称", "被称为", "renamed to", "formerly known as", "also known as", "aka")
DEFEATS = ("击败", "战胜", "打败", "击溃", "defeated", "beat")
LOCATED = ("位于", "坐落于", "地处", "设于", "located in", "situated in")
PERMITS = ("可以", "能够", "允许", "准许", "获准", "有权", "可", "is allowed to", "may", "can")
FORBIDS = ("不可以", "不可", "不能", "不允许", "禁止", "不得", "无权", "is not allowed to", "may not", "cannot", "can't", "must not")
COUNTS = ("共有", "共计", "总计", "合计", "数量为", "数目为", "一共", "共", "total", "count", "has", "contains")
DATES = ("出生于", "发生于", "始于", "截至", "日期", "时间", "date", "on", "since")
CLAUSE_BREAK, COUNT_BREAK = re.compile(r"[\n。！？!?；;]+"), re.compile(r"[\n。！？!?；;，,]+")
TYPES = ("alias", "defeats", "located_in", "permission", "count", "date")
VALIDATOR = "quillspan-claims-1"
RESULT = (
    "status string, reason_codes array<string>, matched_spans array<struct<start:int,end:int>>, normalized_value string, claim_fingerprint string, result_id string, "
    "may_index boolean, evidence string"
)
#: Writes what a fingerprint is of.
TOLD = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))
Span = tuple[int, int]


class Claim(NamedTuple):
    """A candidate as validators see it."""

    claim_type: str
    subject: str = ""
    object: str = ""
    value: object = None
    unit: str = ""
    polarity: bool = True


class Verdict(NamedTuple):
    status: str
    reason: str
    spans: tuple[Span, ...] = ()


@lru_cache(32)  # few, as they may be long: a claim asks for the same ones over and over
def normal(text: str) -> str:
    return unicodedata.normalize("NFKC", text).strip()


def literal(text: str) -> str:
    """F-09: a literal in whose white space may vary."""
    return r"\s*".join(re.escape(p) for p in normal(text).split())


@cache
def any_of(markers: tuple[str, ...]) -> str:
    """F-10: alternatives; English words stand alone."""
    shape = lambda m: re.escape(m).replace(r"\ ", r"\s+")
    return "(?:" + "|".join(rf"\b{shape(m)}\b" if re.fullmatch("[A-Za-z ]+", m) else shape(m) for m in markers) + ")"


COUNT_CUE = re.compile(any_of(COUNTS), re.I)


@cache
def _alternatives(markers: tuple[str, ...]) -> tuple[re.Pattern, tuple[re.Pattern, ...]]:
    """Where a marker begins, and each marker by itself."""
    return re.compile(f"(?={any_of(markers)})", re.I), tuple(re.compile(any_of((m,)), re.I) for m in markers)


def modal(text: str, start: int, end: int) -> bool:
    """P-27: modality or a question around a match."""
    return bool(MODAL.search(text[max(0, start - 24) : end + 8]))


#: Takes ASCII letters out of a text.
NO_LETTERS = dict.fromkeys((*range(0x41, 0x5B), *range(0x61, 0x7B)))


@lru_cache(16)
def _plain(text: str) -> bool:
    """Whether only ASCII letters of a text have case, so that lower-casing it is what ignoring case means."""
    return text.isascii() or (rest := text.translate(NO_LETTERS)).lower() == rest == rest.upper()


def places(low: str, words: list[str], at: int = 0) -> Iterator[Span]:
    """Every place of lower-case ``words`` in the lower-case text, any white space between them; places may overlap."""
    while (at := low.find(words[0], at)) >= 0:
        end = at + len(words[0])
        for word in words[1:]:
            while end < len(low) and low[end].isspace():
                end += 1
            if not low.startswith(word, end):
                break
            end += len(word)
        else:
            yield at, end
        at += 1


def apart(found: Iterable[Span]) -> Iterator[Span]:
    """The first of the spans, then each that begins where the one before has ended or later."""
    last = 0
    for start, end in found:
        if start >= last:
            last = end
            yield start, end


def literal_spans(text: str, name: str) -> list[Span]:
    """F-09: all matches of a literal, in whatever case, one after the other. Names differ from row to row, so no pattern is
    compiled for one unless it has letters whose case folding is not plain."""
    words = normal(name).split()
    if words and _plain(text) and _plain(name):
        return list(apart(places(text.lower(), [w.lower() for w in words])))
    return [m.span() for m in re.finditer(literal(name), text, re.I)]


class Gap(NamedTuple):
    """What may lie between the parts of a relation: at most so many characters, none of the breaks."""

    size: int
    breaks: re.Pattern

    def pattern(self) -> str:
        return f"[^{self.breaks.pattern[1:-1]}]{{0,{self.size}}}?"


GAP, PERMISSION_GAP = Gap(24, re.compile("[\n。！？!?；;，,:：]")), Gap(16, re.compile("[\n。！？!?；;，,]"))


def relations(text: str, left: str, markers: tuple[str, ...], right: str, gap: Gap = GAP) -> list[Span]:
    """F-11: spans of ``left`` (may be empty), a marker and ``right``, close together and within a clause: what the lazy
    pattern left-gap-marker-gap-right finds, from the places of its parts."""
    heads, ends = normal(left).split(), normal(right).split()
    starts, each = _alternatives(markers)
    marked = [(m.start(), [x.end() for p in each if (x := p.match(text, m.start()))]) for m in starts.finditer(text)]
    if not marked:
        return []
    if not ends or (left and not heads) or not (_plain(text) and _plain(left) and _plain(right)):
        before = f"{literal(left)}{gap.pattern()}" if left else ""
        return [m.span() for m in re.finditer(f"{before}{any_of(markers)}{gap.pattern()}{literal(right)}", text, re.I)]
    low = text.lower()
    tails = list(places(low, [w.lower() for w in ends]))
    if not tails:
        return []
    breaks = [m.start() for m in gap.breaks.finditer(text)]

    def reach(at: int) -> int:
        """The last place where what follows ``at`` after a gap may begin."""
        k = bisect_left(breaks, at)
        return min(at + gap.size, breaks[k] if k < len(breaks) else len(text))

    def close(options: list[int]) -> int | None:
        """Where a match ends whose marker ends at one of ``options``, the first that has ``right`` behind it."""
        for at in options:
            k = bisect_left(tails, (at, 0))
            if k < len(tails) and tails[k][0] <= reach(at):
                return tails[k][1]
        return None

    closed = [(start, end) for start, options in marked if (end := close(options)) is not None]

    def opened() -> Iterator[Span]:
        for start, at in places(low, [w.lower() for w in heads]):
            k = bisect_left(closed, (at, 0))
            if k < len(closed) and closed[k][0] <= reach(at):
                yield start, closed[k][1]

    return list(apart(opened() if heads else closed))


class Matches:
    """Spans by whether they are negated and whether they are asserted (F-12, P-28)."""

    def __init__(self, evidence: str, found: list[Span], left_context: int = 0):
        self.sets: dict[tuple[bool, bool], list[Span]] = {(n, a): [] for n in (False, True) for a in (False, True)}
        for start, end in found:
            denied = bool(NEGATED.search(evidence[max(0, start - left_context) : end]))
            self.sets[denied, not modal(evidence, start, end)].append((start, end))

    def get(self, negated: bool | None = None, asserted: bool = True) -> list[Span]:
        """Matches, negated or not (None: both)."""
        return [s for n in (False, True) if negated in (None, n) for s in self.sets[n, asserted]]


def decide(ladder: list[tuple[object, str, str, list[Span]]]) -> Verdict:
    """The first step whose condition holds."""
    return next(Verdict(status, reason, tuple(spans)) for holds, status, reason, spans in ladder if holds)


MODAL_REASON = "MODAL_REPORTED_OR_QUESTION_ASSERTION"


def alias(c: Claim, evidence: str) -> Verdict:
    """P-22: symmetric."""
    if not (c.subject and c.object):
        return Verdict("rejected", "ALIAS_TERMS_REQUIRED")
    found = Matches(evidence, relations(evidence, c.subject, ALIAS, c.object) + relations(evidence, c.object, ALIAS, c.subject))
    yes, no, perhaps = found.get(False), found.get(True), found.get(None, False)
    return decide(
        [
            (yes and no, "review", "CONFLICTING_ALIAS_ASSERTIONS", yes + no),
            (yes, "accepted", "EXACT_TYPED_ALIAS_MATCH", yes),
            (no, "rejected", "NEGATED_ALIAS_RELATION", no),
            (perhaps, "review", MODAL_REASON, perhaps),
            (True, "rejected", "ALIAS_RELATION_NOT_FOUND", []),
        ]
    )


def directed(c: Claim, evidence: str, markers: tuple[str, ...], accepted: str) -> Verdict:
    """P-23: the direction counts."""
    if not (c.subject and c.object):
        return Verdict("rejected", "RELATION_TERMS_REQUIRED")
    ahead, back = (Matches(evidence, relations(evidence, a, markers, b)) for a, b in ((c.subject, c.object), (c.object, c.subject)))
    yes, no, turned = ahead.get(False), ahead.get(True), back.get(False)
    perhaps = ahead.get(None, False) + back.get(False, False)
    return decide(
        [
            (yes and (no or turned), "review", "CONFLICTING_RELATION_ASSERTIONS", yes + no + turned),
            (yes, "accepted", accepted, yes),
            (no, "rejected", "NEGATED_RELATION", no),
            (turned, "rejected", "RELATION_DIRECTION_MISMATCH", turned),
            (perhaps, "review", MODAL_REASON, perhaps),
            (True, "rejected", "RELATION_NOT_FOUND", []),
        ]
    )


def permission(c: Claim, evidence: str) -> Verdict:
    """P-24: the polarity counts; a negation up to six characters before makes a permission none."""
    if not c.object:
        return Verdict("rejected", "PERMISSION_ACTION_REQUIRED")
    found = lambda markers: relations(evidence, c.subject, markers, c.object, PERMISSION_GAP)
    allowed, barred = Matches(evidence, found(PERMITS), left_context=6), Matches(evidence, found(FORBIDS))
    both = [allowed.get(False), barred.get(None)]
    same, other = both if c.polarity else both[::-1]
    perhaps = allowed.get(False, False) + barred.get(None, False)
    return decide(
        [
            (same and other, "review", "CONFLICTING_PERMISSION_ASSERTIONS", same + other),
            (same, "accepted", "EXACT_TYPED_PERMISSION_MATCH", same),
            (other, "rejected", "PERMISSION_POLARITY_MISMATCH", other),
            (perhaps, "review", MODAL_REASON, perhaps),
            (True, "rejected", "PERMISSION_RELATION_NOT_FOUND", []),
        ]
    )


def segments(evidence: str, breaks: re.Pattern, subject: str, cues: tuple[str, ...]) -> list[tuple[int, str]]:
    """F-13 to F-15: parts of the evidence that hold the subject and a cue (all given folded), with their offsets."""
    edges = [0, *(x for m in breaks.finditer(evidence) for x in m.span()), len(evidence)]
    parts = [(a, evidence[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
    held, name = [], normal(subject).casefold()
    for a, part in parts:
        folded = normal(part).casefold()
        if name in folded and any(cue in folded for cue in cues):
            held.append((a, part))
    return held


def _valued(exact: dict[bool, list[Span]], seen: dict[bool, set], expected: object, kind: str) -> Verdict:
    """What counts and dates have in common, once all values are gathered by whether they are asserted."""
    others = any(v != expected for v in seen[True])
    table = {"count": ("MULTIPLE_COUNT_VALUES", "EXACT_TYPED_COUNT_MATCH", "NUMERIC_VALUE_MISMATCH", "COUNT_VALUE_NOT_FOUND")}
    many, match, mismatch, missing = table.get(kind, ("MULTIPLE_DATE_VALUES", "EXACT_TYPED_DATE_MATCH", "DATE_VALUE_MISMATCH", "DATE_VALUE_NOT_FOUND"))
    return decide(
        [
            (exact[True] and others, "review", many, exact[True]),
            (exact[True], "accepted", match, exact[True]),
            (exact[False], "review", MODAL_REASON, exact[False]),
            (True, "rejected", mismatch if seen[True] or seen[False] else missing, []),
        ]
    )


def count(c: Claim, evidence: str) -> Verdict:
    """P-25: only numbers behind a cue that the subject governs, and none inside the subject."""
    expected = to_decimal(c.value)
    if not c.subject or expected is None:
        return Verdict("rejected", "COUNT_SUBJECT_AND_NUMERIC_VALUE_REQUIRED")
    parts = segments(evidence, COUNT_BREAK, c.subject, COUNTS)
    if not parts:
        return Verdict("rejected", "COUNT_ASSERTION_NOT_FOUND")
    exact, seen = {True: [], False: []}, {True: set(), False: set()}
    for offset, part in parts:
        sure = not MODAL.search(part)
        owners = literal_spans(part, c.subject)
        cues = [m.span() for m in COUNT_CUE.finditer(part)]
        for number, a, b in numbers_in(part):
            before = [cue for cue in cues if cue[1] <= a]
            inside = any(x < b and a < y for x, y in owners)
            if inside or not before or not any(y <= before[-1][0] or x >= b for x, y in owners):
                continue
            seen[sure].add(number)
            tail = part[b : b + max(8, len(c.unit) + 4)]
            if number == expected and (not c.unit or normal(c.unit).casefold() in normal(tail).casefold()):
                exact[sure].append((offset + a, offset + b))
    return _valued(exact, seen, expected, "count")


def dated(c: Claim, evidence: str) -> Verdict:
    """P-26: dates in clauses with the subject and a cue; a month is not a day."""
    expected = to_date(c.value)
    if not c.subject or expected is None:
        return Verdict("rejected", "DATE_SUBJECT_AND_VALUE_REQUIRED")
    parts = segments(evidence, CLAUSE_BREAK, c.subject, DATES)
    if not parts:
        return Verdict("rejected", "DATE_ASSERTION_NOT_FOUND")
    exact, seen = {True: [], False: []}, {True: set(), False: set()}
    for offset, part in parts:
        sure = not MODAL.search(part)
        for m in DATE_TOKEN.finditer(part):
            value = to_date(m[0])
            if value is not None:
                seen[sure].add(value)
                if value == expected:
                    exact[sure].append((offset + m.start(), offset + m.end()))
    return _valued(exact, seen, expected, "date")


VALIDATORS = {
    "alias": alias,
    "defeats": lambda c, e: directed(c, e, DEFEATS, "EXACT_TYPED_DEFEAT_MATCH"),
    "located_in": lambda c, e: directed(c, e, LOCATED, "EXACT_TYPED_LOCATION_MATCH"),
    "permission": permission,
    "count": count,
    "date": dated,
}


def validate(c: Claim, evidence: str) -> Verdict:
    """P-21, once the envelope is sound."""
    check = VALIDATORS.get(c.claim_type)
    return check(c, evidence) if check else Verdict("review", "UNSUPPORTED_CLAIM_TYPE")


def normalized_value(c: Claim) -> str | None:
    if c.claim_type == "count":
        number = to_decimal(c.value)
        return None if number is None else format(number.normalize(), "f")
    return (to_date(c.value) or c.value) if c.claim_type == "date" else (None if c.value is None else str(c.value))


#: What the judge of a claim is told; its other columns pass by as they are.
TOLD_OF = ("claim_type", "subject", "object", "value", "unit", "polarity", "source_id", "unit_id", "evidence_start", "evidence_end", "evidence", "envelope")


def _judged(kind, subject, object_, value, unit, polarity, source, unit_id, start, end, evidence, envelope) -> tuple:
    c = Claim(kind, subject or "", object_ or "", value, unit or "", bool(polarity))
    verdict = Verdict("rejected", envelope) if envelope else validate(c, evidence)
    plain = normalized_value(c)
    told = TOLD.encode([c.claim_type, normal(c.subject), normal(c.object), plain, normal(c.unit), c.polarity])
    fingerprint = sha256(told.encode()).hexdigest()
    digest = sha256(evidence.encode()).hexdigest()
    parts = (VALIDATOR, fingerprint, source, unit_id, str(start), str(end), digest, verdict.status, verdict.reason)
    name = "clv_" + sha256("\0".join(parts).encode()).hexdigest()[:24]
    return verdict.status, [verdict.reason], verdict.spans, plain, fingerprint, name, verdict.status == "accepted"


def _spans(each: Iterable[tuple[Span, ...]]) -> pa.Array:
    """Lists of spans as an Arrow array."""
    ends, starts, stops = [0], [], []
    for found in each:
        starts += [a for a, _ in found]
        stops += [b for _, b in found]
        ends.append(len(starts))
    both = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)


def validate_claims(candidates: DataFrame, sources: DataFrame, units: DataFrame) -> DataFrame:
    """P-21, J-01, J-02: candidates (source_id, unit_id, claim_type, subject, object, value, unit, polarity,
    evidence_start, evidence_end, evidence_text) with the verdict: status, reason_codes, matched_spans,
    normalized_value, claim_fingerprint, result_id, may_index, evidence.

    The envelope is judged on joined rows: a valid span within the text, the same text, a known unit around it. Only
    the evidence, not the whole text, goes through Arrow to the validators."""
    # by sorted shuffles: the planner's sizes are those of what candidates are made of, and would have all of them broadcast
    spans = units.select("source_id", "unit_id", F.col("start_char").alias("unit_start"), F.col("end_char").alias("unit_end")).hint("merge")
    homes = units.select("unit_id", F.col("source_id").alias("home")).groupBy("unit_id").agg(F.min("home").alias("home")).hint("merge")
    lost = candidates.select("source_id", "unit_id").distinct().join(spans, ["source_id", "unit_id"], "left_anti").join(homes, "unit_id").hint("merge")
    texts = sources.select("source_id", F.col("text").alias("source_text")).hint("merge")
    df = candidates.join(spans, ["source_id", "unit_id"], "left").join(lost, ["source_id", "unit_id"], "left").join(texts, "source_id", "left")
    a, b = F.col("evidence_start"), F.col("evidence_end")
    bad, beyond = (a < 0) | (b <= a), b > F.coalesce(F.length("source_text"), F.lit(0))
    evidence = F.when(bad | beyond, "").otherwise(part_of(F.col("source_text"), a, b))
    envelope = (
        F.when(bad, "EVIDENCE_SPAN_INVALID")
        .when(beyond, "EVIDENCE_SPAN_OUT_OF_RANGE")
        .when(F.col("evidence_text").isNotNull() & (F.col("evidence_text") != evidence), "EVIDENCE_TEXT_MISMATCH")
        .when(F.col("home").isNotNull(), "UNIT_IDENTITY_MISMATCH")
        .when(F.col("unit_start").isNull(), "UNIT_NOT_FOUND")
        .when((a < F.col("unit_start")) | (b > F.col("unit_end")), "EVIDENCE_OUTSIDE_UNIT")
    )
    df = df.withColumns({"evidence": evidence, "envelope": envelope}).drop("source_text", "unit_start", "unit_end", "home")
    kept = [c for c in df.columns if c not in ("evidence", "envelope")]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), RESULT])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                status, codes, found, plain, prints, names, index = zip(*map(_judged, *(batch.column(c).to_pylist() for c in TOLD_OF)))
                made = [pa.array(status), pa.array(codes), _spans(found), pa.array(plain, pa.string()), pa.array(prints), pa.array(names), pa.array(index), batch.column("evidence")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=written)

    written = [*kept, *(c.split()[0] for c in RESULT.replace("array<struct<start:int,end:int>>", "array").split(", "))]
    return df.mapInArrow(each, out)


def reason_counts(validated: DataFrame) -> DataFrame:
    """G-04: how often each reason was given, by status."""
    each = validated.select("claim_type", "status", F.explode("reason_codes").alias("reason_code"))
    return each.groupBy("claim_type", "status", "reason_code").agg(F.count("*").alias("n"))
