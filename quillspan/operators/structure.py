"""Structure: heading candidates, contiguous units, continuity findings (section 2.12)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.numerals import ordinal
from quillspan.functions.text import collapse, part_of, sha, stable_id
from quillspan.sources.scratch import cut

from .headings import FENCE, SENTENCE_MARKS, SPLIT_NUMBER, SPLIT_UNIT, UNIT_WORDS, Heading, StructurePolicy, detect_heading, title_and_body
from .limits import within
from .lines import FIRST, LAST, in_order, physical_lines

HEADINGS = (
    "source_id string, rule_id string, unit_type string, level int, ordinal long, ordinal_text string, title string, raw string, boundary_start long, start_char long, "
    "end_char long, body_start long, start_line long, end_line long, confidence string, accepted boolean, signals array<string>, detached string, detached_start long, detached_line long"
)
#: What a line must show to matter to the scan of headings.
MAYBE = "(?iU)^\\s*(?:#|第|[卷部篇集章回幕节節]|[0-9０-９零〇○一二三四五六七八九十百千万萬亿億两兩]+\\s*[卷集]|`{3}|~{3}|volume|book|part|chapter|section|pro|pre|intro|epi|after|app|inter|extra|[序楔引前终終尾后後番外特附])"


class _Scan:
    """The state of one source's scan, line by line: fences, a number that waits for its unit, a heading without title."""

    def __init__(self, policy: StructurePolicy):
        self.policy, self.fence, self.number, self.untitled, self.rows = policy, None, None, None, []

    def line(self, line_no: int, start: int, physical: str, content: str) -> None:
        fence = FENCE.match(content)
        if fence or self.fence:
            if fence and self.fence in (None, fence["fence"][0]):
                self.fence = None if self.fence else fence["fence"][0]
            self.number = self.untitled = None
            return
        found, at, first_line, before = None, start, line_no, ""
        if self.number and self.policy.accept_split_numbered_heading:
            found = self._joined(content)
            if found:
                first_line, at, before, _ = self.number
        self.number = None
        if not found:
            waits = SPLIT_NUMBER.match(content) if self.policy.accept_split_numbered_heading else None
            if waits:
                self.number = (line_no, start, physical, waits["number"])
                return
            found = detect_heading(content, self.policy)
        if self.untitled is not None and content.strip():
            if not found:
                self._title(content.strip(), start + len(content) - len(content.lstrip()), line_no)
            self.untitled = None
        if found:
            self._add(found, at, start, first_line, line_no, before, physical)

    def _joined(self, content: str) -> Heading | None:
        """P-12: a unit word that completes the number of the line before."""
        text = content.lstrip()
        m = SPLIT_UNIT.match(text)
        if not m:
            return None
        marker_end = len(content) - len(text) + m.start("rest")
        title, end, body, split = title_and_body(m["rest"], marker_end, self.policy.inline_title_max_characters)
        number = self.number[3]
        known = ordinal(number)
        return Heading("SPLIT_NUMBERED_HEADING", *UNIT_WORDS[m["unit"]], known, number, title, "", 0, marker_end, end, body, "medium", known is not None, ("heading_spans_two_lines", *split))

    def _title(self, text: str, start: int, line_no: int) -> None:
        """P-14: the first line that isn't blank after a heading without title may be its title."""
        if len(text) <= self.policy.inline_title_max_characters and not set(text) & set(SENTENCE_MARKS):
            self.rows[self.untitled][-3:] = [text, start, line_no]

    def _add(self, h: Heading, at: int, start: int, first_line: int, line_no: int, before: str, physical: str) -> None:
        split = h.rule_id == "SPLIT_NUMBERED_HEADING"
        raw = before + physical[: h.heading_end] if split else h.raw
        own = at if split else start + h.marker_start
        places = (at, own, start + h.heading_end, start + h.body_start, first_line, line_no)
        self.rows.append([h.rule_id, h.unit_type, h.level, h.ordinal, h.ordinal_text, h.title, raw, *places, h.confidence, h.accepted, list(h.signals), None, None, None])
        if h.accepted and not h.title and h.body_start == h.heading_end:
            self.untitled = len(self.rows) - 1


def heading_candidates(lines: DataFrame, policy: StructurePolicy = StructurePolicy()) -> DataFrame:
    """P-07 to P-14: the headings of each source's lines. Only lines that may matter, and the one after them that is not
    blank, go through the sequential scan; a source's share of these is one task's work."""
    maybe = F.col("content").rlike(MAYBE)
    solid = F.col("content").rlike("(?U)\\S")
    df = lines.withColumn("maybe", maybe).withColumn("after", F.lag(F.when(solid, F.col("maybe")), 1).over(in_order()))
    last = F.last(F.when(solid, F.col("maybe")), ignorenulls=True).over(in_order().rowsBetween(FIRST, -1))
    df = df.withColumn("near", F.coalesce(last, F.lit(False))).where("maybe or near").select("source_id", "line_no", "start_char", "physical", "content")
    names = [c.split()[0] for c in HEADINGS.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, scan, previous = None, _Scan(policy), 0
        for frame in frames:
            done = []
            for r in frame.itertuples():
                if r.source_id != source:
                    done += [[source, *row] for row in scan.rows]
                    source, scan = r.source_id, _Scan(policy)
                elif r.line_no != previous + 1:
                    scan.number = None  # lines in between were no unit word
                previous = r.line_no
                scan.line(r.line_no, r.start_char, r.physical, r.content)
            yield shaped(done)
        yield shaped([[source, *row] for row in scan.rows])

    def shaped(rows: list[list]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("ordinal", "detached_start", "detached_line")})

    found = df.repartition("source_id").sortWithinPartitions("source_id", "line_no").mapInPandas(each, HEADINGS)
    return found.withColumn("heading_id", stable_id("hdg_", *(F.col(c) for c in ("source_id", "rule_id", "start_char", "end_char", "raw")), length=32))


def boundaries(headings: DataFrame, policy: StructurePolicy = StructurePolicy()) -> tuple[DataFrame, DataFrame]:
    """Accepted headings that begin units, one a place and at most ``max_units`` a source, and UNIT_LIMIT_REACHED for the
    sources that have more."""
    marks = headings.where("accepted").withColumn("twin", F.row_number().over(Window.partitionBy("source_id", "boundary_start").orderBy("heading_id"))).where("twin = 1")
    return within(marks.drop("twin"), policy.max_units, ("boundary_start",), "structure", "UNIT_LIMIT_REACHED")


def units(headings: DataFrame, sources: DataFrame, lines: DataFrame, policy: StructurePolicy = StructurePolicy()) -> DataFrame:
    """W-06, W-08: contiguous units: from each accepted heading to the next, what stands before the first, or the whole
    text. A unit's parent is the nearest unit before it of a lower level."""
    marks, _ = boundaries(headings, policy)
    size = sources.select("source_id", F.length("text").cast("long").alias("size")).where("size > 0")
    count = lines.groupBy("source_id").agg(F.max("line_no").cast("long").alias("n_lines"))
    first = marks.groupBy("source_id").agg(F.min("boundary_start").alias("first"), F.min_by("start_line", "boundary_start").alias("first_line"))
    text = size.join(count, "source_id").join(first, "source_id", "left")
    head = text.where("first is null or first > 0").select(
        "source_id",
        F.when(F.col("first").isNull(), "document").otherwise("front_matter").alias("unit_type"),
        F.lit(0).alias("level"),
        F.lit(None).cast("long").alias("ordinal"),
        F.lit("").alias("ordinal_text"),
        F.lit("").alias("title"),
        F.lit(None).cast("string").alias("heading_id"),
        F.lit(0).cast("long").alias("start_char"),
        F.lit(1).cast("long").alias("start_line"),
        F.lit(0).cast("long").alias("body_start"),
        F.lit("high").alias("confidence"),
        F.array().cast("array<string>").alias("signals"),
    )
    names = head.columns
    rows = marks.withColumn("start_char", F.col("boundary_start")).select(*names).unionByName(head)
    rows = rows.join(text.select("source_id", "size", "n_lines"), "source_id")
    order = in_order("start_char")
    rows = rows.withColumns(
        {
            "end_char": F.coalesce(F.lead("start_char").over(order), "size"),
            "end_line": F.greatest(F.col("start_line"), F.coalesce(F.lead("start_line").over(order) - 1, "n_lines")),
            "position": F.row_number().over(order),
        }
    )
    rows = rows.join(sources, "source_id").withColumn("content", part_of(F.col("text"), F.col("start_char"), F.col("end_char")))
    rows = rows.withColumns({"content_sha256": sha(F.col("content")), "character_count": F.col("end_char") - F.col("start_char")})
    rows = rows.withColumn("unit_id", stable_id("unit_", *(F.col(c) for c in ("source_id", "unit_type", "start_char", "end_char", "content_sha256")), length=32))
    body = part_of(F.col("text"), F.col("body_start"), F.col("end_char"))
    rows = rows.withColumns(
        {
            "body_end": F.col("end_char"),
            "has_body": F.coalesce(body.rlike("(?U)\\S"), F.lit(False)),
            "parent_unit_id": parent(F.col("level"), F.col("unit_id"), F.col("position"), in_order("start_char")),
            "confidence": F.when(F.col("confidence") == "high", "high").otherwise("medium"),
        }
    )
    rows = rows.withColumn("review_status", F.when(F.col("confidence") == "high", "accepted_candidate").otherwise("review"))
    return rows.drop("text", "content", "size", "n_lines")


def parent(level: Column, name: Column, position: Column, window, deepest: int = 4) -> Column:
    """W-08: the name of the nearest row before with a level above 0 and below this one's; null without. A deeper row
    forgets all that is deeper than itself, and what it leaves is exactly this."""
    before = window.rowsBetween(FIRST, -1)
    last = {k: F.last(F.when(level == k, F.struct(position.alias("position"), name.alias("name"))), ignorenulls=True).over(before) for k in range(1, deepest)}
    choice = reduce(lambda acc, k: acc.when(level == k, F.array_max(F.filter(F.array(*(last[j] for j in range(1, k))), lambda x: x.isNotNull()))), range(3, deepest + 1), F.when(level == 2, last[1]))
    return choice["name"]


def coverage(spans: DataFrame) -> DataFrame:
    """G-07: of units (source_id, start_char, end_char, size): covered characters, gaps and overlaps of each source."""
    reach = F.max("end_char").over(in_order("start_char", "end_char").rowsBetween(FIRST, -1))
    df = spans.withColumn("reach", F.coalesce(reach, F.lit(0)))
    df = df.withColumn("new", F.greatest(F.lit(0), F.col("end_char") - F.greatest("start_char", "reach")))
    return df.groupBy("source_id").agg(
        F.sum("new").alias("covered"),
        (F.count_if(F.col("start_char") > F.col("reach")) + F.when(F.max("end_char") != F.max("size"), 1).otherwise(0)).alias("gap_count"),
        F.count_if(F.col("start_char") < F.col("reach")).alias("overlap_count"),
    )


def ordinal_continuity(numbered: DataFrame, keys: list[str], order: list[str], ordinal_column: str = "ordinal") -> DataFrame:
    """W-09: numbered rows with ``previous`` (of the numbered row before), ``first`` (whether the number is new in its
    group), and ``issue``: ORDINAL_INVERSION_CANDIDATE, ORDINAL_GAP_CANDIDATE or null."""
    rows = numbered.where(F.col(ordinal_column).isNotNull())
    group = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumns(
        {
            "previous": F.lag(ordinal_column).over(group),
            "first": F.row_number().over(Window.partitionBy(*keys, ordinal_column).orderBy(*order)) == 1,
        }
    )
    issue = F.when(F.col(ordinal_column) < F.col("previous"), "ORDINAL_INVERSION_CANDIDATE")
    return rows.withColumn("issue", issue.when(F.col(ordinal_column) > F.col("previous") + 1, "ORDINAL_GAP_CANDIDATE"))


def first_bearers(rows: DataFrame, keys: list[str], order: list[str], name: str, alias: str) -> DataFrame:
    """W-10: rows whose keys another row had before, with the name of the first."""
    first = F.first(name).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(alias, first).where(F.col(alias) != F.col(name))


def continuity_findings(units_: DataFrame, headings: DataFrame, policy: StructurePolicy = StructurePolicy()) -> DataFrame:
    """W-09 to W-11 and the heading findings: source_id, rule_id, category, severity, confidence, unit_id,
    related_unit_ids, start_char, end_char, start_line, end_line, signals, finding_id."""
    container = F.get(F.transform(F.filter("signals", lambda s: s.startswith("container_ordinal=")), lambda s: F.substring_index(s, "=", -1)), 0)
    rows = units_.withColumn("container", F.coalesce(container, F.lit(""))).withColumn("group", F.struct("parent_unit_id", "unit_type", "container"))
    span = ("source_id", "unit_id", "start_char", "end_char", "start_line", "end_line")
    none = F.array().cast("array<string>")
    word = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))

    def told(df: DataFrame, rule, category: str, severity: str, confidence: str, related: Column, *signals: Column) -> DataFrame:
        about = {"rule_id": rule, "category": F.lit(category), "severity": F.lit(severity), "confidence": F.lit(confidence), "related_unit_ids": related, "signals": F.array_compact(F.array(*signals))}
        return df.select(*span, *((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in about.items()))

    order = Window.partitionBy("source_id", "group").orderBy("start_char")
    numbered = rows.where("ordinal is not null")
    numbered = numbered.withColumns({"previous": F.lag("ordinal").over(order), "previous_unit": F.lag("unit_id").over(order), "first_unit": F.first("unit_id").over(Window.partitionBy("source_id", "group", "ordinal").orderBy("start_char"))})
    inside = F.when(F.col("container") != "", word("container_ordinal", "container"))
    twice = told(numbered.where("first_unit != unit_id"), "DUPLICATE_ORDINAL_CANDIDATE", "continuity_anomaly", "high", "high", F.array("first_unit"), word("unit_type", "unit_type"), word("ordinal", "ordinal"), inside)
    back = told(numbered.where("ordinal < previous"), "ORDINAL_INVERSION_CANDIDATE", "continuity_anomaly", "high", "high", F.array("previous_unit"), word("previous", "previous"), word("current", "ordinal"), word("unit_type", "unit_type"), inside)
    missing = (F.concat(F.lit("missing_start="), F.col("previous") + 1), F.concat(F.lit("missing_end="), F.col("ordinal") - 1))
    gap = told(numbered.where("ordinal > previous + 1"), "ORDINAL_GAP_CANDIDATE", "continuity_anomaly", "medium", "high", F.array("previous_unit"), word("previous", "previous"), word("current", "ordinal"), *missing, inside)
    titled = rows.withColumn("normal", collapse(F.lower("title"))).where("normal != ''")
    titled = first_bearers(titled, ["source_id", "group", "normal"], ["start_char"], "unit_id", "first_unit")
    same = told(titled, "DUPLICATE_TITLE_CANDIDATE", "structure_anomaly", "low", "medium", F.array("first_unit"), word("title", "normal"))
    whole = in_order("start_char")
    placed = rows.withColumn("chapters_before", F.count_if(F.col("unit_type") == "chapter").over(whole.rowsBetween(FIRST, -1)))
    late = told(placed.where("unit_type in ('prologue', 'preface') and chapters_before > 0"), "LATE_FRONT_MATTER_CANDIDATE", "structure_anomaly", "low", "medium", none, word("unit_type", "unit_type"))
    chapter = F.when(F.col("unit_type") == "chapter", F.struct(*span[1:]))
    after = rows.withColumn("next", F.first(chapter, ignorenulls=True).over(whole.rowsBetween(1, LAST))).where("unit_type = 'epilogue' and next is not null")
    after = after.select("source_id", F.col("unit_id").alias("epilogue"), "next.*")
    late_chapter = told(after, "CHAPTER_AFTER_EPILOGUE_CANDIDATE", "structure_anomaly", "medium", "medium", F.array("epilogue"), F.lit("chapter_occurs_after_epilogue"))
    empty = rows.where("unit_type in ('chapter', 'section', 'prologue', 'epilogue', 'extra_story') and not has_body")
    empty = told(empty, "EMPTY_UNIT_BODY_CANDIDATE", "structure_anomaly", "medium", "high", none, word("unit_type", "unit_type"))
    seen = headings.withColumn("unit_id", F.lit(None).cast("string"))
    doubt = seen.where("not accepted")
    doubt = told(doubt, "AMBIGUOUS_HEADING_CANDIDATE", "heading_candidate", "low", "low", none, word("heading_id", "heading_id"), word("rule_id", "rule_id"))
    loose = seen.where("detached is not null").withColumns({"start_char": F.col("detached_start"), "end_char": F.col("detached_start") + F.length("detached"), "start_line": F.col("detached_line"), "end_line": F.col("detached_line")})
    loose = told(loose, "DETACHED_TITLE_CANDIDATE", "heading_recovery", "low", "medium", none, word("heading_id", "heading_id"), word("candidate_text", "detached"))
    parts = [twice, back, gap, same, late, late_chapter, doubt, loose] + ([empty] if policy.emit_empty_body_candidates else [])
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("finding_id", stable_id("stf_", *(F.col(c) for c in ("source_id", "rule_id", "start_char", "end_char")), F.array_join("signals", "\u0001"), length=32))


def inspect_structure(sources: DataFrame, policy: StructurePolicy = StructurePolicy()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headings, units and findings of ``sources`` (source_id, text). Headings and units are written once: findings look at
    them rule by rule, and would have the texts scanned again for each."""
    lines = physical_lines(sources)
    headings = cut(heading_candidates(lines, policy), "headings")
    rows = cut(units(headings, sources, lines, policy), "units")
    return headings, rows, continuity_findings(rows, headings, policy)


def unit_texts(units_: DataFrame, sources: DataFrame) -> DataFrame:
    """S-13: units with their text, each checked against its hash; one that differs raises."""
    rows = units_.join(sources, "source_id").withColumn("unit_text", part_of(F.col("text"), F.col("start_char"), F.col("end_char"))).drop("text")
    broken = F.raise_error(F.concat(F.lit("content hash mismatch: "), "unit_id"))
    return rows.withColumn("unit_text", F.when(sha(F.col("unit_text")) == F.col("content_sha256"), F.col("unit_text")).otherwise(broken))


def structure_report(units_: DataFrame, findings: DataFrame) -> DataFrame:
    """G-02: source_id, kind (unit or finding), name (unit type or rule), n."""
    each = units_.select("source_id", F.lit("unit").alias("kind"), F.col("unit_type").alias("name"))
    each = each.unionByName(findings.select("source_id", F.lit("finding").alias("kind"), F.col("rule_id").alias("name")))
    return each.groupBy("source_id", "kind", "name").agg(F.count("*").alias("n"))
