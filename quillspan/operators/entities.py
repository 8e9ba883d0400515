"""Mentions, entities, facts, timeline, conflicts and ambiguity (J-08 to J-14, G-16 to G-21, W-14, W-15)."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillspan.functions.text import folded, nfkc, sha, stable_id
from quillspan.sources.scratch import cut, passing

from .claims import any_of, literal, literal_spans
from .connected import connected
from .lines import FIRST, LAST

# The wording of time, date scopes and identity.
EARLIER = "(?i)原先|原本|最初|起初|此前|之前|曾经|昔日|当初|formerly|initially|previously"
LATER = "(?i)后来|随后|之后|此后|最终|如今|现在|现已|改为|变为|later|afterwards|now|eventually"
DATE_SCOPES = {
    "birth_date": "(?i)出生于|(?<!发)生于|born on|date of birth",
    "death_date": "(?i)卒于|死于|逝世于|died on|date of death",
    "start_date": "(?i)始于|开始于|启用于|started on|began on",
    "end_date": "(?i)终于|结束于|截至|ended on|until",
    "event_date": "(?i)发生于|举行于|occurred on|happened on",
}
BREAKS = "[\\n。！？!?；;]+"
IDENTITY_MODAL = re.compile(
    r"据说|传闻|听说|或许|可能|似乎|也许|假如|如果|倘若|若是|声称|宣称|谎称|预计|将要|即将|[？?]|\breportedly\b|\ballegedly\b|\bperhaps\b|\bmaybe\b|\bif\b|\bclaimed\b|\bwill\b", re.I
)
IDENTITY_GAP, IDENTITY_JOIN = r"[^\n。！？!?；;，,:：]{0,32}?", r"(?:与|和|跟|及|、|\band\b)"
SAME_MIDDLE = ("正是", "就是", "即为", "其实是", "本名是", "本名为", "真名是", "真名为", "is the same person as", "is the same entity as")
SAME_TAIL = ("是同一人", "为同一人", "是同一个人", "是同一实体", "same person", "same entity")
DIFFERENT_TAIL = (
    "同名不同人", "并非同一人", "不是同一人", "不是同一个人", "并非同一实体", "不是同一实体",
    "different people", "different persons", "different entities", "not the same person", "not the same entity",
)
WHOLE = (FIRST, LAST)


@F.arrow_udf(ArrayType(IntegerType()))
def surface_span(evidence: pa.Array, surface: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """O-10: the occurrence of a surface that is nearest to the first matched span (given by starts and ends), of those that
    touch a matched one."""

    def place(text: str, name: str, heads: list[int], tails: list[int]) -> tuple[int, int] | None:
        found = literal_spans(text, name) if name else []
        if len(found) > 1:
            touching = [s for s in found if any(s[0] < b and a < s[1] for a, b in zip(heads, tails, strict=True))]
            anchor = heads[0] if heads else 0
            return min(touching or found, key=lambda s: (abs(s[0] - anchor), s))
        return found[0] if found else None

    return pa.array(map(place, *(x.to_pylist() for x in (evidence, surface, starts, ends))), pa.list_(pa.int32()))


def mentions(accepted: DataFrame) -> DataFrame:
    """J-08: the names in accepted claims (result_id, claim_type, subject, object, evidence, matched_spans, ...): the
    subject, and the object of relations. Types follow from the role."""
    kind = F.col("claim_type")
    typed = F.when(kind == "defeats", "actor").when((kind == "located_in") & (F.col("role") == "object"), "place")
    typed = typed.when((kind == "permission") & (F.col("role") == "subject"), "actor").when(kind == "located_in", "entity")
    roles = F.array(F.struct(F.lit("subject").alias("role"), F.col("subject").alias("surface")), F.when(kind.isin("alias", "defeats", "located_in"), F.struct(F.lit("object").alias("role"), F.col("object").alias("surface"))))
    rows = accepted.withColumn("r", F.explode(F.array_compact(roles))).where("r.surface != ''")
    rows = rows.withColumns({"role": F.col("r.role"), "surface": F.trim("r.surface")})
    matched = (F.coalesce(F.col(f"matched_spans.{x}"), F.array().cast("array<int>")) for x in ("start", "end"))
    # a list of none or one: a test for null would be moved before the function, and call it a second time
    rows = rows.withColumn("place", F.explode(F.array_compact(F.array(surface_span(F.col("evidence"), F.col("surface"), *matched)))))
    rows = rows.withColumns(
        {
            "start_char": F.col("evidence_start") + F.col("place")[0],
            "end_char": F.col("evidence_start") + F.col("place")[1],
            "normalized_surface": folded(F.col("surface")),
            "inferred_type": F.coalesce(typed, F.when(F.col("role") == "subject", "entity").otherwise("unknown")),
        }
    )
    ids = ("result_id", "role", "normalized_surface", "source_id", "unit_id", "start_char", "end_char")
    return rows.select(stable_id("men_", *(F.col(c) for c in ids)).alias("mention_id"), *ids, "surface", "inferred_type")


def identity_edges(found: DataFrame, accepted: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """J-12, J-14: edges in the order of merging: equal surfaces of a unit to its first, alias claims, then links. Kind:
    0 to 2, or 3 for ``different_from``."""
    order = Window.partitionBy("source_id", "unit_id", "normalized_surface").orderBy("start_char", "role", "mention_id")
    who = F.struct("mention_id", "inferred_type")
    local = found.withColumn("first", F.first(who).over(order)).where("first.mention_id != mention_id")
    local = local.select("source_id", F.lit(0).alias("kind"), F.col("start_char").alias("rank"), F.col("first").alias("x"), who.alias("y"), F.lit("").alias("claim"))
    # both names of an alias claim stand in one group, so mentions are moved once
    side = lambda role: F.max(F.when(F.col("role") == role, who))
    sides = found.groupBy("result_id").agg(side("subject").alias("x"), side("object").alias("y")).where("x is not null and y is not null")
    alias = accepted.where("claim_type = 'alias'").select("source_id", "result_id", F.col("evidence_start").alias("rank"))
    alias = alias.join(sides, "result_id").select("source_id", F.lit(1).alias("kind"), "rank", "x", "y", F.col("result_id").alias("claim"))
    both = (f"{x}.{c} as {n}" for x, s in (("x", "a"), ("y", "b")) for c, n in (("mention_id", s), ("inferred_type", f"{s}_type")))
    edges = local.unionByName(alias).selectExpr("source_id", "kind", "rank", "claim", *both)
    if links is not None:
        kind = F.when(F.col("relation") == "different_from", 3).otherwise(2)
        edges = edges.unionByName(_typed(links.select("source_id", kind.alias("kind"), F.col("position").cast("long").alias("rank"), "a", "b", F.lit("").alias("claim")), found))
    return edges


def _typed(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges with the types of both mentions; those between other mentions are left out."""
    typed = found.select("source_id", "mention_id", "inferred_type")
    for side in ("a", "b"):
        edges = edges.join(typed.select("source_id", F.col("mention_id").alias(side), F.col("inferred_type").alias(f"{side}_type")), ["source_id", side])
    return edges


SETTLED = "source_id string, mention_id string, component string, merge_basis array<string>, blocked struct<conflict_type:string,severity:string,left_mention:string,right_mention:string,claim_result_id:string,relation:string>"
#: Edges of a source up to which it is settled whole.
SOURCE_EDGES = 200_000
BASIS = ("same_surface_same_unit", "accepted_alias_claim", "evidence_bound_same_as")


def settle(types: dict[str, str], edges: list[tuple[int, str, str, str]]) -> tuple[dict[str, tuple[str, set[str]]], list[tuple]]:
    """J-13 for one source: from mentions with their types and edges (kind, a, b, claim) in order, each mention's component
    (its smallest mention) with the bases of its merges, and the edges that were refused.

    A component is a tree of links up to its root, which holds what is known of it: the concrete type, the roots that it
    must stay apart from, the bases. Foes are moved along when roots merge, so an edge costs no look at members."""
    root = {m: m for m in types}
    concrete = {m: None if t in ("entity", "unknown") else t for m, t in types.items()}
    foes: dict[str, set[str]] = defaultdict(set)
    bases: dict[str, set[str]] = defaultdict(set)

    def top(m: str) -> str:
        while root[m] != m:
            root[m] = m = root[root[m]]
        return m

    for kind, a, b, _ in edges:
        if kind == 3:
            foes[a].add(b)
            foes[b].add(a)
    refused = []
    for kind, a, b, claim in edges:
        low, high = sorted((top(a), top(b)))
        kinds = {concrete[low], concrete[high]} - {None}
        if kind == 3:
            why = "IDENTITY_CONSTRAINT_CONTRADICTION" if low == high else None
        else:
            why = None if low == high else "ENTITY_TYPE_CONFLICT" if len(kinds) > 1 else "EXPLICIT_DIFFERENT_FROM_CONSTRAINT" if high in foes[low] else None
        if why:
            refused.append((why, "review" if kind == 0 else "blocker", a, b, claim or None, {2: "same_as", 3: "different_from"}.get(kind)))
        elif kind != 3:
            if low != high:
                root[high], concrete[low] = low, next(iter(kinds), None)
                for other in foes.pop(high, ()):
                    foes[other].discard(high)
                    foes[other].add(low)
                    foes[low].add(other)
                bases[low] |= bases.pop(high, set())
            bases[low].add(BASIS[kind])
    return {m: (top(m), bases[top(m)]) for m in types}, refused


def components(found: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-13: each mention's component, and the merges that were blocked. All edges lie within a source, and what is blocked
    depends on their order.

    Sources stream through tasks one after the other, each settled when its edges are together. A source of more than
    SOURCE_EDGES is first cut into the components that it would have without constraints, as merges in one have no
    bearing on another. Of these, those whose mentions have one concrete type at most and no ``different_from`` among them
    can't conflict: they are merged as they are, without being brought together; the others are settled one by one.
    Mentions that no edge names stay out of all this. It is solved once and written: both results are read from it."""
    edges = edges.where("a != b")
    edges = edges if "a_type" in edges.columns else _typed(edges, found)
    edges = cut(edges.select("source_id", "kind", F.col("rank").cast("long").alias("rank"), "a", "b", "claim", "a_type", "b_type"), "identity-edges")
    large = cut(edges.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") > SOURCE_EDGES).select("source_id"), "large-sources")
    if large.isEmpty():
        done = cut(_settled(edges.withColumn("home", F.lit(""))), "identity")
    else:
        parts, easy = _cut_up(edges.join(large, "source_id", "left_semi"))
        small = edges.join(large, "source_id", "left_anti").withColumn("home", F.lit(""))
        done = cut(_settled(small.unionByName(parts)).unionByName(easy), "identity")
    own = done.where("mention_id is not null").select("source_id", "mention_id", F.col("component").alias("c"), F.col("merge_basis").alias("basis"))
    none = F.array().cast("array<string>")
    merged = found.select("source_id", "mention_id").join(own, ["source_id", "mention_id"], "left")
    merged = merged.select("source_id", "mention_id", F.coalesce("c", "mention_id").alias("component"), F.coalesce("basis", none).alias("merge_basis"))
    return merged, done.where("blocked is not null").select("source_id", "blocked.*")


def _cut_up(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of large sources, each with the home of its unconstrained component, where it can conflict; and what
    becomes of the mentions of all other components."""
    homes = cut(connected(edges.where("kind != 3").select("source_id", "a", "b")), "homes")
    for side in ("a", "b"):
        edges = edges.join(homes.toDF("source_id", side, f"{side}_home"), ["source_id", side], "left")
    # mentions that no merge could bring together need not be kept apart
    edges = cut(edges.where("a_home = b_home").withColumnRenamed("a_home", "home").drop("b_home"), "bound-edges")
    concrete = [F.when(~F.col(f"{s}_type").isin("entity", "unknown"), F.col(f"{s}_type")) for s in ("a", "b")]
    lowest, highest = F.min(F.least(*concrete)), F.max(F.greatest(*concrete))
    bases = F.sort_array(F.collect_set(F.when(F.col("kind") < 3, F.element_at(F.array(*map(F.lit, BASIS)), F.col("kind") + 1))))
    judged = edges.groupBy("source_id", "home").agg((F.coalesce(lowest != highest, F.lit(False)) | F.max(F.col("kind") == 3)).alias("hard"), bases.alias("merge_basis"))
    judged = cut(judged, "judged-components")
    hard = edges.join(judged.where("hard").select("source_id", "home"), ["source_id", "home"])
    blocked = SETTLED.split(", blocked ")[1]
    easy = homes.join(judged.where("not hard"), ["source_id", "home"]).select("source_id", F.col("node").alias("mention_id"), F.col("home").alias("component"), "merge_basis", F.lit(None).cast(blocked).alias("blocked"))
    return hard, easy


def _settled(edges: DataFrame) -> DataFrame:
    """SETTLED of edges, one group of (source_id, home) after the other in each task."""
    names = [x.split(":")[0] for x in SETTLED.split("struct<")[1][:-1].split(",")]

    def rows_of(source: str, group: list[tuple]) -> list[tuple]:
        homes, refused = settle({m: t for r in group for m, t in ((r[2], r[5]), (r[3], r[6]))}, [(r[0], r[2], r[3], r[4]) for r in group])
        rows = [(source, m, home, sorted(basis), None) for m, (home, basis) in homes.items()]
        return rows + [(source, None, None, None, dict(zip(names, r, strict=True))) for r in refused]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, []

        def shaped(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["source_id", "mention_id", "component", "merge_basis", "blocked"])

        for frame in frames:
            done = []
            for source, home, *row in frame.itertuples(index=False, name=None):
                if (source, home) != key:
                    done += rows_of(key[0], group) if group else []
                    key, group = (source, home), []
                group.append(tuple(row))
            yield shaped(done)
        yield shaped(rows_of(key[0], group) if group else [])

    order = ("source_id", "home", "kind", "rank", "a", "b")
    edges = edges.select(*order[:2], "kind", "rank", "a", "b", "claim", "a_type", "b_type")
    # a shuffle by the keys of the join before it would be left out, whatever that join becomes at run time
    return edges.repartition(F.xxhash64("source_id", "home")).sortWithinPartitions(*order).mapInPandas(each, SETTLED)


def placed(found: DataFrame, merged: DataFrame) -> DataFrame:
    """Mentions with their component and its basis; those that have these stay."""
    return found if "component" in found.columns else found.join(merged, ["source_id", "mention_id"])


def entities(found: DataFrame, merged: DataFrame) -> DataFrame:
    """G-16, G-17: one row a component: canonical name (the commonest, then the earliest, then by name), aliases, type,
    mentions, units, basis. Mentions are moved once: names are counted where their component is."""
    key = ["source_id", "component"]
    sets = {"mention_ids": "mention_id", "unit_ids": "unit_id", "types": "inferred_type"}
    names = placed(found, merged).repartition(*map(F.col, key)).groupBy(*key, "surface")
    names = names.agg(F.count("*").alias("n"), F.min("start_char").alias("at"), *(F.collect_set(c).alias(k) for k, c in sets.items()), F.first("merge_basis").alias("basis"))
    every = {k: F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))) for k in sets} | {"aliases": F.array_sort(F.collect_list("surface"))}
    best = F.min_by("surface", F.struct(-F.col("n"), F.col("at"), F.col("surface")))
    out = names.groupBy(*key).agg(*(v.alias(k) for k, v in every.items()), F.first("basis").alias("merge_basis"), best.alias("canonical_name"))
    out = out.withColumn("concrete", F.array_except("types", F.array(F.lit("entity"), F.lit("unknown"))))
    kind = F.when(F.size("concrete") == 1, F.get("concrete", 0)).when(F.size("concrete") == 0, "entity").otherwise("mixed")
    out = out.withColumn("entity_type", kind)
    ids = (F.array_join("mention_ids", ","), F.col("canonical_name"), F.array_join("aliases", ","), F.col("entity_type"))
    out = out.withColumns({"entity_id": stable_id("ent_", *ids), "source_ids": F.array("source_id")})
    return out.select(*key, "aliases", "mention_ids", "unit_ids", "merge_basis", "canonical_name", "entity_type", "entity_id", "source_ids")


def assertion_context(evidence: Column, spans: Column) -> Column:
    """F-25: the part of the evidence, between clause breaks, around the first match; all of it without a match."""
    start, end = spans[0]["start"], spans[0]["end"]
    head, tail = F.substring(evidence, F.lit(1), start), F.substring(evidence, end + 1, F.length(evidence))
    middle = F.substring(evidence, start + 1, end - start)
    around = F.concat(F.regexp_extract(head, "([^\\n。！？!?；;]*)$", 1), middle, F.regexp_extract(tail, "^([^\\n。！？!?；;]*)", 1))
    return F.when(F.size(spans) > 0, around).otherwise(evidence)


def temporal_marker(context: Column) -> Column:
    """F-24."""
    early, late = context.rlike(EARLIER), context.rlike(LATER)
    return F.when(early & late, "mixed").when(early, "earlier").when(late, "later").otherwise("unspecified")


def predicate_scope(context: Column) -> Column:
    """F-22."""
    dates = reduce(lambda acc, kv: acc.when(context.rlike(kv[1]), kv[0]), list(DATE_SCOPES.items())[1:], F.when(context.rlike(DATE_SCOPES["birth_date"]), "birth_date")).otherwise("generic_date")
    kind = F.col("claim_type")
    unit = F.when(F.col("unit") == "", "unspecified").otherwise(F.col("unit"))
    out = F.when(kind == "date", dates).when(kind == "count", F.concat(F.lit("count:"), folded(unit))).when(kind == "permission", F.concat(F.lit("permission:"), folded(F.col("object"))))
    return out.when(kind == "located_in", "location").when(kind == "alias", "identity").otherwise(kind)


def facts(accepted: DataFrame, found: DataFrame, merged: DataFrame, named: DataFrame) -> DataFrame:
    """J-08, J-09: one fact an accepted claim, with entities, scope and temporal marker."""
    who = placed(found, merged).select("source_id", "component", "result_id", "role").join(named.select("source_id", "component", "entity_id"), ["source_id", "component"])
    sides = who.groupBy("result_id").agg(*(F.max(F.when(F.col("role") == r, F.col("entity_id"))).alias(f"{r}_entity_id") for r in ("subject", "object")))
    df = accepted.withColumn("context", assertion_context(F.col("evidence"), F.col("matched_spans"))).join(sides, "result_id", "left")
    df = df.withColumns({"predicate_scope": predicate_scope(F.col("context")), "temporal_marker": temporal_marker(F.col("context")), "evidence_sha256": sha(F.col("evidence"))})
    df = df.withColumns({c: nfkc(F.col(c)) for c in ("subject", "object", "unit")}).withColumn("value", F.col("normalized_value"))
    df = df.withColumn("fact_id", stable_id("fac_", F.col("result_id"), F.col("predicate_scope"), F.col("claim_fingerprint")))
    names = ("fact_id", "result_id", "claim_type", "predicate_scope", "subject_entity_id", "subject", "object_entity_id", "object", "value", "unit", "polarity", "source_id", "unit_id")
    return df.select(*names, "evidence_start", "evidence_end", "evidence_sha256", F.col("evidence").alias("evidence_text"), "temporal_marker")


def temporal_transitions(rows: DataFrame, keys: list[str], state: str | Column, order: list[str], marker: str = "temporal_marker") -> DataFrame:
    """W-14: per group: how many states, and whether each change between neighbours is supported: by ``later`` on the new
    row or ``earlier`` on the old one, with no ``mixed`` anywhere and one change at least."""
    df = _with_changes(rows.withColumn("state", state if isinstance(state, Column) else F.col(state)), keys, order, marker)
    return df.groupBy(*keys).agg(F.countDistinct("state").alias("states"), _supported(marker).alias("supported"))


def _with_changes(rows: DataFrame, keys: list[str], order: list[str], marker: str) -> DataFrame:
    """Rows with a state, and whether it is another than that of the row before, without support (``changed``, ``bad``)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    df = rows.withColumns({"old_state": F.lag("state").over(window), "old_marker": F.lag(marker).over(window)})
    changed = F.col("old_state").isNotNull() & (F.col("state") != F.col("old_state"))
    bad = changed & ~((F.col(marker) == "later") | F.coalesce(F.col("old_marker") == "earlier", F.lit(False)))
    return df.withColumns({"changed": changed, "bad": bad})


def _supported(marker: str) -> Column:
    return F.max("changed") & ~F.max("bad") & ~F.max(F.col(marker) == "mixed")


CONFLICTS: dict[str, tuple[list[str], str, str]] = {
    # claim type: grouping columns, resolved and unresolved conflict type
    "permission": (["subject_key", "object_form"], "PERMISSION_POLARITY_TRANSITION", "PERMISSION_POLARITY_CONFLICT"),
    "count": (["subject_key", "unit_form"], "COUNT_TEMPORAL_TRANSITION", "MULTIPLE_COUNT_VALUES"),
    "located_in": (["subject_key"], "LOCATION_TEMPORAL_TRANSITION", "MULTIPLE_LOCATIONS"),
    "date": (["subject_key", "predicate_scope"], "DATE_PRECISION_REFINEMENT", "MULTIPLE_DATE_VALUES"),
    "defeats": (["pair"], "RECIPROCAL_DEFEATS_ACROSS_TIME", "RECIPROCAL_DEFEATS_UNRESOLVED"),
}


def keyed(rows: DataFrame) -> DataFrame:
    """Facts with the keys that conflicts are grouped by: an entity where there is one, else the name."""
    key = lambda side: F.coalesce(f"{side}_entity_id", F.concat(F.lit("surface:"), folded(F.col(side))))
    rows = rows.withColumns({"subject_key": key("subject"), "object_key": key("object"), "object_form": folded(F.col("object")), "unit_form": folded(F.col("unit"))})
    return rows.withColumn("pair", F.array_join(F.array_sort(F.array("subject_key", "object_key")), "|"))


def precision_compatible(values: Column) -> Column:
    """F-26: every value is the shortest one or goes on from it."""
    shortest = F.array_min(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"]
    return F.forall(values, lambda v: (v == shortest) | v.startswith(F.concat(shortest, F.lit("-"))))


def conflicts(rows: DataFrame) -> DataFrame:
    """G-18: groups of facts that say different things: conflict_id, conflict_type, severity, status, source_id, group,
    fact_ids, entity_ids, values."""
    df = keyed(rows)
    states = {"permission": F.col("polarity").cast("string"), "count": F.col("value"), "located_in": F.col("object_key"), "date": F.col("value"), "defeats": F.concat_ws(">", "subject_key", "object_key")}
    # all types at once, each grouped by columns of its own
    kind = F.col("claim_type")
    by_kind = lambda of: reduce(lambda acc, k: acc.when(kind == k, of(k)), list(CONFLICTS)[1:], F.when(kind == next(iter(CONFLICTS)), of(next(iter(CONFLICTS)))))
    df = df.where(kind.isin(*CONFLICTS)).withColumns({"state": by_kind(states.get), "group": by_kind(lambda k: F.concat_ws("|", *CONFLICTS[k][0]))})
    key = ["source_id", "claim_type", "group"]
    df = df.select(*key, "state", "fact_id", "subject_entity_id", "object_entity_id", "temporal_marker", "evidence_start", "evidence_end")
    df = _with_changes(df, key, ["evidence_start", "evidence_end", "fact_id"], "temporal_marker")
    # whether a group has more than one state is known before anything of it is gathered
    group = Window.partitionBy(*key)
    df = df.withColumns({"low": F.min("state").over(group), "high": F.max("state").over(group)}).where("low != high")
    out = df.groupBy(*key).agg(
        F.array_sort(F.collect_set("fact_id")).alias("fact_ids"),
        F.array_sort(F.collect_set("state")).alias("values"),
        F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set(F.array("subject_entity_id", "object_entity_id")))))).alias("entity_ids"),
        _supported("temporal_marker").alias("supported"),
    )
    dated = kind == "date"
    out = out.withColumn("solved", F.when(dated, precision_compatible(F.col("values"))).otherwise(F.col("supported")))
    named = lambda i: by_kind(lambda k: F.lit(CONFLICTS[k][i]))
    told = {
        "conflict_type": F.when(F.col("solved"), named(1)).otherwise(named(2)),
        "severity": F.when(F.col("solved"), "info").otherwise("review"),
        "status": F.when(F.col("solved"), F.when(dated, "resolved_precision").otherwise("resolved_temporal")).otherwise("unresolved"),
    }
    out = out.select("source_id", "group", *(v.alias(k) for k, v in told.items()), "fact_ids", "entity_ids", "values")
    return out.withColumn("conflict_id", stable_id("cnf_", F.col("conflict_type"), F.col("source_id"), F.col("group"), F.array_join("fact_ids", ",")))


STATUS_RANK = {"unresolved": ("contested", 3), "resolved_temporal": ("temporal_variant", 2), "resolved_precision": ("compatible_variant", 1)}


def fact_status(rows: DataFrame, disputes: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """J-10, J-11, G-19: facts with canonical_status (the gravest of their conflicts) and conflict_ids."""
    rank = lambda c, k: reduce(lambda acc, s: acc.when(c == s, STATUS_RANK[s][k]), list(STATUS_RANK)[1:], F.when(c == "unresolved", STATUS_RANK["unresolved"][k]))
    told = disputes.select(F.explode("fact_ids").alias("fact_id"), "conflict_id", "status")
    if blocked is not None:
        own = blocked.where("claim_result_id is not null").select(F.col("claim_result_id").alias("result_id"), stable_id("cnf_", F.col("conflict_type"), F.col("left_mention"), F.col("right_mention")).alias("conflict_id"), F.lit("unresolved").alias("status"))
        told = told.unionByName(rows.select("fact_id", "result_id").join(own, "result_id").drop("result_id"))
    worst = told.groupBy("fact_id").agg(F.max_by("status", rank(F.col("status"), 1)).alias("worst"), F.array_sort(F.collect_set("conflict_id")).alias("conflict_ids"))
    out = rows.join(worst, "fact_id", "left")
    status = F.coalesce(rank(F.col("worst"), 0), F.lit("canonical"))
    return out.withColumns({"canonical_status": status, "conflict_ids": F.coalesce("conflict_ids", F.array().cast("array<string>"))}).drop("worst")


def timeline(rows: DataFrame) -> DataFrame:
    """W-15: facts in the order of their source."""
    order = Window.partitionBy("source_id").orderBy("evidence_start", "fact_id")
    date = F.when(F.col("claim_type") == "date", F.col("value"))
    names = ("fact_id", "source_id", "unit_id", "evidence_start", "evidence_end", "predicate_scope", "temporal_marker", "subject_entity_id", "object_entity_id")
    return rows.select(stable_id("evt_", F.col("fact_id")).alias("event_id"), *names, F.col("claim_type").alias("event_type"), date.alias("normalized_date"), F.row_number().over(order).alias("source_order"))


def ambiguity_groups(found: DataFrame, merged: DataFrame, named: DataFrame) -> DataFrame:
    """G-20: surfaces of a source that stand for several entities."""
    rows = placed(found, merged).join(named.select("source_id", "component", "entity_id"), ["source_id", "component"])
    sets = {"surfaces": "surface", "entity_ids": "entity_id", "mention_ids": "mention_id"}
    out = rows.groupBy("source_id", "normalized_surface").agg(*(F.array_sort(F.collect_set(c)).alias(k) for k, c in sets.items())).where(F.size("entity_ids") > 1)
    return out.withColumns({"ambiguity_id": stable_id("amb_", F.col("source_id"), F.col("normalized_surface"), F.array_join("entity_ids", ",")), "reason": F.lit("SAME_SURFACE_MULTIPLE_ENTITIES")})


def valid_links(links: DataFrame, found: DataFrame, sources: DataFrame, units: DataFrame) -> DataFrame:
    """P-35, J-12: identity links (relation, left_result_id, left_role, right_result_id, right_role, source_id, unit_id,
    evidence_start, evidence_end, evidence_text, position) with mentions a and b and ``problem``: why one can't count."""
    side = lambda name: found.select(F.col("result_id").alias(f"{name}_result_id"), F.col("role").alias(f"{name}_role"), F.col("mention_id").alias(name[0]), F.col("surface").alias(f"{name}_surface"), F.col("source_id").alias(f"{name}_source"))
    df = links.join(side("left").withColumnRenamed("l", "a"), ["left_result_id", "left_role"], "left").join(side("right").withColumnRenamed("r", "b"), ["right_result_id", "right_role"], "left")
    spans = units.select("source_id", "unit_id", F.col("start_char").alias("unit_start"), F.col("end_char").alias("unit_end"))
    df = df.join(spans, ["source_id", "unit_id"], "left").join(sources.select("source_id", F.col("text").alias("source_text")), "source_id", "left")
    local = F.substring("source_text", (F.col("evidence_start") + 1).cast("int"), (F.col("evidence_end") - F.col("evidence_start")).cast("int"))
    tests = (
        ("UNKNOWN_MENTION", F.col("a").isNull() | F.col("b").isNull()),
        ("SAME_MENTION", F.col("a") == F.col("b")),
        ("CROSS_SOURCE_IDENTITY_MERGE", (F.col("left_source") != F.col("right_source")) | (F.col("left_source") != F.col("source_id"))),
        ("EVIDENCE_TEXT_MISMATCH", ~F.col("evidence_text").eqNullSafe(local)),
        ("OUTSIDE_UNIT", ~F.coalesce((F.col("unit_start") <= F.col("evidence_start")) & (F.col("evidence_end") <= F.col("unit_end")), F.lit(False))),
    )
    problem = reduce(lambda acc, t: acc.when(t[1], t[0]), tests[1:], F.when(tests[0][1], tests[0][0]))
    df = df.withColumn("problem", problem).drop("source_text", "unit_start", "unit_end", "left_source", "right_source")

    def worded(frame: pd.DataFrame) -> pd.DataFrame:
        rows = zip(frame.problem, frame.relation, frame.left_surface, frame.right_surface, frame.evidence_text, strict=True)
        return frame.assign(problem=[p if isinstance(p, str) else link_problem(*rest) for p, *rest in rows])

    return df.mapInPandas(lambda frames: map(worded, frames), df.schema)


def link_problem(relation: str, left: str, right: str, evidence: str) -> str | None:
    """Whether the evidence says in plain words that both are the same, or are not."""
    if IDENTITY_MODAL.search(evidence):
        return "MODAL_LINK"
    tails = SAME_TAIL if relation == "same_as" else DIFFERENT_TAIL
    pairs = [(literal(left), literal(right)), (literal(right), literal(left))]
    shapes = [IDENTITY_GAP.join((a, IDENTITY_JOIN, b, any_of(tails))) for a, b in pairs]
    if relation == "same_as":
        shapes += [IDENTITY_GAP.join((a, any_of(SAME_MIDDLE), b)) for a, b in pairs]
    return None if any(re.search(s, evidence, re.I) for s in shapes) else "RELATION_NOT_STATED"


def identified(accepted: DataFrame, sources: DataFrame | None = None, units: DataFrame | None = None, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Mentions in accepted claims, these with their component and its basis, the merges that were blocked, and the entities
    that they are."""
    with passing(accepted.sparkSession) as keep:
        found = keep(cut(mentions(accepted), "mentions"))
        good = None
        if links is not None:
            good = valid_links(links, found, sources, units).where("problem is null")
        merged, blocked = components(found, identity_edges(found, accepted, good))
        # mentions and components meet once; what comes of both reads this
        homes, blocked = keep(cut(placed(found, merged), "placed-mentions")), keep(cut(blocked, "blocked-merges"))
        return found, homes, blocked, keep(cut(entities(homes, homes), "entities"))


def normalize(accepted: DataFrame, sources: DataFrame | None = None, units: DataFrame | None = None, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything that follows from accepted claims, by table name."""
    found, homes, blocked, named = identified(accepted, sources, units, links)
    rows = cut(facts(accepted, homes, homes, named), "facts")
    disputes = cut(conflicts(rows), "conflicts")
    judged = fact_status(rows, disputes, blocked)
    unclear = ambiguity_groups(homes, homes, named)
    return {"mentions": found, "entities": named, "facts": judged, "timeline": timeline(judged), "conflicts": disputes, "blocked_merges": blocked, "ambiguity_groups": unclear}


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """G-21: counts and gates in one row."""
    status = tables["facts"].agg(F.count("*").alias("fact_count"), *(F.count_if(F.col("canonical_status") == s).alias(f"{s}_count") for s in ("canonical", "contested", "temporal_variant", "compatible_variant")))
    count: Callable[[str], DataFrame] = lambda t: tables[t].agg(F.count("*").alias(f"{t}_count"))
    out = status.crossJoin(tables["blocked_merges"].agg(F.count_if(F.col("severity") == "blocker").alias("blocker_count")))
    for name in ("mentions", "entities", "conflicts", "ambiguity_groups"):
        out = out.crossJoin(count(name))
    clear = F.col("blocker_count") == 0
    publish = clear & (F.col("contested_count") == 0) & (F.col("ambiguity_groups_count") == 0)
    return out.withColumns({"may_build_review_index": clear, "may_publish_canonical": publish, "may_freeze": F.lit(False)})
