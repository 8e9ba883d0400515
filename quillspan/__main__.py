"""Command line: ``python -m quillspan COMMAND ...``. Exit code 2: verification failed, or a benchmark has blockers; 3: every
question was refused."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import anomaly, chunking, claims, gold, semantics, structure
from quillspan.operators.lines import physical_lines
from quillspan.plans import project
from quillspan.sources import ingest
from quillspan.sources import tables as store
from quillspan.sources.scratch import cut

#: Commands and the paths and words that they take.
COMMANDS = {
    "admit": ("input", "out"),
    "encoding": ("input", "out"),
    "anomalies": ("input", "out"),
    "structure": ("input", "out"),
    "semantic": ("input", "out"),
    "chunks": ("input", "out"),
    "claims": ("input", "candidates", "out"),
    "build": ("input", "project"),
    "export": ("project", "table", "out"),
    "ask": ("project", "question"),
    "search": ("project", "question"),
    "verify": ("project",),
    "verify-answer": ("project", "packets"),
    "gold-run": ("project", "cases", "report"),
    "gold-verify": ("project", "cases", "report"),
    "unlock": ("project",),
}


def sources_of(spark: SparkSession, path: str) -> DataFrame:
    """Decoded files of a folder; what can't be decoded, and files that change meanwhile, stop the run."""
    seen = ingest.read_files(spark, path)
    files = ingest.decode(seen)
    bad = files.where("text is null").select("path").limit(5).collect()
    bad += ingest.changed_files(spark, path, files).limit(5).collect()
    if bad:
        raise SystemExit(f"not decodable or not at rest: {', '.join(r.path for r in bad)}")
    return files.select("source_id", "text").dropDuplicates(["source_id"])


def _whole(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", F.lit("unit-1").alias("unit_id"), F.lit(0).cast("long").alias("start_char"), F.col("text").alias("unit_text"))


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file with closed fields; a line that is none stops the run."""
    rows, problems = store.closed_rows(spark, path, schema)
    bad = problems.limit(5).collect()
    if bad:
        raise SystemExit("; ".join(f"{r.problem}: {r.line[:80]}" for r in bad))
    return rows


def _shown(df: DataFrame, *columns: str) -> int:
    """Prints rows; how many there were."""
    rows = df.select(*columns).collect()
    for row in rows:
        print("\t".join("" if v is None else str(v) for v in row))
    return len(rows)


def _run(spark: SparkSession, told: argparse.Namespace) -> int:
    policy = project.PROFILES[told.profile]
    match told.command:
        case "admit":
            ingest.admission(ingest.read_files(spark, told.input)).drop("content").write.json(told.out)
        case "encoding":
            ingest.text_statistics(ingest.decode(ingest.read_files(spark, told.input))).drop("text").write.json(told.out)
        case "anomalies":
            groups = {name: tuple(marks.split("|")) for name, marks in (m.split("=", 1) for m in told.markers)}
            found = anomaly.inspect_anomalies(sources_of(spark, told.input), anomaly.AnomalyPolicy(marker_groups=groups))
            found.write.partitionBy("category").json(told.out)
        case "structure":
            marks, units, found = (cut(df, "structure") for df in structure.inspect_structure(sources_of(spark, told.input), policy.structure))
            for name, df in (("headings", marks), ("units", units), ("findings", found), ("report", structure.structure_report(units, found))):
                df.write.json(f"{told.out}/{name}")
        case "semantic":
            sources = cut(sources_of(spark, told.input), "sources")
            lines = cut(physical_lines(sources), "lines")
            units = cut(structure.units(cut(structure.heading_candidates(lines, policy.structure), "headings"), sources, lines, policy.structure), "units")
            made = project.accepted_claims(sources, units, cut(anomaly.inspect_anomalies(sources, policy.anomaly, lines), "findings"), policy.semantic)
            made["claims"] = cut(made["claims"], "claims")
            made |= {"findings": project.semantic_findings(made["claims"], made["long_clauses"]), "report": project.semantic_report(made["claims"])}
            for name, df in made.items():
                df.write.json(f"{told.out}/{name}")
        case "chunks":
            chunking.chunks(_whole(sources_of(spark, told.input)), policy.chunk).write.json(told.out)
        case "claims":
            sources = sources_of(spark, told.input)
            units = _whole(sources).select("source_id", "unit_id", "start_char", F.length("unit_text").cast("long").alias("end_char"))
            judged = cut(claims.validate_claims(_rows(spark, told.candidates, store.CANDIDATE), sources, units), "claims")
            judged.write.partitionBy("status").json(f"{told.out}/claims")
            claims.reason_counts(judged).write.json(f"{told.out}/report")
        case "build":
            project.publish(spark, sources_of(spark, told.input), told.project, policy)
        case "export":
            store.read_project(spark, told.project, [told.table])[told.table].write.json(told.out)
        case "ask":
            packets = project.ask(spark, told.project, told.question, told.source).orderBy("question_id").collect()
            for row in packets:
                print(f"{row.question}\t{row.decision}\t{row.answer_text}")
            return 0 if any(row.decision == "answered" for row in packets) else 3
        case "search":
            hits = project.search(spark, told.project, told.question, told.limit, told.source).orderBy("question_id", "rank")
            return 0 if _shown(hits, "question_id", "rank", "source_id", "evidence_start", "evidence_end", "score", "evidence_text") else 3
        case "verify":
            wrong = project.verify(spark, told.project)
            wrong = wrong.unionByName(project.regenerated_differences(spark, told.project)) if told.deep else wrong
            asked = project.probe(spark, told.project).where("decision not in ('answered', 'refused_ambiguous')").select(F.lit("facts").alias("table_name"), F.lit("PROBE_NOT_ANSWERED").alias("problem"))
            return 2 if _shown(wrong.unionByName(asked), "table_name", "problem") else 0
        case "verify-answer":
            return 2 if _shown(project.verify_answers(spark, told.project, spark.read.parquet(told.packets)), "question_id", "reason_codes") else 0
        case "gold-run":
            project.gold_report(spark, told.project, _rows(spark, told.cases, store.GOLD), told.report, gold.POLICIES[told.policy])
            return 2 if _shown(store.read_project(spark, told.report, ["blockers"])["blockers"], "blocker") else 0
        case "gold-verify":
            return 2 if _shown(project.gold_differences(spark, told.project, _rows(spark, told.cases, store.GOLD), told.report, gold.POLICIES[told.policy]), "table_name", "problem") else 0
        case "unlock":
            store.break_lock(spark, told.project)
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in COMMANDS.items():
        sub = commands.add_parser(name)
        for place in places:
            sub.add_argument(place, nargs="+" if place == "question" else None)
        sub.add_argument("--profile", choices=sorted(project.PROFILES), default="balanced")
        sub.add_argument("--policy", choices=sorted(gold.POLICIES), default="release")
        sub.add_argument("--source", default=None)
        sub.add_argument("--limit", type=int, default=10)
        sub.add_argument("--deep", action="store_true", help="build the project's own sources again and compare")
        sub.add_argument("--markers", action="append", default=[], metavar="NAME=M1|M2")
    return _run(SparkSession.builder.appName("quillspan").getOrCreate(), parser.parse_args(args))


if __name__ == "__main__":
    sys.exit(main())
