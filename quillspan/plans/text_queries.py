"""Queries over texts: sources, lines, anomalies, structure, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import collapse, jaccard, mean_sentence, register_shares, sha
from quillspan.operators import anomaly, chunking, structure
from quillspan.operators.anomaly import AnomalyPolicy
from quillspan.operators.lines import in_order, physical_lines
from quillspan.sources import ingest
from quillspan.sources.scratch import cut

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB: physical lines of documents and pages, which end at line feeds only.
_LINES = """
{name}_pieces AS (SELECT {id} AS id, {text} AS text, string_split({text}, chr(10)) AS parts FROM {table}),
{name}_each AS (SELECT id, unnest(parts) AS content, unnest(range(1, len(parts) + 1)) AS line_no, len(parts) AS n FROM {name}_pieces),
{name} AS (SELECT id, line_no, content,
  coalesce(sum(length(content) + 1) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char
  FROM {name}_each WHERE NOT (line_no = n AND content = ''))"""
DOC_LINES = "WITH " + _LINES.format(name="lines", id="doc_id", text="text", table="documents").strip()
PAGE_LINES = "WITH " + _LINES.format(name="lines", id="page_id", text="html", table="pages").strip()
_WINDOWS = """
starts AS (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS start_char FROM documents),
windows AS (SELECT doc_id, start_char // 800 AS window_no, start_char, substr(text, start_char + 1, 800) AS w FROM starts
  WHERE length(substr(text, start_char + 1, 800)) >= 240)"""
_NORMAL = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer splits than there are cores (one small file) are dealt out over all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def dealt(rows: DataFrame) -> DataFrame:
    """Short rows that much is made of, dealt out over all cores: a table of keys has few bytes, so few splits."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def doc_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.as_sources(table(spark, sf_dir, "documents"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physical_lines(doc_sources(spark, sf_dir))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physical_lines(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.col("html").alias("text")))


def named(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The source's id back as the number it was; whole numbers as longs."""
    df = df.withColumn("source_id", F.col("source_id").cast("long")).withColumnRenamed("source_id", key)
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else c for c, t in df.dtypes))


_BREAKS = """length({t}) - length(replace({t}, chr(10), '')) - (length({t}) - length(replace({t}, concat(chr(13), chr(10)), ''))) // 2 AS lf_count,
  (length({t}) - length(replace({t}, concat(chr(13), chr(10)), ''))) // 2 AS crlf_count,
  length({t}) - length(replace({t}, chr(13), '')) - (length({t}) - length(replace({t}, concat(chr(13), chr(10)), ''))) // 2 AS cr_count"""


@query(
    "source_identity",
    f"""WITH c AS (SELECT doc_id, text, {_BREAKS.format(t="text")} FROM documents)
SELECT doc_id, sha256(text) AS source_sha256, strlen(text) AS size_bytes, lf_count, crlf_count, cr_count,
  CASE WHEN (lf_count > 0)::INT + (crlf_count > 0)::INT + (cr_count > 0)::INT = 0 THEN 'none'
       WHEN (lf_count > 0)::INT + (crlf_count > 0)::INT + (cr_count > 0)::INT > 1 THEN 'mixed'
       WHEN lf_count > 0 THEN 'lf' WHEN crlf_count > 0 THEN 'crlf' ELSE 'cr' END AS newline_type,
  lf_count + crlf_count + cr_count + CASE WHEN text <> '' AND right(text, 1) NOT IN (chr(10), chr(13)) THEN 1 ELSE 0 END AS line_count
FROM c""",
)
def source_identity(spark, sf_dir):
    return ingest.identity(table(spark, sf_dir, "documents"))


@query("physical_lines", f"{DOC_LINES} SELECT id AS doc_id, line_no, sha256(content) AS content_sha256 FROM lines")
def lines_of_documents(spark, sf_dir):
    return named(doc_lines(spark, sf_dir).select("source_id", "line_no", sha(F.col("content")).alias("content_sha256")))


@query("line_offsets", f"{DOC_LINES} SELECT id AS doc_id, line_no, start_char::BIGINT AS start_char, (start_char + length(content))::BIGINT AS end_char FROM lines")
def line_offsets(spark, sf_dir):
    return named(doc_lines(spark, sf_dir).select("source_id", "line_no", "start_char", "end_char"))


@query("exact_duplicate_docs", "SELECT sha256(text) AS source_sha256, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(sha(F.col("text")).alias("source_sha256"), "doc_id")
    return docs.groupBy("source_sha256").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


@query("line_length_limit", f"{DOC_LINES} SELECT id AS doc_id, start_char::BIGINT AS start_char, line_no AS start_line, concat('length=', length(content)) AS signal, sha256(content) AS evidence_sha256 FROM lines WHERE length(content) > 400")
def line_length_limit(spark, sf_dir):
    found = anomaly.long_lines(doc_lines(spark, sf_dir), AnomalyPolicy(max_line_characters=400))
    return named(found.select("source_id", "start_char", "start_line", F.array_join("signals", ",").alias("signal"), "evidence_sha256"))


_KIND = "CASE WHEN lf_count > 0 AND crlf_count + cr_count > 0 THEN 'mixed' WHEN lf_count > 0 THEN 'lf' WHEN crlf_count > 0 THEN 'crlf' WHEN cr_count > 0 THEN 'cr' ELSE 'none' END"


@query(
    "newline_stats",
    f"""WITH c AS (SELECT 'documents' AS origin, {_BREAKS.format(t="text")} FROM documents UNION ALL SELECT 'pages', {_BREAKS.format(t="html")} FROM pages)
SELECT origin, {_KIND} AS newline_type, count(*) AS n, sum(lf_count)::BIGINT AS lf_count FROM c GROUP BY ALL""",
)
def newline_stats(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text")
    both = texts.unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("html").alias("text")))
    both = both.withColumns(ingest.newline_counts(F.col("text"))).withColumn("newline_type", ingest.newline_type())
    return both.groupBy("origin", "newline_type").agg(F.count("*").alias("n"), F.sum("lf_count").alias("lf_count"))


@query("encoding_statistics", "SELECT doc_id, length(text) AS character_count, length(text) - length(replace(text, 'é', '')) AS e_acute_count, 0::BIGINT AS control_count FROM documents")
def encoding_statistics(spark, sf_dir):
    stats = ingest.text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stats.select("doc_id", "character_count", F.regexp_count("text", F.lit("é")).cast("long").alias("e_acute_count"), "control_count")


def _matches(lines: str, key: str, pattern: str) -> str:
    return f"""{lines},
m AS (SELECT id, line_no, start_char, regexp_extract_all(content, '{pattern}') AS hits, string_split_regex(content, '{pattern}') AS gaps FROM lines WHERE regexp_matches(content, '{pattern}')),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)
SELECT id AS {key}, line_no,
  (start_char + coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS start_char,
  length(hits[i]) AS n_chars, hits[i] AS hit FROM e"""


_TAG, _URL = "</?[A-Za-z][^>]{0,200}>", "(?i)(?:https?://|www\\.|[A-Za-z0-9-]+\\.(?:com|cn|net|org)\\b)"


def _web(lines: DataFrame, signal: str) -> DataFrame:
    found = anomaly.web_matches(lines, {signal: anomaly.WEB[signal]})
    return found.select("source_id", "line_no", "start_char", (F.col("end_char") - F.col("start_char")).alias("n_chars"), "hit")


@query("web_residue_tags", _matches(PAGE_LINES, "page_id", _TAG))
def web_residue_tags(spark, sf_dir):
    return named(_web(page_lines(spark, sf_dir), "HTML_TAG"), "page_id")


@query("web_residue_urls", _matches(PAGE_LINES, "page_id", _URL))
def web_residue_urls(spark, sf_dir):
    return named(_web(page_lines(spark, sf_dir), "URL_OR_DOMAIN"), "page_id")


@query("web_residue_docs", f"{_matches(DOC_LINES, 'doc_id', _URL)}")
def web_residue_docs(spark, sf_dir):
    return named(_web(doc_lines(spark, sf_dir), "URL_OR_DOMAIN"))


_RUNS = f"""{DOC_LINES}, n AS (SELECT *, {_NORMAL} AS normal FROM lines),
marked AS (SELECT *, CASE WHEN normal = lag(normal) OVER (PARTITION BY id ORDER BY line_no) THEN 0 ELSE 1 END AS new FROM n),
islands AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY line_no) AS island FROM marked),
runs AS (SELECT *, CASE WHEN normal = '' THEN 0 ELSE row_number() OVER (PARTITION BY id, island ORDER BY line_no) END AS run FROM islands)"""


@query("repeated_line_runs", f"{_RUNS} SELECT id AS doc_id, line_no AS start_line, start_char::BIGINT AS start_char, 'run_length=3' AS signal FROM runs WHERE run = 3")
def repeated_line_runs(spark, sf_dir):
    found = anomaly.repeated_runs(doc_lines(spark, sf_dir))
    return named(found.select("source_id", "start_line", "start_char", F.array_join("signals", ",").alias("signal")))


@query("line_run_lengths", f"{_RUNS} SELECT id AS doc_id, max(run)::BIGINT AS longest, count(*) FILTER (WHERE run > 1) AS repeats FROM runs GROUP BY id")
def line_run_lengths(spark, sf_dir):
    runs = anomaly.line_runs(doc_lines(spark, sf_dir))
    return named(runs.groupBy("source_id").agg(F.max("run").alias("longest"), F.count_if(F.col("run") > 1).alias("repeats")))


@query(
    "distant_duplicates",
    f"""{DOC_LINES}, n AS (SELECT *, {_NORMAL} AS normal FROM lines),
f AS (SELECT *, min(line_no) OVER (PARTITION BY id, normal) AS first_line FROM n WHERE length(normal) >= 40)
SELECT id AS doc_id, line_no, first_line FROM f WHERE line_no - first_line >= 1""",
)
def distant_duplicates(spark, sf_dir):
    return named(anomaly.earlier_copies(doc_lines(spark, sf_dir), 40, 1).select("source_id", "line_no", "first_line"))


@query(
    "cross_doc_duplicate_lines",
    f"{DOC_LINES} SELECT sha256({_NORMAL}) AS line_sha256, count(*) AS n_lines, count(DISTINCT id) AS n_docs FROM lines WHERE length({_NORMAL}) >= 20 GROUP BY {_NORMAL} HAVING count(DISTINCT id) > 1",
)
def cross_doc_duplicate_lines(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).select("source_id", collapse(F.col("content")).alias("normal")).where(F.length("normal") >= 20)
    out = lines.groupBy(sha(F.col("normal")).alias("line_sha256")).agg(F.count("*").alias("n_lines"), F.countDistinct("source_id").alias("n_docs"))
    return out.where("n_docs > 1")


@query(
    "unicode_anomalies",
    """SELECT doc_id, (length(text) + 1 + k)::BIGINT AS start_char, rule_id, signal FROM documents,
(VALUES (0, 'UNICODE_REPLACEMENT_CHARACTER', 'U+FFFD'), (1, 'UNICODE_EMBEDDED_BOM', 'U+FEFF'), (2, 'UNICODE_CONTROL_CHARACTER', 'U+0007'), (4, 'UNICODE_NONCHARACTER', 'U+FDD0')) v(k, rule_id, signal)""",
)
def unicode_anomalies(spark, sf_dir):
    texts = doc_sources(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n�﻿\u0007 ﷐")))
    found = anomaly.special_characters(physical_lines(texts))
    return named(found.select("source_id", "start_char", "rule_id", F.array_join("signals", ",").alias("signal")))


_GROUPS = {"article": ("the ", "le ", "der "), "preposition": ("of ", "in ", "de ")}


@query(
    "marker_clusters",
    f"""{DOC_LINES}, h AS (SELECT id, line_no, list_filter(['the ', 'le ', 'der ', 'of ', 'in ', 'de '], lambda m: contains(lower(content), m)) AS hits FROM lines)
SELECT id AS doc_id, line_no AS start_line, len(hits) AS n_markers FROM h
WHERE len(hits) >= 3 AND len(list_intersect(hits, ['the ', 'le ', 'der '])) > 0 AND len(list_intersect(hits, ['of ', 'in ', 'de '])) > 0""",
)
def marker_clusters(spark, sf_dir):
    found = anomaly.marker_clusters(doc_lines(spark, sf_dir), AnomalyPolicy(marker_groups=_GROUPS))
    return named(found.select("source_id", "start_line", (F.size("signals") - 1).alias("n_markers")))


@query("char_windows", f"WITH {_WINDOWS} SELECT doc_id, window_no, start_char, start_char + length(w) AS end_char, sha256(w) AS window_sha256 FROM windows")
def char_windows(spark, sf_dir):
    windows = anomaly.char_windows(doc_sources(spark, sf_dir), 800, 800, 240)
    return named(windows.select("source_id", "window_no", "start_char", "end_char", sha(F.col("window")).alias("window_sha256")))


_GRAMS = f"""{_WINDOWS}, plain AS (SELECT doc_id, window_no, regexp_replace(lower(w), '[^a-z]', '', 'g') AS p FROM windows),
pairs AS (SELECT doc_id, window_no, unnest(list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) AS gram FROM plain WHERE length(p) > 1),
grams AS (SELECT doc_id, window_no, gram, count(*) AS tf FROM pairs GROUP BY ALL)"""


def _windows(spark, sf_dir) -> DataFrame:
    return anomaly.char_windows(doc_sources(spark, sf_dir), 800, 800, 240)


@query("window_bigrams", f"WITH {_GRAMS} SELECT gram, count(*) AS n_windows, sum(tf)::BIGINT AS tf FROM grams GROUP BY gram")
def window_bigrams(spark, sf_dir):
    return anomaly.window_bigrams(_windows(spark, sf_dir)).groupBy("gram").agg(F.count("*").alias("n_windows"), F.sum("tf").alias("tf"))


@query(
    "window_cosine",
    f"""WITH {_GRAMS}, norms AS (SELECT doc_id, window_no, sum(tf * tf) AS norm FROM grams GROUP BY ALL),
dots AS (SELECT a.doc_id, b.window_no, sum(a.tf * b.tf) AS dot FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.window_no = a.window_no + 1 GROUP BY ALL)
SELECT n2.doc_id, n2.window_no, round(coalesce(dot, 0) / sqrt(n1.norm::DOUBLE * n2.norm::DOUBLE), 6) AS cosine
FROM norms n1 JOIN norms n2 ON n1.doc_id = n2.doc_id AND n2.window_no = n1.window_no + 1 LEFT JOIN dots d ON d.doc_id = n2.doc_id AND d.window_no = n2.window_no""",
)
def window_cosine(spark, sf_dir):
    out = anomaly.window_cosines(_windows(spark, sf_dir))
    return named(out.select("source_id", "window_no", F.round("cosine", 6).alias("cosine")))


@query("window_cosine_by_joins", ORACLE_SQL["window_cosine"])
def window_cosine_by_joins(spark, sf_dir):
    out = anomaly.neighbour_cosines(_windows(spark, sf_dir))
    return named(out.select("source_id", "window_no", F.round("cosine", 6).alias("cosine")))


@query(
    "script_profile_shift",
    f"""{DOC_LINES}, r AS (SELECT id, line_no, length(content) AS n, length(regexp_replace(content, '[^A-Za-z]', '', 'g')) / greatest(length(content), 1) AS latin FROM lines),
l AS (SELECT *, lag(CASE WHEN n >= 80 THEN latin END) OVER (PARTITION BY id ORDER BY line_no) AS before FROM r)
SELECT id AS doc_id, line_no, round(latin, 6) AS latin_ratio, round(before, 6) AS latin_before FROM l WHERE n >= 80 AND before IS NOT NULL""",
)
def script_profile_shift(spark, sf_dir):
    out = anomaly.script_shifts(doc_lines(spark, sf_dir), 80, 0.0)
    return named(out.select("source_id", "line_no", F.round("latin", 6).alias("latin_ratio"), F.round("latin_before", 6).alias("latin_before")))


_REGISTERS = {"plain": ("the", "and", "of"), "romance": ("que", "les", "los"), "german": ("der", "und", "ung")}


def _register_sql() -> str:
    count = lambda ws: " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) / {len(w)}" for w in ws)
    columns = ", ".join(f"{count(ws)} AS {name}" for name, ws in _REGISTERS.items())
    shares = ", ".join(f"round(CASE WHEN plain + romance + german > 0 THEN {n} / (plain + romance + german) ELSE 0 END, 6) AS {n}_share" for n in _REGISTERS)
    return f"WITH c AS (SELECT doc_id, {columns} FROM documents) SELECT doc_id, {shares} FROM c"


@query("register_profile", _register_sql())
def register_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", register_shares(F.col("text"), _REGISTERS).alias("r"))
    return docs.select("doc_id", *(F.round(F.col("r")[n], 6).alias(f"{n}_share") for n in _REGISTERS))


@query(
    "sentence_stats",
    """WITH s AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[。！？!?]+'), lambda x: regexp_matches(x, '\\S')) AS parts FROM documents)
SELECT doc_id, round(CASE WHEN len(parts) > 0 THEN list_sum(list_transform(parts, lambda x: length(x))) / len(parts) ELSE length(text) END, 6) AS mean_sentence FROM s""",
)
def sentence_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(mean_sentence(F.col("text")), 6).alias("mean_sentence"))


@query(
    "entity_jaccard",
    f"""WITH {_WINDOWS}, e AS (SELECT doc_id, window_no, list_distinct(regexp_extract_all(w, '[A-Z][a-z]+')) AS names FROM windows),
p AS (SELECT a.doc_id, b.window_no, a.names AS x, b.names AS y FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.window_no = a.window_no + 1)
SELECT doc_id, window_no, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM p""",
)
def entity_jaccard(spark, sf_dir):
    windows = anomaly.char_windows(doc_sources(spark, sf_dir), 800, 800, 240)
    named_ = windows.withColumn("names", F.array_distinct(F.regexp_extract_all("window", F.lit("[A-Z][a-z]+"), 0)))
    both = named_.withColumn("before", F.lag("names").over(in_order("window_no"))).where("before is not null")
    return named(both.select("source_id", "window_no", F.round(jaccard(F.col("before"), F.col("names")), 6).alias("jaccard")))


_FINDINGS = f"""{_RUNS}, found AS (
  SELECT id, 'REPEATED_LINE_RUN_CANDIDATE' AS rule_id, 'contamination_candidate' AS category, start_char, start_char + length(content) AS end_char, line_no, content AS evidence FROM runs WHERE run = 3
  UNION ALL SELECT id, 'LINE_EXCEEDS_LENGTH_LIMIT', 'structural_anomaly', start_char, start_char + length(content), line_no, content FROM runs WHERE length(content) > 400)"""


def _findings(spark, sf_dir) -> DataFrame:
    lines, policy = doc_lines(spark, sf_dir), AnomalyPolicy(max_line_characters=400)
    return anomaly.repeated_runs(lines, policy).unionByName(anomaly.long_lines(lines, policy))


@query("findings_union", f"{_FINDINGS} SELECT id AS doc_id, rule_id, category, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char, line_no AS start_line, sha256(evidence) AS evidence_sha256 FROM found")
def findings_union(spark, sf_dir):
    return named(_findings(spark, sf_dir).select("source_id", "rule_id", "category", "start_char", "end_char", "start_line", "evidence_sha256"))


@query("category_counts", f"{_FINDINGS} SELECT category, rule_id, count(*) AS n FROM found GROUP BY ALL")
def category_counts(spark, sf_dir):
    report = anomaly.anomaly_report(_findings(spark, sf_dir))
    return report.groupBy("category", "rule_id").agg(F.sum("n").alias("n"))


@query(
    "finding_cap",
    f"""{_FINDINGS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_char, end_char, rule_id) AS r, count(*) OVER (PARTITION BY id) AS total FROM found)
SELECT id AS doc_id, rule_id, start_char::BIGINT AS start_char, total > 2 AS limit_reached FROM ranked WHERE r <= 2""",
)
def finding_cap(spark, sf_dir):
    out = anomaly.capped(_findings(spark, sf_dir), 2, "start_char", "end_char", "rule_id")
    return named(out.select("source_id", "rule_id", "start_char", "limit_reached"))


def chapters(spark, sf_dir) -> DataFrame:
    """Documents with a heading before every third line."""
    lines = doc_lines(spark, sf_dir).withColumn("nth", F.floor((F.col("line_no") - 1) / 3) + 1)
    head = F.when((F.col("line_no") - 1) % 3 == 0, F.concat(F.lit("Chapter "), "nth", F.lit("\n"))).otherwise("")
    parts = lines.select("source_id", "line_no", F.concat(head, "content", F.lit("\n")).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "part")))
    return parts.groupBy("source_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("text"))


_CHAPTERS = f"""{DOC_LINES}, parts AS (SELECT id, (line_no - 1) // 3 + 1 AS nth, string_agg(content || chr(10), '' ORDER BY line_no) AS body FROM lines GROUP BY ALL),
chapters AS (SELECT id, nth, 'Chapter ' || nth || chr(10) || body AS content,
  coalesce(sum(length('Chapter ' || nth || chr(10) || body)) OVER (PARTITION BY id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM parts)"""


@query(
    "unit_partition",
    f"""{_CHAPTERS} SELECT id AS doc_id, 'chapter' AS unit_type, nth AS ordinal, start_char::BIGINT AS start_char, (start_char + length(content))::BIGINT AS end_char, sha256(content) AS content_sha256 FROM chapters""",
)
def unit_partition(spark, sf_dir):
    # written once: units read texts twice, lines twice, and headings three times
    texts = cut(chapters(spark, sf_dir), "texts")
    lines = cut(physical_lines(texts), "lines")
    units = structure.units(cut(structure.heading_candidates(lines), "headings"), texts, lines)
    return named(units.select("source_id", "unit_type", "ordinal", "start_char", "end_char", "content_sha256"))


@query(
    "heading_detect",
    f"""{_CHAPTERS} SELECT id AS doc_id, 'ENGLISH_NUMBERED_HEADING' AS rule_id, nth AS ordinal, start_char::BIGINT AS start_char, (start_char + length('Chapter ' || nth))::BIGINT AS end_char, 'high' AS confidence FROM chapters""",
)
def heading_detect(spark, sf_dir):
    found = structure.heading_candidates(physical_lines(chapters(spark, sf_dir)))
    return named(found.select("source_id", "rule_id", "ordinal", "start_char", "end_char", "confidence"))


@query(
    "unit_coverage",
    f"{DOC_LINES} SELECT id AS doc_id, sum(length(content))::BIGINT AS covered, (count(*) FILTER (WHERE line_no > 1) + max(CASE WHEN right(text, 1) = chr(10) THEN 1 ELSE 0 END))::BIGINT AS gap_count, 0::BIGINT AS overlap_count FROM lines JOIN documents ON doc_id = id GROUP BY id",
)
def unit_coverage(spark, sf_dir):
    sizes = doc_sources(spark, sf_dir).select("source_id", F.length("text").alias("size"))
    spans = doc_lines(spark, sf_dir).where("end_char >= start_char").join(sizes, "source_id")
    out = structure.coverage(spans.select("source_id", "start_char", "end_char", "size"))
    return named(out.select("source_id", F.col("covered").cast("long"), F.col("gap_count").cast("long"), F.col("overlap_count").cast("long")))


_ITEMS = ["l_shipdate", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]


def _continuity(spark, sf_dir) -> DataFrame:
    return structure.ordinal_continuity(table(spark, sf_dir, "lineitem").withColumn("ordinal", F.col("l_linenumber").cast("long")), ["l_orderkey"], _ITEMS)


@query("ordinal_duplicates", "SELECT l_orderkey, l_linenumber::BIGINT AS ordinal, count(*) - 1 AS duplicates FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def ordinal_duplicates(spark, sf_dir):
    rows = _continuity(spark, sf_dir).where("not first")
    return rows.groupBy("l_orderkey", "ordinal").agg(F.count("*").alias("duplicates"))


_LAGGED = f"WITH o AS (SELECT l_orderkey, l_linenumber::BIGINT AS ordinal, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ITEMS)})::BIGINT AS previous FROM lineitem)"


@query("ordinal_gaps", f"{_LAGGED} SELECT l_orderkey, previous, ordinal, count(*) AS n FROM o WHERE ordinal > previous + 1 GROUP BY ALL")
def ordinal_gaps(spark, sf_dir):
    rows = _continuity(spark, sf_dir).where("issue = 'ORDINAL_GAP_CANDIDATE'")
    return rows.groupBy("l_orderkey", "previous", "ordinal").agg(F.count("*").alias("n"))


@query("ordinal_inversions", f"{_LAGGED} SELECT l_orderkey, previous, ordinal, count(*) AS n FROM o WHERE ordinal < previous GROUP BY ALL")
def ordinal_inversions(spark, sf_dir):
    rows = _continuity(spark, sf_dir).where("issue = 'ORDINAL_INVERSION_CANDIDATE'")
    return rows.groupBy("l_orderkey", "previous", "ordinal").agg(F.count("*").alias("n"))


@query(
    "parent_hierarchy",
    """SELECT 'n' || n_nationkey AS name, 'r' || n_regionkey AS parent FROM nation UNION ALL
SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, NULL FROM region""",
)
def parent_hierarchy(spark, sf_dir):
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    level = lambda df, n, *keys: df.select(F.lit(n).alias("level"), *(k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)))
    low = F.lit(-1)
    rows = level(region.select("*"), 1, F.col("r_regionkey"), low, low)
    rows = rows.unionByName(level(nation, 2, F.col("n_regionkey"), F.col("n_nationkey"), low))
    homes = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = rows.unionByName(level(customer.join(homes, "c_nationkey"), 3, F.col("n_regionkey"), F.col("c_nationkey"), F.col("c_custkey")))
    name = F.when(F.col("level") == 1, F.concat(F.lit("r"), "k0")).when(F.col("level") == 2, F.concat(F.lit("n"), "k1")).otherwise(F.concat(F.lit("c"), "k2"))
    order = Window.partitionBy("k0").orderBy("k1", "k2")  # a region is a source of its own
    rows = rows.withColumns({"name": name, "position": F.row_number().over(order)})
    return rows.select("name", structure.parent(F.col("level"), F.col("name"), F.col("position"), order).alias("parent"))


@query("duplicate_titles", "SELECT lower(p_name) AS title, min(p_partkey) AS first_part, count(*) - 1 AS duplicates FROM part GROUP BY lower(p_name) HAVING count(*) > 1")
def duplicate_titles(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(collapse(F.lower("p_name")).alias("title"), "p_partkey")
    parts = structure.first_bearers(parts, ["title"], ["p_partkey"], "p_partkey", "first_part")
    return parts.groupBy("title", "first_part").agg(F.count("*").alias("duplicates"))


_FIXED = """WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) > 1400 THEN range(0, length(text) - 180, 1220) WHEN length(text) > 0 THEN [0] ELSE [] END) AS norm_start FROM documents),
c AS (SELECT doc_id, norm_start // 1220 AS ordinal, norm_start, least(norm_start + 1400, length(text)) AS norm_end, CASE WHEN norm_start = 0 THEN 0 ELSE 180 END AS overlap, substr(text, norm_start + 1, 1400) AS t FROM s)"""


@query("chunk_fixed", f"{_FIXED} SELECT doc_id, ordinal, norm_start, norm_end, sha256(t) AS text_sha256 FROM c")
def chunk_fixed(spark, sf_dir):
    out = chunking.fixed_chunks(doc_sources(spark, sf_dir), 1400, 180)
    return named(out.select("source_id", "ordinal", "norm_start", "norm_end", sha(F.col("text")).alias("text_sha256")))


@query("chunk_boundary")
def chunk_boundary(spark, sf_dir):
    units = doc_sources(spark, sf_dir).select("source_id", F.lit("unit-1").alias("unit_id"), F.lit(0).alias("start_char"), F.col("text").alias("unit_text"))
    return chunking.chunks(units).drop("text")


@query(
    "chunk_report",
    f"""{_FIXED} SELECT doc_id, count(*) AS chunk_count, max(norm_end - norm_start) AS max_length, max(overlap)::BIGINT AS max_overlap, sum(overlap)::BIGINT AS total_overlap, sum(norm_end - norm_start - overlap)::BIGINT AS covered_characters FROM c GROUP BY doc_id""",
)
def chunk_report(spark, sf_dir):
    return named(chunking.chunk_report(chunking.fixed_chunks(doc_sources(spark, sf_dir), 1400, 180)))


@query("chunk_invariants", "SELECT doc_id, length(text) AS covered_characters, 0::BIGINT AS problems FROM documents WHERE length(text) > 0")
def chunk_invariants(spark, sf_dir):
    units = doc_sources(spark, sf_dir).select("source_id", F.lit("unit-1").alias("unit_id"), F.lit(0).alias("start_char"), F.col("text").alias("unit_text"))
    made = chunking.chunks(units)
    bad = chunking.chunk_problems(made).groupBy("source_id").agg(F.count("*").alias("problems"))
    report = chunking.chunk_report(made).select("source_id", "covered_characters")
    return named(report.join(bad, "source_id", "left").select("source_id", "covered_characters", F.coalesce("problems", F.lit(0)).cast("long").alias("problems")))


@query("anomaly_report_of_documents")
def anomaly_report_of_documents(spark, sf_dir):
    """Every rule over every document, counted by category and rule; the mosaic and collage rules have no SQL."""
    lines = cut(doc_lines(spark, sf_dir), "lines")
    return anomaly.inspect_anomalies(doc_sources(spark, sf_dir), lines=lines).groupBy("category", "rule_id").agg(F.count("*").alias("n"))
