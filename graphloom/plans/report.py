"""A report of an evaluation as Markdown, from tables that are a few rows long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate


def cell(value: object) -> str:
    text = f"{value:.2f}" if isinstance(value, float) else str(value)
    return " ".join(text.replace("|", "\\|").split())


def markdown_table(header: list[str], rows: list[list[object]]) -> str:
    lines = [header, ["---"] * len(header), *rows]
    return "\n".join("| " + " | ".join(cell(c) for c in row) + " |" for row in lines)


def sections(rows: DataFrame, flagship: str) -> list[tuple[str, list[str], DataFrame]]:
    """The parts of a report of `evaluate.scored` rows: title, columns and a table of a few rows, in order."""
    summaries = evaluate.summary(rows)
    short = ["pass_rate", *evaluate.METRICS, "p95_latency_ms"]
    return [
        ("Strategies", ["strategy", "rows", "pass_ci_low", "pass_ci_high", *short, "p50_latency_ms", *(f"mean_{c}" for c in evaluate.COSTS), "warning_rate", "skipped_rate"], summaries.orderBy("strategy")),
        ("Suites", ["suite", "strategy", "rows", *short], evaluate.breakdown(rows).orderBy("suite", "strategy")),
        ("Boundary crossings", ["strategy", *short, "mean_portal_hops", "mean_shard_fanout", "mean_shard_crossings"], evaluate.boundary(rows).orderBy("strategy")),
        ("Failures", ["label", "rows"], evaluate.failures(rows).orderBy(F.desc("rows"), "label")),
        ("Hardest misses", ["question_id", "strategy"], evaluate.hardest(rows).orderBy("place")),
        ("Reviews", ["audit_status", "rows"], rows.groupBy("audit_status").agg(F.count(F.lit(1)).alias("rows")).orderBy("audit_status")),
        ("External strategies", ["external_rows", "skipped_rows", "warning", "rows"], evaluate.external(rows).where("external_rows > 0")),
        ("Against the best other strategy", ["baseline", "pass_rate_delta", "source_recall_delta", "path_recall_delta", "faithfulness_delta"], evaluate.thesis(summaries, flagship).where("baseline IS NOT NULL")),
        ("Costs", ["widest", "widest_mean_shard_fanout", "slowest", "slowest_p95_latency_ms", "most_warned", "most_warned_warning_rate"], evaluate.cost_notes(summaries)),
    ]


def render(rows: DataFrame, flagship: str) -> str:
    """The report as Markdown. One row for a strategy or suite, failures by label and the hardest misses are collected;
    sections without rows are left out."""
    parts = ["# Evaluation"]
    for title, names, table in sections(rows, flagship):
        found = [[r[n] for n in names] for r in table.collect()]
        parts += [f"## {title}", markdown_table(names, found)] if found else []
    return "\n\n".join(parts) + "\n"


def write_json(rows: DataFrame, flagship: str, path: str) -> None:
    """The report as JSON below `path`: all scored rows as lines in `rows`, and in `report` one object with the sections."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows = rows.sparkSession.read.schema(rows.schema).json(f"{path}/rows")
    whole = None
    for title, names, table in sections(rows, flagship):
        one = table.select(*names).agg(F.collect_list(F.struct(*names)).alias(title.lower().replace(" ", "_")))  # a few rows
        whole = one if whole is None else whole.crossJoin(one)  # one row each
    whole.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/report")


def answer_report(answer: dict, hops: list[dict], evidence: list[dict], warnings: list[str]) -> str:
    """One answer as Markdown: what it says and on what it rests, the path, what to do and what is lacking."""
    bullets = lambda values: "\n".join(f"- {cell(v)}" for v in values) or "- none"
    path = [f"{h['from_id']} -> {h['to_id']} ({h['edge_type']}, {h['score']:.2f})" for h in hops]
    spans = [f"{e['uri']} [{e['start']}-{e['end']}]" for e in evidence]
    parts = ["# Answer", answer["answer"], f"Confidence {answer['confidence']:.2f}, {answer['sources']} source(s)."]
    for title, values in (("Root cause", answer["root_cause"]), ("Path", path), ("Evidence", spans), ("Actions", answer["actions"]), ("Missing", answer["missing"]), ("Warnings", warnings)):
        parts += [f"## {title}", bullets(values)]
    return "\n\n".join(parts) + "\n"
