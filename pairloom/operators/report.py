"""Result documents as JSON, JSON lines, Markdown and plain tables. Only sums reach the driver; details are written by Spark."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.engine import Run


def markdown(doc: dict) -> str:
    """Header, settings, a table of models and one of categories."""
    summary, config = doc["summary"], doc["config"]
    seconds = doc.get("duration_seconds")
    lines = [f"# {doc['benchmark_name']}", "", f"Run {doc['benchmark_id']} of {doc['timestamp']}" + (f", {seconds:.1f} s" if seconds is not None else ""), ""]
    lines += [f"Domain: {config.get('domain') or 'none'}. Capabilities: {', '.join(config['capabilities'])}. Judge: {config['judge']['model']}.", ""]
    lines += [f"- {m['alias'] or m['model']}: {m['provider']}/{m['model']}" for m in config["models"]]
    lines += ["", "| Model | Wins | Ties | Losses | Mean score |", "|-|-:|-:|-:|-:|"]
    lines += [f"| {n} | {s['total_wins']} | {s['total_ties']} | {s['total_losses']} | {s['avg_score']:.2f} |" for n, s in summary["models"].items()]
    lines += ["", f"Winner: {summary['overall_winner']}", ""]
    names = list(summary["models"])
    lines += ["| Category | " + " | ".join(names) + " |", "|-|" + "-|" * len(names)]
    lines += [f"| {c} | " + " | ".join(f"W:{by[n]['wins']} T:{by[n]['ties']}" for n in names) + " |" for c, by in summary["by_category"].items()]
    return "\n".join(lines) + "\n"


def table(rows: list[list[object]], header: list[str]) -> str:
    """Columns as wide as their widest cell."""
    cells = [header, *([str(x) for x in r] for r in rows)]
    wide = [max(len(r[k]) for r in cells) for k in range(len(header))]
    line = ["  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in cells]
    return "\n".join([line[0], "  ".join("-" * w for w in wide), *line[1:]])


def console(doc: dict) -> str:
    models = doc["summary"]["models"]
    rows = [[n, s["total_wins"], s["total_ties"], s["total_losses"], f"{s['avg_score']:.2f}"] for n, s in models.items()]
    return table(rows, ["model", "wins", "ties", "losses", "score"]) + f"\nwinner: {doc['summary']['overall_winner']}"


def summary_line(run: Run) -> str:
    return json.dumps({"type": "summary", **run.document()}, ensure_ascii=False, default=str)


def lines(details: DataFrame) -> DataFrame:
    """value: one JSON line per result."""
    return details.select(F.to_json(F.struct(F.lit("result").alias("type"), "*"), {"ignoreNullFields": "false"}).alias("value"))


def save(run: Run, formats: tuple[str, ...], directory: str, name: str) -> dict[str, str]:
    """Write the formats asked for and say where; unknown formats are an error. Large parts are folders of files."""
    known = {"json", "jsonl", "markdown", "md"}
    if wrong := set(formats) - known:
        raise ValueError(f"unknown formats: {', '.join(sorted(wrong))}; known: {', '.join(sorted(known))}")
    base = Path(directory)
    base.mkdir(parents=True, exist_ok=True)
    out: dict[str, str] = {}
    for f in formats:
        at = base / f"{name}.{'md' if f == 'markdown' else f}"
        if f == "jsonl":
            lines(run.details()).write.mode("overwrite").text(str(at))
            (at / "0-summary.txt").write_text(summary_line(run) + "\n", encoding="utf-8")  # the first by name
        elif f == "json":
            doc = run.document()
            if run.config.output.include_raw_responses:
                doc["detailed_results"] = f"{name}_details"
                run.details().write.mode("overwrite").option("ignoreNullFields", "false").json(str(base / f"{name}_details"))
            at.write_text(json.dumps(doc, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
        else:
            at.write_text(markdown(run.document()), encoding="utf-8")
        out[f] = str(at)
    return out


COMPARED = ("benchmark_name", "winner", "model_1", "wins_1", "model_2", "wins_2", "ties")


def markdown_rows(rows: DataFrame) -> DataFrame:
    """A comparison's rows as lines of a Markdown table: file, line."""
    return rows.select("file", F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in COMPARED)), " | "), F.lit(" |")).alias("line"))


def json_rows(rows: DataFrame) -> DataFrame:
    """A comparison's rows as JSON objects: file, line."""
    return rows.select("file", F.to_json(F.struct(*COMPARED), {"ignoreNullFields": "false"}).alias("line"))


def comparison(rows: DataFrame, form: str) -> str:
    """A comparison of runs (see evaluate.compare), one row a file, as table, json or markdown."""
    if form == "table":
        return table([[r[n] for n in COMPARED] for r in rows.orderBy("file").collect()], list(COMPARED))
    found = [r.line for r in (json_rows if form == "json" else markdown_rows)(rows).orderBy("file").collect()]
    if form == "json":
        return json.dumps({"benchmarks": list(map(json.loads, found))}, indent=2, ensure_ascii=False)
    return "\n".join(["| " + " | ".join(COMPARED) + " |", "|" + "-|" * len(COMPARED), *found])
