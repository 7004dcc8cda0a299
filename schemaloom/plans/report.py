"""Analyses of a catalog as text or Markdown. The inputs are small, collected results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from schemaloom.operators import analytics, rules


def sections(catalog: DataFrame) -> dict[str, list[dict]]:
    """The results that a report shows."""
    spark = catalog.sparkSession
    names = {"Complexity": "agg_complexity", "Types": "agg_types", "Patterns": "agg_patterns", "Categories": "agg_categories", "Policy tags": "agg_policytags"}
    out = {title: [r.asDict() for r in analytics.analyse(spark, name, catalog).collect()] for title, name in names.items()}
    out["Findings"] = [r.asDict() for r in rules.find_all(spark, catalog).collect()]
    return {t: sorted(rows, key=lambda r: tuple(map(str, r.values()))) for t, rows in out.items()}


def as_text(found: dict[str, list[dict]]) -> str:
    return "\n\n".join("\n".join([f"== {title} ==", *("  " + "  ".join(f"{k}={v}" for k, v in row.items()) for row in rows)]) for title, rows in found.items() if rows)


def as_markdown(found: dict[str, list[dict]]) -> str:
    out = []
    for title, rows in found.items():
        if rows:
            head = list(rows[0])
            out.append("\n".join([f"## {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(str(v) for v in row.values()) + " |" for row in rows)]))
    return "\n\n".join(out)
