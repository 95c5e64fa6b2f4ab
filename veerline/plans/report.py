"""Results as Markdown tables. What is formatted here are results of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a report shows at most; what is cut is said.
MOST_ROWS = 1000


def cell(x) -> str:
    if x is None:
        return "–"
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, float):
        return f"{x:.4g}"
    return str(x).replace("|", "\\|").replace("\n", " ")


def markdown(title: str, df: DataFrame, order: tuple[str, ...] = ()) -> str:
    rows = (df.orderBy(*order) if order else df).limit(MOST_ROWS + 1).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows[:MOST_ROWS]]
    if len(rows) > MOST_ROWS:
        lines.append(f"\nMore than {MOST_ROWS} rows; the rest isn't shown.")
    return "\n".join(lines) + "\n"
