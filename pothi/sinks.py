"""Writers: routed, versioned and appended tables, JSON lines, and rendered summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi.sources.tables import latest


def write_routed(df: DataFrame, by: str, routes: dict[str, str]) -> None:
    """Rows of each value of ``by`` to the table of its path; other values are an error, not lost."""
    known = F.coalesce(F.col(by).isin(*routes), F.lit(False))
    wrong = df.where(~known).limit(1).count()
    if wrong:
        raise ValueError(f"{by} has values without a route")
    for value, path in routes.items():
        df.where(F.col(by) == value).write.mode("overwrite").parquet(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """A new version beside the older ones, which stay as they are; writing one that is there is an error."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All versions of a table, with their name."""
    return spark.read.option("basePath", root).parquet(root)


def write_meta(df: DataFrame, path: str, text: str = "text") -> None:
    """All but the text."""
    df.drop(text).write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rewrite(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], order: str, to: str) -> None:
    """The table of ``path`` with ``changes`` merged in, the latest row of a key, written to another path."""
    latest(spark.read.parquet(path).unionByName(changes, allowMissingColumns=True), keys, order).write.mode("overwrite").parquet(to)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def rendered(manifest: DataFrame, group: str, title: str, count: str, most: int = 10_000) -> str:
    """Markdown of a roll-up: a section a group, its lines by count and title; the roll-up has a row a work, at most ``most``."""
    rows = manifest.select(group, title, count).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to render")
    out = []
    for g in sorted({r[group] or "" for r in rows}):
        own = sorted((r for r in rows if (r[group] or "") == g), key=lambda r: (-r[count], r[title] or ""))
        out += [f"## {g or '-'} ({len(own)})", *(f"- {r[title] or '-'}: {r[count]}" for r in own), ""]
    return "\n".join(out)
