"""Readers of the side tables and writers of results. Side tables are small files; results of any size are written by tasks."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One table of files, folders or globs. Columns and rows are pruned by what is selected of it."""
    return spark.read.parquet(*paths)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV file with a header, under a stated schema; a workbook's sheet comes as such a file."""
    return spark.read.csv(path, header=True, schema=schema, sep=sep, mode="FAILFAST")


def settings(path: str) -> dict[str, Any]:
    return yaml.safe_load(Path(path).read_text())


def rosters(spark: SparkSession, path: str) -> DataFrame:
    """panel, panel_name, role, name, affiliation of a JSON file that maps panels to a chair and members."""
    text = spark.read.text(path, wholetext=True)
    person = "struct<name:string,affiliation:string>"
    found = text.select(F.explode(F.from_json("value", f"map<string,struct<committee_name:string,chair:{person},members:array<{person}>>>")).alias("panel", "p"))
    one = lambda role, c: F.transform(c, lambda x: F.struct(F.lit(role).alias("role"), x["name"].alias("name"), x["affiliation"].alias("affiliation")))
    chair = one("Chair", F.filter(F.array("p.chair"), lambda x: x.isNotNull()))
    none = F.expr("CAST(array() AS array<struct<role:string,name:string,affiliation:string>>)")
    people = F.concat(chair, F.coalesce(one("Member", F.col("p.members")), none))
    return found.select("panel", F.col("p.committee_name").alias("panel_name"), F.explode(people).alias("x")).select("panel", "panel_name", "x.*")


def records(df: DataFrame, column: str = "value") -> DataFrame:
    """work_id, title, year, venue, authors, abstract_index of exported JSON records of works."""
    schema = "id string, title string, publication_year long, primary_location struct<source: struct<display_name: string>>, authorships array<struct<author: struct<display_name: string>>>, abstract_inverted_index map<string, array<int>>"
    r = df.select(F.from_json(column, schema).alias("r"))
    return r.select(F.col("r.id").alias("work_id"), "r.title", F.col("r.publication_year").alias("year"), F.col("r.primary_location.source.display_name").alias("venue"), F.array_join(F.transform("r.authorships", lambda a: a["author"]["display_name"]), "; ").alias("authors"), F.col("r.abstract_inverted_index").alias("abstract_index"))


def write_parquet(df: DataFrame, path: str, order: Iterable[str] = (), partitions: int | None = None) -> None:
    """Written whole or not at all. With an order, files are ranges of it, each sorted inside: no task holds more than a range."""
    order = list(order)
    if order:
        df = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(found: dict, path: str) -> None:
    Path(path).write_text(json.dumps(found, indent=2, sort_keys=True))


def _shown(x: Any, digits: int) -> str:
    return "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def small_rows(df: DataFrame, most: int) -> list:
    """The rows of a report; a table that is longer is no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def markdown(df: DataFrame, title: str, digits: int = 3, most: int = 1000) -> str:
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(_shown(x, digits).replace("|", "\\|") for x in r) + " |" for r in small_rows(df, most)]) + "\n"


def latex(df: DataFrame, caption: str, label: str, digits: int = 3, most: int = 1000) -> str:
    """A table environment with rules above, below and under the head."""
    safe = lambda s: s.replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_").replace("#", r"\#")
    number = {"double", "float", "bigint", "int", "smallint"}
    columns = "".join("r" if kind in number else "l" for _, kind in df.dtypes)
    body = [" & ".join(safe(_shown(x, digits)) for x in r) + r" \\" for r in small_rows(df, most)]
    head = " & ".join(safe(c) for c in df.columns) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{safe(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{columns}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"]) + "\n"
