"""Sources and sinks: document files, gold letters, earlier results; result tables, reports and JSON."""

from __future__ import annotations

import io
from collections.abc import Iterable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapheur.operators.evaluate import document_key, printed

SUFFIXES = ("pdf", "jpg", "jpeg", "png")
GOLD_HEADER = {"filename": "filename", "Source": "source", "Destination": "destination", "Date": "date_text", "Ref": "ref_code", "Objet": "objet", "Pj": "pj", "Content": "content", "Copie": "copie", "Table": "table_text"}


def document_files(spark: SparkSession, folder: str, suffixes: Iterable[str] = SUFFIXES, limit: int | None = None) -> DataFrame:
    """(path, doc_id, suffix, length, content) of the document files below a folder; ``limit`` takes the first in order of path.

    Empty files are left out. The content column is read only by those who use it.
    """
    either = "{" + ",".join(x for s in suffixes for x in (s, s.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{either}").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", document_key(name).alias("doc_id"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("suffix"), "length", "content")
    return out.orderBy("path").limit(limit) if limit is not None else out


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gold letters from a CSV with the report's header; every column a string, ``row_no`` the order in the file."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in GOLD_HEADER])
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=False)
    return rows.select(F.monotonically_increasing_id().alias("row_no"), *[F.col(h).alias(c) for h, c in GOLD_HEADER.items()])


def earlier_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of an earlier run; empty, with the same columns, where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def export_report(df: DataFrame, folder: str, name: str, rows: int = 10_000) -> dict[str, Path]:
    """A summary table as CSV (with a byte-order mark), Markdown and LaTeX files on the driver.

    Summary tables have a few rows; more than ``rows`` is an error, not a cut.
    """
    taken = df.limit(rows + 1).toPandas()
    if len(taken) > rows:
        raise ValueError(f"{name} has more than {rows} rows; write it with write_table")
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = {kind: Path(folder, f"{name}.{kind}") for kind in ("csv", "md", "tex")}
    taken.to_csv(out["csv"], index=False, encoding="utf-8-sig")
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    shown = df.limit(rows).withColumns({c: printed(F.col(c)) for c in numbers}).toPandas().astype(str) if numbers else taken.astype(str)
    line = lambda cells, a, sep, z: a + sep.join(cells) + z
    md = io.StringIO()
    md.write(line(shown.columns, "| ", " | ", " |\n") + line(["---"] * len(shown.columns), "| ", " | ", " |\n"))
    tex = io.StringIO()
    tex.write("\\begin{tabular}{" + "l" * len(shown.columns) + "}\n\\hline\n" + line(map(_tex, shown.columns), "", " & ", " \\\\\n\\hline\n"))
    for row in shown.itertuples(index=False):
        md.write(line([str(v).replace("|", "\\|") for v in row], "| ", " | ", " |\n"))
        tex.write(line(map(_tex, row), "", " & ", " \\\\\n"))
    tex.write("\\hline\n\\end{tabular}\n")
    out["md"].write_text(md.getvalue(), encoding="utf-8")
    out["tex"].write_text(tex.getvalue(), encoding="utf-8")
    return out


def _tex(value: object) -> str:
    return "".join("\\" + c if c in "&%$#_{}" else c for c in str(value))
