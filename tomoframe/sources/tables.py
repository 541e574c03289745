"""Particle tables and tomogram lists as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tomoframe.functions.columns import trimmed
from tomoframe.functions.formatting import general_format, lenient_number, whole_format
from tomoframe.operators.ordinals import with_ordinal
from tomoframe.schema import TBL_COLUMNS, WHOLE_POSITIONS
from tomoframe.sources.star import blocks, particle_block


def _tokens(line: Column | str) -> Column:
    return F.transform(F.split(line, r"[ \t\r]+"), lenient_number)


def token_columns(lines: DataFrame, line: str = "line", width: int = len(TBL_COLUMNS)) -> DataFrame:
    """`lines` with `n_tokens` and the first `width` tokens of `line` as numbers: the 35 columns of the table, then col36, col37 and
    so on. Missing tokens and those that are no numbers are null, complex ones count by their real part.

    A generator makes the tokens, so that a line is split once for all columns."""
    names = [*TBL_COLUMNS, *(f"col{i + 1}" for i in range(len(TBL_COLUMNS), width))][:width]
    split = lines.withColumn("_v", F.explode(F.array(_tokens(line))))
    return split.select(*(F.col(f"`{c}`") for c in lines.columns if c not in ("n_tokens", *names)), F.size("_v").cast("bigint").alias("n_tokens"), *(F.get("_v", F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_tbl(spark: SparkSession, path: str) -> DataFrame:
    """The lines of native tables as numbers, with `src_file` and `at` (a growing number within a file): 35 columns, and col36
    and so on where a line has more, as many as the widest one. Blank lines are left out, short rows end in nulls, tokens that
    are no numbers are null, complex ones count by their real part. The width is found by a first scan."""
    lines = spark.read.text(path).select(trimmed("value").alias("line"), F.input_file_name().alias("src_file"), F.monotonically_increasing_id().alias("at")).where("line is not null")
    width = lines.agg(F.max(F.size(F.split("line", r"[ \t\r]+")))).first()[0] or 0
    return token_columns(lines, width=max(width, len(TBL_COLUMNS))).drop("line", "n_tokens")


def tbl_lines(rows: DataFrame) -> DataFrame:
    """`line`: the 35 columns as text; ids are rounded half to even, other numbers have six significant digits. Missing
    columns and nulls are 0."""

    def text(i: int, name: str) -> Column:
        value = F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)) if name in rows.columns else F.lit(0.0)
        return whole_format(value) if i + 1 in WHOLE_POSITIONS else general_format(value)

    kept = [c for c in rows.columns if c not in TBL_COLUMNS]
    return rows.select(*(F.col(f"`{k}`") for k in kept), F.concat_ws(" ", *(text(i, n) for i, n in enumerate(TBL_COLUMNS))).alias("line"))


def write_tbl(rows: DataFrame, path: str, order: str) -> None:
    """A folder of text files, sorted by `order` over all of them."""
    tbl_lines(rows.select(*(F.col(f"`{c}`") for c in rows.columns if c in TBL_COLUMNS and c != order), F.col(order).alias("_order"), *([F.col(order)] if order in TBL_COLUMNS else []))).repartitionByRange("_order").sortWithinPartitions("_order").select("line").write.mode("overwrite").text(path)


def read_vll(spark: SparkSession, path: str) -> DataFrame:
    """tomo_id (the place in the list, from 1), rlnMicrographName, tomo_path of one list file. Blank and comment lines don't count."""
    lines = spark.read.text(path).select(trimmed("value").alias("tomo_path"), F.monotonically_increasing_id().alias("at")).where("tomo_path is not null and not startswith(tomo_path, '#')")
    name = F.regexp_replace(F.regexp_replace("tomo_path", "^.*/", ""), r"(?<=.)\.[^.]*\z", "")
    return with_ordinal(lines, ["at"], "tomo_id").select((F.col("tomo_id") + 1).alias("tomo_id"), name.alias("rlnMicrographName"), "tomo_path")


def star_rows(files: DataFrame, columns: list[str], content: str = "content", place: str | None = None) -> DataFrame:
    """The rows of the particle block of each file's text, with the given columns as strings (null where a file lacks one)
    beside the other columns of `files`, and the number of the row in its block as `place`, if asked for."""
    names = [f for f in files.schema.fields if f.name != content]
    placed = [place] if place else []
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in names] + [f"`{p}` bigint" for p in placed] + [f"`{c}` string" for c in columns])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rest = [f.name for f in names]
            out = []
            for values, text in zip(pdf[rest].itertuples(index=False, name=None), pdf[content]):
                have, rows = particle_block(text or "")
                at = [have.index("_" + c) if "_" + c in have else -1 for c in columns]
                out += [(*values, *[k][: len(placed)], *(row[i] if i >= 0 else None for i in at)) for k, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=[*rest, *placed, *columns])

    return files.mapInPandas(run, schema)


def optics(files: DataFrame, content: str = "content") -> DataFrame:
    """file_id and image_size (rlnImageSizeX) of the first row of each file's optics block; null without one."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for i, text in zip(pdf["file_id"], pdf[content]):
                size = None
                for name, columns, rows in blocks(text or ""):
                    if name.lower() == "optics" and rows and "_rlnImageSizeX" in columns:
                        try:
                            size = int(float(rows[0][columns.index("_rlnImageSizeX")]))
                        except ValueError:
                            pass
                        break
                out.append((i, size))
            yield pd.DataFrame(out, columns=["file_id", "image_size"]).astype({"image_size": "Int64"})

    return files.select("file_id", content).mapInPandas(run, "file_id bigint, image_size bigint")


def read_star(spark: SparkSession, path: str) -> DataFrame:
    """The particle rows of a STAR file, or of a folder of them, with all columns that any of them has as strings, `src_file`, `at`
    (the number in its file), and size_x, size_y, size_z from the file's optics block (null without one)."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="[!._]*").select(F.input_file_name().alias("src_file"), F.col("value").alias("content"))

    def heads(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for src, text in zip(pdf["src_file"], pdf["content"]):
                size = [None] * 3
                for name, columns, rows in blocks(text or ""):
                    if name.lower() == "optics" and rows and all(f"_rlnImageSize{a}" in columns for a in "XYZ"):
                        size = [pd.to_numeric(rows[0][columns.index(f"_rlnImageSize{a}")], errors="coerce") for a in "XYZ"]
                        break
                out.append((src, [c.removeprefix("_") for c in particle_block(text or "")[0]], *size))
            yield pd.DataFrame(out, columns=["src_file", "names", "size_x", "size_y", "size_z"])

    found = files.mapInPandas(heads, "src_file string, names array<string>, size_x double, size_y double, size_z double")
    names = found.select(F.posexplode("names").alias("i", "name")).groupBy("name").agg(F.min("i").alias("i")).orderBy("i", "name").collect()
    return star_rows(files, [r["name"] for r in names], place="at").join(found.drop("names"), "src_file")


def star_text(rows: DataFrame, order: list[str]) -> DataFrame:
    """`line`s of one STAR text per partition: a particle block whose columns are those of `rows`. Values with blanks are quoted."""
    head = "\n".join(["data_particles", "", "loop_", *(f"_{c} #{i + 1}" for i, c in enumerate(rows.columns))])
    quoted = [F.when(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).rlike(r"\s|^$|^[_#'\"]"), F.concat(F.lit('"'), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'))).otherwise(F.col(f"`{c}`").cast("string")) for c in rows.columns]
    body = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws(" ", *quoted).alias("line"))

    def run(batches):
        import pandas as pd

        first = True
        for pdf in batches:
            yield pd.DataFrame({"line": [head, *pdf["line"]] if first else pdf["line"]})
            first = False

    return body.mapInPandas(run, "line string")


def write_star(rows: DataFrame, path: str, order: list[str]) -> None:
    """A folder of STAR files, each with a block of its own, sorted over all of them."""
    star_text(rows, order).write.mode("overwrite").text(path)


class StarDataSource(DataSource):
    """spark.dataSource.register(StarDataSource); spark.read.format("star").schema(...).load(folder): the particle blocks of
    the *.star files of a folder that all executors share, one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "star"

    def schema(self) -> str:
        return "tag bigint, rlnImageName string, rlnMicrographName string"

    def reader(self, schema) -> DataSourceReader:
        return _StarReader(schema, self.options["path"])


class _StarReader(DataSourceReader):
    def __init__(self, schema, path: str):
        self.fields = [(f.name, f.dataType.typeName()) for f in schema.fields]
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import os

        root = self.path.removeprefix("file://")
        names = sorted(n for n in os.listdir(root) if n.endswith(".star") and n[0] not in "._")
        return [InputPartition(os.path.join(root, n)) for n in names]

    def read(self, partition: InputPartition):
        kinds = {"string": str, "long": lambda x: int(float(x)), "integer": lambda x: int(float(x)), "double": float, "float": float}
        with open(partition.value, encoding="utf-8") as f:
            have, rows = particle_block(f.read())
        at = [have.index("_" + n) if "_" + n in have else -1 for n, _ in self.fields]
        for row in rows:
            out = []
            for i, (_, kind) in zip(at, self.fields):
                try:
                    out.append(kinds[kind](row[i]) if i >= 0 else None)
                except ValueError:
                    out.append(None)
            yield tuple(out)
