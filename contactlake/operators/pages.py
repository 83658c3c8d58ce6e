"""Page parsing over Arrow batches: one pass builds each page's tree and yields all facts asked for, in a total order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

import contactlake.functions
from contactlake.functions import dom

# the parser travels to executors with the task
cloudpickle.register_pickle_by_value(contactlake.functions)

SCHEMA = "page_id long, stage int, pos int, kind string, name string, title string, email string, phone string, link string, value string"


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, a few tasks for each, where fewer partitions hold them; larger inputs stay where they lie.

    A file's partitions needn't hold rows, or equally many, and a task of Python takes far longer than reading its rows.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def parsed(pages: DataFrame, *stages: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, stage, pos, kind, name, title, email, phone, link, value) of the stages' finds; stage and pos order them."""
    work = [(i, dom.STAGES[s]) for i, s in enumerate(stages)]
    tree, fields = dom.tree, len(dom.FIELDS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32()] + [pa.string()] * fields
        names = ["page_id", "stage", "pos", "kind", "name", "title", "email", "phone", "link", "value"]
        for batch in it:
            out = []
            for page, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = tree(source or "")
                for stage, find in work:
                    out += [(page, stage, pos, *row) for pos, row in enumerate(find(root))]
            columns = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))).mapInArrow(run, SCHEMA)


#: What a stage tells of its finds, where it tells less than all.
TOLD = {"structured": ("kind", "name", "title", "email", "phone", "link", "value"), "cards": ("name", "title", "email", "phone", "link"), "class_cards": ("name", "title", "email"), "blocks": ("value",), "links": ("kind", "link")}


def register_page_facts(spark: SparkSession, name: str = "page_facts") -> None:
    """Makes the table function `page_facts(TABLE(pages), stage)` callable from SQL.

    It takes any table with a column html and gives all its other columns and pos, then what the stage tells of each find: rows by
    page and pos. An unknown stage, a table without html or one whose columns clash with those added is refused when the query is analysed. A null
    html has no finds.
    """
    tree, stages, fields, told = dom.tree, dom.STAGES, dom.FIELDS, TOLD

    class PageFacts:
        @staticmethod
        def analyze(pages: AnalyzeArgument, stage: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable or "html" not in pages.dataType.names:
                raise ValueError("page_facts needs a table with a column html")
            if stage.value not in told:
                raise ValueError(f"page_facts knows {', '.join(sorted(told))}; not {stage.value}")
            kept = [f for f in pages.dataType.fields if f.name != "html"]
            added = StructType().add("pos", "integer")
            for field in told[stage.value]:
                added.add(field, "string")
            if clash := {f.name for f in kept} & set(added.names):
                raise ValueError(f"page_facts adds {', '.join(sorted(clash))} itself")
            return AnalyzeResult(StructType(kept + added.fields))

        def eval(self, page: Row, stage: str):
            kept = [v for k, v in page.asDict().items() if k != "html"]
            at = [fields.index(f) for f in told[stage]]
            for pos, found in enumerate(stages[stage](tree(page["html"] or ""))):
                yield (*kept, pos, *[found[i] for i in at])

    spark.udtf.register(name, udtf(PageFacts))


def mapped(rows: DataFrame, key: str, value: str, f, schema: str) -> DataFrame:
    """(key, …) of each tuple that f gives for a row's value; schema names the rest."""
    cols = [x.split()[0] for x in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [(k, *r) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in f(v)]
            columns = list(zip(*out, strict=True)) if out else [()] * (len(cols) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], [key, *cols])

    return rows.select(F.col(key).cast("long").alias(key), F.col(value).alias(value)).mapInArrow(run, f"{key} long, {schema}")
