"""OCR responses: blocks and relationships to nodes of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "struct<Left:double,Top:double,Width:double,Height:double>"
BLOCK = (
    f"struct<Id:string,BlockType:string,Page:int,Text:string,RowIndex:int,ColumnIndex:int,RowSpan:int,ColumnSpan:int,"
    f"SelectionStatus:string,EntityTypes:array<string>,Confidence:double,Geometry:struct<BoundingBox:{BOX}>,Relationships:array<struct<Type:string,Ids:array<string>>>>"
)
RESPONSE = f"JobStatus string, DocumentMetadata struct<Pages:int>, Warnings array<struct<ErrorCode:string,Pages:array<int>>>, Blocks array<{BLOCK}>"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response file; unknown shapes fail."""
    table = spark.read.schema(RESPONSE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return table.withColumn("doc_id", F.input_file_name())


def blocks(responses: DataFrame) -> DataFrame:
    """All blocks with their place in the response."""
    out = responses.select("doc_id", F.posexplode("Blocks").alias("position", "b")).select("doc_id", "position", "b.*")
    return out.withColumn("Page", F.coalesce("Page", F.lit(1)))


def edges(table: DataFrame, *more: str) -> DataFrame:
    """Child relationships: doc_id, parent, child, order, and ``more`` columns of the parents."""
    rel = table.select("doc_id", F.col("Id").alias("parent"), *more, F.explode("Relationships").alias("r")).filter("r.Type = 'CHILD'")
    return rel.select("doc_id", "parent", *more, F.posexplode("r.Ids").alias("order", "child"))


def mark(kind: Column, status: Column) -> Column:
    """The sign of a selection mark, as it is set."""
    return F.when(kind == "SELECTION_ELEMENT", F.when(status == "SELECTED", "☒").otherwise("☐"))


def texts(table: DataFrame) -> DataFrame:
    """doc_id, Id and the text of each block: its own, or its children's in order."""
    own = table.select("doc_id", F.col("Id").alias("child"), F.coalesce("Text", mark(F.col("BlockType"), F.col("SelectionStatus"))).alias("t"))
    joined = edges(table).join(own, ["doc_id", "child"]).filter("t is not null")
    inner = joined.groupBy("doc_id", F.col("parent").alias("Id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "t"))), lambda x: x["t"]), " ").alias("inner")
    )
    return table.select("doc_id", "Id", "Text").join(inner, ["doc_id", "Id"], "left").select(
        "doc_id", "Id", F.coalesce("Text", "inner", F.lit("")).alias("text")
    )


def cell_grid(table: DataFrame) -> DataFrame:
    """Cells of tables with table_id, merge_id (their own id where they are not merged) and whether they have own text."""
    grid = table.filter("BlockType = 'CELL'").select("doc_id", "Page", "Id", "RowIndex", "ColumnIndex", "RowSpan", "ColumnSpan", F.col("Text").isNotNull().alias("own"))
    of = lambda kind, name: edges(table.filter(F.col("BlockType") == kind)).select("doc_id", F.col("parent").alias(name), F.col("child").alias("Id"))
    grid = grid.join(of("TABLE", "table_id"), ["doc_id", "Id"]).join(of("MERGED_CELL", "merge_id"), ["doc_id", "Id"], "left")
    return grid.withColumn("merge_id", F.coalesce("merge_id", "Id"))


def merged_cells(grid: DataFrame, *more: Column) -> DataFrame:
    """Of the cells that are merged into one its anchor and spans; ``more`` are other aggregates."""
    end = lambda i, s: F.max(F.col(i) + F.coalesce(s, F.lit(1)) - 1)
    out = grid.groupBy("doc_id", "Page", "table_id", "merge_id").agg(
        F.min("RowIndex").alias("row"), F.min("ColumnIndex").alias("column"), end("RowIndex", "RowSpan").alias("_r"), end("ColumnIndex", "ColumnSpan").alias("_c"), *more
    )
    out = out.withColumn("row_span", F.col("_r") - F.col("row") + 1).withColumn("column_span", F.col("_c") - F.col("column") + 1)
    return out.drop("_r", "_c")


def cells(table: DataFrame) -> DataFrame:
    """Cells of tables in row-major order with their text; cells merged into one keep its anchor alone."""
    grid = cell_grid(table).join(texts(table), ["doc_id", "Id"])
    out = merged_cells(grid, F.array_sort(F.collect_list(F.struct("RowIndex", "ColumnIndex", "text"))).alias("parts"))
    said = F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), " ")
    return out.withColumn("text", said).drop("parts")


def uncovered_lines(table: DataFrame) -> DataFrame:
    """Lines of no layout block and no table cell, in geometric order."""
    of = edges(table)
    owners = table.filter(F.col("BlockType").startswith("LAYOUT") | F.col("BlockType").isin("CELL", "TABLE")).select("doc_id", F.col("Id").alias("parent"))
    direct = of.join(owners, ["doc_id", "parent"]).select("doc_id", F.col("child").alias("Id"))
    words = of.join(direct.withColumnRenamed("Id", "child"), ["doc_id", "child"], "left_semi").select("doc_id", F.col("parent").alias("Id"))
    lines = table.filter("BlockType = 'LINE'").join(direct.unionByName(words).distinct(), ["doc_id", "Id"], "left_anti")
    w = Window.partitionBy("doc_id", "Page").orderBy("Geometry.BoundingBox.Top", "Geometry.BoundingBox.Left", "position")
    return lines.withColumn("rank", F.row_number().over(w))


def node_ids(table: DataFrame, version: str = "1") -> DataFrame:
    """A stable name for each node from document, version, page and path."""
    material = F.concat_ws("\0", "doc_id", F.lit(version), F.col("page_number").cast("string"), "path")
    return table.withColumn("node_id", F.concat(F.lit("node_"), F.substring(F.sha2(material, 256), 1, 32)))


def violations(responses: DataFrame, most_pages: int = 3000) -> DataFrame:
    """Responses that may not be converted, with the reason."""
    pages = F.array_distinct(F.transform("Blocks", lambda b: F.coalesce(b["Page"], F.lit(1))))
    reason = (
        F.when(~F.coalesce(F.col("JobStatus").isin("SUCCEEDED", "PARTIAL_SUCCESS"), F.lit(False)), "INVALID_STATUS")
        .when(F.coalesce(F.size("Blocks"), F.lit(0)) <= 0, "NO_BLOCKS")
        .when(F.col("DocumentMetadata.Pages") > most_pages, "TOO_MANY_PAGES")
        .when(F.size(pages) > F.col("DocumentMetadata.Pages"), "PAGE_MISMATCH")
        .when(F.size(F.array_distinct(F.transform("Blocks", lambda b: b["Id"]))) < F.size("Blocks"), "DUPLICATE_BLOCK")
    )
    return responses.withColumn("violation", reason).filter("violation is not null").select("doc_id", "violation")
