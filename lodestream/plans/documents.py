"""Parsed documents made of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AT = "struct<source_file:string,page:int,section:string,table_id:string,figure_id:string,row_index:int,extraction_method:string,confidence:double>"
_BLOCKS = f"array<struct<text:string,source:{_AT}>>"
_TABLES = f"array<struct<table_id:string,rows:array<array<string>>,source:{_AT}>>"


def source(name: Column, page: int, table: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        name.alias("source_file"), F.lit(page).alias("page"), none.alias("section"), F.lit(table).cast("string").alias("table_id"), none.alias("figure_id"), F.lit(None).cast("int").alias("row_index"),
        F.lit("rendered").alias("extraction_method"), F.lit(0.9).alias("confidence"),
    )


def parsed(d: DataFrame, name: Column, pages: list[Column], rows: Column) -> DataFrame:
    """Parsed documents of these pages and one table; rows: array<array<string>>, null for no table."""
    blocks = F.array(*[F.struct(p.alias("text"), source(name, i).alias("source")) for i, p in enumerate(pages, 1)])
    tables = F.when(rows.isNotNull(), F.array(F.struct(F.lit("p1_t1").alias("table_id"), rows.alias("rows"), source(name, 1, "p1_t1").alias("source"))))
    blocks, empty = (blocks if pages else F.array()).cast(_BLOCKS), F.array().cast(_TABLES)
    return d.select(name.alias("source_file"), F.lit(len(pages)).alias("page_count"), F.create_map().cast("map<string,string>").alias("metadata"), blocks.alias("text_blocks"), F.coalesce(tables, empty).alias("tables"))
