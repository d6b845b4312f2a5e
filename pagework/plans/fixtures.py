"""The input tables as DataFrames over one directory of driver parquet."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.operators.metadata import GATED
from pagework.plans.fixture_sql import SQL, fixture_text, needs
from pagework.schemas import TABLES


class Inputs:
    """Lazily defined tables; nothing is read until a query runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in SQL:
                text = fixture_text(name, "spark")
                self._made[name] = self.spark.sql(text, **{other: self[other] for other in needs(text)})
            else:
                self._made[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    @property
    def docs(self) -> DataFrame:
        return self["docs"]

    @property
    def pages(self) -> DataFrame:
        return self["doc_pages"]

    @property
    def images(self) -> DataFrame:
        return self["page_images"]

    @cached_property
    def manifest(self) -> DataFrame:
        """Each document's pages as one output in page order."""
        return self.pages.select(
            "doc_id",
            F.concat("base", F.lit(".pdf")).alias("output_name"),
            F.col("page_no").alias("out_no"),
            "page_no",
            "rotation",
        )

    @cached_property
    def organize_requests(self) -> DataFrame:
        return with_page_order(self["organize_texts"]).drop("order_text")

    @cached_property
    def tool_requests(self) -> DataFrame:
        return with_page_order(self["tool_requests"]).drop("order_text")

    @cached_property
    def documents_with_info(self) -> DataFrame:
        """Metadata in its raw form: Info dictionary as a map without absent keys, and the XMP packet."""
        keys = {
            "Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator",
            "Producer": "producer", "CreationDate": "creation_date", "ModDate": "mod_date", "Authors": "alt_authors",
            "SourceApplication": "alt_source_application", "PDFProducer": "alt_pdf_producer",
        }
        entries = F.map_from_arrays(
            F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(c) for c in keys.values()])
        )
        return self["raw_metadata"].select(
            "doc_id", F.map_filter(entries, lambda _, v: v.isNotNull()).alias("info"), "xmp", "page_count"
        )

    @cached_property
    def metadata_edits(self) -> DataFrame:
        fields = F.struct(*[F.col(f) for f in GATED])
        return self["metadata_edits"].select("doc_id", F.when(F.col("given"), fields).alias("metadata"))


def with_page_order(requests: DataFrame) -> DataFrame:
    """``order_text`` such as ``2:90;1:0`` as the array the organize operator reads."""

    def instruction(text):
        parts = F.split(text, ":")
        return F.struct(
            F.get(parts, F.lit(0)).try_cast("int").alias("page_number"), F.get(parts, F.lit(1)).try_cast("int").alias("rotation")
        )

    return requests.withColumn("page_order", F.transform(F.split("order_text", ";"), instruction))
