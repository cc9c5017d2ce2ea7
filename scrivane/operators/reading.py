"""The read side: chunk queries, byte windows, assets and manifests, and a façade with the seven tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Caps and defaults.
CHUNK_CAP, CHUNK_DEFAULT = 200, 20
TEXT_WINDOW, ASSET_WINDOW, LEAST_TEXT_WINDOW = 256 << 10, 5 << 20, 4


def query_chunks(chunks: DataFrame, query: str, limit: int | None = CHUNK_DEFAULT, offset: int = 0, order: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """A page of the chunks that contain the query, case ignored, each row with `matched` (of all) and `next_offset`.

    The page comes from a top-k of offset + limit rows, not from a sort of all matches.
    """
    if offset < 0:
        raise ValueError("offset is negative")
    limit = CHUNK_CAP if limit is None else max(1, min(limit, CHUNK_CAP))
    found = chunks.where(F.contains(F.lower("text"), F.lit(query.lower()))) if query else chunks
    total = found.agg(F.count(F.lit(1)).alias("matched"))
    page = found.orderBy(*order).offset(offset).limit(limit)
    after = F.when(F.col("matched") > offset + limit, F.lit(offset + limit)).cast("bigint")
    return page.join(F.broadcast(total)).withColumn("next_offset", after)  # one row


def window_size(limit: int | None, cap: int, text: bool) -> int:
    if limit is None:
        return cap
    if limit < (LEAST_TEXT_WINDOW if text else 1):
        raise ValueError("limit is too small")
    return min(limit, cap)


def incomplete_tail(data: Column) -> Column:
    """Bytes at the end of a binary that begin a UTF-8 character without ending it (0 to 3)."""
    n = F.octet_length(data)
    byte = lambda back: F.conv(F.hex(F.substring(data, n - (back - 1), F.lit(1))), 16, 10).cast("int")
    lead = lambda back, least: (n >= back) & (byte(back) >= least)
    return F.when(lead(1, 0xC0), 1).when(lead(2, 0xE0), 2).when(lead(3, 0xF0), 3).otherwise(0)


def byte_window(content: Column, offset: int, window: int, text: bool = True) -> Column:
    """struct<data, next_offset>: a slice of a binary; text slices end on whole characters; a null data refuses the offset."""
    size = F.octet_length(content)
    raw = F.substring(content, F.lit(offset + 1), F.lit(window))
    cut = F.when(F.lit(text) & (size > offset + window), F.substring(raw, F.lit(1), F.octet_length(raw) - incomplete_tail(raw))).otherwise(raw)
    end = offset + F.octet_length(cut)
    good = F.lit(offset >= 0) & (F.lit(offset) <= size)
    return F.struct(F.when(good, cut).alias("data"), F.when(good & (end < size), end.cast("bigint")).alias("next_offset"))


def asset_list(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def chunk_projection(lines: DataFrame, column: str = "value") -> DataFrame:
    """Chunk records of JSON lines: of the strict form, else of what older records have; unreadable lines keep their number and are flagged."""
    strict = "id string, text string, meta struct<doc_items:array<string>,headings:array<string>,kind:string,page:int,locator:string,sha256:string>"
    old = "id string, text string, heading_path array<string>, sha256 string"
    rows = lines.withColumn("s", F.from_json(column, strict)).withColumn("o", F.from_json(column, old))
    return rows.select(
        *[c for c in lines.columns if c != column], F.coalesce("s.id", "o.id").alias("chunk_id"), F.coalesce("s.text", "o.text").alias("text"),
        F.coalesce("s.meta.headings", "o.heading_path").alias("headings"), F.coalesce("s.meta.sha256", "o.sha256").alias("sha256"), F.coalesce("s.meta.kind", F.lit("text")).alias("kind"), F.col("o.id").isNull().alias("unreadable"),
    )


class Library:
    """Bundles as tables, with the tools of a reading service. Arguments that are not declared are refused by Python itself."""

    TOOLS = ("capture", "read_markdown", "query_chunks", "get_manifest", "list_assets", "read_asset", "doctor")

    def __init__(self, spark: SparkSession, roots: tuple[str, ...] = (), allow_private: bool = False):
        self.spark, self.roots, self.allow_private = spark, roots, allow_private
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def capture(self, pages: DataFrame) -> dict[str, DataFrame]:
        """Pages (page_id, url, html) to Markdown, chunks, assets and a manifest."""
        from scrivane.operators import chunks as K
        from scrivane.operators import pages as P

        blocks = P.block_rows(pages)
        chunks = K.contextual_records(K.section_seeds(blocks))
        parsed = pages.select("page_id", "url", P.markdown(F.col("html")).alias("markdown"), P.metadata(F.col("html")).alias("metadata"))
        assets = pages.select("page_id", F.explode(P.visuals(F.col("html"))).alias("v")).select("page_id", "v.*")
        counts = chunks.groupBy("page_id").agg(F.count(F.lit(1)).alias("chunks"))
        manifest = parsed.join(counts, "page_id", "left").select("page_id", "url", "metadata", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.sha2("markdown", 256).alias("sha256"), F.lit(True).alias("untrusted"))
        for name, df in (("markdown", parsed), ("chunks", chunks), ("assets", assets), ("manifest", manifest)):
            self.register(name, df)
        return self.tables

    def read_markdown(self, page_id: int, offset: int = 0, limit: int | None = None) -> DataFrame:
        w = byte_window(F.col("markdown").cast("binary"), offset, window_size(limit, TEXT_WINDOW, True))
        return self.tables["markdown"].where(F.col("page_id") == page_id).select(w.alias("w")).select(F.col("w.data").cast("string").alias("text"), "w.next_offset")

    def query_chunks(self, query: str = "", limit: int | None = CHUNK_DEFAULT, offset: int = 0) -> DataFrame:
        return query_chunks(self.tables["chunks"], query, limit, offset, ("page_id", "chunk_id"))

    def get_manifest(self, page_id: int) -> DataFrame:
        return self.tables["manifest"].where(F.col("page_id") == page_id)

    def list_assets(self, page_id: int) -> DataFrame:
        return self.tables["assets"].where(F.col("page_id") == page_id)

    def read_asset(self, files: DataFrame, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
        w = byte_window(F.col("content"), offset, window_size(limit, ASSET_WINDOW, False), text=False)
        return files.where(F.col("path") == path).select(w.alias("w")).select(F.base64("w.data").alias("data"), "w.next_offset")

    def doctor(self) -> DataFrame:
        import importlib.util
        import sys

        checks = [("python", "required", sys.version_info >= (3, 10)), ("pyarrow", "required", importlib.util.find_spec("pyarrow") is not None), ("charset_normalizer", "optional", importlib.util.find_spec("charset_normalizer") is not None)]
        return self.spark.createDataFrame(checks, "check string, need string, passed boolean")
