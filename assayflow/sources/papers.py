"""Reading papers, blocks, records, gold rows and configuration. All listing and reading is Spark's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import normal_doi
from ..schema import BLOCK

DOI = r"10\.\d{4,}/[^\s\"'<>]+"


def _paper(path: Column) -> Column:
    """The folder that a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def paper_dirs(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """paper_name of each folder with a content list, by name (O-S1)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_content_list.json").option("recursiveFileLookup", "true").load(root)
    names = files.select(_paper(F.col("path")).alias("paper_name")).distinct().orderBy("paper_name")
    return names.limit(limit) if limit is not None else names


def all_dirs(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """paper_name of each folder that holds any file, by name (O-S1)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    inside = F.element_at(F.split("path", root.rstrip("/").rpartition("/")[2] + "/", 2), -1)
    names = files.where(inside.contains("/")).select(F.split(inside, "/")[0].alias("paper_name")).distinct().orderBy("paper_name")
    return names.limit(limit) if limit is not None else names


def not_done(papers: DataFrame, outputs: DataFrame) -> DataFrame:
    """Papers without both a JSON and a CSV output. outputs: paper_name, kind (O-S2)."""
    done = outputs.where(F.col("kind").isin("json", "csv")).groupBy("paper_name").agg(F.count_distinct("kind").alias("n")).where("n = 2")
    return papers.join(done, "paper_name", "left_anti")


def full_texts(spark: SparkSession, root: str) -> DataFrame:
    """paper_name, text of each full.md (O-S3); join papers to it from the left, so one without the
    file has null text and is not skipped."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "full.md").load(root)
    return files.select(_paper(F.col("_metadata.file_path")).alias("paper_name"), F.col("value").alias("text"))


def content_blocks(spark: SparkSession, root: str) -> DataFrame:
    """paper_name, block_id and the block's fields, from lists or {"content": lists} (O-S4)."""
    files = (
        spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_content_list.json").load(root)
    )
    rows = files.select(_paper(F.col("_metadata.file_path")).alias("paper_name"), F.col("value"))
    return blocks_from_json(rows, "value")


def blocks_from_json(rows: DataFrame, col: str) -> DataFrame:
    """posexplode of a JSON list of blocks; a caption may be a text or a list."""
    plain = F.from_json(F.col(col), "array<string>")
    wrapped = F.from_json(F.get_json_object(F.col(col), "$.content"), "array<string>")
    is_list = F.col(col).rlike(r"(?s)\A\s*\[")
    items = F.when(is_list, plain).otherwise(wrapped)
    one = rows.select(*[c for c in rows.columns if c != col], F.posexplode(items).alias("block_id", "j"))
    fields = []
    for f in BLOCK.split(", "):
        name, kind = f.split(" ")
        value = F.get_json_object("j", f"$.{name}")
        if kind == "array<string>":
            value = F.when(value.rlike(r"(?s)\A\s*\["), F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value))
        elif name in ("text", "content", "body", "para"):
            value = F.when(value.rlike(r"(?s)\A\s*\["), F.coalesce(F.array_join(F.from_json(value, "array<string>"), " "), value)).otherwise(value)
        fields.append(value.alias(name))
    return one.select(*[c for c in one.columns if c != "j"], *fields)


def resolve_doi(papers: DataFrame, blocks: DataFrame, first: int = 50) -> DataFrame:
    """paper_name, doi: the metadata's, else the first found in the leading text blocks that don't look
    like references, else the folder's name (O-S5). papers: paper_name, meta_doi."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    found = F.regexp_replace(F.regexp_extract(text, DOI, 0), r"[.,;) ]+$", "")
    reference = F.lower(text).rlike(r"^\s*(\[\d+\]|\d+\.\s)|^references|et al\.")
    rows = blocks.where((F.col("block_id") < first) & F.col("type").isin("text", "discarded") & ~reference & found.rlike(r"^10\.\d{4,}/"))
    firsts = rows.groupBy("paper_name").agg(F.min_by(found, "block_id").alias("d"))
    return papers.join(firsts, "paper_name", "left").select(
        "paper_name", F.coalesce(F.nullif("meta_doi", F.lit("")), "d", "paper_name").alias("doi")
    )


def doi_from_name(name: Column) -> Column:
    """The older rule: the first underscore of a folder's name is a slash, unless it starts with paper_."""
    return F.when(name.startswith("paper_"), name).otherwise(F.regexp_replace(name, r"^([^_]*)_", "$1/"))


def metadata(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").load(root)
    return files.select(_paper(F.col("_metadata.file_path")).alias("paper_name"), F.get_json_object("value", "$.doi").alias("meta_doi"))


# Columns of a gold sheet.
GOLD = {
    "Enzyme": "enzyme_name", "Substrate": "substrate", "Organism": "organism", "Km (μM)": "Km_value",
    "kcat (s⁻¹)": "kcat_value", "kcat/Km (M⁻¹s⁻¹)": "kcat_Km_value", "Degrad. %": "degradation_efficiency",
    "Source DOI": "doi",
}


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet, row by row, as texts."""
    import zipfile
    from io import BytesIO
    from xml.etree import ElementTree

    with zipfile.ZipFile(BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            strings = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in strings.iter(f"{_SHEET}si")]
        first = min((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        sheet = ElementTree.fromstring(book.read(first))
    out = []
    for row in sheet.iter(f"{_SHEET}row"):
        cells: dict[int, str | None] = {}
        for cell in row.iter(f"{_SHEET}c"):
            column = 0
            for ch in cell.get("r", "A1").rstrip("0123456789"):
                column = 26 * column + ord(ch) - 64
            value = cell.find(f"{_SHEET}v")
            if cell.get("t") == "s":
                text = shared[int(value.text)] if value is not None else None
            elif cell.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            else:
                text = None if value is None else value.text
            cells[column - 1] = text
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of one workbook, its first row as header; a sheet is small (a million rows at most)."""
    (file,) = spark.read.format("binaryFile").load(path).select("content").collect()
    header, *rows = sheet_rows(bytes(file[0]))
    names = [x if x is not None else f"_{i}" for i, x in enumerate(header)]
    rows = [[*r[: len(names)], *[None] * (len(names) - len(r))] for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def gold_rows(spark: SparkSession, path: str) -> DataFrame:
    """A gold sheet as XLSX, CSV (header trimmed) or Parquet, in record names, with rec_idx in file order
    of each DOI (O-S6)."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    raw = read_sheet(spark, path) if kind == "xlsx" else spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", "true").csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns]).withColumn("__o", F.monotonically_increasing_id())
    cols = [(F.col(f"`{old}`") if old in raw.columns else F.lit(None).cast("string")).alias(new) for old, new in GOLD.items()]
    rows = raw.select("__o", *cols).withColumn("doi", normal_doi(F.col("doi"))).where("doi != ''")
    return rows.withColumn("rec_idx", F.row_number().over(Window.partitionBy("doi").orderBy("__o")) - 1).drop("__o")


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """paper_name, rec_idx, record (JSON text) of {paper: [records]} files (O-S7)."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    papers = files.select(F.explode(F.from_json("value", "map<string,string>")).alias("paper_name", "j"))
    return papers.select("paper_name", F.posexplode(F.from_json("j", "array<string>")).alias("rec_idx", "record"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """paper_name, name, mime, base64 of images (O-S10)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,webp}").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    mime = F.when(kind.isin("jpg", "jpeg"), "image/jpeg").otherwise(F.concat(F.lit("image/"), kind))
    return files.select("path", name.alias("name"), mime.alias("mime"), F.base64("content").alias("base64"))


def image_path(folder: Column) -> Column:
    """A block's image: as named, else by its base name in the images folder."""
    given = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("img_path", "image_path", "table_img", "table_image")])
    inside = F.concat(folder, F.lit("/images/"), F.element_at(F.split(given, "/"), -1))
    return F.when(given.startswith("/"), given).when(given.isNotNull(), inside)


def scaled_size(width: Column, height: Column, most: int = 1024) -> Column:
    """struct(width, height) that an image is scaled to: only wider ones; the longer side to most."""
    small = width <= most
    wide = width >= height
    return F.when(small, F.struct(width.alias("width"), height.alias("height"))).otherwise(
        F.struct(
            F.when(wide, F.lit(most)).otherwise((width * most / height).cast("int")).alias("width"),
            F.when(wide, (height * most / width).cast("int")).otherwise(F.lit(most)).alias("height"),
        )
    )


@dataclass(frozen=True)
class Settings:
    """What a configuration file sets (O-S8)."""

    models: tuple[str, ...] = ()
    min_votes: int = 2
    km_tolerance: float = 0.1
    strict: bool = False
    min_toxins: int = 1
    min_kinetics: int = 2

    @staticmethod
    def load(path: str) -> Settings:
        import json

        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(text) or {}
        else:
            found = json.loads(text)
        return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in Settings.__annotations__})
