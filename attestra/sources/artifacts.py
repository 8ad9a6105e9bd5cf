"""Case artifacts: files by content hash, manifest integrity, fields of specs, and the layout of pages as tables of glyphs and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files of a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def prompt_text(spark: SparkSession, path: str) -> DataFrame:
    """(text): a file as one text without blanks at its end."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\s+$", "").alias("text"))


def json_or_null(text: Column, schema: str) -> Column:
    """A JSON text as a struct; null where it does not parse."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def slug(text: Column) -> Column:
    """Lower case runs of letters and digits, joined by hyphens."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "-")


def inside(path: Column) -> Column:
    """Whether a path is relative, not empty, and stays under its root, whatever it goes up in between."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")))
    return F.coalesce((F.trim(path) != "") & ~path.startswith("/") & (depth["low"] >= 0), F.lit(False))


def manifest_violations(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(id, rule, subject): empty or repeated ids, artifacts that leave the root, and those that no row of ``files(path)`` has."""
    told = lambda df, rule, subject: df.select("id", F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
    kinds = ("pdf", "gold", "spec", "facts")
    wanted = cases.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("path")) for k in kinds))).alias("a")).select("id", "a.kind", "a.path")
    empty = told(cases.where("coalesce(trim(id), '') = ''"), "empty id", F.col("title"))
    twice = told(cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "id repeats", F.col("n"))
    out = told(wanted.where(~inside(F.coalesce("path", F.lit("")))), "leaves the root", F.col("kind"))
    gone = told(wanted.where(inside(F.coalesce("path", F.lit("")))).join(files.select("path").distinct(), "path", "left_anti"), "is missing", F.col("path"))
    return empty.unionByName(twice).unionByName(out).unionByName(gone)


def spec_field(text: Column, name: str) -> Column:
    """The value of a spec's ``Name: value`` line without code marks; null where there is none."""
    value = F.replace(F.trim(F.regexp_extract(text, rf"(?im)^\Q{name}\E\s*:\s*(.+)$", 1)), F.lit("`"), F.lit(""))
    return F.when(value != "", value)


def spec_list(text: Column, name: str) -> Column:
    return F.filter(F.transform(F.split(spec_field(text, name), ","), lambda x: F.trim(x)), lambda x: x != "")


def case_metadata(cases: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, title, family, tags, pages, purpose, modality): what a spec says of its case, else the manifest, else a plain text; ``specs(id, text)``."""
    rows = cases.join(specs.select("id", F.col("text").alias("_t")), "id", "left")
    said = lambda *names: [spec_field(F.col("_t"), n) for n in names]
    return rows.select(
        "id",
        F.coalesce(*said("Report title"), "title").alias("title"),
        F.coalesce(*said("Report category"), "family").alias("family"),
        F.coalesce(spec_list(F.col("_t"), "Report capabilities"), "tags").alias("tags"),
        F.coalesce("pages", F.lit(0)).alias("pages"),
        F.coalesce(*said("Report summary", "Purpose"), F.concat(F.lit("Faithful reconstruction of "), "title")).alias("purpose"),
        F.coalesce(*said("Modality profile", "Source modality"), F.lit("not told")).alias("modality"),
    )


def output_pages(anchors: DataFrame) -> DataFrame:
    """(case_id, pages): the last page that a candidate is asked for; ``anchors(case_id, page, document_page)``, the document's own page first."""
    return anchors.groupBy("case_id").agg(F.max(F.coalesce("document_page", "page")).alias("pages"))


def page_layout(pages: DataFrame, glyphs: DataFrame, images: DataFrame) -> DataFrame:
    """(case_id, page, native, image, raster, tiny, outside, coarse) of every page, from its glyphs and images.

    ``pages(case_id, page, width, height)``, ``glyphs(case_id, page, text, size, x0, x1, top, bottom)``, ``images(case_id, page, x0, x1, y0, y1, px,
    py)``. Tiny glyphs are under 5.5 points; things lie outside by over half a point; an image under 120 dots an inch is coarse, one of 0.9 of the page makes it a raster.
    """
    by = ["case_id", "page"]
    area = pages.select(*by, F.col("width").alias("_w"), F.col("height").alias("_h"))
    g = glyphs.join(area, by)
    out = (F.col("x0") < -0.5) | (F.col("x1") > F.col("_w") + 0.5) | (F.col("top") < -0.5) | (F.col("bottom") > F.col("_h") + 0.5)
    g = g.groupBy(*by).agg(F.count("*").alias("_glyphs"), F.count_if((F.col("size") < 5.5) & (F.trim("text") != "")).alias("tiny"), F.count_if(out).alias("_go"))
    i = images.join(area, by).withColumns({"_x": F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")), "_y": F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))})
    off = (F.col("x0") < -0.5) | (F.col("x1") > F.col("_w") + 0.5) | (F.col("y0") < -0.5) | (F.col("y1") > F.col("_h") + 0.5)
    dots = F.least(F.try_divide(F.col("px") * 72, F.col("_x")), F.try_divide(F.col("py") * 72, F.col("_y")))
    i = i.groupBy(*by).agg(F.count("*").alias("_images"), F.count_if(off).alias("_io"), F.count_if((F.col("_x") > 0) & (F.col("_y") > 0) & (dots < 120)).alias("coarse"), F.bool_or(F.col("_x") * F.col("_y") >= F.col("_w") * F.col("_h") * 0.9).alias("raster"))
    rows, zero = pages.select(*by).join(g, by, "left").join(i, by, "left"), lambda c: F.coalesce(c, F.lit(0))
    return rows.select(*by, (zero("_glyphs") > 0).alias("native"), (zero("_images") > 0).alias("image"), F.coalesce("raster", F.lit(False)).alias("raster"), zero("tiny").alias("tiny"), (zero("_go") + zero("_io")).alias("outside"), zero("coarse").alias("coarse"))


def layout_tallies(layout: DataFrame) -> DataFrame:
    """(case_id, native_text_pages, image_pages, full_page_raster_pages)."""
    return layout.groupBy("case_id").agg(*(F.count_if(c).alias(n) for c, n in (("native", "native_text_pages"), ("image", "image_pages"), ("raster", "full_page_raster_pages"))))
