"""Bundles of pasted text and images: JSON documents whose text has markers where the images stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chunking import outline_blocks, outline_paths

# The version of bundles, the marker of an image in their text (its label and its id), and the characters of text kept on either side of an image.
VERSION, MARKER, BESIDE = 1, r"!\[([^\]]*)\]\(clipboard-image://([A-Za-z0-9._-]+)\)", 500
BUNDLE = "version int, content string, images array<struct<id:string,data:string,mimeType:string,filename:string,alt:string,description:string>>"


def _beside(parts: Column, last: bool) -> Column:
    """For each part of a text but the last one, what ends (last) or begins there: the text up to its end, or from its end on, as words between single spaces, cut to BESIDE characters next to the image. A fold that
    carries little more than those characters along the parts."""
    keep, space = BESIDE + 2, F.lit(" ")
    cut = lambda t: F.right(t, F.lit(keep)) if last else F.left(t, F.lit(keep))
    join = lambda near, far: F.regexp_replace(F.concat(near, far) if last else F.concat(far, near), r"\s+", " ")

    def shown(t: Column) -> Column:
        whole = F.char_length(t) < keep  # then the outer end of the text is in it, too
        inner = F.rtrim(t, space) if last else F.ltrim(t, space)
        few = F.when(whole, F.trim(t, space)).otherwise(inner)
        return F.right(few, F.lit(BESIDE)) if last else F.left(few, F.lit(BESIDE))

    ordered = parts if last else F.reverse(parts)
    start = F.struct(F.lit("").alias("t"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(ordered, start, lambda a, p: F.struct(cut(join(a["t"], p)).alias("t"), F.array_append(a["out"], cut(join(a["t"], p))).alias("out")), lambda a: a["out"])
    each = F.transform(walked, shown)
    return F.slice(each, F.lit(1), F.size(parts) - 1) if last else F.reverse(F.slice(each, F.lit(1), F.size(parts) - 1))


def bundle_blocks(bundles: DataFrame, key: str, bundle: str) -> DataFrame:
    """key, block, kind, level, content, path, image, char_offset, before, after, embedding_text of bundles (key, bundle: JSON).

    The text is cut at the markers of images that the bundle has (other markers go, too); each part is parsed as Markdown of its own, and the outline is handed on: a heading stands under the headings of the parts before
    it, another block under its own part's headings or, before the first of those, under what was handed on. An image block has up to BESIDE characters of text on both sides; images without a marker follow at
    the end, in their order. Of images with one id the last one counts. Bundles of another version, and those that are no JSON or have an image without id, have no blocks.
    """
    read = bundles.select(key, F.from_json(bundle, BUNDLE).alias("_b")).filter((F.col("_b.version") == VERSION) & ~F.coalesce(F.exists("_b.images", lambda i: F.coalesce(i["id"], F.lit("")) == ""), F.lit(False)))
    text = F.coalesce("_b.content", F.lit(""))
    some = read.select(key, text.alias("_t"), F.coalesce("_b.images", F.array().cast("array<struct<id:string,data:string,mimeType:string,filename:string,alt:string,description:string>>")).alias("_images"))
    some = some.withColumn("_parts", F.split("_t", MARKER, -1)).withColumn("_labels", F.regexp_extract_all("_t", F.lit(MARKER), F.lit(1))).withColumn("_ids", F.regexp_extract_all("_t", F.lit(MARKER), F.lit(2))).withColumn("_whole", F.regexp_extract_all("_t", F.lit(MARKER), F.lit(0)))

    # text: every part is a document of its own
    part = F.to_json(F.struct(F.col(key).alias("k"), F.col("_p").alias("p")))
    parts = some.select(key, F.posexplode("_parts").alias("_p", "text")).withColumn("_part", part)
    own = outline_paths(outline_blocks(parts, "_part", "text"), "_part").withColumnRenamed("path", "_own")
    blocks = own.join(parts.select("_part", key, "_p"), "_part").select(key, "_p", F.col("block").alias("_n"), "kind", "level", "content", "_own", *[F.lit(None).cast(t).alias(c) for c, t in _IMAGE])

    # images: those with markers stand behind the part of the same number, the others behind all
    numbered = some.select(key, F.posexplode("_images").alias("_i", "_image"))
    known = numbered.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_image.id").orderBy(F.desc("_i")))).filter("_r = 1").select(key, F.col("_image.id").alias("_id"), F.col("_i"), "_image")
    lengths = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.char_length(x))
    spots = F.transform("_ids", lambda x, i: F.struct(x.alias("id"), i.alias("p"), F.get("_labels", i).alias("label"), (lengths(F.col("_parts"), i + 1) + lengths(F.col("_whole"), i)).alias("at"), F.get("_before", i).alias("before"), F.get("_after", i).alias("after")))
    around = some.withColumn("_before", _beside(F.col("_parts"), True)).withColumn("_after", _beside(F.col("_parts"), False)).select(key, F.explode(spots).alias("_s")).select(key, F.col("_s.id").alias("_id"), "_s.*").drop("id")
    marked = around.join(known, [key, "_id"])
    end = some.select(key, F.size("_parts").alias("p"), F.char_length("_t").alias("at"), F.element_at(_beside(F.array_append("_parts", F.lit("")), True), -1).alias("before"))
    alone = known.join(marked.select(key, "_id").distinct(), [key, "_id"], "left_anti").join(end, key).select(key, "_id", "p", F.lit("").alias("label"), "at", "before", F.lit("").alias("after"), "_i", "_image")
    name = F.coalesce(F.nullif(F.col("_image.filename"), F.lit("")), F.concat(F.lit("clipboard-image-"), F.col("_i") + 1))
    alt = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.trim(F.coalesce(F.nullif(F.col("_image.alt"), F.lit("")), name)))
    told = F.coalesce("_image.description", F.lit(""))
    shown = F.concat(F.lit("!["), alt, F.lit("](asset://"), F.substring(F.sha2(F.unbase64("_image.data"), 256), 1, 16), F.lit(")"))
    pictures = marked.select(*alone.columns).unionByName(alone).select(
        key, F.col("p").alias("_p"), (F.lit(1 << 30) + F.col("_i")).alias("_n"), F.lit("IMAGE").alias("kind"), F.lit(0).alias("level"), F.trim(F.concat_ws("\n\n", F.nullif(told, F.lit("")), shown)).alias("content"), F.lit(None).cast("array<string>").alias("_own"),
        (F.col("_i") + 1).alias("image"), F.col("at").alias("char_offset"), "before", "after", F.coalesce(F.nullif(told, F.lit("")), F.nullif(alt, F.lit("")), name).alias("_visible"),
    )
    placed = blocks.unionByName(pictures).withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("_p", "_n")) - 1)
    carried = outline_paths(placed, key)
    path = F.when((F.col("kind") != "HEADING") & (F.size("_own") > 0), F.col("_own")).otherwise(F.col("path"))
    line = lambda label, x: F.when(x != "", F.concat(F.lit(label), x))
    embedding = F.when(F.col("kind") == "IMAGE", F.concat_ws("\n", line("章节: ", F.array_join("path", " > ")), line("图片前文: ", F.col("before")), F.concat(F.lit("图片内容: "), F.col("_visible")), line("图片后文: ", F.col("after"))))
    return carried.select(key, "block", "kind", "level", "content", path.alias("path"), "image", "char_offset", "before", "after", embedding.alias("embedding_text"))


_IMAGE = (("image", "int"), ("char_offset", "int"), ("before", "string"), ("after", "string"), ("_visible", "string"))
