"""Media records: pictures and videos of a sample as visual tokens, what each sample costs, and summaries by task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.operators.ordered import percentiles
from gantry.session import materialise

#: Fields of a record that are summarised, and the shares of its distribution: fixed values.
FIELDS = "image_count visual_tokens_total text_tokens label_tokens repeated_prompt_tokens total_tokens image_token_ratio".split()
SHARES = {"min": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}
_LONG = "long"


def _picture(image: Column, patch: int, merge: int, temporal: int) -> Column:
    """struct(grid_thw, visual_tokens, frames, width, height, pixels, error) of struct(grid_thw, width, height, frames, visual_tokens, pixels)."""
    long = lambda c: image[c].cast(_LONG)
    frames, given, width, height = F.greatest(F.coalesce(long("frames"), F.lit(1)), F.lit(1)), image["grid_thw"], long("width"), long("height")
    sized = F.array(F.when(frames == 1, 1).otherwise(F.floor(frames / temporal)), F.floor(height / patch), F.floor(width / patch)).cast("array<long>")
    grid = F.when(given.isNotNull(), given.cast("array<long>")).otherwise(sized)
    tokens = (grid[0] * F.floor(grid[1] / merge) * F.floor(grid[2] / merge)).cast(_LONG)
    told, bad = long("visual_tokens"), lambda test: F.coalesce(test, F.lit(True))
    error = (
        F.when(F.coalesce(long("frames") < 0, F.lit(False)), "frames").when(given.isNotNull() & (F.size(given) != 3), "grid")
        .when(given.isNull() & (width.isNull() | height.isNull()), "no_size").when(given.isNull() & ((width <= 0) | (height <= 0)), "size")
        .when(given.isNull() & ((width % patch != 0) | (height % patch != 0)), "patches").when(given.isNull() & (frames > 1) & (frames % temporal != 0), "frames")
        .when(bad((grid[0] <= 0) | (grid[1] <= 0) | (grid[2] <= 0)), "grid").when(bad((grid[1] % merge != 0) | (grid[2] % merge != 0)), "merge")
        .when(told.isNotNull() & (told != tokens), "declared")
    )
    pixels = F.coalesce(long("pixels"), width * height)
    return F.struct(grid.alias("grid_thw"), tokens.alias("visual_tokens"), frames.alias("frames"), width.alias("width"), height.alias("height"), pixels.alias("pixels"), error.alias("error"))


def media_records(rows: DataFrame, *, patch: int = 14, merge: int = 2, temporal: int = 1, default_task: str = "causal_vl_sft") -> DataFrame:
    """sample_id, task_family, images, the fields of `FIELDS` and error, from sample_id, task_family, images, text_tokens, padded_tokens, label_tokens and repeated_prompt_tokens.

    Without text_tokens they are padded_tokens, which count one placeholder an image, less the images. `error` says what is
    wrong with a record, its first bad picture first; a record that has one is in no summary.
    """
    whole = lambda c: F.coalesce(F.col(c).cast(_LONG), F.lit(0))
    images = F.coalesce(F.transform("images", lambda i: _picture(i, patch, merge, temporal)), F.array().cast("array<struct<grid_thw:array<bigint>,visual_tokens:bigint,frames:bigint,width:bigint,height:bigint,pixels:bigint,error:string>>"))
    out = rows.withColumn("images", images).withColumn("image_count", F.size("images").cast(_LONG))
    out = out.withColumn("visual_tokens_total", F.aggregate("images", F.lit(0).cast(_LONG), lambda a, i: a + F.coalesce(i["visual_tokens"], F.lit(0))))
    out = out.withColumn("text_tokens", F.coalesce(F.col("text_tokens").cast(_LONG), F.col("padded_tokens").cast(_LONG) - F.col("image_count"), F.lit(0)))
    out = out.withColumns({"label_tokens": whole("label_tokens"), "repeated_prompt_tokens": whole("repeated_prompt_tokens"), "total_tokens": F.col("text_tokens") + F.col("visual_tokens_total")})
    family = F.trim(F.when(F.coalesce(F.col("task_family"), F.lit("")) == "", default_task).otherwise(F.col("task_family")))
    negative = (F.col("text_tokens") < 0) | (F.col("label_tokens") < 0) | (F.col("repeated_prompt_tokens") < 0)
    error = F.coalesce(F.try_element_at(F.filter(F.transform("images", lambda i: i["error"]), lambda e: e.isNotNull()), F.lit(1)), F.when(negative, "negative").when(F.col("total_tokens") < F.col("label_tokens"), "labels").when(family == "", "task"))
    return out.select(
        F.coalesce(F.col("sample_id").cast("string"), F.lit("")).alias("sample_id"), family.alias("task_family"), "images", "image_count", "visual_tokens_total", "text_tokens", "label_tokens", "repeated_prompt_tokens",
        "total_tokens", F.when(F.col("total_tokens") > 0, F.col("visual_tokens_total") / F.col("total_tokens")).otherwise(0.0).alias("image_token_ratio"), error.alias("error"),
    )


def media_values(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Different values of each field in each group and how often they are there, `times`; any coarser summary follows from them."""
    # written first: a filter on `error`, or on what is exploded, would otherwise be pushed below the records and work them out once for each mention
    fields = materialise(records.select(*keys, "error", *FIELDS, F.transform("images", lambda i: i["visual_tokens"]).alias("_each")), "media")
    entry = lambda name, value: F.struct(F.lit(name).alias("field"), value.cast("double").alias("value"))
    of_record = F.array(*(entry(f, F.col(f)) for f in FIELDS))
    of_image = F.transform("_each", lambda n: entry("visual_tokens_per_image", n))
    long = fields.where(F.col("error").isNull()).select(*keys, F.explode(F.concat(of_record, of_image)).alias("e")).select(*keys, "e.*")
    return long.groupBy(*keys, "field", "value").agg(F.count("*").alias("times"))


def summary_of(values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For each group and field of `media_values`: records or images (`n`), min, mean, p50, p90, p95, p99 and max; `visual_tokens_per_image` is over all images."""
    told = values.where(F.col("value").isNotNull())
    means = told.groupBy(*keys, "field").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("mean"))
    found = percentiles(told, [*keys, "field"], "value", SHARES, "times").withColumnRenamed("_count", "n")
    return found.join(means, [*keys, "field"]).select(*keys, "field", "n", "min", "mean", *(s for s in SHARES if s != "min"))


def media_summary(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`summary_of` the records' values; for several summaries of the same records keep their `media_values`."""
    return summary_of(media_values(records, keys), keys)
