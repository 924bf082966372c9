"""Reading JSON that a model wrote: fences around it, prose before it, an array where an object was asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outermost(raw: Column) -> Column:
    """The text from the first opening to the last closing bracket, fences apart; null where there is none."""
    bare = F.regexp_replace(raw, "```(?:json)?", "")
    found = F.regexp_extract(bare, "(?s)(\\{.*\\}|\\[.*\\])", 1)
    return F.when(F.length(found) > 0, found)


def tolerant(raw: Column) -> Column:
    """The JSON object or array that a reply holds, as text, and `{}` where it holds none that is whole.

    Fences are left out. Looked at are all of the text, what lies between its outermost braces, and between its outermost
    brackets; the longest of them that is JSON counts, so that neither an array of objects nor a bracket in the prose misleads.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "```(?:json)?", ""))
    found = [bare, F.regexp_extract(bare, "(?s)\\{.*\\}", 0), F.regexp_extract(bare, "(?s)\\[.*\\]", 0)]
    whole = lambda c: F.when(c.rlike("^[{\\[]") & F.try_parse_json(c).isNotNull(), F.struct(F.length(c).alias("n"), c.alias("text")))
    return F.coalesce(F.greatest(*map(whole, found))["text"], F.lit("{}"))


def rescued_array(raw: Column, key: str) -> Column:
    """array<string> of the strings in `"key": [...]`, also where the object around it is broken."""
    inside = F.regexp_extract(raw, f'(?s)"{key}"\\s*:\\s*\\[(.*?)(?:\\]|$)', 1)
    return F.regexp_extract_all(inside, F.lit('"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1))


def clean_list(values: Column) -> Column:
    """Without nulls and blanks, as strings."""
    return F.filter(F.transform(values, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))


def shallow_merge(a: Column, b: Column) -> Column:
    """Map with b's entries over a's."""
    kept = F.map_filter(a, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(b), k), F.lit(False)))
    return F.coalesce(F.map_concat(kept, b), a, b)


def as_list(raw: Column) -> Column:
    """array<string> (JSON of each item) of a JSON array; of an object the first of its values that is an array, or else itself."""
    item = "array<variant>"
    texts = lambda xs: F.transform(xs, lambda x: F.to_json(x))
    whole = F.try_parse_json(raw)
    lists = F.filter(F.map_values(F.try_variant_get(whole, "$", "map<string,variant>")), lambda x: F.schema_of_variant(x).startswith("ARRAY"))
    of_object = F.when(F.size(lists) > 0, texts(F.try_variant_get(F.get(lists, 0), "$", item))).otherwise(F.array(F.to_json(whole)))
    kind = F.schema_of_variant(whole)
    return F.when(kind.startswith("ARRAY"), texts(F.try_variant_get(whole, "$", item))).when(kind.startswith("OBJECT"), of_object).otherwise(F.array().cast("array<string>"))


def director(raw: Column) -> Column:
    """A director's reply as a struct of review, scene, plot, camera, duration and `fallback` (true where there is no object to read).

    Lists are cleaned; a camera list that the object lacks is looked for anywhere in the reply; what of it slipped
    into the plot's pieces is cut off there.
    """
    text = outermost(raw)
    fields = F.from_json(text, "prev_chapter_review string, scene_design array<string>, plot_arrangement array<string>, camera_movement array<string>, duration_estimate string")
    found = lambda name: clean_list(F.coalesce(fields[name], F.array().cast("array<string>")))
    saved = clean_list(F.transform(rescued_array(raw, "camera_movement"), lambda x: F.replace(x, F.lit('\\"'), F.lit('"'))))
    camera = F.when(F.size(found("camera_movement")) > 0, found("camera_movement")).otherwise(saved)
    tidy = F.transform(found("plot_arrangement"), lambda p: F.trim(F.regexp_replace(p, '(?s),?\\s*"?camera_movement"?\\s*:\\s*\\[.*$', "")))
    plot = F.when(F.size(camera) > 0, tidy).otherwise(found("plot_arrangement"))
    broken = F.try_parse_json(text).isNull()
    return F.struct(F.trim(F.coalesce(fields["prev_chapter_review"], F.lit(""))).alias("review"), found("scene_design").alias("scene"), plot.alias("plot"), camera.alias("camera"), F.coalesce(fields["duration_estimate"], F.lit("")).alias("duration"), F.coalesce(broken, F.lit(True)).alias("fallback"))
