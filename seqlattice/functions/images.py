"""Image references of message samples: tokens in message text, id-to-path maps, resolution in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two token grammars. Extraction takes any name; merging only numbered input and output images.
ANY_TOKEN = r"<([A-Za-z0-9_]+)>"
NUMBERED_TOKEN = r"<(input_image_\d+|output_image_\d+)>"


def image_tokens(messages: Column, grammar: str = ANY_TOKEN) -> Column:
    """Image tokens of all messages in order. Null messages or contents have none."""
    found = F.transform(messages, lambda m: F.coalesce(F.regexp_extract_all(m["content"], F.lit(grammar), F.lit(1)), F.array().cast("array<string>")))
    return F.coalesce(F.flatten(found), F.array().cast("array<string>"))


def image_entries(input_images: Column, output_images: Column) -> Column:
    """(id, path) of input, then output images; entries with a null id or path are left out."""
    none = F.array().cast("array<struct<id:string,path:string>>")
    return F.filter(F.concat(F.coalesce(input_images, none), F.coalesce(output_images, none)), lambda e: e["id"].isNotNull() & e["path"].isNotNull())


def image_map(input_images: Column, output_images: Column) -> Column:
    """Map id -> path. Of entries with one id the last wins, so output images replace input images."""
    placed = F.transform(image_entries(input_images, output_images), lambda e, i: F.struct(e["id"].alias("id"), (-i).alias("back"), e["path"].alias("path")))
    # sorted by id, the last entry of each id comes first
    last = F.transform(F.array(F.array_sort(placed)), lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["id"] != e["id"])))
    return F.map_from_entries(F.transform(F.element_at(last, 1), lambda e: F.struct(e["id"], e["path"])))


def resolve_images(tokens: Column, images: Column, on_missing: str = "skip") -> Column:
    """Paths of the tokens in order; a token without image is skipped, kept as null, or (``error``) fails the query."""
    paths = F.transform(tokens, lambda t: F.try_element_at(images, t))
    if on_missing == "skip":
        return F.filter(paths, lambda p: p.isNotNull())
    if on_missing == "null":
        return paths
    if on_missing == "error":
        return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(images, t), F.raise_error(F.concat(F.lit("Missing image id: "), t))))
    raise ValueError(f"on_missing: {on_missing}")


def missing_image(tokens: Column, images: Column) -> Column:
    """The first token without image, or null."""
    return F.try_element_at(F.filter(tokens, lambda t: ~F.map_contains_key(images, t)), F.lit(1))


def sequence_key(paths: Column) -> Column:
    """64-bit shuffle key of a sequence; equality still needs the paths themselves."""
    return F.xxhash64(paths)


def valid_sequence(paths: Column) -> Column:
    """Sequences that are lists with at least one element."""
    return paths.isNotNull() & (F.size(paths) > 0)


def parse_sequence(text: Column) -> Column:
    """A list of paths from its text form (JSON, or single-quoted); anything else is null."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def image_flags(n_input: Column, n_output: Column) -> Column:
    """Two false flags for each input image, then a true one for each output image; null without images."""
    flags = F.concat(F.array_repeat(F.lit(False), 2 * n_input), F.array_repeat(F.lit(True), n_output.cast("int")))
    return F.when((n_input > 0) | (n_output > 0), flags)


def flatten_messages(parts: Column) -> tuple[Column, Column]:
    """(images, prompt) of ordered (type, value) parts: image values as an array, text values put together."""
    of = lambda kind: F.transform(F.filter(parts, lambda p: p["type"] == kind), lambda p: p["value"])
    return of("image"), F.array_join(of("text"), "")
