"""Column builders over file paths, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions per media type of the catalogue.
CATALOGUE_TYPES = {
    "image": [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".gif", ".webp"],
    "video": [".mp4", ".avi", ".mov", ".mkv", ".flv", ".wmv", ".m4v"],
    "audio": [".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a"],
}
# Extensions the fingerprint step accepts (no .gif, no .m4v).
FINGERPRINT_TYPES = {
    "image": [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp"],
    "video": [".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv"],
}
# MIME type per extension; anything else is an octet stream.
MIME_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".bmp": "image/bmp", ".tiff": "image/tiff",
    ".gif": "image/gif", ".webp": "image/webp", ".mp4": "video/mp4", ".avi": "video/x-msvideo",
    ".mov": "video/quicktime", ".mkv": "video/x-matroska", ".mp3": "audio/mpeg", ".wav": "audio/x-wav",
}
# Leading bytes of a file format, in hex, and the extensions they go with.
MAGIC = {"FFD8FF": (".jpg", ".jpeg"), "89504E470D0A1A0A": (".png",), "474946": (".gif",), "424D": (".bmp",),
         "49492A00": (".tiff",), "4D4D002A": (".tiff",)}

MEGABYTE = 1024 * 1024


def _little(value: int, size: int) -> str:
    return value.to_bytes(size, "little").hex()


def bitmap(pixels: Column, width: int, height: Column) -> Column:
    """An uncompressed 24-bit BMP file of grey `pixels` (rows from the top); the width must be a multiple of four."""
    if width % 4:
        raise ValueError("rows of a bitmap are padded to four bytes; take a width that needs no padding")
    size = height * width * 3
    number = lambda c: F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("int"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)])
    head = F.concat(F.lit("424d"), number(size + 54), F.lit(_little(0, 4) + _little(54, 4) + _little(40, 4) + _little(width, 4)), number(height),
                    F.lit(_little(1, 2) + _little(24, 2) + _little(0, 4)), number(size), F.lit(_little(2835, 4) * 2 + _little(0, 8)))
    lines = F.transform(F.sequence(height - 1, F.lit(0)), lambda y: F.slice(pixels, y * width + 1, F.lit(width)))
    body = F.array_join(F.transform(F.flatten(lines), lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3))), "")
    return F.unhex(F.concat(head, body))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def local_path(uri: Column) -> Column:
    """One spelling for the paths of the `binaryFile` and `image` sources."""
    return F.regexp_replace(uri, "^file:/+", "/")


def media_type(path: Column, types: dict[str, list[str]] = CATALOGUE_TYPES) -> Column:
    ext = extension(path)
    chain = None
    for name, extensions in types.items():
        chain = (F if chain is None else chain).when(ext.isin(extensions), name)
    return chain.otherwise("unknown")


def mime_type(path: Column) -> Column:
    pairs = [F.lit(x) for item in MIME_TYPES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("application/octet-stream"))


def is_media(path: Column, types: dict[str, list[str]] = CATALOGUE_TYPES) -> Column:
    return extension(path).isin([e for group in types.values() for e in group])


def magic_matches(content: Column, path: Column) -> Column:
    """Whether the leading bytes fit the extension; NULL when the format is not recognised."""
    head = F.hex(F.substring(content, 1, 8))
    chain = None
    for prefix, extensions in MAGIC.items():
        chain = (F if chain is None else chain).when(head.startswith(prefix), extension(path).isin(list(extensions)))
    return chain


def megabytes(size: Column) -> Column:
    return F.round(size / MEGABYTE, 2)


def clock(seconds: Column) -> Column:
    """Duration as m:ss."""
    whole = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), whole % 60)
