"""Functions on files, paths and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Usual types of files by extension.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml",
    "webm": "video/webm", "mp4": "video/mp4", "mp3": "audio/mpeg", "ogg": "audio/ogg", "flac": "audio/flac", "wav": "audio/wav",
    "pdf": "application/pdf", "txt": "text/plain", "zip": "application/zip", "epub": "application/epub+zip", "html": "text/html", "json": "application/json",
}
DEFAULT_MIME = "application/octet-stream"
#: Types a perceptual hash is made of.
HASHED_MIME = ("image/jpeg", "image/png", "image/gif")


def extension(path: Column) -> Column:
    """The last extension of a path without its dot; empty where there is none."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def bare(ext: Column) -> Column:
    """An extension in one form: lower case, no dots around it; null where nothing is left."""
    plain = F.regexp_replace(F.lower(F.trim(ext)), r"^\.+|\.+$", "")
    return F.when(plain != "", plain)


def mime_of(ext: Column) -> Column:
    """The type of a file by its extension, in any writing."""
    types = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(types[F.coalesce(bare(ext), F.lit(""))], F.lit(DEFAULT_MIME))


def media_path(root: Column, site: Column, board: Column, thread_no: Column, name: Column, ext: Column, thumbnail: bool = False) -> Column:
    """Where an archived file lies: root/site/board/thread/name.ext, thumbnails with a prefix."""
    stem = F.concat(F.lit("thumbnail_"), name) if thumbnail else name
    return F.concat_ws("/", root, site, board, thread_no.cast("string"), F.concat(stem, F.coalesce(F.concat(F.lit("."), bare(ext)), F.lit(""))))


def zigzag_decode(n: Column) -> Column:
    """Unsigned 64-bit zig-zag (as the bits of a bigint) to signed."""
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1).cast("bigint")))


def zigzag_encode(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two stored perceptual hashes. They are stored zig-zag decoded, which distorts distances, so they are encoded again first."""
    return F.bit_count(zigzag_encode(a).bitwiseXOR(zigzag_encode(b)))


def int_of(text: Column) -> Column:
    """A number given as a number or as a string: rounded down; null where it is none."""
    return F.floor(text.try_cast("double")).cast("bigint")
