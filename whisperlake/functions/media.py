"""Media types: kinds, labels, extensions and upload label order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from whisperlake.functions.text import as_col

# File name extension to media type.
TYPE_BY_EXTENSION = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".heic": "image/heic",
    ".mp4": "video/mp4",
    ".mov": "video/quicktime",
    ".3gp": "video/3gpp",
    ".webm": "video/webm",
    ".mp3": "audio/mpeg",
    ".m4a": "audio/mp4",
    ".aac": "audio/mp4",
    ".ogg": "audio/ogg",
    ".opus": "audio/ogg",
    ".wav": "audio/wav",
    ".flac": "audio/flac",
}
# Media type to extension, then the fallback per family.
EXTENSION_BY_TYPE = {
    "image/png": ".png",
    "image/webp": ".webp",
    "image/heic": ".heic",
    "video/quicktime": ".mov",
    "video/webm": ".webm",
    "video/3gpp": ".3gp",
    "audio/mpeg": ".mp3",
    "audio/ogg": ".ogg",
    "audio/wav": ".wav",
    "audio/flac": ".flac",
}
EXTENSION_BY_FAMILY = {"image/": ".jpg", "video/": ".mp4", "audio/": ".m4a"}
# Attachment kinds and their short labels.
KIND_BY_FAMILY = {"image": "Image", "video": "Video", "audio": "Audio"}
LABEL_BY_KIND = {"Image": "📷 Photo", "Video": "🎥 Video", "Audio": "🎤 Audio", "File": "📎 File"}
GENERIC_TYPE = "application/octet-stream"
MP4_AUDIO_TYPES = ("audio/mp4", "audio/aac", "audio/x-m4a")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def attachment_kind(mime: str | Column) -> Column:
    family = F.lower(F.substring_index(as_col(mime), "/", 1))
    return F.coalesce(_lookup(KIND_BY_FAMILY, family), F.lit("File"))


def attachment_label(mime: str | Column) -> Column:
    return _lookup(LABEL_BY_KIND, attachment_kind(mime))


def mime_from_name(name: str | Column) -> Column:
    """Media type by the last extension of a file name, any case; null when unknown."""
    return _lookup(TYPE_BY_EXTENSION, F.lower(F.regexp_extract(as_col(name), r"(\.[^./\\]+)\z", 1)))


def extension_for(mime: str | Column) -> Column:
    mime = as_col(mime)
    family = _lookup(EXTENSION_BY_FAMILY, F.concat(F.substring_index(mime, "/", 1), F.lit("/")))
    has_family = mime.contains("/")
    return F.coalesce(_lookup(EXTENSION_BY_TYPE, mime), F.when(has_family, family), F.lit(".bin"))


def upload_labels(mime: str | Column) -> Column:
    """Content types to offer a media server, in order."""
    mime = as_col(mime)
    generic = F.array(F.lit(GENERIC_TYPE))
    is_audio = mime.startswith("audio/")
    extra = F.array_compact(F.array(
        mime,
        F.when(is_audio & (mime != "audio/mpeg"), F.lit("audio/mpeg")),
        F.when(mime.isin(*MP4_AUDIO_TYPES), F.lit("video/mp4")),
    ))
    plain = F.coalesce((mime == "") | (mime == GENERIC_TYPE), F.lit(True))
    return F.when(plain, generic).otherwise(F.concat(generic, extra))
