"""Content-type classes. Types are compared in lower case without outer space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from missive.functions.text import trim


def _plain(c: Column) -> Column:
    return F.lower(trim(F.coalesce(c, F.lit(""))))


def is_text(c: Column) -> Column:
    ct = _plain(c)
    return ct.startswith("text/") | ct.isin("application/xml", "application/json")


def is_smil(c: Column) -> Column:
    return _plain(c).contains("smil")


def is_smil_markup(body: Column) -> Column:
    text = trim(body)
    return text.startswith("<smil") | text.startswith("<?xml")


def is_vcard(c: Column) -> Column:
    return _plain(c).isin("text/vcard", "text/x-vcard", "text/directory")


def is_heic(c: Column) -> Column:
    return _plain(c).rlike("heic|heif")


def needs_video_conversion(c: Column) -> Column:
    """Also true of audio in a 3GPP container: the container is what is tested."""
    return _plain(c).rlike("3gpp?|3g2|video/x-matroska")


def needs_audio_conversion(c: Column) -> Column:
    return _plain(c).rlike("audio/amr|audio/3gpp")


def needs_conversion(c: Column) -> Column:
    """What a browser would not show as it is: image, video, audio, or null."""
    return F.when(is_heic(c), "image").when(needs_video_conversion(c), "video").when(needs_audio_conversion(c), "audio")


def is_listed_media(c: Column) -> Column:
    """Images and videos; audio and contact cards are not listed."""
    ct = F.lower(F.coalesce(c, F.lit("")))
    return ct.startswith("image/") | ct.startswith("video/")
