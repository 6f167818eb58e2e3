"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A caption's length and its default, and characters no file name may have.
CAPTION_CHARS, CAPTION_DEFAULT = 80, "highlight"
_FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


def safe_caption(text: Column) -> Column:
    """A caption fit for a file name: blanks of any script collapsed, 80 characters at most."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, _FORBIDDEN, ""), r"(?U)\s+", " "))
    cut = F.rtrim(F.substring(clean, 1, CAPTION_CHARS), F.lit(". "))
    return F.when(F.coalesce(cut, F.lit("")) == "", CAPTION_DEFAULT).otherwise(cut)


#: Fixed value: where a note tells the time of what was missed.
_OFFSET = r"(\d+(?:\.\d+)?)\s*sec"


def offset_seconds(notes: Column) -> Column:
    """The first number before "sec" in a note, or null."""
    return F.regexp_extract(notes, _OFFSET, 1).try_cast("double")


def clip_name(idx: Column) -> Column:
    """clip_001.mp4; numbers past 999 grow wider."""
    return F.format_string("clip_%03d.mp4", idx)


def flagged_name(idx: Column, distance: Column, agreement: Column, strategy: Column, clip: Column) -> Column:
    stem = F.regexp_replace(clip, r"\.[^.]*$", "")
    return F.format_string("%03d - dist%.2f - %s - %s_%s.mp4", idx, F.coalesce(distance, F.lit(1.0)), F.coalesce(agreement, F.lit("no_verdict")), strategy, stem)


def fixed(value: Column, digits: int = 2) -> Column:
    """A number with so many decimals, or n/a."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", value))
