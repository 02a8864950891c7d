"""Text and number formats as JVM expressions: no UDFs.

fixed() rounds the exact binary value, ties to even; format_string() would round the shortest decimal half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks after which a caption chunk ends.
CHUNK_ENDS = ".,!?;:"


def fixed(x: Column, digits: int, width: int = 0) -> Column:
    """x with so many decimals, zero padded to width; wider values stay whole."""
    s = F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s) if width else s


def format_time(seconds: Column) -> Column:
    return fixed(seconds, 2, 6)


def format_duration(seconds: Column) -> Column:
    """12.3s below a minute, else 1m 02.3s; 119.97 becomes 1m 60.0s."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.concat(fixed(seconds, 1), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), fixed(seconds - minutes * 60, 1, 4), F.lit("s")))


def srt_timestamp(ms: Column) -> Column:
    """Whole milliseconds as HH:MM:SS,mmm."""
    ms = ms.cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def to_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, ties to even."""
    return F.rint(seconds * 1000).cast("long")


def strip(text: Column) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def token_text(kind: Column, text: Column) -> Column:
    """A token's text in a phrase: events stand in parentheses; blank is null."""
    s = strip(F.coalesce(text, F.lit("")))
    return F.when(s == "", F.lit(None)).when((kind == "audio_event") & ~s.startswith("("), F.concat(F.lit("("), s, F.lit(")"))).otherwise(s)


def close_marks(text: Column) -> Column:
    """No space before a comma, full stop, question or exclamation mark; colons and semicolons keep theirs."""
    for mark in ",.?!":
        text = F.replace(text, F.lit(f" {mark}"), F.lit(mark))
    return text


def caption_text(text: Column) -> Column:
    """White space squeezed, trailing commas, semicolons and colons off; full stops stay."""
    return F.regexp_replace(squeeze(text), r"[,;:]+$", "")


def speaker_tag(speaker: Column) -> Column:
    return F.when(speaker.isNull(), F.lit("")).otherwise(F.concat(F.lit(" S"), F.regexp_replace(speaker, "^speaker_", "")))


def transcript_path(source: Column, track: Column) -> Column:
    """The file a source's transcript is kept in; track 0 has no suffix."""
    stem = F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.when(track == 0, F.lit("")).otherwise(F.concat(F.lit(".track"), track.cast("string"))), F.lit(".json"))


def graph_path(path: Column) -> Column:
    """A path inside a filter graph: colons and quotes escaped."""
    return F.replace(F.replace(path, F.lit(":"), F.lit("\\:")), F.lit("'"), F.lit("\\'"))
