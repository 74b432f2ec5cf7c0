"""String functions: keys, file names, labels and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spikeloom.functions.keys import recording_key


def split_index(index: Column) -> tuple[Column, Column]:
    """``{dataset}_unit_{n}`` at its last ``_unit_``: dataset and number; NULLs where it doesn't fit."""
    d, n = F.regexp_extract(index, r"^(.*)_unit_([^_]*)$", 1), F.regexp_extract(index, r"^(.*)_unit_([^_]*)$", 2)
    return F.when(d != "", d), F.when(d != "", n)


def batch_of(index: Column) -> Column:
    """The text before the last underscore."""
    return F.when(index.contains("_"), F.regexp_replace(index, r"_[^_]*$", "")).otherwise(index)


def sheet_name(file: Column) -> Column:
    """A store's file name as the sheet writes it: dots only, ``.cmcr`` at the end."""
    key = recording_key(file)
    return F.concat(F.regexp_replace(key, "-", "."), F.lit(".cmcr"))


def store_name(file: Column) -> Column:
    return F.concat(recording_key(file), F.lit(".h5"))


def started_at(file: Column) -> Column:
    """The time in a file's name; NULL where it is none."""
    return F.try_to_timestamp(F.regexp_extract(recording_key(file), r"^(.*)-Rec$", 1), F.lit("yyyy.MM.dd-HH.mm.ss"))


def label_unit(path: Column) -> tuple[Column, Column]:
    """Unit number and label of ``.../<label>/..._unit<n>.png``; the label in lower case."""
    n = F.regexp_extract(path, r"(?i)_unit(\d+)\.png$", 1)
    return F.when(n != "", n.cast("long")), F.when(n != "", F.lower(F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]+$", 1)))


def lane_list(text: Column) -> Column:
    """A comma list of 1-based numbers as sorted 0-based ones; other entries are skipped."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int") - 1)
    return F.sort_array(F.filter(parts, lambda x: x.isNotNull()))


def eye_position(text: Column) -> Column:
    """``eye,VD,NT`` as ``struct<eye, dv, nt>`` with ``dv = -VD``; NULL fields where a part is missing or no number."""
    p = F.split(text, ",")
    vd, nt = F.trim(F.get(p, F.lit(1))).try_cast("double"), F.trim(F.get(p, F.lit(2))).try_cast("double")
    ok = vd.isNotNull() & nt.isNotNull()
    return F.struct(F.when(ok, F.upper(F.trim(F.get(p, F.lit(0))))).alias("eye"), F.when(ok, -vd).alias("dv"), F.when(ok, nt).alias("nt"))


def safe_id(name: Column) -> Column:
    """Trailing dashes cut; NULL where characters remain that no path may hold."""
    cut = F.regexp_replace(name, "-+$", "")
    return F.when(~cut.rlike(r'[<>:"/\\|?*\x00-\x1f]') & (cut != ""), cut)


def has_words(name: Column, all_of: list[str], none_of: list[str]) -> Column:
    """Every keyword of the first list and none of the second."""
    out = F.lit(True)
    for w in all_of:
        out = out & name.contains(w)
    for w in none_of:
        out = out & ~name.contains(w)
    return out


def short_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def playlist_movies(text: Column) -> Column:
    """``['a.mov', 'b.mov']`` as an array of names without their ending; read as text, never evaluated."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"'([^']*)'"), 1), lambda m: F.regexp_replace(m, r"\.mov$", ""))
