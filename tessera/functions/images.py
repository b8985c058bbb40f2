"""Metadata from the names of image measurement files: expressions, no UDF."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

# Fixed values of the file-name convention.
SPECIES = {
    "Zebrafish": "ZFish", "zebrafish": "ZFish", "ZFish": "ZFish", "KFish": "KFish", "killi": "KFish", "Killi": "KFish", "Souris": "Mouse",
    "souris": "Mouse", "Mouse": "Mouse", "mouse": "Mouse", "MNMS": "Human", "Droso": "Droso", "Fly": "Droso", "Worm": "Worm",
}
CONDITIONS = {"Young": "Young", "young": "Young", "Old": "Old", "old": "Old"}
DIETS = {"IF": "IF", "if": "IF", "AL": "AL", "al": "AL"}


def _find(table: Mapping[str, str], text: Column) -> Column:
    """struct<value, rest>: canonical value of the longest token that occurs in text, and text without its first occurrence."""
    tokens = sorted(table, key=len, reverse=True)
    cut = lambda t: F.concat(F.substring_index(text, t, 1), F.substr(text, F.instr(text, t) + len(t)))
    found = lambda t: F.struct(F.lit(table[t]).alias("value"), cut(t).alias("rest"))
    none = F.struct(F.lit(None).cast("string").alias("value"), text.alias("rest"))
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), found(t)) for t in tokens], none)


def stem(name: Column) -> Column:
    """Base name without .txt (any case) and the suffix of measurement files."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?i)\.txt$", ""), "_MITO_measurements$", "")


def metadata(name: Column) -> Column:
    """struct<specie, condition, diet, subject_ID>; what a name doesn't tell is null."""
    whole = stem(name)
    prefix = F.regexp_replace(F.regexp_replace(whole, r"(?is)(?:grille|longitudinalfield).*$", ""), r"x\d+", "")
    found = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    subject = lambda left: F.coalesce(found(left, r"\d+[Ff]ish(\d+)"), found(left, r"(\d{2,})"), found(whole, r"(\d+)[Gg]rille"))
    done = lambda s, c, d: F.struct(s["value"].alias("specie"), c["value"].alias("condition"), d["value"].alias("diet"), subject(d["rest"]).alias("subject_ID"))
    return let(_find(SPECIES, prefix), lambda s: let(_find(CONDITIONS, s["rest"]), lambda c: let(_find(DIETS, c["rest"]), lambda d: done(s, c, d))))


def resolve_condition(from_name: Column, from_file: Column, allowed: tuple[str, ...] = ("Young", "Old")) -> Column:
    """struct<condition, differs>: the name's condition, else the file's if it is an allowed one; differs marks a file that contradicts its name."""
    known = F.when(from_file.isin(*allowed), from_file)
    return F.struct(F.coalesce(from_name, known).alias("condition"), F.coalesce(from_name != from_file, F.lit(False)).alias("differs"))
