"""Metadata from file names: expressions over the array of name tokens, no UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file-name convention.
SPECIES = ("MNMS", "WORM", "WORMS", "FLY", "MOUSE")
TREATMENTS = {t: c for c in ("Vehicule", "Arac15", "Arac30") for t in (c, c.lower(), c.upper())}
#: Words that a name may hold and that say nothing.
SILENT = ("export", "expor", "DR+", "P1", "bis", "BIS", "FlowAIFlagged", "P1Flagged", "DRFlagged")
MARKERS = {"DR": "MtDeepRed", "DeepRed": "MtDeepRed", "DeepRed+": "MtDeepRed", "TMRM": "TMRM", "NM": "Not_Marked"}
MARKER_ORDER = ("TMRM", "MtDeepRed", "Not_Marked")
PASS_TOKENS = ("good", "events", "goodevents", "FlowAIGoodEvents")
DIETS = ("AL", "IF")
AGE_GROUPS = {"Young": "Young", "young": "Young", "YOUNG": "Young", "Old": "Old", "old": "Old", "OLD": "Old"}
AGE_BOUNDS = {"D": (0, 1000), "M": (0, 1000), "Y": (0, 200)}
MAX_ADDITIONS = 20
MAX_MINUTES = 1440


def words(name: Column) -> Column:
    """Tokens of a file's base name without .fcs (any case); empty ones dropped."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?i)\.fcs$", "")
    return F.filter(F.split(base, "_"), lambda t: t != "")


def first(tokens: Column, test) -> Column:
    return F.get(F.filter(tokens, test), F.lit(0))


def lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def one_of(tokens: Column, allowed: Sequence[str]) -> Column:
    return first(tokens, lambda t: t.isin(*allowed))


def required(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"no {what} in the file name")))


def subject_id(tokens: Column) -> Column:
    return first(tokens, lambda t: t.rlike("^[0-9]{3}$") & (t != "000"))


def age(tokens: Column) -> Column:
    """Number after D, M or Y; out of bounds raises. The unit is not kept."""
    token = first(tokens, lambda t: t.rlike("^[DMY][0-9]{2}$"))
    value = F.substring(token, 2, 2).cast("int")
    most = F.when(token.startswith("Y"), AGE_BOUNDS["Y"][1]).otherwise(AGE_BOUNDS["D"][1])
    return F.when(token.isNotNull(), F.when(value <= most, value).otherwise(F.raise_error(F.lit("age out of bounds")).cast("int")))


def age_group(tokens: Column) -> Column:
    return lookup(AGE_GROUPS, one_of(tokens, tuple(AGE_GROUPS)))


def specie(tokens: Column) -> Column:
    return one_of(tokens, SPECIES)


def treatment(tokens: Column) -> Column:
    return lookup(TREATMENTS, one_of(tokens, tuple(TREATMENTS)))


def dilution(tokens: Column) -> Column:
    return F.when(F.array_contains(tokens, "ND"), "Not_Diluted").otherwise("Diluted")


def marker(tokens: Column) -> Column:
    """All markers, in a fixed order, joined by +; null without any."""
    found = F.transform(F.filter(tokens, lambda t: t.isin(*MARKERS)), lambda t: lookup(MARKERS, t))
    ordered = F.filter(F.array(*[F.lit(m) for m in MARKER_ORDER]), lambda m: F.array_contains(found, m))
    return F.when(F.size(found) > 0, F.array_join(ordered, "+"))


def qc_pass(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in PASS_TOKENS]))


def condition(tokens: Column, products: Sequence[str], known: Sequence[str] = ()) -> Column:
    """struct<condition, additions, minutes, unrecognised> by a fold over the tokens.

    A product is an addition and resets the wait; a time such as 30min after a product is its wait
    (bounds are checked); a time before any product, and any other token that is neither metadata
    nor in `known`, is unrecognised. Without products the condition is No_addition.
    """
    meta = (*known, *MARKERS, *PASS_TOKENS, *DIETS, *AGE_GROUPS, "ND")
    start = F.struct(
        F.array().cast("array<string>").alias("parts"),
        F.lit(0).alias("additions"),
        F.lit(None).cast("double").alias("minutes"),
        F.array().cast("array<string>").alias("unrecognised"),
    )

    def step(acc: Column, t: Column) -> Column:
        number = F.regexp_extract(t, r"^(\d+)", 1).cast("double")
        unit = F.lower(F.regexp_extract(t, r"(?i)^\d+(s|min|h)$", 1))
        wait = number * F.when(unit == "s", 1 / 60).when(unit == "min", 1.0).otherwise(60.0)
        fine = F.when(wait <= MAX_MINUTES, wait).otherwise(F.raise_error(F.lit("wait out of bounds")).cast("double"))
        written = F.concat(F.regexp_extract(t, r"^(\d+)", 1), unit)
        is_time = t.rlike(r"(?i)^\d+(s|min|h)$")
        skip = t.isin(*meta) | t.rlike("^[0-9]{3}$") | t.rlike("^[DMY][0-9]{2}$")

        def state(parts=None, additions=None, minutes=None, unrecognised=None) -> Column:
            return F.struct(
                (acc["parts"] if parts is None else parts).alias("parts"),
                (acc["additions"] if additions is None else additions).alias("additions"),
                (acc["minutes"] if minutes is None else minutes).alias("minutes"),
                (acc["unrecognised"] if unrecognised is None else unrecognised).alias("unrecognised"),
            )

        return (
            F.when(t.isin(*products), state(F.concat(acc["parts"], F.array(t)), acc["additions"] + 1, F.lit(None).cast("double")))
            .when(is_time & (acc["additions"] > 0), state(F.concat(acc["parts"], F.array(written)), minutes=fine))
            .when(is_time | ~skip, state(unrecognised=F.concat(acc["unrecognised"], F.array(t))))
            .otherwise(acc)
        )

    def done(acc: Column) -> Column:
        label = F.when(acc["additions"] == 0, "No_addition").otherwise(F.array_join(acc["parts"], "_"))
        count = F.when(acc["additions"] <= MAX_ADDITIONS, acc["additions"]).otherwise(F.raise_error(F.lit("too many additions")).cast("int"))
        return F.struct(label.alias("condition"), count.cast("long").alias("additions"), acc["minutes"].alias("minutes"), acc["unrecognised"].alias("unrecognised"))

    return F.aggregate(tokens, start, step, done)


def declared_column(tokens: Column, values: Mapping[str, str]) -> Column:
    """The one value among the declared words of a name; none is null, two different ones raise."""
    found = F.array_distinct(F.transform(F.filter(tokens, lambda t: t.isin(*values)), lambda t: lookup(values, t)))
    return F.when(F.size(found) > 1, F.raise_error(F.concat(F.lit("two values in one name: "), F.array_join(found, ", "))).cast("string")).otherwise(
        F.get(found, F.lit(0))
    )


def csv_subject(raw: Column) -> Column:
    """First digits as an id of three digits at least; null without digits."""
    digits = F.regexp_extract(raw, r"(\d+)", 1)
    return F.when(digits != "", F.format_string("%03d", digits.cast("long")))


def natural_order(value: Column) -> tuple[Column, Column]:
    """Sort keys: the first digits in a label (none: last), then the label."""
    return F.coalesce(F.nullif(F.regexp_extract(value, r"(\d+)", 1), F.lit("")).cast("long"), F.lit(999_999)), value
