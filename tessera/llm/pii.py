"""Personal data and secrets replaced by keyed surrogates (DataFrame operations only).

Each detected entity gets a surrogate derived by HMAC-SHA512 from a secret key, its kind and its
canonical form, so the same person, number or secret reads the same wherever and in whatever
notation it occurs; a name that a title has shown in a document is also replaced where it stands
there without one. The surrogate keeps kind, script, case, punctuation and length; card numbers and
IBANs stay valid if they are, phone numbers keep their country code, private addresses their
network, given names the gender that the title states.

Collision checks keep distinct entities distinct: the distinct entities of the whole corpus (a
narrow, pre-aggregated table) get their surrogates, and where one equals another entity's
surrogate or a real entity, all but the smallest of them draw again, until none collide. The few
redrawn ones are looked up in a literal map if they are `inline` or fewer, else by a join.
"""

from __future__ import annotations

import hashlib
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

# What is detected, by kind, first match first.
PATTERNS = {
    "secret": r"""(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,2}[=:]\s{0,2}["']?[A-Za-z0-9+/_.-]{6,}+""",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+",
    "aws": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "ip6": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\w)|(?<![\w+.-])[2-9]\d{2}[ .-][2-9]\d{2}[ .-]\d{4}(?![\w-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "name": r"(?<!\p{L})(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|M\.|Señora|Señor|Sra|Sr|Господин|Госпожа)\.? \p{Lu}[\p{L}'’]+(?:-\p{L}[\p{L}'’]+)*(?: \p{Lu}[\p{L}'’]+(?:-\p{L}[\p{L}'’]+)*)?",
}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Госпожа)"
NEUTRAL = r"^(?:Dr|Prof)"
_NAMES = ("given_f", "given_m", "given_n", "surname")
#: A text without any of these has no entity.
HINT = r"[0-9@]|(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|M\.|Señora?|Sra?|Господин|Госпожа)\.? \p{Lu}|(?:[A-Fa-f]{1,4}:){7}|(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,2}[=:]|(?:AKIA|ASIA)[A-Z]{16}|[a-f]{32}"
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga go ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe pi ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе би бо да де ди до га го ка ки ко ла ле ли ло лу ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви".split(),
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_STREAM = 128


#: Stands at both ends of a match, so that one pass of the patterns both finds and splits; a text that holds it takes two passes.
_MARK = "\uf8ff"


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA512 in hex digits."""
    block = key.encode()
    block = (hashlib.sha512(block).digest() if len(block) > 128 else block).ljust(128, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(x ^ b for x in block).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 512))), 512)


def _stream(key: str, kind: Column, canon: Column, salt: Column) -> Column:
    """256 hex digits."""
    return F.concat(*[_hmac(key, F.concat_ws("|", kind, salt.cast("string"), F.lit(str(j)), canon)) for j in range(2)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, F.pmod(i, F.lit(_STREAM)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _of(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _kind(match: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _parts(match: Column) -> Column:
    """array<struct<kind, form>>: what of a match is replaced; kind is empty for what stays."""
    part = lambda kind, form: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), form.alias("form"))
    cut = lambda m, pattern, kind: F.array(
        part("", F.regexp_extract(m, pattern, 1)), part(kind, F.regexp_extract(m, pattern, 2)), part("", F.regexp_extract(m, pattern, 3))
    )
    value = r"""^(.*?[=:]\s{0,2}["']?)([A-Za-z0-9+/_.-]+)(.*)$"""
    title = r"^([^ ]+ )(.*)$"
    gender = F.when(match.rlike(FEMALE), "given_f").when(match.rlike(NEUTRAL), "given_n").otherwise("given_m")
    names = let(
        F.split(F.regexp_extract(match, title, 2), " "),
        lambda w: F.when(
            F.size(w) > 1, F.array(part("", F.regexp_extract(match, title, 1)), part(gender, w[0]), part("", F.lit(" ")), part("surname", w[1]))
        ).otherwise(F.array(part("", F.regexp_extract(match, title, 1)), part("surname", w[0]))),
    )
    return let(
        _kind(match),
        lambda k: F.when(k == "name", names)
        .when(k == "secret", cut(match, value, "secret"))
        .when(k == "aws", cut(match, r"^(.{4})(.*)()$", "aws"))
        .when(k == "phone", cut(match, r"^((?:\+\d{1,3}(?=\D)[ .-]?)?)(.*)()$", "phone"))
        .otherwise(F.array(part(k, match))),
    )


def _core(form: Column) -> Column:
    return F.regexp_replace(form, "[^A-Za-z0-9]", "")


def canonical(kind: Column, form: Column) -> Column:
    """Equal for the notations of one entity."""
    return (
        F.when(kind.isin("email", "ip6", *_NAMES), F.lower(form))
        .when(kind.isin("phone", "card", "iban", "ssn"), _core(form))
        .otherwise(form)
    )


def _luhn(digits: Column) -> Column:
    """Check sum, 0 modulo 10 if valid."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
        ),
        F.lit(0),
        lambda acc, x: acc + x,
    )


def _mod97(iban: Column, check: Column) -> Column:
    """Remainder by 97 of an IBAN with the given check digits; letters count 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(2)), check)
    step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _mapped(kind: Column, core: Column, stream: Column) -> Column:
    """core with each digit and letter replaced by one of its class."""
    is_hex = (core.rlike("^[0-9a-f]+$") & kind.isin("secret", "hex")) | (kind == "ip6")

    def sign(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        digit = F.when((kind == "phone") & i.isin(0, 3), _of("23456789", b)).when((kind == "card") & (i == 0), c).otherwise(_of("0123456789", b))
        return (
            F.when(is_hex, _of("0123456789abcdef", b))
            .when(c.between("0", "9"), digit)
            .when(c.between("a", "z"), _of("abcdefghijklmnopqrstuvwxyz", b))
            .otherwise(_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
        )

    plain = F.array_join(F.transform(F.split(core, ""), sign), "")
    head = lambda m: F.substr(m, F.lit(1), F.length(m) - 1)
    checked = lambda m: F.concat(head(m), F.pmod(10 - _luhn(F.concat(head(m), F.lit("0"))) % 10, F.lit(10)).cast("string"))
    in_country = lambda m: F.concat(F.substr(core, F.lit(1), F.lit(2)), F.substr(m, F.lit(3)))
    with_check = lambda m: F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(m, F.lit("00"))).cast("string"), 2, "0"), F.substr(m, F.lit(5)))
    iban = lambda m: F.when(_mod97(core, F.substr(core, F.lit(3), F.lit(2))) == 1, with_check(m)).otherwise(m)
    return let(
        plain,
        lambda m: F.when((kind == "card") & (_luhn(core) % 10 == 0), checked(m)).when(kind == "iban", let(in_country(m), iban)).otherwise(m),
    )


def _filled(form: Column, core: Column, any_case: Column) -> Column:
    """form with its letters and digits replaced in turn by those of core."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        own = c.between("0", "9") | c.between("a", "z") | c.between("A", "Z")
        new = F.substr(core, acc["k"] + 1, F.lit(1))
        new = F.when(any_case & c.between("A", "Z"), F.upper(new)).otherwise(new)
        return F.struct(F.concat(acc["out"], F.when(own, new).otherwise(c)).alias("out"), (acc["k"] + own.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, put, lambda acc: acc["out"])


def _name(kind: Column, form: Column, stream: Column, salt: Column) -> Column:
    """A made-up name in the script and case of form, ending as its gender does."""

    def spell(part: Column, k: Column, script: str, female: str, male: str) -> Column:
        table = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        n = F.when(F.length(part) < 3, F.lit(1)).otherwise(F.least(F.when(kind == "surname", F.lit(3)).otherwise(F.lit(2)) + salt, F.lit(12)))
        at = lambda i: 24 * k + 2 * i
        body = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: table[(_byte(stream, at(i)) * 256 + _byte(stream, at(i) + 1)) % len(SYLLABLES[script])]), "")
        ending = F.when(kind == "given_f", F.lit(female)).when(kind == "given_m", F.lit(male)).otherwise(F.lit(""))
        return F.concat(body, ending)

    def part(p: Column, k: Column) -> Column:
        word = F.when(p.rlike(r"\p{IsCyrillic}"), spell(p, k, "cyrillic", "на", "р")).otherwise(spell(p, k, "latin", "na", "r"))
        shown = let(word, lambda w: F.when((p == F.upper(p)) & (F.length(p) > 1), F.upper(w)).otherwise(F.initcap(w)))
        return F.when(p.rlike(r"^\p{L}"), shown).otherwise(p)

    # hyphens and apostrophes stay where they are
    return F.array_join(F.transform(F.split(form, r"(?<=[-'’])|(?=[-'’])"), part), "")


def surrogate(kind: Column, form: Column, salt: Column, key: str) -> Column:
    """What stands for form: same kind, script, case and punctuation."""

    def made(stream: Column) -> Column:
        own = F.when(form.rlike(r"^(?:10|127)\."), 1).when(form.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2\d|3[01])|169\.254)\."), 2).otherwise(0)
        public = lambda i: F.when(i == 0, 11 + _byte(stream, i) % 89).otherwise(1 + _byte(stream, i) % 254)  # noqa: E731  11 to 99: never private
        octets = F.array_join(F.transform(F.split(form, r"\."), lambda o, i: F.when(i < own, o).otherwise(public(i).cast("string"))), ".")
        lead = F.regexp_extract(form, r"^(.*?)[A-Za-z0-9-]+\.[A-Za-z]+$", 1)
        domain = F.element_at(F.array(F.lit("example.com"), F.lit("example.net"), F.lit("example.org")), _byte(stream, F.lit(127)) % 3 + 1)
        fill = lambda part, any_case: let(_core(F.when(any_case, F.lower(part)).otherwise(part)), lambda c: let(_mapped(kind, c, stream), lambda m: _filled(part, m, any_case)))
        return (
            F.when(kind == "ip", octets)
            .when(kind == "email", F.concat(fill(lead, F.lit(True)), domain))
            .when(kind.isin(*_NAMES), _name(kind, form, stream, salt))
            .otherwise(fill(form, F.lit(False)))
        )

    return let(_stream(key, kind, canonical(kind, form), salt), made)


def segments(text: Column) -> Column:
    """array<struct<kind, form>>: the whole text in order, entities with their kind, the rest with an empty one."""
    literal = lambda s: F.array(F.struct(F.lit("").alias("kind"), s.alias("form")))
    marked = let(
        F.split(F.regexp_replace(text, f"({_ANY})", f"{_MARK}$1{_MARK}"), _MARK, -1),
        lambda ps: F.flatten(F.transform(ps, lambda p, i: F.when(i % 2 == 1, _parts(p)).otherwise(literal(p)))),
    )
    twice = let(
        F.split(text, _ANY, -1),
        lambda gaps: F.concat(
            F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({_ANY})"), F.lit(1)), lambda m, i: F.concat(literal(gaps[i]), _parts(m)))),
            literal(gaps[F.size(gaps) - 1]),
        ),
    )
    found = F.when(F.contains(text, F.lit(_MARK)), twice).otherwise(marked)
    return F.when(text.rlike(HINT), let(found, _later_names)).otherwise(literal(text))


def _later_names(parts: Column) -> Column:
    """parts, with the names among them also found where they stand alone in the rest."""
    shown = F.array_distinct(F.filter(parts, lambda p: p["kind"].isin(*_NAMES) & (F.length(p["form"]) > 2)))

    def look(names: Column) -> Column:
        def token(t: Column) -> Column:
            known = F.get(F.filter(names, lambda n: n["form"] == t), F.lit(0))
            return F.struct(F.coalesce(known["kind"], F.lit("")).alias("kind"), t.alias("form"))

        words = lambda p: F.split(p["form"], r"(?<=[\p{L}'’-])(?![\p{L}'’-])|(?<![\p{L}'’-])(?=[\p{L}'’-])", -1)
        # only names in this rest are looked for, and rests without one stay whole
        split = lambda p: let(F.filter(names, lambda n: F.contains(p["form"], n["form"])), lambda ns: F.when(F.size(ns) > 0, F.transform(words(p), token)).otherwise(F.array(p)))
        again = F.flatten(F.transform(parts, lambda p: F.when(p["kind"] == "", split(p)).otherwise(F.array(p))))
        return F.when(F.size(names) > 0, again).otherwise(parts)

    return let(shown, look)


def _redrawn(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, canon, salt) of the entities whose first surrogate collides; entities has (kind, canon, form), distinct by kind and canon."""
    real = entities.select("kind", F.col("canon").alias("shown"))
    taken, left, redrawn = None, entities, None
    for salt in count():
        drawn = left.withColumn("shown", canonical(F.col("kind"), surrogate(F.col("kind"), F.col("form"), F.lit(salt), key)))
        free = drawn.join(real, ["kind", "shown"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "shown"], "left_anti")
        given = materialize(free.groupBy("kind", "shown").agg(F.min("canon").alias("canon")), "given")
        lost = materialize(left.join(given, ["kind", "canon"], "left_anti"), "left")
        if salt:
            now = given.select("kind", "canon", F.lit(salt).alias("salt"))
            redrawn = now if redrawn is None else redrawn.unionByName(now)
        names = given.select("kind", "shown")
        taken = names if taken is None else taken.unionByName(names)
        left = lost
        if left.isEmpty():
            break
    empty = entities.select("kind", "canon", F.lit(0).alias("salt")).limit(0)
    return empty if redrawn is None else redrawn


def replace_entities(docs: DataFrame, key: str, text: str = "text", inline: int = 500) -> DataFrame:
    """docs with entities of `text` replaced, and n_entities (int). Who has the key can test guesses of an entity, so keep it secret.

    Null texts stay null, empty ones and texts without entities as they are (n_entities 0). Rows
    that repeat get the same result; an empty table gives an empty result; a column named
    n_entities is replaced, others are kept; names that start with "_pii" are reserved.
    """
    body = docs.drop("n_entities")
    found = (
        body.where(F.col(text).rlike(HINT))
        .select(F.explode(F.filter(segments(F.col(text)), lambda s: s["kind"] != "")).alias("s"))
        .select("s.kind", "s.form")
    )
    entities = materialize(
        found.groupBy("kind", canonical(F.col("kind"), F.col("form")).alias("canon")).agg(F.min("form").alias("form")), "entities"
    )
    redrawn = materialize(_redrawn(entities, key), "redrawn")
    few = redrawn.limit(inline + 1).collect()  # bounded by `inline`
    name = lambda s: F.concat_ws("|", s["kind"], canonical(s["kind"], s["form"]))
    rows = body
    if not few:
        salt = lambda s: F.lit(0)
    elif len(few) <= inline:
        table = F.create_map(*[F.lit(v) for r in few for v in (f"{r['kind']}|{r['canon']}", r["salt"])])
        salt = lambda s: F.coalesce(table[name(s)], F.lit(0))
    else:
        rows = body.withColumn("_pii_key", F.md5(text))
        own = (
            rows.where(F.col(text).rlike(HINT))
            .select("_pii_key", F.explode(F.filter(segments(F.col(text)), lambda s: s["kind"] != "")).alias("s"))
            .select("_pii_key", F.col("s.kind").alias("kind"), canonical(F.col("s.kind"), F.col("s.form")).alias("canon"))
            .distinct()
            .join(redrawn, ["kind", "canon"])
            .groupBy("_pii_key")
            .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "salt"))).alias("_pii_salts"))
        )
        rows = rows.join(own, "_pii_key", "left").drop("_pii_key")
        salt = lambda s: F.coalesce(F.col("_pii_salts")[name(s)], F.lit(0))
    put = lambda s: F.when(s["kind"] == "", s["form"]).otherwise(surrogate(s["kind"], s["form"], salt(s), key))
    done = let(
        segments(F.col(text)),
        lambda ss: F.struct(F.array_join(F.transform(ss, put), "").alias("text"), F.size(F.filter(ss, lambda s: s["kind"] != "")).alias("n")),
    )
    hit = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    return rows.withColumn("_pii", F.when(hit, done)).select(
        *[F.when(hit, F.col("_pii.text")).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in body.columns],
        F.when(hit, F.col("_pii.n")).otherwise(0).alias("n_entities"),
    )
