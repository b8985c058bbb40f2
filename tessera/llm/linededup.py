"""Repeated passages by content-defined chunks of lines (DataFrame operations only).

A text is cut into lines at line feeds, and these into their sentences. Each such line has a digest;
a rolling value over the digests of `window` lines ends a chunk after a line where it is 0 modulo
`every`. A written line of `long` characters or more, a paragraph, also begins and ends one, and no
rolling value reaches beyond its ends. So boundaries depend on nearby text alone, and a passage that is moved, or has other
text around it, is cut at the same places. A chunk whose digest occurs elsewhere too is compared
byte by byte with the first such chunk in order of (doc_id, digest of the text, place); if equal,
it is removed. Chunks of one line below `long` go only with a removed chunk beside them.

Plan: one pass writes the chunks' digests as narrow rows; they are counted (pre-aggregated, so a
passage in a third of all documents costs one row a task) and the repeated ones looked up. Digests
that make a thousandth of all rows or more, a thousand at most, are looked up in a broadcast table
or dealt over `salts` tasks, so no hot key meets in one. One join brings each document's repeated
chunks to its text, the only shuffle of texts; what it gives is written to the shared folder, from
which chunks are compared and texts rebuilt, in n log n steps at most for n lines of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, remove

#: Values below this fit the rolling sum in a long.
_MODULUS = 1_000_003
#: Digests with this share of all rows or more count as hot; so there are a thousand at most.
_HOT_SHARE = 1000


def _digest(text: Column) -> Column:
    """60 bits."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _bare(line: Column) -> Column:
    return F.rtrim(line, F.lit(" \n"))


def short_lines(text: Column, long: int) -> Column:
    """array<struct<t, ends>>: the text in pieces, blanks and line feeds kept, and whether a chunk must end after each."""

    def pieces(lines: Column) -> Column:
        def of_line(line: Column, i: Column) -> Column:
            whole = F.when(i + 1 < F.size(lines), F.concat(line, F.lit("\n"))).otherwise(line)
            # get() gives null beyond the last line
            apart = (F.length(line) >= long) | F.coalesce(F.length(F.get(lines, i + 1)) >= long, F.lit(False))
            return let(
                F.filter(F.split(whole, "(?<=[.!?] )", -1), lambda p: p != ""),
                lambda ps: F.transform(ps, lambda p, j: F.struct(p.alias("t"), (apart & (j + 1 == F.size(ps))).alias("ends"))),
            )

        return F.flatten(F.transform(lines, of_line))

    return let(F.split(text, "\n", -1), pieces)


def chunks(lines: Column, window: int, every: int) -> Column:
    """array<struct<at, n, chars, digest>>: first line (from 0), number of lines, characters and digest of each chunk, in order."""
    total = F.size(lines)

    def ends(digests: Column) -> Column:
        def rolled(k: Column) -> Column:
            values, here = [], F.lit(True)
            for back in range(window):
                if back:  # not beyond the begin of a paragraph
                    here = here & ~F.coalesce(F.get(lines, k - 1 - back)["ends"], F.lit(True))
                values.append(F.when(here, F.get(digests, k - 1 - back) % _MODULUS).otherwise(F.lit(0).cast("long")))
            out = values.pop()
            while values:
                out = (out * 31 + values.pop()) % _MODULUS
            return out

        return F.filter(F.sequence(F.lit(1), total), lambda k: (k == total) | F.get(lines, k - 1)["ends"] | (rolled(k) % every == 0))

    def cut(digests: Column, e: Column) -> Column:
        def one(end: Column, i: Column) -> Column:
            def of(at: Column) -> Column:
                own = F.slice(lines, at + 1, end - at)
                chars = F.aggregate(own, end - at - 1, lambda acc, u: acc + F.length(_bare(u["t"])))
                return F.struct(at.alias("at"), (end - at).alias("n"), chars.alias("chars"), F.xxhash64(F.slice(digests, at + 1, end - at)).alias("digest"))

            return let(F.when(i == 0, 0).otherwise(F.get(e, i - 1)), of)

        return F.transform(e, one)

    found = let(F.transform(lines, lambda u: _digest(_bare(u["t"]))), lambda d: let(ends(d), lambda e: cut(d, e)))
    return F.when(total > 0, found).otherwise(F.array().cast("array<struct<at:int,n:int,chars:int,digest:bigint>>"))


def _chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.transform(F.slice(lines, chunk["at"] + 1, chunk["n"]), lambda u: _bare(u["t"])), "\n")


def drop_repeated_chunks(
    docs: DataFrame, text: str = "text", window: int = 2, every: int = 3, long: int = 200, short: int = 10, salts: int = 64
) -> DataFrame:
    """docs, with repeated chunks cut out of `text`, and n_chunks, n_removed, removed_lines (int).

    Of equal chunks (blanks at line ends aside) the first in order of doc_id (null last), digest of
    the text and place stays; rows that share doc_id and text count as one document and are treated
    alike. A chunk of one line counts if it has `short` characters; below `long` it is removed only
    if a neighbour is. What stays of a text is its other lines as they are; a text of which all is
    removed becomes empty. Null texts stay null, empty ones empty; they have no chunk. An empty
    table gives an empty result. Columns of docs whose names clash with the new ones are replaced;
    names that start with "_ld" are reserved.
    """
    if window < 1 or every < 1 or not 1 <= short <= long:
        raise ValueError("window, every and short must be 1 or more, long at least short")
    body = docs.drop("n_chunks", "n_removed", "removed_lines")
    key = F.xxhash64(F.col(text).cast("string"))
    units = short_lines(F.col(text).cast("string"), long)

    listed = materialize(
        body.where(F.length(text) > 0)
        .select(F.col("doc_id").alias("id"), key.alias("key"), let(units, lambda ls: chunks(ls, window, every)).alias("cs"))
        .select(
            "id",
            "key",
            F.size("cs").alias("n_chunks"),
            F.filter("cs", lambda c: (c["n"] > 1) | (c["chars"] >= short)).alias("cs"),
        ),
        "chunks",
    )
    narrow = listed.select("id", "key", F.explode("cs").alias("c")).select("id", "key", "c.*")
    total = narrow.count()
    repeated = materialize(
        narrow.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", (F.col("n") * _HOT_SHARE >= total).alias("hot")), "repeated"
    )
    hot, quiet = F.broadcast(repeated.where("hot")), repeated.where("not hot")  # a thousand rows at most are hot
    found = materialize(narrow.join(hot, "digest").unionByName(narrow.join(hot.select("digest"), "digest", "left_anti").join(quiet, "digest")), "found")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "at")
    firsts = found.groupBy("digest", "hot").agg(F.min(place).alias("first"))
    placed = (
        found.where("hot").drop("hot").join(F.broadcast(firsts.where("hot")), "digest").unionByName(found.where("not hot").drop("hot").join(firsts.where("not hot"), "digest"))
    )
    # rows that share doc_id and text give each chunk twice: collect_set
    candidates = placed.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("at", "n", "chars", "digest", (place == F.col("first")).alias("is_first"), "hot"))).alias("_ld_found"))
    sizes = listed.groupBy("id", "key").agg(F.min("n_chunks").alias("n_chunks"))
    per_doc = sizes.join(candidates.withColumnsRenamed({"id": "_ld_id", "key": "_ld_of"}), F.col("id").eqNullSafe(F.col("_ld_id")) & (F.col("key") == F.col("_ld_of")), "left").select(
        F.col("id").alias("_ld_id"), F.col("key").alias("_ld_of"), "n_chunks", "_ld_found"
    )
    joined = materialize(
        body.withColumn("_ld_key", key).join(per_doc, F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_key") == F.col("_ld_of")), "left").drop("_ld_id", "_ld_of"),
        "candidates",
    )

    # byte comparison with the first of its digest
    bytes_of = let(units, lambda ls: F.transform("_ld_found", lambda f: F.struct(f.alias("f"), _chunk_text(ls, f).alias("bytes"))))
    shown = materialize(joined.where("_ld_found is not null").select("doc_id", "_ld_key", F.explode(bytes_of).alias("s")).select("doc_id", "_ld_key", "s.f.*", "s.bytes"), "bytes")
    texts = shown.where("is_first").groupBy("digest", "hot").agg(F.min("bytes").alias("first_bytes"))
    dealt = texts.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "_ld_key", "at"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    differ = materialize(
        shown.where("not is_first").withColumn("salt", salt).join(dealt, ["digest", "salt"]).where("bytes <> first_bytes").select(F.col("doc_id").alias("_ld_id"), F.col("_ld_key").alias("_ld_of"), "at"),
        "differ",
    )
    for done in (listed, repeated, found, shown):
        remove(done)
    spared = F.array().cast("array<int>")
    if not differ.isEmpty():  # two texts with one digest
        listed = differ.groupBy("_ld_id", "_ld_of").agg(F.collect_set("at").alias("_ld_spared"))
        joined = joined.join(listed, F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_key") == F.col("_ld_of")), "left").drop("_ld_id", "_ld_of")
        spared = F.coalesce("_ld_spared", spared)
    equal = F.filter("_ld_found", lambda f: ~f["is_first"] & ~F.array_contains(spared, f["at"]))

    def decide(same: Column) -> Column:
        end = lambda f: f["at"] + f["n"]
        beside = lambda f, i: F.coalesce(end(F.get(same, i - 1)) == f["at"], F.lit(False)) | F.coalesce(F.get(same, i + 1)["at"] == end(f), F.lit(False))
        return F.filter(same, lambda f, i: (f["n"] > 1) | (f["chars"] >= long) | beside(f, i))

    def result(gone: Column) -> Column:
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1)["at"] + F.get(gone, i - 1)["n"])
        joined_text = lambda ls, a, b: F.array_join(F.transform(F.slice(ls, a + 1, b - a), lambda u: u["t"]), "")
        kept = lambda ls: F.concat(
            F.array_join(F.transform(gone, lambda f, i: joined_text(ls, begin(i), f["at"])), ""), joined_text(ls, begin(F.size(gone)), F.size(ls))
        )
        return F.struct(
            F.when(F.size(gone) > 0, let(units, kept)).otherwise(F.col(text)).alias("text"),
            F.size(gone).alias("n_removed"),
            F.aggregate(gone, F.lit(0), lambda acc, f: acc + f["n"]).alias("removed_lines"),
        )

    done = joined.withColumn("_ld_out", F.when(F.col("_ld_found").isNotNull(), let(let(equal, decide), result)))
    cut = F.col("_ld_out").isNotNull()
    return done.select(
        *[F.when(cut, F.col("_ld_out.text")).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in body.columns],
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.coalesce("_ld_out.n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("_ld_out.removed_lines", F.lit(0)).alias("removed_lines"),
    )
