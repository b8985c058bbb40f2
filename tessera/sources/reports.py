"""Sinks for summaries: CSV files, and a plain PDF of text pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers."""
    df.write.mode("error").csv(path, header=True)


def table_text(df: DataFrame, rows: int = 40) -> list[str]:
    """The first rows as aligned lines, for a report page; `rows` is the size of the page."""
    got = [list(map(str, df.columns)), *[["" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(rows).collect()]]
    widths = [max(map(len, column)) for column in zip(*got, strict=True)]
    return ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in got]


def pdf(pages: Sequence[tuple[str, Sequence[str]]], lines: int = 60) -> bytes:
    """A PDF of (title, lines) sections in a fixed-width font; long sections run over several pages."""
    escape = lambda s: s.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
    sheets = [(title, list(body[a : a + lines])) for title, body in pages for a in range(0, max(1, len(body)), lines)]
    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(sheets)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(sheets)),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>",
    ]
    for i, (title, body) in enumerate(sheets):
        drawn = b"BT /F 12 Tf 40 800 Td (%s) Tj /F 7 Tf 0 -20 Td 12 TL\n" % escape(title) + b"".join(b"(%s) Tj T*\n" % escape(s) for s in body) + b"ET"
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(drawn), drawn))
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, start=1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    index = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, index, len(objects) + 1, len(out))


def inspect(df: DataFrame) -> DataFrame:
    """Rows (column, type, n, missing, distinct, minimum, maximum), a single pass; distinct is approximate (HyperLogLog++)."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    simple = [c for c, t in kind.items() if not t.startswith(("array", "struct", "map", "binary"))]
    missing = lambda c: F.sum((F.col(c).isNull() | F.isnan(c) if kind[c] in ("double", "float") else F.col(c).isNull()).cast("long"))
    row = lambda c: F.struct(
        F.lit(c).alias("column"), F.lit(kind[c]).alias("type"), F.count(F.lit(1)).alias("n"), F.coalesce(missing(c), F.lit(0)).alias("missing"),
        F.approx_count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("minimum"), F.max(c).cast("string").alias("maximum"),
    )
    return df.agg(F.array(*[row(c) for c in simple]).alias("r")).select(F.explode("r").alias("r")).select("r.*")
