import zlib

from folianta.sources import pdf


def build(contents, flate=False):
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(contents)))
    parts = [b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", f"2 0 obj << /Type /Pages /Kids [{kids}] /Count {len(contents)} >> endobj\n".encode()]
    for i, c in enumerate(contents):
        body = zlib.compress(c) if flate else c
        parts.append(f"{10 + 2 * i} 0 obj << /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >> endobj\n".encode())
        parts.append(f"{11 + 2 * i} 0 obj << /Length {len(body)}{' /Filter /FlateDecode' if flate else ''} >>\nstream\n".encode() + body + b"\nendstream endobj\n")
    return b"".join(parts)


def test_items_have_places_and_sizes(spark, tmp_path):
    page = b"q 2 0 0 2 10 20 cm BT /F1 12 Tf 14 TL 1 0 0 1 5 6 Tm (Hello \\(x\\)) Tj T* [(Wo) -20 (rld)] TJ ET Q BT /F2 8 Tf 50 60 Td <414243> Tj ET"
    (tmp_path / "a.pdf").write_bytes(build([page, b"BT /F1 9 Tf (second) Tj ET"], flate=True))
    (tmp_path / "b.pdf").write_bytes(b"prose")
    rows = pdf.read_items(spark, str(tmp_path)).orderBy("path", "page", "seq").collect()
    assert [(r.page, r.seq, r.str, r.x, r.y, r.size, r.font_name) for r in rows if r.error is None] == [
        (1, 1, "Hello (x)", 20.0, 32.0, 24.0, "F1"),
        (1, 2, "World", 20.0, 4.0, 24.0, "F1"),
        (1, 3, "ABC", 50.0, 60.0, 8.0, "F2"),
        (2, 1, "second", 0.0, 0.0, 9.0, "F1"),
    ]
    assert [r.error for r in rows if r.error] == ["not a PDF"]


def test_revisions_from_a_column(spark):
    df = spark.createDataFrame([("r1", build([b"BT (one) Tj ET"])), ("r2", build([]))], "path string, content binary")
    assert {(r.path, r.str, r.error) for r in pdf.items(df).collect()} == {("r1", "one", None), ("r2", None, "no text")}
