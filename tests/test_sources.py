import json

from inkwell.operators import corpus
from inkwell.sources import providers as V
from inkwell.sources import readers as S
from inkwell.streaming import incremental as I


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("né".encode())
    (tmp_path / "b.txt").write_bytes("né".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "d.txt").write_bytes(b"x" * 40)
    got = {r.path.rsplit("/", 1)[1]: r for r in S.read_uploads(spark, str(tmp_path), limit=30).collect()}
    assert got["a.txt"].text == got["b.txt"].text == "né"
    assert got["c.pdf"].text is None and "no extractable text" in got["c.pdf"].error
    assert got["d.txt"].error == "file too large"


def test_json_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"papers": [{"title": "T", "keywords": ["a"], "word_count": 3}]}))
    assert S.read_papers(spark, str(tmp_path / "p.json")).first().title == "T"
    (tmp_path / "q.jsonl").write_text(json.dumps({"human_answers": ["h" * 200, "short"], "chatgpt_answers": ["m" * 200]}) + "\nnot json\n")
    assert sorted(r.label for r in S.read_answers(spark, str(tmp_path / "q.jsonl")).collect()) == [0, 1]


def test_folder_and_sinks(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("one\ntwo")
    (src / "b.bin").write_text("no")
    got = S.scan_folder(spark, str(src)).collect()
    assert [r.text for r in got] == ["one\ntwo"]
    S.write_report(S.inline(spark, ["x"]), str(tmp_path / "out"), "Report")
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "Report | doc_id: 0 | text: x"


def test_paper_record(spark):
    text = "Title: A Paper\nAbstract: We did it\nin two lines.\n\nKeywords: a, b\n\nIntroduction:\nIn 2019 we began."
    r = corpus.paper_records(S.inline(spark, [text])).first()
    assert (r.title, r.abstract, r.keywords, r.year) == ("A Paper", "We did it\nin two lines.", ["a", "b"], "2019")


class Upper:
    def generate(self, prompts):
        return [p.upper() for p in prompts]


def test_providers(spark):
    rows = S.inline(spark, ["hi"])
    assert V.generate(rows, "text").first().reply == V.OFFLINE
    assert V.generate(rows, "text", Upper()).first().reply == "HI"
    assert V.embed(rows, "text").first().embedding is None


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise V.Retryable("busy", after=5.0 if len(calls) == 1 else None)
        return "ok"

    assert V.with_retries(call, sleep=waits.append) == "ok"
    assert waits == [5.0, 2.0]
    assert V.wait_seconds(9) == 30.0 and V.wait_seconds(0, hint=1.0) == 1.25


def test_stream_equals_batch(spark, tmp_path):
    from inkwell.operators.style import citation_density

    rows = S.inline(spark, ["see [1]", "none here"])
    rows.write.parquet(str(tmp_path / "in"))
    I.run_query(I.stream_table(spark, str(tmp_path / "in")), citation_density, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, citation_density(rows).collect()))


def pdf_file(*contents, deflate=True):
    import zlib

    out = b"%PDF-1.4\n"
    for i, c in enumerate(contents):
        data = zlib.compress(c) if deflate else c
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n" % (2 * i + 1, 2 * i + 2)
        out += b"%d 0 obj << /Length %d%s >> stream\n" % (2 * i + 2, len(data), b" /Filter /FlateDecode" if deflate else b"") + data + b"\nendstream endobj\n"
    return out + b"startxref\n0\n%%EOF"


def test_pdf_text(spark, tmp_path):
    from inkwell.sources.pdf import pdf_text

    first = rb"BT /F1 12 Tf 72 700 Td (Hello \(PDF\)) Tj 0 -14 Td [(W) 20 (orld) -300 (again)] TJ ET"
    second = rb"BT (caf\351) Tj T* <FEFF00E9> Tj ET"
    for deflate in (True, False):
        raw = pdf_file(first, second, deflate=deflate)
        assert pdf_text(raw) == "Hello (PDF)\nWorld again\ncaf\u00e9\n\u00e9"
    (tmp_path / "a.pdf").write_bytes(raw)
    (tmp_path / "b.txt").write_bytes(b"\x93quoted\x94 \x80")
    (tmp_path / "c.txt").write_bytes(b"\x81\xe9")
    (tmp_path / "d.txt").write_bytes(b" \n")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in S.read_uploads(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] == ("Hello (PDF)\nWorld again\ncaf\u00e9\n\u00e9", None)
    assert got["b.txt"][0] == "\u201cquoted\u201d \u20ac" and got["c.txt"][0] == "\x81\u00e9" and got["d.txt"] == (None, "empty file")
    assert pdf_text(None) == pdf_text(b"") == pdf_text(b"%PDF-1.4 /Encrypt") == ""


def modern_pdf(pages, cmap):
    """Pages in an object stream, the tree in another order than the file, one font with a map to Unicode."""
    import zlib

    def stream(n, data, extra=b""):
        packed = zlib.compress(data)
        return b"%d 0 obj << /Length %d /Filter /FlateDecode%s >> stream\n" % (n, len(packed), extra) + packed + b"\nendstream endobj\n"

    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>" % b" ".join(b"%d 0 R" % (10 + i) for i in reversed(range(len(pages))))}
    bodies |= {5: b"<< /Type /Font /ToUnicode 7 0 R >>", 6: b"<< /Type /Font >>"}
    bodies |= {10 + i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (50 + i) for i in range(len(pages))}
    head, data = [], b""
    for n, body in bodies.items():
        head.append(b"%d %d" % (n, len(data)))
        data += body + b" "
    first = b" ".join(head) + b" "
    out = b"%PDF-1.5\n" + stream(30, first + data, b" /Type /ObjStm /N %d /First %d" % (len(bodies), len(first))) + stream(7, cmap)
    return out + b"".join(stream(50 + i, p) for i, p in enumerate(pages)) + b"startxref\n0\n%%EOF"


def test_pdf_of_today():
    """Object streams, the page tree's order, character maps, inherited resources."""
    from inkwell.sources.pdf import pdf_text

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <00E9> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660069> <D83DDE00>] endbfrange"
    raw = modern_pdf([b"BT /F2 9 Tf (second) Tj ET", b"BT /F1 12 Tf <000100020010> Tj [<00110012> -300 <00200021>] TJ /F2 9 Tf (\\351) Tj ET"], cmap)
    assert pdf_text(raw) == "H\u00e9abc fi\U0001f600\u00e9\nsecond"
    assert pdf_text(raw[:200]) == ""


def test_pdf_that_inflates_without_bound(monkeypatch):
    from inkwell.sources import pdf

    raw = pdf_file(b"BT (x) Tj ET" + b" " * 100_000)
    assert pdf.pdf_text(raw) == "x"
    monkeypatch.setattr(pdf, "INFLATED", 10_000)
    assert pdf.pdf_text(raw) == ""
